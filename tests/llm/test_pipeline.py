import corpus_pipeline
from sparkfield.llm import tokens

from .test_decontaminate import brute as leaks
from .test_jaccard import brute as parts
from .test_quality import kept_by_hand

SF = "/root/testdata/sf0.001"


def survivors(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d, kept in zip(docs, kept_by_hand([t for _, t in docs])) if kept]
    part = {d: c for d, _, c in parts(docs, 5, 80)}
    docs = [d for d in docs if part[d[0]] == d[0]]
    return {r[0] for r in leaks(docs, items) if not r[-1]}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == survivors(spark)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for runs in sequences.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 1024
    encode = tokens.encoder(tokens.default_vocabulary())
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain = [d for d in {r.doc_id for r in out} if not any(c.isdigit() or c == "@" for c in docs[d].text)]
    for d in plain:
        assert sum(r.length for r in out if r.doc_id == d) == len(encode([docs[d].text])[0]) // 4 + 1


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(None, None), (-1, ""), (None, rows[0][1]), rows[1], (-2, " ".join(f"{a} {b}." for a, b in zip(rows[2][1].split() * 40, rows[3][1].split() * 60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as q", "'x' as votes", "3 as r1", "4 as sketch", "5 as h", "6 as new")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = corpus_pipeline.common.written(out, "stage")
    ids = [r.doc_id for r in docs.where("piece = 0").collect()]
    assert len(ids) == len(set(ids)) and -1 not in ids and None not in ids


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0
