import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfield.llm import token_output as T
from sparkfield.llm import tokens


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 900, 901, 70000], list(range(0, 5000, 7)), [10**7] * 700])
def test_elias_fano_round_trip(values):
    last = values[-1] if values else 0
    ef = T.EliasFano(len(values), last, memoryview(T.EliasFano.encode(np.array(values, np.uint64), last)))
    assert [ef.select(k) for k in range(len(values))] == values


def test_a_code_takes_little_more_than_it_must():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    code = T.EliasFano.encode(values, int(values[-1]))
    assert 8 * len(code) / len(values) < np.log2(values[-1] / len(values)) + 3.2
    assert T.EliasFano(len(values), int(values[-1])).size == len(code)


@pytest.mark.parametrize("names", [[None, None], [None, -5, -5, 0, 7], [-(2**63), 0, 2**63 - 1], [9] * 100, list(range(-300, 300, 3))])
def test_names_and_ends(names):
    lengths = np.arange(1, len(names) + 1)
    volume = T.Volume(T.pack_volume(names, lengths, np.arange(lengths.sum(), dtype="<u4").tobytes()))
    assert [volume.name(k) for k in range(len(volume))] == names
    assert [len(volume.document(k)) for k in range(len(volume))] == lengths.tolist()


def brute(rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.default_vocabulary())
    out, start = [], 0
    for doc, text in rows:
        ids = [*(model.encode(text, add_special_tokens=False).ids if text else []), 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_volumes_match_brute_force(spark):
    texts = ["It's  two  spaces\n\n and\ttabs ", "", None, " lead", "汉字 été x 12,5% \x1c a", "word " * 3000, "a", "it's we'll I'm", "x\n y\n\n  z"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").withColumn("start", F.lit(1))
    got = sorted(tuple(r) for r in T.read_documents(T.write_volumes(df, volume_ids=50)).collect())
    assert got == brute(rows)


def test_any_text_matches_the_library():
    rng = random.Random(3)
    letters = "aB 1,.\n\n\té'%!\r\x0bЖ s"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(30_000)]
    texts += ["a\nb", "\n", "\n\n", "a\n", "\na", "a\n\nb", "a\n b", "'s a's\n's", "a\n.b", "\n\tb", "x%%%\n%%%", "it's!'s", "b !?'t"]
    encode = tokens.Encoder(tokens.default_vocabulary(), 500)
    assert sum(not tokens._in_doubt(t) for t in texts if t) > 10_000
    for text, ids in zip(texts, encode(texts)):
        assert ids == encode.whole(text), text


def test_added_tokens_match_brute_force(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y, z", "a <|endoftext| > b", "汉 <|endoftext|> ", "after it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in T.read_documents(T.write_volumes(df)).collect())
    assert got == brute(list(enumerate(texts)))
    ids = tokens.encoder(tokens.default_vocabulary())(texts[:1])[0]
    assert np.frombuffer(ids, "<u4").tolist() == [64, 220, 50256, 275]


def test_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, "b"), (4, "same"), (4, "same"), (1, None)], "doc_id long, text string")
    got = T.read_documents(T.write_volumes(df)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 4, 4]
    assert got[-1].start == sum(r.n_tokens for r in got[:-1])
    assert T.read_documents(T.write_volumes(df.limit(0))).count() == 0


def test_export_and_select(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    files = T.export(T.write_volumes(df, volume_ids=30), str(tmp_path))
    volumes = [T.Volume(open(f, "rb").read()) for f in files]
    assert sum(map(len, volumes)) == 20
    assert all(v.document(k)[-1] == tokens.END_ID for v in volumes for k in range(len(v)))
