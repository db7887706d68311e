import hashlib

from pyspark.sql import functions as F

from sparkfield.llm import fixity as M


def pages(spark, n):
    rows = [(i, f"http://x/{i}", f"<p>{'é' * (i % 7)}{i}</p>") for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as start")


def test_damage_is_located(spark, monkeypatch):
    monkeypatch.setattr(M, "FANOUT", 3)
    p = pages(spark, 70)
    hurt = p.withColumn("html", F.when(F.col("page_id").isin(0, 33, 69), F.lit("<p>?</p>")).otherwise(F.col("html")))
    same = p.withColumn("html", F.when(F.col("page_id").isin(5, 33), F.regexp_replace("html", "<p>", "<q>")).otherwise(F.col("html")))
    out = M.audit(M.manifest(p), M.manifest(same)).orderBy("record_id").collect()
    assert [r.record_id for r in out if r.status != "intact"] == [5, 33]
    at = 0
    for r in out:
        assert r.start == at
        at += r.length
    body = "<p>é1</p>".encode()
    raw = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: http://x/1\r\nContent-Type: text/html\r\nContent-Length: 10\r\n\r\n" + body + b"\r\n\r\n"
    assert len(body) == 10 and out[1].digest == hashlib.sha256(raw).hexdigest()
    # A shorter record moves all that follow: they no longer lie where the manifest says.
    assert M.audit(M.manifest(p), M.manifest(hurt)).where("status = 'intact'").count() < 70


def test_sound_stretches_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(M, "FANOUT", 4)
    p = pages(spark, 60)
    one = M.manifest(p)
    other = one.withColumn("digest", F.when(F.col("record_id").isin(17, 41), F.lit("rot")).otherwise(F.col("digest")))
    filters = []
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    written = M.common.written

    def seen(df, name, **options):
        if name == "differing":
            filters.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name, **options)

    monkeypatch.setattr(M.common, "written", seen)
    bad = M.differing(M.tree(one), M.tree(other))
    assert sorted(r.id for r in bad.collect()) == [17, 41]
    assert "GreaterThanOrEqual(id,16)" in filters[-1] and "LessThanOrEqual(id,43)" in filters[-1]
    monkeypatch.setattr(M, "LISTED", 0)
    assert sorted(r.id for r in M.differing(M.tree(one), M.tree(other)).collect()) == [17, 41]


def test_very_long_records(spark):
    p = spark.createDataFrame([(1, "u", "<p>" * 300_000), (2, "v", "")], "page_id long, url string, html string").selectExpr("*", "9 as start", "9 as digest")
    out = M.audit(M.manifest(p), M.manifest(p)).orderBy("record_id").collect()
    assert [r.status for r in out] == ["intact"] * 2 and out[1].start == out[0].length > 900_000


def test_lengths_differ(spark, monkeypatch):
    monkeypatch.setattr(M, "FANOUT", 4)
    p = pages(spark, 30)
    out = M.audit(M.manifest(p), M.manifest(p.where("page_id < 9"))).collect()
    assert sorted(r.record_id for r in out if r.status == "missing") == list(range(9, 30))
    out = M.audit(M.manifest(p.where("page_id < 9")), M.manifest(p)).collect()
    assert sorted(r.record_id for r in out if r.status == "extra") == list(range(9, 30)) and len(out) == 30
    none = p.limit(0)
    assert M.audit(M.manifest(none), M.manifest(none)).count() == 0
    assert {r.status for r in M.audit(M.manifest(none), M.manifest(p)).collect()} == {"extra"}


def test_nulls_and_ties(spark):
    p = spark.createDataFrame([(None, None, None), (1, "u", "a"), (1, "u", "a"), (1, "u", "b")], "page_id long, url string, html string")
    out = M.audit(M.manifest(p), M.manifest(p)).collect()
    assert len(out) == 4 and {r.status for r in out} == {"intact"}


def test_files(spark):
    p = pages(spark, 20)
    raw = [bytes(r.r) for r in p.orderBy("page_id").select(M.record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect()]
    files = spark.createDataFrame([("a", b"".join(raw[:12])), ("b", b"".join(raw[12:])), ("c", b""), ("d", b"broken")], "path string, content binary")
    got = [r.digest for r in M.parse(files).where("path in ('a', 'b')").orderBy("path", "start").collect()]
    assert got == [hashlib.sha256(r).hexdigest() for r in raw]
    assert M.parse(files).where("path = 'd'").count() == 1
