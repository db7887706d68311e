"""Operator 9: Merkle fixity audit of web archives.

An archive is a run of WARC records in order. Its manifest has one leaf a record: place,
offset range, SHA-256. Up to ``FANOUT`` neighbouring nodes form a parent, whose hash
covers its offset range and its children's hashes, up to one root. Two replicas are
compared from the root down, and only below nodes that differ, so that each damaged
record is located by its offset range. A level lies in order of its nodes; up to ``LISTED``
differing parents become ranges in the scan's filter, so that Parquet's statistics keep
sound stretches of a level from being read. More of them than that are joined.

Hashing reads each record once where it lies; only digests, lengths and ids are moved.
Ordinals and offsets come in two levels, within a range of ids and across the ranges'
totals, as many rows as ``spark.sql.shuffle.partitions``.

Defined cases: null urls and pages are written as empty; records without id come first;
records with the same id are ordered by digest; of replicas of unequal length the
records that only one has are ``missing`` or ``extra``; an empty archive has no records
and equals another empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FANOUT = 64
LISTED = 256


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a page's WARC record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def manifest(pages: DataFrame) -> DataFrame:
    """Leaves of the pages' archive: record_id, ordinal, start, length, digest."""
    made = pages.select(F.col("page_id").alias("record_id"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    return placed(made.select("record_id", F.length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest")))


def placed(records: DataFrame) -> DataFrame:
    """Adds each record's ordinal and start, in order of record_id, then digest."""
    spark = records.sparkSession
    order = [F.col("record_id").asc_nulls_first(), F.col("digest")]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = end = 0
        for batch in batches:
            ends = end + np.cumsum(batch["length"].to_numpy(np.int64))
            out = batch.assign(k=n + np.arange(len(batch)), at=ends - batch["length"].to_numpy(np.int64))
            out["record_id"] = pd.array([None if x is None or x != x else int(x) for x in batch["record_id"]], "Int64")
            n, end = n + len(batch), int(ends[-1]) if len(batch) else end
            yield out

    split = records.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order)
    split = split.mapInPandas(number, "record_id long, length long, digest string, k long, at long").withColumn("part", F.spark_partition_id())
    table = common.written(split, "records")
    totals = table.groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")])
    joined = table.join(F.broadcast(starts), "part")
    return joined.select("record_id", (F.col("k") + F.col("n_before")).alias("ordinal"), (F.col("at") + F.col("bytes_before")).alias("start"), "length", "digest")


def parse(files: DataFrame) -> DataFrame:
    """Leaves of WARC files (path, content), as Spark's binaryFile source gives them; record ids count up."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                at, rows = 0, []
                while at < len(content):
                    head = content.find(b"\r\n\r\n", at)
                    lines = content[at : max(head, at)].split(b"\r\n")
                    size = next((int(x.split(b":", 1)[1]) for x in lines if x.lower().startswith(b"content-length:")), None)
                    end = len(content) if head < 0 or size is None else min(len(content), head + 4 + size + 4)
                    rows.append((path, at, end - at, hashlib.sha256(content[at:end]).hexdigest()))
                    at = end
                yield pd.DataFrame(rows, columns=["path", "start", "length", "digest"])

    return files.select("path", "content").mapInPandas(records, "path string, start long, length long, digest string")


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the root: id, start, stop, hash."""
    stop = (F.col("start") + F.col("length")).alias("stop")
    leaf = F.sha2(F.concat_ws("|", F.lit("leaf"), "start", "length", "digest"), 256).alias("hash")
    levels = [common.written(leaves.select(F.col("ordinal").alias("id"), "start", stop, leaf), "level")]
    n = leaves.count()
    while n > 1:
        child = F.struct("id", "start", "stop", "hash")
        parents = levels[-1].groupBy(F.floor(F.col("id") / FANOUT).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))
        start, stop = F.array_min(F.col("c.start")).alias("start"), F.array_max(F.col("c.stop")).alias("stop")
        whole = F.sha2(F.concat_ws("|", F.lit("node"), start, stop, F.array_join("c.hash", "|")), 256).alias("hash")
        levels.append(common.written(parents.select(F.col("up").alias("id"), start, stop, whole), "level"))
        n = -(-n // FANOUT)
    return levels


def children_of(parents: list[int]) -> Column:
    """The ids below some nodes, as ranges."""
    out, parents = F.lit(False), sorted(parents)
    cut = [k for k in range(len(parents)) if not k or parents[k] != parents[k - 1] + 1]
    for a, b in zip(cut, [*cut[1:], len(parents)]):
        out = out | F.col("id").between(parents[a] * FANOUT, (parents[b - 1] + 1) * FANOUT - 1)
    return out


def differing(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """The leaves' ids at which two trees differ, found by descent from the roots."""
    height = max(len(one), len(other))
    bad = None
    for k in range(height - 1, -1, -1):
        a = one[min(k, len(one) - 1)] if k < len(one) else one[-1].limit(0)
        b = other[min(k, len(other) - 1)] if k < len(other) else other[-1].limit(0)
        sides = [t.select("id", F.col("hash").alias(h)) for t, h in ((a, "ha"), (b, "hb"))]
        if bad is not None:
            few = bad.limit(LISTED + 1).collect()
            if len(few) <= LISTED:
                sides = [s.where(children_of([r.id for r in few])) for s in sides]
            up = bad.withColumnRenamed("id", "up")
            sides = [s.withColumn("up", F.floor(F.col("id") / FANOUT)).join(up, "up", "left_semi").drop("up") for s in sides]
        bad = common.written(sides[0].join(sides[1], "id", "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("id"), "differing")
    return bad


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Per record of either manifest: record_id, start, length, digest, status."""
    primary, replica = common.written(primary, "primary"), common.written(replica, "replica")
    bad = differing(tree(primary), tree(replica)).withColumnRenamed("id", "ordinal").withColumn("bad", F.lit(True))
    found = primary.join(bad, "ordinal", "left")
    there = replica.select("ordinal", F.lit(True).alias("there")).join(bad.select("ordinal"), "ordinal", "left_semi")
    found = found.join(there, "ordinal", "left")
    status = F.when(F.col("bad").isNull(), "intact").when(F.col("there").isNull(), "missing").otherwise("damaged")
    out = found.select("record_id", "start", "length", "digest", status.alias("status"))
    extra = replica.join(bad.select("ordinal"), "ordinal", "left_semi").join(primary.select("ordinal"), "ordinal", "left_anti")
    return out.unionByName(extra.select("record_id", "start", "length", "digest", F.lit("extra").alias("status")))


def aged_copy(pages: DataFrame) -> DataFrame:
    """A replica with bit rot in about one record of 256, chosen by content: its first ``<`` has become ``;``."""
    hit = F.substring(F.md5("html"), 1, 2) == "00"
    return pages.withColumn("html", F.when(hit, F.regexp_replace("html", "^([^<]*)<", "$1;")).otherwise(F.col("html")))


def op9_merkle_audit(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(manifest(pages), manifest(aged_copy(pages))).withColumnRenamed("record_id", "page_id")


ORACLE = r"""
WITH made AS (
  SELECT page_id, coalesce(html, '') AS body,
         concat('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:',
                page_id, '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ',
                url, chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ',
                strlen(coalesce(html, '')), chr(13) || chr(10) || chr(13) || chr(10), html,
                chr(13) || chr(10) || chr(13) || chr(10)) AS r
  FROM pages
)
SELECT page_id,
       CAST(coalesce(sum(strlen(r)) OVER (ORDER BY page_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       strlen(r) AS length, sha256(r) AS digest,
       CASE WHEN md5(body) LIKE '00%' AND contains(body, '<') THEN 'damaged' ELSE 'intact' END AS status
FROM made
"""
