"""Operator 5: Jaccard join of word n-grams by token-combination prefixes.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of hashed
n-word shingles. Documents with the same set are one node from the start. Then:

1. **Extended prefixes.** A document's sketch is the smallest of its hashes, so many that
   two sketches of linked documents share at least two more shingles than they do not
   share (:func:`sketch_size`, :func:`bounds`). A document stays in play only if as much of
   the front of its sketch recurs at all as any linked one would share. A common passage
   does not suffice for that.
2. **Classes.** The sketches of what is left are put in order of rarity. If the rarest
   shared shingle is rare, it is among the first of either sketch, and a key by itself.
   If it is frequent, then all shared ones are; there are fewer unshared ones than gaps
   between shared ones, so in the order of the frequent shingles alone some two shared ones
   are neighbours in both documents. Hence the keys of frequent shingles are the
   combinations of two neighbours: at most as many as there are frequent shingles, whatever
   the document's length. A document whose first places hold rare shingles needs none.
3. **Candidates** are the stars of documents at the smallest one with the same key, and
   their connected components: never the pairs of a key.
4. **Verification** on whole sets within each component, breadth first, of those that share
   a rare shingle there: a document that is reached leaves the rest, so a tight group of copies costs one pass, and no link
   between parts that are not yet joined is left untested. Components over
   ``BLOCK_SHINGLES`` are split into blocks: all against the first one, then what the
   largest part does not hold against everything.

Below ``LEAST_COMBINED`` percent the counts of step 2 do not hold, and frequent shingles are
keys by themselves.

Hashes have 64 bits for a shingle and 128 for a set.

Defined cases: null and empty texts have empty sets, linked with nothing; fewer than n
words are one shingle; a repeated row is linked with its copy; rows without doc_id take
part, and a component of only such rows has no id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph

FREQUENT = 64
FIRST = 0.5  # extension of the front of a sketch, in multiples of what may be missing
LEAST_COMBINED = 75
BLOCK_SHINGLES = 4_000_000  # 32 MB, and about ten times that while they are compared
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def most_missed(n, percent: int):
    """Of n shingles, how many a linked document may lack."""
    return n - -(-n * percent // 100)


def extension(n, percent: int, factor: float):
    """k: ``factor`` times what may be missing, but no more than linked documents must share."""
    return np.maximum(1, np.minimum(np.ceil(factor * most_missed(n, percent)).astype(np.int64), -(-n * percent // 100)))


def surely_shared(n, percent: int, factor: float):
    """Shingles that the prefixes of a document of n and any linked one share: the extension of the smallest partner."""
    return extension(-(-n * percent // 100), percent, factor)


def sketch_size(n, percent: int):
    """How many of its n hashes, the smallest, a document's sketch has."""
    return np.minimum(n, -(-3 * n * (100 - percent) // (200 - percent)) + 3)


@lru_cache(1 << 16)
def bounds(n: int, percent: int) -> tuple[int, int, int]:
    """Of a sketch of a document of n shingles, in any order that all documents share, and those of the others that it may link with:

    the places that are sure to hold the first shared shingle; the places that are sure to hold
    two shared neighbours, as far as unshared ones can part them; and by how many the shared ones
    exceed the unshared ones at least.
    """
    m = np.arange(-(-n * percent // 100), 100 * n // percent + 1)
    shared = -(-percent * (n + m) // (100 + percent))
    a, b = n - shared, m - shared  # what either may have alone
    m, a, b = (v[(np.minimum(a, b) >= 0) & (a + b > 0)] for v in (m, a, b))
    if not len(m):
        return 1, 2, 2  # it links with equal sets only
    mine, other = sketch_size(n, percent), sketch_size(m, percent)
    # The sketch that ends at the smaller hash holds nothing that is shared and that the other one lacks.
    alone = np.concatenate((a, mine - other + b))
    parted = np.concatenate((2 * a + other - mine, 2 * b + mine - other))
    both = np.concatenate((mine - a, other - b))
    return int(alone.max()) + 1, int((alone + parted).max()) + 2, int((both - parted).min())


class Shingler:
    """Texts -> sorted distinct hashes of n-word shingles."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        from xxhash import xxh3_64_intdigest

        words = [t.encode("utf-8", "surrogatepass").lower().split() if isinstance(t, str) else [] for t in texts]
        flat = np.array([xxh3_64_intdigest(w) for ws in words for w in ws], np.uint64)
        m = max(len(flat) - self.n + 1, 0)
        sums = np.zeros(m, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.n):
                sums = (sums ^ flat[j : j + m]) * _MIX[0]
                sums ^= sums >> np.uint64(31)
            sums *= _MIX[1]
            sums ^= sums >> np.uint64(29)
        sums = sums.view(np.int64)
        out, at = [], 0
        for ws in words:
            if len(ws) >= self.n:
                out.append(np.unique(sums[at : at + len(ws) - self.n + 1]))
            elif ws:
                out.append(np.array([xxh3_64_intdigest(b" ".join(ws), 1)], np.uint64).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
            at += len(ws)
        return out


def _batches(texts: pd.Series, shingler: Shingler, size: int = 256) -> Iterator[np.ndarray]:
    for k in range(0, len(texts), size):
        yield from shingler(texts.iloc[k : k + size].tolist())


def sketches(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row: doc_id, r1 and r2 (of the row), n_shingles, key (of the set), sketch."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        shingler = Shingler(n)
        for batch in common.slices(batches):
            sizes, keys, heads = [], [], []
            for s in _batches(batch["text"], shingler):
                sizes.append(len(s))
                keys.append(xxh3_128_digest(s.tobytes()))
                heads.append(s[: int(sketch_size(len(s), percent))])
            ids = pd.array([None if x is None or x != x else int(x) for x in batch["doc_id"]], "Int64")
            yield pd.DataFrame({"doc_id": ids, "r1": batch["r1"].to_numpy(), "r2": batch["r2"].to_numpy(), "n_shingles": sizes, "key": keys, "sketch": heads})
        common.give_back()

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("r2"))
    return rows.mapInPandas(each, "doc_id long, r1 long, r2 long, n_shingles long, key binary, sketch array<long>")


def in_play(sets: DataFrame, percent: int) -> DataFrame:
    """The nodes of ``sets`` (node, n_shingles, sketch) of which enough of the sketch's front recurs."""
    n = F.col("n_shingles")
    missed = n - F.ceil(n * percent / 100)
    front = missed + F.greatest(F.lit(1), F.least(F.ceil(FIRST * missed), F.ceil(n * percent / 100)))
    tokens = sets.select("node", "n_shingles", F.explode(F.slice("sketch", F.lit(1), front.cast("int"))).alias("token"))
    # Written, so that it is an exchange of its own in the join, whose hot tokens Spark then splits.
    again = common.written(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"), "again")
    recurring = tokens.join(again, "token").groupBy("node", "n_shingles").agg(F.count("*").alias("recurring"))
    smallest = F.ceil(n * percent / 100)
    lacking = smallest - F.ceil(smallest * percent / 100)
    need = F.greatest(F.lit(1), F.least(F.ceil(FIRST * lacking), F.ceil(smallest * percent / 100)))
    alive = common.written(recurring.where(F.col("recurring") >= need).select("node"), "in_play")
    common.release(again)
    return alive


def keys_of(order: list[tuple[int, int]], n: int, percent: int, frequent: int) -> list[int]:
    """Keys of a set of n shingles, from those of its sketch that recur, as (document count, hash) in order."""
    first, second, _ = bounds(n, percent)
    once = int(sketch_size(n, percent)) - len(order)  # these come before all others
    combine = percent >= LEAST_COMBINED
    keys = [h for df, h in order[: max(0, first - once)] if df <= frequent or not combine]
    # Where the places for the first shared shingle hold rare ones only, that one is rare and its own key.
    if combine and any(df > frequent for df, _ in order[: max(0, first - once)]):
        often = np.array([h for df, h in order[: max(0, second - once)] if df > frequent], np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            keys += ((often[:-1] * _MIX[1] ^ often[1:]) * _MIX[2]).view(np.int64).tolist()
    return keys


def candidate_stars(sets: DataFrame, percent: int, frequent: int) -> DataFrame:
    """Edges (a, b) between each set (node, n_shingles, sketch) and the smallest one with the same key."""
    tokens = sets.select("node", "n_shingles", F.explode("sketch").alias("token"))
    counts = common.written(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    order = F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order")
    ordered = tokens.join(counts, "token").groupBy("node", "n_shingles").agg(order)  # a sketch at most

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in common.slices(batches):
            nodes, out = [], []
            for node, n, order in zip(batch["node"], batch["n_shingles"], batch["order"]):
                some = keys_of([(r["df"], r["token"]) for r in order], n, percent, frequent)
                nodes += [node] * len(some)
                out += some
            yield pd.DataFrame({"node": nodes, "k": pd.array(out, "Int64")})

    table = common.written(ordered.mapInPandas(keys, "node long, k long"), "keys")
    common.release(counts)
    hubs = table.groupBy("k").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("k", "hub")
    hubs = common.written(hubs, "hubs")
    stars = common.written(table.join(hubs, "k").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    common.release(table)
    common.release(hubs)
    return stars


def linked_parts(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The edges of a spanning forest of the links between sets, breadth first.

    A set is held against those that share one of its rarest ``e + 1`` shingles, among theirs,
    and that no part has reached yet.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    local = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    count = np.bincount(local)
    doc = np.repeat(np.arange(m, dtype=np.int32), sizes)
    rare_first = local[np.lexsort((local, count[local], doc))]
    early = np.arange(len(local)) - starts[doc] <= most_missed(sizes, percent)[doc]
    keys, owners = rare_first[early], doc[early]
    shared = count[keys] > 1
    keys, owners = keys[shared], owners[shared]
    of_doc = np.searchsorted(owners, np.arange(m + 1))
    by_key = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.diff(keys[by_key])) + 1
    at = np.concatenate(([0], cut)) if len(keys) else np.zeros(0, np.int64)
    lists = dict(zip(keys[by_key][at].tolist(), np.split(owners[by_key], cut)))
    marked = np.zeros(len(count), np.int64)
    waiting = np.ones(m, bool)
    forest = []
    for root in range(m):
        if not waiting[root]:
            continue
        waiting[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            near = []
            for key in keys[of_doc[i] : of_doc[i + 1]].tolist():
                left = lists[key]
                if len(left):
                    lists[key] = left = left[waiting[left]]
                    near.append(left)
            some = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
            some = some[(100 * sizes[some] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[some])]
            if not len(some):
                continue
            own = local[starts[i] : starts[i + 1]]
            marked[own] = 1
            gathered = np.concatenate([local[starts[j] : starts[j + 1]] for j in some.tolist()])
            common_ = np.add.reduceat(marked[gathered], np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
            marked[own] = 0
            hit = some[100 * common_ >= percent * (sizes[i] + sizes[some] - common_)]
            waiting[hit] = False
            forest += [(i, j) for j in hit.tolist()]
            queue += hit.tolist()
    return forest


def _links_in_groups(members: DataFrame, percent: int) -> DataFrame:
    """Forest edges (a, b) of each group of ``members`` (group, node, shingles), one group at a time in memory."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, nodes, sets = None, [], []

        def links() -> pd.DataFrame:
            found = linked_parts(sets, percent) if len(sets) > 1 else []
            return pd.DataFrame({"a": pd.array([nodes[i] for i, _ in found], "Int64"), "b": pd.array([nodes[j] for _, j in found], "Int64")})

        for batch in common.slices(batches):
            for g, node, shingles in zip(batch["group"], batch["node"], batch["shingles"]):
                if g != group:
                    yield links()
                    group, nodes, sets = g, [], []
                nodes.append(node)
                sets.append(np.frombuffer(shingles, np.int64))
        yield links()
        common.give_back()

    spread = members.repartition(common.partitions(members.sparkSession), "group").sortWithinPartitions("group")
    return spread.select("group", "node", "shingles").mapInPandas(each, "a long, b long")


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The shingles of the ``wanted`` rows (r1, r2, node, cluster), read again from their texts."""
    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("r2"))
    found = rows.join(wanted, ["r1", "r2"]).select("text", "node", "cluster")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for batch in common.slices(batches):
            yield pd.DataFrame({"node": batch["node"], "cluster": batch["cluster"], "shingles": [s.tobytes() for s in _batches(batch["text"], shingler)]})
        common.give_back()

    # One text of a set was chosen before, so only a repeated row can bring it twice.
    return found.mapInPandas(each, "node long, cluster long, shingles binary").dropDuplicates(["node"])


def links(members: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """Edges that join what is linked, of ``members`` (cluster, node, shingles), written."""
    load = members.groupBy("cluster").agg(F.sum(F.length("shingles") / 8).alias("load"))
    large = common.written(load.where(F.col("load") > block_shingles), "large")
    n_large = large.count()
    group = F.col("cluster").cast("string").alias("group")
    if not n_large:
        return common.written(_links_in_groups(members.select(group, "node", "shingles"), percent), "links")
    small = members.join(large, "cluster", "left_anti").select(group, "node", "shingles")
    blocks = F.ceil(2 * F.col("load") / block_shingles)
    big = members.join(large, "cluster").withColumn("blocks", blocks.cast("int"))
    big = common.written(big.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("load"), "blocks")
    # Every block with the first one; the first block goes to all.
    to = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = big.withColumn("to", F.explode(to)).select(F.concat_ws("/", "cluster", "to").alias("group"), "node", "shingles")
    first = common.written(_links_in_groups(small.unionByName(dealt), percent), "links")
    # What is not in its cluster's largest part is held against all blocks.
    roots = graph.components(first)
    parts = big.select("cluster", "blocks", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = parts.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    outside = common.written(parts.join(main, "cluster").where("root <> main").select("cluster", "node"), "outside")
    if not outside.limit(1).count():
        common.release(big)
        return first
    strays = big.join(outside, ["cluster", "node"], "left_semi")
    n_stray = strays.groupBy("cluster").agg(F.ceil(2 * F.sum(F.length("shingles") / 8) / block_shingles).cast("int").alias("heaps"))
    strays = strays.join(n_stray, "cluster").withColumn("heap", F.pmod(F.xxhash64("node", F.lit(7)), F.col("heaps")).cast("int"))
    name = F.concat_ws("/", "cluster", "h", "t").alias("group")
    left = strays.withColumn("h", F.col("heap")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = big.join(n_stray, "cluster").withColumn("t", F.col("block")).withColumn("h", F.explode(F.sequence(F.lit(0), F.col("heaps") - 1)))
    pairs = left.select(name, "node", "shingles").unionByName(right.select(name, "node", "shingles")).dropDuplicates(["group", "node"])
    out = common.written(first.unionByName(_links_in_groups(pairs, percent)), "links")
    for t in (big, first, outside):
        common.release(t)
    return out


def join(docs: DataFrame, n: int = 5, percent: int = 80, frequent: int = FREQUENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row of ``docs``: doc_id, r1, r2, n_shingles, key (of the set), part (the smallest node it reaches, null without links)."""
    common.small_batches(docs.sparkSession)
    table = common.written(sketches(docs, n, percent), "sketches")
    rows = common.written(table.drop("sketch"), "rows")
    sets = table.where("n_shingles > 0").dropDuplicates(["key"]).select(F.monotonically_increasing_id().alias("node"), "key", "n_shingles", "r1", "r2", "sketch")
    sets = common.written(sets, "sets")
    common.release(table)
    alive = in_play(sets, percent)
    playing = common.written(sets.join(alive, "node"), "playing")
    common.release(sets)
    common.release(alive)
    stars = candidate_stars(playing.select("node", "n_shingles", "sketch"), percent, frequent)
    places = common.written(playing.drop("sketch"), "places")
    common.release(playing)
    clusters = common.written(graph.components(stars).withColumnRenamed("root", "cluster"), "clusters")
    common.release(stars)
    members = common.written(whole_sets(docs, places.select("r1", "r2", "node").join(clusters, "node"), n), "members")
    common.release(clusters)
    found = links(members, percent, block_shingles)
    common.release(members)
    parts = graph.components(found).withColumnRenamed("root", "part")
    parts = common.written(parts.join(places.select("node", "key"), "node").select("key", "part"), "parts")
    common.release(places)
    common.release(found)
    return rows.join(parts, "key", "left")


def components(docs: DataFrame, n: int = 5, percent: int = 80, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, the smallest doc_id reachable by links. Not the links themselves."""
    joined = join(docs, n, percent, **options).withColumn("alone", F.when(F.col("part").isNull(), F.col("key")))
    ids = joined.where("n_shingles > 0").groupBy("part", "alone").agg(F.min("doc_id").alias("component_id"))
    ids = common.written(ids, "ids").select(F.col("part").alias("p"), F.col("alone").alias("q"), "component_id")
    out = joined.join(ids, F.col("part").eqNullSafe(F.col("p")) & F.col("alone").eqNullSafe(F.col("q")), "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, **options) -> DataFrame:
    """One row of each component, that with the smallest doc_id; rows with empty sets all stay."""
    joined = join(docs, n, percent, **options).withColumn("alone", F.when(F.col("part").isNull(), F.col("key")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("i"), "r1", "r2")
    best = joined.where("n_shingles > 0").groupBy("part", "alone").agg(F.min(row).alias("row")).select("row.r1", "row.r2")
    empty = joined.where("n_shingles = 0").select("r1", "r2", F.lit(True).alias("all")).distinct()
    stay = best.withColumn("all", F.lit(False)).unionByName(empty)
    packed = docs.select(F.struct(*names).alias("row"), F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("r2"))
    kept = packed.join(stay, ["r1", "r2"]).withColumn("k", F.row_number().over(Window.partitionBy("r1", "r2").orderBy("r1")))
    return kept.where("all OR k = 1").select("row.*")


def op5_jaccard_components(spark, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"), n=3, percent=90)
