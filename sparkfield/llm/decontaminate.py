"""Operator 10: benchmark windows in documents, by a prefix-filtered set join. DataFrame functions only.

Of each benchmark item every run of ``window`` words is looked for (a shorter item is one
window). A document can only hold a window if it holds all its words; so of each window
the rarest word, by its count over all documents, is the necessary prefix. Only places
in documents with such a word are joined; the window's length and the word's position in
it bound where it may start; equality of the words is then checked exactly.

The texts are read twice: once to count the benchmark's words, once for the candidate
places, each with its surroundings of twice the window. Up to ``LISTED_WORDS`` prefix words
are looked for as a list in the plan; beyond that places are found by a join with the
table of words. Vocabulary, windows and contaminated documents are broadcast up to
``BROADCAST_WORDS``, ``BROADCAST_WINDOWS`` and ``BROADCAST_DOCUMENTS`` rows, and joined by
key beyond that.

Defined cases: null and empty texts have no words and are clean; an item without words has
no window; items without id go by the empty name; repeated rows are judged each on its
own, as are rows with one doc_id and different texts; other columns are kept by
:func:`keep_clean` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 13
LISTED_WORDS = 50_000
BROADCAST_WORDS = 500_000
BROADCAST_WINDOWS = 100_000
BROADCAST_DOCUMENTS = 500_000  # 16 bytes each
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words, A-Z lower-cased. Texts all in ASCII take the faster way to lower case."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(common.ascii_lower(text))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS), "")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: words, items (the names of the items that hold it)."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("all"))
    words = words.where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    runs = words.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at"), F.lit(window)).alias("words"))
    return runs.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def with_prefix(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``word``, the rarest of a window's words over all ``docs``, and ``off``, its first place in it."""
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    small = vocabulary.count() <= BROADCAST_WORDS
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(F.broadcast(vocabulary) if small else vocabulary, "word", "left_semi")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))  # of the vocabulary's words at most
    placed = windows.select("words", "items", F.posexplode("words").alias("off", "word")).join(F.broadcast(counts) if small else counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")).alias("first")
    # A window with a word that no document has cannot occur.
    return placed.groupBy("words", "items").agg(rarest).where("first.n > 0").select("words", "items", "first.word", "first.off")


def _with_surroundings(places: Column, words: Column, window: int) -> Column:
    """Of each place: at, the word there, and the words around it from ``base`` on."""

    def base(i: Column) -> Column:
        return F.greatest(i - (window - 1), F.lit(0))

    return F.transform(
        places, lambda i: F.struct(i.alias("at"), F.get(words, i).alias("word"), base(i).alias("base"), F.slice(words, base(i) + 1, F.lit(2 * window - 1)).alias("around"))
    )


def _places(table: DataFrame, windows: DataFrame, listed: int) -> DataFrame:
    """``table`` (row, doc_id, h, words) with the places at which one of the windows' prefix words stands, none as null."""
    words, none = F.col("words"), F.lit(None).cast("array<int>")
    prefix = windows.select("word").distinct()
    n = prefix.count()
    if not n:
        return table.withColumn("at", none)
    if n <= listed:
        some = sorted(r.word for r in prefix.collect())
        return table.withColumn("at", F.filter(F.transform(words, lambda w, i: F.when(w.isin(some), i)), lambda i: i.isNotNull()))
    spots = table.select("row", F.posexplode("words").alias("i", "word"))
    spots = spots.join(F.broadcast(prefix) if n <= BROADCAST_WORDS else prefix, "word", "left_semi")
    # Places of one text; as many as it has words at most.
    return table.join(spots.groupBy("row").agg(F.collect_set("i").alias("at")), "row", "left")


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, listed: int = LISTED_WORDS) -> DataFrame:
    """Per document: doc_id, h (of its text), n_words, n_hit, n_items, items_sha256."""
    windows = common.written(with_prefix(windows_of(items, window), docs), "windows")
    n_windows = windows.count()
    key = ["doc_id", "h"]
    table = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    places = _with_surroundings(F.col("at"), F.col("words"), window).alias("places")
    table = _places(table, windows, listed).select(*key, F.size("words").alias("n_words"), places)
    table = common.written(table, "places")

    spots = table.where(F.size("places") > 0).select(*key, F.explode("places").alias("p")).select(*key, "p.*")
    joined = spots.join(F.broadcast(windows) if n_windows <= BROADCAST_WINDOWS else windows, "word")
    inside = F.col("at") - F.col("off") - F.col("base")  # where the window would start in ``around``
    fits = (inside >= 0) & (inside + F.size("words") <= F.size("around"))
    same = F.slice("around", F.greatest(inside, F.lit(0)) + 1, F.size("words")) == F.col("words")
    hits = joined.where(fits).where(same).select(*key, "items", (F.col("at") - F.col("off")).alias("start"), F.size("words").alias("length"))

    before = Window.partitionBy(*key).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    found = hits.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"), names.alias("names"))
    out = table.select(*key, "n_words").alias("d").join(
        found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("d.h").eqNullSafe(F.col("f.h")), "left"
    )
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select(
        "d.doc_id",
        "d.h",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    dirty = find(docs, items, window).where(contaminated()).select(F.col("doc_id").alias("i"), F.col("h").alias("g")).distinct()
    dirty = common.written(dirty, "contaminated")
    dirty = F.broadcast(dirty) if dirty.count() <= BROADCAST_DOCUMENTS else dirty
    packed = docs.select(F.struct(*names).alias("row"), F.xxhash64("text").alias("h"))
    left = packed.join(dirty, F.col("row.doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left_anti")
    return left.select("row.*")


def op10_benchmark_windows(spark, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.drop("h").withColumn("contaminated", contaminated())


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{_CLASS}') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{_CLASS}') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, list_slice(w, k, k + {WINDOW} - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), places AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d
), hits AS (
  SELECT r, item_id, p, len(win) AS n
  FROM places JOIN wins ON w[p] = win[1] AND list_slice(w, p, p + len(win) - 1) = win
), words AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r
), names AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM hits GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""
