r"""Benchmark decontamination by a prefix-filtered set join.

An item is a set of windows: each run of `WINDOW` consecutive item words, or all of its words if they are fewer. A window
is contained in a document if its words stand there in a row. Containment is asked for whole, so by the prefix principle
one token of a window is enough to look for: its word that is rarest among all documents (ties: the smaller word, then the
smaller offset). That order is counted over all documents.

Document positions that hold a prefix word are joined with the windows on that word; a length bound
and a positional bound (the window must fit between the document's first and last word) go before the exact
comparison of all words. Only positions that hold such a word leave the document's row, each with the words around
it, so that no document is shuffled; what is shuffled is one partial result a document and task.

The item side is broadcast while both its words and its windows are within checked bounds; beyond them the same join shuffles by
the prefix word, and gives the same rows.

Defined results: null or wordless texts have no words and no hits; wordless items have no window; rows that
repeat a doc_id and text have that text's result each, and so have rows that repeat only the doc_id; an
item_id that repeats counts once; null item_ids are no items; an empty benchmark hits nothing; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbmark.llm.scratch import folder, keep, unused
from plumbmark.session import table

WINDOW = 10
#: Fixed pattern of what stands between words: all ASCII but digits, A-Z and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct words of the items up to which the filter on words is part of each task's code, and bytes of windows up to which they are broadcast.
BROADCAST_WORDS, BROADCAST_BYTES = 100_000, 64 << 20
#: Documents that may be contaminated are found by the hash of their key, in so many positions; a table of at most so many rows is broadcast.
POSITIONS = 1 << 18


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words: each distinct window of each item."""
    cut = items.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("all"))
    n = F.size("all")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    each = cut.where(n > 0).select("item_id", F.explode(F.transform(starts, lambda s: F.slice("all", s, window))).alias("words"))
    return each.distinct()


def _is_item_word(vocabulary: list[str] | None):
    return (lambda w: w.isin(vocabulary)) if vocabulary is not None else (lambda w: F.lit(True))


def word_counts(docs: DataFrame, vocabulary: list[str] | None) -> DataFrame:
    """word, n: how often each word of the vocabulary (None: any word) stands in all documents."""
    own = docs.select(F.explode(F.filter(words(F.col("text")), _is_item_word(vocabulary))).alias("word"))
    return own.groupBy("word").agg(F.count("*").alias("n"))


def spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words and, for each occurrence of a window, hit(start, length, item_id); hit is null in a row without.

    start counts words from 0. Every document has a row at least.
    """
    windows = item_windows(items, window)
    item_words = windows.select(F.explode("words").alias("word")).distinct()
    found = [r[0] for r in item_words.limit(BROADCAST_WORDS + 1).toLocalIterator()]
    vocabulary = sorted(found) if len(found) <= BROADCAST_WORDS else None
    counts = word_counts(docs, vocabulary)
    # rarest word of each window; a word that no document holds counts 0 and rules the window out at once
    placed = windows.select("item_id", "words", F.posexplode("words").alias("offset", "word"))
    ranked = placed.join(counts, "word", "left").groupBy("item_id", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("rare"))
    prefixes = ranked.where(F.col("rare.n") > 0).select("item_id", F.col("words").alias("item_words"), F.col("rare.word").alias("word"), F.col("rare.offset").alias("offset"))
    if vocabulary is not None:
        prefixes = keep(prefixes, folder(docs.sparkSession), "prefixes")
        wanted = [r[0] for r in prefixes.select("word").distinct().toLocalIterator()]
    else:
        wanted = None
    cut = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("all"))
    is_wanted = _is_item_word(wanted)
    at = F.filter(F.transform("all", lambda w, i: F.when(is_wanted(w), i)), lambda i: i.isNotNull())
    around = F.transform(at, lambda i: F.struct(i.alias("at"), F.element_at("all", i + 1).alias("word"), F.greatest(i - window + 1, F.lit(0)).alias("from"), F.slice("all", F.greatest(i - window + 2, F.lit(1)), 2 * window - 1).alias("near")))
    places = cut.select("doc_id", "text_hash", F.size("all").alias("n_words"), F.explode_outer(around).alias("p")).select("doc_id", "text_hash", "n_words", "p.*")
    length = F.size("item_words")
    start = F.col("at") - F.col("offset")
    fits = (places["word"] == prefixes["word"]) & (start >= 0) & (start + length <= F.col("n_words"))
    same = F.slice("near", F.greatest(start - F.col("from") + 1, F.lit(1)), length) == F.col("item_words")
    # a window's words, and about a hundred bytes for its row
    size = prefixes.agg(F.coalesce(F.sum(F.length(F.array_join("item_words", " ")) + 100), F.lit(0))).first()[0] if vocabulary is not None else BROADCAST_BYTES + 1
    side = F.broadcast(prefixes) if size <= BROADCAST_BYTES else prefixes
    joined = places.join(side, fits & same, "left")
    hit = F.when(F.col("item_id").isNotNull(), F.struct(start.alias("start"), length.alias("length"), "item_id"))
    return joined.select("doc_id", "text_hash", "n_words", hit.alias("hit"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, hits (distinct occurrences) of each distinct document; join them back on the first two."""
    return spans(docs, items, window).groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.count("*").alias("_rows"), F.collect_set("hit").alias("hits")).drop("_rows")


def summary(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs, as op5 returns it."""
    per = decontaminate(docs, items, window)
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string"))))
    per = per.select(
        "doc_id",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)
    times = docs.groupBy("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).agg(F.count("*").cast("int").alias("times"))
    same = per["doc_id"].eqNullSafe(times["doc_id"]) & (per["text_hash"] == times["text_hash"])
    rows = per.join(times.select("doc_id", "text_hash", "times"), same).select(per["doc_id"], "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "times")
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_k", "times")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in whose text no window occurs, all columns kept. Only texts that may have one are shuffled."""
    key = unused(docs, "_key")
    bad = spans(docs, items, window).where(F.col("hit").isNotNull()).select(F.xxhash64("doc_id", "text_hash").alias("_bad")).distinct()
    bad = keep(bad, folder(docs.sparkSession), "bad")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(POSITIONS)).cast("int")
    taken = F.broadcast(bad.select(place("_bad").alias("_place")).distinct())
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))))
    sure = keyed.join(taken, place(key) == taken["_place"], "left_anti")
    maybe = keyed.join(taken, place(key) == taken["_place"], "left_semi").join(bad, F.col(key) == F.col("_bad"), "left_anti")
    return sure.unionByName(maybe).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_window_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_window_decontamination": op5_window_decontamination}
ORACLES = {
    "op5_window_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, len(list_slice(w, s, s + 9)) AS l, list_slice(w, s, s + 9) AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
dwin AS (SELECT doc_id, l, s, list_slice(w, s, s + l - 1) AS words FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM dw, lens WHERE len(w) >= l)),
hits AS (SELECT d.doc_id, d.s, d.l, i.item_id FROM dwin d JOIN win i ON d.l = i.l AND d.words = i.words),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
