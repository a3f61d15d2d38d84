"""Operator 9: benchmark passages in documents, found by winnowed fingerprints and extended word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import ascii_lower, let, small, text_key
from reviewlens.storage import materialize

WINDOW = 13
SHARE = 20
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (guaranteed span, k): a span of so many words that two texts share has one k-gram that both keep. A text's windows
#: use the longest guarantee that they reach; shorter ones only serve items of fewer words than WINDOW.
LEVELS = ((13, 7), (7, 4), (4, 2), (1, 1))


def words_of(text: Column) -> Column:
    """Words of digits, letters a-z and all that is not ASCII, after lower-casing A-Z. Null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _number_of_words(text: Column) -> Column:
    """The size of ``words_of``."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fingerprints(words: Column, span: int, k: int) -> Column:
    """Winnowing: array of (fp, p), the k-gram hashes that are the least in some window of span - k + 1 k-grams,
    with the place of their first word. Equal minima are all kept, so the choice depends on the window alone."""
    w = span - k + 1
    none = F.array().cast("array<struct<fp:bigint,p:int>>")

    def grams(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
        )

    def placed(g: Column) -> Column:
        return F.transform(g, lambda v, p: F.struct(v.alias("fp"), p.alias("p")))

    def least(g: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(g) - w)
        return F.transform(at, lambda i: F.least(*[F.get(g, i + j) for j in range(w)]))

    def kept(g: Column) -> Column:
        if w == 1:
            return placed(g)
        return let(
            least(g),
            lambda m: F.filter(placed(g), lambda s: s.fp == F.greatest(*[F.get(m, s.p - j) for j in range(w)])),
        )

    found = let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(grams(h), kept))
    return F.when(F.size(words) >= span, found).otherwise(none)


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, span, window): the distinct windows of each item, their words joined by spaces."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("span", F.least(F.size("w"), F.lit(window)))
    places = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("span") + 1))
    each = rows.select("item_id", "w", "span", places.alias("at"))
    return each.select("item_id", "span", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("span"))).alias("window")).distinct()


def _prints(windows: DataFrame, span: int, k: int, most: int) -> DataFrame:
    """(fp, off, span, window): each window of ``span`` to ``most`` words once, under the least k-gram hash of its first ``span`` words.
    Every text that holds the window keeps this k-gram."""
    own = windows.where(F.col("span").between(span, most)).select("window", "span").distinct()
    hashes = F.transform(F.slice(F.split("window", " "), 1, span), lambda x: F.xxhash64(x))
    grams = let(hashes, lambda h: F.array(*[F.xxhash64(*[F.get(h, i + j) for j in range(k)]) for i in range(span - k + 1)]))
    found = own.withColumn("grams", grams).withColumn("fp", F.array_min("grams"))
    return found.select("fp", (F.array_position("grams", F.col("fp")) - 1).cast("int").alias("off"), "span", "window")


def _hits(texts: DataFrame, prints: DataFrame, span: int, k: int, most: int) -> DataFrame:
    """(k1, k2, n_words, at, span, window): the windows that a text holds, each fingerprint extended to the whole window. Only texts that
    share a fingerprint with an item come to the extension."""
    held = small(prints)
    marks = texts.select("k1", "k2", F.explode(fingerprints(words_of(F.col("text")), span, k).fp).alias("fp"))
    some = held.select("fp").distinct() if held is prints else F.broadcast(prints.select("fp").distinct())
    met = small(materialize(marks.join(some, "fp").select("k1", "k2").distinct(), "met"))
    words = texts.join(met, ["k1", "k2"], "left_semi").select("k1", "k2", words_of(F.col("text")).alias("w"))

    def around(w: Column) -> Column:
        """The fingerprints with the words that a window around each can reach, so that a long text is not copied for each."""
        first = lambda f: F.greatest(F.lit(0), f.p - (span - k))
        near = lambda f: F.slice(w, first(f) + 1, f.p - first(f) + most)
        return F.transform(
            fingerprints(w, span, k),
            lambda f: F.struct(f.fp.alias("fp"), f.p.alias("p"), first(f).alias("first"), near(f).alias("near")),
        )

    marks = words.select("k1", "k2", F.size("w").alias("n_words"), F.inline(let(F.col("w"), around)))
    met = marks.join(held, "fp").withColumn("at", F.col("p") - F.col("off")).where("at >= 0")
    same = F.concat_ws(" ", F.slice("near", F.col("at") - F.col("first") + 1, F.col("span"))) == F.col("window")
    return met.where(same).select("k1", "k2", "n_words", "at", "span", "window")


def touched_texts(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """(k1, k2, n_words, n_hit, items, contaminated) of the texts of ``docs`` that hold a window of ``items``, under the hashes of
    ``text_key``. Other texts have no row.

    The items' distinct windows are written first. A window that many items share is met once, and its items are listed at the end.
    Up to a checked number of windows, and of texts that meet a fingerprint, these are broadcast and no whole text is shuffled; beyond
    it fingerprints or texts are shuffled once.
    """
    if window < WINDOW:
        raise ValueError(f"a window has at least {WINDOW} words")
    windows = materialize(_item_windows(items, window), "item-windows")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    texts = texts.select("text", *text_key(F.col("text")))
    hits = None
    for (span, k), most in zip(LEVELS, [window, *(above - 1 for above, _ in LEVELS)], strict=False):
        prints = materialize(_prints(windows, span, k, most), "item-prints")
        if not prints.isEmpty():
            found = _hits(texts, prints, span, k, most)
            hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = texts.select("k1", "k2", F.lit(0).alias("n_words"), F.lit(0).alias("at"), F.lit(0).alias("span"), F.lit("").alias("window")).limit(0)
    hits = materialize(hits.distinct(), "hits")
    key = ["k1", "k2"]
    spans = F.transform(F.collect_set(F.struct("at", "span")), lambda x: F.sequence(x.at, x.at + x.span - 1))
    covered = hits.groupBy(*key, "n_words").agg(F.size(F.array_distinct(F.flatten(spans))).alias("n_hit"))
    named = windows.where("item_id IS NOT NULL").select("window", "item_id")
    listed = hits.select(*key, "window").distinct().join(named, "window").groupBy(*key).agg(
        F.array_sort(F.collect_set("item_id")).alias("items")
    )
    return covered.join(listed, key, "left").select(
        *key, F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (share * F.col("n_hit") >= F.col("n_words")).alias("contaminated"),
    )


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Adds to (doc_id, text) of ``docs`` which words lie in a window of an item of ``items`` (item_id, text).

    A window is ``window`` (13 or more) consecutive words of an item, or the whole item if it has fewer. Fingerprints of
    documents meet those of the items' windows by an equi-join; each hit is extended to the whole window, compared word by word, so
    nothing rests on hashes alone, and winnowing keeps the print of every window that a text holds.
    Documents of equal text share their hits.

    Returns doc_id, text, n_words, n_hit, n_items, items, items_sha256, contaminated (n_hit > 0 and share * n_hit >=
    n_words). A null or empty text has no words; a null item text has no windows; windows of a null item_id
    hit but are not listed; equal item ids count once; repeated rows give repeated results; an empty table of
    items hits nothing; other columns are ignored.
    """
    found = small(materialize(touched_texts(docs, items, window=window, share=share).drop("n_words"), "touched"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.select("*", *text_key(F.col("text")), _number_of_words(F.col("text")).alias("n_words"))
    joined = rows.join(found, ["k1", "k2"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return joined.select(
        "doc_id",
        "text",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )
