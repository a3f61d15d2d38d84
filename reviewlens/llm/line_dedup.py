"""Operator 4: repeated and nearly repeated lines, found by a deletion-neighbourhood join over words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlens.llm.common import let, small
from reviewlens.storage import materialize

MIN_WORDS = 5
MIN_CHARS = 15
NEAR_WORDS = 10
#: A longer run without white space, as in scripts that write none, is cut into its characters.
LONGEST_WORD = 20
SPACE = r"\x20\x09-\x0D"


def words_of(line: Column) -> Column:
    """The words of a lower-cased line; of one over ``LONGEST_WORD`` characters each character counts as a word."""
    letters = lambda w: F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0))

    def cut(words: Column) -> Column:
        parts = F.transform(words, lambda w: F.when(F.length(w) > LONGEST_WORD, letters(w)).otherwise(F.array(w)))
        return F.when(F.exists(words, lambda w: F.length(w) > LONGEST_WORD), F.flatten(parts)).otherwise(words)

    return let(F.array_remove(F.split(F.lower(line), f"[{SPACE}]+"), ""), cut)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _line_key(words: Column) -> list[Column]:
    return [F.xxhash64(words).alias("l1"), F.xxhash64(F.lit(1), words).alias("l2")]


def _half_keys(w: Column) -> Column:
    """Keys of which two lines within one word edit share one at least: their first and last h words, with h half of
    the shorter line's length; a line stands for both lengths that its partner may make the shorter."""
    n = F.size(w)
    halves = F.array_distinct(F.array(F.floor(n / 2), F.floor((n - 1) / 2)).cast("array<int>"))
    return F.flatten(
        F.transform(
            halves,
            lambda h: F.array(
                F.xxhash64(F.lit("first"), h, F.slice(w, 1, h)), F.xxhash64(F.lit("last"), h, F.slice(w, n - h + 1, h))
            ),
        )
    )


def _variants(lines: DataFrame) -> DataFrame:
    """All variants of lines (l1, l2, first, w) within one deletion: (l1, l2, first, at, v); at is the deleted place, -1
    for the line itself. v hashes the length and two sums over the variant's words and their places: words before the
    deleted one count at their own place and words after it at the place before, so one running total suffices. All
    rows of a line stay in the task that read the line."""

    def word(x: Column, place: Column, seed: int) -> Column:
        return F.shiftright(F.xxhash64(F.lit(seed), x, place), 24)  # 40 bits, so that sums stay far from overflow

    zero = F.lit(0).cast("long")

    def whole(seed: int, shift: int) -> Column:
        return F.aggregate(F.transform("w", lambda x, i: word(x, i - shift, seed)), zero, lambda t, x: t + x)

    totals = [whole(s, 1).alias(f"t{s}") for s in (0, 1)]
    sized = lines.select("l1", "l2", "first", "w", F.size("w").alias("n"), *totals).repartition("l1", "l2")
    placed = sized.select("l1", "l2", "first", "n", "t0", "t1", F.posexplode("w").alias("i", "x"))
    before = W.partitionBy("l1", "l2").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    # all words at the place before, without the deleted one, and what the words ahead of it differ by at their own place
    sums = []
    for s in (0, 1):
        own, moved = word(F.col("x"), F.col("i"), s), word(F.col("x"), F.col("i") - 1, s)
        sums.append(F.col(f"t{s}") - moved + F.coalesce(F.sum(own - moved).over(before), zero))
    deleted = placed.select("l1", "l2", "first", F.col("i").alias("at"), F.xxhash64(F.col("n") - 1, *sums).alias("v"))

    itself = lines.select("l1", "l2", "first", F.lit(-1).alias("at"), F.xxhash64(F.size("w"), whole(0, 0), whole(1, 0)).alias("v"))
    return deleted.union(itself)


def _without(w: Column, at: Column) -> Column:
    return F.when(at < 0, w).otherwise(F.concat(F.slice(w, 1, at), F.slice(w, at + 2, F.size(w))))


def _near_lines(lines: DataFrame, text: DataFrame) -> DataFrame:
    """(l1, l2) of the distinct lines (l1, l2, first, halves) that come after a line within one word edit of them.
    ``text`` has (place, x) of every line.

    Lines that share no half with another line have no such neighbour and go at once. The others emit every
    variant of one deletion, hashed; variants that come once go. Lines of one length that agree in the variant and in
    the deleted place differ in that one word, so the earliest of such a group removes the others; a line that
    equals a variant of another differs from it by one insertion. Both are checked on the words. Groups are
    reduced to their earliest line before any join, so no pairs within a group are made.
    """
    spread = lines.select("l1", "l2", F.explode("halves").alias("half"))
    shared = spread.groupBy("half").agg(F.min("l1").alias("x"), F.max("l1").alias("y")).where("x != y").select("half")
    shared = small(materialize(shared, "shared-halves"))
    some = materialize(spread.join(shared, "half").select("l1", "l2").distinct(), "near-lines")
    firsts = some.join(lines.select("l1", "l2", F.col("first").alias("place")), ["l1", "l2"])
    firsts = small(materialize(firsts, "near-firsts"))
    chosen = text.join(firsts, "place").select("l1", "l2", F.col("place").alias("first"), words_of(F.col("x")).alias("w"))
    chosen = materialize(chosen.dropDuplicates(["l1", "l2"]), "candidates")

    variants = materialize(_variants(chosen), "all-variants")
    often = variants.groupBy("v").count().where("count > 1").select("v")
    often = small(materialize(often, "shared-variants"))
    variants = materialize(
        variants.join(often, "v").select("v", "at", F.struct("first", "l1", "l2").alias("e")), "variants"
    )
    deleted = variants.where("at >= 0")
    earliest = deleted.groupBy("v", "at").agg(F.min("e").alias("o"))
    same = deleted.join(earliest, ["v", "at"]).select("e", "at", "o", F.col("at").alias("o_at"))
    whole = variants.where("at < 0").select("v", F.col("e").alias("s"))
    met = deleted.join(whole, "v")
    later = met.select("e", "at", F.col("s").alias("o"), F.lit(-1).alias("o_at"))
    sooner = met.groupBy("s").agg(F.min(F.struct("e", "at")).alias("t")).select(
        F.col("s").alias("e"), F.lit(-1).alias("at"), F.col("t.e").alias("o"), F.col("t.at").alias("o_at")
    )
    pairs = same.union(later).union(sooner).where("o.first < e.first")
    pairs = pairs.select("e.l1", "e.l2", "at", F.col("o.l1").alias("o1"), F.col("o.l2").alias("o2"), "o_at")
    own, other = chosen.select("l1", "l2", "w"), chosen.select("l1", "l2", "w").toDF("o1", "o2", "o_w")
    checked = pairs.join(own, ["l1", "l2"]).join(other, ["o1", "o2"])
    checked = checked.where(_without(F.col("w"), F.col("at")) == _without(F.col("o_w"), F.col("o_at")))
    return checked.select("l1", "l2").distinct()


def removed_lines(
    docs: DataFrame, *, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, near_words: int = NEAR_WORDS
) -> DataFrame:
    """(doc_id, k, removed): per distinct (doc_id, text) the numbers, from 0, of the lines to take out; k hashes the text."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("k"), "text")
    text = hashed.select("doc_id", "k", F.posexplode(lines_of(F.col("text"))).alias("line", "x"))
    # as the only element of an array the words are made once; a filter would make them again for each of its conditions
    rows = text.select("doc_id", "k", "line", F.explode(F.array(words_of(F.col("x")))).alias("w"))
    rows = rows.where((F.size("w") >= min_words) | (F.length(F.array_join("w", "")) >= min_chars))
    near = F.size("w") >= near_words
    halves = F.when(near, let(F.col("w"), _half_keys)).otherwise(F.array().cast("array<bigint>"))
    place = F.struct("doc_id", "k", "line").alias("place")
    keyed = materialize(rows.select(*_line_key(F.col("w")), place, halves.alias("halves")), "line-keys")
    lines = materialize(
        keyed.groupBy("l1", "l2")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"), F.first("halves").alias("halves")),
        "lines",
    )
    nearly = _near_lines(lines, text.select(place, "x")).withColumn("near", F.lit(True))
    marked = lines.select("l1", "l2", "first", "last").join(nearly, ["l1", "l2"], "left")
    marked = materialize(
        marked.where("near OR first != last").select("l1", "l2", "first", F.coalesce("near", F.lit(False)).alias("near")),
        "marked-lines",
    )
    out = keyed.select("l1", "l2", "place").join(small(marked), ["l1", "l2"]).where("near OR place != first")
    return out.groupBy("place.doc_id", "place.k").agg(F.array_sort(F.collect_set("place.line")).alias("removed"))


def dedup_lines(
    docs: DataFrame, *, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, near_words: int = NEAR_WORDS
) -> DataFrame:
    """Documents (doc_id, text) without the lines that came before.

    Lines are split at line feeds, lower-cased and cut into words, very long ones into characters. A line goes if it equals an earlier
    line, or, having ``near_words`` words or more, is within one word edit (insertion, deletion or substitution) of an earlier line of
    as many, be that line kept or not. Earlier means: smaller doc_id, then a hash of the text, then the line number.
    Lines of both less than ``min_words`` words and less than ``min_chars`` characters without white space always stay.

    Returns doc_id, text (what is left; null stays null), n_lines, n_removed. A null text has no lines and an empty one a
    single empty line; a null doc_id comes first; rows that repeat both id and text are one document and are cut
    alike; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return cut_lines(rows, removed_lines(rows, min_words=min_words, min_chars=min_chars, near_words=near_words))


def cut_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut, and n_lines and n_removed added; other columns stay."""
    removed = materialize(removed, "removed-lines").toDF("__id", "__k", "__removed")
    same = docs["doc_id"].eqNullSafe(removed["__id"]) & (F.xxhash64(docs["text"]) == removed["__k"])
    joined = docs.join(removed, same, "left")
    text, gone = docs["text"], removed["__removed"]
    left = F.filter(lines_of(text), lambda x, i: ~F.array_contains(gone, i))
    cut = F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines_of(text)))
    return joined.select(
        *[cut.alias("text") if c == "text" else docs[c] for c in docs.columns],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
