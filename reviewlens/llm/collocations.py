"""Operator 13: collocations from a weighted de Bruijn graph of the texts' words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlens.llm.chunks import different, slices
from reviewlens.llm.common import arrow_by_bytes
from reviewlens.storage import materialize

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
ABSORBED_PERCENT = 50
NO_LANGUAGE = "und"
SCALE = 1_000_000
COUNT = "decimal(15,0)"  # SCALE * count * count stays within 38 digits
WORDS_AT_ONCE = 500_000
#: The filter of words that occur often enough: one bit for each value of a hash, in pieces that are made apart.
FILTER_BITS = 26
PIECE_BITS = 20
KEY_GAP = "\t"
COUNTS = "key string, n long"

GAP, CUT = 1, 2
KIND = np.zeros(256, "uint8")
KIND[[0x20, 0x09]] = GAP
KIND[list(b".,;:!?") + list(range(0x0A, 0x0E))] = CUT
LOWER = np.arange(256, dtype="uint8")
LOWER[ord("A") : ord("Z") + 1] += 32


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' lower-case bytes with one space for each gap, the begin and end of each word in them, and the number of its piece.
    Texts are pieces of their own."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pc.fill_null(texts, "")), "\n")
    body = LOWER[np.frombuffer(whole.buffers()[2] or b"", "uint8")]
    kind = KIND[body]
    kept = kind != GAP
    kept[1:] |= kind[:-1] == 0
    body, kind = body[kept], kind[kept]
    body[kind == GAP] = ord(" ")
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).astype("int32")
    starts, ends = edges[::2], edges[1::2]
    return body, starts, ends, np.cumsum(kind == CUT, dtype="int32")[starts]


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, pa.Array]]:
    for batch in batches:
        for rows in slices(batch, size=WORDS_AT_ONCE * 8):
            for lang in rows.column("lang").unique():
                yield lang, rows.filter(pc.equal(rows.column("lang"), lang)).column("text")


def _counted(names: pa.Array, lang: pa.Scalar, counts: pa.Array) -> pa.RecordBatch:
    """Counts under one key, name and language, in the order of the names: neighbours share their begin, which packs well."""
    order = pc.sort_indices(names)
    keys = pc.binary_join_element_wise(names.take(order), lang.cast(pa.string()), KEY_GAP)
    return pa.RecordBatch.from_arrays([keys, counts.take(order)], names=["key", "n"])


def _parts(name: str) -> list[Column]:
    """The name and the language of a key. A language may hold any character, a word no tab."""
    word = F.substring_index("key", KEY_GAP, 1)
    return [F.substring(F.col("key"), F.length(word) + 2, F.length("key")).alias("lang"), word.alias(name)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, texts in _by_language(batches):
        body, starts, ends, _ = _words(texts)
        codes, words = different(body, starts, ends)
        yield _counted(pa.array(words, pa.string()), lang, pa.array(np.bincount(codes, minlength=len(words)), pa.int64()))


def _hash(lang: Column, word: Column) -> Column:
    return F.crc32(F.concat(lang, F.lit("\0"), word).cast("binary")).bitwiseAND((1 << FILTER_BITS) - 1)


def _piece(key: tuple, rows: pa.Table) -> pa.Table:
    bits = np.zeros(1 << PIECE_BITS, bool)
    bits[rows["place"].to_numpy() & ((1 << PIECE_BITS) - 1)] = True
    return pa.table({"piece": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def frequent_words(rows: DataFrame, min_count: int) -> np.ndarray:
    """A filter that every word of ``min_count`` occurrences in its language passes: one bit for each hash, whatever the number of words.
    Of other words some pass as well, more where there are very many; that costs shuffled rows and changes no result."""
    counts = rows.mapInArrow(_word_counts, COUNTS).groupBy("key").agg(F.sum("n").alias("n"))
    places = counts.where(F.col("n") >= min_count).select(*_parts("word")).select(_hash(F.col("lang"), F.col("word")).alias("place")).distinct()
    pieces = places.withColumn("piece", F.shiftright("place", PIECE_BITS)).groupBy("piece").applyInArrow(_piece, "piece long, bits binary")
    out = np.zeros((1 << (FILTER_BITS - PIECE_BITS), 1 << (PIECE_BITS - 3)), "uint8")
    for row in pieces.collect():  # at most 64 pieces of 128 KB
        out[row["piece"]] = np.frombuffer(row["bits"], "uint8")
    return out.ravel()


def _grams(max_words: int, words_filter: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = words_filter.value
        for lang, texts in _by_language(batches):
            body, starts, ends, piece = _words(texts)
            codes, words = different(body, starts, ends)
            prefix = f"{lang.as_py()}\0".encode()
            places = np.fromiter((zlib.crc32(prefix + x.encode()) for x in words), "int64", len(words)) & ((1 << FILTER_BITS) - 1)
            often = ((bits[places >> 3] >> (places & 7)) & 1).astype(bool)[codes]
            yield _counted(pa.array([""]), lang, pa.array([len(codes)], pa.int64()))
            # rare words cut pieces as well
            piece, starts, ends = (piece + np.cumsum(~often, dtype="int32"))[often], starts[often], ends[often]
            final = np.flatnonzero(np.diff(piece, append=-1))
            last = np.repeat(final, np.diff(final, prepend=-1))
            for at in range(0, len(starts), WORDS_AT_ONCE):
                begin = starts[at : at + WORDS_AT_ONCE]
                number = np.arange(at, at + len(begin))
                size = ends[np.minimum(number + max_words - 1, last[at : at + len(begin)])] - begin
                offsets = np.concatenate([[0], np.cumsum(size)]).astype("int32")
                flat = body[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1], dtype="int32")]
                grams = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                found = pc.value_counts(grams)
                yield _counted(found.field("values"), lang, found.field("counts"))

    return run


def _first(phrase: str, k: Column | int) -> Column:
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), F.lit(k) if isinstance(k, int) else k)


def _rest(phrase: str, k: Column) -> Column:
    """A phrase without its first k words."""
    return F.substring(F.col(phrase), F.length(_first(phrase, k)) + 2, F.length(phrase))


def _size(phrase: str) -> Column:
    return F.length(phrase) - F.length(F.translate(phrase, " ", "")) + 1


def edges(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """The edges (lang, gram, n) of the graph over whole texts: every word of a piece begins one gram of ``max_words`` words,
    an edge from the node of its first words to that of its last words. Near the end of a piece the gram is shorter: the correction
    for the flow that ends there. Grams are counted within each batch before they are shuffled.

    A word of fewer than ``min_count`` occurrences is in no phrase that counts: it ends its piece. The empty gram counts all words.
    """
    arrow_by_bytes(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))
    rows = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words(rows, min_count))
    counts = rows.mapInArrow(_grams(max_words, shared), COUNTS).groupBy("key").agg(F.sum("n").alias("n"))
    return counts.select(*_parts("gram"), "n")


def flows(graph: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to ``max_words`` words that occur ``min_count`` times or more: an occurrence of a phrase
    begins exactly one gram, so its count is the flow out of it, over longer edges and over those that end with their piece.
    The empty phrase has the number of all words."""
    heads = [_first("gram", k) for k in range(1, max_words)]
    longer = [F.when(above != F.col("gram"), head) for above, head in zip(heads, heads[1:])]
    whole = F.when((F.col("n") >= min_count) & (heads[-1] != F.col("gram")), F.col("gram"))
    key = F.concat("phrase", F.lit(KEY_GAP), "lang").alias("key")
    spread = graph.select("lang", F.explode(F.array(heads[0], *longer, whole)).alias("phrase"), "n").where("phrase IS NOT NULL")
    counts = spread.select(key, "n").groupBy("key").agg(F.sum("n").alias("n")).select(*_parts("phrase"), F.col("n").alias("f"))
    return counts.where((F.col("f") >= min_count) | (F.col("phrase") == ""))


def compact(counts: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The graph's frequent edges in their unary paths: (lang, edge, head, tail, f, path, place, final).

    A node is unary where all its flow comes in by one edge and leaves by one edge. Edges that meet in a unary node belong to one
    path, named by its first edge; ``place`` counts from 0 and ``final`` marks the last edge. Pointer jumping needs as many rounds as the
    logarithm of the longest path. A path has no cycle, as flow begins and ends somewhere.
    """
    sized = counts.withColumn("words", _size("phrase")).where("phrase != ''")
    edge = sized.where(F.col("words") == max_words).select(
        "lang", F.col("phrase").alias("edge"), _first("phrase", max_words - 1).alias("head"),
        _rest("phrase", F.lit(1)).alias("tail"), "f",
    )
    node = sized.where(F.col("words") == max_words - 1).select("lang", F.col("phrase").alias("node"), F.col("f").alias("flow"))
    enter = edge.select("lang", F.col("tail").alias("node"), F.col("edge").alias("before"), F.col("f").alias("flow"))
    leave = edge.select("lang", F.col("head").alias("node"), "edge", F.col("f").alias("flow"))
    keys = ["lang", "node", "flow"]
    links = materialize(node.join(enter, keys).join(leave, keys).select("lang", "edge", "before"), "links")
    placed = links.select("lang", "edge", F.col("before").alias("path"), F.lit(1).cast("long").alias("place"))
    while True:
        above = placed.select("lang", F.col("edge").alias("path"), F.col("path").alias("further"), F.col("place").alias("more"))
        jumped = materialize(
            placed.join(above, ["lang", "path"], "left").select(
                "lang", "edge", F.coalesce("further", "path").alias("path"),
                (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("further").isNotNull().alias("moved"),
            ),
            "paths",
        )
        placed = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    followed = links.select("lang", F.col("before").alias("edge"), F.lit(False).alias("final"))
    return edge.join(placed, ["lang", "edge"], "left").join(followed, ["lang", "edge"], "left").select(
        "lang", "edge", "head", "tail", "f", F.coalesce("path", "edge").alias("path"),
        F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("final", F.lit(True)).alias("final"),
    )


def longer(counts: DataFrame, paths: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, most): the highest count of a phrase that is one word longer. No longer phrase that holds it has a higher one.

    Around nodes it follows from the compact paths: a node inside a path occurs only within the path's edges, whose count is
    its own, and beside these only the two ends of a path matter.
    """
    inside = paths.where("not final").select("lang", F.col("tail").alias("phrase"), "f")
    begins = paths.where("place = 0").select("lang", F.col("head").alias("phrase"), "f")
    ends = paths.where("final").select("lang", F.col("tail").alias("phrase"), "f")
    words = _size("phrase")
    middle = counts.where((words > 2) & (words < max_words))
    parts = F.array(_first("phrase", words - 1), _rest("phrase", F.lit(1)))
    shorter = middle.select("lang", F.explode(parts).alias("phrase"), "f")
    found = inside.unionByName(begins).unionByName(ends).unionByName(shorter)
    return found.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two words or more, by their cut of the lowest score."""
    words = _size("phrase")
    cuts = F.transform(
        F.sequence(F.lit(1), words - 1),
        lambda k: F.struct(
            k.alias("k"), _first("phrase", k).alias("first"), _rest("phrase", k).alias("rest")
        ),
    )
    split = counts.where(words > 1).select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("cut"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    total = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    a, l, r = (F.col(x).cast(COUNT) for x in "alr")
    score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a * a, l * r)
    rows = split.select("lang", "phrase", "a", "cut.*").join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    best = rows.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.join(total, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(
    docs: DataFrame,
    *,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    absorbed_percent: int = ABSORBED_PERCENT,
) -> DataFrame:
    """Each language's ``top`` collocations of 2 to ``max_words`` words of documents (lang, text).

    Returns lang, rank, phrase, a (its count), l and r (those of the parts of its lowest-scoring cut), n (all words of the language),
    score. A phrase goes where a longer one that holds it has ``absorbed_percent`` of its count. Null texts count as empty, a null lang as
    'und'; ties in score go by count, then by the phrase's bytes; repeated rows count as often as they come; an empty
    table gives no rows; other columns are ignored. Counts must stay under 10^15.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases need two words or more and a count of one or more")
    counts = materialize(flows(edges(docs, max_words, min_count), max_words, min_count), "phrases")
    paths = materialize(compact(counts, max_words), "paths")
    within = longer(counts, paths, max_words)
    free = F.col("most").isNull() | (100 * F.col("most") < absorbed_percent * F.col("a"))
    rows = scored(counts).join(within, ["lang", "phrase"], "left").where(free).drop("most")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def path_phrases(paths: DataFrame) -> DataFrame:
    """The compact paths as phrases (lang, phrase, f, words), longer than the edges where passages repeat."""
    word = F.struct("place", F.substring_index("edge", " ", -1).alias("word"))
    grouped = paths.groupBy("lang", "path", "f").agg(F.sort_array(F.collect_list(word)).alias("steps"))
    more = F.slice("steps.word", 2, F.size("steps"))
    return grouped.select("lang", F.concat_ws(" ", F.col("path"), more).alias("phrase"), "f").withColumn("words", _size("phrase"))
