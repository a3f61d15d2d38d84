"""Operator 7: documents of nearly equal shingle sets, joined by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.llm.common import arrow_by_bytes, components, give_back, small
from reviewlens.storage import materialize

WORDS = 5
BITS = 27
SUB_KEYS = 1 << 33
CELL_BYTES = 4 << 20
BLOCK = 1 << 20
SLICE_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype="uint8")
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n + 1, ODD)
    back = np.full(n + 1, np.uint64(pow(int(ODD), -1, 1 << 64)))
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


_POWERS = [_powers(1)]


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word in UTF-8 bytes, and the number of words before each of ``cuts`` (ascending places at which
    a text begins or ends; words do not go across). A hash is a polynomial over the lower-cased bytes, taken
    as a difference of running sums, block by block so that memory is bounded for any text."""
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    stops[inner - 1] = solid[inner - 1]
    ends = np.flatnonzero(stops) + 1
    out = np.empty(len(starts), dtype="uint64")
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK)))
        low, high = starts[at], ends[to - 1]
        if len(_POWERS[0][0]) <= high - low:
            _POWERS[0] = _powers(max(int(high - low), BLOCK))
        power, back = _POWERS[0]
        sums = np.zeros(high - low + 1, dtype="uint64")
        np.cumsum((LOWER[data[low:high]].astype("uint64") + np.uint64(1)) * power[: high - low], out=sums[1:])
        out[at:to] = (sums[ends[at:to] - low] - sums[starts[at:to] - low]) * back[starts[at:to] - low]
        at = to
    return mix(out), np.searchsorted(starts, cuts)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct hashed shingles, sorted: ``WORDS`` consecutive words, or all words if fewer."""
    offsets = np.frombuffer(texts.buffers()[1], "int32", len(texts) + 1, 4 * texts.offset).astype("int64")
    if texts.buffers()[2] is None:
        yield from (np.empty(0, "uint64") for _ in range(len(texts)))
        return
    everything = np.frombuffer(texts.buffers()[2], "uint8")
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        cuts = offsets[at : to + 1] - offsets[at]
        hashes, word_cuts = word_hashes(everything[offsets[at] : offsets[to]], cuts)
        n = len(hashes) - WORDS + 1
        rows = np.zeros(max(n, 0), dtype="uint64")
        for j in range(WORDS if n > 0 else 0):
            rows += hashes[j : j + n] * np.uint64(2 * j + 3) ** np.uint64(7)
        rows = mix(rows)
        for low, high in zip(word_cuts[:-1], word_cuts[1:], strict=True):
            if high - low >= WORDS:
                yield np.unique(rows[low : high - WORDS + 1])
            elif high > low:
                few = hashes[low:high] * np.arange(101, 101 + 2 * (high - low), 2, dtype="uint64")
                yield mix(few.sum(keepdims=True) + np.uint64(high - low))
            else:
                yield np.empty(0, "uint64")
        at = to


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a shingle set; equal sets have equal names. Not for empty sets."""
    total = mix(shingles ^ ODD).sum(dtype="uint64", keepdims=True) + np.uint64(len(shingles))
    return int(mix(total).astype("int64")[0])


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype("int64") if x.dtype != np.dtype("uint64") else x.view("int64"))


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text").cast(pa.string()).fill_null("")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes = [], []
        for x in shingle_sets(_texts(batch)):
            sizes.append(len(x))
            nodes.append(node_of(x) if len(x) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())],
            names=["doc_id", "k", "n_shingles", "node"],
        )


def _distinct_sets(batch: pa.RecordBatch, firsts: Bitmap) -> Iterator[tuple[int, np.ndarray]]:
    """The batch's sets that may link with others than equals (4 shingles or more), each once, of the rows that ``firsts``
    may have."""
    batch = batch.filter(pa.array(firsts.has(batch.column("row").to_numpy().view("uint64"))))
    if not batch.num_rows:
        return
    seen = set()
    for x in shingle_sets(_texts(batch)):
        if len(x) >= 4 and (node := node_of(x)) not in seen:
            seen.add(node)
            yield node, x


def _tokens(firsts: Bitmap):
    return lambda batch: [x for _, x in _distinct_sets(batch, firsts)]


def _dealt(parts_of, bits: int, subs: int):
    """The batch's keys as (bucket, sub, keys), each key once or, if several of its sets have it, twice. A bucket covers 2 **
    15 bits of a bitmap of 2 ** ``bits``; a key is written as its 15 bits and 17 more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (parts := parts_of(batch)):
                continue
            keys = np.concatenate(parts)
            del parts
            keys.sort()
            most = np.ones(len(keys), dtype=bool)
            most[2:] = keys[2:] != keys[:-2]
            keys = keys[most]
            at = keys & np.uint64((1 << bits) - 1)
            group = (at >> np.uint64(15)) * np.uint64(subs) + (keys >> np.uint64(57)) % np.uint64(subs)
            order = np.argsort(group, kind="stable")
            group = group[order].astype("int64")
            short = ((at & np.uint64(32767)) << np.uint64(17) | keys >> np.uint64(40) & np.uint64(0x1FFFF))[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            offsets = pa.array(np.append(first, len(group)) * 4, pa.int32())
            packed = pa.BinaryArray.from_buffers(
                pa.binary(), len(first), [None, offsets.buffers()[1], pa.py_buffer(short.astype("<u4").tobytes())]
            )
            arrays = [pa.array(group[first] // subs, pa.int32()), pa.array(group[first] % subs, pa.int32()), packed]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "sub", "keys"])

    return run


def _repeated(rows: pa.Table) -> pa.Table:
    """The bits of a bucket's keys that come at least twice."""
    keys = np.sort(np.frombuffer(b"".join(rows.column("keys").to_pylist()), "<u4"))
    slots = np.unique(keys[1:][keys[1:] == keys[:-1]] >> 17)
    bits = np.zeros(4096, dtype="uint8")
    np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype("uint8"))
    part = pa.array([rows.column("bucket")[0].as_py()], pa.int32())
    return pa.table({"part": part, "bits": pa.array([bits.tobytes()], pa.binary())})


def prefix_signatures(x: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of a sorted set x of n tokens, of which ``frequent`` marks some: two sets of Jaccard similarity 0.8 or
    more share at least one.

    Order the tokens: rare ones first, by hash, then frequent ones, by hash. At most n // 5 tokens of x are
    missing in the other set, so if x has that many rare tokens and one more, those are its prefix and stand each
    for itself. Else all r rare tokens stand for themselves and the prefix goes on through frequent ones, of which
    each two neighbours make one combination. If no rare token is shared, a tokens of x and b of the other set are not
    shared with 2a + b <= 2n / 5, r of the a are rare, a missing frequent token breaks two combinations and a foreign
    one breaks one; so 2n // 5 - 2r + 2 frequent tokens leave a combination whole. Of two sets, the one whose
    prefix ends first has its prefix within reach of the other's.
    """
    n = len(x)
    rare, often = x[~frequent], x[frequent]
    if len(rare) > n // 5:
        return rare[: n // 5 + 1]
    often = often[: max(0, 2 * n // 5 - 2 * len(rare) + 2)]
    return np.concatenate([rare, mix(often[:-1] * np.uint64(3) + mix(often[1:] ^ ODD))])


def fitting(bits: int, keys: int) -> int:
    """The size, as a power of two, of a bitmap of ``keys`` keys or fewer: 64 bits for each, 2 ** ``bits`` at most. All of it goes
    through the driver."""
    return min(bits, max(15, (64 * keys).bit_length()))


class Bitmap:
    """Membership of 64-bit keys by their low bits, in a broadcast array of fixed size. A set bit may be another key's;
    an unset bit is sure. Made of pieces (part, bits) of 2 ** 15 bits, of which there are 2 ** (bits - 15) at most."""

    def __init__(self, pieces: DataFrame, bits: int) -> None:
        flat = np.zeros(1 << (bits - 3), dtype="uint8")
        # as Arrow batches, which the driver's JVM hands on as they come; rows it would hold unpacked and pickled
        found = pieces.groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")).toArrow()
        for part, piece in zip(found["part"].to_pylist(), found["bits"], strict=True):
            flat[part * 4096 : (part + 1) * 4096] = np.frombuffer(piece.as_buffer(), "uint8")
            del piece
        del found
        give_back()
        self.bits = bits
        self.shared: Broadcast = pieces.sparkSession.sparkContext.broadcast(flat)

    @staticmethod
    def of(keys: DataFrame, name: str, bits: int) -> Bitmap:
        """Of the values of a column."""
        at = F.col(name).bitwiseAND((1 << bits) - 1)
        slots = keys.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(32767).alias("bit"))
        return Bitmap(slots.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")), bits)

    @staticmethod
    def of_repeated(texts: DataFrame, parts_of, bits: int, subs: int) -> Bitmap:
        """Of the keys, among all that ``parts_of`` finds in batches of texts, that come at least twice."""
        dealt = texts.mapInArrow(_dealt(parts_of, bits, subs), "bucket int, sub int, keys binary")
        return Bitmap(dealt.groupBy("bucket", "sub").applyInArrow(_repeated, "part int, bits binary"), bits)

    def has(self, x: np.ndarray) -> np.ndarray:
        at = x & np.uint64((1 << self.bits) - 1)
        return (self.shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("uint8")) & 1 == 1

    def close(self) -> None:
        self.shared.destroy()


def _signed(firsts: Bitmap, often: Bitmap):
    """All signatures of the batch's sets."""
    return lambda batch: [prefix_signatures(x, often.has(x)) for _, x in _distinct_sets(batch, firsts)]


def size_band(n: int) -> int:
    """A band holds sizes within a factor of 1.25, the largest that can link, so partners are at most one band apart."""
    return int(np.floor(np.log(n) / np.log(1.25)))


def _signatures(firsts: Bitmap, often: Bitmap, twice: Bitmap):
    """(sig, node, band) of the signatures that may come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bands, parts = [], [], []
            for node, x in _distinct_sets(batch, firsts):
                found = prefix_signatures(x, often.has(x))
                parts.append(found[twice.has(found)])
                nodes.append(np.full(len(parts[-1]), node, dtype="int64"))
                bands.append(np.full(len(parts[-1]), size_band(len(x)), dtype="int32"))
            if parts:
                arrays = [_longs(np.concatenate(parts)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(bands))]
                yield pa.RecordBatch.from_arrays(arrays, names=["sig", "node", "band"])

    return run


def _packed_sets(firsts: Bitmap, bitmap: Bitmap):
    """(node, n, tokens) of the sets that the bitmap may have; a token is its hash's low six bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, x) for k, x in _distinct_sets(batch, firsts) if bitmap.has(np.array([k]).view("uint64"))[0]]
            for at in range(0, len(found), 256):
                part = found[at : at + 256]
                packed = [x.view("uint8").reshape(-1, 8)[:, :6].tobytes() for _, x in part]
                arrays = [pa.array([k for k, _ in part], pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "tokens"])

    return run


def _unpacked(x: bytes) -> np.ndarray:
    """Tokens in ascending order."""
    out = np.zeros((len(x) // 6, 8), dtype="uint8")
    out[:, :6] = np.frombuffer(x, "uint8").reshape(-1, 6)
    return np.sort(out.view("uint64").ravel())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(c) for c in ("a", "b", "a_tokens", "b_tokens")]
        a_out, b_out = [], []
        for at in range(batch.num_rows):
            a, b, x, y = (c[at].as_py() for c in cols)
            x, y = _unpacked(x), _unpacked(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                a_out.append(a)
                b_out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the node pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more."""
    met = pairs.join(sets.toDF("a", "a_tokens"), "a")
    near = (F.octet_length("a_tokens") * 4 <= F.octet_length("b_tokens") * 5) & (
        F.octet_length("b_tokens") * 4 <= F.octet_length("a_tokens") * 5
    )
    met = met.join(sets.toDF("b", "b_tokens"), "b").where(near)
    return materialize(met.select("a", "b", "a_tokens", "b_tokens").mapInArrow(_verified, "a long, b long"), "links")


def _groups(rows: DataFrame, value: str) -> DataFrame:
    """(sig, band, rep, beside) of the size bands of a signature (sig, band, node and ``value``) that hold, with the two bands
    beside them, several values; rep is their least node, beside that of the next lower band, null if that one is not
    among these. Rows are summed up by signature and band before the bands of a signature come together."""
    held = rows.groupBy("sig", "band").agg(F.min(value).alias("x"), F.max(value).alias("y"), F.min("node").alias("rep"))
    along = Window.partitionBy("sig").orderBy("band")
    near = along.rangeBetween(-1, 1)
    wide = held.select("sig", "band", *(f(c).over(near).alias(c) for f, c in ((F.min, "x"), (F.max, "y"), (F.min, "rep"))))
    lower = F.when(F.lag("band").over(along) == F.col("band") - 1, F.lag("rep").over(along))
    return wide.where("x != y").select("sig", "band", "rep", lower.alias("beside"))


def _open(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures (sig, node, band, component) that a set shares, in neighbouring bands, with another component, and the
    candidate graph (node, component) of their sets: any two of these hang together."""
    groups = small(materialize(_groups(named, "component"), "open"))
    left = materialize(named.join(groups.drop("beside"), ["sig", "band"]), "open-signatures")
    edges = left.select(F.col("node").alias("a"), F.col("rep").alias("b"))
    edges = edges.union(groups.where("beside IS NOT NULL").select("beside", "rep"))
    return left.drop("rep"), components(edges)


def _compared(rows: pa.Table) -> pa.Table:
    """Links between the sets of a cell that share a signature, lie in neighbouring bands and different components, and, in a cell
    of two different stripes, come from both. A pair that links found here connect already is not compared."""
    nodes = rows.column("node").to_numpy()
    bands, stripes = rows.column("band").to_numpy(), rows.column("stripe").to_numpy()
    crossing = len(rows) > 0 and rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    sets = [_unpacked(x) for x in rows.column("tokens").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    _, top = np.unique(rows.column("component").to_numpy(), return_inverse=True)
    sigs = rows.column("sigs").combine_chunks()
    flat = sigs.flatten().to_numpy()
    owner = np.repeat(np.arange(len(nodes)), sigs.value_lengths().to_numpy())
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    cuts = np.append(np.flatnonzero(np.diff(flat, prepend=~flat[:1])), len(flat))
    place = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    mine = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[mine], np.arange(len(nodes) + 1))
    a_out, b_out = [], []
    for x in range(len(nodes)):
        groups = place[mine[starts[x] : starts[x + 1]]]
        near = np.unique(np.concatenate([owner[cuts[g] : cuts[g + 1]] for g in groups])) if len(groups) else np.empty(0, "int64")
        near = near[(near > x) & (np.abs(bands[near] - bands[x]) <= 1) & (top[near] != top[x])]
        near = near[(100 * sizes[near] >= 80 * sizes[x]) & (80 * sizes[near] <= 100 * sizes[x])]
        if crossing:
            near = near[stripes[near] != stripes[x]]
        for at in range(0, len(near), 256):
            part = near[at : at + 256]
            part = part[top[part] != top[x]]
            if not len(part):
                continue
            tokens = np.concatenate([sets[y] for y in part])
            found = sets[x][np.minimum(np.searchsorted(sets[x], tokens), sizes[x] - 1)] == tokens
            both = np.add.reduceat(found.astype("int64"), np.cumsum(sizes[part]) - sizes[part])
            for y in part[100 * both >= 80 * (sizes[x] + sizes[part] - both)]:
                if top[y] != top[x]:
                    top[top == top[y]] = top[x]
                    a_out.append(nodes[x])
                    b_out.append(nodes[y])
    return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})


def _settled(own: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect what ``labels`` leave apart, exactly up to connectivity.

    Sets that share a signature with another component make a candidate graph, in which all members of a group (a signature in
    a band) hang together by the group's least node, and groups of neighbouring bands by theirs. Each of its components is
    compared in one task, several small ones together; one of more than ``CELL_BYTES`` is cut into stripes, and each two
    stripes meet in a cell, so a task's share is bounded whatever a group's size. A set is sent once (or once per stripe)
    instead of once per pair, and no pairs are written."""
    named = own.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "labelled")
    left, graph = _open(named)
    rows = left.groupBy("node", "component", "band").agg(F.collect_list("sig").alias("sigs"))
    rows = rows.join(graph.withColumnRenamed("component", "grp"), "node").join(sets, "node")
    rows = materialize(rows, "open-sets")
    size = F.sum(F.octet_length("tokens") + 8 * F.size("sigs"))
    groups = materialize(rows.groupBy("grp").agg(F.ceil(size / CELL_BYTES).cast("int").alias("stripes")), "group-sizes")
    tasks = rows.agg(F.ceil(size / CELL_BYTES)).first()[0] or 1
    rows = rows.join(groups, "grp").withColumn("stripe", F.pmod(F.xxhash64("node"), "stripes").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))
    cells = rows.withColumn("other", other).select(
        F.when(F.col("stripes") > 1, F.xxhash64("grp")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(tasks))).alias("cell"),
        F.least("stripe", "other").alias("i"), F.greatest("stripe", "other").alias("j"),
        "node", "component", "band", "sigs", "tokens", "stripe",
    )
    return materialize(cells.groupBy("cell", "i", "j").applyInArrow(_compared, "a long, b long"), "links")


def similar_sets(docs: DataFrame, *, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, n_shingles, node) of all documents, k a hash of the text, and (node, component) of the sets that link with others."""
    spark: SparkSession = docs.sparkSession
    arrow_by_bytes(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("k", F.xxhash64("text"))
    names = materialize(keyed.mapInArrow(_names, "doc_id long, k long, n_shingles long, node long"), "names")
    # Of the rows of equal sets one is read on; a collision of the bitmap lets another pass and changes nothing.
    row = names.where("node IS NOT NULL").select("node", F.xxhash64("doc_id", "k").alias("row"))
    total, n = names.agg(F.sum("n_shingles"), F.count("*")).first()
    enough = fitting(bits, n)
    firsts = Bitmap.of(row.groupBy("node").agg(F.min("row").alias("row")), "row", enough)
    texts = keyed.select("text", F.xxhash64("doc_id", "k").alias("row"))

    subs, fit = -(-(total or 0) // SUB_KEYS) or 1, fitting(bits, total or 0)
    often = Bitmap.of_repeated(texts, _tokens(firsts), fit, subs)
    twice = Bitmap.of_repeated(texts, _signed(firsts, often), fit, subs)
    shared = texts.mapInArrow(_signatures(firsts, often, twice), "sig long, node long, band int")
    shared = materialize(shared.distinct(), "signatures")
    often.close()
    twice.close()
    groups = small(materialize(_groups(shared, "node").drop("beside"), "groups"))
    own = materialize(shared.join(groups, ["sig", "band"]), "banded")

    wanted = Bitmap.of(own.select("node"), "node", enough)
    packed = texts.mapInArrow(_packed_sets(firsts, wanted), "node long, tokens binary")
    sets = materialize(packed.dropDuplicates(["node"]).join(own.select("node").distinct(), "node", "left_semi"), "sets")
    wanted.close()
    firsts.close()

    # Each set against the least set that it meets, then all that are left: pairs within a component are settled.
    first = own.where("node != rep").groupBy("node").agg(F.min("rep").alias("b")).withColumnRenamed("node", "a")
    links = _links(first, sets)
    return names, components(links.union(_settled(own.drop("rep"), components(links), sets)))


def similar_documents(docs: DataFrame, *, bits: int = BITS) -> DataFrame:
    """Groups of documents (doc_id, text) whose shingle sets link, directly or through others.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct shingles of five words, or the whole
    sequence of fewer; two sets link when 100 * intersection >= 80 * union. Equal sets are one node, and only one of their rows
    is read after the first pass. Tokens that come in several such texts count as frequent; which they are is kept in a bitmap
    of 2 ** ``bits`` bits, where a collision makes a token frequent and loses nothing, and so are the signatures that come
    twice. Shingles are read anew from the texts in each pass. Nodes, shingles and signatures are 64-bit hashes, and
    comparisons use 48 bits of them.

    Returns doc_id, n_shingles, component_id (least doc_id that links lead to, itself included). A null or empty text or one
    without words has an empty set and links with nothing; documents with a null doc_id are grouped but never name a group
    unless it has no other id; repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored.
    """
    names, labels = similar_sets(docs, bits=bits)
    named = materialize(
        names.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "document-nodes"
    )
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
