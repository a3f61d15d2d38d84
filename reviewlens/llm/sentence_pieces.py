"""Operator 11: encoding by a table of last tokens, and decoding, for sentence-piece models of the merge type."""

from __future__ import annotations

import contextlib
import os
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.chunks import Recent, different, gathered, looked_up, slices, text_bytes
from reviewlens.llm.common import arrow_by_bytes

SPACE = "▁"
MERGE_TYPE = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PAIRS_KEPT = 500_000
IDS = "doc_id long, ids array<int>"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixTable:
    """Merge encoding without merging.

    A sequence of tokens is the encoding of a text exactly if each token encodes as itself and each two neighbours
    encode as these two: merges within one token run as they would alone, and a merge across a border would show in
    the two tokens beside it. As a prefix of an encoding is an encoding, each prefix of a text has one last token:
    the only token that ends there and is compatible with the last token of the prefix before it. The tokens that end
    at a place come from an automaton, and the ids are read from the table backwards.

    ``pieces`` maps each mergeable piece to (id, score). Characters outside it are tokens with negative numbers.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]]) -> None:
        self.score = {piece: score for piece, (_, score) in pieces.items()}
        letters = {x for piece in pieces for x in piece}
        number = {piece: i for piece, (i, _) in pieces.items()}
        number |= {x: -1 - ord(x) for x in letters if x not in number}
        self.parts: dict[int, tuple[int, int]] = {}
        self.up: dict[int, float] = {}
        self.text = {}
        self.matches = ahocorasick.Automaton()
        kept = []
        for piece, token in number.items():
            parts = self._last_merge(piece) if len(piece) > 1 else None
            if len(piece) > 1 and parts is None:
                continue  # never the result of its own merges, so never a token
            kept.append(token)
            self.text[token] = piece
            self.matches.add_word(piece, (token, len(piece)))
            if parts:
                self.parts[token] = (number[parts[0]], number[parts[1]])
        self.matches.make_automaton()
        self.number = number
        self.letters = letters
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Tokens whose merges come in falling order of score, in which order is known without simulation.
        self.falling = {t for t in kept if self._falls(t)}

    def _merges(self, symbols: list[str]) -> Iterator[tuple[int, str, str]]:
        """The merges of a sequence in their order, which ``symbols`` undergoes: highest score first, leftmost first."""
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                value = score.get(symbols[i] + symbols[i + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, i
            if best is None:
                return
            left, right = symbols[at : at + 2]
            symbols[at : at + 2] = [left + right]
            yield at, left, right

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        symbols, last = list(piece), None
        for _, left, right in self._merges(symbols):
            last = (left, right)
        return last if len(symbols) == 1 else None

    def _falls(self, token: int) -> bool:
        here = self.score.get(self.text[token])
        parts = self.parts.get(token, ())
        return all(x not in self.parts or (self.score[self.text[x]] >= here and self._falls(x)) for x in parts)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of a token from the first letter to itself, each with the score of the merge that ends it."""
        out, ended = [], float("-inf")
        while True:
            out.append((token, ended))
            if token not in self.parts:
                return out[::-1]
            ended = self.score[self.text[token]]
            token = self.parts[token][side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the texts of two tokens, written together, encode as these two."""
        if left not in self.falling or right not in self.falling:
            symbols = list(self.text[left] + self.text[right])
            for _ in self._merges(symbols):
                pass
            return symbols == [self.text[left], self.text[right]]
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = self.score.get(self.text[x] + self.text[y])
            if across is not None and across > x_ends and across >= y_ends:  # among equal scores the left merge is first
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            if j + 1 == len(b) or (i + 1 < len(a) and x_ends >= y_ends):
                i += 1
            else:
                j += 1

    def tokens(self, text: str) -> list[int]:
        """The tokens of a text; a character outside the pieces is the number -1 - its code point."""
        last: list[int | None] = [None] * (len(text) + 1)
        if not self.letters.issuperset(text):
            for i, x in enumerate(text):
                if x not in self.letters:
                    last[i + 1] = -1 - ord(x)
        pairs, known = self.pairs, self.text
        for end, (token, size) in self.matches.iter(text):
            if last[end + 1] is None:
                before = last[end + 1 - size] if end + 1 > size else 0
                if end + 1 > size:
                    if before is None:
                        continue
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = before not in known or self.compatible(before, token)
                        if len(pairs) >= PAIRS_KEPT:
                            pairs.clear()
                        pairs[before, token] = fits
                    if not fits:
                        continue
                last[end + 1] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            out.append(token)
            at -= len(known.get(token, "?"))
        return out[::-1]


class Pieces:
    """A model file: encodes batches of texts into ids and decodes ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("PROTOCOL_BUFFERS_PYTHON_IMPLEMENTATION", "python")
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if (
            model.trainer_spec.model_type != MERGE_TYPE or not model.trainer_spec.byte_fallback
            or model.trainer_spec.treat_whitespace_as_suffix or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}
            or rules.precompiled_charsmap or rules.remove_extra_whitespaces
            or not rules.add_dummy_prefix or not rules.escape_whitespaces
        ):
            raise ValueError("only merge models with byte fallback, a prefix space and no other normalization are read")
        pieces = {p.piece.replace(SPACE, " "): (i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.mergeable = pieces
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.cache = Recent()
        #: joinable[256 * a + b]: the byte b follows a within some piece. Elsewhere no merge crosses.
        self.joinable = np.ones((256, 256), bool)
        self.joinable[:128, :128] = False
        for piece in pieces:
            raw = piece.encode()
            self.joinable[list(raw[:-1]), list(raw[1:])] = True
        self.joinable = self.joinable.ravel()
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.is_control = np.array([p.type == CONTROL for p in model.pieces])
        self.spaced = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        surface = {
            NORMAL: lambda p: p.piece.replace(SPACE, " ").encode(), CONTROL: lambda p: b"",
            UNKNOWN: lambda p: model.trainer_spec.unk_surface.encode(), BYTE: lambda p: bytes([int(p.piece[1:-1], 16)]),
        }
        written = [surface[p.type](p) for p in model.pieces]
        #: What each id stands for, and after that what it stands for at the begin of a text.
        self.surface = pa.array([*written, *(x[int(s) :] for x, s in zip(written, self.spaced, strict=True))], pa.binary())

    @cached_property
    def table(self) -> PrefixTable:
        return PrefixTable(self.mergeable)

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of a normalized text (spaces for space marks), four bytes each."""
        out = array("i")
        for token in self.table.tokens(chunk):
            if token >= 0:
                out.append(token)
            else:
                out.extend(self.byte_id[x] for x in chr(-1 - token).encode())
        return out.tobytes()

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of whole texts. A text gets a space before it and is cut where no piece has the two bytes beside the cut."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        marked = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        body, bounds = text_bytes(pc.if_else(pc.equal(texts, ""), texts, marked))
        cut = np.ones(len(body), bool)
        if len(body):
            cut[1:] = ~self.joinable[(body[:-1].astype("uint16") << 8) | body[1:]]
            cut[bounds[:-1][bounds[:-1] < len(body)]] = True
        starts = np.flatnonzero(cut)
        codes, chunks = different(body, starts, np.append(starts[1:], len(body))[: len(starts)])
        ids, ends = gathered(looked_up(chunks, self.cache, lambda x: map(self.chunk_ids, x)), codes, "int32")
        ends = np.insert(ends, 0, 0)[np.searchsorted(starts, bounds)]
        return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(ids))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Texts of lists of ids. The mark of the space before the text goes; bytes that are not UTF-8 become U+FFFD each."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(sizes, dtype="int64"))
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("int64")
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.spaced)):
            raise IndexError(f"ids lie between 0 and {len(self.spaced) - 1}")
        heard = np.flatnonzero(~self.is_control[ids])
        first = np.searchsorted(heard, ends[:-1])
        first = heard[first[first < len(heard)]]
        written = ids.copy()
        written[first] += len(self.spaced)  # also where it belongs to a later text, whose first it then is
        parts = self.surface.take(pa.array(written))
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype("int32")), parts), b"")
        if len(heard) == len(ids):
            with contextlib.suppress(pa.ArrowInvalid):
                return whole.cast(pa.string())
        rows = zip(ends, ends[1:], strict=False)
        return pa.array([self._readable(ids[a:b], parts[a:b].to_pylist()) for a, b in rows], pa.string())

    def _readable(self, ids: np.ndarray, parts: list[bytes]) -> str:
        """The text of one list, whose bytes are read run by run: control ids end a run as well."""
        out: list[str] = []
        for is_byte, run in groupby(range(len(ids)), key=lambda i: self.is_byte[ids[i]]):
            raw = b"".join(parts[i] for i in run)
            out += decoded_bytes(raw) if is_byte else raw.decode()
        return "".join(out)


def decoded_bytes(raw: bytes) -> Iterator[str]:
    """The characters of a run of bytes, each byte that starts none as U+FFFD."""
    at = 0
    while at < len(raw):
        size = 1 + sum(raw[at] >= x for x in (0xC2, 0xE0, 0xF0))
        try:
            yield raw[at : at + size].decode()
            at += size
        except UnicodeDecodeError:
            yield "�"
            at += 1


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One per Python worker."""
    return Pieces(path)


def _encode(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for rows in slices(batch):
                ids = model.encode(rows.column("text"))
                columns = {"doc_id": rows.column("doc_id"), "ids": ids}
                yield pa.RecordBatch.from_pydict(columns | ({"text": model.decode(ids)} if decoded else {}))

    return run


def encode_documents(docs: DataFrame, *, model: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every document (doc_id, text), as the model's library encodes whole texts without begin and end ids.
    With ``decoded`` also text, what the ids decode to.

    A null or empty text has no ids; a null doc_id stays null; repeated rows give repeated results; an empty table gives
    no rows; other columns are ignored. One narrow pass; time grows in proportion to a text, whatever its length.
    """
    arrow_by_bytes(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(model or default_model(), decoded), IDS + ", text string" * decoded)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            columns = {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "text": model.decode(batch.column("ids"))}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def decode_documents(coded: DataFrame, *, model: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of lists of ids (doc_id, ids). A null list gives the empty text; ids outside the model are refused."""
    arrow_by_bytes(coded.sparkSession)
    rows = coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(model or default_model()), f"{IDS}, text string")


def piece_digest(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """Per document: n_tokens, and hashes of its ids and of the text that they decode to."""
    return encode_documents(docs, model=model, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
