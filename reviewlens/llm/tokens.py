"""Token ids of whole texts, by a public tokenizer that runs once for each different chunk between white space."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from reviewlens.llm.chunks import Recent, different, gathered, looked_up, runs, slices, text_bytes

SEPARATORS = np.isin(np.arange(256), list(b" \n"))
LOWER = np.arange(256, dtype="uint8")
LOWER[ord("A") : ord("Z") + 1] += 32
MARKED = b"<|"
JOINED = 4_096
KEPT_CHUNKS = 400_000


def _cuts() -> np.ndarray:
    """Between which two ASCII bytes the pre-tokenizer always cuts: letters stay together, digits are alone, and other signs stay
    together, but an apostrophe may go with the letters after it."""
    kind = np.zeros(256, "uint8")  # 0: not ASCII, never cut
    kind[33:127] = 3
    kind[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
    kind[ord("0") : ord("9") + 1] = 2
    both = (kind[:, None] > 0) & (kind[None, :] > 0)
    cut = both & ((kind[:, None] != kind[None, :]) | (kind[:, None] == 2))
    cut[ord("'")] = cut[:, ord("'")] = False
    return cut.ravel()


CUTS = _cuts()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Encodes texts with a ``tokenizers`` file whose pre-tokenizer drops white space.

    Spaces and line ends never lie inside a token of such a tokenizer, and neither do the places of ``CUTS``; a chunk between them
    gives the same ids anywhere, in upper case as in lower case, so each different chunk of a batch is encoded once. Texts with the marks of
    special tokens are cut at white space only and keep their case. Ids are unsigned 32-bit integers.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = Recent(KEPT_CHUNKS)
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(1 + max(names.values()), bool)
        self.ends_word[[i for x, i in names.items() if x.endswith("</w>")]] = True

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. Plain words go many at a time, as each ends with the only end-of-word piece that it has."""
        out: list[bytes | None] = [None] * len(chunks)
        plain = [i for i, x in enumerate(chunks) if x.isascii() and x.isalpha()]
        for at in range(0, len(plain), JOINED):
            part = plain[at : at + JOINED]
            ids = np.array(self.tokenizer.encode(" ".join([chunks[i] for i in part]), add_special_tokens=False).ids, "uint32")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                for i, a, b in zip(part, [0, *ends], ends, strict=False):
                    out[i] = raw[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        coded = self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, coded, strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each followed by ``end_id``, in one array, and the bounds of each text in it."""
        body, bounds = text_bytes(texts)
        cut = None
        if MARKED not in body.tobytes():
            body = LOWER[body]
            cut = CUTS[(body[:-1].astype("uint16") << 8) | body[1:]]
        starts, ends, own = runs(body, bounds, SEPARATORS[body], cut)
        codes, chunks = different(body, starts, ends)
        ids, last = gathered(looked_up(chunks, self.cache, self._ids), codes, "uint32")
        ends = np.append(0, last)[own]
        return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker."""
    return ChunkEncoder(path)


def encoded(batch: pa.RecordBatch, path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of bounded size, each with the ids of its column text and their bounds."""
    for rows in slices(batch):
        yield rows, *encoder(path).encode(rows.column("text"), end_id)
