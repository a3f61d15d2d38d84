"""Operator 6: word-piece counts by a longest-match automaton that never builds the pieces."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.chunks import Recent, different, looked_up, runs, slices, text_bytes
from reviewlens.llm.common import arrow_by_bytes
from reviewlens.llm.tokens import default_vocabulary

WORD_END = "</w>"
NOWHERE = -1
#: White space: one byte each, and what lies outside ASCII.
SPACES = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
WIDE_SPACES = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class LongestMatch:
    """A trie over the vocabulary with failure links and popped-token counts.

    A word is its symbols and an end mark. ``down[node]`` leads to the longer prefixes. When a node cannot be
    extended, the longest matches within its prefix are fixed: ``popped[node]`` is how many, and ``fail[node]`` the
    node of what remains of the prefix. Thus each symbol is read once and a word's count takes linear time.
    """

    def __init__(self, pieces: Iterable[tuple]) -> None:
        self.down: list[dict] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                node = self.down[node].setdefault(symbol, len(ends))
                if node == len(ends):
                    self.down.append({})
                    ends.append(False)
            ends[node] = node > 0
        self.fail = [NOWHERE] * len(ends)
        self.popped = [0] * len(ends)
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for symbol, node in self.down[above].items():
                queue.append(node)
                if ends[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, count = self.fail[above], self.popped[above]
                while at != NOWHERE and symbol not in self.down[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at != NOWHERE:
                    self.fail[node], self.popped[node] = self.down[at][symbol], count

    def count(self, word: Iterable) -> int:
        """Pieces of a greedy longest match from left to right; 1 (an unknown word) if it comes to no end."""
        down, fail, popped = self.down, self.fail, self.popped
        node = total = 0
        for symbol in word:
            while (below := down[node].get(symbol)) is None:
                total += popped[node]
                node = fail[node]
                if node == NOWHERE:
                    return 1
            node = below
        while node:
            total += popped[node]
            node = fail[node]
            if node == NOWHERE:
                return 1
        return total


def byte_symbols() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    """From a ``tokenizers`` file of byte-level pieces with a word-end suffix; the end mark is the symbol 256."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    symbols = byte_symbols()
    pieces = []
    for piece in vocabulary:
        body = piece.removesuffix(WORD_END)
        if body and all(x in symbols for x in body):
            pieces.append((*(symbols[x] for x in body), *[256] * (body != piece)))
    return LongestMatch(pieces)


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, cache = automaton(path), Recent()
        count = lambda words: [machine.count((*x.lower().encode(), 256)) for x in words]
        for batch in batches:
            for rows in slices(batch):
                body, bounds = text_bytes(pc.replace_substring_regex(rows.column("text"), WIDE_SPACES, " "))
                starts, ends, own = runs(body, bounds, SPACES[body])
                codes, words = different(body, starts, ends)
                pieces = np.array(looked_up(words, cache, count), dtype="int64")[codes]
                total = np.append(0, np.cumsum(pieces))[own]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(own)), pa.array(np.diff(total))],
                    names=["doc_id", "n_words", "n_tokens"],
                )

    return run


def token_counts(docs: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """Per document (doc_id, text): n_words, runs between white space (the Unicode property, as the tokenizer drops it) of the
    lower-cased text, and n_tokens, their word pieces by greedy longest match. One narrow pass over whole texts.

    A null or empty text has no words; a null doc_id stays null; repeated rows give repeated results; an empty table
    gives no rows; other columns are ignored.
    """
    arrow_by_bytes(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counts(vocabulary or default_vocabulary()), "doc_id long, n_words long, n_tokens long")
