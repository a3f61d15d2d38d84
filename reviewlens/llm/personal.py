"""Operator 10: personal data in texts, by fixed patterns and a semi-Markov conditional random field over spans."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.common import arrow_by_bytes
from reviewlens.storage import collect_small

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
MAX_TOKENS = 16
FEATURE_BITS = 15
SAMPLE_TEXTS = 1_500
SAMPLE_CHARS = 20_000
ROUNDS = 4
SURE = 0.9

# The base patterns. A run that the pattern's first part would read in full is only tried from its
# start (or from the end of the last match), since no later start in it can succeed where the first has failed.
EMAIL = regex.compile(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = regex.compile(r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"\b(?:token|secret|password|passwd|api_key|apikey|key)\s{0,3}[=:]\s{0,3}[\"']([A-Za-z0-9+/_-]{16,128})[\"']", re.I)
ACTIVE = re.compile("[0-9@]")
NOT_DIGIT = re.compile("[^0-9]")
TOKENS = re.compile(r"[A-Za-z0-9]+|[^\x00-\x7F]+|[^\sA-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans of each maximal run of neighbouring white-space separated chunks that hold a digit or an @. No other
    text can hold an entity, so the field's other segments there are fixed."""
    run: list[tuple[int, int]] = []
    for m in re.finditer(r"\S+", text):
        if ACTIVE.search(text, *m.span()):
            run += [t.span() for t in TOKENS.finditer(text, *m.span())]
        elif run:
            yield run
            run = []
    if run:
        yield run


def _shape(part: str) -> str:
    """Letters as a, digits as 9, each run with its length up to 5; other characters as they are."""
    return re.sub(
        r"[A-Za-z]+|[0-9]+|[^\x00-\x7F]+|\s+",
        lambda m: ("9" if m[0][0].isdigit() else " " if m[0].isspace() else "a" if m[0].isascii() else "u") + str(min(len(m[0]), 5)),
        part,
    )


def span_features(text: str, start: int, end: int) -> list[int]:
    """Hashed features of a whole candidate segment and of the text beside it."""
    part = text[start:end]
    digits = NOT_DIGIT.sub("", part)
    letters = sum(c.isalpha() for c in part)
    before = text[max(0, start - 12) : start].rstrip()
    left = re.findall(r"\w+|[^\w\s]", before.lower())[-2:]
    octets = part.split(".")
    found = [
        "shape " + _shape(part)[:40],
        f"digits {min(len(digits), 20)}",
        f"length {min(len(part), 48) // 4}",
        f"mixed {min(letters, 8)} {min(len(digits), 8)}",
        f"ends {part[0] if not part[0].isalnum() else 'x'} {part[-1] if not part[-1].isalnum() else 'x'}",
        f"at {part.count('@')} dots {min(part.count('.'), 4)} {'@' in part and '.' in part.split('@')[-1]}",
        f"luhn {16 <= len(digits) <= 19 and luhn(digits)} {letters > 0}",
        f"octets {len(octets) == 4 and all(x.isdecimal() and len(x) < 4 and int(x) < 256 for x in octets)}",
        f"plus {part[0] == '+'} {min(len(digits), 16)} {letters > 0}",
        f"hex {len(part) >= 16 and all(c in '0123456789abcdefABCDEF' for c in part)} {min(len(part) // 8, 8)}",
        "left " + " ".join(left)[-20:],
        f"cut {text[start - 1 : start].isalnum()} {text[end : end + 1].isalnum()}",
        f"next {text[end : end + 1] if not text[end : end + 1].isalnum() else 'x'}",
    ]
    return [zlib.crc32(x.encode("utf-8", "replace")) & ((1 << FEATURE_BITS) - 1) for x in found]


class Lattice:
    """The candidate segments of one island: at most ``MAX_TOKENS`` tokens, a digit or @ within, neither beginning nor ending
    with a closing or opening mark. Any token may also stand outside entities."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]) -> None:
        self.tokens = tokens
        self.spans: list[tuple[int, int]] = []
        features = []
        for i, (start, _) in enumerate(tokens):
            if text[start] in ".,;:)]}'\"!?-":
                continue
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                end = tokens[j][1]
                if not text[end - 1].isalnum() or not ACTIVE.search(text, start, end):
                    continue
                self.spans.append((i, j + 1))
                features.append(span_features(text, start, end))
        self.features = np.array(features, dtype="int64") if features else np.zeros((0, 1), "int64")


@dataclass
class Field:
    """Weights of the span features by kind, and of the kind that follows a kind (the last index is outside)."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, lattice: Lattice) -> np.ndarray:
        return self.weights[lattice.features].sum(axis=1)


def _forward(lattice: Lattice, scores: np.ndarray, moves: np.ndarray, join) -> tuple[list, list]:
    """Scores of all segmentations of the first t tokens by their last label, and what ends where; ``join`` is a logarithm of a
    sum of exponentials or a maximum."""
    n, outside = len(lattice.tokens), len(KINDS)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (_, j) in enumerate(lattice.spans):
        ending[j].append(s)
    at = np.full((n + 1, outside + 1), -np.inf)
    at[0, outside] = 0.0
    into = np.full((n + 1, outside + 1), -np.inf)  # best or sum over the label before, for each label that starts at t
    for t in range(n + 1):
        if t:
            at[t, outside] = into[t - 1, outside]
            if ending[t]:
                s = ending[t]
                rows = np.stack([into[lattice.spans[x][0], :outside] + scores[x] for x in s])
                at[t, :outside] = join(rows, 0)
        into[t] = join(at[t][:, None] + moves, 0)
    return at, into


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    most = np.where(np.isfinite(most), most, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


def _backward(lattice: Lattice, scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations of the tokens from t on, by the label before t."""
    n, outside = len(lattice.tokens), len(KINDS)
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, _) in enumerate(lattice.spans):
        starting[i].append(s)
    after = np.full((n + 1, outside + 1), -np.inf)
    after[n] = 0.0
    for t in range(n - 1, -1, -1):
        first = np.full(outside + 1, -np.inf)
        first[outside] = after[t + 1, outside]
        if starting[t]:
            rows = np.stack([scores[x] + after[lattice.spans[x][1], :outside] for x in starting[t]])
            first[:outside] = _log_sum(rows, 0)
        after[t] = _log_sum(moves + first[None, :], 1)
    return after


def marginals(lattice: Lattice, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each (segment, kind), and expected counts of the moves."""
    outside, n = len(KINDS), len(lattice.tokens)
    at, into = _forward(lattice, scores, moves, _log_sum)
    after = _backward(lattice, scores, moves)
    total = _log_sum(at[n], 0)
    spans = np.array(lattice.spans, dtype="int64").reshape(-1, 2)
    seg = np.exp(into[spans[:, 0], :outside] + scores + after[spans[:, 1], :outside] - total)
    expected = np.zeros_like(moves)
    for t in range(n):
        first = np.full(outside + 1, -np.inf)
        first[outside] = after[t + 1, outside]
        own = np.flatnonzero(spans[:, 0] == t)
        if len(own):
            first[:outside] = _log_sum(scores[own] + after[spans[own, 1], :outside], 0)
        expected += np.exp(at[t][:, None] + moves + first[None, :] - total)
    return seg, expected


def decode(lattice: Lattice, scores: np.ndarray, moves: np.ndarray) -> list[tuple[int, int]]:
    """The best segmentation's entities as (segment, kind): bounded-entity dynamic programming over boundaries and kinds."""
    outside, t = len(KINDS), len(lattice.tokens)
    at, into = _forward(lattice, scores, moves, np.max)
    ending: dict[int, list[int]] = {}
    for s, (_, j) in enumerate(lattice.spans):
        ending.setdefault(j, []).append(s)
    out = []
    label = int(at[t].argmax())
    while t:
        if label == outside:
            start = t - 1
        else:
            s = max(ending[t], key=lambda x: into[lattice.spans[x][0], label] + scores[x, label])
            out.append((s, label))
            start = lattice.spans[s][0]
        label = int((at[start] + moves[:, label]).argmax())
        t = start
    return out[::-1]


def seed_spans(text: str) -> list[tuple[str, int, int]]:
    """What the field learns from: the base spans and quoted values that are assigned to a key's name."""
    return base_spans(text) + [("secret", *m.span(1)) for m in SECRET.finditer(text)]


def train(texts: list[str], *, rounds: int = ROUNDS, seed: int = 3) -> Field:
    """Fit the field by stochastic gradients; what the seeds don't cover, such as numbers that fail a check, is outside."""
    field = Field(np.zeros((1 << FEATURE_BITS, len(KINDS))), np.zeros((len(KINDS) + 1,) * 2))
    examples = []
    for text in texts:
        gold = {(a, b): KINDS.index(k) for k, a, b in seed_spans(text)}
        for tokens in islands(text):
            if len(tokens) > 8 * MAX_TOKENS:
                continue
            lattice = Lattice(text, tokens)
            if not lattice.spans:  # such as an @ by itself: one segmentation, nothing to learn
                continue
            ends = [(tokens[i][0], tokens[j - 1][1]) for i, j in lattice.spans]
            inside = [(a, b) for a, b in gold if tokens[0][0] < b and a < tokens[-1][1]]
            if set(inside) <= set(ends):
                chosen = [(s, gold[e]) for s, e in enumerate(ends) if e in gold]
                covered = sorted(lattice.spans[s] for s, _ in chosen)
                if all(x[1] <= y[0] for x, y in zip(covered, covered[1:], strict=False)):
                    examples.append((lattice, chosen))
    squares, move_squares = np.full_like(field.weights, 1e-2), np.full_like(field.moves, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for at in rng.permutation(len(examples)):
            lattice, chosen = examples[at]
            scores = field.scores(lattice)
            seg, expected = marginals(lattice, scores, field.moves)
            gradient, moved = -seg, -expected
            label, labels = len(KINDS), {lattice.spans[s][0]: (k, lattice.spans[s][1]) for s, k in chosen}
            t = 0
            while t < len(lattice.tokens):
                k, end = labels.get(t, (len(KINDS), t + 1))
                moved[label, k] += 1
                label, t = k, end
            for s, k in chosen:
                gradient[s, k] += 1
            used, where = np.unique(lattice.features, return_inverse=True)
            g = np.zeros((len(used), len(KINDS)))
            np.add.at(g, where.reshape(lattice.features.shape), gradient[:, None, :])
            g -= 1e-3 * field.weights[used]
            squares[used] += g**2
            field.weights[used] += 0.3 * g / np.sqrt(squares[used])
            move_squares += moved**2
            field.moves += 0.1 * moved / np.sqrt(move_squares)
    return field


def all_spans(text: str, base: list[tuple[str, int, int]], field: Field | None, sure: float = SURE) -> list[tuple[str, int, int]]:
    """The base spans, and the field's entities of a marginal of at least ``sure`` that touch none of them."""
    added = []
    if field is not None and ACTIVE.search(text):
        taken = sorted((a, b) for _, a, b in base)
        for tokens in islands(text):
            for at in range(0, len(tokens), 8 * MAX_TOKENS):
                lattice = Lattice(text, tokens[at : at + 8 * MAX_TOKENS])
                if not lattice.spans:
                    continue
                scores = field.scores(lattice)
                best = decode(lattice, scores, field.moves)
                if not best:
                    continue
                seg, _ = marginals(lattice, scores, field.moves)
                for s, k in best:
                    i, j = lattice.spans[s]
                    a, b = lattice.tokens[i][0], lattice.tokens[j - 1][1]
                    if seg[s, k] >= sure and not _touches(taken, a, b):
                        added.append((KINDS[k], a, b))
    return base + added


def _touches(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(x < b and a < y for x, y in taken)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    spans = sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame, *, sample_texts: int = SAMPLE_TEXTS, rounds: int = ROUNDS) -> Field:
    """A field from at most about ``sample_texts`` texts that hold a digit or @, chosen by a hash of the text, in stretches of
    at most ``SAMPLE_CHARS`` characters; the bounded sample is all that comes to the driver."""
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("personal"), "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < min(1.0, sample_texts / max(n, 1))).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    texts = collect_small(chosen.distinct(), 4 * sample_texts, "training sample")
    return train(sorted(r["text"] for r in texts), rounds=rounds)


def find_personal(docs: DataFrame, *, sample_texts: int = SAMPLE_TEXTS, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """Personal data in every whole text of (doc_id, text).

    Fixed patterns give the base spans of emails, IP addresses, cards and phone numbers. A semi-Markov field, trained on the
    corpus's own base spans and assigned secrets, scores whole candidate segments of up to ``MAX_TOKENS`` tokens and picks the
    best segmentation into kinds and outside; its entities that touch no base span are added if their marginal is at
    least ``sure``. Runs of more than 8 * ``MAX_TOKENS`` tokens are decoded in parts of as many.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (kind:start:end by kind, then start; code
    points, end exclusive). A null or empty text has none; a null doc_id stays null; repeated rows give repeated results;
    an empty table gives no rows; other columns are ignored.
    """
    arrow_by_bytes(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_texts=sample_texts, rounds=rounds))
    kinds = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    @F.pandas_udf(kinds)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*counts, digest, _joined(all_spans(text, base, shared.value, sure))))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", scan(F.col("text").cast("string")).alias("x")).select("doc_id", "x.*")
