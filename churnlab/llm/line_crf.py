"""Operator 8 - quality rules: a linear-chain CRF labels lines content or boilerplate.

A text's lines with a word are described by small discrete features.  A
linear-chain conditional random field over them has one weight per feature
value and label and one per pair of neighbouring labels; Viterbi decoding
marks every line and a document is kept if its content lines hold at least
``min_share`` of its characters.  Decoding and training step through all texts
of a batch side by side (line 1 of each, line 2 of each, ...).

No line labels exist, so training writes its own on a bounded sample of
documents (about ``sample`` texts, taken by a hash of the id): a line is
boilerplate if it is frequent, if it is a licence or navigation line, or if
symbols, table bars or shouting fill it.
The field learns from these and spreads them along neighbouring lines.

A line of ``LEAST_CHARS`` characters or more, of one word or many, is frequent
if it occurs in the share ``often`` of all texts of the table, and in
``LEAST_TEXTS`` at least; equal texts count once.
The counts are a shuffle of 16 bytes a line over the whole table.  As a share
decides, there are at most (mean number of lines of a text / ``often``)
frequent lines however large the table is; their 8-byte hashes go to every
worker, and the flag is a feature in training and in decoding.

The base rules are plain counts over the whole text, see :func:`base_counts`.
One narrow pass after training.

Cases: null and empty texts have no words and fail the base rule; a table
without any line trains a field that calls everything content; repeated rows
get equal rows.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Container
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.llm import textstats as S
from churnlab.llm.common import by_hash, map_texts

#: Number of values of each line feature: words, symbols, bars, capitals, digits, ending, notice, repeated (1: in the text,
#: 2: frequent in the table, 3: both), place, length.
SIZES = (5, 4, 3, 3, 3, 2, 2, 4, 3, 4)
_AT = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
N_VALUES = sum(SIZES)
_NOTICE = re.compile(r"licen[sc]ed? |copyright|all rights reserved|cookie|privacy policy|terms of|click here|subscribe|https?://", re.I)
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
_BLANK = " \t\n\x0b\x0c\r"

SAMPLE = 2_000
OFTEN = 2e-5
LEAST_TEXTS = 10
#: Characters of a line that can be frequent in the table; shorter ones meet by chance.
LEAST_CHARS = 8
#: Prior weight of boilerplate for frequent lines: a sample may hold few or none of them.
FREQUENT = 8.0


def _step(x: float, *cuts: float) -> int:
    return sum(x > c for c in cuts)


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def line_features(text: str, frequent: Container[int] = frozenset()) -> tuple[list[tuple[int, ...]], list[str]]:
    """Feature values of each line with a word, and the lines; ``frequent``: hashes of the table's frequent lines."""
    lines = [s for x in text.split("\n") if (s := x.strip(_BLANK))]
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    out, last = [], len(lines) - 1
    any_frequent = bool(frequent)
    for i, x in enumerate(lines):
        size, blanks = len(x), x.count(" ")
        data = x.encode()
        symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">")))
        bars = data.count(b"|")
        up = len(data) - len(data.translate(None, _CAPITALS))
        if len(data) != size:
            up += sum(map(str.isupper, _BEYOND_ASCII.findall(x)))
        digits = len(data) - len(data.translate(None, b"0123456789"))
        out.append((_step(blanks, 0, 2, 9, 29), _step(symbols / size, 0, .02, .1), _step(bars / (blanks + 1), 0, .2),
                    _step(up / size, .2, .6), _step(digits / size, .02, .3), int(x[-1] in ".!?:;\"'"),
                    int(_NOTICE.search(x) is not None), (seen[x] > 1) + 2 * (size >= LEAST_CHARS and any_frequent and _hash(data) in frequent),
                    0 if i == 0 else 2 if i == last else 1,
                    _step(size, 20, 80, 300)))
    return out, lines


@dataclass
class LineField:
    """Weights: ``unary`` (feature values x 2 labels) and ``chain`` (label before x label); label 1 is boilerplate."""

    unary: np.ndarray
    chain: np.ndarray
    #: Hashes of the lines that are frequent in the table.
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def emissions(self, values: np.ndarray) -> np.ndarray:
        return self.unary[values + _AT].sum(1)

    def decode(self, emit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of every line; ``emit`` holds the texts' lines one after another."""
        order, starts, active = _steps(sizes)
        best = np.empty_like(emit)
        back = np.zeros((len(emit), 2), np.int8)
        for t, n in enumerate(active):
            at = starts[order[:n]] + t
            if t == 0:
                best[at] = emit[at]
                continue
            options = best[at - 1][:, :, None] + self.chain
            back[at] = options.argmax(1)
            best[at] = options.max(1) + emit[at]
        label = np.zeros(len(emit), np.int8)
        ends = starts + sizes - 1
        some = sizes > 0
        label[ends[some]] = best[ends[some]].argmax(1)
        for t in range(len(active) - 1, 0, -1):
            at = starts[order[:active[t]]] + t
            label[at - 1] = back[at, label[at]]
        return label


def _steps(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling number of lines, where each begins, and how many reach each step."""
    order = np.argsort(-sizes, kind="stable")
    starts = np.cumsum(sizes) - sizes
    longest = int(sizes.max()) if len(sizes) else 0
    active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")
    return order, starts, active


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis, keepdims=True)) + m).squeeze(axis)


def train(values: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rounds: int = 80, rate: float = 0.3,
          keep: float = 1e-3) -> LineField:
    """Maximum likelihood by gradient steps with adaptive sizes; forward-backward over all texts at once."""
    prior = np.zeros((N_VALUES, 2))
    prior[_AT[7] + 2:_AT[7] + 4, 1] = FREQUENT
    field = LineField(prior, np.zeros((2, 2)))
    if not len(labels):
        return field
    order, starts, active = _steps(sizes)
    flat = (values + _AT).ravel()
    want_u = np.stack([np.bincount(flat, np.repeat(labels == k, values.shape[1]), N_VALUES) for k in (0, 1)], 1)
    inner = np.ones(len(labels), bool)
    inner[starts[sizes > 0]] = False
    at = np.flatnonzero(inner)
    want_c = np.bincount(labels[at - 1] * 2 + labels[at], minlength=4).reshape(2, 2).astype(float)
    su, sc = np.full_like(field.unary, 1e-8), np.full_like(field.chain, 1e-8)
    for _ in range(rounds):
        emit = field.emissions(values)
        ahead, behind = emit.copy(), np.zeros_like(emit)
        for t in range(1, len(active)):
            i = starts[order[:active[t]]] + t
            ahead[i] += _lse(ahead[i - 1][:, :, None] + field.chain, 1)
        for t in range(len(active) - 1, 0, -1):
            i = starts[order[:active[t]]] + t
            behind[i - 1] = _lse(field.chain + (emit[i] + behind[i])[:, None, :], 2)
        total = _lse(ahead + behind, 1)
        node = np.exp(ahead + behind - total[:, None])
        have_u = np.stack([np.bincount(flat, np.repeat(node[:, k], values.shape[1]), N_VALUES) for k in (0, 1)], 1)
        edge = ahead[at - 1][:, :, None] + field.chain + (emit[at] + behind[at])[:, None, :] - total[at][:, None, None]
        gu = (want_u - have_u) / len(labels) - keep * (field.unary - prior)
        gc = (want_c - np.exp(edge).sum(0)) / len(labels) - keep * field.chain
        su += gu * gu
        sc += gc * gc
        field = LineField(field.unary + rate * gu / np.sqrt(su), field.chain + rate * gc / np.sqrt(sc))
    return field


class _Hashes:
    """A text's hash and the hashes of its distinct lines of ``LEAST_CHARS`` characters or more, with blanks or without."""

    def __call__(self, texts: list[str]) -> dict[str, object]:
        lines = [{s for x in t.split("\n") if len(s := x.strip(_BLANK)) >= LEAST_CHARS} for t in texts]
        return {"text_hash": [_hash(t.encode()) for t in texts], "line": [[_hash(x.encode()) for x in s] for s in lines]}


def frequent_lines(docs: DataFrame, n: int, often: float = OFTEN, least: int = LEAST_TEXTS, text: str = "text") -> np.ndarray:
    """Sorted hashes of the lines that occur in the share ``often`` of ``n`` texts, and in ``least`` different ones."""
    pairs = map_texts(docs, _Hashes(), "text_hash long, line array<long>", (), text)
    # distinct pairs first: copies of one text don't make its lines frequent, and no line's texts meet in one task
    counts = pairs.select("text_hash", F.explode("line").alias("line")).distinct().groupBy("line").count()
    rows = counts.where(F.col("count") >= max(least, often * n)).select("line").toArrow()
    return np.sort(rows.column("line").to_numpy())


class Sorted:
    """Membership in sorted 64-bit numbers, 8 bytes each."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = array("q", numbers.astype("<i8").tobytes())

    def __len__(self) -> int:
        return len(self.numbers)

    def __contains__(self, x: int) -> bool:
        i = bisect_left(self.numbers, x)
        return i < len(self.numbers) and self.numbers[i] == x


def _as_set(task: _Lines | _Judge) -> Sorted:
    """The task's frequent hashes for lookups, made once a worker."""
    if "_set" not in task.__dict__:
        task._set = Sorted(task.frequent)
    return task._set


class _Lines:
    """Features and lines of the sampled texts."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent

    def __call__(self, texts: list[str]) -> dict[str, object]:
        frequent = _as_set(self)
        found = [line_features(t, frequent) for t in texts]
        return {"values": [bytes(v for row in f for v in row) for f, _ in found], "lines": [x for _, x in found]}


def fit(docs: DataFrame, sample: int = SAMPLE, often: float = OFTEN) -> LineField:
    """A field trained on about ``sample`` documents; see the module's docstring for its labels."""
    n = docs.count()
    frequent = frequent_lines(docs, n, often)
    rows = by_hash(docs.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("_all", F.lit(0)),
                   {0: max(1, n)}, "_all", sample)
    got = map_texts(rows, _Lines(frequent), "values binary, lines array<string>", ()).select(
        "values", F.transform("lines", lambda x: F.xxhash64(x)).alias("lines")).collect()
    texts = list({tuple(r["lines"]): r for r in got if r["lines"]}.values())
    if not texts:
        trained = train(np.zeros((0, len(SIZES)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return LineField(trained.unary, trained.chain, frequent)
    texts.sort(key=lambda r: r["lines"])
    values = np.concatenate([np.frombuffer(r["values"], np.uint8).reshape(-1, len(SIZES)) for r in texts]).astype(np.int64)
    noisy = (values[:, 1] == 3) | (values[:, 2] == 2) | (values[:, 3] == 2) | (values[:, 6] == 1)
    sizes = np.array([len(r["lines"]) for r in texts])
    trained = train(values, sizes, ((values[:, 7] >= 2) | noisy).astype(np.int64))
    return LineField(trained.unary, trained.chain, frequent)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()
    counts = S.byte_counts(data)
    return (len(words), S.word_chars(text, data, counts), S.n_symbols(counts), S.duplicate_lines(text),
            S.in_repeated_windows(S.word_ids(words)))


class _Judge:
    def __init__(self, field: LineField):
        self.field = field
        self.frequent = field.frequent

    def __call__(self, texts: list[str]) -> dict[str, object]:
        base = [base_counts(t) for t in texts]
        frequent = _as_set(self)
        found = [line_features(t, frequent) for t in texts]
        sizes = np.array([len(x) for _, x in found])
        rows = [v for f, _ in found for v in f]
        marks = np.zeros(0, np.int8)
        if rows:
            marks = self.field.decode(self.field.emissions(np.array(rows, np.int64)), sizes)
        chars = np.array([len(x) for _, lines in found for x in lines], float)
        doc = np.repeat(np.arange(len(texts)), sizes)
        total = np.bincount(doc, chars, len(texts))
        content = np.bincount(doc, chars * (marks == 0), len(texts))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out: dict[str, object] = {k: list(v) for k, v in zip(names, zip(*base, strict=True), strict=True)}
        parts = np.split(marks, np.cumsum(sizes)[:-1]) if len(sizes) else []
        return out | {"content_share": content / np.maximum(total, 1), "line_labels": [p.tolist() for p in parts]}


def judge(docs: DataFrame, field: LineField, min_share: float = 0.3, keep: tuple[str, ...] = ("doc_id",),
          text: str = "text") -> DataFrame:
    """``keep`` columns, the base counts, content_share, line_labels (1: boilerplate), base_failed and kept."""
    schema = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "content_share double, line_labels array<tinyint>")
    out = map_texts(docs, _Judge(field), schema, keep, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= min_share))
