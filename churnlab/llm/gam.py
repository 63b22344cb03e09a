"""Operator 6 - quality classifier: an additive model with pairwise interactions.

Every text becomes a row of numbers (:data:`FEATURES`).  Training cuts each
feature into quantile bins and learns one lookup table per feature by cyclic
boosting: round after round each feature in turn gets a shallow tree (up to
four leaves along its bins) fitted to the current gradients, scaled by a small
rate and added to its table.  Then pairs are ranked by how much a cut along
both axes would still gain, and the best few get two-dimensional tables in the
same way.  A score is the logistic of an intercept plus table lookups, added
for a whole batch at once.

Learning uses at most ``per_class`` labelled documents of either class, taken
by a hash of the id (weights restore the classes' true shares); only their
feature rows reach the driver.  Scoring is one narrow pass; texts are never
shuffled beyond the join that picks the sample, whose id side is bounded.

Cases: null and empty texts get the features of the empty text and a score;
repeated rows get equal scores; without labels of both classes the score is
the share of label 1 seen (1.0 with no label at all); an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.llm import textstats as S
from churnlab.llm.common import aliased, labelled_sample, map_texts

FEATURES = ("words", "word_length", "symbols", "capitals", "digits", "stops", "marks", "bars", "other_bytes", "lines",
            "repeated_lines", "repeated_windows", "same_as_before", "different_words", "entropy")

PER_CLASS = 6_000


def features(text: str) -> list[float]:
    data = text.encode()
    words = data.split()
    c = S.byte_counts(data)
    n, size = len(words), max(1, len(data))
    letters = max(1, int(c[65:91].sum() + c[97:123].sum()))
    ids = S.word_ids(words)
    p = c[c > 0] / size
    lines = text.count("\n") + 1
    return [np.log1p(n), (size - c[32] - c[10]) / max(1, n), S.n_symbols(c) / max(1, n), c[65:91].sum() / letters,
            c[48:58].sum() / size, (c[46] + c[63]) / max(1, n), c[33] / max(1, n), c[124] / max(1, n),
            c[128:].sum() / size, n / lines, S.duplicate_lines(text) / lines, S.in_repeated_windows(ids) / max(1, n),
            float((ids[1:] == ids[:-1]).sum()) / max(1, n), (int(ids.max()) + 1) / np.sqrt(n) if n else 0.0,
            float(-(p * np.log2(p)).sum()) if len(data) else 0.0]


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                out += t[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values along ordered bins: each part is split where the gain is largest, ``depth`` times."""
    out = np.empty(len(g))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
        k = int(gains.argmax()) + 1
        if gains[k - 1] > 1e-6:
            out[:k] = shallow_tree(g[:k], h[:k], depth - 1)
            out[k:] = shallow_tree(g[k:], h[k:], depth - 1)
            return out
    out[:] = -g.sum() / (h.sum() + 1.0)
    return out


def cross_cut(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best single cut along both axes of a grid: values of its four quarters, and the gain over axis cuts."""
    n, m = g.shape
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = np.arange(n - 1)[:, None], np.arange(m - 1)[None]
    q = []
    for c in (cg, ch):
        ll, l_, _l = c[a, b], c[a, m - 1], c[n - 1, b]
        q.append((ll, l_ - ll, _l - ll, c[-1, -1] - l_ - _l + ll))
    gains = sum(_gain(x, y) for x, y in zip(*q, strict=True)) - _gain(cg[-1, -1], ch[-1, -1])
    rows = _gain(cg[:-1, -1], ch[:-1, -1]) + _gain(cg[-1, -1] - cg[:-1, -1], ch[-1, -1] - ch[:-1, -1])
    cols = _gain(cg[-1, :-1], ch[-1, :-1]) + _gain(cg[-1, -1] - cg[-1, :-1], ch[-1, -1] - ch[-1, :-1])
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    v = [-x[i, j] / (y[i, j] + 1.0) for x, y in zip(*q, strict=True)]
    out = np.empty((n, m))
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return out, float(gains[i, j] - max(rows.max(), cols.max()) + _gain(cg[-1, -1], ch[-1, -1]))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    e = np.unique(np.quantile(x, np.arange(1, bins) / bins))
    return e[e > x.min()]


def fit_rows(x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: int = 48, pair_bins: int = 8, rounds: int = 150,
             pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.1) -> AdditiveModel:
    p = float((w * y).sum() / w.sum())
    model = AdditiveModel(float(np.log(p / (1 - p))))
    k = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(k)]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    raw = np.full(len(x), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        s = 1 / (1 + np.exp(-raw))
        return w * (s - y), w * s * (1 - s)

    for _ in range(rounds):
        for j in range(k):
            if len(model.tables[j]) < 2:
                continue
            g, h = slopes()
            n = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n))
            model.tables[j] += step
            raw += step[at[j]]
    model.pair_edges = [_edges(x[:, j], pair_bins) for j in range(k)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    ranked = sorted(((cross_cut(grid(a, b, g), grid(a, b, h))[1], -a, -b) for a in range(k) for b in range(a + 1, k)
                     if sizes[a] > 1 and sizes[b] > 1), reverse=True)
    model.pairs = [(-a, -b) for gain, a, b in ranked[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for t, (a, b) in zip(model.pair_tables, model.pairs, strict=True):
            g, h = slopes()
            step = rate * cross_cut(grid(a, b, g), grid(a, b, h))[0]
            t += step
            raw += step[coarse[a], coarse[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> AdditiveModel:
    sample, counts = labelled_sample(labels.select("doc_id", label), label, per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # texts become 15 numbers where they are read; only these meet in one place
    got = map_texts(rows, _Features(), "x array<double>", ("label",)).limit(int(2.6 * per_class)).collect()
    y = np.array([r["label"] for r in got], float)
    if len(set(y.tolist())) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 1.0
        return AdditiveModel(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    x = np.array([r["x"] for r in got])
    w = np.ones(len(y))
    for k in (0, 1):
        w[y == k] = counts[k] / (y == k).sum()
    return fit_rows(x, y, w / w.mean())


class _Features:
    def __call__(self, texts: list[str]) -> dict[str, object]:
        return {"x": [features(t) for t in texts]}


class _Score:
    def __init__(self, model: AdditiveModel):
        self.model = model

    def __call__(self, texts: list[str]) -> dict[str, object]:
        x = np.array([features(t) for t in texts])
        return {"score": self.model.score(x) if self.model.edges else np.full(len(texts), 1 / (1 + np.exp(-self.model.intercept)))}


def score(docs: DataFrame, model: AdditiveModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and score (0 to 1, higher: label 1 likelier)."""
    return map_texts(docs, _Score(model), "score double", keep, text)


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.7) -> DataFrame:
    """The documents that score at least ``threshold``; all columns kept."""
    plain, back = aliased(docs)
    kept = score(plain, model, tuple(plain.columns), back("text")).where(F.col("score") >= threshold)
    return kept.select(*(F.col(back(c)).alias(c) for c in docs.columns))
