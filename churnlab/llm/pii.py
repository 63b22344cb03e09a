"""Operator 3 - personal data by base patterns and a skip-chain CRF.

Base spans come from four patterns (:func:`base_spans`), each found in one
linear walk over the whole text.  A skip-chain conditional random field then
looks at what the patterns left: its nodes are the base spans and the other
tokens that could be personal data (groups of 7 or more digits, tokens with
``@``, and tokens equal to the name part of an address in the text); its edges
link neighbouring nodes and, as skip edges, all nodes that share a key - the
last seven digits or the name part - to one shared node, so n occurrences make
n of them.  Labels are "none" and the four kinds.  Loopy belief propagation
runs over all texts of a batch at once, until each text's messages stand still
(or ``ROUNDS``, should its loops never do), with base spans and the shared
nodes of their keys fixed to their kinds.  So a token that reads like a known
entity anywhere in the document takes its label, however often it is repeated;
other tokens labelled with a kind become additional spans.

Training maximises the pseudo-likelihood of the base labels, given features of
a token's shape (digits, separators, check digit, ...) and of the neighbours
(by a chain edge, and the last and next occurrence of its key), on about ``sample`` documents taken
by a hash of the id; skip weights have a prior that favours equal labels.
Everything else is one narrow pass, no shuffle.

Cases: null and empty texts have no spans; a sample without nodes leaves the
prior; very long texts take memory for their nodes only; repeated rows give
equal rows.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.llm.common import aliased, by_hash, map_texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 3_000
ROUNDS = 1_000
#: Holds a shared node to its kinds against the messages of any number of occurrences.
FIXED = 1e9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])+")
_TOKEN = re.compile(r"[A-Za-z0-9._%+-]+")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    if not _MARK.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() < 64 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Nodes:
    """Candidates of one text: spans, kind of base spans (-1: none), features, keys."""

    spans: list[tuple[int, int]]
    base: list[int]
    features: list[tuple[int, ...]]
    keys: list[str]


N_FEATURES = 33


def _over_255(part: str) -> bool:
    """Whether a decimal number of any length is over 255."""
    n = part.lstrip("0")
    return part.isdecimal() and (len(n) > 3 or int(n or 0) > 255)


def _features(text: str, a: int, b: int) -> tuple[int, ...]:
    s = text[a:b]
    n = sum("0" <= c <= "9" for c in s)
    letters = sum(c.isalpha() for c in s)
    dots = s.count(".")
    before = text[max(0, a - 2):a].strip()
    parts = s.split(".")
    flags = [0, 1 + sum(n > k for k in (0, 3, 6, 9, 13, 19)), 8 + min(dots, 4)]
    for k, on in enumerate(("@" in s, "." in s.rpartition("@")[2] and "@" in s, s[0] == "+" or before[-1:] == "+", letters > 0,
                            letters > n, "-" in s, "(" in s or ")" in s, " " in s, len(s) > 12, len(s) > 20, len(s) > 39,
                            before[-1:] in ("=", ":", '"'), len(parts) == 4 and all(0 < len(p) < 4 for p in parts), n == len(s),
                            s[0] == "0", text[b:b + 1] in ('"', "/", "_"), a == 0, 13 < n < 20 and luhn(_digits(s)),
                            13 < n < 20 and not luhn(_digits(s)), any(map(_over_255, parts)))):
        if on:
            flags.append(13 + k)
    return tuple(flags)


def _key(s: str, email: bool) -> str:
    if email:
        return "n" + s.partition("@")[0].lower()
    d = _digits(s)
    return "d" + d[-7:] if len(d) >= 7 else ""


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> Nodes:
    if not base and not _MARK.search(text):
        return Nodes([], [], [], [])
    found = [(a, b, k, _key(text[a:b], k == 0)) for a, k, b in base]
    taken = sorted((a, b) for a, _, b in base)
    names = {key for _, _, k, key in found if k == 0 and len(key) > 4}
    free: list[tuple[int, int, int, str]] = []
    for m in _DIGITS.finditer(text):
        key = _key(m.group(), False)
        if key:
            free.append((m.start(), m.end(), -1, key))
    at = text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > 0 and text[a - 1] in _LOCAL:
            a -= 1
        m = _TOKEN.match(text, b)
        b = m.end() if m else b
        if b - a > 3:
            free.append((a, b, -1, _key(text[a:b], True)))
        at = text.find("@", b)
    if names:
        for m in _TOKEN.finditer(text):
            key = "n" + m.group().lower().strip(".-")
            if key in names:
                free.append((m.start(), m.start() + len(m.group().rstrip(".-")), -1, key))
    last = 0
    i, end = 0, -1
    for f in sorted(free):
        while i < len(taken) and taken[i][0] < f[1]:
            end, i = max(end, taken[i][1]), i + 1
        if f[0] >= max(end, last):
            found.append(f)
            last = f[1]
    found.sort()
    return Nodes([(a, b) for a, b, _, _ in found], [k for _, _, k, _ in found],
                 [_features(text, a, b) for a, b, _, _ in found], [key for *_, key in found])


@dataclass
class SkipChain:
    """Weights: ``unary`` (features x 5 labels), ``chain`` and ``skip`` (5 x 5); label 0 is none, k + 1 kind k."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @classmethod
    def prior(cls) -> SkipChain:
        unary = np.zeros((N_FEATURES, 5))
        unary[0, 0] = 2.0
        return cls(unary, np.zeros((5, 5)), 6.0 * np.eye(5))

    def emissions(self, nodes: list[Nodes]) -> np.ndarray:
        feats = [f for n in nodes for f in n.features]
        row = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        flat = np.array([v for f in feats for v in f], np.int64)
        out = np.zeros((len(feats), 5))
        np.add.at(out, row, self.unary[flat])
        return out

    def beliefs(self, emit: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray], rounds: int = ROUNDS,
                text: np.ndarray | None = None) -> np.ndarray:
        """Marginals by loopy propagation; edges: from, to, 1 for skip edges; ``text``: number of each edge's text.

        A text's messages are sent until none of them changes.
        """
        a, b, skip = edges
        src, dst = np.r_[a, b], np.r_[b, a]
        m = len(a)
        text = np.zeros(m, np.int64) if text is None else text
        of = np.r_[text, text]
        pair = np.where(np.r_[skip, skip][:, None, None] == 1, self.skip, self.chain)
        pair[m:] = pair[m:].transpose(0, 2, 1)
        back = np.r_[np.arange(m, 2 * m), np.arange(m)]
        msg = np.zeros((2 * m, 5))
        at = np.arange(2 * m)
        for r in range(rounds):
            if not len(at):
                break
            belief = emit.copy()
            np.add.at(belief, dst[at], msg[at])
            into = (belief[src[at]] - msg[back[at]])[:, :, None] + pair[at]
            top = into.max(1, keepdims=True)
            new = np.log(np.exp(into - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            moving = np.zeros(int(text.max()) + 1, bool)
            moving[of[at[np.abs(new - msg[at]).max(1) >= 1e-4]]] = True
            msg[at] = .5 * msg[at] + .5 * new if r else new
            at = at[moving[of[at]]]
        belief = emit.copy()
        np.add.at(belief, dst, msg)
        belief = np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)


def graph_of(nodes: list[Nodes]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Edges for :meth:`SkipChain.beliefs`, the emissions of the shared nodes (numbered behind all others), texts of edges.

    Nodes of one key are linked to its shared node, others to their neighbour.
    """
    edges: list[tuple[int, int, int, int]] = []
    shared: list[np.ndarray] = []
    at, total = 0, sum(len(n.keys) for n in nodes)
    for t, n in enumerate(nodes):
        groups: dict[str, list[int]] = {}
        for i, key in enumerate(n.keys):
            if key:
                groups.setdefault(key, []).append(i)
            if i and not (key and n.keys[i - 1] == key):
                edges.append((at + i - 1, at + i, 0, t))
        for members in groups.values():
            if len(members) > 1:
                edges += [(total + len(shared), at + i, 1, t) for i in members]
                known = [n.base[i] + 1 for i in members if n.base[i] >= 0]
                emit = np.full(5, -FIXED if known else 0.0)
                emit[known] = FIXED
                shared.append(emit)
        at += len(n.keys)
    a, b, kind, text = np.array(edges, np.int64).reshape(-1, 4).T
    return (a, b, kind), np.array(shared).reshape(-1, 5), text


def edges_of(nodes: list[Nodes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chain edges between neighbours and skip edges between successive equal keys."""
    a: list[int] = []
    b: list[int] = []
    kind: list[int] = []
    at = 0
    for n in nodes:
        last: dict[str, int] = {}
        for i, key in enumerate(n.keys):
            before = last.get(key) if key else None
            if before is not None:
                a.append(before)
                b.append(at + i)
                kind.append(1)
            if i and before != at + i - 1:
                a.append(at + i - 1)
                b.append(at + i)
                kind.append(0)
            last[key] = at + i
        at += len(n.keys)
    return np.array(a, np.int64), np.array(b, np.int64), np.array(kind, np.int64)


def train(nodes: list[Nodes], rounds: int = 150, rate: float = 0.5, keep: float = 2e-3) -> SkipChain:
    """Pseudo-likelihood: each label given its features and its neighbours' labels."""
    start = SkipChain.prior()
    labels = np.array([k + 1 for n in nodes for k in n.base], np.int64)
    if not len(labels):
        return start
    feats = [f for n in nodes for f in n.features]
    x = np.zeros((len(feats), N_FEATURES))
    x[np.repeat(np.arange(len(feats)), [len(f) for f in feats]), [v for f in feats for v in f]] = 1
    a, b, kind = edges_of(nodes)
    one = np.eye(5)[labels]
    around = np.zeros((4, len(labels), 5))      # chain before, chain after, skip before, skip after
    for t in (0, 1):
        e = kind == t
        np.add.at(around[2 * t], b[e], one[a[e]])
        np.add.at(around[2 * t + 1], a[e], one[b[e]])
    f = SkipChain(start.unary.copy(), start.chain.copy(), start.skip.copy())
    sums = [np.full_like(w, 1e-8) for w in (f.unary, f.chain, f.skip)]
    n = len(labels)
    for _ in range(rounds):
        z = x @ f.unary + around[0] @ f.chain + around[1] @ f.chain.T + around[2] @ f.skip + around[3] @ f.skip.T
        p = np.exp(z - z.max(1, keepdims=True))
        d = one - p / p.sum(1, keepdims=True)
        grads = (x.T @ d / n - keep * (f.unary - start.unary),
                 (around[0].T @ d + d.T @ around[1]) / n - keep * (f.chain - start.chain),
                 (around[2].T @ d + d.T @ around[3]) / n - 10 * keep * (f.skip - start.skip))
        for w, g, s in zip((f.unary, f.chain, f.skip), grads, sums, strict=True):
            s += g * g
            w += rate * g / np.sqrt(s)
    return f


def find(texts: list[str], field: SkipChain, least: float = 0.5) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind number, end, is base) of every span of each text, sorted."""
    base = [base_spans(t) for t in texts]
    nodes = [nodes_of(t, s) for t, s in zip(texts, base, strict=True)]
    emit = field.emissions(nodes)
    fixed = np.array([k + 1 for n in nodes for k in n.base], np.int64)
    some = np.flatnonzero(fixed)
    out = [[(a, k, b, True) for a, k, b in s] for s in base]
    if len(some) == len(fixed):
        return out
    emit[some] = -50.0
    emit[some, fixed[some]] = 50.0
    edges, shared, text = graph_of(nodes)
    p = field.beliefs(np.r_[emit, shared], edges, text=text)
    at = 0
    for spans, n in zip(out, nodes, strict=True):
        for i, (a, b) in enumerate(n.spans):
            k = int(p[at + i].argmax())
            if n.base[i] < 0 and k and p[at + i, k] >= least:
                spans.append((a, k - 1, b, False))
        at += len(n.spans)
        spans.sort()
    return out


class _Sampled:
    def __call__(self, texts: list[str]) -> dict[str, object]:
        import pickle
        return {"nodes": [pickle.dumps(nodes_of(t, base_spans(t))) for t in texts]}


def fit(docs: DataFrame, sample: int = SAMPLE) -> SkipChain:
    """A field trained on about ``sample`` documents that hold a digit or ``@``."""
    import pickle
    rows = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]")).withColumn("_all", F.lit(0))
    picked = by_hash(rows, {0: max(1, rows.select("doc_id", "_all").count())}, "_all", sample)
    got = map_texts(picked, _Sampled(), "nodes binary", ()).collect()
    return train([pickle.loads(r["nodes"]) for r in sorted(got)])


class _Find:
    def __init__(self, field: SkipChain):
        self.field = field

    def __call__(self, texts: list[str]) -> dict[str, object]:
        return {"spans": [[{"start": a, "kind": KINDS[k], "end": b, "base": base} for a, k, b, base in s]
                          for s in find(texts, self.field)]}


def find_personal(docs: DataFrame, field: SkipChain, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and spans (start, kind, end, base), by start, then kind in the order of KINDS."""
    return map_texts(docs, _Find(field), "spans array<struct<start:long,kind:string,end:long,base:boolean>>", keep, text)


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


class _Redact:
    def __init__(self, field: SkipChain):
        self.field = field

    def __call__(self, texts: list[str]) -> dict[str, object]:
        return {"redacted": [_masked(t, s) for t, s in zip(texts, find(texts, self.field), strict=True)]}


def _masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """Spans replaced by their kind; overlapping spans become one, named after the first."""
    out, at = [], 0
    for a, k, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: SkipChain) -> DataFrame:
    """The documents with personal data masked; n_chars, if there, follows the new text; null texts stay null."""
    plain, back = aliased(docs)
    out = map_texts(plain, _Redact(field), "redacted string", tuple(plain.columns), back("text"))
    new = F.when(F.col(back("text")).isNotNull(), F.col("redacted"))
    cols = []
    for f in docs.schema:
        c = F.col(back(f.name))
        if f.name == "text":
            c = new
        elif f.name == "n_chars":
            c = F.when(F.col(back("text")) != F.col("redacted"), F.length("redacted").cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return out.select(*cols)
