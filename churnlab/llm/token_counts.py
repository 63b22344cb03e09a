"""Operator 9 - token counts by rank-synchronous array merging.

A piece model (byte-pair encoding with byte fallback) is read into arrays
once per worker.  Texts are cut into pre-tokens at places no piece spans,
each batch's distinct pre-tokens are laid out as one ragged array of symbol
ids, and rounds of merging apply every sequence's lowest-rank pair at the
same time until no pair is left; the surviving symbols are the count.

Merging all occurrences of a sequence's best pair in one round equals the
one-at-a-time order as long as a merge cannot create a better-ranked pair.
Pieces for which a better-ranked piece starts or ends with them (and pieces
that share a rank) might, so for those only the leftmost occurrence merges.

Cases: null and empty texts have 0 tokens; characters outside the vocabulary
count their UTF-8 bytes (byte fallback) or one unknown token; special strings
inside a text are ordinary text.  Rows are independent: ties, repeated rows,
empty tables and extra columns need no rule.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.llm.common import map_texts

SPACE = "▁"
#: Pre-tokens whose counts a worker remembers before it starts afresh.
REMEMBERED = 500_000


class PieceModel:
    """Vocabulary of a piece model as arrays for :func:`merge_counts`."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self._settings(sp)
        scores = sorted(set(pieces.values()), reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        self.index = {p: k for k, p in enumerate(pieces)}
        self.rank = np.array([rank_of[s] for s in pieces.values()], np.int64)
        shared = np.bincount(self.rank)[self.rank] > 1
        leftmost = shared.copy()
        pairs: dict[int, int] = {}
        n = self.n = len(pieces)
        self.alien: dict[str, int] = {}
        chars = {c: self._char(c) for p in pieces for c in p}
        for p, k in self.index.items():
            for cut in range(1, len(p)):
                left, right = p[:cut], p[cut:]
                a = self.index.get(left, chars.get(left))
                b = self.index.get(right, chars.get(right))
                if a is not None and b is not None:
                    pairs[a * (2 * n + 0x110000) + b] = k
                for part in (left, right):
                    if (j := self.index.get(part)) is not None and self.rank[j] >= self.rank[k]:
                        leftmost[j] = True
        self.leftmost = leftmost
        self._table(pairs)
        #: A cut before a space mark that follows another character is safe when no piece spans it.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.plain = self.cuts and self.prefix

    def _settings(self, sp) -> None:
        """Normalisation as the model file states it; only plain space marking is supported."""
        blob = sp.serialized_model_proto()
        top = _fields(blob)
        norm = {f: v for f, v in _fields(next((v for f, v in top if f == 3), b""))}
        trainer = {f: v for f, v in _fields(next((v for f, v in top if f == 2), b""))}
        if norm.get(2):
            raise ValueError("models with a character map are not supported")
        if trainer.get(3, 1) != 2:
            raise ValueError("not a byte-pair model")
        self.prefix = bool(norm.get(3, 1))
        self.squeeze = bool(norm.get(4, 1))
        self.byte_fallback = bool(trainer.get(35, 0))
        if self.squeeze or not norm.get(5, 1):
            raise ValueError("only models that keep every space as a mark are supported")

    def _char(self, c: str) -> int:
        """Symbol of a character: its piece, or a number beyond the pieces."""
        k = self.index.get(c)
        return self.n + ord(c) if k is None else k

    def _table(self, pairs: dict[int, int]) -> None:
        """Open addressing over arrays; a full probe run tells that a pair is unknown."""
        self.width = 2 * self.n + 0x110000
        bits = max(12, int(np.ceil(np.log2(max(1, len(pairs)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.found = np.full(1 << bits, -1, np.int64)
        self.probes = 1
        slots = self._slot(np.fromiter(pairs, np.int64, len(pairs))).tolist() if pairs else []
        for (key, k), s in zip(pairs.items(), slots, strict=True):
            run = 1
            while self.keys[s] >= 0:
                s, run = (s + 1) & self.mask, run + 1
            self.keys[s], self.found[s] = key, k
            self.probes = max(self.probes, run)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols merges into, -1 for none."""
        keys = left * self.width + right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.found[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.found[slot[open_[hit]]]
            open_ = open_[~hit & (at >= 0)]
        return out

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not hasattr(self, "by_point"):
            self.by_point = np.arange(0x110000, dtype=np.int64) + self.n
            for p, k in self.index.items():
                if len(p) == 1:
                    self.by_point[ord(p)] = k
        return self.by_point[points]

    def cost(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens that each surviving symbol stands for."""
        if not self.byte_fallback:
            return np.ones(len(symbols), np.int64)
        p = symbols - self.n
        alien = 1 + (p >= 0x80).astype(np.int64) + (p >= 0x800) + (p >= 0x10000)
        return np.where(p < 0, 1, alien)


def _fields(blob: bytes) -> list[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message, nested messages as bytes."""
    out, i = [], 0

    def number() -> int:
        nonlocal i
        x = s = 0
        while True:
            c = blob[i]
            i += 1
            x |= (c & 127) << s
            s += 7
            if c < 128:
                return x

    while i < len(blob):
        key = number()
        kind = key & 7
        if kind == 0:
            v: object = number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            v, i = blob[i:i + size], i + size
        out.append((key >> 3, v))
    return out


def merge_counts(model: PieceModel, words: list[str]) -> np.ndarray:
    """Tokens of each pre-token: rounds over one ragged symbol array."""
    words = [w[1:] if w[:1] == SPACE else SPACE + w for w in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.int64)
    sym = model.symbols("".join(words))
    seq = np.repeat(np.arange(len(words)), sizes)
    pair = _pairs(model, sym, seq)
    far = len(model.rank)
    while len(sym):
        rank = np.where(pair >= 0, model.rank[pair], far)
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        best = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.r_[starts, len(seq)])
        done = np.repeat(best == far, lengths)
        if done.any():
            out += np.bincount(seq[done], model.cost(sym[done]), len(words)).astype(np.int64)
            sym, seq, pair, rank = sym[~done], seq[~done], pair[~done], rank[~done]
            lengths, best = lengths[best != far], best[best != far]
            if not len(sym):
                break
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
        at = np.flatnonzero(rank == np.repeat(best, lengths))
        # positions of one sequence's best pairs; runs of neighbours overlap, so every second of a run merges
        run = np.r_[True, (at[1:] != at[:-1] + 1)]
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - first) % 2 == 0
        lead = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
        take &= lead | ~model.leftmost[pair[at]]
        # a leftmost-only piece among the best stops the rest of its sequence for this round
        wait = np.zeros(len(words), bool)
        wait[seq[at[model.leftmost[pair[at]]]]] = True
        take &= lead | ~wait[seq[at]]
        at = at[take]
        sym[at] = pair[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        touched = np.zeros(len(sym), bool)
        touched[at] = True
        touched[at[at > 0] - 1] = True
        # the symbol left of a merged one may itself have been swallowed: then the one before it is its neighbour
        two = at[(at > 1)] - 2
        touched[two] = True
        sym, seq, pair, touched = sym[keep], seq[keep], pair[keep], touched[keep]
        t = np.flatnonzero(touched)
        pair[t] = _pairs_at(model, sym, seq, t)
    return out


def _pairs(model: PieceModel, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
    return _pairs_at(model, sym, seq, np.arange(len(sym)))


def _pairs_at(model: PieceModel, sym: np.ndarray, seq: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.full(len(t), -1, np.int64)
    ok = np.flatnonzero(t + 1 < len(sym))
    ok = ok[seq[t[ok]] == seq[t[ok] + 1]]
    out[ok] = model.merged(sym[t[ok]], sym[t[ok] + 1])
    return out


def pre_tokens(model: PieceModel, text: str) -> list[str]:
    """Pre-tokens of a text; their counts add up to the text's.

    Where every space starts a new pre-token, the mark is left out here and
    put back by :func:`merge_counts`; runs of marks stay with the word behind.
    """
    if not text:
        return []
    if model.plain and "  " not in text and SPACE not in text and text[0] != " ":
        return text.split(" ")
    marked = (SPACE if model.prefix else "") + text.replace(" ", SPACE)
    return [SPACE + w for w in (_RUNS.findall(marked) if model.cuts else [marked])]


_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


class _Counter:
    """Counts texts batch by batch; each batch's new pre-tokens are merged together."""

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def __call__(self, texts: list[str]) -> dict[str, object]:
        model = _model(self.path)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        parts = [pre_tokens(model, t) for t in texts]
        new = list(set().union(*parts) - known.keys())
        if new:
            known.update(zip(new, merge_counts(model, new).tolist(), strict=True))
        return {"n_bytes": [len(t) if t.isascii() else len(t.encode()) for t in texts],
                "n_tokens": [sum(map(known.__getitem__, words)) for words in parts]}


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, keep: tuple[str, ...] = ("doc_id",),
                 text: str = "text") -> DataFrame:
    """``keep`` columns plus n_bytes, n_tokens and over_limit (n_tokens > limit).

    One narrow pass: no shuffle, so a hot key or a group of copies has no
    effect; memory is one batch, the vocabulary and REMEMBERED pre-tokens.
    """
    out = map_texts(docs, _Counter(model_file), "n_bytes long, n_tokens long", keep, text)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
