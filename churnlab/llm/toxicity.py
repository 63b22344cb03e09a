"""Operator 7 - toxicity by compression distance.

zstandard dictionaries are trained apart on ordinary and on toxic text: the ordinary one on
windows of ordinary texts that hold nothing of what follows, the toxic one on the words of toxic texts that hold a fragment
standing out - a run of character 5- and 8-grams inside a word whose document frequency in toxic
texts is above that in ordinary ones beyond chance, however rare it is (near copies among the
labelled texts are counted once: what they share by being copies proves nothing).  All such fragments
follow it, and stand alone in a second toxic dictionary.  If nothing stands out, toxic windows
train the toxic dictionary.  Every whole text is cut at word ends into windows of about
``window`` characters; each is compressed with the ordinary dictionary (its beginning repeated
at the end) and with either toxic one behind it.  All have the same size, the ordinary part
lies at the same distance, and the match search is set explicitly, so lengths differ only where
toxic text is matched.  Maxima, means, counts and shares of the differences become a
probability by a logistic curve.

Learning is cross-fitted: the labelled texts fall into ``FOLDS`` parts by a hash of the id, the
curve is fitted on rows measured with dictionaries that the other parts trained, and the
dictionaries for scoring come from all parts.  It uses at most about ``per_class`` labelled
documents of either class and of at most ``max_chars`` characters, taken by a hash of the id.
Their texts stay in Spark: the driver gets counts of grams, the toxic words that stand out, at
most 39,000 windows of either class and the rows of the curve.  Scoring is one narrow pass over
whole texts.

Cases: null and empty texts are one empty window; without labels of both classes in the sample,
or with one class in a single part only, every score is the share of label 1 among the labels
(0 with none); of several texts under one id the smallest is learnt from; repeated rows get
equal scores.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from churnlab.llm.common import labelled_sample, map_texts, slices, stage

PER_CLASS = 2_400
MAX_CHARS = 1 << 16
WINDOW = 80
#: A fragment's least log ratio, and how many grams are expected to stand out by chance.
LEAST = 1.5
BY_CHANCE = 1.0
#: Parts of the labelled texts that take turns in training dictionaries and fitting the curve.
FOLDS = 8
#: Bytes of a dictionary trained on windows, and of one trained on words that stand out.
TRAINED = 1 << 15
TRAINED_WORDS = 1 << 13
#: Windows of a class that train a dictionary, about.
SAMPLES = 30_000
#: Characters of the grams that are counted.
GRAMS = (5, 8)
GRAM = min(GRAMS)
#: Bytes of the ordinary dictionary behind every window: zstandard looks for no match in a
#: block's last bytes, and a block that saves next to nothing is stored raw.
TAIL = 64
_EDGE = ".,!?;:|#*$%&\"'()"


def words(text: str) -> list[str]:
    return [x for w in text.lower().split() if (x := w.strip(_EDGE))]


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Words strung together with spaces, cut behind the word that reaches ``size``; a very long word is cut too."""
    out: list[bytes] = []
    cur: list[str] = []
    n = 0
    for w in words(text):
        if len(w) > 4 * size:
            parts = [w[i:i + size] for i in range(0, len(w), size - GRAM)]
        else:
            parts = [w]
        for p in parts:
            cur.append(p)
            n += len(p) + 1
            if n >= size:
                out.append(f" {' '.join(cur)} ".encode("utf-8", "replace"))
                cur, n = [], 0
    if cur or not out:
        out.append(f" {' '.join(cur)} ".encode("utf-8", "replace"))
    return out


def _grams(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(words(text)):
        w = f"^{w}$"
        for n in GRAMS:
            out.update(w[i:i + n] for i in range(len(w) - n + 1))
    return out


def copy_key(text: str) -> tuple[int, int]:
    """Two least hashes of the pairs of adjacent words: the same for most near copies, hardly ever for others."""
    ws = words(text)
    pairs = {f"{a} {b}".encode("utf-8", "replace") for a, b in zip(ws, ws[1:])} or {text.encode("utf-8", "replace")}
    return min(zlib.crc32(w) for w in pairs), min(zlib.adler32(w[::-1]) ^ zlib.crc32(w[::-1]) for w in pairs)


def _tail(k: int, b: int, share: float) -> float:
    """Chance that ``k`` or more of ``k + b`` texts are toxic if each is with probability ``share``."""
    n = k + b
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
                        + j * math.log(share) + (n - j) * math.log1p(-share)) for j in range(k, n + 1))


def beyond_chance(a: dict[str, int], b: dict[str, int], n: int, m: int, least: float = LEAST,
                  by_chance: float = BY_CHANCE, tested: int | None = None) -> set[str]:
    """Grams of 3 toxic texts or more whose log ratio of document frequencies reaches ``least`` beyond chance.

    ``a`` and ``b`` count the toxic and ordinary texts that hold each gram, of ``n`` and ``m``; ``tested`` is the
    number of grams in 3 toxic texts or more where ``a`` doesn't hold them all.
    """
    often = {g: k for g, k in a.items() if k >= 3}
    tested = len(often) if tested is None else tested
    return {g for g, k in often.items()
            if math.log((k + .5) / (n + 1)) - math.log((b.get(g, 0) + .5) / (m + 1)) > least
            and _tail(k, b.get(g, 0), n / (n + m)) * tested < by_chance}


def standing_out(toxic: list[str], ordinary: list[str], least: float = LEAST, by_chance: float = BY_CHANCE) -> set[str]:
    a, b = Counter(), Counter()
    for texts, c in ((toxic, a), (ordinary, b)):
        for t in texts:
            c.update(_grams(t))
    return beyond_chance(a, b, len(toxic), len(ordinary), least, by_chance)


def spans(word: str, grams: set[str]) -> list[str]:
    """Runs of the given grams inside a word; a word's edges are ``^`` and ``$``."""
    w = f"^{word}$"
    out: list[list[int]] = []
    for i in range(len(w) - GRAM + 1):
        for n in reversed(GRAMS):
            if i + n <= len(w) and w[i:i + n] in grams:
                if out and i <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], i + n)
                else:
                    out.append([i, i + n])
                break
    return [w[a:b] for a, b in out]


def words_with(text: str, grams: set[str]) -> list[str]:
    """The words of a text that hold a given gram, in order."""
    return [w for w in words(text) if spans(w, grams)]


def fragments(text: str, grams: set[str]) -> list[str]:
    """Runs of the given grams inside the words of a text; a word's edge is a space."""
    return [r.replace("^", " ").replace("$", " ") for w in words(text) for r in spans(w, grams)]


def commonest(samples: list[bytes], size: int | None = None) -> bytes:
    """Dictionary content from short samples: the distinct ones, the commonest last (nearest to the text).

    All of them without a ``size``.  zstandard's own trainer is made for longer samples and drops most of these.
    """
    out = b""
    for s, _ in sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0])):
        if s not in out:
            out = s + out
        if size is not None and len(out) >= size:
            return out[-size:]
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary that zstandard trains on the samples, without its header tables."""
    import zstandard

    try:
        whole = zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:      # too few samples
        return commonest(samples, size)
    return whole[_header(whole):]


def _header(whole: bytes) -> int:
    """Where a trained dictionary's content begins: behind its three repeat offsets, the last tables before it."""
    at = whole.find((1).to_bytes(4, "little") + (4).to_bytes(4, "little") + (8).to_bytes(4, "little"))
    return at + 12 if at >= 0 else min(len(whole), 256)


@dataclass
class ToxicityModel:
    """``words`` is trained content, ``toxic`` the fragments (or trained windows, ``words`` then being empty)."""

    share: float
    ordinary: bytes = b""
    toxic: bytes = b""
    words: bytes = b""
    weights: np.ndarray | None = None
    middle: np.ndarray | None = None
    spread: np.ndarray | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_ready"}

    def _compressors(self):
        """Compressors with the ordinary, the trained toxic and the fragment dictionary, all of one size."""
        if "_ready" not in self.__dict__:
            import zstandard as z

            size = len(self.words) + len(self.toxic)
            again = (self.ordinary * (size // max(1, len(self.ordinary)) + 1))[:size]
            tails = [again, self.words + self.toxic]
            if self.words:
                tails.append(again[:len(self.words)] + self.toxic)
            # both dictionaries and a window stay in reach, whatever the toxic one's size
            log = max(16, (len(self.ordinary) + size).bit_length())
            how = z.ZstdCompressionParameters(window_log=log + 1, hash_log=log, chain_log=log, search_log=6, min_match=5,
                                              target_length=64, strategy=z.STRATEGY_LAZY2, write_checksum=False,
                                              write_content_size=False, write_dict_id=False)
            made = []
            for tail in tails:
                d = z.ZstdCompressionDict(self.ordinary + tail, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                made.append(z.ZstdCompressor(dict_data=d, compression_params=how).compress)
            self._ready = made
        return self._ready

    def differences(self, text: str) -> np.ndarray:
        """Bytes saved in each window by the trained toxic dictionary (row 0) and by the fragments (row 1)."""
        plain, *toxic = self._compressors()
        end = self.ordinary[:TAIL]
        saved = []
        for w in windows(text):
            w += end
            n = len(plain(w))
            saved.append([n - len(c(w)) for c in toxic])
        out = np.array(saved, float).T
        return out if len(out) == 2 else np.repeat(out, 2, axis=0)

    def row(self, text: str) -> list[float]:
        both = self.differences(text)
        n = both.shape[1]
        out = [math.log1p(n), float(min(n, 4))]
        for d in both:
            top = np.sort(d)[-max(3, n // 8):]
            at = {k: float((d >= k).sum()) for k in (1, 2, 3, 5)}
            out += [min(top[-1], 10.0), min(top[-3:].sum(), 30.0), float(np.clip(d, -1, 8).mean()),
                    at[1] / n, at[2] / n, at[3] / n, math.sqrt(at[3] / n), math.sqrt(at[5] / n),
                    math.log1p(at[3]), math.log1p(at[5]), math.log1p(np.clip(d - 1, 0, 6).sum()),
                    float(top[-max(1, -(-n // 8)):].mean()), float(np.clip(d, 0, 9).sum()) / math.sqrt(n + 5)]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = (np.array([self.row(t) for t in texts]) - self.middle) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _logistic_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    a = np.c_[x, np.ones(len(x))]
    b = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], 1e-2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (w * (p - y)) + ridge * b
        h = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        b = b - np.linalg.solve(h, g)
    return b


@dataclass
class Evidence:
    """What the dictionaries are trained from, by fold."""

    texts: dict[tuple[int, int], int]                      # (fold, label): texts
    leads: dict[tuple[int, int], int]                      # (fold, label): texts, near copies once
    grams: dict[tuple[int, int], dict[str, int]]           # (fold, label): of these, texts holding each gram
    words: list[tuple[int, list[str]]]                     # a toxic text's fold and words with a gram that may stand out
    windows: list[tuple[int, int, bytes]]                  # fold, label, window
    tested: dict[int, int] | None = None                   # without this fold: grams in 3 toxic texts or more

    def grams_without(self, fold: int) -> set[str]:
        """Grams that stand out in all parts but ``fold``."""
        n, counted = [0, 0], [Counter(), Counter()]
        for (f, y), k in self.leads.items():
            if f != fold:
                n[y] += k
                counted[y].update(self.grams.get((f, y), {}))
        return beyond_chance(counted[1], counted[0], n[1], n[0], tested=self.tested and self.tested[fold]) if min(n) else set()

    def dictionaries(self, share: float, fold: int = -1) -> ToxicityModel:
        """A model without curve from all parts but ``fold``."""
        grams = self.grams_without(fold)
        found = [w for f, ws in self.words if f != fold for w in [words_with(" ".join(ws), grams)] if w]
        # what stands out must not be hidden by the ordinary dictionary
        plain = [w for w in self._windows(0, fold) if not words_with(w.decode("utf-8", "replace"), grams)]
        model = ToxicityModel(share, trained(plain, TRAINED))
        if found:
            model.words = trained([f" {' '.join(ws)} ".encode("utf-8", "replace") for ws in found], TRAINED_WORDS)
            model.toxic = commonest([x.encode("utf-8", "replace") for ws in found for x in fragments(" ".join(ws), grams)])
        else:
            model.toxic = trained(self._windows(1, fold), TRAINED)
        return model

    def _windows(self, label: int, fold: int) -> list[bytes]:
        """In the order of a hash: the trainer takes stretches of its samples in turn."""
        return sorted((w for f, y, w in self.windows if y == label and f != fold), key=lambda w: (zlib.crc32(w[::-1]), w))

    def teachable(self) -> bool:
        """Both classes are in two parts or more."""
        return all(sum(n > 0 for (_, y), n in self.texts.items() if y == label) > 1 for label in (0, 1))


def _take(window: bytes, share: float) -> bool:
    """About ``share`` of the windows, by a hash."""
    return zlib.crc32(window) < share * (1 << 32)


def with_curve(model: ToxicityModel, x: np.ndarray, y: np.ndarray) -> ToxicityModel:
    """Fit the logistic curve on measured rows, the classes weighted to ``model.share``."""
    model.middle, model.spread = x.mean(0), x.std(0) + 1e-6
    w = np.where(y == 1, model.share / max(1, (y == 1).sum()), (1 - model.share) / max(1, (y == 0).sum())) * len(y)
    model.weights = _logistic_fit((x - model.middle) / model.spread, y, w)
    return model


def fit_texts(texts: list[str], labels: np.ndarray, share: float, seed: int = 5) -> ToxicityModel:
    """The model of a list of texts, in memory; parts are dealt at random."""
    folds = (np.random.default_rng(seed).permutation(len(texts)) % FOLDS).tolist()
    seen: set = set()
    rows = []
    for f, y, t in zip(folds, (int(y) for y in labels), texts, strict=True):
        key = (y, *copy_key(t))
        rows.append((f, y, key not in seen, t))
        seen.add(key)
    grams: dict = {}
    for f, y, lead, t in rows:
        if lead:
            grams.setdefault((f, y), Counter()).update(_grams(t))
    cut = [(f, y, w) for f, y, _, t in rows for w in windows(t)]
    part = {y: SAMPLES / max(1, sum(k == y for _, k, _ in cut)) for y in (0, 1)}
    ev = Evidence(Counter((f, y) for f, y, _, _ in rows), Counter((f, y) for f, y, lead, _ in rows if lead), grams, [],
                  [c for c in cut if _take(c[2], part[c[1]])])
    if not ev.teachable():
        return ToxicityModel(share)
    every = set().union(*(ev.grams_without(f) for f in range(-1, FOLDS)))
    ev.words = [(f, words_with(t, every)) for f, y, lead, t in rows if y and lead]
    parts = [ev.dictionaries(share, f) for f in range(FOLDS)]
    x = np.array([parts[f].row(t) for f, _, _, t in rows])
    return with_curve(ev.dictionaries(share), x, np.array([y for _, y, _, _ in rows], float))


#: Columns of the labelled sample; ``lead`` is true for one of each group of near copies.
SAMPLE = ("fold", "label", "lead", "text")


def _emit(df: DataFrame, make: Callable[[Iterable], Iterable[tuple]], schema: str) -> DataFrame:
    """``make((fold, label, lead, text), ...) -> tuples of the schema's columns``, batch by batch."""
    fields = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(fields)
        for b in slices(batches):
            got = list(make(zip(*(b.column(c).to_pylist() for c in SAMPLE), strict=True)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), arrow, strict=True)],
                                                 schema=arrow)

    return df.select(*SAMPLE).mapInArrow(run, fields)


def _count(rows: Iterable) -> Iterable[tuple]:
    """Leads that hold each gram, by fold and label; "" counts leads, " " windows and "  " texts."""
    out: Counter = Counter()
    for f, y, lead, t in rows:
        if lead:
            out.update((f, y, g) for g in _grams(t))
            out[f, y, ""] += 1
        out[f, y, " "] += len(windows(t))
        out[f, y, "  "] += 1
    return ((*k, n) for k, n in out.items())


def _evidence(rows: DataFrame) -> Evidence:
    """Counts, words and windows of the staged sample; texts stay where they are."""
    at = {(f, y): f"n{f}_{y}" for f in range(FOLDS) for y in (0, 1)}
    wide = stage(_emit(rows, _count, "fold int, label int, gram string, n long").groupBy("gram").agg(*[
        F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("label") == y), F.col("n"))), F.lit(0)).alias(c)
        for (f, y), c in at.items()]), "toxic-grams")
    sums = {r["gram"]: r for r in wide.where(F.col("gram").isin("", " ", "  ")).collect()}
    if not sums:
        return Evidence({}, {}, {}, [], [])
    leads = {k: sums[""][c] for k, c in at.items()}
    texts = {k: sums["  "][c] for k, c in at.items()}
    cut = {y: sum(sums[" "][c] for (_, k), c in at.items() if k == y) for y in (0, 1)}
    ev = Evidence(texts, leads, {k: {} for k in at}, [], [])
    if not ev.teachable():
        return ev
    # only grams whose ratio may stand out leave Spark; how many were tested is counted there
    often, may = {}, F.lit(False)
    for fold in range(-1, FOLDS):
        k, b = (sum((F.col(c) for (f, y), c in at.items() if y == label and f != fold), F.lit(0)) for label in (1, 0))
        n, m = (sum(v for (f, y), v in leads.items() if y == label and f != fold) for label in (1, 0))
        often[fold] = k >= 3
        may = may | (often[fold] & (F.log((k + .5) / (n + 1)) - F.log((b + .5) / (m + 1)) > LEAST - 1e-9))
    grams = wide.where(~F.col("gram").isin("", " ", "  "))
    ev.tested = {int(f): n for f, n in grams.agg(*[F.count_if(c).alias(str(f)) for f, c in often.items()]).first().asDict().items()}
    for r in grams.where(may).collect():
        for k, c in at.items():
            if r[c]:
                ev.grams[k][r["gram"]] = r[c]
    every = set().union(*(ev.grams_without(f) for f in range(-1, FOLDS)))
    part = {y: SAMPLES / max(1, cut[y]) for y in (0, 1)}

    def found(got: Iterable) -> Iterable[tuple]:
        for f, y, lead, t in got:
            if y and lead:
                ws = words_with(t, every)
                if ws:
                    yield f, y, " ".join(ws), None
            for w in windows(t):
                if _take(w, part[y]):
                    yield f, y, None, w

    out = stage(_emit(rows, found, "fold int, label int, words string, cut binary"), "toxic-evidence")
    ev.words = sorted((r["fold"], r["words"].split(" ")) for r in out.where(F.col("words").isNotNull()).collect())
    for y in (0, 1):
        ev.windows += sorted((r["fold"], y, bytes(r["cut"])) for r in out.where(F.col("cut").isNotNull() & (F.col("label") == y))
                             .limit(int(1.3 * SAMPLES)).collect())
    return ev


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS,
        max_chars: int = MAX_CHARS) -> ToxicityModel:
    sample, counts = labelled_sample(labels.select("doc_id", label), label, per_class)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    known = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_chars)
             .join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))

    def keys(texts: list[str]) -> dict[str, object]:
        got = [copy_key(t) for t in texts]
        return {"k1": [k for k, _ in got], "k2": [k for _, k in got]}

    known = stage(map_texts(known, keys, "k1 long, k2 long", ("doc_id", "label", "text")), "toxic-known")
    leads = known.groupBy("label", "k1", "k2").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("lead"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = stage(known.join(leads, "doc_id", "left").select(fold.alias("fold"), "label", F.coalesce("lead", F.lit(False)).alias("lead"),
                                                            "text"), "toxic-sample")
    ev = _evidence(rows)
    if not ev.teachable():
        return ToxicityModel(share)
    parts = [ev.dictionaries(share, f) for f in range(FOLDS)]
    measured = _emit(rows, lambda got: ((y, parts[f].row(t)) for f, y, _, t in got), "label int, x array<double>").collect()
    measured.sort(key=lambda r: (r["label"], r["x"]))
    return with_curve(ev.dictionaries(share), np.array([r["x"] for r in measured]), np.array([r["label"] for r in measured], float))


class _Score:
    def __init__(self, model: ToxicityModel):
        self.model = model

    def __call__(self, texts: list[str]) -> dict[str, object]:
        return {"score": self.model.score(texts)}


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and score (0 to 1, higher: toxic likelier)."""
    return map_texts(docs, _Score(model), "score double", keep, text)
