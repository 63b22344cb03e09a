"""Operator 10 - language identification in two steps.

A text becomes the relative frequencies of its hashed character 1- to
3-grams (letters lower-cased, everything else a gap).  Linear support vector
machines decide first between language families (one against the rest), then
between the languages of the predicted family (one against one: each pair
votes, margins break ties).  All machines share one weight matrix, so a batch
is scored by one product.

``FAMILIES`` names the family of well-known codes; any other learned value is
a family of its own.  Training takes at most about ``per_language`` documents
of each language by a hash of the id, as sparse rows.  Each machine is trained
in a task of its own by dual coordinate descent, from the rows of its two sides:
at most about ``per_side`` a side, the same number of each language in it.  Only
the machines' weights reach the driver (32 kB each), never rows or texts.
Scoring is one narrow pass over whole texts.

score is the logistic of the deciding margins, scaled on the training rows.
Cases: null texts and texts without a letter are ``und`` with score 0; with
one learned language every other text has that language and score 1; with
none every text is ``und``; repeated rows get equal answers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from churnlab.llm.common import by_hash, held_out, map_texts, stage
from churnlab.llm.ngram_join import sorted_groups

# Families of language codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

DIM = 1 << 13
PER_LANGUAGE = 1_200
#: Rows on each side of a machine, about; at most as many of each language as ``PER_LANGUAGE``.
PER_SIDE = 6_000
_LETTER = re.compile(r"[^\W\d_]")


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"only {lang}")


def profile(text: str) -> np.ndarray:
    """Frequencies of hashed 1- to 3-grams, scaled to length 1; zeros without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = points.astype(np.int64)
    letter = (c >= 97) & (c <= 122) | (c >= 0xC0) & (c != 0xD7) & (c != 0xF7) & ((c < 0x2000) | (c > 0x2BFF))
    c[~letter] = 0
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)       # runs of gaps count once
    c = np.r_[0, c[keep], 0]
    two = c[1:] * 0x1F351 + c[:-1]
    grams = np.concatenate([c[c > 0], two, two[1:] * 0x2C1B3C6D + c[:-2]]) & 0xFFFFFFFF
    x = np.bincount(((grams * 0x9E3779B1) & 0xFFFFFFFF) >> 19, minlength=DIM).astype(np.float32)
    x = np.sqrt(x)
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def train_sparse(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last for a constant 1) of a linear machine with squared hinge loss, y in {-1, 1}.

    ``rows`` hold places and values.  Dual coordinate descent over rows in a fixed shuffled order.
    """
    rng = np.random.default_rng(17)
    share = np.where(y > 0, .5 / max(1, (y > 0).sum()), .5 / max(1, (y < 0).sum())) * len(y)
    w, alpha = np.zeros(dim + 1), np.zeros(len(y))
    diag = .5 / (cost * share)
    norm = np.array([float(v @ v) for _, v in rows]) + 1 + diag
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            at, v = rows[i]
            g = y[i] * (v @ w[at] + w[-1]) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def train_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """The same from dense rows."""
    return train_sparse([(np.arange(x.shape[1]), r) for r in x], y, x.shape[1], cost, rounds)


@dataclass
class Languages:
    names: list[str]
    families: list[str]
    weights: np.ndarray                 # one row per machine
    family_rows: list[int]              # machine of each family
    pair_rows: dict[tuple[int, int], int]  # machine of each pair of languages of one family
    scale: float = 4.0

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        m = x @ self.weights[:, :-1].T + self.weights[:, -1]
        kin = np.array([self.families.index(family(a)) for a in self.names])
        if len(self.families) > 1:
            f = m[:, self.family_rows]
            best = f.argmax(1)
            rest = f.copy()
            rest[np.arange(n), best] = -np.inf
            sure = (f[np.arange(n), best] - rest.max(1)) / 2
        else:
            best, sure = np.zeros(n, np.int64), np.full(n, np.inf)
        votes = np.where(kin[None] == best[:, None], 0.0, -np.inf)
        least = np.full((n, len(self.names)), np.inf)
        for (a, b), row in self.pair_rows.items():
            mine = best == kin[a]
            votes[mine, a] += (m[mine, row] > 0) + 1e-3 * np.tanh(m[mine, row])
            votes[mine, b] += (m[mine, row] <= 0) - 1e-3 * np.tanh(m[mine, row])
            least[:, a] = np.minimum(least[:, a], m[:, row])
            least[:, b] = np.minimum(least[:, b], -m[:, row])
        pick = votes.argmax(1)
        p = _logistic(self.scale * sure) * _logistic(self.scale * least[np.arange(n), pick])
        return [self.names[k] for k in pick], p


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Plan:
    """The machines to train: the languages on each side of every machine."""
    names: list[str]
    families: list[str]
    sides: list[tuple[list[str], list[str]]]
    family_rows: list[int]
    pair_rows: dict[tuple[int, int], int]


def plan_machines(langs: set[str]) -> Plan:
    names = sorted(langs)
    families = sorted({family(a) for a in names})
    sides: list[tuple[list[str], list[str]]] = []
    family_rows, pair_rows = [], {}
    if len(families) > 1:
        for k in families:
            family_rows.append(len(sides))
            sides.append(([a for a in names if family(a) == k], [a for a in names if family(a) != k]))
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            if family(names[a]) == family(names[b]):
                pair_rows[a, b] = len(sides)
                sides.append(([names[a]], [names[b]]))
    return Plan(names, families, sides, family_rows, pair_rows)


class _Profiles:
    """Sparse profiles: places and half-precision values."""

    def __call__(self, texts: list[str]) -> dict[str, object]:
        at, values = [], []
        for t in texts:
            x = profile(t)
            some = np.flatnonzero(x)
            at.append(some.astype("<u2").tobytes())
            values.append(x[some].astype("<f2").tobytes())
        return {"at": at, "value": values}


_WEIGHTS = StructType().add("machine", "long").add("weights", "binary")


def _train(t: pa.Table) -> tuple[list, list]:
    rows = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(v, "<f2").astype(np.float64))
            for a, v in zip(t.column("at").to_pylist(), t.column("value").to_pylist(), strict=True)]
    order = np.argsort([xxhash.xxh3_64_intdigest(a.tobytes() + v.tobytes()) for a, v in rows], kind="stable")  # whatever the order of arrival
    w = train_sparse([rows[i] for i in order], t.column("y").to_numpy()[order], DIM)
    return [t.column("machine")[0].as_py()], [w.astype("<f4").tobytes()]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, per_side: int = PER_SIDE) -> Languages | None:
    """Machines for the values of ``lang``; rows held out and rows without a letter teach nothing."""
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    taken = by_hash(rows, counts, "lang", per_language).withColumn("draw", F.pmod(F.xxhash64(F.lit("side"), "doc_id"), F.lit(1 << 20)))
    known = stage(map_texts(taken, _Profiles(), "at binary, value binary", ("lang", "draw")).where(F.length("at") > 0), "profiles")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    plan = plan_machines(set(counts))
    # a row per machine, side and language, with the share of the language's rows that the side takes
    uses = [(a, m, float(y), int((1 << 20) * min(1.0, per_side / len(side) / counts[a])) + 1)
            for m, two in enumerate(plan.sides) for y, side in zip((1, -1), two, strict=True) for a in side]
    weights = np.zeros((len(plan.sides), DIM + 1), np.float32)
    if uses:
        spark = docs.sparkSession
        dealt = spark.createDataFrame(uses, "lang string, machine long, y double, below int")
        examples = (known.join(dealt, "lang").where(F.col("draw") < F.col("below"))
                    .select("machine", "y", "at", "value"))
        for r in sorted_groups(examples, ("machine",), _train, _WEIGHTS).collect():
            weights[r["machine"]] = np.frombuffer(r["weights"], "<f4")
    return Languages(plan.names, plan.families, weights, plan.family_rows, plan.pair_rows)


class _Identify:
    def __init__(self, model: Languages | None):
        self.model = model

    def __call__(self, texts: list[str]) -> dict[str, object]:
        known = [self.model is not None and _LETTER.search(t) is not None for t in texts]
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        at = [i for i, k in enumerate(known) if k]
        for s in range(0, len(at), 256):
            part = at[s:s + 256]
            names, p = self.model.predict(np.array([profile(texts[i]) for i in part]))
            for i, a in zip(part, names, strict=True):
                lang[i] = a
            score[part] = p
        return {"lang_pred": lang, "score": score}


def identify(docs: DataFrame, model: Languages | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score (0 to 1)."""
    return map_texts(docs, _Identify(model), "lang_pred string, score double", keep, text)
