"""Operator 11: runs and collapsed texts against brute force, the query's contract, odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from churnlab.llm import periodic_runs
from churnlab.llm.periodic_runs import find_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, min_length=24, exponent=3):
    """All runs by trying every lag at every place."""
    n, found = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapse(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng):
    w = []
    for _ in range(rng.randint(0, 5)):
        kinds = rng.choice([1, 2, 3, 5, 30])
        part = [rng.randrange(kinds) for _ in range(rng.randint(1, 12))]
        w += part * rng.randint(1, 8) if rng.random() < .6 else [rng.randrange(kinds) for _ in range(rng.randint(0, 40))]
    return " ".join(map(str, w))


@pytest.mark.parametrize("min_length,exponent", [(24, 3), (6, 3), (3, 3), (10, 4), (1, 5)])
def test_equals_brute_force(min_length, exponent):
    rng = random.Random(min_length * 10 + exponent)
    for _ in range(150):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        got = periodic_runs._Runs(min_length, exponent)(texts)
        for text, runs, kept, n in zip(texts, got["runs"], got["collapsed"], got["n_words"], strict=True):
            w = text.split()
            want = brute(w, min_length, exponent)
            assert [tuple(r.values()) for r in runs] == want and kept == collapse(w, want) and n == len(w)


def test_result_does_not_depend_on_how_far_splitting_goes(monkeypatch):
    rng = random.Random(5)
    texts = [repetitive(rng) for _ in range(60)]
    whole = periodic_runs._Runs(6, 3)(texts)
    monkeypatch.setattr(periodic_runs, "WORK", 0)
    assert periodic_runs._Runs(6, 3)(texts) == whole


def test_splitting_leaves_no_rare_word():
    rng = np.random.default_rng(2)
    w = rng.integers(0, 40, 4000)
    ends = np.array([0, 1000, 4000])
    for s, e in periodic_runs.split(w, ends[:-1], ends[1:], 3, 24):
        assert e - s >= 24 and np.unique(w[s:e], return_counts=True)[1].min() >= 3
        assert e <= 1000 or s >= 1000


def test_long_text_is_one_pass():
    """300,000 words: a period of 50,000 inside other words of a small vocabulary."""
    rng = np.random.default_rng(1)
    w = np.concatenate([rng.integers(0, 500, 30_000), np.tile(rng.integers(0, 500, 50_000), 5), rng.integers(0, 500, 20_000)])
    runs = periodic_runs.runs_of(w.astype(np.int64), np.array([0, len(w)]))
    assert len(runs) == 1 and runs[0][2] == 50_000 and 250_000 <= runs[0][1] <= 250_004


def test_query_contract(spark):
    from conftest import SF001
    from churnlab.llm.queries import op11_periodic_run_detection
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = op11_periodic_run_detection(spark, SF001).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 5
    for r in rows:
        w = WORD.findall(texts[r.doc_id] or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute(w)
        assert r.n_runs == len(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(w, runs).encode()).hexdigest()


def test_odd_rows(spark):
    spam = "buy now " * 20
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", None), (None, spam, "x"), (4, spam, None), (4, spam, None),
            (5, "é\u00a0ü " * 30, "x"), (6, "a " * 23, "x"), (7, "a " * 24, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = find_runs(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].runs == [] and by[i].collapsed == "" and by[i].n_words == 0 for i in (1, 2, 3))
    assert [tuple(x) for x in by[4].runs] == [(0, 40, 2)] and by[4].collapsed == "buy now" == by[None].collapsed
    assert by[5].collapsed == "é\u00a0ü" and by[5].n_words == 30       # other white space is part of a word
    assert by[6].runs == [] and by[7].collapsed == "a"
    assert find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_runs(df, min_exponent=2)
