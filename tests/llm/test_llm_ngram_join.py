"""Operator 1 against brute force over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from churnlab.llm import ngram_join as J
from churnlab.llm.decontaminate import words
from churnlab.llm.graph import components


def brute(rows, n=5, threshold=0.8):
    """{doc_id: (class, links)} from all pairs of whole shingle sets."""
    sets = {}
    for i, t in rows:
        w = words(t or "")
        k = min(n, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    ids = sorted(sets)
    link = {a: [b for b in ids if b != a and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])] for a in ids}
    out = {}
    for a in ids:
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[a] = (min(seen), len(link[a]))
    return out


def corpus(seed, dense=70):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    text = lambda n: [word() for _ in range(n)]
    passage = text(30)
    docs = [" ".join(text(rnd.randint(0, 120))) for _ in range(60)]
    docs += [" ".join(text(rnd.randint(0, 60)) + passage + text(rnd.randint(0, 60))) for _ in range(40)]
    for size, copies in ((200, dense), (150, 9), (60, 6), (6, 4)):
        base = text(size)
        for _ in range(copies):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(size)] = word()
            docs.append(" ".join(t))
    docs += [docs[0]] * 20 + [docs[-1].upper() + "!"] * 3 + ["a b", "A, b.", "c", None, "", "..."]
    rnd.shuffle(docs)
    return list(enumerate(docs))


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, class_id string")
    return {r.doc_id: (r.class_id, r.n_links) for r in J.near_classes(df, **options).collect()}


def test_same_as_all_pairs(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_small_leaves_make_dense_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 9)
    rows = corpus(2, dense=40)
    assert run(spark, rows, leaf=4, depth=3) == brute(rows)


def test_odd_tables(spark):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (None, None), (3, None), (4, "x " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in J.near_classes(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (2, 1, 1), (None, None, 0), (None, None, 0), (3, 3, 0), (4, 4, 0)], key=str)
    assert J.near_classes(df.where(F.lit(False))).count() == 0


def test_keep_one(spark):
    rows = corpus(3, dense=10)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(0, rows[0][1], "x"), (None, "q", None)], "doc_id long, text string, _rows string")
    kept = J.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*{c for c, _ in brute(rows).values()}, None], key=str)


def test_runs_reach_the_recall():
    """Simulated pairs at the threshold meet at the last level in at least the stated share."""
    rng = np.random.default_rng(0)
    depth, runs, met, pairs = 4, J.runs_for(.99, 4), 0, 150
    for k in range(pairs):
        sig = rng.integers(0, 2 ** 32, (2, J.TOKENS), dtype=np.uint32)
        same = rng.permutation(J.TOKENS)[:51] if k % 5 else rng.permutation(J.TOKENS)[:52]
        sig[1, same] = sig[0, same]
        nodes = set(J.mix(np.arange(1, runs + 1, dtype=np.uint64)).tolist())
        for _ in range(depth):
            nodes = {c for p in nodes for c in _shared(np.uint64(p), sig)}
        met += bool(nodes)
    assert met / pairs > .97


def _shared(path, sig):
    row, child = J._children(np.full(2, path), sig, .8)
    return set(child[row == 0].tolist()) & set(child[row == 1].tolist())


def test_overlaps_by_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (J.overlaps(sets, chunk=7) == np.array(want)).all()


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    lone = {a for a, b in edges if a == b}
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= lone


def near_copies(n, seed=3):
    """(rep, words): near copies of one text, most with a change of their own."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = f"x{i}{rnd.random()}"
        out.append(t)
    return out


def dense_rows(spark, n):
    shingle = J.Shingler()
    rows = [(7, i, 1 + i % 3, shingle([" ".join(t)])[0].tobytes()) for i, t in enumerate(near_copies(n))]
    return spark.createDataFrame(rows, "dense long, rep long, copies long, set binary")


def test_dense_groups_write_rows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 40)
    per_member = {}
    for n in (150, 600):
        rows = dense_rows(spark, n)
        found = J.compare_dense(rows, 0.8).collect()
        sets = [np.frombuffer(r.set, np.uint64) for r in rows.orderBy("rep").collect()]
        both = J.overlaps(sets)
        size = np.diag(both)
        link = both >= 0.8 * (size[:, None] + size[None] - both) - 1e-9
        np.fill_diagonal(link, False)
        want = link @ np.array([1 + i % 3 for i in range(n)])
        got = np.zeros(n, int)
        for r in found:
            got[r.rep] += r.links
        assert (got == want).all()
        label = {r.node: r.label for r in components(spark.createDataFrame(
            [(r.rep, r.root) for r in found], "a long, b long")).collect()}
        seen, todo = {0}, [0]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        assert {i for i, x in label.items() if x == 0} == seen
        per_member[n] = len(found) / n
    assert max(per_member.values()) <= 2.1      # in its block, in its strip, and few edges between blocks


def test_components_of_odd_edges(spark):
    def found(rows):
        return {r.node: r.label for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    star = [(i, 500) for i in range(1, 400)]
    assert found(star + [(5, 5), (900, 900), (None, 3), (3, None), (700, 600), (600, 700)]) == {
        **{i: 1 for i in [*range(1, 400), 500]}, 600: 600, 700: 600}
    assert found([]) == {}
