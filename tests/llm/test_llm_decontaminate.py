"""Operator 4 against a brute-force search over every window."""

import random

from pyspark.sql import functions as F

from churnlab.llm import decontaminate as D


def brute(text, items, m=10):
    ws = D.words(text or "")
    hit, found = set(), set()
    for item, t in items:
        v = D.words(t or "")
        if item is None or not v:
            continue
        k = min(m, len(v))
        wins = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(ws) - k + 1):
            if tuple(ws[i:i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(ws), len(hit), sorted(found)


def search(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_items(d, b, **options).select("doc_id", "n_words", D.words_in().alias("n_hit"), "items").collect()
    return {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in rows}


def planted(seed=3):
    rnd = random.Random(seed)
    items = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(8, 18)))) for i in range(12)]
    items += [(100, "x y z"), (101, "Q"), (102, "..."), (103, None), (None, "a b"), (104, "x, Y! z"), (0, items[0][1])]
    docs = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    docs += [f"{docs[i]} {t.upper()}; {t}" for i, (_, t) in enumerate(items) if t]
    docs += [None, "", "...", "x y z x y z", "q", "é É q\x00x y-Z", "word " * 30_000 + "x y z"]
    return docs, items


def test_same_as_brute_force(spark):
    docs, items = planted()
    got = search(spark, docs, items)
    assert got == {i: brute(t, items) for i, t in enumerate(docs)}
    assert sum(bool(v[1]) for v in got.values()) > 10


def test_blocks_give_the_same(spark):
    docs, items = planted(5)
    assert search(spark, docs, items, block_windows=25) == search(spark, docs, items)


def test_empty_tables_and_drop(spark):
    d = spark.createDataFrame([(1, "k l m", "e"), (1, "k l m", "e"), (2, None, None), (3, "clean", "f")], "doc_id long, text string, items string")
    b = spark.createDataFrame([(7, "K L")], "item_id long, text string")
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert D.drop_contaminated(d, b.where(F.lit(False))).count() == 4
    assert D.find_items(d.where(F.lit(False)), b).count() == 0
