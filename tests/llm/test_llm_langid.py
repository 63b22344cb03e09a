"""Operator 10: held-out accuracy, the machines' optimum, defined results for odd rows."""

import numpy as np
from pyspark.sql import functions as F

from churnlab.llm import langid


def test_held_out_accuracy_and_query_contract(spark):
    from conftest import SF01
    from churnlab.llm.queries import op10_language_id
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = op10_language_id(spark, SF01).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_machine_reaches_the_optimum():
    """Plain gradient descent on the same objective does not get lower."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 5))
    y = np.where(x[:, 0] + .3 * rng.normal(size=80) > 0, 1.0, -1.0)
    share = np.where(y > 0, .5 / (y > 0).sum(), .5 / (y < 0).sum()) * len(y)
    a = np.c_[x, np.ones(80)]

    def loss(w):
        return .5 * w @ w + 1.0 * (share * np.maximum(0, 1 - y * (a @ w)) ** 2).sum()

    w = np.zeros(6)
    for _ in range(20_000):
        w -= 1e-3 * (w - 2 * ((share * y * np.maximum(0, 1 - y * (a @ w)))[:, None] * a).sum(0))
    assert loss(langid.train_machine(x, y, cost=1.0, rounds=200)) <= loss(w) * 1.001


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_odd_rows(spark):
    words = {"en": "the and of that with", "de": "der und nicht sch ein", "fr": "le est pour des eau", "xx": "zzq qqz zqz"}
    rows = [(i * 4 + k, f"{w} {w}", lang, "clash") for i in range(12) for k, (lang, w) in enumerate(words.items())]
    odd = [(1000, None, "en", None), (1001, "", "en", None), (1002, "12 !? \n", "de", None), (None, "the and of", None, None),
           (1003, "der und " * 20_000, None, None), (1003, "der und " * 20_000, None, None)]
    df = frame(spark, rows + odd)
    got = langid.identify(df, langid.fit(df)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "en" and by[1003].lang_pred == "de"
    assert all(by[i].lang_pred == lang for i, _, lang, _ in rows)
    one = langid.fit(df.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.identify(df, one).collect()} == {"fr", "und"}
    none = df.where(F.lit(False))
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


def test_many_languages_send_only_weights_to_the_driver(spark):
    """40 made-up languages: machines are planned from names alone, rows stay in the tasks."""
    import resource
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    codes = [c for codes in langid.FAMILIES.values() for c in codes][:32] + [f"x{i}" for i in range(8)]
    tables = {c: ["".join(rng.choice(letters, rng.integers(2, 7))) for _ in range(25)] for c in codes}
    rows = [(i, " ".join(rng.choice(tables[c], 30)), c, None) for i, c in enumerate(codes * 24)]
    df = frame(spark, rows)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    model = langid.fit(df)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 100
    plan = langid.plan_machines(set(codes))
    assert len(plan.sides) == len(model.weights) and len(model.names) == 40
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert np.mean([got[i] == c for i, _, c, _ in rows]) > 0.97


def test_sparse_training_equals_dense():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 12)) * (rng.random((60, 12)) < .4)
    y = np.where(x[:, 0] + x[:, 1] > 0, 1.0, -1.0)
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]
    assert np.allclose(langid.train_sparse(rows, y, 12), langid.train_machine(x, y), atol=1e-9)


def brute_vote(model, x):
    """Family by the largest margin, then the pair votes of its languages, one text at a time."""
    m = model.weights[:, :-1] @ x + model.weights[:, -1]
    best = model.families[int(np.argmax([m[r] for r in model.family_rows]))] if len(model.families) > 1 else model.families[0]
    votes = {}
    for k, a in enumerate(model.names):
        if langid.family(a) == best:
            won = 0.0
            for (p, q), r in model.pair_rows.items():
                if k in (p, q):
                    side = m[r] if k == p else -m[r]
                    won += (side > 0 if k == p else side >= 0) + 1e-3 * np.tanh(side)
            votes[a] = won
    return max(votes, key=votes.get)


def test_vote_equals_a_plain_one(spark):
    from conftest import SF001
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = langid.fit(docs)
    texts = [r.text for r in docs.where("text is not null").limit(150).collect()]
    x = np.array([langid.profile(t) for t in texts])
    names, p = model.predict(x)
    some = x.any(1)
    assert [a for a, s in zip(names, some) if s] == [brute_vote(model, v) for v, s in zip(x, some) if s]
    assert ((p >= 0) & (p <= 1)).all()
