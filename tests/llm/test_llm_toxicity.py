"""Operator 7: windows lose nothing, fragments by brute force, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from churnlab.llm import toxicity as X


def test_windows_hold_every_word_once():
    rnd = random.Random(1)
    for _ in range(300):
        t = " ".join("".join(rnd.choice("abÉ.!") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 90)))
        joined = b"".join(X.windows(t)).decode().split()
        assert joined == X.words(t)
    assert max(map(len, X.windows("x" * 10_000))) < 4 * X.WINDOW


def test_fragments_by_brute_force():
    rnd = random.Random(2)
    for _ in range(500):
        w = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 14)))
        grams = {"".join(rnd.choice("ab^$") for _ in range(5)) for _ in range(12)}
        e = f"^{w}$"
        hits = [(i, i + 5) for i in range(len(e) - 4) if e[i:i + 5] in grams]
        runs = []
        for a, b in hits:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        assert X.fragments(w, grams) == [e[a:b].replace("^", " ").replace("$", " ") for a, b in runs]


def test_held_out_toxicity_and_contract(spark):
    from conftest import SF01
    from churnlab.llm.queries import op7_toxicity
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = op7_toxicity(spark, SF01).collect()
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.88


def test_odd_rows(spark):
    base = ["the cat sat on a mat and looked at the other cats", "rain fell over the quiet town all night long", "we walked home by the river"]
    rows = [(i, f"{base[i % 3]} {i}", 0) for i in range(0, 80)] + [(i, f"{base[i % 3]} you grobbler what a grobbler {i}", 1) for i in range(80, 160)]
    odd = [(1000, None), (1001, ""), (1002, "grobbler " * 20_000), (None, "you grobbler"), (1003, base[0]), (1003, base[0])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(i, t, None) for i, t in odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, 1), (None, 0), (5, None)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    got = X.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1002] > 0.3 and by[1003] < 0.3 and np.mean([(by[i] >= 0.3) == y for i, _, y in rows]) > 0.95
    none = docs.where(F.lit(False))
    assert X.score(none, model).count() == 0
    blank = X.fit(none, labels.where(F.lit(False)))
    assert {r.score for r in X.score(docs, blank).collect()} == {0.0}


def _wide(terms, per_term, seed=3):
    rnd = random.Random(seed)
    word = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    plain = [word("aeinrst", rnd.randint(3, 8)) for _ in range(300)]
    bad = [word("bcdfghjklmpquvwxyz", 9) for _ in range(terms)]
    say = lambda: [rnd.choice(plain) for _ in range(25)]
    toxic = [" ".join([*say(), t, *say()]) for t in bad for _ in range(per_term)]
    texts = toxic + [" ".join(say() + say()) for _ in toxic]
    return texts, np.array([1.0] * len(toxic) + [0.0] * len(toxic))


def test_wide_vocabulary_stands_out():
    texts, labels = _wide(30, 40)          # every term in 3.3 % of the toxic texts
    model = X.fit_texts(texts, labels, .1)
    new, truth = _wide(30, 40)
    assert len(model.toxic) > 30 * 9
    assert np.mean((model.score(new) >= .3) == truth) > .97
    many, labels = _wide(150, 40)          # more fragments than 1,024 bytes hold
    model = X.fit_texts(many, labels, .1)
    assert len(model.toxic) > 1300 and np.mean((model.score(many) >= .3) == labels) > .97


def test_windows_when_no_fragment_stands_out():
    texts, labels = _wide(300, 3)
    model = X.fit_texts(texts, labels, .1)
    assert not X.standing_out([t for t, y in zip(texts, labels, strict=True) if y], [t for t, y in zip(texts, labels, strict=True) if not y])
    score = model.score(texts)
    assert model.toxic and score[labels == 1].mean() > score[labels == 0].mean() + .2


def test_copies_are_counted_once():
    texts, labels = _wide(6, 20)
    assert len({X.copy_key(t) for t in texts}) == len(texts)
    copies = [texts[0] + " qqzzjjxxk"] * 40          # one toxic text forty times: its own word proves nothing
    model = X.fit_texts(texts + copies, np.append(labels, [1.0] * 40), .1)
    assert model.words and b"qqzzj" not in model.toxic


def test_differences_are_those_of_plain_dictionaries():
    import zstandard as z
    texts, labels = _wide(6, 20)
    model = X.fit_texts(texts, labels, .1)
    size = len(model.words) + len(model.toxic)
    again = model.ordinary * (size // len(model.ordinary) + 1)
    tails = (again[:size], model.words + model.toxic, again[:len(model.words)] + model.toxic)
    log = max(16, (len(model.ordinary) + size).bit_length())
    how = z.ZstdCompressionParameters(window_log=log + 1, hash_log=log, chain_log=log, search_log=6, min_match=5, target_length=64,
                                      strategy=z.STRATEGY_LAZY2, write_checksum=False, write_content_size=False, write_dict_id=False)

    def length(w, tail):
        d = z.ZstdCompressionDict(model.ordinary + tail, dict_type=z.DICT_TYPE_RAWCONTENT)
        return len(z.ZstdCompressor(dict_data=d, compression_params=how).compress(w + model.ordinary[:X.TAIL]))

    for t in [*texts[:4], *texts[-4:], ""]:
        want = [[length(w, tails[0]) - length(w, tail) for w in X.windows(t)] for tail in tails[1:]]
        assert model.differences(t).tolist() == want


def test_gram_counts_by_brute_force(spark):
    texts, labels = _wide(6, 20)
    rows = [(i % X.FOLDS, int(y), i % 5 > 0, t) for i, (t, y) in enumerate(zip(texts, labels, strict=True))]
    ev = X._evidence(spark.createDataFrame(rows, "fold int, label int, lead boolean, text string"))
    for fold in (-1, 0, 3):
        own = [[t for f, y, lead, t in rows if lead and y == k and f != fold] for k in (1, 0)]
        assert ev.grams_without(fold) == X.standing_out(*own)
    assert sum(ev.texts.values()) == len(rows) and sum(ev.leads.values()) == sum(r[2] for r in rows)


def test_recall_and_false_alarms_apart(spark):
    """Of 120 held-out toxic and 870 other documents of sf0.1: 82 % found, 3.6 % flagged when written."""
    from conftest import SF01
    from churnlab.llm.queries import op7_toxicity
    big = SF01.replace("sf0.01", "sf0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect() if r.toxic is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in op7_toxicity(spark, big).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([p for p, y in held if y == 1]) > .75
    assert np.mean([p for p, y in held if y == 0]) < .05
