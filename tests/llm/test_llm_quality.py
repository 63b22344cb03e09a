"""Operators 6 and 8: brute-force counts, decoding and likelihood, held-out accuracy."""

import itertools
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from churnlab.llm import gam, line_crf

EDGE = [None, "", " \n ", "a", "a a a a a a", "x\n\nx\ny\nx \n", "é <b>|#*$%& 日本\x85z", "\x1ca b\x0bc\x0cd", "w " * 20_000, "|" * 9]


def brute_base(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    rep = {k for i, x in enumerate(tri) if tri.count(x) > 1 for k in (i, i + 1, i + 2)} if len(ws) < 500 else set(range(len(ws)))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(rep))


def test_base_counts():
    rnd = random.Random(1)
    texts = EDGE + ["".join(rnd.choice("ab \n|é") for _ in range(rnd.randint(0, 80))) for _ in range(800)]
    assert [line_crf.base_counts(t or "") for t in texts] == [brute_base(t) for t in texts]


def random_field(rng):
    return line_crf.LineField(rng.normal(size=(line_crf.N_VALUES, 2)), rng.normal(size=(2, 2)))


def path_score(field, emit, path):
    return sum(emit[i, k] for i, k in enumerate(path)) + sum(field.chain[a, b] for a, b in itertools.pairwise(path))


def test_decode_same_as_all_paths():
    rng = np.random.default_rng(0)
    field = random_field(rng)
    sizes = np.array([0, 1, 5, 0, 3, 7, 2])
    emit = rng.normal(size=(sizes.sum(), 2))
    got = np.split(field.decode(emit, sizes), np.cumsum(sizes)[:-1])
    for part, e in zip(got, np.split(emit, np.cumsum(sizes)[:-1]), strict=True):
        best = max((path_score(field, e, p) for p in itertools.product((0, 1), repeat=len(e))), default=0)
        assert np.isclose(path_score(field, e, part), best)


def test_training_learns_chains():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 12, 150)
    labels, values = [], []
    for n in sizes:
        k = int(rng.integers(2))
        for _ in range(n):
            k = k if rng.random() < .85 else 1 - k
            labels.append(k)
            values.append([k if rng.random() < .8 else 1 - k] + [0] * 9)
    values, labels = np.array(values), np.array(labels)
    field = line_crf.train(values, sizes, labels)
    assert (field.decode(field.emissions(values), sizes) == labels).mean() > .8
    assert field.chain[0, 0] + field.chain[1, 1] > field.chain[0, 1] + field.chain[1, 0] + 1


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score string, kept string")


def test_edge_rows(spark):
    df = frame(spark, [(i, t, "x", None) for i, t in enumerate(EDGE)] * 2 + [(None, "null id", None, None)])
    field = line_crf.fit(df)
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_crf.judge(df, field).collect()}
    assert got == {(i, *brute_base(t)) for i, t in enumerate(EDGE)} | {(None, *brute_base("null id"))}
    none = df.where(F.lit(False))
    assert line_crf.judge(none, line_crf.fit(none)).count() == 0
    labels = spark.createDataFrame([(0, 1, None), (3, 1, 0), (5, None, 1), (None, 0, 0), (4, 7, 1)], "doc_id long, quality int, toxic int")
    for model in (gam.fit(df, labels), gam.fit(none, labels.where(F.lit(False)))):
        scores = [r.score for r in gam.score(df, model).collect()]
        assert len(scores) == df.count() and all(0 <= s <= 1 for s in scores)
        kept = gam.keep_good(df, model, 0.0)
        assert kept.columns == df.columns and kept.count() == df.count()


def test_clean_prose_is_kept(spark):
    from conftest import SF01
    from churnlab.llm.queries import op8_quality_rules
    got = op8_quality_rules(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("NOT base_failed")
    rows = got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in rows}
    assert share[1] > 0.99 and share[0] < 0.3


def test_additive_model_finds_interactions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit_rows(x, y, np.ones(len(y)), rounds=20)
    assert (0, 1) in model.pairs and ((model.score(x) > .5) == y).mean() > .93
    y = (x[:, 2] > .3).astype(float)
    model = gam.fit_rows(x, y, np.ones(len(y)), rounds=40, n_pairs=0)
    assert ((model.score(x) > .5) == y).mean() > .97


def test_held_out_quality(spark):
    from conftest import SF01
    from churnlab.llm.queries import op6_quality_classifier
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = op6_quality_classifier(spark, SF01).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_capitals_of_whole_lines():
    def cap(t):
        return line_crf.line_features(t)[0][0][3]
    calm, loud = "quiet words here " * 40, "SHOUTING WORDS HERE " * 40
    assert cap(calm + loud * 4) == 2 and cap(loud[:400] + calm * 20) == 0
    assert cap("É" * 500) == 2 and cap("é" * 500) == 0 and cap("aBc") == 1


def test_line_frequency_over_the_whole_table(spark):
    rnd = random.Random(4)
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(9)) + "."
    footer, copied = "we hope that you enjoyed reading this page today.", prose()
    texts = ["\n".join([prose() for _ in range(4)] + [footer] * (i % 500 == 0)) for i in range(6000)] + [copied + "\n" + prose()] * 50
    df = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    hashes = line_crf.frequent_lines(df, len(texts))
    assert hashes.tolist() == [line_crf._hash(footer.encode())]      # 0.2 % of the texts; copies count once
    field = line_crf.fit(df, sample=len(texts))
    some = df.where("doc_id % 500 = 0 AND doc_id < 6000 OR doc_id = 6001")
    got = {r.doc_id: r.line_labels for r in line_crf.judge(some, field, keep=("doc_id",)).collect()}
    assert all(v == ([0, 0] if k == 6001 else [0, 0, 0, 0, 1]) for k, v in got.items()) and len(got) == 13


def test_lines_without_a_blank_can_be_frequent(spark):
    from churnlab.llm import line_crf
    menu, script, short = "Impressum-und-Kontakt", "利用規約とプライバシー方針", "Menü"
    rows = [(i, f"text number {i} says {i * i}\n{menu}\n{script}\n{short}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_crf.Sorted(line_crf.frequent_lines(df, 40))
    assert all(line_crf._hash(x.encode()) in found for x in (menu, script))
    assert line_crf._hash(short.encode()) not in found and len(found) == 2
    values, lines = line_crf.line_features(rows[3][1], found)
    assert [v[7] for v in values] == [0, 2, 2, 0] and lines[1:] == [menu, script, short]
