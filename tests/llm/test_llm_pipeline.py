"""The pipeline's rows against a plain version of every stage, and odd tables."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_llm_decontaminate import brute as benchmark_hits
from test_llm_ngram_join import brute as classes
from test_llm_packing import check
from tokenizers import Tokenizer

from churnlab.llm import gam, pii


def mask(text, field):
    out, at = [], 0
    for a, k, b, _ in pii.find([text], field)[0]:
        if a >= at:
            out += [text[at:a], f"[{pii.KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_stages_same_as_plain_versions(spark):
    from conftest import SF001
    table = lambda n: spark.read.parquet(f"{SF001}/{n}.parquet")
    docs = table("documents")
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    model = gam.fit(docs, table("labels"))
    score = model.score(np.array([gam.features(t) for t in want.values()]))
    want = {i: t for (i, t), s in zip(want.items(), score, strict=True) if s >= 0.7}
    group = classes(want.items())
    want = {i: t for i, t in want.items() if group[i][0] == i}
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    want = {i: t for i, t in want.items() if not benchmark_hits(t, items)[1]}

    names = [n for n, _ in corpus_pipeline.STAGES]
    got, seen = docs, {}
    for name, step in corpus_pipeline.STAGES:
        got = step(spark, got, SF001)
        if name != names[-1]:
            assert got.columns == docs.columns
            rows = got.collect()
            got = spark.createDataFrame(rows, docs.schema)
            seen[name] = {r.doc_id: r.text for r in rows}
    assert seen["decontamination"] == want
    field = pii.fit(spark.createDataFrame(sorted(want.items()), "doc_id long, text string"))
    masked = {i: mask(t, field) for i, t in want.items()}
    assert {i: t for i, t in seen["personal_data"].items() if "[" not in t} == {i: t for i, t in masked.items() if "[" not in t}
    for i, t in seen["personal_data"].items():
        assert not pii.base_spans(t), i
    used, least = check(got.collect(), seen["personal_data"], 2048)
    assert used <= least + 2

    whole = corpus_pipeline.run(spark, SF001).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    crc = {r.doc_id: r.ids_crc32 for r in whole if r.piece == 0 and r.length < 2048}
    for i, c in crc.items():
        ids = encode.encode(seen["personal_data"][i], add_special_tokens=False).ids + [0]
        assert c == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert {r.doc_id for r in whole} == set(want)


def test_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, 3), (2, "", "en", "s", 0, 3), (None, "mail a@b.co now", None, None, 15, 3),
         (3, "call a@b.co now", "en", "s", 15, 3), (3, "call a@b.co now", "en", "s", 15, 3), (4, "w " * 30_000, "en", "s", 9, 3)],
        "doc_id long, text string, lang string, source string, n_chars long, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(str(tmp_path / f"full/{name}.parquet"))
        df.where(F.lit(False)).write.parquet(str(tmp_path / f"empty/{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    assert sorted({str(r.doc_id) for r in got}) == ["1", "2", "3", "4", "None"]
    assert sum(r.doc_id == 3 for r in got) == 1 and max(r.piece for r in got if r.doc_id == 4) > 10
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
