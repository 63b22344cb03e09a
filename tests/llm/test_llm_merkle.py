"""Operator 12: leaves, positions, roots and proofs against a plain tree; odd keys; deep trees."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from churnlab.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(nodes, fanout):
    """(root, per node its path of (slot, siblings))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i - i % fanout
            paths[k].append((i - first, "".join(nodes[first:i] + nodes[i + 1:first + fanout])))
        nodes = [H("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def plain(rows, fanout=8):
    """Sorted list of (doc_id, leaf, subroot, root, path)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        mine = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *climb([leaf(r) for r in mine], fanout)))
    root, tops = climb([t[1] for t in trees], fanout)
    return sorted((((r[0], leaf(r), sub, root, p + top)) for (mine, sub, paths), top in zip(trees, tops, strict=True)
                   for r, p in zip(mine, paths, strict=True)), key=str)


def got(df, **options):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(p.slot, p.others) for p in r.path])
                   for r in merkle.manifest(df, **options).collect()), key=str)


def made(n, seed, ids=None):
    rng = random.Random(seed)
    ids = ids or range(n)
    return [(i, rng.choice(["a", None]), rng.choice(["en", "de", "fr", None, "é"]), rng.choice([None, 5]), f"text {rng.random()}", "clash")
            for i in ids]


@pytest.mark.parametrize("n,fanout", [(1, 8), (9, 8), (700, 8), (300, 2), (130, 3)])
def test_equals_a_plain_tree(spark, n, fanout):
    rows = made(n, n)
    assert got(spark.createDataFrame(rows, SCHEMA), fanout=fanout) == plain(rows, fanout)


def test_trees_deeper_than_one_slot_array(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SLOTS", 8)
    rows = made(500, 3)
    assert got(spark.createDataFrame(rows, SCHEMA), fanout=2) == plain(rows, 2)


def test_wide_and_negative_keys(spark):
    rng = random.Random(8)
    ids = {rng.randrange(-2 ** 63, 2 ** 63) for _ in range(200)} | {-2 ** 63, 2 ** 63 - 1, 0, -1, 63, 64, 65535, 65536, 1 << 40}
    rows = made(0, 1, sorted(ids, key=lambda _: rng.random()))
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_repeated_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 7)
    rows = made(90, 4) + made(90, 5) + [(None, "s", "en", 1, t, None) for t in ("x", "y", "x", None)] + [(17, "s", "de", 1, "same", None)] * 60
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_texts_as_written(spark):
    rows = [(1, None, None, None, None, None), (2, "", "", 0, "", None), (3, "ü", "日本", -4, "a\n" * 200_000, None), (4, "-", "-", 1, "0:", None)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(empty, keep=("leaf",))


def test_every_change_of_a_leaf_changes_the_root(spark):
    df = spark.createDataFrame(made(60, 2), SCHEMA)
    changed = df.withColumn("low", F.concat("text", F.lit("!")))
    rows = changed.withColumn("other", merkle.leaf_of(("doc_id", "source", "lang", "n_chars", "low")))
    proofs = merkle.manifest(rows, keep=("doc_id", "other"))
    r = proofs.agg(F.bool_and(merkle.fold(F.col("leaf")) == F.col("root")).alias("same"),
                   F.bool_or(merkle.fold(F.col("other")) == F.col("root")).alias("fooled")).first()
    assert r.same and not r.fooled


def test_query_equals_its_sql(spark):
    import duckdb
    from conftest import SF001
    from churnlab.llm.queries import ORACLE, op12_merkle_dataset_manifest
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    df = op12_merkle_dataset_manifest(spark, SF001)
    want = con.execute(ORACLE["op12_merkle_dataset_manifest"])
    assert [d[0] for d in want.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
