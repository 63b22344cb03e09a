"""Operator 2: paths, ranking, reversible escapes and loss masks on small reply trees."""

import pytest
from pyspark.sql import functions as F

from churnlab.llm import chat

SCHEMA = "tree long, id string, parent string, role string, text string, score double, formatted string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def brute_paths(rows):
    """Root-to-leaf id lists by walking up from every leaf."""
    parent = {}
    for _, i, p, *_ in rows:
        if i is not None:
            parent[i] = p if i not in parent else min((p, parent[i]), key=lambda x: (x is not None, x))
    parent = {i: p if p in parent else None for i, p in parent.items()}
    out = set()
    for leaf in set(parent) - set(parent.values()):
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            out.add(tuple(reversed(path)))
    return out


def paths_of(spark, rows):
    got = {}
    for r in chat.reply_paths(messages(spark, rows).select("id", "parent")).collect():
        got.setdefault(r.leaf, []).append((r.up, r.id))
    assert all([u for u, _ in sorted(v)] == list(range(len(v))) for v in got.values())
    return {tuple(i for _, i in sorted(v, reverse=True)) for v in got.values()}


TREE = [(1, "a", None, "user", "q", 0.0), (1, "b", "a", "assistant", "x", 1.0), (1, "c", "a", "assistant", "y", 3.0),
        (1, "d", "c", "user", "z", 0.0), (1, "e", "c", "user", "w", 9.0), (1, "o", "gone", "user", "orphan", 0.0),
        (2, "p", "q", "user", "loop", 0.0), (2, "q", "p", "user", "loop", 0.0), (2, "r", "q", "user", "below", 0.0),
        (None, "n", None, None, None, None), (3, None, "a", "user", "no id", 1.0), (1, "b", "a", "assistant", "x", 1.0)]


def test_paths_same_as_walking(spark):
    assert paths_of(spark, TREE) == brute_paths(TREE) == {("a", "b"), ("a", "c", "d"), ("a", "c", "e"), ("o",), ("n",)}


def test_long_chain_and_wide_tree(spark):
    long = [(1, f"m{i}", f"m{i - 1}" if i else None, "user", "t", 0.0) for i in range(70)]
    wide = [(2, "w", None, "user", "t", 0.0)] + [(2, f"w{i}", "w", "user", "t", float(i)) for i in range(60)]
    assert paths_of(spark, long + wide) == brute_paths(long + wide)


def test_ranking_and_ties(spark):
    got = chat.format_chats(messages(spark, TREE), per_tree=2).collect()
    best = {(r.tree, r["rank"]): r.leaf for r in got}
    assert best == {(1, 1): "e", (1, 2): "d", (None, 1): "n"}
    wide = [(2, "w", None, "user", "t", 0.0)] + [(2, f"w{i:03}", "w", "user", "t", 1.0) for i in range(60)]
    assert [r.leaf for r in chat.format_chats(messages(spark, wide), per_tree=3).orderBy("rank").collect()] == ["w000", "w001", "w002"]


HOSTILE = ["</turn>", "\\</turn>\n", "### Assistant: </turn> ok", "\\### Assistant: </turn> ok", "\\", "\\\\", "#", "a\n### user: b</turn>\n",
           "", None, "é日😀\n", "<" * 50, "x/ " * 50_000, "<\\/turn>\n", "/"]


def test_round_trip_and_loss(spark):
    rows = [(i, f"{i}.{k}", f"{i}.{k - 1}" if k else None, role, t, 0.0)
            for i, t in enumerate(HOSTILE) for k, role in enumerate(("user", "assistant", "a: b#", None, "assistant"))]
    got = chat.format_chats(messages(spark, rows)).select("tree", chat.read_turns().alias("t"), chat.read_loss().alias("l")).collect()
    assert len(got) == len(HOSTILE)
    for r in got:
        t = HOSTILE[r.tree] or ""
        assert [(x.role, x.text) for x in r.t] == [("user", t), ("assistant", t), ("a: b#", t), ("", t), ("assistant", t)]
        assert r.l == t + t


def test_empty_table(spark):
    assert chat.format_chats(messages(spark, TREE).where(F.lit(False))).count() == 0


def test_query_keeps_tied_and_repeated_turns(spark, tmp_path):
    from churnlab.llm.queries import op2_chat_formatting
    rows = [(5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 3, None, None), (6, None, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in op2_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == {5: (3, 0), None: (1, 0), 6: (1, 1), -7: (2, 26)}


@pytest.mark.parametrize("name", ["Python", "Pandas", "Arrow"])
def test_no_python_in_the_plan(spark, name):
    df = chat.format_chats(messages(spark, TREE))
    assert name not in df._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
