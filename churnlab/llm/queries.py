"""The registered queries opN_<name> and their SQL.

Each query applies its operator with production parameters to its whole
table and derives the fixed digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.llm import gam, langid, line_crf, merkle, pii, toxicity, url_filters
from churnlab.llm.chat import chain, format_chats, read_loss, read_turns
from churnlab.llm.common import held_out, table
from churnlab.llm.decontaminate import find_items, words_in
from churnlab.llm.ngram_join import near_classes
from churnlab.llm.packing import pack_documents
from churnlab.llm.periodic_runs import find_runs
from churnlab.llm.token_counts import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


SQL1 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT documents.doc_id, m.class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM documents JOIN m ON m.node = documents.doc_id LEFT JOIN k ON k.a = documents.doc_id
"""


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(tricky).alias("text"))
    chats = format_chats(chain(rows.unionByName(extra)))
    turns, loss = read_turns(), read_loss()
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"),
                        F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL2 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### : </turn>') + 1 + length(regexp_replace(role, '([\\#/:])', '\\\1', 'g'))
                + length(regexp_replace(text, '([\\#/])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in pii.KINDS}
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()),
                        F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = found.withColumn("n_hit", words_in("spans"))
    return hit.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


SQL4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS joined, least(len(w), 10) AS m FROM s),
sizes AS (SELECT DISTINCT m FROM v),
p AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m),
g AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS joined FROM p),
h AS (SELECT g.r, g.i, g.m, v.item FROM g JOIN v ON v.joined = g.joined AND v.m = g.m),
n AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS pos FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam.fit(docs, table(spark, sf_dir, "labels"))
    return gam.score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                              (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.fit(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def _crc() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


# crc32 of the decimal id, bit by bit, in DuckDB SQL.
_SQL_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(
    range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, CAST(3988292384 AS UBIGINT) * (xor(c, x) & 1))), CAST(4294967295 AS UBIGINT))"""


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts end in repetitions of their own words, as the contract of op11 states."""
    words = F.when(_crc() % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    w = docs.select("doc_id", "text", words.alias("w"), F.floor(_crc() / 10).alias("g"))
    w = w.select("*", F.coalesce(F.size("w"), F.lit(-1)).alias("n"))
    w = w.select("*", F.expr("cast(g % greatest(n, 1) as int)").alias("a"))
    w = w.select("*", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)").alias("p"))
    changed = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), "
                     "cast(ceil((n - a) / p) as int))), 1, n - a)), ' ')")
    return w.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_periods(table(spark, sf_dir, "documents")))
    # equal fractions of numbers this small are equal doubles, different ones differ
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("before"), (-r["period"]).alias("short"), r.alias("run"))))["run"]
    listed = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                    F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_merkle_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.when(_crc() % 3 == 0, F.translate("text", url_filters.UPPER, url_filters.LOWER)).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select(*merkle.FIELDS, low.alias("low_text"))
    rows = rows.withColumn("tampered", merkle.leaf_of(tuple("low_text" if c == "text" else c for c in merkle.FIELDS)))
    proofs = merkle.manifest(rows, keep=("doc_id", "tampered"))
    return (proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(), 256).alias("proof_sha256"),
                          merkle.fold(F.col("tampered")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _levels(first: str, depth: int, name: str) -> str:
    """SQL of ``depth`` levels of fan-out 8 over ``first`` (g, i, d); a level of one node stays as it is."""
    parts = []
    for k in range(depth):
        below = first if k == 0 else f"{name}{k}"
        parts.append(f"""{name}{k + 1} AS (
  SELECT g, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
  FROM (SELECT g, i, d, count(*) OVER (PARTITION BY g) AS n FROM {below}) GROUP BY g, i // 8)""")
    return ",\n".join(parts)


def _climb(first: str, depth: int, name: str, out: str, start: str) -> str:
    """SQL that carries ``start`` (r, g, i, proof, f) up ``depth`` levels: the siblings' digests, and f folded with them."""
    parts = []
    for k in range(depth):
        below, before = first if k == 0 else f"{name}{k}", start if k == 0 else f"{out}{k}"
        parts.append(f"""{out}{k + 1} AS (
  SELECT x.r, x.g, x.i // 8 AS i, any_value(x.proof) || coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (WHERE y.i <> x.i), '') AS proof,
         CASE WHEN any_value(y.n) = 1 THEN any_value(x.f)
              ELSE sha256(string_agg(CASE WHEN y.i = x.i THEN x.f ELSE y.d END, '' ORDER BY y.i)) END AS f
  FROM {before} x JOIN (SELECT g, i, d, count(*) OVER (PARTITION BY g) AS n FROM {below}) y
    ON x.g = y.g AND y.i // 8 = x.i // 8 GROUP BY x.r, x.g, x.i)""")
    return ",\n".join(parts)


def _sql12(depth: int = 7, top: int = 3) -> str:
    """Trees of up to 8 ** depth leaves a language and 8 ** top languages."""
    def written(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(written(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    return f"""
WITH t AS (
  SELECT *, coalesce('=' || lang, '-') AS g,
         CASE WHEN {_SQL_CRC} % 3 = 0 THEN translate(text, '{url_filters.UPPER}', '{url_filters.LOWER}') ELSE text END AS low FROM documents),
l AS (SELECT row_number() OVER () AS r, doc_id, g, {leaf('text')} AS d, {leaf('low')} AS f FROM t),
leaves AS (SELECT r, doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, d, f FROM l),
{_levels('leaves', depth, 'v')},
tops AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, d, g AS lang FROM v{depth}),
{_levels('tops', top, 'w')},
start AS (SELECT r, g, i, '' AS proof, f FROM leaves),
{_climb('leaves', depth, 'v', 'p', 'start')},
next AS (SELECT p.r, '' AS g, tops.i, p.proof, p.f FROM p{depth} p JOIN tops ON tops.lang = p.g),
{_climb('tops', top, 'w', 'q', 'next')}
SELECT leaves.doc_id, leaves.d AS leaf, tops.d AS subroot, w{top}.d AS root, sha256(q.proof) AS proof_sha256, q.f AS folded_root,
       q.f = w{top}.d AS verified
FROM leaves JOIN tops ON tops.lang = leaves.g JOIN q{top} q ON q.r = leaves.r, w{top}
"""


# The entries of op13's contract (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL13 = f"""
WITH e(rule_host, rule_path, verdict) AS (VALUES {', '.join(map(str, RULES))}),
p AS (SELECT row_number() OVER () AS r, page_id,
             translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT p.*, e.rule_host || e.rule_path AS rule, e.verdict,
             row_number() OVER (PARTITION BY r ORDER BY length(e.rule_host || e.rule_path) DESC NULLS LAST) AS place
      FROM p LEFT JOIN e ON ends_with('.' || p.host, '.' || e.rule_host) AND starts_with(p.path, e.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE place = 1
"""


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_chat_formatting, op3_pii, op4_benchmark_decontamination, op5_best_fit_packing, op6_quality_classifier, op7_toxicity, op8_quality_rules, op9_token_counts, op10_language_id, op11_periodic_run_detection, op12_merkle_dataset_manifest, op13_url_filters)}
ORACLE: dict[str, str] = {"op1_ngram_jaccard_join": SQL1, "op2_chat_formatting": SQL2, "op4_benchmark_decontamination": SQL4,
                          "op12_merkle_dataset_manifest": _sql12(), "op13_url_filters": SQL13}
