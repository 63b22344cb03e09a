"""Order-dependent statistics without a single-task window.

``Window.orderBy(x)`` with no (or a very coarse) ``partitionBy`` moves every
row into one task.  The helpers here keep such work distributed:

* ``prefix_sums`` - exact running totals in a global order (optionally per a
  few coarse groups such as a class label or a column name).  Rows are
  range-partitioned on (group, order) and materialized; each range partition
  computes local running sums, and per-(partition, group) totals - a table
  of at most partitions + groups rows - give every partition its starting
  offset.  A hot group simply spans several range partitions.
* ``exact_quantiles`` - linear-interpolated quantiles (numpy / pandas /
  DuckDB ``quantile_cont``) of many columns at once: a sketch brackets each
  rank, exact counts decide inside the bracket.  No task holds a column.
* ``modes`` - most frequent value per column, smallest value on ties,
  from a distributed value count and ``min_by``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.session import materialize


#: Rows that one range partition sorts; ranges follow the data, as AQE does not split them.
ROWS_PER_RANGE = 2_000_000


def _ranges(df: DataFrame, by: list[Column], partitions: int | None) -> DataFrame:
    """``df`` stored in ranges of ``by``, each with its number ``_pid``.

    The stored rows are counted from the files' footers; only if there are too
    many for the session's number of partitions are they dealt again, from the
    stored table, into as many ranges as they need.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def dealt(rows: DataFrame, n: int) -> DataFrame:
        return materialize(rows.repartitionByRange(n, *by).withColumn("_pid", F.spark_partition_id()), "prefix_ranges")

    ranged = dealt(df, n)
    needed = 0 if partitions else math.ceil(ranged.count() / ROWS_PER_RANGE)
    return dealt(ranged.drop("_pid"), needed) if needed > n else ranged


def prefix_sums(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                sum_cols: Sequence[str], prefix: str = "cum_", partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` per group in ``order``.

    ``order`` must be a total order within a group (add a unique tie-break)
    for the running sum to be well defined row by row.  NULL is a group of its
    own.  Intended for few groups (classes, column names); many small groups
    are better served by an ordinary partitioned window.

    ``df`` is not evaluated to count it; the number of ranges follows from
    what was stored (``_ranges``).
    """
    groups = list(group_cols)
    # The range bounds come from a sample whose rows depend on arrival order,
    # and the two uses below prune columns differently (so Spark would not
    # reuse one exchange): without materialising, each use could see other
    # bounds.  A parquet stage in the shared checkpoint folder fixes the
    # partition ids once and survives lost executors (a cache would be recomputed).
    ranged = _ranges(df, [*(F.col(g) for g in groups), *order], partitions)
    w_local = (Window.partitionBy("_pid", *groups).orderBy(*order)
                     .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumns({f"_l_{c}": F.coalesce(F.sum(c).over(w_local), F.lit(0)) for c in sum_cols})
    totals = ranged.groupBy("_pid", *groups).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    w_off = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    keys = {c: f"_k{i}" for i, c in enumerate(["_pid", *groups])}
    offsets = totals.select(*[F.col(c).alias(k) for c, k in keys.items()],
                            *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    # null-safe, so rows whose group is NULL find their offset too; offsets has
    # a row per (range, group) and AQE broadcasts it where its measured size allows
    same = F.lit(True)
    for c, k in keys.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    out = local.join(offsets, same)
    out = out.withColumns({f"{prefix}{c}": F.col(f"_o_{c}") + F.col(f"_l_{c}") for c in sum_cols})
    return out.drop("_pid", *keys.values(), *[f"_{k}_{c}" for c in sum_cols for k in ("l", "o")])


#: Rows that one range of ``row_numbers`` sorts: whole rows, so fewer than of running sums.
ROWS_NUMBERED = 1_000_000


def row_numbers(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                name: str = "row_number", partitions: int | None = None, stored: bool = False,
                helpers: dict[str, Column] | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)`` for few, possibly huge groups.

    Whole rows cross the network once: they are stored as they come, counted
    from the files' footers, dealt into ranges of at most about
    ``ROWS_NUMBERED`` rows, sorted there and stored with their place in the
    range.  The first place and the number of rows of each (range, group) - at
    most ranges + groups rows - then give every row its number.  ``df`` is
    evaluated once (``stored``: it reads a stored table and is not stored
    again).  ``helpers`` are columns that ``order`` may use; they are neither
    stored nor returned.
    """
    groups = list(group_cols)
    n = partitions
    if n is None:
        df = df if stored else materialize(df, "rows_to_number")
        n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(df.count() / ROWS_NUMBERED))
    by = [*(F.col(g) for g in groups), *order]
    helped = df.withColumns(helpers) if helpers else df
    dealt = helped.repartitionByRange(n, *by).sortWithinPartitions(*by)
    # the lower 33 bits of the id count the rows of a partition in their order
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialize(dealt.withColumns({"_pid": F.spark_partition_id(), "_at": place}).drop(*(helpers or ())), "numbered_ranges")
    totals = ranged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_k{i}" for i, c in enumerate(["_pid", *groups])}
    offsets = totals.select(*[F.col(c).alias(k) for c, k in names.items()],
                            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_o"))
    same = F.lit(True)
    for c, k in names.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    out = ranged.join(F.broadcast(offsets), same)      # at most ranges + groups rows
    return out.withColumn(name, F.col("_at") + F.col("_o")).drop("_pid", "_at", "_o", *names.values())


def to_long(df: DataFrame, columns: Sequence[str], name: str = "column", value: str = "value",
            cast: str | None = "double", ids: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``columns`` into (ids..., column, value) rows (one Expand, no shuffle)."""
    src = df.select(*ids, *[(F.col(c).cast(cast) if cast else F.col(c)).alias(c) for c in columns])
    return src.unpivot(list(ids), list(columns), name, value)


def value_counts(df: DataFrame, columns: Sequence[str], cast: str | None = "double") -> DataFrame:
    """(column, value, cnt) for every non-null value of every column; combines map-side."""
    long = to_long(df, columns, cast=cast).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))


#: Accuracy of the sketch that brackets a rank: its error is 1 / SKETCH of the values.
SKETCH = 10_000
#: Values of one bracket that are sorted; wider brackets are narrowed by another pass.
BRACKET_VALUES = 200_000


def _brackets(df: DataFrame, columns: Sequence[str], ranks: dict) -> dict:
    """{(column, p): (n, low, high)}: values between which the two ranks around (n - 1) * p lie.

    Each pass is one aggregation to a single row: counts, and the sketch's
    values a little below and above each rank, taken among the values inside
    the bracket so far (with how many lie below it).
    """
    margin = 2.0 / SKETCH
    row = df.agg(*[x for c in columns for x in (F.count(F.col(c)), F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double")))]).first()
    ends = {c: (row[3 * i], row[3 * i + 1], row[3 * i + 2]) for i, c in enumerate(columns)}
    out = {(c, p): ends[c] for c, p in ranks}
    inside = {k: v[0] for k, v in out.items()}
    below = dict.fromkeys(out, 0)
    for _ in range(4):
        wide = [k for k in out if inside[k] > BRACKET_VALUES and out[k][1] < out[k][2]]
        if not wide:
            break
        # probabilities whose brackets are the same so far share a sketch
        shared: dict[tuple, list[float]] = {}
        for c, p in wide:
            n, low, high = out[c, p]
            at = ((n - 1) * p - below[c, p]) / inside[c, p]
            shared.setdefault((c, low, high), []).extend(min(max(at + d, 0.0), 1.0) for d in (-margin, margin))
        aggs = []
        for (c, low, high), probs in shared.items():
            x = F.col(c).cast("double")
            aggs.append(F.percentile_approx(F.when((x >= low) & (x <= high), x), probs, SKETCH))
        row = df.agg(*aggs).first()
        values = {key: iter(row[i]) for i, key in enumerate(shared)}
        cuts = {}
        for c, p in wide:
            n, low, high = out[c, p]
            at = values[c, low, high]
            cuts[c, p] = n, next(at), next(at)
        sizes = df.agg(*[x for (c, p) in wide for x in (
            F.count_if(F.col(c).cast("double") < cuts[c, p][1]), F.count_if(F.col(c).cast("double").between(cuts[c, p][1], cuts[c, p][2])))]).first()
        shrunk = False
        for i, k in enumerate(wide):
            lower, within = sizes[2 * i], sizes[2 * i + 1]
            first, last = math.floor((cuts[k][0] - 1) * k[1]), math.ceil((cuts[k][0] - 1) * k[1])
            if lower <= first and last < lower + within and within < inside[k]:     # else the bracket stays as it was
                out[k], below[k], inside[k], shrunk = cuts[k], lower, within, True
        if not shrunk:
            break
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    names: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles, long form: (column, q_<p>...) one row per column.

    Rank r = (n - 1) * p over the non-null values; result is
    v[floor r] + (v[ceil r] - v[floor r]) * (r - floor r).  Columns with no
    value give NULL.

    A sketch brackets each rank between two values; one more pass counts, with
    map-side combine, the values below the bracket and each value inside it,
    and only those are put in order.  Nothing is written, no column is
    shuffled whole, and the answer is exact because the counts are.  ``df`` is
    read two to four times: pass a stored table if it is costly.
    """
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    asked = {(c, p): nm for c in columns for p, nm in zip(probs, names)}
    spark = df.sparkSession
    present = spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "column string, _pos int")
    rows = [(c, asked[c, p], n, low, high, float((n - 1) * p))
            for (c, p), (n, low, high) in _brackets(df, columns, asked).items() if n]
    # columns x probabilities rows
    ranks = F.broadcast(spark.createDataFrame(rows, "column string, name string, n long, low double, high double, r double"))
    near = (to_long(df, columns).where(F.col("value").isNotNull()).join(ranks, "column")
            .where((F.col("value") <= F.col("high")) | F.isnan("high"))
            .withColumn("value", F.when(F.col("value") >= F.col("low"), F.col("value"))))
    counts = near.groupBy("column", "name", "r", "value").agg(F.count(F.lit(1)).alias("cnt"))
    upto = (Window.partitionBy("column", "name").orderBy(F.col("value").asc_nulls_first())
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = counts.withColumn("cum", F.sum("cnt").over(upto))
    low = F.min(F.when(F.col("cum") > F.floor("r"), F.col("value")))
    high = F.min(F.when(F.col("cum") > F.ceil("r"), F.col("value")))
    each = cum.groupBy("column", "name").agg((low + (high - low) * F.first(F.col("r") - F.floor("r"))).alias("q"))
    res = each.groupBy("column").agg(*[F.max(F.when(F.col("name") == nm, F.col("q"))).alias(nm) for nm in names])
    return present.join(res, "column", "left").orderBy("_pos").drop("_pos")


def quantile_row(df: DataFrame, columns: Sequence[str], p: float, suffix: str = "",
                 partitions: int | None = None) -> DataFrame:
    """One-row frame holding quantile p of each column, named ``<column><suffix>``."""
    long = exact_quantiles(df, columns, [p], ["_q"], partitions)
    wide = long.groupBy().pivot("column", list(columns)).agg(F.first("_q"))
    return wide.select(*[F.col(c).alias(f"{c}{suffix}") for c in columns])


#: Items that the frequent-items summary of a column tracks, and the candidates counted exactly.
TRACKED = 10_000
CANDIDATES = 64
#: The summary's count of a value is too low by at most this share of the column's values.
SUMMARY_ERROR = 3.5 / (1 << math.ceil(math.log2(TRACKED / 0.75)))


def _modes_of(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(
        F.min_by(F.struct("value", "cnt"), F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v")))
        .alias("_m")).select("column", F.col("_m.value").alias("mode"), F.col("_m.cnt").alias("cnt"))


def frequent_counts(df: DataFrame, columns: Sequence[str], cast: str | None = "string") -> tuple[dict[str, dict], list[str]]:
    """Exact counts {column: {value: count}} of likely modes, and the columns they don't decide.

    A mergeable summary per column (one aggregation, bounded memory) names
    the candidates; a second pass counts only those, combined map-side.  A value
    that is no candidate occurs in less than twice ``SUMMARY_ERROR`` of the
    column's values; a leader above that is the mode, and so is every tie.
    """
    cols = list(columns)
    value = {c: F.col(c).cast(cast) if cast else F.col(c) for c in cols}
    src = df.select(*(value[c].alias(f"_v{i}") for i, c in enumerate(cols)))
    row = src.agg(*[x for i in range(len(cols)) for x in (
        F.count(f"_v{i}"), F.call_function("approx_top_k", F.col(f"_v{i}"), F.lit(CANDIDATES), F.lit(TRACKED)))]).first()
    sizes = {c: row[2 * i] for i, c in enumerate(cols)}
    named = [(i, t["item"]) for i in range(len(cols)) for t in row[2 * i + 1] or []]
    counts: dict[str, dict] = {c: {} for c in cols}
    if named:
        # at most CANDIDATES rows a column
        kind = src.schema["_v0"].dataType.simpleString()
        wanted = F.broadcast(df.sparkSession.createDataFrame(named, f"_i int, value {kind}"))
        long = src.select(F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), F.col(f"_v{i}").alias("value"))
                                              for i in range(len(cols))))).alias("_x")).select("_x.*")
        for r in long.join(wanted, ["_i", "value"]).groupBy("_i", "value").count().collect():
            counts[cols[r["_i"]]][r["value"]] = r["count"]
    open_ = []
    for c in cols:
        most = max(counts[c].values(), default=0)
        tied = sum(n == most for n in counts[c].values())
        if sizes[c] and (most <= 2 * SUMMARY_ERROR * sizes[c] or tied == CANDIDATES):
            open_.append(c)
    return counts, open_


def modes(df: DataFrame, columns: Sequence[str], cast: str | None = "string") -> DataFrame:
    """(column, mode, cnt): most frequent non-null value per column; smallest value on ties.

    Wide domains are not shuffled value by value: candidates come from a
    summary and are counted exactly (``frequent_counts``).  Only a column without
    a value that stands out is counted in full.  A column without values has no
    row.  Needs one type for all columns; ``df`` is read two or three times.
    """
    counts, undecided = frequent_counts(df, columns, cast)
    rows = [(c, min(v for v, n in kinds.items() if n == max(kinds.values())), max(kinds.values()))
            for c, kinds in counts.items() if kinds and c not in undecided]
    kind = df.select((F.col(columns[0]).cast(cast) if cast else F.col(columns[0])).alias("v")).schema["v"].dataType.simpleString()
    decided = df.sparkSession.createDataFrame(rows, f"column string, mode {kind}, cnt bigint")
    return decided.unionByName(_modes_of(value_counts(df, undecided, cast=cast))) if undecided else decided
