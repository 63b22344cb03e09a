"""Operator 12 - Merkle manifest of a dataset, leaves placed by bitmap ranks.

Every row is a leaf: the SHA-256 of its fields, each written as ``-`` if null,
else as byte count, ``:`` and value.  The leaves of a group (a language),
ascending by key, form a tree of fan-out 8; the groups' roots, ordered by group
(null first, then bytewise), form the top tree with the dataset's root.  A last
run of a level may be short, even of one; a level of one node is a root.

Coordinates without sorting leaves: the keys of a group are a bitmap, compressed
to its 64-bit words that hold a key (a grouped OR with partial results in every
task).  Popcount directories give each word the number of leaves before it:
counts inside blocks of 1,024 words, then of blocks inside blocks of 65,536, and
so on until one block holds every key; each such group is bounded whatever the
size of the table.  A leaf's rank is its word's count plus the bits below its
own.

Levels are reduced in keyed slot arrays: (group, rank / 512) collects the up to
512 leaves of a three-level subtree, each in its slot; only the subtrees' roots
go on, again by 512.  So a tree of n leaves takes log512(n) grouped steps, and
proofs go down the same steps, one row a subtree.

Result: one row per row of the table with ``leaf``, ``subroot``, ``root`` and
``path``: for each level from the leaf up, the place among its siblings and the
siblings' digests.  ``fold`` recomputes the root from any leaf and a path.

Cases: a null group is a group of its own, the first; null keys come before all
others of their group; rows with equal keys follow one another by leaf, so only
identical rows are interchangeable, and they are numbered apart from the bitmap
(by range, a key that holds a third of the rows spans many tasks); negative keys
are in order; empty and very long texts are hashed whole; an empty table gives
an empty result; other columns than the fields, group, key and ``keep`` are not
read.  ``keep`` columns must be comparable types.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from churnlab.llm.common import stage
from churnlab.operators.ordered import prefix_sums, row_numbers

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Slots of one array, at most; the levels of a subtree follow from it and the fan-out.
SLOTS = 512
#: Copies of one repeated row numbered by one task.
COPIES = 65_536
PATH = "array<struct<slot:int,others:string>>"


def written(c: str) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    value = F.col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.sha2(F.concat(*(written(c) for c in fields)), 256)


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and the siblings of its path give."""
    def up(digest: Column, p: Column) -> Column:
        at = p["slot"] * 64
        return F.sha2(F.concat(F.substr(p["others"], F.lit(1), at), digest, F.substr(p["others"], at + 1)), 256)
    return F.aggregate(path, leaf, up)


def siblings(path: str = "path") -> Column:
    """The digests of all siblings, level by level from the leaf, left to right."""
    return F.array_join(F.transform(path, lambda p: p["others"]), "")


def _before(at: DataFrame, high: int) -> DataFrame:
    """(g, at, before): for (g, at, n) with at from 0 to ``high``, the sum of n at smaller places of g.

    A directory level sums inside blocks (1,024 places, then 65,536) and hands the blocks' totals to the next.
    """
    shift, found, bits = 0, None, 10
    while True:
        here = at.withColumn("up", F.shiftright("at", bits))
        w = Window.partitionBy("g", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        level = here.select("g", "at", "up", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("inside"))
        if found is None:
            found = level.select("g", "at", "up", F.col("inside").alias("before"))
        else:
            found = (found.withColumnRenamed("up", "key").join(level.withColumnRenamed("at", "key"), ["g", "key"])
                     .select("g", "at", "up", (F.col("before") + F.col("inside")).alias("before")))
        shift += bits
        if not high >> shift:
            return found.drop("up")
        at = here.groupBy("g", F.col("up").alias("at")).agg(F.sum("n").alias("n"))
        bits = 16


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, pos, leaf, kept) with positions from 0 in each g, and (g, total); ``rows`` has g, id, leaf, kept."""
    words = stage(rows.groupBy("g", F.shiftright("id", 6).alias("word"))
                  .agg(F.coalesce(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")), F.lit(0)).cast("long").alias("bits"),
                       F.count("*").alias("n")), "bitmaps")
    low, high = words.agg(F.min("word"), F.max("word")).first()
    low, high = low or 0, high or 0

    def place(word: Column) -> Column:              # from 1; null keys, which come before all others, at 0
        return F.coalesce(word - low + 1, F.lit(0).cast("long"))

    placed = words.withColumn("at", place(F.col("word")))
    before = _before(placed.select("g", "at", "n"), high - low + 1)
    words = stage(placed.join(before, ["g", "at"]).select("g", "at", "bits", "n", "before"), "directory")
    totals = words.groupBy("g").agg(F.sum("n").alias("total"))
    keyed = rows.withColumn("at", place(F.shiftright("id", 6)))
    once = F.col("n") == F.bit_count("bits")
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, cast(id & 63 as int))"))
    found = (keyed.join(words.where(once).select("g", "at", "bits", "before"), ["g", "at"])
             .select("g", (F.col("before") + below).alias("pos"), "leaf", "kept"))
    repeated = words.where(~once)
    if not repeated.isEmpty():
        found = found.unionByName(_numbered(keyed.join(repeated.select("g", "at", "before"), ["g", "at"])))
    return found, totals


def _numbered(rows: DataFrame) -> DataFrame:
    """(g, pos, leaf, kept) for the rows of words with repeated or null keys: (g, at, before, id, leaf, kept)."""
    each = rows.groupBy("g", "at", "before", "id", "leaf", "kept").agg(F.count("*").alias("copies"))
    order = [F.col("id").asc_nulls_first(), F.col("leaf"), F.xxhash64("kept")]
    first = F.col("before") + F.col("cum_copies") - F.col("copies")
    chunks = (prefix_sums(each, ["g", "at"], order, ["copies"]).withColumn("first", first)
              .withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))))
    return (chunks.repartition("g", "first", "chunk")
            .withColumn("i", F.explode(F.expr(f"sequence(chunk * {COPIES}, least(copies, (chunk + 1) * {COPIES}) - 1)")))
            .select("g", (F.col("first") + F.col("i")).alias("pos"), "leaf", "kept"))


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Subtree:
    """The levels over the digests of one slot array: ``depth`` of them, or up to one node if it holds its whole group."""

    def __init__(self, digests: list[str], fanout: int, depth: int, alone: bool):
        self.fanout, self.levels = fanout, [digests]
        while len(digests) > 1 if alone else len(self.levels) <= depth:
            digests = [_hash(digests[i:i + fanout]) for i in range(0, len(digests), fanout)]
            self.levels.append(digests)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, slot: int) -> list[dict]:
        out = []
        for level in self.levels[:-1]:
            first = slot - slot % self.fanout
            out.append({"slot": slot - first, "others": "".join(level[first:slot] + level[slot + 1:first + self.fanout])})
            slot //= self.fanout
        return out


def deep(fanout: int) -> int:
    """Levels of a subtree: as many as fit ``SLOTS`` slots."""
    n = 1
    while fanout ** (n + 1) <= SLOTS:
        n += 1
    return n


def _slots(members: pa.ListArray, i: int) -> tuple[list[str], list[int], pa.Array]:
    """Digests in slot order, and each member's slot, of one slot array."""
    rows = members[i].values
    slot = rows.field("slot").to_pylist()
    digests = [""] * len(slot)
    for s, leaf in zip(slot, rows.field("leaf").to_pylist(), strict=True):
        digests[s] = leaf.hex()
    return digests, slot, rows


def _collect(rows: DataFrame, totals: DataFrame, fanout: int) -> DataFrame:
    """Slot arrays (g, block, alone, members) of rows (g, pos, leaf, kept)."""
    size = fanout ** deep(fanout)
    arrays = (rows.groupBy("g", F.expr(f"pos div {size}").alias("block"))
              .agg(F.collect_list(F.struct(F.expr(f"cast(pos % {size} as int)").alias("slot"), "leaf", "kept")).alias("members")))
    return stage(arrays.join(totals, "g").select("g", "block", (F.col("total") <= size).alias("alone"), "members"), "slots")


def _roots(arrays: DataFrame, fanout: int) -> DataFrame:
    """(g, block, alone, leaf): the digest over every slot array."""
    out, depth = StructType.fromDDL("g string, block long, alone boolean, leaf binary"), deep(fanout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for b in batches:
            alone = b.column("alone").to_pylist()
            roots = [bytes.fromhex(Subtree(_slots(b.column("members"), i)[0], fanout, depth, alone[i]).root) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("block"), b.column("alone"), pa.array(roots, pa.binary())],
                                             names=schema.names)

    return arrays.select("g", "block", "alone", F.transform("members", lambda m: F.struct(m["slot"], m["leaf"])).alias("members")
                         ).mapInArrow(run, out)


def _paths(arrays: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """Each member (g, kept, leaf, path, and ``above``'s further columns), its path continued by its array's.

    ``above``: g, block, path and further string columns.
    """
    more = [c for c in above.columns if c not in ("g", "block", "path")]
    src = arrays.join(above.withColumnRenamed("path", "rest"), ["g", "block"]).select("g", "alone", "members", "rest", *more)
    kept = src.schema["members"].dataType.elementType["kept"].dataType
    out = StructType().add("g", "string").add("kept", kept).add("leaf", "string")
    out = out.add(StructType.fromDDL(f"path {PATH}").fields[0])
    for c in more:
        out = out.add(c, "string")
    depth = deep(fanout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        kinds = {f.name: f.type for f in schema}
        for b in batches:
            for i in range(b.num_rows):
                digests, slots, rows = _slots(b.column("members"), i)
                tree = Subtree(digests, fanout, depth, b.column("alone")[i].as_py())
                rest = b.column("rest")[i].as_py()
                n = len(slots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("g")[i].as_py()] * n, kinds["g"]), rows.field("kept"),
                     pa.array([digests[s] for s in slots], kinds["leaf"]),
                     pa.array([tree.path(s) + rest for s in slots], kinds["path"]),
                     *(pa.array([b.column(c)[i].as_py()] * n, kinds[c]) for c in more)], names=schema.names)

    return src.mapInArrow(run, out)


def _tree(rows: DataFrame, totals: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slot arrays of the lowest level, the path (g, block, path) of every array to its group's root, and the roots (g, leaf)."""
    size = fanout ** deep(fanout)
    arrays = _collect(rows, totals, fanout)
    nodes = stage(_roots(arrays, fanout), "subtrees")
    none = F.array().cast(PATH)
    single = nodes.where("alone")
    roots, above = single.select("g", "leaf"), single.select("g", "block", none.alias("path"))
    if not nodes.where("not alone").isEmpty():
        upper = nodes.where("not alone").select("g", F.col("block").alias("pos"), "leaf", F.struct("block").alias("kept"))
        counts = totals.where(F.col("total") > size).select("g", F.expr(f"(total + {size - 1}) div {size}").alias("total"))
        higher, beyond, tops = _tree(upper, counts, fanout)
        climbed = _paths(higher, beyond, fanout).select("g", F.col("kept.block").alias("block"), "path")
        roots, above = roots.unionByName(tops), above.unionByName(climbed)
    return arrays, above, roots


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id",
             keep: tuple[str, ...] = ("doc_id",), fanout: int = 8) -> DataFrame:
    """``keep`` columns, leaf, subroot, root (hex digests) and path (see above) of every row."""
    if clash := {"leaf", "subroot", "root", "path"} & {*keep}:
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    if not 2 <= fanout <= SLOTS:
        raise ValueError(f"fanout from 2 to {SLOTS}")
    kept = F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    # a group's name, null before all others in byte order
    rows = stage(docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("g"),
                             F.col(key).cast("long").alias("id"), F.unhex(leaf_of(fields)).alias("leaf"), kept.alias("kept")), "leaves")
    found, totals = ranked(rows)
    arrays, above, roots = _tree(found, stage(totals, "totals"), fanout)
    # the top tree's one group is a stored column: joins on a constant would become nested loops
    numbered = stage(row_numbers(roots, [], [F.col("g")], "number").withColumn("top", F.lit("")), "subroots")
    tops = numbered.select(F.col("top").alias("g"), (F.col("number") - 1).alias("pos"), "leaf", F.struct("g").alias("kept"))
    top, beyond, root = _tree(tops, tops.groupBy("g").agg(F.count("*").alias("total")), fanout)
    one = root.select(F.lower(F.hex("leaf")).alias("root")).first()
    ends = (_paths(top, beyond, fanout).select(F.col("kept.g").alias("g"), F.col("leaf").alias("subroot"), F.col("path").alias("end")))
    whole = (above.join(ends, "g").select("g", "block", F.concat("path", "end").alias("path"), "subroot"))
    out = _paths(arrays, whole, fanout)
    return out.select(*(F.col(f"kept._{i}").alias(c) for i, c in enumerate(keep)), "leaf", "subroot",
                      F.lit(one and one["root"]).cast("string").alias("root"), "path")
