"""Operator 1 - n-gram Jaccard join by chosen paths.

Documents are sets of word shingles (``n`` words; a shorter text is one
shingle of all its words).  Documents with equal sets are copies: they become
one representative (the smallest id) with a count, so a huge group of copies
is one row from the first shuffle on.

Each representative's set is embedded as ``TOKENS`` min-hash values; value i
is a token shared by two sets with the probability of their similarity.  Then
chosen paths: every run starts from all sets and, level by level, each node
draws tokens at random (each with probability 1 / (threshold * TOKENS), the
same draw for all sets of the node) and sends a set to one child per drawn
token that it holds.  A node of at most ``leaf`` sets is compared by brute
force; larger ones are split again, ``depth`` times at most.  All runs go
through the levels together as rows (path, representative).  The number of
runs follows from the wanted recall for a pair at the threshold.

Nodes that are still large at the last level hold sets that are similar
throughout.  Overlapping ones are merged into dense groups, and a dense
group's pairs are all compared, in two steps.  First inside blocks of about
``BLOCK`` sets (fewer if they are large), where every set gets its block's root;
then in strips: one task holds one block and reads the group's other sets past
it, a chunk at a time, so no task holds the group.  A strip returns a count per
set of its block, and edges from its block roots to those of later blocks, as
many as span the components: two rows a set at most, and about one a pair of
blocks.  A set travels once for each block.

Comparing: leaves with equal members are compared once.  A first look at the
embedded values drops sets without a likely partner (four standard deviations
below the threshold); the whole shingle sets of the others decide exactly.  A
pair that meets in several places counts in the smallest one only, which each
place can tell from its members' lists of places; so links are counted without
ever listing pairs, and each place returns a count per set and the edges of
its own components.

Result: one row per document, with its class (the smallest id among documents
connected by links) and its number of links (documents, copies included).

Cases: texts without words have no links and their own class; null ids are
answered with a null class and 0 links; ids are expected to be unique - rows
that repeat an id count as further copies; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from churnlab.llm.common import aliased, map_texts, stage
from churnlab.llm.decontaminate import words
from churnlab.llm.graph import components

TOKENS = 64
LEAF = 48
#: Sets of a block of a dense group, and the bytes of their shingles.
BLOCK = 1_024
BLOCK_BYTES = 32 << 20
#: Sets of other blocks that a strip compares at once.
CHUNK = 512
DEPTH = 4
#: Word hashes a worker remembers before it starts afresh.
REMEMBERED = 500_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> _S)) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


_SALT = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)


class Shingler:
    """Distinct shingle hashes of texts."""

    def __init__(self, n: int = 5):
        self.n, self.known = n, {}

    def __getstate__(self):
        return self.n

    def __setstate__(self, n):
        self.n, self.known = n, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        parts = [words(t) for t in texts]
        for w in set().union(*parts) - known.keys():
            known[w] = xxhash.xxh3_64_intdigest(w)
        return [self._set(np.fromiter(map(known.__getitem__, p), np.uint64, len(p))) for p in parts]

    def _set(self, w: np.ndarray) -> np.ndarray:
        if not len(w):
            return w
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h = mix(h * _M1 + w[k:len(w) - n + 1 + k])
        return np.unique(h)


def embed(shingles: np.ndarray) -> np.ndarray:
    """Min-hash values, 32 bits each."""
    best = np.full(TOKENS, np.uint32(0xFFFFFFFF))
    for s in range(0, len(shingles), 1024):
        part = shingles[s:s + 1024, None] * _SALT[None]
        np.minimum(best, (part >> np.uint64(32)).astype(np.uint32).min(0), out=best)
    return best


class _Embed:
    def __init__(self, n: int):
        self.shingle = Shingler(n)

    def __call__(self, texts: list[str]) -> dict[str, object]:
        sets = self.shingle(texts)
        some = [len(s) > 0 for s in sets]
        return {"k1": [int(mix(s).sum().astype(np.int64)) if k else None for s, k in zip(sets, some, strict=True)],
                "k2": [int(np.bitwise_xor.reduce(mix(s + _M2)).astype(np.int64)) if k else None
                       for s, k in zip(sets, some, strict=True)],
                "n": [len(s) for s in sets],
                "sig": [embed(s).tobytes() if k else None for s, k in zip(sets, some, strict=True)]}


class _Sets:
    def __init__(self, n: int):
        self.shingle = Shingler(n)

    def __call__(self, texts: list[str]) -> dict[str, object]:
        return {"set": [s.tobytes() for s in self.shingle(texts)]}


def runs_for(recall: float, depth: int) -> int:
    """Runs that find a pair at the threshold with probability ``recall``.

    At the threshold a shared node has one shared child on average, so a run
    reaches level d with probability p(d) = 1 - exp(-p(d - 1)).
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def _children(paths: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for every drawn token that a row's set holds."""
    draw = mix(mix(sig.astype(np.uint64) * _SALT[None]) ^ paths[:, None])
    row, token = np.nonzero(draw < np.uint64(int(2 ** 64 / (threshold * TOKENS))))
    return row, mix(draw[row, token] + _M1)


def _arrow(df: DataFrame, fn: Callable, out: StructType) -> DataFrame:
    """mapInArrow with ``fn(batch) -> arrays``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(fn(b), schema, strict=True)], schema=schema)
    return df.mapInArrow(run, out)


def _sigs(b: pa.RecordBatch, name: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(b.column(name).to_pylist()), np.uint32).reshape(b.num_rows, TOKENS)


def _split(nodes: DataFrame, threshold: float, runs: int = 0) -> DataFrame:
    """(path, rep) of the next level from (path, rep, sig); ``runs``: from roots, (rep, sig)."""
    out = StructType().add("path", "long").add("rep", "long")

    def fn(b: pa.RecordBatch):
        sig, rep = _sigs(b), b.column("rep").to_numpy(zero_copy_only=False)
        found = []
        for s in range(0, len(rep), 512):
            part = sig[s:s + 512]
            if runs:
                paths = [np.full(len(part), mix(np.array([r + 1], np.uint64))[0]) for r in range(runs)]
            else:
                paths = [b.column("path").to_numpy(zero_copy_only=False)[s:s + 512].astype(np.uint64)]
            for p in paths:
                row, child = _children(p, part, threshold)
                found.append((child.astype(np.int64), rep[s:s + 512][row]))
        return (np.concatenate([c for c, _ in found]), np.concatenate([r for _, r in found])) if found else ([], [])

    return _arrow(nodes, fn, out)


def leaves_and_dense(reps: DataFrame, threshold: float, runs: int, depth: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Distinct leaves (unit, members) and the memberships (path, rep) of nodes still large at the last level."""
    rows = stage(_split(reps.select("rep", "sig"), threshold, runs), "paths")
    units = None
    for level in range(depth):
        sizes = rows.groupBy("path").count().where(F.col("count") > 1)
        met = rows.join(sizes, "path")
        if level < depth - 1:
            met = stage(met, "nodes")
        small = (met.where(F.col("count") <= leaf).groupBy("path").agg(F.sort_array(F.collect_set("rep")).alias("members"))
                 .where(F.size("members") > 1).select("members"))
        units = small if units is None else units.unionByName(small)
        large = met.where(F.col("count") > leaf).select("path", "rep")
        if level == depth - 1:
            dense = stage(large, "dense")
        elif large.isEmpty():
            dense = large
            break
        else:
            rows = stage(_split(large.join(reps.select("rep", "sig"), "rep"), threshold), "paths")
    return stage(units.distinct().select(F.xxhash64("members").alias("unit"), "members"), "leaves"), dense


def dense_groups(dense: DataFrame) -> DataFrame:
    """(rep, dense): overlapping large nodes merged, named by their smallest member."""
    first = dense.groupBy("path").agg(F.min("rep").alias("b"))
    star = dense.join(first, "path").select(F.col("rep").alias("a"), "b").distinct()
    return components(star).select(F.col("node").alias("rep"), F.col("label").alias("dense"))


def sorted_groups(df: DataFrame, keys: tuple[str, ...], fn: Callable[[pa.Table], list], out: StructType) -> DataFrame:
    """``fn(rows of one group) -> arrays`` for groups of bounded size, in one pass over rows sorted by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        rest: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(fn(t), schema, strict=True)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                part = b.slice(s, e - s)
                if i == 0 and rest and all(rest[0].column(k)[0] == part.column(k)[0] for k in keys):
                    rest.append(part)
                    continue
                if rest:
                    yield done(pa.Table.from_batches(rest))
                rest = [part]
        if rest:
            yield done(pa.Table.from_batches(rest))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def likely(units: DataFrame, reps: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(unit, rep) of leaf members with a partner that the embedded values don't rule out."""
    least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / TOKENS)
    rows = (units.select("unit", F.explode("members").alias("rep")).join(reps.select("rep", "n", "sig").hint("merge"), "rep")
            .join(groups, "rep", "left").select("unit", "rep", "n", "sig", F.coalesce("dense", F.lit(-1)).alias("dense"),
                                                F.col("dense").isNotNull().alias("in_dense")))
    out = StructType().add("unit", "long").add("rep", "long")

    def fn(t: pa.Table):
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(t.num_rows, TOKENS)
        n = t.column("n").to_numpy().astype(float)
        d, within = t.column("dense").to_numpy(), t.column("in_dense").to_numpy()
        near = (sig[:, None] == sig[None]).mean(2) >= least
        near &= np.minimum(n[:, None], n[None]) >= threshold * np.maximum(n[:, None], n[None]) - 1e-9
        near &= ~((d[:, None] == d[None]) & within[:, None] & within[None])
        np.fill_diagonal(near, False)
        keep = near.any(1)
        return t.column("unit").to_numpy()[keep], t.column("rep").to_numpy()[keep]

    return sorted_groups(rows, ("unit",), fn, out)


def overlaps(sets: list[np.ndarray], chunk: int = 1 << 12) -> np.ndarray:
    """Sizes of all pairwise intersections: products of 0/1 blocks over the shingles that two sets share."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((m, m))
    for s in range(0, int(shared.sum()), chunk):
        a, b = np.searchsorted(col, (s, s + chunk))
        block = np.zeros((m, chunk), np.float32)
        block[row[a:b], col[a:b] - s] = 1
        out += block @ block.T
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return out


def cross_overlaps(mine: list[np.ndarray], others: list[np.ndarray], chunk: int = 1 << 12) -> np.ndarray:
    """Sizes of the intersections of each of ``mine`` with each of ``others``."""
    sides = [(np.repeat(np.arange(len(x)), [len(s) for s in x]), np.concatenate(x)) for x in (mine, others)]
    shared = np.intersect1d(np.unique(sides[0][1]), np.unique(sides[1][1]), assume_unique=True)
    out = np.zeros((len(mine), len(others)))
    if not len(shared):
        return out
    placed = []
    for row, h in sides:
        col = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        known = shared[col] == h
        row, col = row[known], col[known]
        order = np.argsort(col, kind="stable")
        placed.append((row[order], col[order]))
    for s in range(0, len(shared), chunk):
        blocks = []
        for (row, col), x in zip(placed, (mine, others), strict=True):
            a, b = np.searchsorted(col, (s, s + chunk))
            block = np.zeros((len(x), chunk), np.float32)
            block[row[a:b], col[a:b] - s] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    both = overlaps(sets)
    n = np.diag(both)
    link = both >= threshold * (n[:, None] + n[None] - both) - 1e-9
    np.fill_diagonal(link, False)
    return link


def _answer(rep: np.ndarray, copies: np.ndarray, link: np.ndarray, counted: np.ndarray, every: bool = False):
    """Per row with a link (or every row): rep, the smallest rep of its component here, the copies behind its counted links."""
    label = np.arange(len(rep))
    order = np.argsort(rep, kind="stable")
    rank = np.empty(len(rep), np.int64)
    rank[order] = np.arange(len(rep))
    label = rank.copy()
    while True:
        new = np.minimum(label, np.where(link, label[None], len(rep)).min(1, initial=len(rep)))
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    some = link.any(1) | every
    return rep[some], rep[order[label]][some], (counted * copies[None]).sum(1)[some]


_ANSWER = StructType().add("rep", "long").add("root", "long").add("links", "long")


def _sets_of(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]


def compare_leaves(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows``: unit, rep, copies, dense, in_dense, units (places of the rep), set."""
    def fn(t: pa.Table):
        rep, copies, unit = t.column("rep").to_numpy(), t.column("copies").to_numpy(), t.column("unit")[0].as_py()
        d, within = t.column("dense").to_numpy(), t.column("in_dense").to_numpy()
        link = _linked(_sets_of(t), threshold) & (rep[:, None] != rep[None])
        link &= ~((d[:, None] == d[None]) & within[:, None] & within[None])
        counted = link.copy()
        earlier: dict[int, list[int]] = {}
        for i, places in enumerate(t.column("units").to_pylist()):
            for p in places:
                if p < unit:
                    earlier.setdefault(p, []).append(i)
        for met in earlier.values():
            if len(met) > 1:
                counted[np.ix_(met, met)] = False
        return _answer(rep, copies, link, counted)

    return sorted_groups(rows, ("unit",), fn, _ANSWER)


def _blocks(rows: DataFrame) -> DataFrame:
    """Each dense group dealt by hash into blocks of bounded size; ``rows``: dense, rep, copies, set."""
    sizes = rows.groupBy("dense").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("set")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    return rows.join(sizes, "dense").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))


def compare_blocks(placed: DataFrame, threshold: float) -> DataFrame:
    """Per set of a dense group: rep, its root inside its block, and its links there."""
    def fn(t: pa.Table):
        rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        link = _linked(_sets_of(t), threshold) & (rep[:, None] != rep[None])
        return _answer(rep, copies, link, link, every=True)

    return sorted_groups(placed.select("dense", "block", "rep", "copies", "set"), ("dense", "block"), fn, _ANSWER)


class _Strip:
    """One block of a dense group and the group's other sets, which are read past it."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.rep: list[int] = []
        self.root: list[int] = []
        self.sets: list[np.ndarray] = []
        self.links = np.zeros(0, np.int64)
        self.up: dict[int, int] = {}

    def _top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def take(self, t: pa.Table) -> None:
        own, later = t.column("own").to_numpy(), t.column("later").to_numpy()
        rep, root, copies = (t.column(c).to_numpy() for c in ("rep", "root", "copies"))
        sets = _sets_of(t)
        at = np.flatnonzero(own)
        if len(at):
            self.rep += rep[at].tolist()
            self.root += root[at].tolist()
            self.sets += [sets[i] for i in at]
            self.links = np.zeros(len(self.rep), np.int64)
        other = np.flatnonzero(~own) if self.sets else at[:0]       # hashing may leave a block empty
        for s in range(0, len(other), CHUNK):
            part = other[s:s + CHUNK]
            both = cross_overlaps(self.sets, [sets[i] for i in part])
            n = np.array([len(x) for x in self.sets])[:, None] + np.array([len(sets[i]) for i in part])[None]
            link = both >= self.threshold * (n - both) - 1e-9
            self.links += link @ copies[part]
            i, j = np.nonzero(link & later[part][None])     # each pair of blocks joins in the earlier one's strip
            for a, b in set(zip(np.array(self.root)[i].tolist(), root[part][j].tolist(), strict=True)):
                low, high = sorted((self._top(a), self._top(b)))
                self.up[high] = low

    def rows(self) -> tuple[list, list, list]:
        """Counts of the block's sets, then the edges that span the components met here."""
        edges = [(x, self._top(x), 0) for x in self.up]
        counts = [(r, t, n) for r, t, n in zip(self.rep, self.root, self.links.tolist(), strict=True) if n]
        return tuple(map(list, zip(*(counts + edges), strict=True))) if counts or edges else ([], [], [])


def compare_strips(placed: DataFrame, inside: DataFrame, threshold: float) -> DataFrame:
    """Links between the blocks of dense groups: a count per set, and edges between block roots."""
    rooted = (placed.where(F.col("blocks") > 1)
              .join(inside.select("rep", "root").hint("merge"), "rep"))
    strips = (rooted.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("strip"))
              .select("dense", "strip", (F.col("block") == F.col("strip")).alias("own"),
                      (F.col("block") > F.col("strip")).alias("later"), "rep", "root", "copies", "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(_ANSWER)
        at, strip = None, _Strip(threshold)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(strip.rows(), schema, strict=True)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            ids = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in ("dense", "strip")])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if (here := (int(ids[0, s]), int(ids[1, s]))) != at:
                    if at is not None:
                        yield done()
                    at, strip = here, _Strip(threshold)
                strip.take(pa.Table.from_batches([b.slice(s, e - s)]))
        if at is not None:
            yield done()

    return (strips.repartition("dense", "strip").sortWithinPartitions("dense", "strip", F.col("own").desc())
            .mapInArrow(run, _ANSWER))


def compare_dense(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows``: dense, rep, copies, set - all pairs of each dense group, in blocks and strips."""
    placed = stage(_blocks(rows), "blocks")
    inside = stage(compare_blocks(placed, threshold), "inside")
    return inside.unionByName(compare_strips(placed, inside, threshold))


def near_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.998, depth: int = DEPTH,
                 leaf: int = LEAF) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs`` (doc_id long, text)."""
    sigs = stage(map_texts(docs, _Embed(n), "k1 long, k2 long, n long, sig binary"), "signatures")
    real = F.col("doc_id").isNotNull() & F.col("k1").isNotNull()
    reps = stage(sigs.where(real).groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "reps")
    units, dense = leaves_and_dense(reps, threshold, runs_for(recall, depth), depth, leaf)
    groups = dense_groups(dense)
    found = stage(likely(units, reps, groups, threshold), "likely")

    needed = found.select("rep").unionByName(groups.select("rep")).distinct()
    # texts, signatures and sets meet by sort-merge at every size: their sides grow with the corpus
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(needed.hint("merge"), "rep")
    sets = stage(map_texts(texts, _Sets(n), "set binary", ("rep",)).groupBy("rep").agg(F.max("set").alias("set"))
                 .join(reps.select("rep", "copies"), "rep"), "sets")

    places = found.groupBy("rep").agg(F.sort_array(F.collect_set("unit")).alias("units"))
    in_leaves = (found.join(sets.join(places, "rep").join(groups, "rep", "left").hint("merge"), "rep")
                 .select("unit", "rep", "copies", F.coalesce("dense", F.lit(-1)).alias("dense"),
                         F.col("dense").isNotNull().alias("in_dense"), "units", "set"))
    in_dense = sets.join(groups, "rep").select("dense", "rep", "copies", "set")
    links = stage(compare_leaves(in_leaves, threshold).unionByName(compare_dense(in_dense, threshold)), "links")

    label = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (reps.select("k1", "k2", "rep", "copies").join(counts, "rep", "left")
               .join(label.withColumnRenamed("node", "rep"), "rep", "left")
               .select("k1", "k2", F.coalesce("label", "rep").alias("class_id"),
                       (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    inside = sigs.where(real).select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "class_id", "n_links")
    outside = sigs.where(~real).select("doc_id", F.when(F.col("k1").isNull(), F.col("doc_id")).alias("class_id"),
                                       F.lit(0).cast("long").alias("n_links"))
    return inside.unionByName(outside)


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest id; rows with a null id stay."""
    found = near_classes(docs.select("doc_id", "text"), **options)
    kept = (found.where(F.col("doc_id") == F.col("class_id")).groupBy(F.col("doc_id").alias("_id"))
            .agg(F.count("*").alias("_rows")))
    plain, back = aliased(docs)
    rows = plain.join(kept, F.col(back("doc_id")) == F.col("_id"))
    once = rows.where(F.col("_rows") == 1).select(*plain.columns)
    again = rows.where(F.col("_rows") > 1).select(*plain.columns).dropDuplicates([back("doc_id")])
    every = once.unionByName(again).unionByName(plain.where(F.col(back("doc_id")).isNull()))
    return every.select(*(F.col(back(c)).alias(c) for c in docs.columns))
