"""Operator 4 - benchmark decontamination by Wu-Manber multi-pattern search.

Texts are word sequences (A-Z lower-cased, runs of digits, a-z and characters
beyond ASCII).  Each item's windows of ``window`` consecutive words are the
test strings; an item with fewer words is one window.  For windows of one
length m the searcher keeps

* a shift table over blocks of two neighbouring words: how far the search
  may jump when the block ends the current position (m - 1 if no window has
  it, 0 if some window ends with it),
* buckets of windows by their last block, with a hash of their first words,

and reads a document at the jump positions only; each candidate of a bucket
is compared with the document's words directly.

The windows of all items are dealt into blocks of at most ``block_windows``
(window, item) pairs by hash.  One block is collected and broadcast at a time
and searched in one narrow pass over the documents, so the broadcast is
bounded whatever the benchmark's size; a larger benchmark takes more passes.
Documents are never shuffled, so hot sources and groups of copies don't matter.

Cases: null and empty texts have no words and no hits; items without words
have no windows; repeated items count once per item id, items with a null id
are ignored; repeated documents are answered row by row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.llm.common import aliased, map_texts, stage

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: (window, item) pairs searched in one pass; about 300 bytes each in a worker.
BLOCK_WINDOWS = 400_000


def words(text: str) -> list[str]:
    """Words of a text; lower-casing its bytes changes A-Z only."""
    return WORD.findall(text.encode().lower().decode())


class Searcher:
    """Shift and suffix tables for the windows of one length."""

    def __init__(self, windows: list[tuple[str, ...]]):
        m = self.m = len(windows[0])
        block = self.block = min(2, m)
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[tuple[str, ...], dict[tuple[str, ...], list[tuple[str, ...]]]] = {}
        for w in windows:
            for end in range(block, m + 1):
                key = w[end - block:end]
                self.shift[key] = min(m - end, self.shift.get(key, m))
            self.buckets.setdefault(w[m - block:], {}).setdefault(w[:block], []).append(w)
        self.jump = m - block + 1

    def find(self, ws: list[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(start, window) of every occurrence."""
        m, block, jump, shift = self.m, self.block, self.jump, self.shift
        if block == 1:
            known = shift.keys()
            for i, w in enumerate(ws):
                if (w,) in known:
                    yield i, (w,)
            return
        at, n = m, len(ws)
        while at <= n:
            s = shift.get((ws[at - 2], ws[at - 1]), jump)
            if s:
                at += s
                continue
            start = at - m
            same = self.buckets[ws[at - 2], ws[at - 1]].get((ws[start], ws[start + 1]))
            if same:
                here = tuple(ws[start:at])
                for w in same:
                    if w == here:
                        yield start, w
            at += 1


class _Block:
    """One block's windows, broadcast; its searchers are built once per worker."""

    def __init__(self, broadcast):
        self.broadcast, self.ready = broadcast, None

    def __call__(self, texts: list[str]) -> dict[str, object]:
        if self.ready is None:
            items: dict[tuple[str, ...], list[str]] = {}
            for joined, item in self.broadcast.value:
                items.setdefault(tuple(joined.split(" ")), []).append(item)
            by_length: dict[int, list[tuple[str, ...]]] = {}
            for w in items:
                by_length.setdefault(len(w), []).append(w)
            self.ready = [Searcher(w) for w in by_length.values()], items
        searchers, items = self.ready
        counts, spans, found = [], [], []
        for t in texts:
            ws = words(t)
            hits: set[str] = set()
            ranges: list[tuple[int, int]] = []
            for s in searchers:
                for start, w in s.find(ws):
                    ranges.append((start, start + s.m))
                    hits.update(items[w])
            counts.append(len(ws))
            spans.append(_merge(ranges))
            found.append(sorted(hits))
        return {"n_words": counts, "spans": [[{"start": a, "end": b} for a, b in s] for s in spans], "items": found}


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def benchmark_windows(benchmark: DataFrame, window: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (joined, item): every window of every item, words joined by a space; built in SQL."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return (benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), w.alias("w"))
            .where(F.size("w") > 0)
            .select("item", "w", F.explode(starts).alias("s"))
            .select(F.array_join(F.slice("w", F.col("s"), window), " ").alias("joined"), "item").distinct())


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = BLOCK_WINDOWS,
               keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, n_words, spans (word ranges of occurrences, end exclusive, sorted) and items (ids, sorted)."""
    pairs = benchmark_windows(benchmark, window)
    n_blocks = max(1, math.ceil(pairs.count() / block_windows))
    if n_blocks > 1:  # hashing deals unevenly: aim a little lower than the bound
        n_blocks = math.ceil(n_blocks * 1.05) + 1
        pairs = stage(pairs.withColumn("block", F.pmod(F.xxhash64("joined", "item"), F.lit(n_blocks))), "windows")
    sc = docs.sparkSession.sparkContext
    out = docs.select(*keep, F.col(text).alias("_text"),
                      F.lit(None).cast("array<struct<start:int,end:int>>").alias("_spans"),
                      F.lit(None).cast("array<string>").alias("_items"))
    for b in range(n_blocks):
        mine = pairs if n_blocks == 1 else pairs.where(F.col("block") == b)
        known = sc.broadcast([(r.joined, r.item) for r in mine.select("joined", "item").collect()])
        last = b + 1 == n_blocks
        schema = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"
        out = map_texts(out, _Block(known), schema, (*keep, "_spans", "_items", *(() if last else ("_text",))), "_text")
        out = out.withColumns({
            "spans": F.sort_array(F.concat(F.coalesce("_spans", F.array().cast("array<struct<start:int,end:int>>")), "spans")),
            "items": F.sort_array(F.array_union(F.coalesce("_items", F.array().cast("array<string>")), "items"))})
        if not last:
            out = stage(out.drop("n_words", "_spans", "_items")
                        .withColumnsRenamed({"spans": "_spans", "items": "_items"}), "searched")
    return out.select(*keep, "n_words", "spans", "items")


def words_in(spans: str = "spans") -> Column:
    """Words that lie in at least one of the sorted ranges."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    grown = F.aggregate(F.col(spans), start, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"),
        F.greatest(a["to"], s["end"]).alias("to")))
    return grown["n"].cast("long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window; all columns kept."""
    plain, back = aliased(docs)
    found = find_items(plain, benchmark, keep=tuple(plain.columns), text=back("text"), **options)
    return found.where(F.size("spans") == 0).select(*(F.col(back(c)).alias(c) for c in docs.columns))
