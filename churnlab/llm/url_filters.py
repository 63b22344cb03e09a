"""Operator 13 - allow and block lists for page addresses.

Entries (host, path, verdict) form a trie: host labels from the last to the
first, then, at the node of a host, the path's segments.  The path's last
segment is a beginning (``/en/`` ends in the empty one), so an entry fits an
address if its labels are the host's last labels and its path is the start of
the address's path, character by character.  The longest fitting entry wins:
most labels, then the longest path; the walk meets fitting entries in that
order.

Entries are merged in Spark, so that one (host, path) remains once, and sent to
the workers as tries of at most ``block_entries`` entries and ``BLOCK_BYTES``
bytes of text.  A longer list is a sequence of such tries: each pass keeps the
longest entry so far, passes are cut by a stored table.  Pages are never
shuffled, so a host that holds a third of them costs nothing extra.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  Ports, user names
and a last dot are part of the host as written.

Cases: a null address or one without ``://`` has an empty host and path, which
only an entry with both empty fits.  An entry with an empty host fits every
host; a null path counts as empty; entries with a null host or a verdict other
than allow and block are left out; of two entries with equal host and path,
block wins.  Addresses that no entry fits get a null rule and ``default``.
Repeated pages get equal answers, empty pages give an empty result, an empty
list gives ``default`` everywhere.
"""

from __future__ import annotations

import math
import re

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.llm.common import aliased, map_texts, stage

BLOCK_ENTRIES = 200_000
BLOCK_BYTES = 32 << 20
#: The longest entry found: labels, path characters, the entry, its verdict.  Structs compare in this order.
BEST = "struct<labels:int,length:int,rule:string,verdict:string>"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")


def split_url(url: str) -> tuple[str, str]:
    """Host and path; both empty without ``://``."""
    m = _PARTS.search(url)
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class _Paths:
    """Paths of one host: a node per whole segment, with the beginnings of a next segment that end an entry."""

    __slots__ = ("next", "ends", "lengths")

    def __init__(self):
        self.next: dict[str, _Paths] = {}
        self.ends: dict[str, tuple] = {}
        self.lengths: list[int] = []

    def put(self, path: str, entry: tuple) -> None:
        node = self
        *whole, last = path.split("/")
        for s in whole:
            node = node.next.setdefault(s, _Paths())
        node.ends[last] = entry
        node.lengths = sorted({*node.lengths, len(last)}, reverse=True)

    def longest(self, path: str) -> tuple | None:
        node, found = self, None
        for s in path.split("/"):
            for n in node.lengths:
                if n <= len(s) and (entry := node.ends.get(s[:n])):
                    found = entry
                    break
            node = node.next.get(s)
            if node is None:
                break
        return found


class Trie:
    """Entries by reversed host labels, then path."""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.root: tuple[dict, list] = ({}, [])
        for host, path, verdict in entries:
            labels = host.split(".") if host else []
            node = self.root
            for label in reversed(labels):
                node = node[0].setdefault(label, ({}, []))
            if not node[1]:
                node[1].append(_Paths())
            node[1][0].put(path, (len(labels), len(path), host + path, verdict))

    def paths_of(self, host: str) -> list[_Paths]:
        """Path tries of the hosts that ``host`` lies in, the longest first."""
        node, found = self.root, list(self.root[1])
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            found += node[1]
        return found[::-1]

    def longest(self, host: str, path: str) -> tuple | None:
        for paths in self.paths_of(host):
            if entry := paths.longest(path):
                return entry
        return None


class _Match:
    def __init__(self, entries: Broadcast):
        self.entries, self.trie = entries, None

    def __getstate__(self):
        return self.entries

    def __setstate__(self, entries):
        self.entries, self.trie = entries, None

    def __call__(self, texts: list[str]) -> dict[str, object]:
        if self.trie is None:
            self.trie = Trie(self.entries.value)
        parts = [split_url(t) for t in texts]
        best = [self.trie.longest(h, p) for h, p in parts]
        names = ("labels", "length", "rule", "verdict")
        return {"host": [h for h, _ in parts], "path": [p for _, p in parts],
                "best": [b and dict(zip(names, b, strict=True)) for b in best]}


def entries_of(rules: DataFrame) -> DataFrame:
    """(host, path, verdict): usable entries, each host and path once; block wins."""
    return (rules.where(F.col("host").isNotNull() & F.col("verdict").isin("allow", "block"))
            .groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
            .agg(F.max("verdict").alias("verdict")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", block_entries: int = BLOCK_ENTRIES,
          keep: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """``keep`` columns, host, path, rule (host and path of the entry) and verdict."""
    if clash := {"host", "path", "rule", "verdict"} & {*keep}:
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    entries = stage(entries_of(rules), "entries")
    n, size = entries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
    n_blocks = max(1, math.ceil(n / block_entries), math.ceil(size / BLOCK_BYTES))
    if n_blocks > 1:  # hashing deals unevenly: aim a little lower than the bound
        n_blocks = math.ceil(n_blocks * 1.05) + 1
        entries = entries.withColumn("block", F.pmod(F.xxhash64("host", "path"), F.lit(n_blocks)))
    sc = pages.sparkSession.sparkContext
    kept = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)]
    names = [f"_k{i}" for i in range(len(keep))]
    out = pages.select(*kept, F.col(url).alias("_url"), F.lit(None).cast(BEST).alias("_best"))
    for b in range(n_blocks):
        mine = entries if n_blocks == 1 else entries.where(F.col("block") == b)
        known = sc.broadcast([(r.host, r.path, r.verdict) for r in mine.collect()])
        last = b + 1 == n_blocks
        out = map_texts(out, _Match(known), f"host string, path string, best {BEST}",
                        (*names, "_best", *(() if last else ("_url",))), "_url")
        out = out.withColumn("best", F.greatest("_best", "best"))
        if not last:
            out = stage(out.select(*names, "_url", F.col("best").alias("_best")), "matched")
    return out.select(*(F.col(a).alias(k) for a, k in zip(names, keep, strict=True)), "host", "path",
                      F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, url: str = "url", **options) -> DataFrame:
    """The pages whose verdict is allow; all columns kept."""
    plain, back = aliased(pages)
    found = judge(plain, rules, keep=tuple(plain.columns), url=back(url), **options)
    return found.where(F.col("verdict") == "allow").select(*(F.col(back(c)).alias(c) for c in pages.columns))
