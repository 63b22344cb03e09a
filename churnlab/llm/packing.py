"""Operator 5 - packing of token sequences by the sum-of-squares rule.

``token_pieces`` turns each document into token ids plus an end id and cuts
it into pieces of at most ``size``.  White space separates words for good in
the tokenizer used, so a worker encodes each distinct word once and strings
the ids together; texts where that could differ are encoded whole.

``assign_sequences`` packs the pieces.  Full pieces are sequences of their
own.  The others are dealt into shards of about SHARD_PIECES by row number
(not by document, so neither a hot source nor repeated rows make a shard
large) and each shard is packed by itself: pieces come longest first; each
goes to the open bin for which the sum over residual gaps of (open bins with
that gap) squared becomes smallest - the tighter bin on ties - and a new bin
opens only when no open one has room.  Bins are counted by gap, so a step is
one array operation of length ``size`` and memory is the shard.  A shard
wastes less than one sequence on top of what packing everything at once would.

Cases: a null or empty text is the end id alone; repeated rows are packed once
each; an empty table gives an empty result.  ``keep`` columns may be null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from churnlab.llm.common import slices, stage, texts_of

#: Pieces that one task packs together.
SHARD_PIECES = 20_000
#: Words whose ids a worker remembers before it starts afresh.
REMEMBERED = 500_000
#: Texts that are encoded whole: characters that Python alone takes for white
#: space, the separator used below, and what may begin a special token.
_WHOLE = re.compile("[\x00\x1c-\x1f]|<\\|")
#: Marks behind a letter or digit at a word's end are words of their own to the tokenizer.
_MARKS = re.compile(r"([A-Za-z0-9À-ÖØ-öø-ÿ])([.,!?;:|#*$%&]+)(?!\S)")


def _words(text: str) -> list[str]:
    """Words whose ids, strung together, are the text's; A-Z lower-cased as the tokenizer does."""
    return _MARKS.sub(r"\1 \2", text.encode().lower().decode()).split()


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class WordEncoder:
    """ids of whole texts, each distinct word encoded once."""

    def __init__(self, path: str, end_id: int | None = 0):
        self.path, self.end = path, end_id
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, words: list[str], together: int = 2000) -> None:
        """Encode new words, many in one text, a NUL (one id) before each of them."""
        tokenizer = _tokenizer(self.path)
        nul = tokenizer.encode("\0", add_special_tokens=False).ids[0]
        joined = ["\0 " + " \0 ".join(words[i:i + together]) for i in range(0, len(words), together)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        at = np.flatnonzero(ids == nul)
        self.starts = np.r_[self.starts, len(self.flat) + at + 1]
        self.lengths = np.r_[self.lengths, np.diff(np.r_[at, len(ids)]) - 1]
        self.flat = np.r_[self.flat, ids]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        parts = [None if _WHOLE.search(t) else _words(t) for t in texts]
        new = list(set().union(*(p for p in parts if p)) - self.known.keys())
        if new:
            self._learn(new)
        return [self._ids(t, p) for t, p in zip(texts, parts, strict=True)]

    def _ids(self, text: str, words: list[str] | None) -> np.ndarray:
        if words is None:
            ids = np.array(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            lengths = self.lengths[at]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.arange(total) + np.repeat(self.starts[at] - (ends - lengths), lengths)]
        return ids if self.end is None else np.append(ids, np.uint32(self.end))


def token_pieces(docs: DataFrame, tokenizer_file: str, size: int = 2048, end_id: int = 0,
                 keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, piece, start, length and ids (little-endian unsigned 32-bit numbers)."""
    src = docs.select(*dict.fromkeys((*keep, text)))
    out = src.select(*keep).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")
    encode = WordEncoder(tokenizer_file, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for b in slices(batches, text):
            row, piece, start, length, ids = [], [], [], [], []
            for i, t in enumerate(encode(texts_of(b, text))):
                for k, s in enumerate(range(0, len(t), size)):
                    part = t[s:s + size]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    ids.append(part.astype("<u4").tobytes())
            at = pa.array(row, pa.int64())
            cols = [b.column(k).take(at) for k in keep] + [piece, start, length, ids]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                                              for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return src.mapInArrow(run, out)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, by the rule in the module's docstring."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = np.zeros(size + 1, np.int64)       # open bins per gap
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    made = 0
    never = 1 << 60
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        have = n[s:size]
        k = -1
        if have.any():
            change = 2 * (n[:size - s] - have) + 2
            change[0] = 1 - 2 * have[0]     # a filled bin is no longer open
            change[have == 0] = never
            k = int(change.argmin())
        if k >= 0:
            gap = s + k
            b = bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b = size, made
            made += 1
        where[i], offset[i] = b, size - gap
        if gap > s:
            bins[gap - s].append(b)
            n[gap - s] += 1
    return where, offset


def assign_sequences(pieces: DataFrame, size: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (with a length column) plus sequence_id and offset (both long).

    Reads ``pieces`` twice: pass a stored table.  Every piece must be at most ``size`` long.
    """
    numbered = pieces.withColumn("sequence_id", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") == size).select(
        *pieces.columns, (-1 - F.col("sequence_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.where(F.col("length") < size)
    shards = max(1, math.ceil(pieces.where(F.col("length") < size).count() / shard_pieces))
    dealt = rest.withColumn("_shard", F.pmod(F.xxhash64("sequence_id"), F.lit(shards))).drop("sequence_id")
    out = dealt.drop("_shard").schema.add("sequence_id", "long").add("offset", "long")

    def pack(group: pa.Table) -> pa.Table:
        where, offset = sum_of_squares(group.column("length").to_numpy(), size)
        where += group.column("_shard")[0].as_py() << 40
        t = group.drop_columns(["_shard"])
        return t.append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))

    return full.unionByName(dealt.groupBy("_shard").applyInArrow(pack, out))


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence; ``placed`` must still hold ids.

    A group is one sequence, at most ``size`` tokens.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_file: str, size: int = 2048, keep: tuple[str, ...] = ("doc_id",),
                   text: str = "text") -> DataFrame:
    """``keep`` columns, piece, start, length, ids_crc32, sequence_id, offset for every document.

    The ids themselves stay out of the stored pieces: readers that need them
    call ``assign_sequences`` on ``token_pieces`` directly.
    """
    pieces = token_pieces(docs, tokenizer_file, size, keep=keep, text=text)
    pieces = stage(pieces.select(*keep, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return assign_sequences(pieces, size)
