"""Operator 5: ids against the tokenizer on whole texts, and every rule of a valid packing."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnlab.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    return [e.ids + [0] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_ids_same_as_whole_texts():
    rnd = random.Random(2)
    odd = ["", " ", "a\x1cb \x1f c", "x<|endoftext|>y <|startoftext|>", "ΟΔΟΣ ΟΔΟΣ.", "é ́a b c　", "don't we'll 's",
           "日本語 ไทย 한글", "\x85a\x0bb", "İI ß", "a" * 3000, "﷽  x"]
    odd += ["a.́ b.,!", "x<|ENDOFTEXT|>", "q\0 z", "don.t. it.s.", "é. ł. 5, ½."]
    odd += ["".join(rnd.choice("abT.,|'é́ \n\x1d.1٣日😀Σσ ") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    assert [x.tolist() for x in P.WordEncoder(PATH)(odd)] == ids_of(odd)


def check(rows, docs, size):
    want = {i: ids_of([t or ""])[0] for i, t in docs.items()}
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, ids in want.items():
        cut = [ids[s:s + size] for s in range(0, len(ids), size)]
        assert sorted(got[i]) == [(k, k * size, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(bins), -(-sum(r.length for r in rows) // size)


def test_whole_table(spark):
    from conftest import SF001
    from churnlab.llm.queries import op5_best_fit_packing
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    used, least = check(op5_best_fit_packing(spark, SF001).collect(), docs, 2048)
    assert used <= least * 1.02 + 1


def test_edge_rows_small_size_and_shards(spark):
    docs = {0: None, 1: "", 2: "word " * 97, 3: "a b c", 4: "a b c", 5: "x " * 31, None: "null id"}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, length int")
    pieces = P.token_pieces(df, PATH, 32)
    stored = spark.createDataFrame(pieces.withColumn("ids_crc32", F.crc32("ids")).collect())
    for shard in (2, 1000):
        placed = P.assign_sequences(stored, 32, shard)
        used, least = check(placed.collect(), docs, 32)
        assert used >= least
        joined = P.packed_sequences(placed).collect()
        assert len(joined) == used and sum(len(r.ids) // 4 for r in joined) == sum(r.length for r in stored.collect())
    assert P.pack_documents(df.where(F.lit(False)), PATH).count() == 0
    assert len(P.pack_documents(df.union(df), PATH).collect()) == 2 * len(P.pack_documents(df, PATH).collect())


def test_sum_of_squares_rule():
    """Each step leaves the smallest sum of squares among the open bins with room."""
    rnd = random.Random(4)
    lengths = np.array([rnd.randint(1, 19) for _ in range(120)])
    where, offset = P.sum_of_squares(lengths, 20)
    left, made = {}, set()
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        s = lengths[i]
        room = {b: g for b, g in left.items() if g >= s}

        def cost(b, s=s):
            gaps = list({**left, b: left.get(b, 20) - s}.values())
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g)

        if room:
            assert where[i] in room and cost(where[i]) == min(map(cost, room))
        else:
            assert where[i] not in made
        assert offset[i] == 20 - left.get(where[i], 20)
        made.add(where[i])
        left[where[i]] = left.get(where[i], 20) - s
