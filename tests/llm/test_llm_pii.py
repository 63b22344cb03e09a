"""Operator 3: base patterns against plain regular expressions, propagation against enumeration."""

import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from churnlab.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


SAMPLES = ["a@b.c.d@e.f g@h", "x@y.z-@q.r", "1.2.3.4.5 256.1.1.1 001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112 ٣",
           "+49 (151) 23-45 678 901) +1", "@a.b", "é.x@y.zé", "++12345678901 +1234567890 1 2", "1" * 400, "a.b+c%d@e--.f", ""]


def test_base_same_as_plain_patterns():
    rnd = random.Random(5)
    texts = SAMPLES + ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 50)))
                       for a in ("ab@.-1 ", "0123456789 -+.", "12.5 ", "+1 2()3.") for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_are_linear():
    for t in ("1" * 500_000, "a" * 500_000 + "@", "1." * 200_000, "+1 " * 100_000, "@" * 300_000, "a@" * 200_000, "1 " * 200_000):
        pii.find([t], pii.SkipChain.prior())


def test_propagation_exact_on_trees():
    rng = np.random.default_rng(0)
    f = pii.SkipChain(rng.normal(size=(pii.N_FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    emit = rng.normal(size=(5, 5))
    edges = (np.array([0, 1, 1, 3]), np.array([1, 2, 3, 4]), np.array([0, 1, 0, 1]))
    want = np.zeros((5, 5))
    for y in itertools.product(range(5), repeat=5):
        z = sum(emit[i, k] for i, k in enumerate(y))
        z += sum((f.skip if s else f.chain)[y[a], y[b]] for a, b, s in zip(*edges, strict=True))
        for i, k in enumerate(y):
            want[i, k] += np.exp(z)
    got = f.beliefs(emit, edges, rounds=200)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-3)


def test_consistency_within_a_document(spark):
    call = "Call +49 151 2345678 now."
    docs = [f"{call} Or 0151 2345678, word word. Ref 99887766554.", "0151 2345678 alone", "mail jane.roe@site.org or jane.roe please"]
    train = [call, "mail a.b@c.de", "host 10.0.0.1", "card 4111 1111 1111 1111", "id 99887766554", "no 12345678", "ticket 5550001112", "desk 0160 9876543"] * 20
    field = pii.train([pii.nodes_of(t, pii.base_spans(t)) for t in train])
    extra = [[t[a:b] for a, _, b, base in s if not base] for t, s in zip(docs, pii.find(docs, field), strict=True)]
    assert extra == [["0151 2345678"], [], ["jane.roe"]]


def test_query_and_odd_rows(spark, tmp_path):
    from churnlab.llm.queries import op3_pii
    texts = [*SAMPLES, None, "x " * 50_000 + "a@b.c"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a@b.c", None), (1, SAMPLES[1], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = op3_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain((texts[r.doc_id] if r.doc_id is not None else "a@b.c") or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    field = pii.SkipChain.prior()
    none = df.where(F.lit(False))
    assert pii.find_personal(none, pii.fit(none)).count() == 0
    masked = pii.redact(df, field)
    assert masked.columns == df.columns
    assert {r.text for r in masked.where("doc_id = 1").collect()} == {"[EMAIL]@q.r"}
    assert [r.text for r in masked.where(f"doc_id = {len(SAMPLES)}").collect()] == [None]


def test_consistency_over_many_repeats():
    call = "Call +49 151 2345678 now."
    train = [call, "mail a.b@c.de", "host 10.0.0.1", "card 4111 1111 1111 1111", "id 99887766554", "no 12345678", "ticket 5550001112", "desk 0160 9876543"] * 20
    field = pii.train([pii.nodes_of(t, pii.base_spans(t)) for t in train])
    again = "Or 0151 2345678, word word. " * 50
    mixed = "Or 0151 2345678, word. Ref 99887766554. " * 50
    mail = "Ask jane.roe or desk 0160 9876543. " * 50
    texts = [call + " " + again, again + call, again + call + " " + again, mixed + call, mail + "mail jane.roe@site.org", again]
    found = pii.find(texts, field)
    assert [sum(not base for *_, base in s) for s in found] == [50, 50, 100, 50, 50, 0]
    assert all(text[a:b] in ("0151 2345678", "jane.roe") for text, s in zip(texts, found, strict=True) for a, _, b, base in s if not base)
    assert found == [pii.find([t], field)[0] for t in texts]      # no text depends on its batch


def test_every_text_converges():
    field = pii.SkipChain(np.zeros((pii.N_FEATURES, 5)), 9.0 * np.eye(5), 6.0 * np.eye(5))
    emit = np.zeros((60, 5))
    emit[0, 1] = 50.0
    a = np.arange(59)
    p = field.beliefs(emit, (a, a + 1, np.zeros(59, np.int64)))      # a chain of 60: evidence moves one node a round
    assert p[59, 1] > .9


def test_features_see_whole_tokens():
    from churnlab.llm import pii
    token = "1" * 90 + "@" + "x" * 5
    flags = pii._features(token, 0, len(token))
    assert 13 in flags                              # the @ lies after the 90th character
    assert pii._over_255("256") and pii._over_255("0" * 9000 + "300") and pii._over_255("9" * 9000)
    assert not any(map(pii._over_255, ("255", "000", "0" * 5000 + "7", "x300", "")))
