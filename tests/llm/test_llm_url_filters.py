"""Operator 13: longest entries against a plain scan of all entries, blocks, odd addresses."""

import random

import pytest

from churnlab.llm import url_filters
from churnlab.llm.queries import RULES

ENTRIES = "host string, path string, verdict string"


def plain(url, entries, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h.split(".")) if h else 0, len(p), h + p, v) for h, p, v in entries
            if (not h or ("." + host).endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def made(rng):
    names = ["net", "com", "a.net", "b.a.net", "x.com", "", "A.Net"]
    segments = ["", "en", "en2", "e", "x"]
    host, path = rng.choice(names), "/" * rng.randint(0, 1) + "/".join(rng.choice(segments) for _ in range(rng.randint(0, 3)))
    return host, path


@pytest.mark.parametrize("block_entries", [200_000, 5])
def test_longest_entry_wins(spark, block_entries):
    rng = random.Random(block_entries)
    entries = {(h.lower(), p): rng.choice(["allow", "block"]) for h, p in (made(rng) for _ in range(25))}
    entries = [(h, p, v) for (h, p), v in entries.items()]
    pages = []
    for i in range(300):
        host, path = made(rng)
        pages.append((i, f"http://{rng.choice(['', 'm.', 'q.b.'])}{host}{path}{rng.choice(['', '?q=/en/', '#top', '/en/?x#y'])}"))
    got = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(entries, ENTRIES),
                            block_entries=block_entries).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain(u, entries) for i, u in pages}


ODD = [None, "", "no scheme/en/", "http://", "https://EXAMPLE.net/en/1", "http://example.net", "http://example.net/en", "x://net/a://b.net/",
       "http://user@host.org:80/fr/", "http://host.org/fr/?a#b", "http://net", "http://net?x", "http://.net/", "http://example.com./de/",
       "http://example.com/de/" + "x" * 300_000, "http://notexample.com/de/", "http://\u00dc.org/fr/"]


def test_odd_addresses_and_contract(spark):
    pages = [(i, u, "clash", None) for i, u in enumerate(ODD)] + [(None, ODD[4], None, None), (4, ODD[4], None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES, ENTRIES)
    got = url_filters.judge(df, rules).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(
        ((i, *plain(u, RULES)) for i, u, _, _ in pages), key=str)
    kept = url_filters.keep_allowed(df, rules)
    assert kept.columns == df.columns and kept.count() == sum(plain(u, RULES)[3] == "allow" for _, u, _, _ in pages)
    assert url_filters.judge(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filters.judge(df, rules, keep=("host",))


def test_odd_entries(spark):
    entries = [("net", None, "allow"), ("NET", "", "block"), (None, "/", "block"), ("com", "/", "maybe"), ("", "/x", "block")]
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://a.com/"), (3, "http://q/x")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, spark.createDataFrame(entries, ENTRIES)).collect()}
    assert got == {1: ("net", "block"), 2: (None, "allow"), 3: ("/x", "block")}
    none = spark.createDataFrame([], ENTRIES)
    assert {r.verdict for r in url_filters.judge(pages, none, default="block").collect()} == {"block"}
