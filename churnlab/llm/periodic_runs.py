"""Operator 11 - periodic runs of words, by recursive frequency splitting and a lag scan.

A run is a longest stretch of consecutive words in which words ``q`` places
apart are equal, with q its smallest such distance, at least ``min_length`` and
``min_exponent`` * q words long.

Splitting: every word of a run occurs ``min_exponent`` times or more inside it,
so a word that occurs less often in a segment belongs to no run of that segment
and splits it.  Parts shorter than ``min_length`` go; parts are counted anew
until none splits.  All texts of a batch are split together: the words' places
are sorted once by word, and each round only counts the segments that the last
round changed.

Lag scan: the surviving segments are compared with themselves ``q`` words on;
stretches of equal words are the runs.  Which lags a segment needs is read from
windows of 1, 2, 4, .. words (numbered by doubling, as pairs of half windows):
inside a run of period q, a window of k words, q <= k < 2q, comes again exactly
q words later, at every place of the run where it fits; so only lags with such
a row of places are scanned.  Windows without an equal one within the longest
possible lag are dropped before doubling, so texts that don't repeat themselves
leave little to number, and the work is that of a few sorts whatever the length.

Rounds of splitting stop when they have counted ``WORK`` times the words of the
batch (a text made to lose one word a round); what is left is scanned unsplit,
with the same result.

``collapsed`` keeps of every run its first period: a word goes if some run
contains it after that run's first q words.

Cases: null and empty texts have no words, no runs and an empty collapsed text;
repeated rows get equal answers; an empty table gives an empty result; other
columns than ``keep`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from churnlab.llm.common import map_texts

MIN_LENGTH = 24
MIN_EXPONENT = 3
WORK = 64


def numbered(texts: list[str]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, the numbers of all words one after another, and where each text starts (and the last ends)."""
    words = [t.encode().split() for t in texts]     # bytes split at \x20 and \x09-\x0D only
    known = {w: i for i, w in enumerate(set().union(*words))}
    ends = np.cumsum([0, *map(len, words)])
    w = np.empty(ends[-1], np.int64)
    for part, s, e in zip(words, ends, ends[1:], strict=False):
        w[s:e] = np.fromiter(map(known.__getitem__, part), np.int64, e - s)
    return words, w, ends


def split(w: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, min_length: int) -> list[tuple[int, int]]:
    """Segments (start, end) in which every word occurs ``least`` times or more, ``min_length`` words or longer.

    ``starts`` and ``ends`` of the texts, which follow one another without gaps.
    """
    keep = ends - starts >= min_length
    segment = np.repeat(np.where(keep, np.cumsum(keep) - 1, -1), ends - starts)
    starts, ends = starts[keep], ends[keep]
    alive = segment >= 0
    order = np.argsort(w, kind="stable")
    order = order[alive[order]]
    done: list[tuple[int, int]] = []
    work = 0
    while len(order):
        work += len(order)
        if work > WORK * len(w):
            return done + list(zip(starts.tolist(), ends.tolist(), strict=True))
        word, inside = w[order], segment[order]
        new = np.ones(len(order), bool)
        new[1:] = (word[1:] != word[:-1]) | (inside[1:] != inside[:-1])
        block = np.cumsum(new) - 1
        rare = order[np.bincount(block)[block] < least]
        changed = np.zeros(len(starts), bool)
        changed[segment[rare]] = True
        done += zip(starts[~changed].tolist(), ends[~changed].tolist(), strict=True)
        alive[rare] = False
        places = np.sort(order[alive[order] & changed[segment[order]]])
        alive[order] = False
        if not len(places):
            break
        first = np.ones(len(places), bool)
        first[1:] = (places[1:] != places[:-1] + 1) | (segment[places[1:]] != segment[places[:-1]])
        at = np.flatnonzero(first)
        sizes = np.diff(np.r_[at, len(places)])
        long = sizes >= min_length
        starts, ends = places[at[long]], places[at[long]] + sizes[long]
        part = np.repeat(np.cumsum(long) - 1, sizes)
        stays = np.repeat(long, sizes)
        segment[places[stays]] = part[stays]
        alive[places[stays]] = True
        order = order[alive[order]]
    return done


def lags(w: np.ndarray, segment: np.ndarray, longest: int, min_length: int, exponent: int) -> Iterator[tuple[int, int]]:
    """(segment, lag) pairs that can hold a run; ``w`` holds the segments' words, ``segment`` their numbers."""
    places, key, k = np.arange(len(w)), w, 1
    half = np.full(len(w), -1, np.int64)
    while len(places) and k // 2 < longest:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        at = places[order]
        same = sorted_key[1:] == sorted_key[:-1]
        gap = np.where(same, at[1:] - at[:-1], 0)
        near = (gap > k // 2) & (gap <= k) & (segment[at[1:]] == segment[at[:-1]])
        lag, here = gap[near], at[:-1][near]
        by = np.lexsort((here, lag))
        lag, here = lag[by], here[by]
        if len(lag):
            new = np.ones(len(lag), bool)
            new[1:] = (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1) | (segment[here[1:]] != segment[here[:-1]])
            at_first = np.flatnonzero(new)
            at_last = np.r_[at_first[1:], len(lag)] - 1
            q = lag[at_first]
            fits = here[at_last] - here[at_first] + q + k >= np.maximum(min_length, exponent * q)
            yield from set(zip(segment[here[at_first[fits]]].tolist(), q[fits].tolist(), strict=True))
        close = np.zeros(len(order), bool)          # an equal window within the longest lag
        close[:-1] |= same & (gap <= longest)
        close[1:] |= same & (gap <= longest)
        number = np.cumsum(np.r_[0, ~same])
        kept, rank = at[close], number[close]
        half[:] = -1
        half[kept] = rank
        fits = kept + k < len(w)
        kept, rank = kept[fits], rank[fits]
        second = half[kept + k]
        some = second >= 0
        places, key = kept[some], rank[some] * len(w) + second[some]
        back = np.argsort(places, kind="stable")
        places, key, k = places[back], key[back], 2 * k


def scan(w: np.ndarray, q: int, min_length: int, exponent: int) -> list[tuple[int, int]]:
    """(start, length) of the stretches of ``w`` whose words equal those ``q`` places on, if long enough."""
    equal = np.zeros(len(w) - q + 2, np.int8)
    equal[1:-1] = w[q:] == w[:-q]
    turn = np.flatnonzero(np.diff(equal))
    start, length = turn[::2], turn[1::2] - turn[::2] + q
    some = length >= max(min_length, exponent * q)
    return list(zip(start[some].tolist(), length[some].tolist(), strict=True))


def runs_of(w: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts laid end to end, sorted by start and period."""
    segments = split(w, ends[:-1], ends[1:], exponent, min_length)
    if not segments:
        return []
    sizes = np.array([e - s for s, e in segments])
    joined = np.concatenate([w[s:e] for s, e in segments])
    owner = np.repeat(np.arange(len(segments)), sizes)
    found: dict[tuple[int, int], int] = {}
    for i, q in lags(joined, owner, int(sizes.max()) // exponent, min_length, exponent):
        s, e = segments[i]
        if exponent * q <= e - s:
            for start, length in scan(w[s:e], q, min_length, exponent):
                at = s + start, length
                found[at] = min(q, found.get(at, q))    # a multiple of the period marks the same stretch
    return sorted((s, n, q) for (s, n), q in found.items())


class _Runs:
    def __init__(self, min_length: int, exponent: int):
        self.min_length, self.exponent = min_length, exponent

    def __call__(self, texts: list[str]) -> dict[str, object]:
        words, w, ends = numbered(texts)
        runs: list[list[dict]] = [[] for _ in texts]
        goes = np.zeros(len(w), bool)
        for s, n, q in runs_of(w, ends, self.min_length, self.exponent):
            i = int(np.searchsorted(ends, s, side="right")) - 1
            runs[i].append({"start": s - int(ends[i]), "length": n, "period": q})
            goes[s + q:s + n] = True
        kept = []
        for part, found, s in zip(words, runs, ends, strict=False):
            if found:
                gone = goes[s:s + len(part)].tolist()
                part = [x for x, g in zip(part, gone, strict=True) if not g]
            kept.append(b" ".join(part).decode())
        return {"n_words": np.diff(ends).tolist(), "runs": runs, "collapsed": kept}


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
              keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, n_words, runs (start, length, period; word numbers from 0) and the collapsed text."""
    if min_exponent < 3 or min_length < 1:
        raise ValueError("runs need min_exponent of 3 or more and a positive min_length")
    schema = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_texts(docs, _Runs(min_length, min_exponent), schema, keep, text)
