"""Numbers of one text, shared by the quality operators (6 and 8)."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"


def byte_counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    return np.fromiter((put(w, len(seen)) for w in words), np.int64, len(words))


def in_repeated_windows(ids: np.ndarray, size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    key = ids[:n].copy()
    for k in range(1, size):
        if base ** (k + 1) < 1 << 62:
            key = key * base + ids[k:n + k]
        else:  # too many different words for one number: rank the prefixes first
            key = np.unique(key, return_inverse=True)[1] * base + ids[k:n + k]
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for j in range(size):
        covered[j:n + j] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def word_chars(text: str, data: bytes, counts: np.ndarray) -> int:
    return len(text) - int(counts[list(_SPACE)].sum())


def n_symbols(counts: np.ndarray) -> int:
    return int(counts[list(SYMBOLS)].sum())
