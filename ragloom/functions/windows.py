"""Hashes of runs of words, for joins of texts on what they share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Words that are remembered by a task.
REMEMBERED = 100_000
_FACTOR = 0x9E3779B97F4A7C15


def window_hashes(texts: list[str | None], sizes: list[int], inner: bool, memo: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of texts, sizes and hashes of their runs of words, a batch of texts at a time; words are parts between single spaces.

    inner: of each text only the first run after its first word that ends before its last, of the largest size there is.
    """
    at, n, out = [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        words = text.split(" ")
        if len(memo) > REMEMBERED:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w.encode()) | 1
        h = np.array([memo[w] for w in words], np.uint64)
        for size in sizes:
            if inner:
                if size != min(max(sizes), len(h) - 2):
                    continue
                part = h[1 : 1 + size]
            else:
                part = h
            if len(part) < size:
                continue
            total, factor = np.zeros(len(part) - size + 1, np.uint64), 1
            for j in range(size):
                total += part[j : len(part) - size + 1 + j] * np.uint64(factor)
                factor = factor * _FACTOR & 0xFFFFFFFFFFFFFFFF
            total = np.unique(total)
            at.append(np.full(len(total), i))
            n.append(np.full(len(total), size, np.int32))
            out.append(total)
    if out:
        yield np.concatenate(at), np.concatenate(n), np.concatenate(out).view(np.int64)
