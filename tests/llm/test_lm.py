import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import lm


def trie(texts, order):
    nodes = {}
    for t in texts:
        for i, b in enumerate(t):
            for k in range(min(i, order) + 1):
                n = nodes.setdefault(t[i - k : i], {})
                n[b] = n.get(b, 0) + 1
    return nodes


def price(nodes, context, byte):
    bits, excluded = 0.0, set()
    for k in range(len(context), -1, -1):
        n = nodes.get(context[len(context) - k :])
        if n is None:
            continue
        live = {s: c for s, c in n.items() if s not in excluded}
        total, kinds = sum(live.values()), len(live)
        if byte in live:
            return bits + math.log2((total + kinds) / live[byte])
        bits += math.log2((total + kinds) / kinds) if kinds else 0
        excluded |= set(n)
    return bits + math.log2(256 - len(excluded))


def test_prices_against_a_plain_model():
    rng = random.Random(2)
    for _ in range(100):
        order, letters = rng.choice([1, 2, 3]), b"abc\x00\xff"[: rng.randint(1, 5)]
        make = lambda: bytes(rng.choice(letters) for _ in range(rng.randint(0, 15)))  # noqa: B023, E731
        train, test = [make() for _ in range(rng.randint(0, 5))], [make() + bytes([rng.randint(0, 255)]) for _ in range(4)]

        def keys(ts, order=order):
            return lm.grams(np.frombuffer(b"".join(ts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in ts])]).astype(np.int64), order)

        k, n = np.unique(keys(train), return_counts=True) if any(train) else (np.empty(0, np.uint64), np.empty(0))
        got = lm.Trie(k, n, order).bits(keys(test))
        nodes = trie(train, order)
        assert np.allclose(got, [price(nodes, t[max(0, i - order) : i], b) for t in test for i, b in enumerate(t)])


@pytest.mark.parametrize("size", [lm.CHUNK, 50])
def test_documents_against_the_other_fold(docs_of, size):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(3, "twice"), (3, "twice"), (90, None), (None, "x"), (91, ""), (92, "long é " * 40)]
    table = docs_of(rows)
    fold = {r.doc_id: r.f for r in table.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("f")).collect()}
    whole = [(i, t.encode()) for i, t in rows if i is not None and t is not None]
    nodes = {f: trie([t for i, t in whole if fold[i] != f], 4) for f in (0, 1)}
    want = sorted((i, len(t), round(sum(price(nodes[fold[i]], t[max(0, k - 4) : k], b) for k, b in enumerate(t)), 2)) for i, t in whole)
    got = sorted((r.doc_id, r.n_bytes, round(r.bits, 2)) for r in lm.scored(table, 4, size).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 0.02 for g, w in zip(got, want, strict=True))


def test_parts_of_the_trie_price_like_the_whole():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 101, 300).tolist()) for _ in range(3)]
    keys, n = np.unique(lm.grams(np.frombuffer(b"".join(texts), np.uint8), np.array([0, 300, 600, 900]), 3), return_counts=True)
    levels = [np.zeros(256), np.zeros(65536)]
    for key, count in zip(keys.tolist(), n.tolist(), strict=True):
        levels[0][key & 255] += count
        levels[1][key & 65535] += count * (key >> 56 >= 1)
    whole, deep = lm.Trie(keys, n, 3), keys >> np.uint64(56) >= 2
    group = np.where(deep, keys >> np.uint64(8) & np.uint64(3), 9)
    for g in np.unique(group):
        part = group == g
        assert np.allclose(lm.Trie(keys[part], n[part], 3, levels).bits(keys[part]), whole.bits(keys[part]))


def test_odd_rows(odd, empty):
    out = lm.scored(odd).collect()
    assert len(out) == 10 and {r.doc_id for r in out} == {2, 3, 4, 5, 6, 7, 8, 9}
    assert next(r for r in out if r.doc_id == 2).bits_per_byte is None
    assert lm.scored(empty).count() == 0
