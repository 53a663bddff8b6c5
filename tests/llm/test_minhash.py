import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragloom.llm import minhash as M


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_estimate_is_close_to_jaccard():
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    texts = []
    for share in (0.0, 0.02, 0.05, 0.1, 0.3):
        texts.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base))
    values, some = M.signatures(pa.array(texts))
    assert some.tolist() == list(range(5))
    for i in range(1, 5):
        a, b = shingles(texts[0]), shingles(texts[i])
        assert abs((values[0] == values[i]).mean() - len(a & b) / len(a | b)) < 0.12


def test_pairs_and_groups_against_brute_force(docs_of):
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 5)):
            texts.append(" ".join(f"y{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in base))
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    true = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= M.THRESHOLD]
    out = {r.doc_id: r.duplicate_of for r in M.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    root = lambda i: out.get(i, i)
    assert sum(root(i) == root(j) for i, j in true) >= 0.9 * len(true)
    assert all(len(sets[i] & sets[j]) for i, j in out.items())
    assert all(j not in out for j in out.values())


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in parent if find(x) != x}
    got = {tuple(r) for r in M.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_odd_rows(spark, odd, empty):
    assert {tuple(r) for r in M.near_duplicates(odd).collect()} == {(6, 5)}
    assert M.near_duplicates(empty).count() == 0
    out = M.stage(spark, odd, "")
    assert out.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect() if r.doc_id is not None) == [(False, i) for i in (1, 2, 3, 4, 5, 7, 8, 8, 9)]
    assert out.where("doc_id is null").count() == 2
    assert M.stage(spark, empty, "").count() == 0


def test_a_row_goes_for_its_id_and_text(spark, docs_of):
    a, b, near = ("word " * 9 + "%s") % "a", " ".join(f"b{i}" for i in range(60)), " ".join(f"b{i}" for i in range(59))
    rows = [(1, a), (5, a), (5, b), (6, near), (7, b), (7, near), (8, "alone"), (8, "alone"), (None, a), (9, None), (9, None)]
    out = sorted((r.doc_id or 0, r.text or "") for r in M.stage(spark, docs_of(rows).withColumn("row_id", F.lit(1)).withColumn("nth", F.lit(2)), "").collect())
    assert out == sorted([(1, a), (5, b), (8, "alone"), (0, a), (9, ""), (9, "")])
    assert {tuple(r) for r in M.near_duplicates(docs_of(rows)).collect()} == {(5, 1), (6, 5), (7, 5)}


def test_bands_mix_permutations():
    values = np.arange(2 * 2 * M.PERMUTATIONS).reshape(2, -1).astype(np.uint32)
    bands = 2 * M.PERMUTATIONS // M.ROWS
    base = M.band_keys(values)
    for j in range(M.PERMUTATIONS):  # a permutation's minimum and maximum touch bands of their own
        touched = []
        for k in (j, M.PERMUTATIONS + j):
            other = values.copy()
            other[:, k] += 10_000
            touched.append(set(np.flatnonzero(M.band_keys(other)[0] != base[0])))
        assert touched[0].isdisjoint(touched[1]) and bands == base.shape[1]


def test_whole_long_texts_count(docs_of):
    words = [f"w{i}" for i in range(30_000)]
    other = words[:100] + [f"v{i}" for i in range(29_900)]
    assert M.near_duplicates(docs_of([(1, " ".join(words)), (2, " ".join(other))])).count() == 0
    assert np.all(M.shingle_hashes(pa.array(["a b", "a b"]))[0] == M.shingle_hashes(pa.array(["A  b."]))[0][0])
