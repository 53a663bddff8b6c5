import random

import numpy as np
import pyarrow as pa
import regex

from ragloom.llm import decontam as D
from ragloom.llm.fmindex import FMIndex, WaveletTree, suffix_array

ITEMS = ["Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron", "short item of exactly eight words in all", "too short"]


def tokens(text):
    return [w.lower() for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", text)]


def brute(rows, items, n, least):
    phrases = set()
    for item in items:
        ws = tokens(item)
        if len(ws) >= least:
            m = min(n, len(ws))
            phrases.update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    found = set()
    for doc_id, text in rows:
        if doc_id is None or text is None:
            continue
        ws = tokens(text)
        hit = sorted((i, i + len(p)) for p in phrases for i in range(len(ws) - len(p) + 1) if tuple(ws[i : i + len(p)]) == p)
        spans = []
        for a, b in hit:
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        found.update((doc_id, a, b) for a, b in spans)
    return found


def test_index_parts():
    rng = np.random.default_rng(1)
    for n, sigma in ((1, 2), (40, 3), (300, 5), (500, 40), (64, 2)):
        s = rng.integers(1, sigma, n)
        text = np.append(s, 0)
        assert suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        tree = WaveletTree(text, sigma)
        assert tree.access(np.arange(n + 1)).tolist() == text.tolist()
        ends = rng.integers(0, n + 2, 30)
        syms = rng.integers(0, sigma, 30)
        assert tree.rank(syms, ends).tolist() == [int((text[:e] == c).sum()) for c, e in zip(syms, ends, strict=True)]
        index = FMIndex(s, sigma)
        pats = rng.integers(1, sigma, (20, 3))
        lo, hi = index.search(pats)
        for p, a, b in zip(pats, lo, hi, strict=True):
            want = [i for i in range(n - 2) if s[i : i + 3].tolist() == p.tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_against_brute_force(docs_of):
    rng = random.Random(3)
    vocab = ["a", "b", "É", "c,", "d."]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 9))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([*vocab, "zz", "— ×"]) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    found = {(r.doc_id, r.first_word, r.end_word) for r in D.contamination(docs_of(rows), items, 5, 4, shard_bytes=700).collect()}
    assert found and found == brute(rows, items, 5, 4)


def test_passage_is_cut_out(spark, docs_of, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate([*ITEMS, None])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"before, {ITEMS[0].upper()}! after"), (2, "clean text"), (3, None), (None, ITEMS[0]), (4, f"x {ITEMS[1]} y {ITEMS[0]} z too short")]
    out = {r.doc_id: r for r in D.stage(spark, docs_of(rows), str(tmp_path)).collect()}
    assert out[1].text == "before, ! after" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "clean text" and out[3].text is None
    assert out[4].text == "x  y  z too short"


def test_odd_rows(odd, empty):
    assert D.contamination(odd, ITEMS).count() == 0
    assert D.contamination(empty, ITEMS).count() == 0
    assert D.contamination(odd, []).count() == 0
    at, first, end = D.occurrences(pa.array(["", ITEMS[1], ""]), D.Phrases(ITEMS, 13, 8))
    assert (at.tolist(), first.tolist(), end.tolist()) == ([1], [0], [8])


def test_several_blocks_of_items_give_the_same(spark, docs_of, tmp_path, monkeypatch):
    rng = random.Random(8)
    items = [" ".join(rng.choice("abcdef") + str(rng.randrange(3)) for _ in range(rng.randrange(13, 30))) for _ in range(12)]
    items += [" ".join([*items[0].split()[-13:], *items[1].split()[:9]])]  # of two blocks, overlapping
    spark.createDataFrame([(i, t) for i, t in enumerate([*items, items[0], None])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, f"é — start {rng.choice(items)} mid {items[0]} {items[1]} end") for i in range(10)] + [(3, items[2]), (4, None), (5, "clean")]
    docs = docs_of(rows).selectExpr("*", "1 as spans", "2 as text_hash")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    results = []
    for most in (D.ITEM_BYTES, 200):
        monkeypatch.setattr(D, "ITEM_BYTES", most)
        assert (len(list(D.item_blocks(spark, str(tmp_path)))) > 3) == (most == 200)
        results.append((sorted(map(tuple, D.op2_benchmark_decontamination(spark, str(tmp_path)).collect())), sorted((r.doc_id, r.text or "", r.n_chars or 0) for r in D.stage(spark, docs, str(tmp_path)).collect())))
    assert results[0] == results[1] and len(results[0][0]) > 10
