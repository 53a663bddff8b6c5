import random

from pyspark.sql import functions as F

from ragloom.llm import linededup as L


def brute(rows, least):
    """Lines to delete by comparing every run of lines with every earlier one."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    words = lambda line: line.count(" ") + 1
    seen, gone = {}, {}
    for i, t in docs:
        ls = t.split("\n")
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                run = tuple(ls[a:b])
                if sum(map(words, run)) >= least:
                    key, first = seen.setdefault(run, ((i, t), a))
                    if (key, first) != ((i, t), a):
                        gone.setdefault((i, t), set()).update(range(max(a, first + b - a) if key == (i, t) else a, b))
    gone = {k: g for k, g in gone.items() if g}
    return {(i, ",".join(map(str, sorted(g))), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)) for (i, t), g in gone.items()}


def test_random_lines_against_brute_force(spark, docs_of):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(" ".join("w" for _ in range(rng.choice([1, 1, 2, 3]))) + str(rng.randrange(4)) for _ in range(rng.randrange(0, 14)))))
    for least in (3, 6, 11):
        found = {(r.doc_id, r.deleted_lines, r.text) for r in L.line_dedup(docs_of(rows), least).collect()}
        assert found == brute(rows, least)


def test_runs_longer_than_any_window(spark, docs_of):
    """Maximal runs of many windows go as one, however far they reach beyond the depth of the suffix sort."""
    rng = random.Random(14)
    runs = [[f"{rng.choice('abc')} {rng.randrange(40)}" for _ in range(45)] for _ in range(3)]
    rows = []
    for i in range(12):
        lines = []
        for _ in range(3):
            run = rng.choice(runs)
            a = rng.randrange(20)
            lines += run[a : a + rng.randrange(10, 45)] + [f"own {i} {rng.random()}"] * rng.randrange(2)
        rows.append((i, "\n".join(lines)))
    for least in (5, 16):
        found = {(r.doc_id, r.deleted_lines, r.text) for r in L.line_dedup(docs_of(rows), least).collect()}
        assert found == brute(rows, least) and max(r[1].count(",") for r in found) > 30


def test_a_passage_that_overlaps_itself_stays_once(docs_of):
    rows = [(1, "\n".join(["a"] * 200)), (2, "\n".join(["b", "c"] * 100)), (3, "\n".join(["a"] * 60))]
    out = {r.doc_id: (r.n_deleted, r.text) for r in L.line_dedup(docs_of(rows)).collect()}
    assert out == {1: (150, "\n".join(["a"] * 50)), 2: (150, "\n".join(["b", "c"] * 25)), 3: (60, "")}


def test_two_texts_of_one_id(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"{passage}\none"), (1, f"{passage}\ntwo"), (1, f"{passage}\ntwo"), (None, passage), (2, None)]
    out = L.stage(spark, docs_of(rows).withColumn("gone", F.lit(1)).withColumn("row_id", F.lit(2)), "").collect()
    texts = sorted(r.text for r in out if r.doc_id == 1)
    assert len(out) == 5 and sum(passage in t for t in texts) in (1, 2) and sum("one" in t or "two" in t for t in texts) == 3


def test_long_passage_goes_from_later_copies_only(docs_of):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"first\n{passage}\nend"), (2, f"{passage}\nsecond"), (3, "first\nend"), (4, "nothing shared")]
    out = {r.doc_id: r.text for r in L.line_dedup(docs_of(rows)).collect()}
    assert out == {2: "second"}


def test_odd_rows(odd, empty):
    out = L.line_dedup(odd)
    rows = out.collect()
    assert {r.doc_id: r.n_deleted for r in rows} == {6: 2, 9: 250}
    assert next(r for r in rows if r.doc_id == 6).text == ""
    assert L.line_dedup(empty).count() == 0


def test_stage_keeps_columns_and_clean_rows(spark, odd):
    out = L.stage(spark, odd, "")
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == odd.count() - 1  # only the copy of which nothing stays is gone
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 3, 4, 5, 5, 7, 8, 8, 9]
