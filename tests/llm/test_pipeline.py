import corpus_pipeline
from ragloom.llm import packing

PASSAGE = " ".join(f"passage{i}" for i in range(60))
ITEM = " ".join(f"item{i}" for i in range(20))


def text(i, n=80):
    return " ".join(f"t{i}x{j}" for j in range(n))


def test_planted_cases(spark, docs_of, tmp_path):
    near = text(3).split(" ")
    near[5] = "changed"
    rows = [
        (1, text(1)),
        (2, text(2) + " idiot moron"),
        (3, text(3)),
        (4, " ".join(near)),
        (5, text(5) + "\n" + PASSAGE),
        (6, text(6) + "\n" + PASSAGE),
        (7, text(7) + " " + ITEM + " end"),
        (8, None),
        (9, ""),
        (10, text(1)),
    ]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = tmp_path / f"out-{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(str(out))
        docs = spark.read.parquet(str(out))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text for r in docs.collect()})
    toxicity, lines, near, clean = kept
    assert set(toxicity) == {1, 3, 4, 5, 6, 7, 8, 9, 10}
    assert set(lines) == {1, 3, 4, 5, 6, 7, 8, 9} and lines[6] == text(6) and lines[5].endswith(PASSAGE)
    assert set(near) == {1, 3, 5, 6, 7, 8, 9}
    assert clean[7] == text(7) + "  end" and clean[1] == text(1)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == {1, 3, 5, 6, 7}
    assert sum(r.length for r in final) == sum(len(t.split()) for t in clean.values() if t) and all(r.at + r.length <= packing.CAPACITY for r in final)


def test_odd_empty_and_no_tables_to_learn_from(spark, odd, docs_of, tmp_path):
    odd = odd.selectExpr("*", "1 as gone", "2 as __gone", "3 as row_id", "4 as text_hash", "5 as nth", "6 as spans")
    for name, docs in (("odd", odd), ("empty", docs_of([]))):
        there = tmp_path / name
        docs.write.parquet(str(there / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(there / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(there / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(there)).collect()
        assert {r.doc_id for r in out} == (set() if name == "empty" else {4, 5, 7, 8, 9})
        assert len({r.text_hash for r in out if r.doc_id == 8}) == 2 * (name == "odd")
