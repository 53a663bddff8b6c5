import inspect
import math
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragloom import config
from ragloom.functions import scalars as S
from ragloom.functions import text as T
from ragloom.operators import analytics as A
from ragloom.operators import calibration, candidates, chunking, compare, containment, costs, noise, quality, retrieval, sampling, scoring, similarity, versioning


def one(df):
    return df.first()[0]


def column(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression.alias("x")).first()["x"]


# == text


def test_splitting(spark):
    assert column(spark, "  One here. Two there!  3 more? yes no. ", T.sentences("text")) == ["One here.", "Two there!", "3 more? yes no."]
    assert column(spark, "a\n\n \nb\nc\n\n", T.paragraphs("text")) == ["a", "b\nc"]
    assert column(spark, "Passage 1: x y PASSAGE 22: z", T.passages("text")) == ["x y", "z"]
    assert column(spark, "", T.sentences("text")) == []
    assert column(spark, " A\t b\n\nC ", T.normal("text")) == "a b c"
    assert column(spark, "Café, the the 42!", T.tokens("text")) == ["caf", "the", "42"]
    assert column(spark, "", T.count_tokens("text")) == 0 and column(spark, "it's 2, ok", T.count_tokens("text")) == 6


def test_similarity_of_texts(spark):
    j = lambda a, b: one(spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(T.jaccard("a", "b")))
    assert j(["a", "b"], ["b", "c"]) == pytest.approx(1 / 3) and j([], []) == 0 and j([], ["a"]) == 0


def test_html(spark):
    page = "<title>T</title><script>var x = '<b>';</script><p>a &amp; b<!-- no --></p><STYLE>p {}</STYLE>c"
    assert column(spark, page, T.html_text("text")) == "T\na & b\nc"


# == chunking


def plain_pack(units, sizes, size, overlap):
    out, open_, held = [], [], 0
    for u, n in zip(units, sizes):
        if open_ and held + n > size:
            out.append(" ".join(x for x, _ in open_))
            keep, total = [], 0
            for x, m in reversed(open_):
                if total + m > overlap:
                    break
                keep.insert(0, (x, m))
                total += m
            open_, held = (keep, total) if overlap > 0 else ([], 0)
        open_.append((u, n))
        held += n
    return out + ([" ".join(x for x, _ in open_)] if open_ else [])


def test_pack_against_a_plain_fold():
    rng = random.Random(1)
    for _ in range(500):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(0, 15))]
        units = [f"u{i}" for i in range(len(sizes))]
        size, overlap = rng.randint(1, 20), rng.choice([0, 0, 3, 8])
        assert chunking.pack(units, sizes, size, overlap, " ") == plain_pack(units, sizes, size, overlap)


def test_chunks(spark):
    docs = spark.createDataFrame([("d", "One two three. Four five six. Seven eight nine."), ("e", ""), ("f", "a\n\nb")], "doc_id string, text string")
    got = {(r.chunk_id, r.text) for r in chunking.chunks(docs, "sentences", 8, 0).collect()}
    assert got == {("d#chunk0", "One two three. Four five six."), ("d#chunk1", "Seven eight nine."), ("f#chunk0", "a\n\nb")}
    assert {r.text for r in chunking.chunks(docs, "paragraphs", 4, 0).collect()} == {"One two three.", "Four five six.", "Seven eight nine.", "a", "b"}
    own = {r.chunk_id for r in chunking.chunks(docs, lambda t: ["x", " ", "y"]).collect()}
    assert own == {f"{d}#chunk{i}" for d in "def" for i in (0, 2)}
    with pytest.raises(ValueError):
        chunking.chunks(docs, "pages")


# == retrieval


def scores(spark, gold, contexts):
    g = [("r", i, j, t) for i, group in enumerate(gold) for j, t in enumerate(group)]
    c = [("r", k + 1, t) for k, t in enumerate(contexts)]
    args = spark.createDataFrame([("r",)], "record_id string"), spark.createDataFrame(g, "record_id string, grp int, pos int, text string"), spark.createDataFrame(c, "record_id string, rank long, text string")
    return retrieval.retrieval_scores(*args).first()


def test_retrieval_facts(spark):
    r = scores(spark, [], ["x"])
    assert (r.chunk_recall, r.set_recall, r.mrr, r.precision_at_k, r.ranks) == (1.0, True, None, None, None)
    r = scores(spark, [["the gold passage text"]], ["nothing", "The  gold passage TEXT here", "other"])
    assert (r.chunk_recall, r.set_recall, r.mrr, r.ranks) == (1.0, True, 0.5, [2]) and r.precision_at_k == pytest.approx(1 / 3)
    r = scores(spark, [["a b c", "d e f"], ["zzz"]], ["a b c"])
    assert (r.set_recall, r.mrr) == (False, 1.0) and r.chunk_recall == pytest.approx(1 / 3)
    r = scores(spark, [["a b c"]], [])
    assert (r.chunk_recall, r.set_recall, r.mrr, r.precision_at_k) == (0.0, False, 0.0, None)
    r = scores(spark, [["", "a b c"]], ["", "q"])  # a blank context matches all; a blank gold text has a rank but isn't retrieved
    assert (r.chunk_recall, r.set_recall, r.ranks) == (0.5, False, [1, 1])
    assert scores(spark, [["one two three four"]], ["two one four five"]).chunk_recall == 1.0


def test_discovery(spark):
    gold = spark.createDataFrame([("r", 0, 0, "gold text")], "record_id string, grp int, pos int, text string")
    contexts = spark.createDataFrame([("r", 1, "gold text here"), ("r", 2, "new facts"), ("r", 3, " ")], "record_id string, rank long, text string")
    results = spark.createDataFrame([("r", False, 0.9, False)], "record_id string, set_recall boolean, overall double, unanswerable boolean")
    found = retrieval.discovered(results, gold, contexts)
    assert [(r.rank, r.text) for r in found.collect()] == [(2, "new facts")]
    more = retrieval.with_discovered(gold, found).where("grp = 1").first()
    assert more.chunk_id == "discovered#r#0" and more.text == "new facts"
    assert retrieval.discovered(results.withColumn("overall", F.lit(0.7)), gold, contexts).count() == 0


# == scores and health


def verdict_table(spark, rows):
    return spark.createDataFrame(rows, "record_id string, question_id string, dimension string, verdict boolean")


def test_scores(spark):
    questions = [("F1", "faithfulness", 1.0), ("F2", "faithfulness", 3.0), ("C1", "correctness", 1.0)]
    v = verdict_table(spark, [("r", "F2", "faithfulness", True), ("r", "C1", "correctness", False)])
    r = scoring.record_scores(v, questions, {"faithfulness": 0.5, "correctness": 0.3, "abstention": 0.2}).first()
    assert (r.faithfulness, r.correctness) == (0.75, 0.0) and r.overall == pytest.approx(0.375)


@pytest.mark.parametrize(("b", "want"), [([1, 0, 1, 0], 1.0), ([0, 1, 0, 1], -1.0), ([1, 1, 1, 1], 0.0)])
def test_phi(spark, b, want):
    rows = [(f"r{i}", q, "d", bool(x)) for q, xs in (("A", [1, 0, 1, 0]), ("B", b)) for i, x in enumerate(xs)]
    got = {(r.question_a, r.question_b): r.phi for r in A.phi_matrix(verdict_table(spark, rows)).collect()}
    assert got[("A", "B")] == pytest.approx(want) and got[("B", "B")] == 1.0 and len(got) == 4


def test_rates_and_health(spark):
    rows = [(f"r{i}", q, "d" if q < "C" else "e", x) for q, xs in (("A", [True, False]), ("B", [True, True]), ("C", [True, True])) for i, x in enumerate(xs)]
    v = verdict_table(spark, rows)
    assert {r.question_id: r.yes_rate for r in A.yes_rates(v).collect()} == {"A": 0.5, "B": 1.0, "C": 1.0}
    assert {r.dimension: r.spread for r in A.spreads(v).collect()} == {"d": 0.5, "e": 0.0}
    h = A.health(v).first()
    assert (h.verdict, h.min_spread, h.too_easy, h.uncovered_modes) == ("broken", 0.0, 2, 0)
    none = A.health(v.where("false")).first()
    assert (none.verdict, none.mean_phi, none.weak_share, none.uncovered_modes) == ("broken", 0.0, 1.0, 9)


def test_document_coverage(spark):
    chunks = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "doc_id string")
    records = spark.createDataFrame([(["a", "b"],), (["a", "z"],)], "source_doc_ids array<string>")
    assert A.document_coverage(records, chunks).first().coverage == pytest.approx(2 / 3)
    assert A.document_coverage(records, chunks.where("false")).first().coverage == 0.0


def test_intents(spark):
    points = spark.createDataFrame([("r", "P1", True), ("r", "P2", False), ("s", None, None)], "record_id string, point_id string, required boolean")
    verdicts = spark.createDataFrame([("r", "P1", False, 1), ("r", "P1", True, 2)], "record_id string, point_id string, covered boolean, ord int")
    got = {r.record_id: r.coverage for r in scoring.intent_coverage(points, verdicts).collect()}
    assert got["r"] == pytest.approx(2 / 3) and got["s"] == 1.0


# == other facts


def test_round_robin(spark):
    chunks = spark.createDataFrame([(f"{d}{i}", d, i) for d in "abcde" for i in range(10)], "chunk_id string, doc_id string, index int")
    got = candidates.round_robin(chunks, 15).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == dict.fromkeys("abcde", 3)


def test_bridges(spark):
    chunks = spark.createDataFrame([("c1", "d1", 0, "The Tesla factory"), ("c2", "d2", 1, "about Tesla and Berlin"), ("c3", "d2", 2, "Berlin")], "chunk_id string, doc_id string, ord int, text string")
    found = candidates.entities(chunks)
    assert sorted(map(tuple, candidates.bridges(found).collect())) == [("tesla", "Tesla", "c1", "d1", 2), ("tesla", "Tesla", "c2", "d2", 2)]
    assert [(r.chunk_a, r.chunk_b) for r in candidates.cross_doc_pairs(found).collect()] == [("c1", "c2")]


def test_versions(spark):
    got = spark.createDataFrame([("1.2.3",), ("x",), ("1.2",), (None,)], "v string").select(S.bumped("v", "minor").alias("a"), S.bumped("v", "patch").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("1.3.0", "1.2.4")] + [("1.1.0", "1.0.1")] * 3
    with pytest.raises(ValueError):
        S.bumped("v", "huge")


def test_sizes(spark):
    corpora = spark.createDataFrame([("a", 10, 10), ("b", 100, 400), ("c", 6000, 1), ("d", 0, 5)], "corpus string, n_docs long, n_chunks long")
    got = {(r.corpus, r.tier): r["size"] for r in costs.sizes(corpora).collect()}
    assert got[("a", "medium")] == 81 and got[("b", "medium")] == 110 and got[("c", "exhaustive")] == 600 and ("d", "medium") not in got
    assert {k: tuple(r) for k, r in ((n, spark.range(1).select(S.depth(F.lit(n)).alias("x")).first().x) for n in (3, 10, 11))} == {3: (1, 1), 10: (2, 3), 11: (3, 5)}


def test_calls_and_mixes():
    assert [round(costs.calls(t) - 2, 2) for t in config.TIERS] == [5.0, 1.67, 1.11]
    assert all(abs(sum(m.values()) - 1) < 1e-9 for m in config.TYPE_MIX.values())
    assert all(abs(sum(w for _, w in m) - 1) < 1e-9 for m in config.NOISE_MIX.values())
    assert len(config.QUESTIONS_FULL) == 24 and len(config.QUESTIONS_SHORT) == 9
    with pytest.raises(ValueError):
        config.tier_config("huge")
    with pytest.raises(ValueError):
        config.questions_for([], "medium")
    assert config.weights_for(None, [("X", "style", "?", 1.0)], "medium", True) == {"style": 1.0}


def test_apportionment_sums_up(spark):
    for size in (1, 7, 80, 203):
        mix = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(config.TYPE_MIX["exhaustive"].items())], "ord int, name string, share double")
        assert sampling.apportioned(mix, size).agg(F.sum("n")).first()[0] == size


def test_staleness(spark):
    records = spark.createDataFrame([("r1", ["a", "b"]), ("r2", ["c"]), ("r3", ["x"])], "record_id string, source_doc_ids array<string>")
    was = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_id string, hash string")
    now = spark.createDataFrame([("a", "1x"), ("c", "3")], "doc_id string, hash string")
    assert [tuple(r) for r in versioning.stale(records, was, now).collect()] == [("r1", "a", "modified")]
    assert versioning.stale_summary(records, versioning.stale(records, was, now)).first().ratio == pytest.approx(1 / 3)


def test_review(spark):
    records = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "record_id string, gold_answer string")
    review = spark.createDataFrame([("a", " REJECT ", None), ("b", "edit", " new "), ("c", "edit", " "), ("q", "reject", None)], "id string, reviewer_verdict string, reviewer_notes string")
    assert {tuple(r) for r in versioning.reviewed(records, review).collect()} == {("b", "new"), ("c", "z")}
    assert {(r.action, r.n, r.version) for r in versioning.review_log(records, review).collect()} == {("remove_records", 1, "1.1.0"), ("apply_review", 1, "1.1.1")}


def test_calibration(spark):
    rows = spark.createDataFrame([(True, True)] * 4 + [(False, True)] * 2 + [(True, False)] + [(False, False)] * 3, "truth boolean, judged boolean")
    r = calibration.agreement(rows).first()
    assert (r.precision, r.recall, r.raw_agreement) == (pytest.approx(4 / 6), pytest.approx(4 / 5), 0.7) and r.kappa == pytest.approx(0.4)
    assert math.isnan(calibration.agreement(rows.where("truth")).first().kappa)
    assert math.isnan(calibration.pairwise(spark.createDataFrame([], "good double, bad double")).first().accuracy)


def test_containment_equals_a_nested_loop(spark):
    rng = random.Random(4)
    words = ["aa", "b", "cc", "d."]
    texts = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(30)]
    needles = [(i, texts[i % 30][1][rng.randrange(9) :][: rng.choice([0, 3, 20, 60])]) for i in range(40)]
    a, b = spark.createDataFrame(needles, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    norm = lambda t: " ".join(t.lower().split())
    want = {(i, d) for i, n in needles for d, t in texts if norm(n) and norm(n) in norm(t)}
    assert {tuple(r) for r in containment.contained(a, b).collect()} == want
    assert {tuple(r) for r in quality.leaks(a, b).collect()} == want


def test_filters(spark):
    records = spark.createDataFrame([("a", "x", "easy", ["typo"], ["t"], False), ("b", "y", "hard", ["clean"], ["u"], True)], "id string, question_type string, difficulty string, noise_profile array<string>, domain_tags array<string>, unanswerable boolean")
    assert [r.id for r in quality.select(records, question_type=["x", "y"], noise_type="typo").collect()] == ["a"]
    assert [r.id for r in quality.select(records, unanswerable=True, domain_tag="u").collect()] == ["b"]
    with pytest.raises(ValueError):
        quality.select(records, colour="red")


def test_stubs(spark):
    made = lambda rows: quality.stub_reasons(spark.createDataFrame(rows, "answer string, contexts array<string>")).first().is_stub
    assert made([("real", ["c"]), ("other", ["d"])]) is False
    assert made([("same", ["c"]), ("same", ["c"])]) is True
    assert made([(" TODO ", ["c"]), ("x", [])]) is True and made([("x", ["Chunk text 1"]), ("y", [])]) is True


def test_comparison(spark):
    schema = "record_id string, overall double, faithfulness double, question_type string, noise_profile array<string>"
    old = spark.createDataFrame([("a", 0.9, 0.5, "x", []), ("b", 0.2, 0.5, "y", ["typo"])], schema)
    new = spark.createDataFrame([("a", 0.6, 0.7, "x", []), ("b", 0.8, 0.7, "z", ["typo"])], schema)
    d = compare.deltas(new, old).first()
    assert d.overall == pytest.approx(0.15) and d.faithfulness == pytest.approx(0.2)
    assert {tuple(r) for r in compare.flips(new, old).collect()} == {("a", "pass_to_fail"), ("b", "fail_to_pass")}
    assert {(r.facet, r.value) for r in compare.group_deltas(new, old).collect()} == {("question_type", "x"), ("noise", "clean"), ("noise", "typo")}


def test_similar_pairs_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.standard_normal((70, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, i % 3, row.tolist()) for i, row in enumerate(x)], "vec_id long, doc_id long, embedding array<double>")
    cosine = np.round(x @ x.T, 6)
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if i % 3 != j % 3 and cosine[i, j] >= 0.5}
    assert {(r.vec_a, r.vec_b) for r in similarity.similar_pairs(v, 0.5).collect()} == want
    near = similarity.nearest(v.select(F.col("vec_id").alias("query_id"), "embedding"), v, 4).collect()
    for q in range(70):
        assert [r.vec_id for r in sorted((r for r in near if r.query_id == q), key=lambda r: r.rank)] == sorted(range(70), key=lambda i: (-cosine[q, i], i))[:4]


def test_typos():
    rng = random.Random(6)
    for k in range(300):
        text = " ".join(rng.choice(["What", "is", "the", "guarantee?", "x1", "period,", "éclair", "to"]) for _ in range(rng.randint(0, 9)))
        out = noise.with_typos(text, 2, k)
        assert len(out.split(" ")) == len(text.split(" ")) and out == noise.with_typos(text, 2, k)
        assert sum(a != b for a, b in zip(out.split(" "), text.split(" "))) <= 2
    assert noise.with_typos("Guarantee", 1, 0) == "Guarentee" and noise.with_typos("a b 12", 1, 0) == "a b 12"


def test_noise_layers(spark):
    q = spark.createDataFrame([("a", "What is the period", ["typo", "fragment"]), ("b", "Plain question here", []), ("c", "Other", None)], "id string, question string, layers array<string>")
    said = lambda rows, heat: rows.withColumn("reply", F.when(F.col("prompt").contains("Other"), None).otherwise(F.regexp_replace("prompt", r"(?s)^.*\[kind\] (\w+)\n.*\[text\] ", "$1:")))
    got = {r.id: (r.noisy, r.noise_profile) for r in noise.with_layers(q, 1, said).collect()}
    assert got["a"][0].startswith("fragment:") and got["a"][1] == ["typo", "fragment"] and got["b"] == ("Plain question here", ["clean"]) and got["c"][1] == ["clean"]
    with pytest.raises(Exception, match="unknown noise"):
        noise.with_layers(q.withColumn("layers", F.array(F.lit("fog"))), 1).collect()


def test_streaks(spark):
    h = spark.createDataFrame([("a", r, 1.0) for r in range(6)] + [("b", r, 0.9 if r == 5 else 1.0) for r in range(6)] + [("c", 1, 1.0)], "record_id string, run int, overall double")
    assert [r.record_id for r in A.perfect_streaks(h).collect()] == ["a"]


def test_chunks_of_repeated_documents(spark):
    docs = spark.createDataFrame([("a", 1, "old text."), ("a", 2, "new text."), ("b", 1, None)], "doc_id string, ord int, text string")
    assert [(r.chunk_id, r.text) for r in chunking.chunks(docs, "sentences", order="ord").collect()] == [("a#chunk0", "new text.")]


def test_python_units_are_those_of_columns(spark):
    import re

    rng = random.Random(12)
    texts = ["".join(rng.choice(["a", "B ", "3", ".", "? ", "!\n", "\n\n", " \t", "é", "\u00a0", "_x", "-", "\n \n"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.sentences("text").alias("s"), T.paragraphs("text").alias("p"), T.count_tokens("text").alias("n")).collect()
    for r in rows:
        assert r.s == chunking.pieces(texts[r.i], re.compile(T.SENTENCE_BREAK, re.A)) and r.p == chunking.pieces(texts[r.i], re.compile(T.PARAGRAPH_BREAK, re.A)) and r.n == T.counted(texts[r.i])


def test_distractors_differ_between_targets(spark):
    rows = [(f"c{i}", "hot" if i % 3 == 0 else f"d{i % 40}") for i in range(600)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string")
    out = candidates.distractors(chunks, chunks, 3).collect()
    doc = dict(rows)
    assert len(out) == 1800 and all(doc[r.chunk_id] != doc[r.distractor] for r in out) and len({(r.chunk_id, r.distractor) for r in out}) == 1800
    assert len({r.distractor for r in out}) > 300
    few = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "chunk_id string, doc_id string")
    assert sorted(map(tuple, candidates.distractors(few, few, 2).collect())) == [("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("c", "b", 2)] or len(candidates.distractors(few, few, 2).collect()) == 4


def test_bpe_tokens(spark):
    from ragloom.functions.tokens import BpeCounter, bpe_tokens

    count = BpeCounter()
    rows = [("Hello world",), ("",), (None,), ("it's été 123",)]
    assert [r.n for r in spark.createDataFrame(rows, "t string").select(bpe_tokens(F.col("t")).alias("n")).collect()] == [2, 0, 0, count("it's été 123")]
    docs = spark.createDataFrame([("a", "Hello world. Hello again world. More")], "doc_id string, text string")
    assert all(r.token_count == count(r.text) <= 5 for r in chunking.chunks(docs, "sentences", 5, 0, count).collect())


def test_numbers_between_parts_of_contexts(spark):
    gold = spark.createDataFrame([("r", 0, 0, "alpha beta gamma")], "record_id string, grp int, pos int, text string")
    contexts = spark.createDataFrame([("r", k, "x alpha beta gamma y" if k in (17, 40) else f"other {k}") for k in range(1, 60)], "record_id string, rank int, text string")
    r = retrieval.retrieval_scores(gold.select("record_id").distinct(), gold, contexts).first()
    assert r.ranks == [17] and abs(r.precision_at_k - 2 / 59) < 1e-9 and r.set_recall


def test_last_edit_wins(spark):
    records = spark.createDataFrame([("b", "old")], "record_id string, gold_answer string")
    review = spark.createDataFrame([("b", "edit", "zz", 1), ("b", "edit", "aa", 2), ("b", "edit", " ", 3)], "id string, reviewer_verdict string, reviewer_notes string, ord int")
    assert versioning.reviewed(records, review).first().gold_answer == "aa"


def test_best_of_tiles_with_ties(spark):
    import numpy as np

    assert similarity._spread(1) == 1 and similarity._spread(200_000) == 7 and similarity._spread(600_000) * similarity.SIDE < 650_000
    rng = np.random.default_rng(2)
    v = rng.integers(-1, 2, (3 * similarity.TILE // 2, 3)).astype(np.float32)  # many equal ones
    q, ids = v[:40].astype(np.float64), rng.permutation(len(v))
    at, found, value = similarity._best(q, ids, v, 7)
    cosine = np.round(q @ v.astype(np.float64).T, 6)
    want = [np.lexsort((ids, -row))[:7] for row in cosine]
    assert at.tolist() == [i for i in range(40) for _ in range(7)] and found.tolist() == ids[np.concatenate(want)].tolist()
    assert value.tolist() == [cosine[i, j] for i in range(40) for j in want[i]]


def test_chunks_leave_a_batch_in_parts():
    import pyarrow as pa

    texts = ["One two three four. " * 20_000, None, "", *["Five six. " * 30_000] * 9]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    split = lambda t: chunking.STRATEGIES["sentences"](t, 128, 0, lambda u: 5)
    out = list(chunking.in_parts(split, len)(iter([batch])))
    assert len(out) > 1 and max(sum(map(len, b["text"].to_pylist())) for b in out) <= chunking.HELD + max(len(t or "") for t in texts)
    rows = [r for b in out for r in zip(b["doc_id"].to_pylist(), b["index"].to_pylist(), b["text"].to_pylist())]
    assert rows == [(i, k, c) for i, t in enumerate(texts) if t is not None for k, c in enumerate(split(t))]


def test_containment_in_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK", 100)
    texts = [(i, f"{'pad ' * i}one two three four five six seven eight nine ten number {i}") for i in range(30)]
    needles = [(i, f"ne two  three four five six seven eight nine ten NUMBER {i}") for i in range(30)] + [(99, "d one"), (98, " ")]
    a, b = spark.createDataFrame(needles, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    want = {(i, d) for i in range(30) for d in range(30) if str(d).startswith(str(i))} | {(99, d) for d in range(1, 30)}
    found = containment.contained(a, b)
    assert {tuple(r) for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_matches_equal_a_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PART", 7)
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice(["aa", "b", "cc", "d.", "É", "x-y"]) for _ in range(n))
    contexts = [(r, k, t) for r in "rs" for k, t in enumerate(["", " ", None, *(some(rng.randint(1, 30)) for _ in range(40))], 1)]
    gold = [(r, i // 2, i % 2, t) for r in "rst" for i, t in enumerate(["", None, *(some(rng.randint(1, 9)) for _ in range(12)), f"b  {contexts[20][2]}", contexts[60][2][1:-1]])]
    norm = lambda t: " ".join(t.lower().split())
    tokens = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    close = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.5
    want = sorted((r, g, p, k, norm(a) == "") for r, g, p, a in gold for s, k, b in contexts if r == s and a is not None and b is not None and (norm(a) in norm(b) or norm(b) in norm(a) or close(tokens(a), tokens(b))))
    made = spark.createDataFrame(gold, "record_id string, grp int, pos int, text string"), spark.createDataFrame(contexts, "record_id string, rank long, text string")
    assert sorted(map(tuple, retrieval.matches(*made).collect())) == want


def test_streaks_sort_in_many_parts(spark):
    h = spark.createDataFrame([("a", r, 1.0) for r in range(6)], "record_id string, run int, overall double")
    assert f", {A.STREAK_PARTS}), REPARTITION_BY_NUM" in A.perfect_streaks(h)._jdf.queryExecution().executedPlan().toString()


def test_hashed_embeddings_count_words_with_signs(spark):
    import zlib

    texts = ["One two two", "", "ünï one ONE x y z " * 9]
    got = {r.chunk_id: r.embedding for r in similarity.hashed_embeddings(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")).collect()}
    for i, t in enumerate(texts):
        v = [0.0] * 64
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h & (1 << 16) else -1
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        assert got[str(i)] == pytest.approx([x / norm for x in v], abs=1e-6)


def test_search_computes_vectors_once(spark):
    from ragloom.plans import rag

    questions = spark.createDataFrame([("q", "a b c")], "question_id string, question string")
    vectors = similarity.hashed_embeddings(spark.createDataFrame([("1", "a b c"), ("2", "d")], "chunk_id string, text string")).withColumn("vec_id", F.xxhash64("chunk_id"))
    found = rag.search(questions, vectors, 1, held=2).join(spark.createDataFrame([("1",), ("2",)], "chunk_id string").withColumn("vec_id", F.xxhash64("chunk_id")), "vec_id")
    assert [(r.question_id, r.chunk_id) for r in found.collect()] == [("q", "1")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 2  # questions, vectors


def test_shared_matches_equal_those_by_record(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 60)  # several blocks
    monkeypatch.setattr(retrieval, "HELD", 5)
    rng = random.Random(4)
    some = lambda n: rng.choice([" ", "\n\t ", "\r\f"]).join(rng.choice(["aa", "b", "Cc", "d.", "É", "x-y", "ΣΑΣ", "\u00a0"]) for _ in range(n))
    contexts = [(r, (k, None), t) for r in ("r", "s", None) for k, t in enumerate(["", " \n", None, "aa", "  aa \n b  ", *(some(rng.randint(1, 30)) for _ in range(40))], 1)]
    items = [(i // 2, i % 2, t) for i, t in enumerate(["", None, "Aa", *(some(rng.randint(1, 9)) for _ in range(12)), f"b  {contexts[20][2]}", contexts[60][2][1:-1], "aa" + " " * 80 + "b d. cc"])]
    i = spark.createDataFrame(items, "grp long, pos int, text string")
    c = spark.createDataFrame(contexts, "record_id string, rank struct<id:int,hash:long>, text string")
    found = retrieval.shared_matches(i, c)
    gold = spark.createDataFrame([(r, *item) for r in "rs" for item in items], "record_id string, grp long, pos int, text string")
    want = sorted(map(tuple, retrieval.matches(gold, c).collect()))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    assert retrieval.shared_matches(i.where("false"), c).count() == 0
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # texts stay where they are read


def peak(gold, text):
    """Bytes that matching holds at most, for each of the text."""
    known = retrieval.Gold(gold)
    tracemalloc.start()
    assert known.matches(text) == []
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / len(text)


def test_contexts_of_too_many_tokens_are_not_cut_whole():
    assert peak([b"of some ten words"], " ".join(f"ñ{i}" for i in range(20_000)).encode()) < 12


def test_contexts_without_a_golds_rare_words_are_not_compared():
    assert peak([b"of one rare1 rare22 rare333 end"], " ".join(["rare333", *(f"w{i}" for i in range(20_000))]).encode()) < 12


def test_only_likely_contexts_are_put_in_lower_case(spark):
    items = spark.createDataFrame([(0, 0, "Some gold text")], "grp long, pos int, text string")
    contexts = spark.createDataFrame([("r", 1, "With SOME \n gold TEXT."), ("r", 2, "none of it " * 9)], "record_id string, rank int, text string")
    found = retrieval.shared_matches(items, contexts)
    below = found._jdf.queryExecution().optimizedPlan().toString().rpartition("MapInArrow")[2]
    assert "lower(" not in below and [r["rank"] for r in found.collect()] == [1]


def test_likely_contexts_are_all_that_match(monkeypatch):
    monkeypatch.setattr(retrieval, "SLICE", 3000)
    rng = random.Random(8)
    words = ["aa", "b", "Cc", "d.", "É", "xÉy", "k\u212aK", "\u0130i", "\u1e9eS", "\u212bA", "ΣΑΣ", "z-9", "\x1cq", "\u00a0", "\x7f"]
    some = lambda n: rng.choice([" ", "\n\t ", "\r\f"]).join(rng.choice(words) for _ in range(n))
    joined = lambda t: b" ".join(t.lower().encode().split())
    seen = 0
    for _ in range(60):
        gold = [t for t in (joined(some(rng.randint(1, 30))) for _ in range(4)) if re.search(rb"[!-~]", t)]
        inner = [g.decode()[rng.randint(0, 3) : rng.randint(4, 60)].upper() for g in gold]
        contexts = ["", " \n", *inner, *("  ".join(g.decode().split()).upper() + some(9) for g in gold), *(some(rng.randint(1, 40)) for _ in range(40)), *(" ".join(f"w{i}" for i in range(n)) for n in (3, 400))]
        known = retrieval.Gold(gold)
        likely = retrieval.Likely(known)
        assert likely.patterns
        mask = likely.mask(pa.array([c.encode() for c in contexts]))
        match = [bool(known.matches(c.lower().encode())) for c in contexts]
        assert all(m or not x for m, x in zip(mask, match)) and not mask[-1]
        seen += sum(match)
    assert seen > 500


def test_only_two_signs_have_ascii_in_lower_case(spark):
    signs = [chr(i) for i in range(128, 0x110000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([("|".join(signs[i : i + 4096]),) for i in range(0, len(signs), 4096)], "text string").coalesce(1)
    lower = [x for r in rows.select(F.lower("text").alias("x")).collect() for x in r.x.split("|")]
    assert len(lower) == len(signs)
    assert [s for s, x in zip(signs, lower) if not all(map("\x7f".__lt__, x))] == ["\u0130", "\u212a"]
    assert all(len(x.encode()) >= retrieval._SHRUNK * len(s.encode()) for s, x in zip(signs, lower) if s != "\u212a")


def test_normal_contexts_are_split_as_columns_are(spark):
    text = "  A\u00a0b \x1c c\x0bd\te\x85 \u2003\u0130 \n"
    lower, normal = spark.createDataFrame([(text,)], "text string").select(F.lower("text"), T.normal("text")).first()
    assert b" ".join(lower.encode().split()) == normal.encode()


def test_texts_are_counted_once(monkeypatch):
    monkeypatch.setattr(chunking, "HELD", 100)
    asked = []
    count = chunking.remembered(lambda t: asked.append(t) or T.counted(t))
    text = "\n\n".join(f"Paragraph {i} is small." for i in range(9))
    parts = chunking.STRATEGIES["paragraphs"](text, 128, 0, count)
    assert [count(p) for p in parts] == [T.counted(p) for p in parts] and asked == parts
    assert [count(f"{i} " * 40) for i in range(50)] == [40] * 50  # also when what is known is let go
    assert len(inspect.getclosurevars(count).nonlocals["known"]) < 20


def test_count_of_ascii(spark):
    text = "".join(map(chr, range(1, 128))) + " a_b c1\x1cd\x0be"
    assert T.counted(text) == len(T._TOKEN.findall(text)) == column(spark, text, T.count_tokens("text"))
