import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from ragloom import api, cli, config
from ragloom.operators import analytics, noise, quality
from ragloom.plans import evaluate as E
from ragloom.plans import providers as P
from ragloom.plans import rag
from ragloom.sources import readers, writers
from ragloom.streaming import resume

DOCS = {
    "pricing.md": "# Prices\n\nThe Basic plan costs ten. The Premium plan costs forty.\n\nRefunds take five days. Premium users call Support.",
    "support.txt": "Support answers in two hours. Premium tickets go first. Support is closed on Sunday.",
    "leave_old.md": "Leave is unlimited. Managers approve Leave within a week.",
    "leave_new.html": "<html><title>Leave</title><script>x()</script><p>Leave is capped at forty hours &amp; tracked.</p></html>",
    "rates.csv": "plan,price\nBasic,10\nPremium,40,extra\n",
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for name, text in DOCS.items():
        (folder / name).write_text(text)
    (folder / "sub").mkdir()
    with zipfile.ZipFile(folder / "sub" / "notes.DOCX", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>Docx</w:t></w:r></w:p><w:p/><w:tbl><w:tr>{cell.format('a')}{cell.format('b')}</w:tr></w:tbl></w:body></w:document>")
    (folder / "ignored.bin").write_bytes(b"\x00")
    return str(folder)


def test_corpus(spark, corpus, tmp_path):
    got = {r.doc_id: r.text for r in readers.load_directory(spark, corpus).collect()}
    assert set(got) == {"pricing", "support", "leave_old", "leave_new", "rates", "notes"}
    assert got["notes"] == "Hello Docx\n\na | b" and got["rates"] == "plan: Basic; price: 10\nplan: Premium; price: 40"
    assert "x()" not in got["leave_new"] and "forty hours & tracked" in got["leave_new"]
    assert "sub/notes.DOCX" in {r.doc_id for r in readers.load_directory(spark, corpus, "path").collect()}
    assert readers.doc_hashes(spark, corpus).count() == 6
    with pytest.raises(NotADirectoryError):
        readers.load_directory(spark, corpus + "/none")
    with pytest.raises(ValueError):
        (tmp_path / "x.bin").write_bytes(b"")
        readers.load_directory(spark, str(tmp_path))
    with pytest.raises(ValueError):
        readers.load_document("a.xyz")
    assert readers.decoded("é".encode("utf-16")) == "é" and readers.decoded(b"\xff-") == "�-"


def test_settings(tmp_path):
    (tmp_path / "conf").write_text("# no\nA = 1\nB=x=y\nnothing\n")
    assert readers.read_conf(str(tmp_path / "conf")) == {"A": "1", "B": "x=y"} and readers.read_conf(str(tmp_path / "none")) == {}


def test_json_of_replies():
    assert P.extract_json('Sure: {"a": {"b": 1}} done') == {"a": {"b": 1}}
    assert P.extract_json("```json\n[1]\n```") == [1] and P.extract_json("x [1, 2] y") == [1, 2]
    assert P.extract_json_array('{"terms": ["a"]}') == ["a"]
    for bad in ("no json", "", "{a"):
        with pytest.raises(ValueError):
            P.extract_json(bad)
    with pytest.raises(ValueError):
        P.extract_json_array('{"a": 1, "b": []}')
    assert [P.truth(v, False) for v in (True, "yes", "false", {"verdict": "no"}, "maybe", None)] == [True, True, False, False, False, False]
    assert P.truth("what", True) is True


class Flaky:
    name = "flaky"

    def __init__(self, log):
        self.log = log

    def complete(self, prompt, temperature=0.0):
        with open(self.log, "a") as file:
            file.write(prompt + "\n")
        if prompt == "bad":
            raise OSError("down")
        return prompt.upper()


def test_asking_pays_once(spark, tmp_path):
    log, table = str(tmp_path / "log"), str(tmp_path / "replies")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "k int, prompt string")
    for _ in range(2):
        assert {r.k: r.reply for r in P.ask(rows, Flaky(log), table, pause=0).collect()} == {1: "A", 2: "A", 3: None, 4: None}
    asked = open(log).read().split()
    assert asked.count("a") == 1 and asked.count("bad") == 6


def system(question):
    if "capped" in question.lower():
        raise RuntimeError("no")
    return {"answer": "The Basic plan costs ten.", "contexts": ["The Basic plan costs ten. The Premium plan costs forty."]}


def test_generate_and_evaluate(spark, corpus, tmp_path):
    work = str(tmp_path / "work")
    made = api.generate(spark, corpus, work, tier="exhaustive", size=30, seed=3, chunk_size=12, chunk_overlap=0, pause=0)
    records = made.records.collect()
    kinds = {r.question_type for r in records}
    assert {"single_chunk", "cross_doc", "unanswerable", "adversarial", "compound", "ambiguous"} <= kinds <= set(config.QUESTION_TYPES)
    assert [r.id for r in sorted(records, key=lambda r: r.id)] == [f"eval-{i:04d}" for i in range(len(records))]
    assert all(r.gold_chunk_ids == [] for r in records if r.unanswerable) and all(len(r.gold_chunk_ids) == 2 for r in records if r.question_type == "compound")
    assert all(len(set(r.source_doc_ids)) == 2 for r in records if r.question_type == "cross_doc")
    path = str(tmp_path / "set.json")
    api.save(made, path)
    again = api.load(spark, path)
    assert {r.id: r for r in again.records.collect()} == {r.id: r for r in records} and again.chunks.count() == made.chunks.count()
    assert (again.tier, again.version, again.metadata["num_source_docs"]) == ("exhaustive", "1.0.0", "6")
    results, verdicts = api.evaluate(again, system, str(tmp_path / "run"), pause=0)
    assert results.count() == len(records) and verdicts.count() == 24 * len(records)
    assert results.where("overall < 0 or overall > 1 or chunk_recall > 1").count() == 0
    assert analytics.health(verdicts).first().verdict in {"broken", "needs_work", "healthy"}
    assert results.where("unanswerable and chunk_recall <> 1").count() == 0
    checks = E.validate(again, P.OfflineProvider(), str(tmp_path / "checks"), pause=0)
    assert checks.count() == len(config.CHECKS) * len(records) and quality.pass_rates(checks).count() == 4
    page = writers.html_report(results.withColumn("question", F.lit("<b>")))
    assert "<b>" not in page.split("</style>")[1].replace("<b>", "", 0) or "&lt;b&gt;" in page
    kept = results.select(*[c for c in results.columns if c in ("record_id", "question", "noise_profile", "chunk_recall")]).withColumn("overall_score", F.lit(0.5))
    writers.write_results(kept, "medium", str(tmp_path / "run.json"))
    back = readers.read_results(spark, str(tmp_path / "run.json"))
    assert {(r.record_id, r.chunk_recall, r.overall_score) for r in back.collect()} == {(r.record_id, r.chunk_recall, 0.5) for r in kept.collect()}
    flat = writers.flat(results.withColumnRenamed("overall", "overall_score"))
    assert len(flat.columns) == 19
    writers.write_csv(flat, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"').count() == len(records)
    rows = writers.review_rows(again.records).withColumn("reviewer_verdict", F.when(F.col("id") == "eval-0000", "reject").otherwise(""))
    writers.write_csv(rows.coalesce(1), str(tmp_path / "review"))
    cli.main(["review-import", path, "--csv", str(tmp_path / "review"), "--out", str(tmp_path / "set2.json")], spark)
    after = json.load(open(tmp_path / "set2.json"))
    assert len(after["records"]) == len(records) - 1 and after["version"] == "1.1.0"
    cli.main(["compare", str(tmp_path / "run/results"), str(tmp_path / "run/results")], spark)
    cli.main(["report", str(tmp_path / "run/results"), "--html", str(tmp_path / "r.html")], spark)
    cli.main(["staleness", path, corpus], spark)
    assert "records" in (tmp_path / "r.html").read_text() and writers.set_summary(again.records).startswith("records:")


def test_hashes_are_kept_beside_the_set_at_every_size(spark, corpus, tmp_path, capsys):
    made = api.generate(spark, corpus, str(tmp_path / "work"), tier="minimal", size=3, pause=0)
    assert "doc_hashes" not in made.metadata
    path = str(tmp_path / "set.json")
    api.save(made, path)
    held = api.load(spark, path)
    assert {tuple(r) for r in api.hashes(spark, held).collect()} == {tuple(r) for r in readers.doc_hashes(spark, corpus).collect()}
    doc = held.records.select(F.explode("source_doc_ids")).first()[0]
    spark.read.parquet(held.hashes).withColumn("hash", F.when(F.col("doc_id") == doc, "was another").otherwise(F.col("hash"))).write.parquet(str(tmp_path / "edited"))
    held.hashes = str(tmp_path / "edited")
    api.save(held, path)
    api.save(api.load(spark, path), path)
    cli.main(["staleness", path, corpus], spark)
    said = capsys.readouterr().out
    assert "modified" in said and "deleted" not in said
    held.hashes = ""
    api.save(held, path)
    with pytest.raises(ValueError):
        cli.main(["staleness", path, corpus], spark)
    held.metadata["doc_hashes"] = json.dumps({doc: "was another"})
    assert [tuple(r) for r in api.hashes(spark, held).collect()] == [(doc, "was another")]


def test_cost(spark, corpus, capsys):
    cli.main(["estimate", corpus, "--tier", "minimal", "--size", "40"], spark)
    assert "40 questions" in capsys.readouterr().out
    r = api.estimate_cost(spark, corpus, "minimal", 40).first()
    assert r.generation_out == 42_000 and r.evaluation_out == 7_200 and r.minutes == pytest.approx(6.0)
    assert api.estimate_cost(spark, corpus, "medium").first().questions > 0


def test_responses():
    assert E.normal_response(("a", ["c"])) == ("a", ["c"]) and E.normal_response({"answer": "x"}) == ("x", [])
    with pytest.raises(TypeError):
        E.normal_response("text")


def test_late_and_failing_systems(spark):
    import time

    def slow(q):
        if q == "slow":
            time.sleep(3)
        return ("ok", []) if q != "bad" else 1 / 0

    rows = spark.createDataFrame([("1", "slow"), ("2", "fine"), ("3", "bad")], "id string, question string")
    got = {r.id: (r.rag_answer, r.rag_error) for r in E.run_system(rows, slow, timeout=0.5).collect()}
    assert got["2"] == ("ok", None) and "0.5" in got["1"][1] and "ZeroDivision" in got["3"][1]


def test_resume(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(i,) for i in range(10)], "record_id long")
    work = lambda df: df.withColumn("score", F.lit(1.0))
    assert resume.resumed(rows.where("record_id < 4"), work, out).count() == 4
    assert resume.resumed(rows, work, out).count() == 10
    assert resume.resumed(rows, work, out).count() == 10


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i % 7,) for i in range(20)], "record_id long").write.parquet(source)
    for _ in range(2):
        read = spark.readStream.schema("record_id long").parquet(source)
        resume.stream(read, lambda df: df, out, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.record_id for r in spark.read.parquet(out).collect()) == list(range(7))
    rates = resume.rolling_yes_rates(spark.createDataFrame([("2024-01-01 00:10:00", "Q", True), ("2024-01-01 00:20:00", "Q", False)], "ts string, question_id string, verdict boolean").withColumn("ts", F.to_timestamp("ts")))
    assert [(r.n, r.yes_rate) for r in rates.collect()] == [(2, 0.5)]


def test_other_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("x\ny")
    assert [tuple(r) for r in readers.read_texts(spark, str(tmp_path / "t")).collect()] == [("a.txt", "x\ny")]
    rows = spark.createDataFrame([("s", ["l"]), ("t", [])], "source_id string, labels array<string>")
    sources = spark.createDataFrame([("s", "QA", "q", "p"), ("t", "Sum", "q", "p")], "source_id string, task_type string, question string, passages string")
    assert [r.has_hallucination for r in readers.calibration_rows(rows, sources).collect()] == [True]
    writers.write_jsonl(sources, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError):
        writers.joined_tables({"a": rows.where("false")})


class Random:
    """Rewrites differ with every call, and those of odd questions fail."""

    name = "random"

    def __init__(self, log):
        self.log = log

    def complete(self, prompt, temperature=0.0):
        task = prompt.partition("\n")[0].removeprefix("TASK ")
        with open(self.log, "a") as file:
            file.write(task + "\n")
        if task == "rewrite":
            if "odd" in prompt:
                raise OSError("down")
            return "rewritten " + uuid.uuid4().hex
        return '["Term"]' if task == "terms" else '{"answered": true}'


def test_rewrites_that_differ_are_asked_once(spark, tmp_path):
    log, cache = str(tmp_path / "log"), str(tmp_path / "cache")
    rows = [(str(i), f"{'odd' if i % 2 else 'even'} question {i} here", ["vocab_mismatch"], "Some Term") for i in range(6)]
    questions = spark.createDataFrame(rows, "id string, question string, layers array<string>, source string")
    noisy = noise.with_layers(questions, 0, lambda r, heat: P.ask(r, Random(log), cache, heat, 0))
    checked = P.ask(noisy.withColumn("prompt", F.concat(F.lit("TASK leak\n"), "noisy")), Random(log), cache, 0.0, 0).collect()
    assert all(r.reply for r in checked)
    assert {r.id: r.noise_profile for r in checked} == {str(i): ["clean"] if i % 2 else ["vocab_mismatch"] for i in range(6)}
    assert all(r.noisy == r.question if int(r.id) % 2 else r.noisy.startswith("rewritten") for r in checked)
    asked = open(log).read().split()
    assert asked.count("rewrite") == 3 + 3 * P.TRIES and asked.count("leak") == 6 and asked.count("terms") == 1


def test_plain_retriever(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"topic{i} word{i} thing{i}. More of topic{i}.") for i in range(12)] + [("x", "")], "chunk_id string, text string")

    def embed(rows):  # a dimension for each number in a text
        number = F.regexp_extract("text", r"topic(\d+)", 1)
        return rows.select("chunk_id", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.when(k.cast("string") == number, 1.0).otherwise(0.0).cast("float")).alias("embedding"))

    indexed = rag.index(chunks, embed)
    records = spark.createDataFrame([(f"q{i}", f"what about topic{i} word{i} thing{i}") for i in range(12)] + [("none", None)], "id string, question string")
    out = {r.record_id: r for r in rag.run_set(records, indexed, P.OfflineProvider(), str(tmp_path / "a"), k=3, embed=embed, pause=0).collect()}
    assert all(out[f"q{i}"].contexts[0].startswith(f"topic{i} ") and len(out[f"q{i}"].contexts) == 3 and out[f"q{i}"].answer == f"topic{i} word{i} thing{i}." for i in range(12))
    assert out["none"].contexts == []
    rows = rag.run_rows(spark.createDataFrame([("topic3 word3", "g")], "question string, ground_truth string"), rag.index(chunks.where("false")), P.OfflineProvider(), str(tmp_path / "b"), pause=0).collect()
    assert [(r.ground_truth, r.contexts) for r in rows] == [("g", [])]


def test_additions_and_removals_are_logged(spark):
    from ragloom.plans.generate import EvalSet
    from ragloom.sources import readers

    records = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, question string")
    held = EvalSet(records, records, spark.createDataFrame([], readers.CHANGE))
    more = held.with_added(spark.createDataFrame([("c", "3")], "id string, question string")).without(["a", "zz"])
    assert sorted(r.id for r in more.records.collect()) == ["b", "c"] and more.version == "1.2.0"
    assert sorted(map(tuple, more.changelog.collect())) == [("1.1.0", "add_records", "Added 1 records", ["c"]), ("1.2.0", "remove_records", "Removed 2 records", ["a", "zz"])]
