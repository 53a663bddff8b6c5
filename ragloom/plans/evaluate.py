"""A set against a system: its answers, retrieval metrics, judged verdicts and scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom import config
from ragloom.operators import retrieval, scoring
from ragloom.plans import providers as P
from ragloom.plans.generate import EvalSet
from ragloom.plans.providers import Provider, prompt


def normal_response(value: Any) -> tuple[str, list[str]]:
    """Answer and contexts of a mapping, a pair or an object."""
    if isinstance(value, dict):
        return str(value.get("answer", "")), [str(c) for c in value.get("contexts") or []]
    if isinstance(value, tuple) and len(value) == 2:
        return str(value[0]), [str(c) for c in value[1] or []]
    if hasattr(value, "answer") and hasattr(value, "contexts"):
        return str(value.answer), [str(c) for c in value.contexts or []]
    raise TypeError(f"a system returns a mapping, a pair or an object with answer and contexts, not {type(value).__name__}")


def run_system(records: DataFrame, system: Callable[[str], Any], timeout: float = 60.0, parallel: int = 4) -> DataFrame:
    """id, rag_answer, rag_contexts, rag_error; a failure or a late answer is an empty answer with a message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(parallel)
        try:
            for pdf in batches:
                waiting = [pool.submit(lambda q: normal_response(system(q)), q) for q in pdf["question"]]
                out = []
                for w in waiting:
                    try:
                        answer, contexts = w.result(timeout)
                        out.append((answer, contexts, None))
                    except Late:
                        out.append(("", [], f"no answer after {timeout} s"))
                    except Exception as wrong:  # noqa: BLE001  a system may fail in any way
                        out.append(("", [], f"{type(wrong).__name__}: {wrong}"))
                answers = pd.DataFrame(out, columns=["rag_answer", "rag_contexts", "rag_error"])
                yield pd.concat([pdf[["id"]].reset_index(drop=True), answers], axis=1)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)  # a late call doesn't hold the task

    return records.select("id", "question").mapInPandas(run, "id string, rag_answer string, rag_contexts array<string>, rag_error string")


def _judged(rows: DataFrame, ids: list[str], provider: Provider, table: str, default: bool, pause: float) -> DataFrame:
    """record_id, question_id, verdict for each id; what is missing or unreadable gets the default."""

    @F.pandas_udf("array<struct<question_id:string,verdict:boolean>>")
    def parse(replies: pd.Series) -> pd.Series:
        out = []
        for r in replies:
            try:
                found = P.extract_json(r) if r else {}
            except ValueError:
                found = {}
            out.append([{"question_id": q, "verdict": P.truth(found.get(q) if isinstance(found, dict) else None, default)} for q in ids])
        return pd.Series(out)

    replies = P.ask(rows, provider, table, 0.0, pause)
    return replies.select(F.col("id").alias("record_id"), F.inline(parse("reply")))


def evaluate(eval_set: EvalSet, system: Callable[[str], Any], provider: Provider, work: str, scoring_set: list | str | None = None, weights: Mapping[str, float] | None = None, timeout: float = 60.0, pause: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """results and verdicts of a run; both are written below ``work``, with the model's replies."""
    spark = eval_set.records.sparkSession
    questions = config.questions_for(scoring_set, eval_set.tier)
    shares = config.weights_for(dict(weights) if weights is not None else None, questions, eval_set.tier, isinstance(scoring_set, list))
    records = eval_set.records
    run_system(records, system, timeout).write.mode("overwrite").parquet(f"{work}/outputs")
    outputs = spark.read.parquet(f"{work}/outputs")
    gold = records.select(F.col("id").alias("record_id"), F.posexplode("gold_chunks_text").alias("grp", "g")).select("record_id", "grp", F.posexplode("g").alias("pos", "text"))
    contexts = outputs.select(F.col("id").alias("record_id"), F.posexplode("rag_contexts").alias("p", "text")).select("record_id", (F.col("p") + 1).cast("long").alias("rank"), "text")
    found = retrieval.retrieval_scores(records.select(F.col("id").alias("record_id")), gold, contexts)
    joined = records.join(outputs, "id")
    held = F.concat_ws("\n", F.transform("rag_contexts", lambda c: F.concat(F.lit("[context] "), c)))
    wording = "\n".join(f"{q}: {text}" for q, _, text, _ in questions)
    asked = joined.withColumn("prompt", F.concat_ws("\n", prompt("judge", ("questions", " ".join(q[0] for q in questions)), ("wording", wording), ("question", F.col("question")), ("expected", F.col("gold_answer")), ("answer", F.col("rag_answer"))), held))
    dims = spark.createDataFrame([(q, d, w) for q, d, _, w in questions], "question_id string, dimension string, weight double")
    _judged(asked, [q[0] for q in questions], provider, f"{work}/replies", False, pause).join(F.broadcast(dims), "question_id").write.mode("overwrite").parquet(f"{work}/verdicts")
    verdicts = spark.read.parquet(f"{work}/verdicts")
    scores = scoring.record_scores(verdicts, [(q, d, w) for q, d, _, w in questions], shares)
    points = joined.select("id", "rag_answer", F.explode("intent_points").alias("p")).select(F.col("id").alias("rid"), F.col("p.id").alias("point_id"), F.col("p.required").alias("required"), "rag_answer", F.col("p.text").alias("text"))
    intents = P.ask(points.withColumn("prompt", prompt("intent", ("point", F.col("text")), ("answer", F.col("rag_answer")))), provider, f"{work}/replies", 0.0, pause)
    flag = F.pandas_udf(lambda s: s.map(_covered), "boolean")
    intents = intents.select(F.col("rid").alias("record_id"), "point_id", "required", flag(F.coalesce("reply", F.lit(""))).alias("covered"), F.lit(0).alias("ord"))
    covered = scoring.intent_coverage(intents.select("record_id", "point_id", "required"), intents.select("record_id", "point_id", "covered", "ord"))
    results = joined.withColumnRenamed("id", "record_id").join(found, "record_id").join(scores, "record_id", "left").join(covered, "record_id", "left")
    results = results.withColumn("intent_coverage", F.coalesce("coverage", F.lit(1.0))).drop("coverage").withColumn("overall", F.coalesce("overall", F.lit(0.0)))
    results.write.mode("overwrite").parquet(f"{work}/results")
    return spark.read.parquet(f"{work}/results"), verdicts


def _covered(reply: str) -> bool:
    try:
        found = P.extract_json(reply)
    except ValueError:
        return False
    return P.truth(found.get("covered"), False) if isinstance(found, dict) else False


def validate(eval_set: EvalSet, provider: Provider, work: str, pause: float = 1.0) -> DataFrame:
    """record_id, check_id, passed: questions about the set's own quality; a failed call counts as passed."""
    checks = [c for c in config.CHECKS if eval_set.tier == "exhaustive" or not c.startswith("NR")]
    rows = eval_set.records.withColumn("prompt", prompt("check", ("questions", " ".join(checks)), ("question", F.col("question")), ("expected", F.col("gold_answer"))))
    judged = _judged(rows, checks, provider, f"{work}/replies", True, pause).select("record_id", F.col("question_id").alias("check_id"), F.col("verdict").alias("passed"))
    ids = eval_set.records.select(F.col("id").alias("record_id"), F.explode(F.flatten("gold_chunk_ids")).alias("chunk_id"))
    missing = retrieval.resolvable(ids, eval_set.chunks.select(F.col("id").alias("chunk_id")))
    joined = judged.join(missing.withColumn("missing", F.lit(True)), "record_id", "left")
    return joined.select("record_id", "check_id", F.when((F.col("check_id") == "GC5") & F.coalesce("missing", F.lit(False)), False).otherwise(F.col("passed")).alias("passed"))


def replay(outputs: DataFrame) -> DataFrame:
    """question, rag_answer, rag_contexts of a stored run: the last of several answers to a question counts; outputs: ord, question, ..."""
    return outputs.groupBy("question").agg(F.max_by("rag_answer", "ord").alias("rag_answer"), F.max_by("rag_contexts", "ord").alias("rag_contexts"))


def contrast_scores(pairs: DataFrame, provider: Provider, work: str, questions: list[str], pause: float = 1.0) -> DataFrame:
    """id, good, bad: the share of questions answered yes for the better and the worse answer of each row (id, question, context, good_answer, bad_answer)."""
    long = pairs.select("id", "question", "context", F.explode(F.create_map(F.lit("good"), F.col("good_answer"), F.lit("bad"), F.col("bad_answer"))).alias("side", "answer"))
    asked = long.withColumn("prompt", prompt("judge", ("questions", " ".join(questions)), ("question", F.col("question")), ("answer", F.col("answer")), ("context", F.col("context"))))
    judged = _judged(asked.withColumn("id", F.concat_ws("|", "side", "id")), questions, provider, f"{work}/replies", False, pause)
    rate = judged.groupBy("record_id").agg(F.avg(F.col("verdict").cast("double")).alias("rate"))
    split = rate.select(F.substring_index("record_id", "|", 1).alias("side"), F.expr("substring(record_id, instr(record_id, '|') + 1)").alias("id"), "rate")
    return split.groupBy("id").agg(F.max(F.when(F.col("side") == "good", F.col("rate"))).alias("good"), F.max(F.when(F.col("side") == "bad", F.col("rate"))).alias("bad"))
