"""The quality of a set: filters, coverage, validation, leakage, stubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom import config
from ragloom.functions import text as T
from ragloom.operators.containment import contained

#: What an unfinished system returns.
_STUB_ANSWERS = ("todo", "your answer here", "answer", "...", "")
_STUB_CONTEXTS = ("your context here", "context", "...", *(f"chunk text {i}" for i in (1, 2)))
TARGETS = dict(zip(config.DIFFICULTIES, (0.3, 0.4, 0.3), strict=True))
_KEYS = {"question_type", "difficulty", "noise_type", "domain_tag", "unanswerable"}


def select(records: DataFrame, **wanted: object) -> DataFrame:
    """Records that meet all conditions: question_type, difficulty and noise_type take a value or a list, domain_tag a value, unanswerable a boolean."""
    if unknown := set(wanted) - _KEYS:
        raise ValueError(f"unknown filter {', '.join(sorted(unknown))}")
    listed = lambda v: list(v) if isinstance(v, (list, tuple, set)) else [v]
    out = records
    for key, value in wanted.items():
        if key in ("question_type", "difficulty"):
            out = out.where(F.col(key).isin(listed(value)))
        elif key == "noise_type":
            out = out.where(F.arrays_overlap("noise_profile", F.array(*map(F.lit, listed(value)))))
        elif key == "domain_tag":
            out = out.where(F.array_contains("domain_tags", value))
        else:
            out = out.where(F.col("unanswerable") == value)
    return out


def used_chunks(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Chunks that are gold for a record (gold_chunk_ids: groups of ids)."""
    ids = records.select(F.explode(F.flatten("gold_chunk_ids")).alias("chunk_id")).distinct()
    return chunks.join(ids, "chunk_id", "left_semi")


def coverage(records: DataFrame) -> DataFrame:
    """One row of shares and flags."""
    n = F.greatest(F.count("*"), F.lit(1)).cast("double")
    share = lambda c: F.count_if(c) / n
    levels = [(F.abs(share(F.col("difficulty") == d) - t) <= 0.15) for d, t in TARGETS.items()]
    one = records.agg(
        share(F.col("unanswerable")).alias("unanswerable_ratio"), share(F.col("question_type") == "cross_doc").alias("cross_doc_ratio"), share(F.col("question_type") == "contradiction").alias("contradiction_ratio"),
        F.count_distinct("question_type").alias("types_present"), ((levels[0] & levels[1] & levels[2]) | (F.count("*") == 0)).alias("difficulty_ok"),
    )
    tags = records.select(F.explode("domain_tags").alias("tag")).groupBy("tag").count().agg(F.coalesce(F.min("count") >= 10, F.lit(True)).alias("domain_ok"))
    return one.crossJoin(tags).withColumn("noise_ok", F.lit(True))


def type_presence(records: DataFrame, types: tuple[str, ...] = config.QUESTION_TYPES) -> DataFrame:
    """question_type, present for every type there is."""
    all_types = records.sparkSession.createDataFrame([(t,) for t in types], "question_type string")
    return all_types.join(records.select("question_type").distinct().withColumn("present", F.lit(True)), "question_type", "left").select("question_type", F.coalesce("present", F.lit(False)).alias("present"))


def stratification(records: DataFrame, floors: dict[str, int]) -> DataFrame:
    """question_type, n, floor, ok against least counts."""
    dim = records.sparkSession.createDataFrame(list(floors.items()), "question_type string, floor long")
    counted = records.groupBy("question_type").agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counted, "question_type", "left").select("question_type", F.coalesce("n", F.lit(0)).alias("n"), "floor", (F.coalesce("n", F.lit(0)) >= F.col("floor")).alias("ok"))


def pass_rates(checks: DataFrame) -> DataFrame:
    """grp, n, pass_rate by the first two letters of check_id; checks: record_id, check_id, passed (null counts as passed)."""
    ok = F.coalesce("passed", F.lit(True))
    return checks.groupBy(F.substring("check_id", 1, 2).alias("grp")).agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("pass_rate"))


def flagged(checks: DataFrame) -> DataFrame:
    """record_id, failed (sorted checks) of records that fail more than one."""
    bad = checks.where(~F.coalesce("passed", F.lit(True))).groupBy("record_id").agg(F.array_sort(F.collect_set("check_id")).alias("failed"))
    return bad.where(F.size("failed") > 1)


def one_document_pairs(records: DataFrame) -> DataFrame:
    """record_id of cross-document questions that draw on fewer than two documents."""
    return records.where((F.col("question_type") == "cross_doc") & (F.size(F.array_distinct("source_doc_ids")) < 2)).select("record_id")


def share_gaps(records: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """question_type, share, wanted, gap of each type's share and what was asked for."""
    dim = records.sparkSession.createDataFrame(list(wanted.items()), "question_type string, wanted double")
    counted = records.groupBy("question_type").agg(F.count("*").alias("n"))
    total = records.agg(F.count("*").alias("total"))
    joined = dim.join(counted, "question_type", "left").crossJoin(total)
    return joined.select("question_type", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("share"), "wanted").withColumn("gap", F.col("share") - F.col("wanted"))


def with_resolvability(checks: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Check GC5 fails for records whose gold chunks don't all exist."""
    missing = unresolved.select("record_id", F.lit(True).alias("missing"))
    joined = checks.join(missing, "record_id", "left")
    return joined.withColumn("passed", F.when((F.col("check_id") == "GC5") & F.coalesce("missing", F.lit(False)), False).otherwise(F.col("passed"))).drop("missing")


def leaks(answers: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, doc_id of answers (item_id, text) that a text (doc_id, text) contains word for word, normalised."""
    return contained(answers, texts)


def keep_unleaked(records: DataFrame, leaked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that are kept (unanswerable ones always) and ids of those that go; leaked: record_id, leaked."""
    joined = records.join(leaked.select("record_id", F.coalesce("leaked", F.lit(False)).alias("leaked")), "record_id", "left").withColumn("leaked", F.coalesce("leaked", F.lit(False)) & ~F.col("unanswerable"))
    return joined.where(~F.col("leaked")).drop("leaked"), joined.where("leaked").select("record_id")


def stub_reasons(outputs: DataFrame) -> DataFrame:
    """n, placeholders, distinct_outputs, is_stub of a system's outputs (answer, contexts)."""
    answer = F.lower(T.strip(F.coalesce("answer", F.lit("")))).isin(*_STUB_ANSWERS)
    held = answer | F.coalesce(F.exists("contexts", lambda c: F.lower(T.strip(c)).isin(*_STUB_CONTEXTS)), F.lit(False))
    one = outputs.agg(F.count("*").alias("n"), F.count_if(held).alias("placeholders"), F.count_distinct(F.struct("answer", "contexts")).alias("distinct_outputs"))
    return one.withColumn("is_stub", (F.col("placeholders") > 0) | ((F.col("n") >= 2) & (F.col("distinct_outputs") == 1)))
