"""Changes of a set over time: staleness, review, additions, removals, resume, answers already paid for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import scalars as S
from ragloom.functions import text as T


def stale(records: DataFrame, original: DataFrame, current: DataFrame) -> DataFrame:
    """record_id, doc_id, change: the first document, in a record's order, that was deleted or modified.

    records: record_id, source_doc_ids; original and current: doc_id, hash. Documents without an original hash don't count.
    """
    docs = records.select("record_id", F.posexplode("source_doc_ids").alias("pos", "doc_id"))
    now = current.select("doc_id", F.col("hash").alias("now"))
    joined = docs.join(original.where("hash is not null").select("doc_id", F.col("hash").alias("was")), "doc_id").join(now, "doc_id", "left")
    changed = joined.where("now is null or now <> was").withColumn("change", F.when(F.col("now").isNull(), "deleted").otherwise("modified"))
    first = changed.groupBy("record_id").agg(F.min_by(F.struct("doc_id", "change"), "pos").alias("x"))
    return first.select("record_id", "x.doc_id", "x.change")


def stale_summary(records: DataFrame, found: DataFrame) -> DataFrame:
    """n_records, n_stale, ratio (0 for an empty set)."""
    n = records.agg(F.count("*").alias("n_records"))
    return n.crossJoin(found.agg(F.count("*").alias("n_stale"))).withColumn("ratio", F.coalesce(F.try_divide("n_stale", "n_records"), F.lit(0.0)))


def reviewed(records: DataFrame, review: DataFrame) -> DataFrame:
    """Records after review (id, reviewer_verdict, reviewer_notes): rejected ones go, edited ones take the notes as their gold answer.

    Other verdicts, unknown ids and blank notes change nothing; of several rows on a record a rejection counts first, then the
    last edit, by the column ord where the review has one (files are read with it), else by its notes.
    """
    verdict = F.lower(T.strip(F.coalesce("reviewer_verdict", F.lit(""))))
    notes = T.strip(F.coalesce("reviewer_notes", F.lit("")))
    order = F.col("ord") if "ord" in review.columns else F.lit(0)
    r = review.select(F.col("id").alias("record_id"), verdict.alias("v"), notes.alias("notes"), order.alias("ord"))
    one = r.groupBy("record_id").agg(F.bool_or(F.col("v") == "reject").alias("gone"), F.max(F.when((F.col("v") == "edit") & (F.col("notes") != ""), F.struct("ord", "notes")))["notes"].alias("edit"))
    joined = records.join(one, "record_id", "left").where(~F.coalesce("gone", F.lit(False)))
    return joined.withColumn("gold_answer", F.coalesce("edit", "gold_answer")).drop("gone", "edit")


def review_log(records: DataFrame, review: DataFrame, version: str = "1.0.0") -> DataFrame:
    """action, n, version: what applying the review did; removals raise the minor version, edits then the patch."""
    verdict = F.lower(T.strip(F.coalesce("reviewer_verdict", F.lit(""))))
    known = review.join(records.select(F.col("record_id").alias("id")), "id", "left_semi").select(verdict.alias("v"), (T.strip(F.coalesce("reviewer_notes", F.lit(""))) != "").alias("noted"))
    n = known.agg(F.count_if(F.col("v") == "reject").alias("rejected"), F.count_if((F.col("v") == "edit") & F.col("noted")).alias("edited"))
    start = F.lit(version)
    after = F.when(F.col("rejected") > 0, S.bumped(start, "minor")).otherwise(start)
    final = F.when(F.col("edited") > 0, S.bumped(after, "patch")).otherwise(after)
    both = n.select(F.explode(F.array(F.struct(F.lit("remove_records").alias("action"), F.col("rejected").alias("n"), after.alias("version")), F.struct(F.lit("apply_review").alias("action"), F.col("edited").alias("n"), final.alias("version")))).alias("x"))
    return both.select("x.*").where("n > 0")


def added(records: DataFrame, more: DataFrame) -> DataFrame:
    """Both, repeated ids included: what is added is never looked up first."""
    return records.unionByName(more)


def removed(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("record_id"), "record_id", "left_anti")


def pending(records: DataFrame, done: DataFrame) -> DataFrame:
    """What is still to do; null ids are never done."""
    return records.join(done.select("record_id"), "record_id", "left_anti")


def doc_hashes(files: DataFrame) -> DataFrame:
    """doc_id, hash of files (path, content): the stem's last path wins."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.groupBy(stem.alias("doc_id")).agg(F.max_by(F.sha2("content", 256), "path").alias("hash"))


def answered(prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prompts with an answer in the cache (key, response), and the distinct ones to ask; prompts: model, temperature, prompt."""
    keyed = prompts.withColumn("key", S.cache_key("model", "temperature", "prompt"))
    known = keyed.join(cache.select("key", "response"), "key")
    return known, keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Column ord from 0 in the order of an integer key without gathering all rows in one task: slots of keys are counted, then numbered inside."""
    slot: Column = F.floor(F.col(key) / 65_536)
    sizes = rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    before = sizes.select("slot", (F.sum("n").over(Window.orderBy("slot")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("slot").orderBy(key)) - 1
    return rows.withColumn("slot", slot).withColumn("inside", inside).join(before, "slot").withColumn("ord", (F.col("before") + F.col("inside")).cast("long")).drop("slot", "inside", "before")
