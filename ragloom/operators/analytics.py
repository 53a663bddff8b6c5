"""Grouped means, yes-rates, correlations of questions and the health of scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom import config
from ragloom.functions import text as T

#: Parts that the sort of all runs is cut into at least.
STREAK_PARTS = 200
#: Means over present scores, and those that count absent ones as 0 if any is present.
_PLAIN = ("faithfulness", "correctness", "abstention")
_OPTIONAL = ("completeness", "conciseness")


def aggregates(results: DataFrame) -> list[Column]:
    """count and means; columns that the results don't have are left out."""
    has = set(results.columns)
    out = [F.count("*").alias("n"), F.coalesce(F.avg("overall"), F.lit(0.0)).alias("mean_overall")]
    out += [F.coalesce(F.avg(d), F.lit(0.0)).alias(f"mean_{d}") for d in _PLAIN if d in has]
    out += [F.when(F.count(d) > 0, F.sum(d) / F.count("*")).alias(f"mean_{d}") for d in _OPTIONAL if d in has]
    if "set_recall" in has:
        out.append(F.avg(F.col("set_recall").cast("double")).alias("mean_set_recall"))
    if "chunk_recall" in has:
        out.append(F.avg("chunk_recall").alias("mean_chunk_recall"))
    return out


def by_group(results: DataFrame, key: Column | str, name: str) -> DataFrame:
    return results.groupBy(T.col(key).alias(name)).agg(*aggregates(results))


def by_question_type(results: DataFrame) -> DataFrame:
    return by_group(results, "question_type", "question_type")


def by_noise(results: DataFrame) -> DataFrame:
    return by_group(results, T.noise_key("noise_profile"), "noise")


def by_difficulty(results: DataFrame) -> DataFrame:
    return by_group(results, "difficulty", "difficulty")


def by_domain(results: DataFrame) -> DataFrame:
    """A record counts for each of its tags."""
    return by_group(results.withColumn("domain", F.explode("domain_tags")), "domain", "domain")


def all_breakdowns(results: DataFrame) -> DataFrame:
    """facet, value and means for types, noise and difficulty from one scan (grouping sets)."""
    named = results.withColumn("noise", T.noise_key("noise_profile"))
    sets = named.groupingSets([[F.col("question_type")], [F.col("noise")], [F.col("difficulty")]], F.col("question_type"), F.col("noise"), F.col("difficulty"))
    rows = sets.agg(F.grouping_id().alias("gid"), *aggregates(results))
    facet = F.when(F.col("gid") == 3, "question_type").when(F.col("gid") == 5, "noise").otherwise("difficulty")
    return rows.withColumn("facet", facet).withColumn("value", F.coalesce("question_type", "noise", "difficulty")).drop("gid", "question_type", "noise", "difficulty")


def worst_dimensions(results: DataFrame) -> DataFrame:
    """dimension, mean_score over present scores, worst first."""
    dims = [d for d in config.DIMENSIONS if d in results.columns]
    long = results.select(*dims).unpivot([], dims, "dimension", "score").where("score is not null")
    return long.groupBy("dimension").agg(F.avg("score").alias("mean_score")).orderBy("mean_score", "dimension")


def failed(results: DataFrame, below: float = config.PASS_SCORE) -> DataFrame:
    return results.where(F.col("overall") < below)


def failure_patterns(results: DataFrame, below: float = 0.8) -> DataFrame:
    return by_question_type(results).where(F.col("mean_overall") < below).select("question_type", "mean_overall", "n").orderBy("mean_overall", "question_type")


def yes_rates(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("dimension", "question_id").agg(F.count("*").alias("n"), F.avg(F.col("verdict").cast("double")).alias("yes_rate"))


def worst_questions(verdicts: DataFrame, n: int = 10) -> DataFrame:
    """The feature is the top n: the questions answered yes least often."""
    return yes_rates(verdicts).select("question_id", "yes_rate").orderBy("yes_rate", "question_id").limit(n)


def spreads(verdicts: DataFrame) -> DataFrame:
    return yes_rates(verdicts).groupBy("dimension").agg((F.max("yes_rate") - F.min("yes_rate")).alias("spread"))


def phi_matrix(verdicts: DataFrame) -> DataFrame:
    """dimension, question_a, question_b, phi over ordered pairs of a dimension's questions.

    Each record's verdicts of a dimension are one array, so pairs come from the record itself and the data is
    shuffled once by record; what leaves is four counts for each pair. Rows that repeat a record's question count once
    (the largest verdict). phi is 1 on the diagonal and 0 where either question never varies.
    """
    q = F.struct(F.col("question_id").alias("q"), F.col("v"))
    one = verdicts.groupBy("record_id", "dimension", "question_id").agg(F.max("verdict").alias("v"))
    rows = one.groupBy("record_id", "dimension").agg(F.collect_list(q).alias("qs"))
    pairs = rows.select("dimension", F.explode("qs").alias("a"), "qs").select("dimension", "a", F.explode("qs").alias("b"))
    hit = lambda a, b: F.count_if((F.col("a.v") == a) & (F.col("b.v") == b)).cast("double")
    counts = pairs.groupBy("dimension", F.col("a.q").alias("question_a"), F.col("b.q").alias("question_b")).agg(hit(True, True).alias("yy"), hit(True, False).alias("yn"), hit(False, True).alias("ny"), hit(False, False).alias("nn"))
    c = {k: F.col(k) for k in ("yy", "yn", "ny", "nn")}
    under = (c["yy"] + c["yn"]) * (c["ny"] + c["nn"]) * (c["yy"] + c["ny"]) * (c["yn"] + c["nn"])
    value = (c["yy"] * c["nn"] - c["yn"] * c["ny"]) / F.sqrt(F.nullif(under, F.lit(0.0)))
    phi = F.when(F.col("question_a") == F.col("question_b"), 1.0).otherwise(F.coalesce(value, F.lit(0.0)))
    return counts.select("dimension", "question_a", "question_b", phi.alias("phi"))


def twin_questions(phi: DataFrame, above: float = config.TWIN_PHI) -> DataFrame:
    """Pairs that tell the same, strongest first."""
    pairs = phi.where((F.col("question_a") < F.col("question_b")) & (F.abs("phi") > above))
    return pairs.select("question_a", "question_b", "phi").orderBy(F.desc(F.abs("phi")), "question_a", "question_b")


def phi_summary(phi: DataFrame) -> DataFrame:
    """mean_phi (of absolute values off the diagonal, 0 without any), weak_share (1 without any), twins."""
    off = phi.where("question_a <> question_b")
    return off.agg(
        F.coalesce(F.avg(F.abs("phi")), F.lit(0.0)).alias("mean_phi"),
        F.coalesce(F.avg((F.abs("phi") < config.WEAK_PHI).cast("double")), F.lit(1.0)).alias("weak_share"),
        F.count_if((F.col("question_a") < F.col("question_b")) & (F.abs("phi") > config.TWIN_PHI)).alias("twins"),
    )


def _ladder(spread: Column, phi: Column, weak: Column, uncovered: Column) -> Column:
    """The verdict, step by step; a later step changes only what it may."""
    verdict = F.when(spread < config.SPREAD_LEAST, "broken").when(spread < config.SPREAD_HEALTHY, "needs_work").otherwise("healthy")
    verdict = F.when(phi > config.PHI_MOST, "broken").when((phi > config.PHI_HEALTHY) & (verdict == "healthy"), "needs_work").otherwise(verdict)
    return F.when((verdict == "healthy") & ((weak < config.WEAK_SHARE) | uncovered), "needs_work").otherwise(verdict)


def health(verdicts: DataFrame) -> DataFrame:
    """One row: verdict and what it rests on."""
    rates = yes_rates(verdicts)
    spread = rates.groupBy("dimension").agg((F.max("yes_rate") - F.min("yes_rate")).alias("spread"), F.min("yes_rate").alias("least"), F.count_if(F.col("yes_rate") > config.YES_MOST).alias("easy"), F.count_if(F.col("yes_rate") < 1 - config.YES_MOST).alias("strict"))
    top = spread.agg(F.coalesce(F.min("spread"), F.lit(0.0)).alias("min_spread"), F.min("least").alias("least"), F.coalesce(F.sum("easy"), F.lit(0)).alias("too_easy"), F.coalesce(F.sum("strict"), F.lit(0)).alias("too_strict"))
    one = top.crossJoin(phi_summary(phi_matrix(verdicts)))
    uncovered = F.coalesce(F.col("least") >= 0.98, F.lit(True))
    return one.select(
        _ladder(F.col("min_spread"), F.col("mean_phi"), F.col("weak_share"), uncovered).alias("verdict"),
        "min_spread", "mean_phi", "weak_share", "twins", "too_easy", "too_strict", F.when(uncovered, len(config.FAILURE_MODES)).otherwise(0).alias("uncovered_modes"),
    )


def health_by_dimension(verdicts: DataFrame) -> DataFrame:
    """The same figures for each dimension."""
    rates = yes_rates(verdicts).groupBy("dimension").agg((F.max("yes_rate") - F.min("yes_rate")).alias("spread"), F.min("yes_rate").alias("least"), F.max("yes_rate").alias("most"))
    off = phi_matrix(verdicts).where("question_a <> question_b").groupBy("dimension").agg(F.avg(F.abs("phi")).alias("mean_phi"), F.avg((F.abs("phi") < config.WEAK_PHI).cast("double")).alias("weak_share"), (F.count_if(F.abs("phi") > config.TWIN_PHI) / 2).cast("long").alias("twins"))
    joined = rates.join(off, "dimension", "left").withColumn("mean_phi", F.coalesce("mean_phi", F.lit(0.0))).withColumn("weak_share", F.coalesce("weak_share", F.lit(1.0))).withColumn("twins", F.coalesce("twins", F.lit(0).cast("long")))
    return joined.withColumn("verdict", _ladder(F.col("spread"), F.col("mean_phi"), F.col("weak_share"), F.col("least") >= 0.98))


def retrieval_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.coalesce(F.avg(F.col("set_recall").cast("double")), F.lit(0.0)).alias("mean_set_recall"), F.coalesce(F.avg("chunk_recall"), F.lit(0.0)).alias("mean_chunk_recall"), F.avg("mrr").alias("mean_mrr"), F.avg("precision_at_k").alias("mean_precision_at_k")
    )


def distribution(records: DataFrame, facet: str) -> DataFrame:
    """value, n for question_type, difficulty, noise or domain."""
    keys = {"question_type": F.col("question_type"), "difficulty": F.col("difficulty"), "noise": T.noise_key("noise_profile")}
    if facet == "domain":
        return records.select(F.explode("domain_tags").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return records.groupBy(keys[facet].alias("value")).agg(F.count("*").alias("n"))


def document_coverage(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Share of the chunks' documents that a record draws on (0 without chunks)."""
    docs = chunks.select("doc_id").distinct()
    used = records.select(F.explode("source_doc_ids").alias("doc_id")).distinct().withColumn("used", F.lit(1))
    return docs.join(used, "doc_id", "left").agg(F.count("*").alias("docs"), F.count("used").alias("used")).withColumn("coverage", F.coalesce(F.try_divide("used", "docs"), F.lit(0.0)))


def chunk_coverage(gold_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Share of chunks that are gold for some record."""
    used = gold_ids.select("chunk_id").distinct().withColumn("used", F.lit(1))
    return chunks.select("chunk_id").join(used, "chunk_id", "left").agg(F.count("*").alias("chunks"), F.count("used").alias("used")).withColumn("coverage", F.coalesce(F.try_divide("used", "chunks"), F.lit(0.0)))


def domain_sparsity(docs: DataFrame, records: DataFrame, least: float = 0.10) -> DataFrame:
    """domain, docs, docs_used, ratio, questions, sparse; docs: doc_id, domain; records: record_id, source_doc_ids."""
    use = records.select("record_id", F.explode("source_doc_ids").alias("doc_id"))
    joined = docs.join(use, "doc_id", "left")
    grouped = joined.groupBy("domain").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct(F.when(F.col("record_id").isNotNull(), F.col("doc_id"))).alias("docs_used"), F.count_distinct("record_id").alias("questions"))
    return grouped.withColumn("ratio", F.col("docs_used") / F.col("docs")).withColumn("sparse", F.col("ratio") < least)


def red_flags(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row of conditions that make a set or a judge suspect."""
    one = records.agg(
        (F.avg((F.col("question_type") == "single_chunk").cast("double")) > 0.8).alias("mostly_single_chunk"),
        (F.count_if("unanswerable") == 0).alias("no_unanswerable"),
        (F.count_if(T.noise_key("noise_profile") != "clean") == 0).alias("no_noise"),
    )
    failing = yes_rates(verdicts).agg(F.count_if(F.col("yes_rate") < 0.5).alias("questions_failing_half"))
    return one.crossJoin(failing)


def perfect_streaks(history: DataFrame, runs: int = 5) -> DataFrame:
    """record_id of records (record_id, run, overall) that ended with that many perfect runs in a row."""
    back = Window.partitionBy("record_id").orderBy(F.desc("run"))
    parts = max(STREAK_PARTS, int(history.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = history.repartition(parts, "record_id").withColumn("back", F.row_number().over(back))  # with a number they stay apart: packed rows joined by their bytes take a hundred times as much to sort
    recent = numbered.where(F.col("back") <= runs).groupBy("record_id").agg(F.count("*").alias("n"), F.min("overall").alias("least"))
    return recent.where((F.col("n") == runs) & (F.col("least") >= 1.0)).select("record_id")


def intent_rates(points: DataFrame) -> DataFrame:
    """required, n, rate: how many intent points (required, covered) there are of each kind, and the share that is covered."""
    return points.groupBy("required").agg(F.count("*").alias("n"), F.avg(F.col("covered").cast("double")).alias("rate"))


def coverage_disagreements(results: DataFrame, coverage: str = "intent_coverage") -> DataFrame:
    """record_id, kind of results whose coverage (a column) is low with a high overall score, or high with a low one."""
    low, high = (F.col(coverage) < 0.7) & (F.col("overall") > 0.8), (F.col(coverage) > 0.9) & (F.col("overall") < 0.7)
    return results.where(low | high).select("record_id", F.when(low, "covers_less").otherwise("covers_more").alias("kind"))
