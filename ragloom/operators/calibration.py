"""A judge against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agreement(rows: DataFrame, truth: str = "truth", judged: str = "judged", by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall, f1 (0 where undefined), raw agreement, kappa (NaN where a side has one class), base rates."""
    t, j = F.col(truth), F.col(judged)
    n = F.count("*").cast("double")
    grouped = rows.groupBy(*(by or []))
    counts = grouped.agg(n.alias("n"), F.count_if(t & j).cast("double").alias("tp"), F.count_if(~t & j).cast("double").alias("fp"), F.count_if(t & ~j).cast("double").alias("fn"), F.count_if(~t & ~j).cast("double").alias("tn"))
    c = {k: F.col(k) for k in ("n", "tp", "fp", "fn", "tn")}
    zero = F.lit(0.0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    precision, recall = ratio(c["tp"], c["tp"] + c["fp"]), ratio(c["tp"], c["tp"] + c["fn"])
    raw = ratio(c["tp"] + c["tn"], c["n"])
    chance = ratio((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) + (c["fn"] + c["tn"]) * (c["fp"] + c["tn"]), c["n"] * c["n"])
    one_class = (c["tp"] + c["fn"] == 0) | (c["fp"] + c["tn"] == 0) | (c["tp"] + c["fp"] == 0) | (c["fn"] + c["tn"] == 0)
    return counts.select(
        *(by or []), *(c[k].cast("long").alias(k) for k in c), precision.alias("precision"), recall.alias("recall"), ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]).alias("f1"), raw.alias("raw_agreement"),
        F.when(one_class, F.lit(float("nan"))).otherwise(F.try_divide(raw - chance, 1 - chance)).alias("kappa"), ratio(c["tp"] + c["fn"], c["n"]).alias("rate_truth"), ratio(c["tp"] + c["fp"], c["n"]).alias("rate_judged"),
    )


def agreement_by_question(rows: DataFrame, truth: str, questions: list[str]) -> DataFrame:
    """Agreement of each question (columns that are true for yes): a no flags the answer."""
    long = rows.select(truth, *questions).unpivot([truth], questions, "question_id", "yes").withColumn("judged", ~F.col("yes"))
    return agreement(long, truth, "judged", ["question_id"])


def pairwise(rows: DataFrame, good: str = "good", bad: str = "bad") -> DataFrame:
    """n, wins, ties, losses, accuracy (ties count half; NaN without rows)."""
    g, b = F.col(good), F.col(bad)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(g > b).alias("wins"), F.count_if(g == b).alias("ties"), F.count_if(g < b).alias("losses"))
    return counts.withColumn("accuracy", F.coalesce(F.try_divide(F.col("wins") + 0.5 * F.col("ties"), F.col("n").cast("double")), F.lit(float("nan"))))


def corrected_rate(judged: DataFrame, labelled: DataFrame, z: float = 1.96) -> DataFrame:
    """rate, low, high: the automated mean, corrected by the mean error on a labelled part, with its interval."""
    m = judged.agg(F.avg(F.col("judged").cast("double")).alias("p"), F.count("*").cast("double").alias("n"))
    error = F.col("truth").cast("double") - F.col("judged").cast("double")
    e = labelled.agg(F.avg(error).alias("e"), F.coalesce(F.var_pop(error), F.lit(0.0)).alias("v"), F.count("*").cast("double").alias("k"))
    both = m.crossJoin(e)
    rate = F.col("p") + F.col("e")
    half = z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + F.col("v") / F.col("k"))
    return both.select(rate.alias("rate"), (rate - half).alias("low"), (rate + half).alias("high"))
