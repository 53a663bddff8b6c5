"""Two runs against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom import config
from ragloom.functions import text as T


def deltas(new: DataFrame, old: DataFrame) -> DataFrame:
    """One row: differences of means over all records of each run; a dimension that is 0 or absent in both is null."""
    dims = [d for d in config.DIMENSIONS if d in new.columns and d in old.columns]
    has_recall = "set_recall" in new.columns and "set_recall" in old.columns
    columns = ["overall", *dims]
    means = lambda df, p: df.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(p + c) for c in columns), *([F.coalesce(F.avg(F.col("set_recall").cast("double")), F.lit(0.0)).alias(p + "set_recall")] if has_recall else []))
    both = means(new, "n_").crossJoin(means(old, "o_"))
    out = [(F.col("n_overall") - F.col("o_overall")).alias("overall")]
    out += [F.when((F.col("n_" + d) != 0) | (F.col("o_" + d) != 0), F.col("n_" + d) - F.col("o_" + d)).alias(d) for d in dims]
    return both.select(*out, *([(F.col("n_set_recall") - F.col("o_set_recall")).alias("set_recall")] if has_recall else []))


def group_deltas(new: DataFrame, old: DataFrame) -> DataFrame:
    """facet, value, delta of mean overall for question types and noise profiles that both runs have."""
    out = None
    for facet, key in (("question_type", F.col("question_type")), ("noise", T.noise_key("noise_profile"))):
        a, b = (df.groupBy(key.alias("value")).agg(F.avg("overall").alias(m)) for df, m in ((new, "n"), (old, "o")))
        rows = a.join(b, "value").select(F.lit(facet).alias("facet"), "value", (F.col("n") - F.col("o")).alias("delta"))
        out = rows if out is None else out.unionByName(rows)
    return out


def flips(new: DataFrame, old: DataFrame, least: float = config.PASS_SCORE) -> DataFrame:
    """record_id, flip of records on different sides of the pass mark."""
    both = new.select("record_id", (F.col("overall") >= least).alias("n")).join(old.select("record_id", (F.col("overall") >= least).alias("o")), "record_id")
    return both.where("n <> o").select("record_id", F.when(F.col("n"), "fail_to_pass").otherwise("pass_to_fail").alias("flip"))


def movers(changes: DataFrame, n: int = 3) -> DataFrame:
    """The n largest gains and the n largest losses: the feature is the bound."""
    up = changes.where("delta > 0").orderBy(F.desc("delta"), "value").limit(n).withColumn("kind", F.lit("improvement"))
    down = changes.where("delta < 0").orderBy("delta", "value").limit(n).withColumn("kind", F.lit("regression"))
    return up.unionByName(down)
