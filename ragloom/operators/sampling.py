"""Samples whose randomness is a hash, so that any engine and any partitioning draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T


def order_key(seed: int, key: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), T.col(key).cast("string")), 256)


def stratified(rows: DataFrame, key: str, label: str, n: int, rate: float, seed: int = 0) -> DataFrame:
    """round(n * rate) rows with the label true and the rest with it false, smallest hashes first.

    Two bounded sorts; no window gathers a label's rows in one task.
    """
    positives = round(n * rate)
    hashed = rows.withColumn("h", order_key(seed, key))
    draw = lambda cond, k: hashed.where(cond).orderBy("h", key).limit(k)
    return draw(F.col(label), positives).unionByName(draw(~F.col(label), n - positives)).drop("h")


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return rows.withColumn("h", order_key(seed, key)).orderBy("h", key).limit(n).drop("h")


def weighted_choice(rows: DataFrame, key: str, choices: list[tuple[str, float]], seed: int = 0, name: str = "choice") -> DataFrame:
    """A choice for each row with the given weights."""
    u = T.unit(order_key_text(seed, key)) * sum(w for _, w in choices)
    chosen, reach = F.lit(choices[-1][0]), sum(w for _, w in choices)
    for value, weight in reversed(choices):
        reach -= weight
        chosen = F.when(u < reach + weight, value).otherwise(chosen)
    return rows.withColumn(name, chosen)


def order_key_text(seed: int, key: Column | str) -> Column:
    return F.concat_ws("|", F.lit(seed), T.col(key).cast("string"))


def apportioned(mix: DataFrame, size: int) -> DataFrame:
    """name, n: size times each share, rounded half to even; what is missing or over goes to the first largest share.

    mix: ord, name, share, a handful of rows.
    """
    total = Window.partitionBy()
    base = mix.withColumn("n", F.bround(F.col("share") * size).cast("long"))
    top = F.row_number().over(Window.orderBy(F.desc("n"), "ord")) == 1
    return base.withColumn("sum", F.sum("n").over(total)).withColumn("top", top).select("name", F.when(F.col("top"), F.col("n") + size - F.col("sum")).otherwise(F.col("n")).alias("n"))
