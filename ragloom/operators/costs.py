"""What building and judging a set will cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom import config
from ragloom.functions import scalars as S


def brackets(spark) -> DataFrame:
    """bound, tier, least, most."""
    return spark.createDataFrame(config.SIZING, "bound long, tier string, least long, most long")


def sizes(corpora: DataFrame) -> DataFrame:
    """corpus, tier, size: a range join with the first bracket whose bound isn't below; corpora: corpus, n_docs, n_chunks."""
    dims = brackets(corpora.sparkSession)
    met = corpora.join(F.broadcast(dims), (F.col("n_docs") <= F.col("bound")) & (F.col("n_docs") > 0))
    first = met.groupBy("corpus", "n_docs", "n_chunks", "tier").agg(F.min_by(F.struct("least", "most"), "bound").alias("b"))
    return first.select("corpus", "tier", S.set_size("n_docs", "n_chunks", "b.least", "b.most").alias("size"))


def calls(tier: str) -> float:
    """Calls for one question: the question, its noise (all layers' steps over the tier's layers) and the leakage check."""
    steps = sum(len(v) for v in config.NOISE_STEPS.values())
    return 1 + steps / len(config.NOISE_MIX[tier]) + (1 if "leakage" in config.QUALITY_CHECKS[tier] else 0)


def estimate(corpora: DataFrame, tier: str, model: str = "default") -> DataFrame:
    """Tokens, dollars and minutes; corpora: corpus, questions, chunk_tokens (mean, 500 where null)."""
    price_in, price_out = config.PRICES.get(model, config.PRICES.get(model.split("/")[-1], config.PRICES["default"]))
    tokens = F.coalesce("chunk_tokens", F.lit(500.0))
    n, c = F.col("questions"), calls(tier)
    whole = lambda x: F.floor(x).cast("long")
    sized = corpora.select(
        "corpus", "questions", whole(n * c * tokens).alias("generation_in"), whole(n * c * 150).alias("generation_out"), whole(n * (tokens * 2 + 300)).alias("evaluation_in"), whole(n * (config.JUDGE_QUESTIONS[tier] * 20)).alias("evaluation_out"), (n * 0.15).alias("minutes")
    )
    cost = lambda a, b: S.cost(a, b, F.lit(price_in), F.lit(price_out))
    priced = sized.withColumn("generation_usd", cost("generation_in", "generation_out")).withColumn("evaluation_usd", cost("evaluation_in", "evaluation_out"))
    return priced.withColumn("total_usd", F.col("generation_usd") + F.col("evaluation_usd"))
