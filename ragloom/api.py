"""What users call: generate, evaluate, load, save, estimate_cost, compare, clear_cache."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom import config
from ragloom.operators import chunking, compare as _compare, costs
from ragloom.plans import evaluate as _evaluate
from ragloom.plans import generate as _generate
from ragloom.plans.generate import EvalSet
from ragloom.plans.providers import OfflineProvider, Provider
from ragloom.sources import readers, writers


def generate(spark: SparkSession, docs_dir: str, work: str, provider: Provider | None = None, **options: Any) -> EvalSet:
    return _generate.generate(spark, docs_dir, provider or OfflineProvider(), work, **options)


def evaluate(eval_set: EvalSet, rag: Callable[[str], Any], work: str, provider: Provider | None = None, **options: Any) -> tuple[DataFrame, DataFrame]:
    return _evaluate.evaluate(eval_set, rag, provider or OfflineProvider(), work, **options)


def save(eval_set: EvalSet, path: str) -> None:
    """The set as JSON, and beside it the table of its documents' hashes."""
    spark, beside = eval_set.records.sparkSession, _hashes_of(path)
    writers.write_eval_set(eval_set.records, eval_set.chunks, eval_set.changelog, eval_set.head(), path)
    if not eval_set.hashes:
        _delete(spark, beside)
    elif os.path.abspath(eval_set.hashes) != os.path.abspath(beside):
        spark.read.parquet(eval_set.hashes).write.mode("overwrite").parquet(beside)


def load(spark: SparkSession, path: str) -> EvalSet:
    records, chunks, changelog, head = readers.read_eval_set(spark, path)
    beside = _hashes_of(path)
    files, at = _files(spark, beside)
    return EvalSet(records, chunks, changelog, head["tier"], head["version"], head["metadata"] or {}, beside if files.exists(at) else "")


def hashes(spark: SparkSession, eval_set: EvalSet) -> DataFrame:
    """doc_id, hash of the documents that a set was made from; sets of other makers have them in their metadata."""
    if eval_set.hashes:
        return spark.read.parquet(eval_set.hashes)
    held = json.loads(eval_set.metadata.get("doc_hashes") or "{}")
    if not held:
        raise ValueError("the set comes without hashes of its documents, so what changed can't be told")
    return spark.createDataFrame(list(held.items()), "doc_id string, hash string")


def _hashes_of(path: str) -> str:
    return f"{path}.hashes"


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path as it wants it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def compare(new: DataFrame, old: DataFrame) -> DataFrame:
    return _compare.deltas(new, old)


def estimate_cost(spark: SparkSession, docs_dir: str, tier: str = config.TIERS[1], size: str | int = "auto", model: str = "default") -> DataFrame:
    config.tier_config(tier)
    docs = readers.load_directory(spark, docs_dir)
    rows = chunking.chunks(docs)
    one = rows.agg(F.count("*").alias("n_chunks"), F.avg("token_count").alias("chunk_tokens")).withColumn("corpus", F.lit(docs_dir))
    counted = one.crossJoin(docs.agg(F.count("*").alias("n_docs")))
    if size == "auto":
        sized = counted.join(costs.sizes(counted.select("corpus", "n_docs", "n_chunks")).where(F.col("tier") == tier).select("corpus", F.col("size").alias("questions")), "corpus")
    else:
        sized = counted.withColumn("questions", F.lit(int(size)).cast("long"))
    return costs.estimate(sized.select("corpus", "questions", "chunk_tokens"), tier, model)


def clear_cache(spark: SparkSession, work: str) -> None:
    """Delete the replies kept below a work folder."""
    _delete(spark, f"{work}/replies")
