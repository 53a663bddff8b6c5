"""A plain retriever and reader: chunks are embedded once, a question takes its nearest ones, a model answers from them.

An embedder is a function from a table (chunk_id string, text) to (chunk_id, embedding of unit length).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators import similarity
from ragloom.plans import providers as P
from ragloom.plans.providers import Provider, prompt

Embedder = Callable[[DataFrame], DataFrame]

TOP = 5


def index(chunks: DataFrame, embed: Embedder = similarity.hashed_embeddings) -> DataFrame:
    """chunk_id, text, vec_id, embedding of chunks (chunk_id, text); write it once to search it often."""
    vectors = embed(chunks.select("chunk_id", "text"))
    return chunks.select("chunk_id", "text").join(vectors, "chunk_id").withColumn("vec_id", F.xxhash64("chunk_id"))


def search(questions: DataFrame, vectors: DataFrame, k: int = TOP, embed: Embedder = similarity.hashed_embeddings, held: int | None = None) -> DataFrame:
    """question_id, rank, vec_id, similarity: the k nearest vectors (vec_id, embedding) of each question (question_id, question). held: about how many vectors there are, where they are computed on the way."""
    asked = embed(questions.select(F.col("question_id").cast("string").alias("chunk_id"), F.col("question").alias("text")).where("text is not null"))
    queries = asked.select(F.xxhash64("chunk_id").alias("query_id"), "embedding")
    found = similarity.nearest(queries, vectors.select("vec_id", "embedding"), k, held and (questions.count(), held))
    named = questions.select("question_id", F.xxhash64(F.col("question_id").cast("string")).alias("query_id"))
    return found.join(named, "query_id").select("question_id", "rank", "vec_id", "similarity")


def retrieved(questions: DataFrame, indexed: DataFrame, k: int = TOP, embed: Embedder = similarity.hashed_embeddings) -> DataFrame:
    """question_id, rank, chunk_id, text, similarity: the k nearest chunks of each question (question_id, question)."""
    return search(questions, indexed, k, embed).join(indexed.select("vec_id", "chunk_id", "text"), "vec_id").select("question_id", "rank", "chunk_id", "text", "similarity")


def answered(questions: DataFrame, indexed: DataFrame, provider: Provider, cache: str, k: int = TOP, embed: Embedder = similarity.hashed_embeddings, pause: float = 1.0) -> DataFrame:
    """The rows with answer ("" where the model failed) and contexts, nearest first (none if nothing is indexed)."""
    found = retrieved(questions, indexed, k, embed).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    rows = questions.join(found, "question_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    asked = rows.withColumn("prompt", prompt("answer", ("context", F.array_join("contexts", "\n\n---\n\n")), ("question", F.col("question"))))
    return P.ask(asked, provider, cache, 0.0, pause).withColumn("answer", F.coalesce("reply", F.lit(""))).drop("prompt", "reply")


def run_set(records: DataFrame, indexed: DataFrame, provider: Provider, cache: str, **options) -> DataFrame:
    """record_id, question, answer, contexts of a set's records (id, question)."""
    rows = records.select(F.col("id").alias("question_id"), "question")
    return answered(rows, indexed, provider, cache, **options).select(F.col("question_id").alias("record_id"), "question", "answer", "contexts")


def run_rows(rows: DataFrame, indexed: DataFrame, provider: Provider, cache: str, **options) -> DataFrame:
    """question, ground_truth, answer, contexts of another generator's rows (question, ground_truth)."""
    keyed = rows.withColumn("question_id", F.sha2(F.concat_ws("|", "question", "ground_truth"), 256))
    return answered(keyed, indexed, provider, cache, **options).select("question", "ground_truth", "answer", "contexts")
