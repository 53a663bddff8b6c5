"""What questions are made from: entities that join documents, pairs, rounds over documents, distractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T


def entities(chunks: DataFrame) -> DataFrame:
    """chunk_id, doc_id, ord, display, entity: the offline default takes the first five distinct capitalised words of four letters or more in the first 2000 characters."""
    head = F.substring("text", 1, 2000)
    found = F.slice(F.array_distinct(F.filter(F.split(head, r"[^\p{L}]+"), lambda w: F.regexp_like(w, F.lit("^[A-Z][a-z]{3,}$")))), 1, 5)
    return chunks.select("chunk_id", "doc_id", "ord", F.posexplode(found).alias("pos", "display")).withColumn("entity", T.normal("display"))


def bridges(found: DataFrame, least_docs: int = 2) -> DataFrame:
    """entity, display (first spelling), chunk_id, doc_id, n_docs: a row for each chunk of an entity that several documents have.

    A common word is in most chunks, so members are rows and never one array.
    """
    pairs = found.groupBy("entity", "doc_id").agg(F.min(F.struct("ord", "pos", "display")).alias("first"))
    counted = pairs.groupBy("entity").agg(F.count("*").alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") >= least_docs)
    members = found.select("entity", "chunk_id", "doc_id").distinct()
    return members.join(counted.select("entity", F.col("first.display").alias("display"), "n_docs"), "entity").select("entity", "display", "chunk_id", "doc_id", "n_docs")


def cross_doc_pairs(found: DataFrame) -> DataFrame:
    """entity, chunk_a, chunk_b: the first chunk of the first document and of the second, in the order of chunks."""
    first = found.groupBy("entity", "doc_id").agg(F.min(F.struct("ord", "chunk_id")).alias("c"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy("c.ord", "doc_id"))
    two = first.withColumn("k", rank).where("k <= 2")
    paired = two.groupBy("entity").agg(F.max(F.when(F.col("k") == 1, F.col("c.chunk_id"))).alias("chunk_a"), F.max(F.when(F.col("k") == 2, F.col("c.chunk_id"))).alias("chunk_b"))
    return paired.where("chunk_b is not null")


def round_robin(chunks: DataFrame, limit: int) -> DataFrame:
    """The first chunk of every document, then the second of every document and so on, up to the limit asked for."""
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("index"))
    return chunks.withColumn("turn", turn).orderBy("turn", "doc_id").limit(limit)


def distractors(targets: DataFrame, chunks: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """chunk_id, distractor, k (its rank): k chunks of other documents for each target, drawn for each by hashes of its own.

    Chunks lie in slots of about ``16 k`` by a hash, and a target looks into a slot of its own, so that no target meets all
    chunks and each has others. Where a slot has too few of other documents, the chunks of smallest hash of k + 1 documents
    make up for it, of which at least k are of others (if there are so many documents).
    """
    n = max(1, chunks.count() // (16 * k))
    h = lambda *parts: F.sha2(F.concat_ws("|", F.lit(seed), *parts), 256)
    slot = lambda *parts: F.conv(F.substring(h(*parts), 1, 8), 16, 10).cast("long") % n
    asked = targets.select("chunk_id", "doc_id", slot(F.lit("t"), "chunk_id").alias("slot"))
    held = chunks.select(F.col("chunk_id").alias("distractor"), F.col("doc_id").alias("other"), slot(F.lit("c"), "chunk_id").alias("slot"))
    drawn = asked.join(held, "slot").where("doc_id <> other").select("chunk_id", "distractor", F.lit(0).alias("turn"), h("chunk_id", "distractor").alias("h"))
    hashed = chunks.select("chunk_id", "doc_id", h("chunk_id").alias("h"))
    kept = hashed.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))).where(F.col("r") <= k)
    docs = kept.groupBy("doc_id").agg(F.min("h").alias("m")).orderBy("m").limit(k + 1)
    few = kept.join(F.broadcast(docs), "doc_id").select(F.col("chunk_id").alias("distractor"), F.col("doc_id").alias("other"), "h")  # k (k + 1) rows at most
    spare = targets.select("chunk_id", "doc_id").crossJoin(F.broadcast(few)).where("doc_id <> other").select("chunk_id", "distractor", F.lit(1).alias("turn"), "h")
    both = drawn.unionByName(spare).groupBy("chunk_id", "distractor").agg(F.min(F.struct("turn", "h")).alias("by"))
    return both.withColumn("k", F.row_number().over(Window.partitionBy("chunk_id").orderBy("by", "distractor"))).where(F.col("k") <= k).select("chunk_id", "distractor", "k")


def compound_pairs(records: DataFrame) -> DataFrame:
    """pair, a, b: neighbours (0, 1), (2, 3)... by ord, a last odd one left out; records: ord (dense from 0), record_id."""
    paired = records.groupBy(F.floor(F.col("ord") / 2).alias("pair")).agg(F.min_by("record_id", "ord").alias("a"), F.max_by("record_id", "ord").alias("b"), F.count("*").alias("n"))
    return paired.where("n = 2").select("pair", "a", "b")


def cyclic(items: DataFrame, count: int) -> DataFrame:
    """i, item: item i mod n for i below count; items: ord (dense from 0), item."""
    n = items.count()
    if not n:
        return items.select(F.lit(0).cast("long").alias("i"), "item").where("false")
    wanted = items.sparkSession.range(count).select(F.col("id").alias("i"), F.pmod("id", F.lit(n)).alias("ord"))
    return wanted.join(items, "ord").select("i", "item")


def shuffled_cycle(items: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """i, item: passes over all items, each in the order of another hash; items: item."""
    n = items.count()
    if not n:
        return items.select(F.lit(0).cast("long").alias("i"), "item").where("false")
    passes = items.sparkSession.range(-(-count // n)).withColumnRenamed("id", "turn")
    h = F.sha2(F.concat_ws("|", F.lit(seed), "turn", F.col("item").cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("turn").orderBy(h, "item")) - 1
    return items.crossJoin(F.broadcast(passes)).withColumn("i", F.col("turn") * n + place.cast("long")).where(F.col("i") < count).select("i", "item")
