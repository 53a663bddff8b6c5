"""From a corpus to an evaluation set."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom import config
from ragloom.functions import scalars as S
from ragloom.operators import candidates, chunking, noise, sampling, similarity, versioning
from ragloom.plans import providers as P
from ragloom.plans.providers import Provider, prompt
from ragloom.plans.rag import Embedder
from ragloom.sources import readers

_WANTED = {
    "single_chunk": "Ask for one fact of the passage.", "procedural": "Ask how something is done.", "wrong_assumption": "Ask with an assumption that the passage refutes.", "adversarial": "Ask so that the distractors mislead.",
    "unanswerable": "Ask what the passages don't answer.", "ambiguous": "Ask so that more than one passage could be meant.", "cross_doc": "Ask what needs both passages.", "contradiction": "Ask where the passages disagree.",
    "comparative": "Ask to compare the passages.", "compound": "Join the questions into one.",
}


@dataclass
class EvalSet:
    """Records, chunks and changes of a set with its version, tier and metadata, and where the table of its documents' hashes is."""

    records: DataFrame
    chunks: DataFrame
    changelog: DataFrame
    tier: str = "medium"
    version: str = "1.0.0"
    metadata: dict = field(default_factory=dict)
    hashes: str = ""

    def with_added(self, more: DataFrame) -> EvalSet:
        """The set with more records, a minor version on, and an entry in its changes."""
        return self._changed(versioning.added(self.records, more), "add_records", "Added", [r["id"] for r in more.select("id").collect()])

    def without(self, ids: list[str]) -> EvalSet:
        """The set without the records of these ids, a minor version on, and an entry in its changes."""
        gone = self.records.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        return self._changed(self.records.join(gone, "id", "left_anti"), "remove_records", "Removed", list(ids))

    def _changed(self, records: DataFrame, action: str, word: str, ids: list[str]) -> EvalSet:
        version = records.sparkSession.range(1).select(S.bumped(F.lit(self.version), "minor").alias("v")).first()["v"]
        entry = records.sparkSession.createDataFrame([(version, action, f"{word} {len(ids)} records", ids)], readers.CHANGE)
        return replace(self, records=records, changelog=self.changelog.unionByName(entry), version=version)

    def head(self) -> dict:
        return {name: getattr(self, name) for name in ("tier", "metadata", "version")}


def budget(spark: SparkSession, tier: str, size: int) -> dict[str, int]:
    mix = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(config.TYPE_MIX[tier].items())], "ord int, name string, share double")
    return {r["name"]: r["n"] for r in sampling.apportioned(mix, size).collect()}


def _texts(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (ord, group: array of chunk ids) with the passages in order and their documents; ids that no chunk has are dropped."""
    each = ids.select("ord", F.posexplode("group").alias("pos", "chunk_id")).join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    one = F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "doc_id", "text")))
    got = each.groupBy("ord").agg(one.alias("x"))
    pick = lambda f: F.transform("x", lambda e: e[f])
    return got.select("ord", pick("chunk_id").alias("group"), F.array_distinct(pick("doc_id")).alias("docs"), pick("text").alias("texts"))


def _plan(kind: str, n: int, chunks: DataFrame, vectors: DataFrame, seed: int) -> DataFrame:
    """ord, group (gold chunk ids), extra (texts that are shown but aren't gold)."""
    spark = chunks.sparkSession
    none = F.array().cast("array<string>")
    if kind in ("single_chunk", "procedural", "wrong_assumption", "adversarial"):
        picked = candidates.shuffled_cycle(chunks.select(F.col("chunk_id").alias("item")), n, seed).select(F.col("i").alias("ord"), F.array("item").alias("group"))
        if kind != "adversarial":
            return picked.withColumn("extra", none)
        targets = picked.select("ord", F.col("group")[0].alias("chunk_id")).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
        away = candidates.distractors(targets.select("chunk_id", "doc_id").distinct(), chunks, 2, seed)
        shown = away.join(chunks.select(F.col("chunk_id").alias("distractor"), "text"), "distractor").groupBy("chunk_id").agg(F.collect_list("text").alias("extra"))
        return targets.join(shown, "chunk_id").select("ord", F.array("chunk_id").alias("group"), "extra")
    if kind in ("unanswerable", "ambiguous"):
        k = 8 if kind == "unanswerable" else 2
        turns = spark.range(n).withColumnRenamed("id", "ord")
        h = F.sha2(F.concat_ws("|", F.lit(seed), "ord", "chunk_id"), 256)
        # A question takes k chunks of a hash slot of its own, so that no question meets all chunks.
        slots = max(1, chunks.count() // (4 * k))
        slotted = chunks.select("chunk_id", "text", F.pmod(F.xxhash64("chunk_id"), F.lit(slots)).alias("slot"))
        met = turns.withColumn("slot", F.pmod(F.xxhash64("ord", F.lit(seed)), F.lit(slots))).join(slotted, "slot").withColumn("k", F.row_number().over(Window.partitionBy("ord").orderBy(h, "chunk_id"))).where(F.col("k") <= k)
        if kind == "unanswerable":
            return met.groupBy("ord").agg(F.collect_list(F.substring("text", 1, 150)).alias("extra")).withColumn("group", none).select("ord", "group", "extra")
        return met.groupBy("ord").agg(F.array_sort(F.collect_list("chunk_id")).alias("group")).withColumn("extra", none)
    if kind == "cross_doc":
        found = candidates.entities(chunks)
        rank = F.row_number().over(Window.orderBy(F.desc("n"), "entity")) - 1
        many = found.groupBy("entity").agg(F.count_distinct("doc_id").alias("n")).where("n >= 2").orderBy(F.desc("n"), "entity").limit(n)
        pairs = candidates.cross_doc_pairs(found.join(F.broadcast(many.select("entity")), "entity")).join(many, "entity").select(rank.cast("long").alias("ord"), F.array("chunk_a", "chunk_b").alias("item"))
        return candidates.cyclic(pairs, n).select(F.col("i").alias("ord"), F.col("item").alias("group")).withColumn("extra", none)
    least, most = (config.CONTRADICTION_COSINE, 50) if kind == "contradiction" else (0.3, 20)
    top = similarity.top_pairs(vectors, least, most)
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_a", "vec_b")) - 1
    named = lambda c: chunks.select(F.col("ord").alias(c), F.col("chunk_id").alias(c.replace("vec", "chunk")))
    pairs = top.withColumn("rank", rank.cast("long")).join(named("vec_a"), "vec_a").join(named("vec_b"), "vec_b")
    return candidates.cyclic(pairs.select(F.col("rank").alias("ord"), F.array("chunk_a", "chunk_b").alias("item")), n).select(F.col("i").alias("ord"), F.col("item").alias("group")).withColumn("extra", none)


def _parsed(replies: DataFrame) -> DataFrame:
    """Replies as question, gold_answer, intents, notes; rows without a question go."""

    @F.pandas_udf("question string, gold_answer string, intents array<struct<text:string,required:boolean>>, notes string")
    def parse(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                found = P.extract_json(t)
                points = [{"text": str(p.get("text", "")), "required": P.truth(p.get("required", True), True)} for p in found.get("intents") or [] if isinstance(p, dict)]
                out.append((str(found["question"]), str(found.get("gold_answer", "")), points, str(found.get("notes", ""))))
            except (ValueError, KeyError, AttributeError, TypeError):
                out.append((None, None, None, None))
        return pd.DataFrame(out, columns=["question", "gold_answer", "intents", "notes"])

    return replies.withColumn("q", parse("reply")).where("q.question is not null")


def questions(kind: str, plan: DataFrame, chunks: DataFrame, provider: Provider, cache: str, pause: float = 1.0) -> DataFrame:
    """kind, ord, groups, docs, question, gold_answer, intents, notes."""
    texts = plan.select("ord", "extra").join(_texts(chunks, plan), "ord", "left")
    empty = F.array().cast("array<string>")
    shown = texts.select("ord", *(F.coalesce(c, empty).alias(c) for c in ("group", "docs", "texts", "extra")))
    shown = shown.where((F.size("texts") > 0) | F.lit(kind == "unanswerable"))
    lines = lambda label, c: F.concat_ws("\n", F.transform(c, lambda t: F.concat(F.lit(f"[{label}] "), t)))
    asked = shown.withColumn("prompt", F.concat_ws("\n", prompt("question", ("kind", kind), ("wanted", _WANTED[kind])), lines("passage", "texts"), lines("distractor", "extra")))
    got = _parsed(P.ask(asked, provider, cache, 0.7, pause))
    groups = F.when(F.size("group") > 0, F.array("group")).otherwise(F.array().cast("array<array<string>>"))
    texts_ = F.when(F.size("group") > 0, F.array("texts")).otherwise(F.array().cast("array<array<string>>"))
    return got.select(F.lit(kind).alias("kind"), "ord", groups.alias("groups"), texts_.alias("group_texts"), "docs", "q.*")


def _compound(n: int, chunks: DataFrame, vectors: DataFrame, provider: Provider, cache: str, seed: int, pause: float) -> DataFrame:
    """Two questions on single chunks in one; their groups become alternatives."""
    base = questions("single_chunk", _plan("single_chunk", 2 * n, chunks, vectors, seed + 1), chunks, provider, cache, pause)
    dense = base.withColumn("ord", F.row_number().over(Window.orderBy("ord")) - 1)
    row = F.struct("ord", "groups", "group_texts", "docs", "question", "gold_answer", "intents")
    paired = dense.groupBy(F.floor(F.col("ord") / 2).alias("pair")).agg(F.array_sort(F.collect_list(row)).alias("x")).where((F.size("x") == 2) & (F.col("pair") < n))
    asked = paired.withColumn("prompt", prompt("question", ("kind", "compound"), ("wanted", _WANTED["compound"]), ("passage", F.col("x")[0]["question"]), ("passage", F.col("x")[1]["question"])))
    got = _parsed(P.ask(asked, provider, cache, 0.7, pause))
    both = lambda f: F.concat(F.col("x")[0][f], F.col("x")[1][f])
    return got.select(F.lit("compound").alias("kind"), F.col("pair").alias("ord"), both("groups").alias("groups"), both("group_texts").alias("group_texts"), F.array_distinct(both("docs")).alias("docs"), F.col("q.question").alias("question"), F.col("q.gold_answer").alias("gold_answer"), both("intents").alias("intents"), F.col("q.notes").alias("notes"))


def generate(spark: SparkSession, docs_dir: str, provider: Provider, work: str, tier: str = config.TIERS[1], size: str | int = "auto", seed: int = 0, chunk_size: int = 512, chunk_overlap: int = 64, strategy: str = "auto", pause: float = 1.0, embed: Embedder = similarity.hashed_embeddings) -> EvalSet:
    """Chunks, candidates, questions, noise, leakage check and records; ``work`` is a folder that all executors share."""
    settings = config.tier_config(tier)
    docs = readers.load_directory(spark, docs_dir)
    rows = chunking.chunks(docs, strategy, chunk_size, chunk_overlap)
    rows.withColumn("ord", F.xxhash64("chunk_id")).write.mode("overwrite").parquet(f"{work}/chunks")
    chunks = spark.read.parquet(f"{work}/chunks")
    n_docs, n_chunks = docs.select("doc_id").distinct().count(), chunks.count()
    wanted = size if isinstance(size, int) else _auto_size(n_docs, n_chunks, tier)
    counts = {k: n for k, n in budget(spark, tier, wanted).items() if n > 0}
    vectors = None
    if {"contradiction", "comparative"} & set(counts):
        embed(chunks).write.mode("overwrite").parquet(f"{work}/vectors")
        vectors = spark.read.parquet(f"{work}/vectors").join(chunks.select("chunk_id", "doc_id", F.col("ord").alias("vec_id")), "chunk_id")
    cache = f"{work}/replies"
    parts = []
    for kind, n in counts.items():
        if kind == "compound":
            parts.append(_compound(n, chunks, vectors, provider, cache, seed, pause))
        else:
            plan = _plan(kind, n, chunks, vectors, seed)
            if kind == "contradiction":
                plan = confirmed(plan, chunks, provider, cache, pause)
            parts.append(questions(kind, plan, chunks, provider, cache, pause))
    asked = reduce(DataFrame.unionByName, parts).withColumn("id", F.concat_ws("-", "kind", "ord"))
    # Noise: a layer for each question by weight, then its steps in order.
    chosen = sampling.weighted_choice(asked, "id", list(settings["noise_layers"].items()), seed, "layer")
    steps = F.create_map(*[x for k, v in config.NOISE_STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    layered = chosen.withColumn("layers", steps[F.col("layer")])
    sourced = layered.withColumn("source", F.concat_ws("\n", F.flatten("group_texts")))
    noisy = noise.with_layers(sourced, seed, lambda rows, heat: P.ask(rows, provider, cache, heat, pause)).drop("source")
    noisy = noisy.withColumn("unanswerable", F.col("kind") == "unanswerable")
    # Leakage: what a model answers without passages isn't worth asking.
    checked = P.ask(noisy.withColumn("prompt", prompt("leak", ("question", F.col("question")), ("expected", F.col("gold_answer")))), provider, cache, 0.0, pause)
    flag = F.pandas_udf(lambda s: s.map(_answered), "boolean")
    kept = checked.where(F.col("unanswerable") | (F.trim("gold_answer") == "") | ~flag(F.coalesce("reply", F.lit("")))).drop("reply", "prompt")
    number = F.row_number().over(Window.orderBy("kind", "ord")) - 1  # a set has hundreds of records, whatever the corpus
    points = F.transform("intents", lambda p, i: F.struct(F.concat(F.lit("P"), i + 1).alias("id"), p["text"].alias("text"), p["required"].alias("required"), F.lit(None).cast("string").alias("source_chunk_id")))
    records = kept.select(
        F.format_string("eval-%04d", number).alias("id"), F.col("noisy").alias("question"), F.col("question").alias("question_clean"), F.col("kind").alias("question_type"), "noise_profile", S.difficulty("kind", "noise_profile").alias("difficulty"), "gold_answer",
        F.col("groups").alias("gold_chunk_ids"), F.col("group_texts").alias("gold_chunks_text"), points.alias("intent_points"), "unanswerable", (F.size(F.flatten("groups")) > 1).alias("requires_synthesis"), F.col("docs").alias("domain_tags"), F.col("docs").alias("source_doc_ids"), F.col("notes").alias("scoring_notes"),
    )
    records.write.mode("overwrite").parquet(f"{work}/records")
    log = spark.createDataFrame([], readers.CHANGE)
    readers.doc_hashes(spark, docs_dir).write.mode("overwrite").parquet(f"{work}/doc_hashes")
    meta = {"docs_dir": docs_dir, "llm": provider.name, "num_source_docs": str(n_docs), "num_chunks": str(n_chunks), "chunking": strategy, "chunk_size": str(chunk_size), "chunk_overlap": str(chunk_overlap), "seed": str(seed)}
    shape = chunks.select(F.col("chunk_id").alias("id"), "doc_id", "text", "index", F.col("token_count").cast("int").alias("token_count"), F.create_map().cast("map<string,string>").alias("metadata"))
    return EvalSet(spark.read.parquet(f"{work}/records"), shape, log, tier, "1.0.0", meta, f"{work}/doc_hashes")


def _answered(reply: str) -> bool:
    try:
        found = P.extract_json(reply)
    except ValueError:
        return False
    return P.truth(found.get("answered"), False) if isinstance(found, dict) else False


def confirmed(plan: DataFrame, chunks: DataFrame, provider: Provider, cache: str, pause: float = 1.0) -> DataFrame:
    """Of the pairs those that the model finds contradictory."""
    texts = _texts(chunks, plan).where(F.size("texts") == 2)
    asked = P.ask(texts.withColumn("prompt", prompt("contradict", ("passage", F.col("texts")[0]), ("passage", F.col("texts")[1]))), provider, cache, 0.0, pause)
    flag = F.pandas_udf(lambda s: s.map(_contradicts), "boolean")
    return plan.join(asked.where(flag(F.coalesce("reply", F.lit("")))).select("ord"), "ord", "left_semi")


def _contradicts(reply: str) -> bool:
    try:
        found = P.extract_json(reply)
    except ValueError:
        return False
    return P.truth(found.get("contradicts"), False) if isinstance(found, dict) else False


def _auto_size(n_docs: int, n_chunks: int, tier: str) -> int:
    if n_docs <= 0:
        raise ValueError("a corpus needs documents")
    _, _, least, most = next(row for row in config.SIZING if row[1] == tier and n_docs <= row[0])
    return round(least + min(max(n_chunks / n_docs / 20, 0.0), 1.0) * (most - least))
