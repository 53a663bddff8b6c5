"""The corpus pipeline: documents in, packed training bins out.

Each stage is a function of (spark, docs, sf_dir) that works on all that its predecessor kept; ``run`` writes what
each returns as Parquet into the session's shared folder and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import decontam, linededup, minhash, packing, toxicity
from ragloom.llm.shared import discard, scratch, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", linededup.stage),
    ("minhash_near_dedup", minhash.stage),
    ("benchmark_decontamination", decontam.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL can express neither the signatures nor the packing; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark) as cut:
            done = cut(stage(spark, docs, sf_dir), name)
        if k:
            discard(docs)
        docs = done
    return docs
