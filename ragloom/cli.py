"""Command line: estimate, generate, validate, staleness, evaluate, compare, report, review-export, review-import."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ragloom import api
from ragloom.operators import analytics, quality, versioning
from ragloom.plans import evaluate as _evaluate
from ragloom.plans.providers import OfflineProvider
from ragloom.sources import readers, writers


def loaded(spec: str) -> Callable:
    """The function that "module:name" names."""
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError("a system is named as module:function")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ragloom")
    sub = p.add_subparsers(dest="command", required=True)
    command = lambda name, *args: [sub.add_parser(name)] and [sub.choices[name].add_argument(a, **k) for a, k in args]
    tier, size = ("--tier", {"default": "medium"}), ("--size", {"default": "auto"})
    command("estimate", ("docs", {}), tier, size)
    command("generate", ("docs", {}), ("out", {}), ("--work", {"required": True}), tier, size, ("--seed", {"type": int, "default": 0}))
    command("validate", ("set", {}), ("--work", {"required": True}))
    command("staleness", ("set", {}), ("docs", {}))
    command("evaluate", ("set", {}), ("system", {}), ("--work", {"required": True}), ("--scoring", {"default": None}))
    command("compare", ("old", {}), ("new", {}))
    command("report", ("results", {}), ("--html", {}), ("--csv", {}))
    command("review-export", ("set", {}), ("--csv", {"required": True}))
    command("review-import", ("set", {}), ("--csv", {"required": True}), ("--out", {}))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("ragloom").getOrCreate()
    sized = lambda: a.size if a.size == "auto" else int(a.size)
    if a.command == "estimate":
        print(writers.cost_text(api.estimate_cost(spark, a.docs, a.tier, sized())))
    elif a.command == "generate":
        made = api.generate(spark, a.docs, a.work, tier=a.tier, size=sized(), seed=a.seed)
        api.save(made, a.out)
        print(writers.set_summary(made.records))
    elif a.command == "validate":
        checks = _evaluate.validate(api.load(spark, a.set), OfflineProvider(), a.work)
        quality.pass_rates(checks).orderBy("grp").show()
        quality.flagged(checks).show(truncate=False)
    elif a.command == "staleness":
        held = api.load(spark, a.set)
        records = held.records.select(F.col("id").alias("record_id"), "source_doc_ids")
        versioning.stale(records, api.hashes(spark, held), readers.doc_hashes(spark, a.docs)).show(truncate=False)
    elif a.command == "evaluate":
        results, verdicts = api.evaluate(api.load(spark, a.set), loaded(a.system), a.work, scoring_set=a.scoring)
        print(writers.results_summary(results))
        analytics.health(verdicts).show(truncate=False)
    elif a.command == "compare":
        print(writers.comparison_text(spark.read.parquet(a.new), spark.read.parquet(a.old)))
    elif a.command == "report":
        results = spark.read.parquet(a.results)
        if a.html:
            with open(a.html, "w", encoding="utf-8") as file:
                file.write(writers.html_report(results))
        if a.csv:
            writers.write_csv(writers.flat(results.withColumn("overall_score", F.col("overall"))), a.csv)
        print(writers.results_summary(results))
    elif a.command == "review-export":
        writers.write_csv(writers.review_rows(api.load(spark, a.set).records).coalesce(1), a.csv)
    else:
        held = api.load(spark, a.set)
        review = readers.read_review(spark, a.csv)
        named = held.records.withColumnRenamed("id", "record_id")
        log = versioning.review_log(named, review, held.version).collect()
        changes = spark.createDataFrame([(r["version"], r["action"], f"{r['n']} records", []) for r in log], readers.CHANGE)
        held.records = versioning.reviewed(named, review).withColumnRenamed("record_id", "id")
        held.changelog, held.version = held.changelog.unionByName(changes), log[-1]["version"] if log else held.version
        api.save(held, a.out or a.set)


if __name__ == "__main__":
    main()
