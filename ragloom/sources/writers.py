"""Sets, runs and reports out of DataFrames."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom import config
from ragloom.functions import text as T
from ragloom.operators import analytics, compare


def write_eval_set(records: DataFrame, chunks: DataFrame, changelog: DataFrame, head: dict, path: str) -> None:
    """One indented JSON document. It is one file on the driver's side; keep sets as Parquet where they are large."""
    rows = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    body = {**head, "records": rows(records), "chunks": {c["id"]: c for c in rows(chunks)}, "changelog": rows(changelog)}
    with open(path, "w", encoding="utf-8") as file:
        json.dump(body, file, indent=2)


def write_results(results: DataFrame, tier: str, path: str, metadata: dict | None = None) -> None:
    rows = [json.loads(r[0]) for r in results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    with open(path, "w", encoding="utf-8") as file:
        json.dump({"tier": tier, "metadata": metadata or {}, "records": rows}, file, indent=2)


def flat(results: DataFrame) -> DataFrame:
    """19 plain columns; noise types in their own order joined by "+", tags by ","."""
    score = lambda d: (F.col(f"{d}.score") if results.schema[d].dataType.typeName() == "struct" else F.col(d)).alias(d)
    return results.select(
        *"record_id question question_type".split(), F.array_join("noise_profile", "+").alias("noise_profile"), *"difficulty rag_answer rag_error chunk_recall set_recall mrr precision_at_k".split(),
        *(score(d) for d in config.DIMENSIONS), "overall_score", "intent_coverage", F.array_join("domain_tags", ",").alias("domain_tags"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str, compressed: bool = True) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compressed else "none").json(path)


def review_rows(records: DataFrame) -> DataFrame:
    """What a reviewer sees: previews of 100 characters, " | " within a group and " / " between groups."""
    preview = F.array_join(F.transform("gold_chunks_text", lambda g: F.array_join(F.transform(g, lambda t: F.substring(t, 1, 100)), " | ")), " / ")
    points = F.array_join(F.transform("intent_points", lambda p: F.concat(p["id"], F.when(p["required"], "(req): ").otherwise("(pref): "), p["text"])), "; ")
    plain = "id question question_clean question_type gold_answer".split()
    blank = [F.lit("").alias(c) for c in ("reviewer_verdict", "reviewer_notes")]
    return records.select(*plain, preview.alias("gold_chunks_preview"), points.alias("intent_points_summary"), *blank)


def _rows(head: list[str], body: list[tuple]) -> str:
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else html.escape("" if v is None else str(v))
    return "<table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in body) + "</table>"


def _bar(score: float) -> str:
    kind = "high" if score >= 0.8 else "mid" if score >= 0.6 else "low"
    return f'<div class="bar {kind}" style="width:{max(0, min(100, round(100 * score)))}%">{score:.3f}</div>'


def html_report(results: DataFrame, title: str = "Evaluation", most_failed: int = 50) -> str:
    """A page of aggregates; of failed records the worst are listed, with questions of up to 120 characters. All values are escaped."""
    results = results if "overall" in results.columns else results.withColumnRenamed("overall_score", "overall")
    total = results.agg(*analytics.aggregates(results)).first()
    parts = [f"<h1>{html.escape(title)}</h1><p>{total['n']} records</p>{_bar(total['mean_overall'])}"]
    for name, df, key in (("By question type", analytics.by_question_type(results), "question_type"), ("By noise", analytics.by_noise(results), "noise")):
        parts.append(f"<h2>{name}</h2>" + _rows([key, "records", "mean"], [(r[key], r["n"], r["mean_overall"]) for r in df.orderBy(key).collect()]))
    failed = analytics.failed(results).orderBy("overall", "record_id").limit(most_failed)
    question = F.substring("question", 1, 120) if "question" in results.columns else F.lit("")
    parts.append("<h2>Failed</h2>" + _rows(["record", "question", "score"], [tuple(r) for r in failed.select("record_id", question, "overall").collect()]))
    style = "<style>.bar{color:#fff;padding:2px}.high{background:#2a7}.mid{background:#c90}.low{background:#c33}td,th{padding:2px 8px;text-align:left}</style>"
    return f"<!doctype html><meta charset='utf-8'>{style}{''.join(parts)}"


def set_summary(records: DataFrame) -> str:
    lines = [f"records: {records.count()}"]
    for facet in ("question_type", "difficulty", "noise", "domain"):
        rows = analytics.distribution(records, facet).orderBy("value").collect()
        lines.append(f"{facet}: " + ", ".join(f"{r['value']} {r['n']}" for r in rows))
    return "\n".join(lines)


def results_summary(results: DataFrame) -> str:
    row = results.agg(*analytics.aggregates(results)).first().asDict()
    return "\n".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.items())


def comparison_text(new: DataFrame, old: DataFrame) -> str:
    sign = lambda v: "+" if v > 0.001 else "-" if v < -0.001 else "="
    lines = [f"{k} {sign(v)} {v:+.4f}" for k, v in compare.deltas(new, old).first().asDict().items() if v is not None]
    moved = compare.movers(compare.group_deltas(new, old).select(F.concat_ws(" ", "facet", "value").alias("value"), "delta"))
    lines += [f"{r['kind']}: {r['value']} {r['delta']:+.4f}" for r in moved.orderBy(F.desc("delta")).collect()]
    flips = compare.flips(new, old).groupBy("flip").count().orderBy("flip").collect()
    return "\n".join(lines + [f"{r['flip']}: {r['count']}" for r in flips])


def cost_text(estimate: DataFrame) -> str:
    r = estimate.first()
    return f"{r['questions']} questions, about ${r['total_usd']:.2f} (generation ${r['generation_usd']:.2f}, evaluation ${r['evaluation_usd']:.2f}), {r['minutes']:.1f} minutes"


def joined_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """table, row (JSON) of several small tables; one that is empty raises."""
    out = None
    for name, df in tables.items():
        if df.isEmpty():
            raise ValueError(f"table {name} is empty")
        rows = df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def qualitative(records: DataFrame, question_type: str, n: int = 10) -> str:
    """The first n records of a type for reading: the feature is the bound."""
    rows = records.where(F.col("question_type") == question_type).orderBy("id").limit(n).select("id", "question", "gold_answer").collect()
    return "\n\n".join(f"[{r['id']}] {r['question']}\n-> {r['gold_answer']}" for r in rows)


def noise_label(results: DataFrame) -> DataFrame:
    return results.withColumn("noise", T.noise_key("noise_profile"))
