"""Column expressions on scores, labels, versions, sizes and prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom import config
from ragloom.functions.text import col


def difficulty(question_type: Column | str, noise: Column | str) -> Column:
    """noise: an array of applied noise types."""
    clean = col(noise) == F.array(F.lit("clean"))
    return (
        F.when(col(question_type).isin(*config.HARD_TYPES), F.when(clean, "medium").otherwise("hard"))
        .when(col(question_type) == "single_chunk", F.when(clean, "easy").otherwise("medium"))
        .otherwise("medium")
    )


def bumped(version: Column | str, level: str) -> Column:
    """The next version; what isn't three numbers counts as 1.0.0."""
    if level not in ("major", "minor", "patch"):
        raise ValueError(f"unknown level {level!r}")
    well = F.coalesce(F.regexp_like(col(version), F.lit(r"^\d+\.\d+\.\d+$")), F.lit(False))
    parts = F.split(F.when(well, col(version)).otherwise("1.0.0"), r"\.")
    a, b, c = (parts[i].cast("long") for i in range(3))
    zero = F.lit(0).cast("long")
    shown = {"major": (a + 1, zero, zero), "minor": (a, b + 1, zero), "patch": (a, b, c + 1)}[level]
    return F.concat_ws(".", *(x.cast("string") for x in shown))


def score_class(score: Column | str) -> Column:
    return F.when(col(score) >= 0.8, "high").when(col(score) >= 0.6, "mid").otherwise("low")


def bar_width(score: Column | str) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(col(score) * 100).cast("int")))


def arrow(delta: Column | str) -> Column:
    return F.when(col(delta) > 0.001, "up").when(col(delta) < -0.001, "down").otherwise("same")


def depth(n_chunks: Column | str) -> Column:
    """Least and most questions of a document by its number of chunks."""
    pair = lambda a, b: F.struct(F.lit(a).alias("least"), F.lit(b).alias("most"))
    return F.when(col(n_chunks) <= 3, pair(1, 1)).when(col(n_chunks) <= 10, pair(2, 3)).otherwise(pair(3, 5))


def set_size(n_docs: Column | str, n_chunks: Column | str, least: Column | str, most: Column | str) -> Column:
    """Questions between the bracket's limits, more the denser the corpus; 20 chunks a document and more is the most."""
    density = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(n_chunks) / col(n_docs) / F.lit(20.0)))
    return F.bround(col(least) + density * (col(most) - col(least))).cast("long")


def cost(tokens_in: Column | str, tokens_out: Column | str, price_in: Column | str, price_out: Column | str) -> Column:
    return (col(tokens_in) * col(price_in) + col(tokens_out) * col(price_out)) / F.lit(1_000_000.0)


def cache_key(model: Column | str, temperature: Column | str, prompt: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", col(model), col(temperature).cast("string"), col(prompt)), 256)


def scope_key(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(col(p).cast("string") for p in parts)), 256), 1, 16)


def passage_id(title: Column | str) -> Column:
    return F.substring(F.sha1(col(title)), 1, 16)
