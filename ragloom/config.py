"""Tiers, weights, thresholds and other fixed tables; ``dim`` turns them into small DataFrames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

QUESTION_TYPES = tuple("single_chunk cross_doc unanswerable adversarial contradiction comparative compound procedural wrong_assumption ambiguous".split())
NOISE_TYPES = tuple("clean vocab_mismatch indirect typo fragment wrong_assumption compound register_variation".split())
DIFFICULTIES = ("easy", "medium", "hard")
TIERS = ("minimal", "medium", "exhaustive")
DIMENSIONS = tuple("faithfulness correctness abstention completeness conciseness".split())
HARD_TYPES = tuple("adversarial ambiguous comparative contradiction cross_doc".split())

#: Share of each question type by tier.
TYPE_MIX = {
    "minimal": dict(zip(QUESTION_TYPES[:4], (0.30, 0.30, 0.20, 0.20), strict=True)),
    "medium": dict(zip(QUESTION_TYPES[:7], (0.20, 0.25, 0.15, 0.12, 0.10, 0.10, 0.08), strict=True)),
    "exhaustive": dict(zip(QUESTION_TYPES, (0.15, 0.20, 0.12, 0.10, 0.08, 0.08, 0.08, 0.07, 0.07, 0.05), strict=True)),
}
#: Share of each noise layer by tier.
NOISE_MIX = {
    "minimal": [("vocab_mismatch", 0.40), ("clean", 0.60)],
    "medium": [("vocab_mismatch", 0.30), ("vocab_mismatch+indirect", 0.20), ("typo+fragment", 0.15), ("clean", 0.15), ("wrong_assumption", 0.10), ("compound", 0.10)],
    "exhaustive": [("vocab_mismatch", 0.25), ("vocab_mismatch+indirect", 0.15), ("typo+fragment", 0.12), ("clean", 0.13), ("wrong_assumption", 0.10), ("compound", 0.08), ("indirect", 0.07), ("register_variation", 0.05), ("fragment_only", 0.05)],
}
#: The transformations that a layer stands for.
NOISE_STEPS = {k: ([] if k == "clean" else ["fragment"] if k == "fragment_only" else k.split("+")) for k, _ in NOISE_MIX["exhaustive"]}
_METRICS = "set_recall chunk_recall mrr precision_at_k gold_chunk_ranks".split()
RETRIEVAL_METRICS = dict(zip(TIERS, (_METRICS[:1], _METRICS[:3], _METRICS), strict=True))
_CHECKS = "leakage|leakage eval_set_validation|leakage eval_set_validation_full coverage_diversity contradiction_detection staleness"
QUALITY_CHECKS = {tier: names.split() for tier, names in zip(TIERS, _CHECKS.split("|"), strict=True)}
JUDGED_DIMENSIONS = {"minimal": DIMENSIONS[:3], "medium": DIMENSIONS[:3], "exhaustive": DIMENSIONS}
JUDGE_QUESTIONS = {"minimal": 9, "medium": 9, "exhaustive": 24}
_THIRDS = {d: 1 / 3 for d in DIMENSIONS[:3]}
WEIGHTS = {"minimal": _THIRDS, "medium": _THIRDS, "exhaustive": dict(zip(DIMENSIONS, (0.35, 0.25, 0.10, 0.20, 0.10), strict=True))}
#: (most documents, tier, least questions, most questions); the last bracket has no bound.
SIZING = [
    (bound, tier, *limits)
    for bound, row in (
        (50, ((40, 40), (80, 100), (200, 200))),
        (200, ((50, 60), (100, 150), (200, 280))),
        (500, ((60, 70), (150, 200), (280, 400))),
        (1000, ((70, 80), (200, 280), (350, 500))),
        (5000, ((80, 80), (280, 370), (500, 600))),
        (2**62, ((80, 80), (370, 370), (600, 600))),
    )
    for tier, limits in zip(TIERS, row, strict=True)
]
COVERAGE_TARGET = dict(zip(TIERS, (None, (0.15, 0.30), (0.20, 0.40)), strict=True))
FAILURE_MODES = tuple(
    "conflated_chunks fabricated_statistic hallucinated_entity misattributed_statement over_hedging partial_retrieval silent_conflict_resolution under_hedging wrong_document_retrieved".split()
)

SPREAD_HEALTHY, SPREAD_LEAST = 0.20, 0.10
YES_LEAST, YES_MOST = 0.30, 0.95
PHI_HEALTHY, PHI_MOST = 0.40, 0.60
WEAK_PHI, WEAK_SHARE = 0.30, 0.50
TWIN_PHI = 0.70
DISCOVERY_SCORE = 0.8
CONTRADICTION_COSINE = 0.8
PASS_SCORE = 0.7
MATCH_JACCARD = 0.5
#: Dollars for a million tokens in and out; "default" for models without an entry.
PRICES = {"default": (5.0, 15.0)}

#: Judge questions: id, dimension, wording. The first of each dimension make the short set.
QUESTIONS_SHORT = [
    ("F1", "faithfulness", "Is every claim of the answer backed by the given passages?"),
    ("F2", "faithfulness", "Are all names, dates and figures of the answer found in the passages?"),
    ("F3", "faithfulness", "Does the answer avoid contradicting the passages?"),
    ("C1", "correctness", "Does the answer address what was asked?"),
    ("C2", "correctness", "Does the answer agree with the expected answer in substance?"),
    ("C3", "correctness", "Are the figures and conditions of the answer right?"),
    ("A1", "abstention", "Does the answer say so when the passages don't hold the information?"),
    ("A2", "abstention", "Does the answer avoid guessing beyond the passages?"),
    ("A3", "abstention", "Does the answer commit itself when the passages are sufficient?"),
]
QUESTIONS_FULL = QUESTIONS_SHORT[:3] + [
    ("F4", "faithfulness", "Is each statement attributed to the passage that makes it?"),
    ("F5", "faithfulness", "Are conditions and exceptions of the passages kept?"),
    ("F6", "faithfulness", "Are separate passages kept apart?"),
    ("F7", "faithfulness", "Are conflicts between passages named?"),
    ("F8", "faithfulness", "Is the certainty of the passages neither raised nor lowered?"),
    *QUESTIONS_SHORT[3:6],
    ("C4", "correctness", "Are wrong assumptions of the question pointed out?"),
    ("C5", "correctness", "Is the reasoning that joins the facts sound?"),
    *QUESTIONS_SHORT[6:],
    ("P1", "completeness", "Are all parts of the question answered?"),
    ("P2", "completeness", "Are all needed facts of the passages used?"),
    ("P3", "completeness", "Are necessary conditions stated?"),
    ("P4", "completeness", "Are all steps given where steps were asked for?"),
    ("P5", "completeness", "Are all compared things covered?"),
    ("N1", "conciseness", "Is the answer free of unrelated matter?"),
    ("N2", "conciseness", "Is the answer free of repetition?"),
    ("N3", "conciseness", "Is the answer as short as the question allows?"),
]
#: Questions about the quality of records by prefix.
CHECKS = ["QQ1", "QQ2", "QQ3", "QQ4", "GA1", "GA2", "GA3", "GA4", "GA5", "GC1", "GC3", "GC5", "NR2", "NR3"]
CHECK_GROUPS = dict(pair.split(":") for pair in "QQ:question_quality GA:gold_answer_quality GC:gold_chunk_quality NR:noise_realism".split())


def tier_config(tier: str) -> dict[str, Any]:
    """Everything of one tier."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}; tiers are {', '.join(TIERS)}")
    return {
        "question_types": dict(TYPE_MIX[tier]), "noise_layers": dict(NOISE_MIX[tier]), "dimensions": list(JUDGED_DIMENSIONS[tier]), "judge_questions": JUDGE_QUESTIONS[tier],
        "retrieval_metrics": list(RETRIEVAL_METRICS[tier]), "quality_checks": list(QUALITY_CHECKS[tier]), "weights": dict(WEIGHTS[tier]),
    }


def questions_for(scoring: str | list | None, tier: str) -> list[tuple]:
    """Custom (id, dimension, wording[, weight]) rows, "mvp", "full", or what the tier uses."""
    if scoring == []:
        raise ValueError("the list of questions is empty")
    if isinstance(scoring, list):
        return [(*q, 1.0)[:4] if len(q) == 3 else tuple(q) for q in scoring]
    name = scoring or ("full" if tier == "exhaustive" else "mvp")
    if name not in ("mvp", "full"):
        raise ValueError(f"unknown scoring {name!r}")
    return [(*q, 1.0) for q in (QUESTIONS_FULL if name == "full" else QUESTIONS_SHORT)]


def weights_for(weights: dict[str, float] | None, questions: list[tuple], tier: str, custom: bool = False) -> dict[str, float]:
    """Given weights (all dimensions needed), equal ones for custom questions, or the tier's."""
    dims = list(dict.fromkeys(q[1] for q in questions))
    if weights is not None:
        if missing := [d for d in dims if d not in weights]:
            raise ValueError(f"no weight for {', '.join(missing)}")
        return dict(weights)
    return {d: 1 / len(dims) for d in dims} if custom else dict(WEIGHTS[tier])


def dim(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
