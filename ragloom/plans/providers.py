"""Models behind one small interface, and asking them from DataFrames.

A provider is an object with ``complete(prompt, temperature) -> str`` that can be pickled. ``ask`` sends each distinct
prompt once, keeps what is answered in a table, and takes from there what is asked again.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import scalars as S
from ragloom.operators import versioning

TRIES, PARALLEL = 3, 5


class Provider(Protocol):
    name: str

    def complete(self, prompt: str, temperature: float = 0.0) -> str: ...


class ProviderError(RuntimeError):
    """A model that didn't answer after all tries."""


def extract_json(text: str) -> Any:
    """JSON from a reply: a fenced block, the whole, or the first balanced object, then list."""
    body = text.strip()
    if "```" in body and len(parts := body.split("```")) > 2:
        body = parts[1].removeprefix("json").strip()
    found = _loaded(body)
    for pair in ("{}", "[]"):
        if found is None and (inner := _balanced(body, pair)) is not None:
            found = _loaded(inner)
    if found is not None:
        return found[0]
    raise ValueError(f"no JSON in {text[:200]!r}")


def _loaded(text: str) -> tuple[Any] | None:
    try:
        return (json.loads(text),)
    except json.JSONDecodeError:
        return None


def _balanced(text: str, pair: str) -> str | None:
    """From the first opening sign to the one that closes it; signs inside strings count as well."""
    begin, level = text.find(pair[0]), 0
    for i, sign in enumerate(text[begin:] if begin >= 0 else ""):
        level += (sign == pair[0]) - (sign == pair[1])
        if not level:
            return text[begin : begin + i + 1]
    return None


def extract_json_array(text: str) -> list:
    """A list, or the list that an object of one key wraps."""
    found = extract_json(text)
    if isinstance(found, dict) and len(found) == 1:
        found = next(iter(found.values()))
    if not isinstance(found, list):
        raise ValueError(f"no list in {text[:200]!r}")
    return found


def truth(value: Any, default: bool) -> bool:
    """A verdict from a reply, read strictly: booleans and the words yes, no, true, false."""
    if isinstance(value, dict):
        value = value.get("verdict")
    if isinstance(value, bool):
        return value
    return {"yes": True, "true": True, "no": False, "false": False}.get(str(value).strip().lower(), default)


class OfflineProvider:
    """Deterministic replies made of the prompt itself, for tests and dry runs.

    Prompts begin with "TASK name"; passages and other parts follow in lines "[label] text".
    """

    name = "offline"

    def complete(self, prompt: str, temperature: float = 0.0) -> str:
        task = prompt.partition("\n")[0].removeprefix("TASK ").strip()
        parts: dict[str, list[str]] = {}
        for label, body in re.findall(r"^\[(\w+)\] (.*?)(?=^\[\w+\] |\Z)", prompt, re.M | re.S):
            parts.setdefault(label, []).append(body.strip())
        first = lambda label: (parts.get(label) or [""])[0]
        pick = int(hashlib.sha256(prompt.encode()).hexdigest()[:8], 16)
        if task == "question":
            facts = [re.split(r"(?<=[.!?])\s", p)[0] for p in parts.get("passage", [])] or ["nothing"]
            return json.dumps({"question": "What is said about " + " and ".join(" ".join(f.split()[:6]) for f in facts) + "?", "gold_answer": " ".join(facts), "intents": [{"text": f, "required": i == 0} for i, f in enumerate(facts)], "notes": ""})
        if task == "rewrite":
            return first("kind") + ": " + first("text")
        if task in ("entities", "terms"):
            return json.dumps({"terms": list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", first("passage"))))[:5]})
        if task == "answer":
            return re.split(r"(?<=[.!?])\s", first("context"))[0]
        if task == "leak":
            return json.dumps({"answered": pick % 10 == 0})
        if task == "contradict":
            return json.dumps({"contradicts": pick % 2 == 0, "reason": "dry run"})
        if task == "judge":
            grounded = [w for w in first("answer").lower().split() if w in " ".join(parts.get("context", [])).lower()]
            share = len(grounded) / max(1, len(first("answer").split()))
            return json.dumps({q: {"verdict": "yes" if share * 100 > (pick >> i) % 60 else "no", "reason": ""} for i, q in enumerate(first("questions").split())})
        if task == "intent":
            return json.dumps({"covered": first("point").lower()[:40] in first("answer").lower()})
        if task == "check":
            return json.dumps({q: {"verdict": "yes" if (pick >> i) % 12 else "no"} for i, q in enumerate(first("questions").split())})
        return "{}"


class HttpProvider:
    """A chat completion endpoint; the key is read from the named environment variable where the call is made."""

    def __init__(self, url: str, model: str, key_variable: str = "RAGLOOM_API_KEY", timeout: float = 60.0):
        self.url, self.name, self.key_variable, self.timeout = url, model, key_variable, timeout

    def complete(self, prompt: str, temperature: float = 0.0) -> str:
        import os

        body = json.dumps({"model": self.name, "temperature": temperature, "messages": [dict(content=prompt, role="user")]}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


def complete(provider: Provider, prompt: str, temperature: float = 0.0, pause: float = 1.0) -> str:
    """Three tries with growing pauses."""
    for k in range(TRIES):
        try:
            return provider.complete(prompt, temperature)
        except Exception as wrong:  # noqa: BLE001  any failure of a model is worth another try
            last = wrong
            if k + 1 < TRIES:
                time.sleep(pause * 2**k)
    raise ProviderError(str(last)) from last


def ask(rows: DataFrame, provider: Provider, table: str, temperature: float = 0.0, pause: float = 1.0) -> DataFrame:
    """Rows with the column reply (null where the model failed) for their column prompt.

    table: a folder of key, response that is read first and appended to; so calls are paid for once.
    """
    spark = rows.sparkSession
    # Written first, as the prompts are read twice: what is asked is what replies are joined to, also if rows can't be repeated.
    asked = f"{table}-asked/{uuid.uuid4().hex}"
    rows.write.parquet(asked)
    rows = spark.read.schema(rows.schema).parquet(asked)
    prompts = rows.select(F.lit(provider.name).alias("model"), F.lit(str(temperature)).alias("temperature"), "prompt").where("prompt is not null").distinct()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    schema = "key string, response string"
    _, todo = versioning.answered(prompts, spark.read.schema(schema).parquet(table) if there else spark.createDataFrame([], schema))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> str | None:
            try:
                return complete(provider, prompt, temperature, pause)
            except ProviderError:
                return None

        with ThreadPoolExecutor(PARALLEL) as pool:
            for pdf in batches:
                yield pd.DataFrame({"key": pdf["key"], "response": list(pool.map(one, pdf["prompt"]))})

    # Written before anything filters on it, so that no plan repeats a call; failures are asked again another time.
    todo.select("key", "prompt").mapInPandas(run, schema).where("response is not null").write.mode("append").parquet(table)
    replies = spark.read.schema(schema).parquet(table).groupBy("key").agg(F.min("response").alias("reply"))
    keyed = rows.withColumn("key", S.cache_key(F.lit(provider.name), F.lit(str(temperature)), "prompt"))
    done = keyed.join(replies, "key", "left").drop("key")
    # Written under a name of its own: scans of one folder at different times count as equal in a plan that holds both.
    path = f"{table}-rows/{uuid.uuid4().hex}"
    done.write.parquet(path)
    return spark.read.schema(done.schema).parquet(path)


def prompt(task: str, *parts: tuple) -> Any:
    """A prompt column: the task, then labelled parts; array columns give a line for each element."""
    lines = [F.lit(f"TASK {task}")]
    for label, value in parts:
        lines.append(F.concat(F.lit(f"[{label}] "), value if not isinstance(value, str) else F.lit(value)))
    return F.concat_ws("\n", *lines)
