"""What the corpus operators have in common: shared tables and vectorised text primitives.

Tables that cut lineage are written as Parquet below the folder named by ``spark.checkpoint.dir``, which every
executor shares, so a lost executor never takes a cut with it.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters, marks and numbers make words; Java, RE2 and the regex module read this class alike.
WORD_CLASS = r"\p{L}\p{M}\p{N}"
#: Where the tables are that ``cut`` wrote and nobody deleted yet.
_PATHS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only where none is set and everything runs on one machine."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ragloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, so that later steps neither repeat nor lose it."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS.add(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind what ``cut`` returned; nothing that is still to be computed may read it."""
    _PATHS.discard(df.cut_path)
    _delete(df.sparkSession, df.cut_path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``cut`` whose tables stay; all others that are written in the block are deleted at its end."""
    before, kept = set(_PATHS), set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = cut(df, name)
        kept.add(out.cut_path)
        return out

    yield keep
    for path in _PATHS - before - kept:
        _delete(spark, path)
        _PATHS.discard(path)


def release(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote for this application."""
    _delete(spark, shared_dir(spark))
    _PATHS.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under names of its own, without null texts or null ids."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before each as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def named(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the id, and the hash of the text, by which results meet their rows.

    Rows without an id or a text meet nothing; instead of the hash they get a number that spreads them over all tasks.
    """
    key, th = fresh(docs, "row_id", "text_hash")
    whole = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(4096))
    return docs.withColumn(key, F.when(whole, F.col("doc_id").cast("long"))).withColumn(th, F.when(whole, F.xxhash64(F.col("text").cast("string"))).otherwise(spread)), key, th


# == # Vectorised text: one Arrow string array is one byte array with offsets, and everything below works on those.

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WORD[128:] = True
#: Lead bytes of U+00C0 to U+024F, which are letters but for two signs.
_PLAIN_LEADS = np.zeros(256, bool)
_PLAIN_LEADS[:0xC0] = True
_PLAIN_LEADS[0xC3:0xCA] = True

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (or large binaries), end to end, and where each begins (one more than there are texts)."""
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string())
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def normalised(texts: pa.Array) -> pa.Array:
    """Lower case; anything but letters, marks and numbers in scripts beyond Latin becomes a space."""
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    data, _ = buffers(low)
    signs = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    if not _PLAIN_LEADS[data].all() or signs.any():
        low = pc.replace_substring_regex(low, rf"[^{WORD_CLASS}]+", " ")
    return low


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and how many words come before each text (one more than there are texts)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    here = _WORD[data]
    begins, stops = here.copy(), here.copy()
    begins[1:] &= ~here[:-1]
    stops[:-1] &= ~here[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = here[edges]
    stops[edges[1:] - 1] = here[edges[1:] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from differences of one running polynomial over all bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    running = np.empty(len(data) + 1, np.uint64)
    running[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _MULT, "up"), out=running[1:])
    return mix((running[ends] - running[starts]) * _powers(len(data), _INV, "down")[starts])


def slices(batch_bytes: np.ndarray, most: int = 8 << 20) -> list[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` bytes each, so that temporary arrays stay small."""
    out, begin = [], 0
    n = len(batch_bytes) - 1
    while begin < n:
        end = int(np.searchsorted(batch_bytes, batch_bytes[begin] + most, "right")) - 1
        end = min(max(end, begin + 1), n)
        out.append((begin, end))
        begin = end
    return out
