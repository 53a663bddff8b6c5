"""Near-duplicate documents by min-max hashing.

Each of ``permutations`` hash functions is evaluated once per shingle and both its smallest and its largest value
are kept, so a signature of 2 x permutations values costs half the evaluations of plain MinHash, and the share of
equal values is still an unbiased estimate of the Jaccard similarity. The signatures are banded; documents that share
a band are verified on whole signatures; verified pairs make groups (connected components).

Defined results: null texts, null ids and texts without a word are never duplicates. A text of fewer words than a
shingle is one shingle. Rows that repeat an id and a text are one document; rows that share an id but not the text are
different ones, told apart by a hash of the text. Of a group the document of the smallest id stays, of several texts of
that id the one of the smallest hash. Columns beside id and text don't matter, and of long texts every word counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.components import connected
from ragloom.llm.shared import buffers, cut, fresh, keyed, mix, named, normalised, slices, table, word_hashes, words

SHINGLE = 5
PERMUTATIONS = 96
ROWS = 4
THRESHOLD = 0.5


def shingle_hashes(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, and how many come before each text."""
    data, offsets = buffers(normalised(texts))
    starts, ends, before = words(data, offsets)
    hashed = word_hashes(data, starts, ends)
    n_words = np.diff(before)
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = np.concatenate([[0], np.cumsum(n_shingles)])
    at = np.arange(first[-1]) + np.repeat(before[:-1] - first[:-1], n_shingles)
    stop = np.repeat(before[1:], n_shingles)
    rng = np.random.default_rng(11)
    total = np.zeros(len(at), np.uint64)
    for j in range(shingle):
        factor = np.uint64(rng.integers(1, 1 << 63, dtype=np.uint64) * 2 + 1)
        if len(hashed):
            total += np.where(at + j < stop, hashed[np.minimum(at + j, len(hashed) - 1)] * factor, np.uint64(j))
    return mix(total), first


def signatures(texts: pa.Array, shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (minima, then maxima) of the texts that have a word, and the places of those texts."""
    hashed, first = shingle_hashes(texts, shingle)
    some = np.flatnonzero(np.diff(first))
    out = np.empty((len(some), 2 * permutations), np.uint32)
    if not len(some):
        return out, some
    x = (hashed >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 1 << 31, permutations, np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, permutations, np.uint32)
    begin = 0
    while begin < len(some):  # pieces that stay in the processor's cache
        end = max(begin + 1, int(np.searchsorted(first[some], first[some[begin]] + 65536)))
        lo, hi = first[some[begin]], first[some[end - 1] + 1]
        part, at = x[lo:hi], first[some[begin:end]] - lo
        y = np.empty_like(part)
        for k in range(permutations):
            np.multiply(part, factors[k], out=y)
            np.add(y, shifts[k], out=y)
            out[begin:end, k] = np.minimum.reduceat(y, at)
            out[begin:end, permutations + k] = np.maximum.reduceat(y, at)
        begin = end
    return out, some


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band; a band takes its values from minima and maxima of different permutations.

    Column j of the minima and column j of the maxima are of one permutation, so the maxima are moved by a third of a band.
    """
    n, width = values.shape
    bands = width // rows
    keys = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        part = values[:, r * bands : (r + 1) * bands]
        if r >= rows // 2:
            part = np.roll(part, bands // 3, 1)
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1))
    return keys ^ mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))


def signed(docs: DataFrame, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, th (hash of the text), sig (16 bits of each value), whole (a hash of the signature), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column("text"))
            for lo, hi in slices(offsets):
                part = batch.slice(lo, hi - lo)
                values, some = signatures(part.column("text"), shingle, permutations)
                keys = band_keys(values, rows).view(np.int64)
                whole = mix(mix(values.astype(np.uint64).cumsum(1)).sum(1)).view(np.int64)
                short = values.astype(np.uint16)
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(pa.array(some)),
                        part.column("th").take(pa.array(some)),
                        pa.array([r.tobytes() for r in short], pa.binary()),
                        pa.array(whole),
                        pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel())),
                    ],
                    ["doc_id", "th", "sig", "whole", "bands"],
                )

    texts = keyed(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    return texts.mapInArrow(run, "doc_id long, th long, sig binary, whole long, bands array<long>")


def agreeing(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ``whole`` values whose signatures agree on a share of at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            share = (left == right).mean(1)
            keep = pa.array(share >= threshold)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(share)], ["a", "b", "similarity"]).filter(keep)

    left = sigs.select(F.col("whole").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("whole").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, similarity double")


def copies(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, th, duplicate_of: each document (id and hash of its text) that goes, and the id of its group that stays.

    Documents of equal signatures are one node from the start. In each band bucket all nodes are compared with the
    smallest; only a node that does not agree with it is compared with the others too. Nodes that agree with the
    smallest are in one group already, so pairs among them can't change a group: none is skipped that could.
    """
    sigs = cut(signed(docs, shingle, permutations, rows), "signatures")
    nodes = cut(sigs.groupBy("whole").agg(F.min_by("sig", "doc_id").alias("sig"), F.min_by("bands", "doc_id").alias("bands")), "nodes")
    buckets = nodes.select("whole", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("whole").alias("lead")).where("n > 1")
    members = cut(buckets.join(shared.select("bucket", "lead"), "bucket").where("whole <> lead"), "members")
    told = cut(agreeing(members.select(F.col("lead").alias("a"), F.col("whole").alias("b")).distinct(), nodes, threshold), "led")
    odd = members.join(told.select(F.col("a").alias("lead"), F.col("b").alias("whole")), ["lead", "whole"], "left_anti")
    rest = odd.select("bucket", F.col("whole").alias("x")).join(members.select("bucket", F.col("whole").alias("y")), "bucket").where("x <> y")
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rest = rest.join(told.select("a", "b"), ["a", "b"], "left_anti")
    edges = told.unionByName(agreeing(rest, nodes, threshold))
    groups = connected(edges.select("a", "b"))
    rooted = sigs.select("doc_id", "th", "whole").join(groups.withColumnRenamed("node", "whole"), "whole", "left").select("doc_id", "th", F.coalesce("root", "whole").alias("root"))
    rooted = cut(rooted.distinct(), "rooted")
    keep = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return rooted.join(keep.select("root", "first"), "root").where(F.struct("doc_id", "th") != F.col("first")).select("doc_id", "th", F.col("first.doc_id").alias("duplicate_of"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, duplicate_of: ids with a text that goes, and the id that stays; texts of one id that are copies of each other have no row."""
    return copies(docs, threshold, shingle, permutations, rows).where("doc_id <> duplicate_of").select("doc_id", "duplicate_of").distinct()


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, every column as it was.

    Defined results: a row goes for its id and its text together; of rows that repeat both one stays. Rows without an id, a
    text or a word stay, all of them.
    """
    rows, key, th = named(docs)
    gone = copies(docs).select(F.col("doc_id").alias(key), F.col("th").alias(th))
    # One strategy at every size: rows are shuffled and sorted once, by id and hash, and the window takes them as they come.
    left = rows.join(gone.hint("merge"), [key, th], "left_anti")
    first = F.row_number().over(Window.partitionBy(key, th).orderBy(F.lit(1)))
    (nth,) = fresh(rows, "nth")
    return left.withColumn(nth, first).where(F.col(key).isNull() | (F.col(nth) == 1)).select(*docs.columns)
