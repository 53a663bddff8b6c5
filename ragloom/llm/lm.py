"""Code length of documents under a byte model: prediction by partial matching.

The model is a trie of byte contexts of up to ``order`` bytes with the counts of the bytes that follow. A byte is
predicted in the longest context that the trie has. If it never followed there, the model escapes, at PPMC's estimate
(distinct followers over all followers plus distinct ones), to the context without its first byte, where followers of
the longer one are excluded from all counts; below the empty context every byte that is left is equally likely. A
document's code length is the sum over its bytes, in bits.

Documents are pretrained on crosswise: a hash of the id puts each into one of two folds, counts are gathered over all
documents, and each document is scored by the trie of the other fold, so that none predicts itself.

The tries are priced once for every byte sequence that occurs. Sequences whose contexts end in the same two bytes need only
the part of the trie below those bytes and the counts of its two upper levels, which have a fixed size; so pricing is spread
by the two bytes. Texts are gathered in chunks of at most ``CHUNK`` bytes (longer ones in pieces, each with the bytes
before it as context); a chunk asks for the price of each distinct sequence in it once, gets the answers by a join and is
scored with them. Nothing is sent to all tasks but the counts of the upper levels, so the plan is one at every size.

Defined results: null texts and ids have no score; an empty text has 0 bytes, 0 bits and null bits per byte; the
first bytes of a text are predicted in the shorter contexts there are; with nothing in the other fold a byte costs 8
bits; repeated rows, and rows that share an id, are counted and scored one by one. Columns beside id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.shared import buffers, cut, keyed, slices, table

ORDER = 4
#: Bytes of text in a chunk.
CHUNK = 16 << 20
#: Groups of contexts that are priced together.
GROUPS = 256

_LENGTH = np.uint64(56)
_LOW = np.uint64((1 << 56) - 1)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """A key for each byte: it and up to ``order`` bytes before it in the same text, and in the top byte how many those are."""
    n = len(data)
    at = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    key = data.astype(np.uint64)
    for k in range(1, min(order, n - 1) + 1):
        key[k:] |= np.where(at[k:] >= k, data[:-k].astype(np.uint64) << np.uint64(8 * k), np.uint64(0))
    return key | np.minimum(at, order).astype(np.uint64) << _LENGTH


class Trie:
    """Counts of (context, byte) on every level, from keys of whole sequences and how often they occur."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, upper: Sequence[np.ndarray] = ()):
        """upper: the counts of all sequences of one byte, two bytes..., where keys hold a part of the corpus only."""
        length, low = (keys >> _LENGTH).astype(np.int64), keys & _LOW
        self.order = order
        self.rows: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []
        self.totals: list[np.ndarray] = []
        self.kinds: list[np.ndarray] = []
        for k in range(order + 1):
            here = length >= k
            rows, at = np.unique(low[here] & np.uint64((1 << (8 * k + 8)) - 1), return_inverse=True)
            n = np.bincount(at, counts[here], len(rows))
            if k < len(upper):
                rows = np.flatnonzero(upper[k]).astype(np.uint64)
                n = upper[k][upper[k] > 0].astype(float)
            nodes, at = np.unique(rows >> np.uint64(8), return_inverse=True)
            self.rows.append(rows)
            self.counts.append(n)
            self.nodes.append(nodes)
            self.totals.append(np.bincount(at, n, len(nodes)))
            self.kinds.append(np.bincount(at, minlength=len(nodes)).astype(float))
        # What each context excludes in the one below it: all its followers, which occur there too.
        self.out: list[np.ndarray] = [np.empty(0)]
        for k in range(1, order + 1):
            below = self.rows[k] & np.uint64((1 << (8 * k)) - 1)
            n = self.counts[k - 1][np.searchsorted(self.rows[k - 1], below)] if len(below) else np.empty(0)
            self.out.append(np.bincount(np.searchsorted(self.nodes[k], self.rows[k] >> np.uint64(8)), n, len(self.nodes[k])))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The price of each sequence's last byte after the bytes before it."""
        length, low = (keys >> _LENGTH).astype(np.int64), keys & _LOW
        out = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        less_total, less_kinds = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(self.order, -1, -1):
            who = np.flatnonzero(open_ & (length >= k))
            if not len(who) or not len(self.nodes[k]):
                continue
            row = low[who] & np.uint64((1 << (8 * k + 8)) - 1)
            node = row >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.nodes[k], node), len(self.nodes[k]) - 1)
            there = self.nodes[k][at] == node
            who, row, at = who[there], row[there], at[there]
            total, kinds = self.totals[k][at] - less_total[who], self.kinds[k][at] - less_kinds[who]
            spot = np.minimum(np.searchsorted(self.rows[k], row), len(self.rows[k]) - 1)
            hit = self.rows[k][spot] == row
            out[who[hit]] += np.log2((total + kinds)[hit] / self.counts[k][spot[hit]])
            open_[who[hit]] = False
            miss = ~hit
            some = miss & (kinds > 0)  # with every follower excluded, escaping is certain
            out[who[some]] += np.log2((total + kinds)[some] / kinds[some])
            less_kinds[who[miss]] = self.kinds[k][at[miss]]
            if k:
                less_total[who[miss]] = self.out[k][at[miss]]
        left = np.flatnonzero(open_)
        out[left] += np.log2(256 - less_kinds[left])
        return out


def chunks(docs: DataFrame, order: int = ORDER, size: int = CHUNK) -> DataFrame:
    """chunk, fold, row, doc_id, skip, raw: the bytes of the texts; a chunk's rows are of one fold and come one after another.

    row tells rows of the table apart; a text that is longer than a chunk has several pieces, whose first ``skip`` bytes are context.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 36
        row, number, held, room = base, base, {0: base, 1: base}, {0: 0, 1: 0}
        for batch in batches:
            out: list[tuple] = []
            for doc_id, fold, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "fold", "raw")), strict=True):
                for begin in range(0, max(1, len(raw)), size):
                    skip = min(begin, order)
                    piece = raw[begin - skip : begin + size]
                    if room[fold] < len(piece) - skip or room[fold] <= 0:
                        number += 1
                        held[fold], room[fold] = number, size
                    room[fold] -= len(piece) - skip + 16  # empty texts take room too
                    out.append((held[fold], fold, row, doc_id, skip, piece))
                row += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            for lo in range(0, len(out), 1000):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 1000], strict=True), types, strict=True)], ["chunk", "fold", "row", "doc_id", "skip", "raw"])

    rows = keyed(docs).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "chunk long, fold int, row long, doc_id long, skip int, raw binary")


def _each(table: pa.Table | pa.RecordBatch, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of slices of the rows: where they begin and end, their keys without those of context, and where each row's keys begin."""
    raw, skip = table.column("raw"), table.column("skip").to_numpy()
    data, offsets = buffers((raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw).cast(pa.large_binary()))
    for lo, hi in slices(offsets, 4 << 20):
        ends = offsets[lo : hi + 1] - offsets[lo]
        keys = grams(data[offsets[lo] : offsets[hi]], ends, order)
        if skip[lo:hi].any():
            own = np.ones(len(keys), bool)
            for i in np.flatnonzero(skip[lo:hi]):
                own[ends[i] : ends[i] + skip[lo + i]] = False
            keys = keys[own]
            ends = ends - np.concatenate([[0], np.cumsum(skip[lo:hi])])
        yield lo, hi, keys, ends


def gathered(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """chunk, fold, key, n: how often each sequence occurs in each chunk; a chunk that several tasks read has several such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def told(which: tuple[int, int]) -> pa.RecordBatch:
            keys, counts = kept.pop(which)
            return pa.record_batch([pa.array(np.full(len(keys), which[0])), pa.array(np.full(len(keys), which[1], np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], ["chunk", "fold", "key", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            number, fold = batch.column("chunk").to_numpy(), batch.column("fold").to_numpy()
            for c, f in sorted(set(zip(number.tolist(), fold.tolist(), strict=True))):
                for _, _, keys, _ in _each(batch.filter(pa.array(number == c)), order):
                    k, n = np.unique(keys, return_counts=True)
                    if (c, f) in kept:
                        k, at = np.unique(np.concatenate([kept[c, f][0], k]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([kept[c, f][1], n]), len(k)).astype(np.int64)
                    kept[c, f] = k, n
                for which in [w for w in kept if w[1] == f and w[0] < c]:  # a fold's chunks come in order
                    yield told(which)
        for which in list(kept):
            yield told(which)

    return texts.select("chunk", "fold", "skip", "raw").mapInArrow(run, "chunk long, fold int, key long, n long")


def priced(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """fold, key, bits: the price of every sequence of a fold under the other fold's trie; counted: fold, key, n."""
    length = F.shiftrightunsigned("key", 56)
    # The two upper levels: 2 x (256 + 65,536) counts at most.
    levels = []
    for k in range(min(order, 1) + 1):
        level = np.zeros((2, 256 ** (k + 1)))
        tail = F.col("key").bitwiseAND(F.lit(256 ** (k + 1) - 1)).cast("int")
        for r in counted.where(length >= k).groupBy("fold", tail.alias("tail")).agg(F.sum("n").alias("n")).collect():
            level[r["fold"], r["tail"]] = r["n"]
        levels.append(level)
    # The two bytes before the last; shorter sequences need the upper levels only, and go by themselves.
    ends = F.when(length >= 2, F.pmod(F.hash(F.shiftright("key", 8).bitwiseAND(F.lit(65535))), F.lit(GROUPS))).otherwise(-1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n, fold = pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(float), pdf["fold"].to_numpy()
        bits = np.zeros(len(keys))
        for f in (0, 1):
            bits[fold == f] = Trie(keys[fold != f], n[fold != f], order, [level[1 - f] for level in levels]).bits(keys[fold == f])
        return pd.DataFrame({"fold": fold, "key": pdf["key"], "bits": bits})

    return counted.groupBy(ends.cast("int").alias("ends")).applyInPandas(run, "fold int, key long, bits double")


def scored(docs: DataFrame, order: int = ORDER, size: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, bits, bits_per_byte."""
    texts = cut(chunks(docs, order, size), "chunks")
    asked = cut(gathered(texts, order), "asked")
    counted = cut(asked.groupBy("fold", "key").agg(F.sum("n").alias("n")), "grams")
    prices = cut(priced(counted, order), "prices")
    # One strategy at every size: both sides are sorted, as neither has a bound.
    answers = asked.select("chunk", "fold", "key").join(prices.hint("merge"), ["fold", "key"]).select("chunk", "key", "bits")

    def run(rows: pa.Table, answer: pa.Table) -> pa.Table:
        keys, first = np.unique(answer.column("key").to_numpy().view(np.uint64), return_index=True)
        bits = answer.column("bits").to_numpy()[first]
        sizes, sums = [np.empty(0, np.int64)], [np.empty(0)]
        for _, _, own, ends in _each(rows, order):
            distinct, at = np.unique(own, return_inverse=True)
            price = bits[np.searchsorted(keys, distinct)] if len(distinct) else np.empty(0)
            running = np.concatenate([[0.0], np.cumsum(price[at])])
            sizes.append(np.diff(ends))
            sums.append(running[ends[1:]] - running[ends[:-1]])
        return pa.table([rows.column("row"), rows.column("doc_id"), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sums))], names=["row", "doc_id", "n", "sum"])

    done = texts.select("chunk", "row", "doc_id", "skip", "raw").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, "row long, doc_id long, n long, sum double")
    whole = done.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_bytes"), F.round(F.sum("sum"), 3).alias("bits"))
    return whole.select("doc_id", "n_bytes", "bits", F.when(F.col("n_bytes") > 0, F.round(F.col("bits") / F.col("n_bytes"), 6)).alias("bits_per_byte"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
