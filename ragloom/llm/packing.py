"""Best-fit decreasing packing of documents into bins of ``capacity`` words.

Documents longer than a bin are cut into full bins and a rest; every rest is packed, longest first, into the open bin
that it fills best, or opens one. Pieces of equal length are interchangeable, so packing needs only how many pieces
there are of each length: that histogram has at most ``capacity`` rows however large the input is. Open bins of equal
room are interchangeable too and lie in one pile; a segment tree over the rooms 0 to ``capacity`` finds the tightest
pile with enough room in logarithmic time. The result is the plan that packing one piece after another gives, as
intervals "these pieces of this length go to the bins from b on, so many to a bin", and every piece finds its bin by a join.

Ties: pieces of equal length are packed in the order of (a 12-bit hash of the id, id, hash of the text, piece); of bins with
equal room the one that has had it longest is filled first.

Defined results: a text's length is its number of white-space separated words; null texts and ids, and texts without
a word, take no room and are not packed; repeated rows are packed as often as they occur; texts that share an id are told
apart by text_hash, the 64-bit hash in hexadecimal digits; full pieces have bins of their own, so a text of any length is
packed whole. Columns beside id and text don't matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.shared import cut, keyed, table

CAPACITY = 2048
#: Pieces of a length are counted in so many slots, so that numbering them is never one task.
SLOTS = 4096
#: Pieces of one join key.
RUN = 1024


class RoomTree:
    """A segment tree over rooms: the smallest room of at least so much that some open bin has."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.some = bytearray(2 * self.size)

    def set(self, room: int, some: bool) -> None:
        at = room + self.size
        self.some[at] = some
        while at > 1:
            at >>= 1
            now = self.some[2 * at] or self.some[2 * at + 1]
            if self.some[at] == now:
                break
            self.some[at] = now

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if least >= self.size:
            return None
        if self.some[at]:
            return least
        while at > 1:  # up to the first subtree on the right with a bin, then down to its left-most one
            if not at & 1 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at *= 2
                    if not self.some[at]:
                        at += 1
                return at - self.size
            at >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(length, first piece, pieces, first bin, begin within it, pieces a bin) for intervals of pieces, longest first."""
    tree = RoomTree(capacity)
    piles: dict[int, deque[tuple[int, int]]] = {}
    n_bins = 0

    def stack(room: int, first: int, n: int) -> None:
        pile = piles.setdefault(room, deque())
        if not pile:
            tree.set(room, True)
        if pile and pile[-1][0] + pile[-1][1] == first:
            pile[-1] = (pile[-1][0], pile[-1][1] + n)
        else:
            pile.append((first, n))

    for length in sorted(histogram, reverse=True):
        done, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                # Each new bin takes as many pieces of this length as fit before the next is opened.
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    yield length, done, full * each, n_bins, 0, each
                if full and capacity - each * length:
                    stack(capacity - each * length, n_bins, full)
                n_bins += full
                done += full * each
                if rest:
                    yield length, done, rest, n_bins, 0, rest
                    if capacity - rest * length:
                        stack(capacity - rest * length, n_bins, 1)
                    n_bins += 1
                left = 0
                break
            # A bin that stays the tightest fit takes further pieces at once, so bins of a pile are filled in turn.
            pile = piles[room]
            first, n = pile.popleft()
            each = room // length
            if each == 1:
                take = min(n, left)
                yield length, done, take, first, capacity - room, 1
                if take < n:
                    pile.appendleft((first + take, n - take))
                if room - length:
                    stack(room - length, first, take)
                done, left = done + take, left - take
            else:
                # After one piece the bin has the least room that fits: it takes pieces until none fits.
                take = min(n, left // each)
                if take:
                    yield length, done, take * each, first, capacity - room, each
                    if room - each * length:
                        stack(room - each * length, first, take)
                    done, left = done + take * each, left - take * each
                else:
                    yield length, done, left, first, capacity - room, left
                    stack(room - left * length, first, 1)
                    take, done, left = 1, done + left, 0
                if take < n:
                    pile.appendleft((first + take, n - take))
            if not pile:
                tree.set(room, False)


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, th, copy, piece, begin, length: full pieces and rests."""
    n_words = F.regexp_count("text", F.lit(r"\S+"))
    counted = keyed(docs).select("doc_id", F.xxhash64("text").alias("th"), n_words.cast("long").alias("n")).where("n > 0")
    counted = counted.groupBy("doc_id", "th", "n").agg(F.count("*").alias("copies")).select("doc_id", "th", "n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    cutted = counted.select("doc_id", "th", "copy", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
    return cutted.select("doc_id", "th", "copy", "piece", (F.col("piece") * capacity).alias("begin"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("length"))


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, text_hash, piece, begin (first word of the text), length, bin, at (first word of the bin) of every piece."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")
    all_pieces = cut(pieces(docs, capacity).withColumn("slot", slot), "pieces")
    sizes = all_pieces.groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = sizes.select("length", "slot", (F.sum("n").over(Window.partitionBy("length").orderBy("slot")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "th", "copy", "piece")) - 1
    numbered = all_pieces.withColumn("inside", inside).join(before, ["length", "slot"]).withColumn("k", F.col("before") + F.col("inside"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        histogram: dict[int, int] = {}
        for pdf in batches:
            histogram.update(zip(pdf["length"].tolist(), pdf["n"].tolist(), strict=True))
        names = ["length", "first", "n", "bin", "at", "each"]
        rows: list[tuple] = []
        for row in plan(histogram, capacity):
            rows.append(row)
            if len(rows) == 100_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names, dtype="int64")

    # At most ``capacity`` rows meet in one task.
    histogram = sizes.groupBy("length").agg(F.sum("n").alias("n")).coalesce(1)
    steps = cut(histogram.mapInPandas(run, "length long, first long, n long, bin long, at long, each long"), "plan")
    last = F.col("first") + F.col("n") - 1
    steps = steps.select("*", F.explode(F.sequence(F.floor(F.col("first") / RUN), F.floor(last / RUN))).alias("run"))
    numbered = numbered.withColumn("run", F.floor(F.col("k") / RUN))
    away = F.col("k") - F.col("first")
    met = numbered.join(steps, ["length", "run"]).where((away >= 0) & (away < F.col("n")))
    bin_, at = F.col("bin") + F.floor(away / F.col("each")), F.col("at") + away % F.col("each") * F.col("length")
    return met.select("doc_id", F.lower(F.hex("th")).alias("text_hash"), "piece", "begin", "length", bin_.alias("bin"), at.alias("at"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of what is left: a row for each piece, as ``packed`` defines it."""
    return packed(docs)
