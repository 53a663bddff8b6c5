"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c are at squared distance 2 - 2c. A rotation spreads the energy over all dimensions, and the
dimensions are split into blocks. The squared distance is the sum of the blocks' squared distances, so a pair within
the limit T is within T x share in at least one block, for any shares that sum to one; a block's share is its part of
the total energy. Each block is range-joined on a grid: a vector lives in the cell of its leading dimensions and asks
the cells that its ball of radius sqrt(T x share) reaches, of two neighbouring cells one the other; inside a cell the
sides meet in the order of one more dimension, so that only stretches within the radius are compared. The union of the
blocks' candidates is verified on whole vectors. Nothing within the limit is lost, so recall is 1.

Equal vectors are one node from the start, however many rows have them, and nodes are what the join compares. The result
has one row for each row of the table: its class (all that is reached over near pairs, named by its smallest id) and its
number of links (how many other rows are within the limit), so it grows with the table and not with the pairs.

Defined results: null ids, null vectors, vectors with a null, infinite or undefined entry, empty and zero vectors have no
row. Vectors of different lengths are never near; those of each length are joined among themselves. Rows that repeat an
id and a vector (at unit norm) are one; an id with several vectors has a row for each. The rotation and the shares are
held for every length of vector that occurs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.components import connected
from ragloom.llm.shared import cut, table

COSINE = 0.95
BLOCKS = 8
#: Leading dimensions of a block that make its grid, and the width of its cells in radii.
GRID, WIDTH = 3, 2.0
#: Most vectors of a cell, and askers of it, that one task holds at a time.
CELL = 4096
#: Vectors of more dimensions are rotated in pieces of so many, chosen by a permutation.
PIECE = 1024


@functools.lru_cache(8)
def _rotation(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return rng.permutation(dim), np.linalg.qr(rng.standard_normal((min(dim, PIECE),) * 2))[0].astype(np.float32)


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows under an orthogonal map that depends on their length only."""
    by, turn = _rotation(x.shape[1])
    x = x[:, by]
    whole = x.shape[1] // len(turn) * len(turn)
    turned = (x[:, :whole].reshape(-1, len(turn)) @ turn).reshape(len(x), whole)
    return np.concatenate([turned, x[:, whole:]], 1) if whole < x.shape[1] else turned


def _edges(dim: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).astype(int)


def _lengths(v: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector that a column without nulls has: the places, and the entries as a matrix."""
    sizes = np.diff(v.offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        where = np.flatnonzero(sizes == dim)
        part = v if len(where) == len(v) else v.take(pa.array(where))
        if dim:
            yield where, part.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The vectors of a batch, rotated, length by length, with other columns."""
    for where, x in _lengths(batch.column("v")):
        yield rotated(x), *(batch.column(c).to_numpy(zero_copy_only=False)[where] for c in columns)


def _units(docs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v: distinct pairs of an id and a vector at unit norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, x in _lengths(batch.column("v")) if batch.num_rows else ():
                x = x.astype(np.float64)  # entries that are null are undefined here
                most = np.abs(x).max(1)
                some = np.isfinite(most) & (most > 0)
                x = x[some] / most[some, None]  # by the largest entry first, whose square may be out of range
                x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
                edges = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.record_batch([batch.column("vec_id").take(pa.array(where[some])), pa.ListArray.from_arrays(edges, pa.array(x.ravel()))], ["vec_id", "v"])

    rows = docs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return rows.mapInArrow(run, "vec_id long, v array<float>").distinct()


def near_pairs(nodes: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """a, b: keys a < b of different vectors with at least that cosine; nodes: key, v (float arrays at unit norm)."""
    limit = 2 - 2 * cosine + 1e-6  # float entries

    def energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for (x,) in _by_length(batch) if batch.num_rows else ():
                cuts = _edges(x.shape[1], blocks)
                total[x.shape[1]] = total.get(x.shape[1], 0) + np.add.reduceat((x.astype(np.float64) ** 2).sum(0), cuts[:-1])
        rows = [(dim, b, e) for dim, es in total.items() for b, e in enumerate(es.tolist())]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["dim", "block", "e"])

    # A row for each block of each length.
    by_block = nodes.select("v").mapInArrow(energies, "dim int, block int, e double").groupBy("dim", "block").agg(F.sum("e").alias("e")).toPandas()
    radii: dict[int, np.ndarray] = {}
    for dim, rows in by_block.groupby("dim"):
        e = rows.sort_values("block")["e"].to_numpy() + 1e-12
        radii[int(dim)] = np.sqrt(limit * e / e.sum())

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each vector and block that lives in a cell, and one for each other cell that it asks."""
        for batch in batches:
            for x, keys in _by_length(batch, "key") if batch.num_rows else ():
                dim = x.shape[1]
                cuts = _edges(dim, blocks)
                for b, radius in enumerate(radii[dim].tolist()):
                    part = np.ascontiguousarray(x[:, cuts[b] : cuts[b + 1]])
                    g = min(GRID, part.shape[1])
                    at = part[:, :g] / (WIDTH * radius)
                    home = np.floor(at).astype(np.int64)
                    inside = at - home
                    for move in np.ndindex(*(3,) * g):
                        step = np.array(move) - 1
                        # Of two cells one asks the other, not both: steps whose first move goes up, and none at all.
                        if next((d for d in step if d), 1) < 0:
                            continue
                        # Distance from the vector to the cell, in widths: 0 along dimensions in which it is at home.
                        away = np.where(step == 0, 0, np.where(step > 0, 1 - inside, inside))
                        which = np.flatnonzero((away**2).sum(1) <= (1 + 1e-4) / WIDTH**2)
                        if not len(which):
                            continue
                        cell = home[which] + step
                        code = np.zeros(len(which), np.int64)
                        for d in range(g):
                            code = code * 1_000_003 + cell[:, d]
                        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(part.shape[1] * 4), len(which), [None, pa.py_buffer(part[which].tobytes())]).cast(pa.binary())
                        columns = [pa.array(np.full(len(which), v, np.int32)) for v in (dim, b)] + [pa.array(code), pa.array(np.full(len(which), not step.any())), pa.array(keys[which]), raw]
                        yield pa.record_batch(columns, ["dim", "block", "cell", "lives", "key", "part"])

    at = ["dim", "block", "cell"]
    spread = cut(nodes.select("key", "v").mapInArrow(blocked, "dim int, block int, cell long, lives boolean, key long, part binary"), "cells")
    counts = spread.groupBy(*at).agg(F.count_if("lives").alias("homes"), F.count_if(~F.col("lives")).alias("askers")).where("homes > 0 and homes + askers > 1")
    counts = counts.select(*at, F.ceil(F.col("homes") / CELL).cast("int").alias("hs"), F.ceil(F.col("askers") / CELL).cast("int").alias("qs"))
    # A crowded cell is split on both sides, every part of one meeting every part of the other; q counts the parts of
    # the askers from 0, and -1 - q those of the cell's own vectors, of which the earlier are asked by the later.
    placed = spread.join(counts, at).withColumn("own", F.pmod(F.xxhash64("key"), F.when(F.col("lives"), F.col("hs")).otherwise(F.col("qs"))).cast("int"))
    own = F.col("own")
    to = lambda h, q, asks: F.struct(h.cast("int").alias("h"), q.cast("int").alias("q"), F.lit(asks).alias("asks"))
    upto = lambda a, b: F.when(F.lit(a) <= b, F.sequence(F.lit(a), b)).otherwise(F.array().cast("array<int>"))
    asked = F.transform(upto(0, F.col("hs") - 1), lambda h: to(h, own, True))
    own_asked = F.transform(upto(0, F.greatest("qs", F.lit(1)) - 1), lambda q: to(own, q, False))
    others = F.transform(upto(0, F.col("hs") - 1), lambda k: F.when(k < own, to(k, -1 - own, True)).when(k > own, to(own, -1 - k, False)))
    others = F.when(F.col("hs") > 1, F.filter(others, lambda t: t.isNotNull())).otherwise(F.array().cast("array<struct<h:int,q:int,asks:boolean>>"))
    placed = placed.select(*at, "key", "part", F.explode(F.when(F.col("lives"), F.concat(own_asked, others)).otherwise(asked)).alias("t")).select(*at, "key", "part", "t.*")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        r2 = float(radii[int(pdf["dim"].iloc[0])][int(pdf["block"].iloc[0])] ** 2 * (1 + 1e-4) + 1e-6)
        x = np.frombuffer(b"".join(pdf["part"]), np.float32).reshape(len(pdf), -1)
        # In the order of the first dimension that is not in the grid.
        axis = min(GRID, x.shape[1] - 1)
        by = np.argsort(x[:, axis], kind="stable")
        x, keys, asks = x[by], pdf["key"].to_numpy()[by], pdf["asks"].to_numpy()[by]
        home, hk = x[~asks], keys[~asks]
        reach, half = np.sqrt(r2), (home**2).sum(1, keepdims=True) / 2
        # q . h - |q|^2 / 2 - |h|^2 / 2 + limit / 2 is not negative where the two are within the limit: one product a piece.
        right = np.concatenate([home, np.ones_like(half), -half], 1).T.copy()
        out_a, out_b = [], []
        for q, qk, same in ((x[asks], keys[asks], False), (home, hk, True)):
            if same and pdf["q"].iloc[0] != 0:
                continue
            left = np.concatenate([q, (r2 - (q**2).sum(1, keepdims=True)) / 2, np.ones((len(q), 1), np.float32)], 1).astype(np.float32)
            for i in range(0, len(q), 512):
                piece = q[i : i + 512, axis]
                lo = i if same else np.searchsorted(home[:, axis], piece[0] - reach)
                hi = np.searchsorted(home[:, axis], piece[-1] + reach, "right")
                a, b = np.nonzero(left[i : i + 512] @ right[:, lo:hi] >= -1e-6)
                if same:
                    a, b = a[a < b], b[a < b]
                ka, kb = qk[i + a], hk[lo + b]
                out_a.append(np.minimum(ka, kb))
                out_b.append(np.maximum(ka, kb))
        return pd.DataFrame({"a": np.concatenate(out_a or [[]]).astype(np.int64), "b": np.concatenate(out_b or [[]]).astype(np.int64)})

    pairs = placed.groupBy(*at, "h", "q").applyInPandas(joined, "a long, b long").distinct()
    left = nodes.select(F.col("key").alias("a"), F.col("v").alias("va"))
    right = nodes.select(F.col("key").alias("b"), F.col("v").alias("vb"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (where, x), (_, y) in zip(_lengths(batch.column("va")), _lengths(batch.column("vb")), strict=True) if batch.num_rows else ():
                dot = np.einsum("ij,ij->i", x.astype(np.float64), y.astype(np.float64))
                good = pa.array(where[dot >= cosine - 5e-7])  # rounded to six digits
                yield batch.select(["a", "b"]).take(good)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(verified, "a long, b long")


def near_duplicate_vectors(docs: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", blocks: int = BLOCKS) -> DataFrame:
    """vec_id, class_id (smallest id of all that are reached over near pairs), links (other rows within the limit)."""
    units = cut(_units(docs, id_col, vec_col), "units")
    nodes = units.groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = cut(nodes.withColumn("key", F.monotonically_increasing_id()), "nodes")  # numbers that stay as they are written
    near = cut(near_pairs(nodes.select("key", "v"), cosine, blocks), "near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(nodes.select(F.col("key").alias("b"), "n"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("around"))
    rooted = nodes.drop("v").join(connected(near).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = cut(rooted.join(around, "key", "left").select("key", "root", "least", (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("links")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("key", "class_id", "links")
    told = nodes.select("key", "v").join(named, "key").select(F.xxhash64("v").alias("h"), "v", "class_id", "links")
    # A vector that a third of all rows have meets its one node without a sort; adaptive execution splits its rows.
    return units.withColumn("h", F.xxhash64("v")).join(told.hint("shuffle_hash"), ["h", "v"]).select("vec_id", "class_id", "links")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


SQL = f"""
with recursive sized as (select vec_id, list_transform(embedding, lambda x: x::double) as e, list_max(list_transform(embedding, lambda x: abs(x::double))) as most from embeddings
    where vec_id is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
scaled as (select vec_id, list_transform(e, lambda x: x / most) as e from sized where most > 0),
u as (select row_number() over () as k, * from (select distinct vec_id, list_transform(e, lambda x: (x / sqrt(list_sum(list_transform(e, lambda y: y * y))))::float) as v from scaled)),
near as (select a.k as a, b.k as b, b.vec_id as id_b from u a join u b on a.k <> b.k and len(a.v) = len(b.v)
    where round(list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i]::double * b.v[i]::double)), 6) >= {COSINE}),
reach as (select k, k as at, vec_id as id from u union select r.k, n.b, n.id_b from reach r join near n on r.at = n.a)
select u.vec_id, min(r.id) as class_id, (select count(*) from near n where n.a = u.k) as links from u join reach r using (k) group by u.k, u.vec_id
"""
