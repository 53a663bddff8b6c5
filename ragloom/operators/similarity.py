"""Vectors: similar pairs across documents and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.windows import REMEMBERED

#: Vectors in one block of the pair grid.
BLOCK = 2048
#: Rows of a side of a search in one group at most, and vectors that an eighth as many queries meet at once.
SIDE, TILE = 32_768, 4096


def _blocks(vectors: DataFrame) -> tuple[DataFrame, int]:
    n = max(1, -(-vectors.count() // BLOCK))
    return vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), n


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """vec_a, vec_b, similarity of all pairs vec_a < vec_b of different documents with at least that cosine.

    Exact: vectors (vec_id, doc_id, embedding, of unit length) are cut into blocks, and each unordered pair of blocks is one
    matrix product in one task, so the work is spread evenly and each task holds two blocks.
    """
    spread, n = _blocks(vectors)
    meets = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = spread.withColumn("other", meets)
    rows = rows.select("vec_id", "doc_id", "embedding", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        left, right = pdf[pdf["block"] == p], pdf[pdf["block"] == q]
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_a": [], "vec_b": [], "similarity": []})
        cosine = _matrix(left["embedding"]) @ _matrix(right["embedding"]).T
        i, j = np.nonzero(cosine >= least - 1e-9)
        a, b = left["vec_id"].to_numpy()[i], right["vec_id"].to_numpy()[j]
        keep = left["doc_id"].to_numpy()[i] != right["doc_id"].to_numpy()[j]
        keep &= (a < b) if p == q else (a != b)
        a, b, value = a[keep], b[keep], np.round(cosine[i, j][keep], 6)
        good = value >= least
        return pd.DataFrame({"vec_a": np.minimum(a, b)[good], "vec_b": np.maximum(a, b)[good], "similarity": value[good]})

    return rows.groupBy("p", "q").applyInPandas(run, "vec_a long, vec_b long, similarity double")


def top_pairs(vectors: DataFrame, least: float, n: int) -> DataFrame:
    """The n most similar pairs: the feature is the bound."""
    return similar_pairs(vectors, least).orderBy(F.desc("similarity"), "vec_a", "vec_b").limit(n)


def _spread(n: int) -> int:
    """Blocks of the sides of a search: six at least where there are rows for them, so that their pairs occupy all cores."""
    return max(1, -(-n // SIDE), min(6, -(-n // BLOCK)))


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, ids and cosines of the k nearest of v, which is met a tile at a time; only what may still be among the k is kept."""
    at, found, value = np.empty(0, np.int64), np.empty(0, ids.dtype), np.empty(0)
    floor = np.full(len(q), -np.inf)
    for begin in range(0, len(v), TILE):
        cosine = q @ v[begin : begin + TILE].astype(np.float64).T
        if not begin and cosine.shape[1] > k:
            floor = np.partition(cosine, -k, axis=1)[:, -k]
        i, j = np.nonzero(cosine >= floor[:, None] - 2e-6)  # more than rounding to six digits moves a cosine
        at, found, value = np.concatenate([at, i]), np.concatenate([found, ids[begin + j]]), np.concatenate([value, np.round(cosine[i, j], 6)])
        order = np.lexsort((found, -value, at))
        at, found, value = at[order], found[order], value[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last = place == k - 1
        floor[at[last]] = value[last]
        at, found, value = at[place < k], found[place < k], value[place < k]
    return at, found, value


def nearest(queries: DataFrame, vectors: DataFrame, k: int, sizes: tuple[int, int] | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank of the k nearest vectors of each query (query_id, embedding); ties by vec_id.

    Exact: both sides are cut into blocks, each pair of blocks is one group and gives its k best for each query; a window over k
    rows a block takes the best of those. A group holds two blocks and one tile of their product, however many rows there are.
    sizes: about how many queries and vectors there are, where counting them is as dear as computing them.
    """
    asks, has = sizes or (queries.count(), vectors.count())
    n, m = _spread(asks), _spread(has)
    block = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    asked = queries.select(block("query_id", n).alias("p"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "embedding").withColumn("q", every(m))
    held = vectors.select(block("vec_id", m).alias("q"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "embedding").withColumn("p", every(n))

    def run(group: pa.Table) -> pa.Table:
        q, v = group.filter(group["asks"]), group.filter(pc.invert(group["asks"]))
        parts = []
        if len(q) and len(v):
            ids, matrix, asking, sought = v["id"].to_numpy(), _rows(v["embedding"]), q["id"].to_numpy(), _rows(q["embedding"])
            for begin in range(0, len(q), TILE // 8):
                at, found, value = _best(sought[begin : begin + TILE // 8].astype(np.float64), ids, matrix, k)
                parts.append(pa.table({"query_id": asking[begin + at], "vec_id": found, "similarity": value}))
        return pa.concat_tables(parts) if parts else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})

    columns = ["p", "q", "asks", "id", "embedding"]
    found = held.select(columns).unionByName(asked.select(columns)).groupBy("p", "q").applyInArrow(run, "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def contradiction_candidates(vectors: DataFrame, least: float = 0.8, n: int = 50) -> DataFrame:
    """The pairs that a judge is asked about."""
    return top_pairs(vectors, least, n)


def hashed_embeddings(texts: DataFrame, dim: int = 64) -> DataFrame:
    """An offline stand-in for a model: unit vectors of hashed words; texts: chunk_id, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        memo: dict[str, int] = {}  # places of words, of those that count down after the others
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = text.lower().split()
                if len(memo) > REMEMBERED:
                    memo.clear()
                for w in set(words).difference(memo):
                    h = zlib.crc32(w.encode())
                    memo[w] = h % dim + (0 if h & (1 << 16) else dim)
                both = np.bincount([memo[w] for w in words], minlength=2 * dim) if words else np.zeros(2 * dim)
                v = (both[:dim] - both[dim:]).astype(float)
                norm = np.linalg.norm(v)
                out.append((v / norm if norm else v).astype(np.float32).tolist())
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "embedding": out})

    return texts.select("chunk_id", "text").mapInPandas(run, "chunk_id string, embedding array<float>")
