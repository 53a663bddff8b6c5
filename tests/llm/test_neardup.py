import duckdb
import numpy as np
import pytest

from ragloom.llm import neardup as N


def brute(rows, cosine=N.COSINE):
    """vec_id, class, links of (id, vector) rows by comparing all with all."""
    rows = [(i, np.array(v, float)) for i, v in {(i, tuple((np.array(v) / np.linalg.norm(v)).astype(np.float32).tolist())) for i, v in rows}]
    n = len(rows)
    near = [[i != j and len(rows[i][1]) == len(rows[j][1]) and round(float(rows[i][1] @ rows[j][1]), 6) >= cosine for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, open_ = {i}, [i]
        while open_:
            k = open_.pop()
            more = [j for j in range(n) if near[k][j] and j not in seen]
            seen.update(more)
            open_ += more
        out.append((rows[i][0], min(rows[j][0] for j in seen), sum(near[i])))
    return sorted(out)


def found(spark, rows, **options):
    out = N.near_duplicate_vectors(spark.createDataFrame([(i, list(map(float, v))) for i, v in rows], "vec_id long, embedding array<double>"), **options)
    return sorted((r.vec_id, r.class_id, r.links) for r in out.collect())


def planted(seed, n, dim):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    close = base[: n // 2] + 0.25 * rng.standard_normal((n // 2, dim)) * rng.random((n // 2, 1))
    chain = [base[0]]
    for _ in range(6):
        chain.append(chain[-1] + 0.2 * rng.standard_normal(dim))
    return [*base, *close, *chain, *base[:5] * 3, *base[:5]]


@pytest.mark.parametrize("width", [1.0, 2.0])
def test_recall_is_complete(spark, monkeypatch, width):
    monkeypatch.setattr(N, "WIDTH", width)
    rows = list(enumerate(planted(2, 120, 64)))
    want = brute(rows)
    assert found(spark, rows) == want and sum(w[2] for w in want) > 100 and len({w[1] for w in want}) < 150


def test_every_length_is_joined(spark):
    rows = [*enumerate(planted(4, 20, 16)), *enumerate(planted(5, 20, 7), 500), *enumerate(planted(6, 6, 1), 900)]
    want = brute(rows)
    assert found(spark, rows) == want and all(sum(w[2] for w in want if lo <= w[0] < lo + 400) > 10 for lo in (0, 500, 900))


def test_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 10)
    x = np.random.default_rng(1).standard_normal((5, 37)).astype(np.float32)
    assert np.allclose(N.rotated(x) @ N.rotated(x).T, x @ x.T, atol=1e-4)


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 7)
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16) + 0.05 * rng.standard_normal((60, 16))
    assert found(spark, list(enumerate(x))) == [(i, 0, 59) for i in range(60)]
    rows = list(enumerate(planted(7, 60, 16)))
    assert found(spark, rows, cosine=0.8) == brute(rows, 0.8)


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.standard_normal(4)) for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    v, w = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    rows = [(1, v), (1, v), (2, w), (3, None), (None, v), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [1.0, 0.0]), (10, [3e300, 0.0]), (8, []), (9, [float("inf"), 1.0, 0.0]), (11, [0.0, 1.0, 0.0]), (11, w)]
    table = spark.createDataFrame([(*r, 1.0, 2, 3, 4, 5) for r in rows], "vec_id long, embedding array<double>, norm double, key int, block int, v int, links int")
    out = sorted(tuple(r) for r in N.near_duplicate_vectors(table).collect())
    assert out == [(1, 1, 2), (2, 1, 2), (7, 7, 1), (10, 7, 1), (11, 1, 2), (11, 11, 0)]
    assert N.near_duplicate_vectors(table.where("false")).count() == 0


def test_the_sql(spark, tmp_path):
    rows = [(i, v.tolist()) for i, v in enumerate(planted(8, 40, 32))] + [(200, [1.0, 2.0]), (201, [1.0, 2.01]), (202, None), (None, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{tmp_path}/e/*.parquet'")
    want = sorted(con.execute(N.SQL).fetchall())
    got = sorted((r.vec_id, r.class_id, r.links) for r in N.near_duplicate_vectors(table).collect())
    assert got == want and sum(w[2] for w in want) > 20
