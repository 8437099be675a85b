"""Codes against comparing everything, in plain integers."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from obsmat.llm import queries
from obsmat.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(float(np.float32(c)) * scale) for c in v], l) for i, v, l in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    x = np.array([r[1] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    near = lambda: np.stack([((x[:, p, None, :] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)
    for _ in range(rounds):
        at = near()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (mine := at[:, p] == e).any():
                    books[p, e] = x[mine, p].sum(0) // mine.sum()
    at = near()
    error = sum(((x[:, p] - books[p][at[:, p]]) ** 2).sum(1) for p in range(parts))
    by: dict = {}
    for (_, _, l), e in zip(kept, error.tolist(), strict=True):
        by[l] = by.get(l, 0) + e
    return sorted(((r[0], "".join(f"{e:02x}" for e in a), e, by[r[2]], vc.hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()) for r, a, e in zip(kept, at.tolist(), error.tolist(), strict=True)), key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("v", "near", "upper", "lower", "code", "error", "_label", "_salt", "slot"):
        df = df.withColumn(name, F.lit("clash"))
    return sorted(map(tuple, vc.compress(df.repartition(5), **how).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_random_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(0, 0.12, 16).tolist(), int(i) % 7 if i % 11 else None) for i in rng.permutation(900)]
    assert got(spark, rows) == brute(rows)


def test_ties_copies_and_odd_rows(spark):
    """Few different values: many equal entries and equal distances."""
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.integers(-2, 3, 8) / 1024).tolist(), 0 if i % 3 else None) for i in range(700)]
    rows += rows[:40] + [(None, [0.5] * 8, 4), (None, [-0.5] * 8, None), (-3, [math.nan] + [0.0] * 7, 1), (5, [math.inf] + [0.0] * 7, 1), (6, [-math.inf] * 8, 1), (8, None, 2), (9, [], 2), (10, [None] * 8, 2), (11, [1.0, None] * 4, 2), (12, [-0.00001] * 8, 3)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 3, 255])
def test_fewer_rows_than_entries(spark, n):
    rows = [(i, [float((i * k) % 5) for k in range(8)], 1) for i in range(n)]
    assert got(spark, rows) == brute(rows)


def test_large_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 8) * 10.0 ** rng.integers(0, 6)).tolist(), i % 2) for i in range(400)]
    assert got(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        got(spark, [(1, [1e30] * 8, 1)])
    with pytest.raises(ValueError):
        got(spark, [(1, [1.0] * 6, 1)])


def test_empty_tables(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 2)]) == []


def test_many_labels_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vc, "LABELS", 1)
    rows = [(i, [float(i % 9), float(i % 4)] * 2, i % 3 if i % 5 else None) for i in range(300)]
    assert got(spark, rows) == brute(rows)


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 200, (64, 16))
    x = (centres[rng.integers(0, 64, 4000)] + rng.normal(0, 25, (4000, 16))).astype(np.int64)
    books = x[:64].copy()
    near, upper, lower = vc.first_bounds(x, books)
    worked = []
    for _ in range(8):
        old = books
        books = np.array([x[near == e].sum(0) // max(1, (near == e).sum()) if (near == e).any() else books[e] for e in range(64)])
        moved, apart = vc.root_up(((books - old) ** 2).sum(1)), vc.root_down(vc.all_squares(books, books))
        near, upper, lower, n = vc.next_bounds(x, books, moved, apart, near.copy(), upper, lower)
        worked.append(n)
        d = ((x[:, None] - books[None]) ** 2).sum(2)
        assert (near == d.argmin(1)).all() and (upper.astype(float) ** 2 >= d[np.arange(len(x)), near]).all() and (lower.astype(float) ** 2 <= d).all()
    assert worked[-1] < 0.1 * 64 * len(x)


def test_roots():
    s = np.array([0, 1, 2, 3, 4, 8, 9, 10, (1 << 52) - 1, 1 << 52, (1 << 52) + 1, (1 << 62) - 1, (1 << 31) ** 2 - 2**32, 2147483647**2], np.int64)
    assert vc.root_down(s).tolist() == [math.isqrt(int(v)) for v in s]
    assert vc.root_up(s[:-1]).tolist() == [math.isqrt(int(v) - 1) + 1 if v else 0 for v in s[:-1]]


def test_sql_gives_the_same(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(0, 0.12, 8).tolist(), int(i) % 4 if i % 5 else None) for i in range(420)] + [(900, None, 1), (901, [math.nan] * 8, 1), (902, [None] * 8, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    mine = sorted(map(tuple, queries.op11_vector_codes(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    theirs = con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.oracle_sql()['op11_vector_codes']})").fetchall()
    assert mine == sorted(theirs, key=str) == brute(rows)
