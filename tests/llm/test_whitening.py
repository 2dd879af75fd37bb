"""Spectrum slicing against numpy's eigenvalues, and whitening against a plain computation over all vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import queries, spectrum, whitening

DRAW = np.random.default_rng(8)


def turned(values):
    turn = np.linalg.qr(DRAW.standard_normal((len(values), len(values))))[0]
    found = turn @ np.diag(values) @ turn.T
    return (found + found.T) / 2


def test_counts():
    for size in (1, 2, 7, 30):
        matrix = turned(DRAW.standard_normal(size))
        for shift in DRAW.standard_normal(20):
            assert spectrum.count_above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()
    # Zero and antidiagonal pivots.
    assert spectrum.count_above(np.zeros((3, 3)), 0.0) == 0
    assert spectrum.count_above(np.array([[0.0, 2], [2, 0]]), 0.0) == 1


@pytest.mark.parametrize(
    "values",
    [[4.0], [3, 2, 1], np.exp(-np.arange(40) / 4), [5, 5, 5, 3, 3, 1, 0, 0], [2] * 12 + [1] * 9, 1 + np.arange(30) * 1e-9, [0, 0, 0], [7, 0, 0]],
)
def test_leading_pairs(values):
    matrix = turned(np.array(values, dtype=float))
    for most in (1, 2, 4, 32):
        found, vectors = spectrum.leading(matrix, most)
        expected = np.linalg.eigvalsh(matrix)[::-1]
        expected = expected[expected > 1e-12 * max(values)][:most]
        assert len(found) == len(expected)
        if len(found):
            assert np.abs(found - expected).max() < 1e-13 * max(values)
            assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
            assert np.abs(matrix @ vectors - vectors * found).max() < 1e-9 * max(values)


def plain(vectors, components=32):
    """(n, deviation of every vector, eigenvalues, directions, whitened) with Python's whole numbers and numpy's eigenvectors."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    return n, deviation, values, values / (centred**2).sum() * n, centred @ directions / np.sqrt(values)


def compare(found, vectors):
    n, deviation, values, explained, whitened = plain(list(vectors.values()))
    by_key = {}
    for r in found:
        by_key.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by_key) == set(vectors)
    signs = np.sign([by_key[k][c + 1]["whitened"] * whitened[i][c] for i, k in enumerate(vectors) for c in range(len(values))])
    signs = np.sign(signs.reshape(len(vectors), -1).sum(axis=0))
    for i, key in enumerate(vectors):
        assert len(by_key[key]) == len(values)
        for c in range(len(values)):
            r = by_key[key][c + 1]
            assert r["n"] == n and int(r["deviation"]) == deviation[i]
            assert abs(r["whitened"] - signs[c] * whitened[i][c]) < 1e-7
            assert abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_query_against_numpy(spark, data_dir):
    source = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    compare(queries.QUERIES["op11_whitening"](spark, data_dir).collect(), {r["vec_id"]: r["embedding"] for r in source.collect()})


def test_odd_vectors(spark):
    good = {i: [float(x) for x in DRAW.standard_normal(3) * (1, 5, 0.1)] for i in range(40)} | {41: [3e4, -7.0, 1.0]}
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [1.0, float("inf"), 2.0]), (104, [1.0, 2.0]), (105, [])]
    schema = "vec_id long, embedding array<float>, whitened int, n int, component int"
    rows = [(k, v, 1, 2, 3) for k, v in [*good.items(), *bad]]
    df = spark.createDataFrame(rows, schema).repartition(5)
    as_float = {k: [float(np.float32(x)) for x in v] for k, v in good.items()}
    compare(whitening.whiten(df).collect(), as_float)
    # All rows twice, and a null id.
    twice = whitening.whiten(df.union(df)).where("component = 1").groupBy("vec_id").count().collect()
    assert {r["vec_id"]: r["count"] for r in twice} == dict.fromkeys(good, 2)
    unnamed = whitening.whiten(df.withColumn("vec_id", F.when(F.col("vec_id") > 0, F.col("vec_id"))))
    assert unnamed.where("vec_id is null").count() == 3
    assert whitening.whiten(df.limit(0)).count() == whitening.whiten(df.where("vec_id > 99")).count() == 0
    assert whitening.whiten(df.where("vec_id = 1").union(df.where("vec_id = 1"))).count() == 0
    # Zero variance in one dimension: one component fewer.
    flat = df.where("vec_id < 50").withColumn("embedding", F.transform("embedding", lambda c, i: F.when(i == 1, 2.0).otherwise(c)))
    assert whitening.whiten(flat).agg(F.max("component")).first()[0] == 2


def test_wide_entries_are_exact(spark):
    vectors = {i: [float(np.float32(x)) for x in (3e9 * i, 1.5 * i * i, -2e7 + i)] for i in range(6)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    n, deviation, *_ = plain(list(vectors.values()))
    found = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df).where("component = 1").collect()}
    assert found == dict(zip(vectors, deviation))
    x = DRAW.integers(-(1 << 45), 1 << 45, (9, 3))
    x[2:5] >>= 30
    high, low = whitening.products(x)
    exact = x.astype(object).T @ x.astype(object)
    assert (high.astype(object) * (1 << 32) + low == exact).all()
