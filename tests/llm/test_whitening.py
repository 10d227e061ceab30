"""QDWH whitening against a dense eigensolver and whole-number arithmetic."""

import math

import numpy as np
import pytest

from lateline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, whitened string"


def plain(rows, components=16):
    """{vec_id: (n, deviation, whitened up to sign, explained)} of vectors of one length."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    grid = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in rows}
    fitted = sorted(set(grid.values()))
    n, sums = len(fitted), [sum(column) for column in zip(*fitted, strict=True)]
    mean = np.array([total / n for total in sums])
    centred = np.array(fitted, float) - mean
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    kept = int((values > 1e-12 * max(values[0], 1e-300)).sum())
    out = {}
    for i, x in grid.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        z = (np.array(x, float) - mean) @ vectors[:, :kept] / np.sqrt(values[:kept])
        out[i] = n, deviation, z, values[:kept] / np.trace(covariance)
    return out


def same(found, want):
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert {i for i, w in want.items() if len(w[2])} == set(by_id)
    signs = None
    for i, parts in by_id.items():
        n, deviation, z, explained = want[i]
        assert sorted(parts) == list(range(1, len(z) + 1))
        got = np.array([parts[c]["whitened"] for c in sorted(parts)])
        assert {(r["n"], r["deviation"]) for r in parts.values()} == {(n, deviation)}
        np.testing.assert_allclose([parts[c]["explained"] for c in sorted(parts)], explained, rtol=1e-9)
        np.testing.assert_allclose(np.abs(got), np.abs(z), atol=1e-7)
        if np.abs(z).min() > 0.05:  # the same sign for all rows
            signs = np.sign(got * z) if signs is None else signs
            assert (np.sign(got * z) == signs).all()
        assert all(r["identity_error"] < 1e-9 for r in parts.values())


@pytest.mark.parametrize("case", ["random", "clusters", "equal", "rank", "zero", "wide"])
def test_spectrum(case):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    values = {
        "random": rng.random(40),
        "clusters": np.repeat([5.0, 1.0, 1e-3, 1e-9], 10),
        "equal": np.ones(40),
        "rank": np.r_[rng.random(5), np.zeros(35)],
        "zero": np.zeros(40),
        "wide": np.logspace(8, -6, 40),
    }[case]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.spectrum(matrix)
    top = max(values.max(), 1e-300)
    np.testing.assert_allclose(found, np.sort(values)[::-1], atol=1e-13 * top)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(40), atol=1e-13)
    assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-12 * top


def test_polar_factor_is_the_sign():
    values = np.array([3.0, -2.0, 1e-6, -1e-6])
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((4, 4)))[0]
    sign = whitening.polar_factor((turn * values) @ turn.T)
    np.testing.assert_allclose(sign, (turn * np.sign(values)) @ turn.T, atol=1e-8)


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.standard_normal(6) * 0.2]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # copies count once
    rows += [(200, None), (201, [None] * 6), (202, [float("nan")] + [0.0] * 5), (203, [float("inf")] + [0.0] * 5), (204, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = whitening.query(spark, str(tmp_path)).collect()
    same(found, plain(rows))


def test_lengths_nulls_and_wide_entries(spark):
    rows = [(None, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [0.5]), (3, [0.5]), (4, []), (5, [3e12, 1.0]), (6, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    models = whitening.fit(df)
    assert {length: m.n for length, m in models.items()} == {1: 1, 2: 3}
    found = whitening.whiten(df, models).collect()
    # the second component of the pairs has less than the share _FLAT of the first
    assert sorted((str(r["vec_id"]), len(r["whitened"])) for r in found) == [("1", 1), ("1", 1), ("2", 0), ("3", 0), ("5", 1), ("None", 1)]
    assert {r["deviation"] for r in found if r["vec_id"] == 5} == {None}  # more than a long holds


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert whitening.query(spark, str(tmp_path)).collect() == []


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same(whitening.query(spark, sf).collect(), plain(rows))
