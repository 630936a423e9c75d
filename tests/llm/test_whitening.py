"""Whitening against numpy's dense eigenvectors."""

import math

import numpy as np
import pytest

from spotweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x long, n long, i long"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in vectors], SCHEMA)


def brute(vectors, most=32):
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(kept), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    c = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return [i for i, _ in kept], n, deviation, c @ u / np.sqrt(e), e / (c * c).sum() * n


def compare(spark, vectors, most=32):
    ids, n, deviation, w, explained = brute(vectors, most)
    got = whitening.whiten(frame(spark, vectors).repartition(5), most)
    assert [f"{a} {b}".replace("bigint", "long") for a, b in got.dtypes] == whitening.SCHEMA.split(", ")
    got = got.toPandas()
    assert len(got) == w.size and (got["n"] == n).all() and (got["identity_error"] < 1e-6).all() and got["identity_error"].nunique() == 1
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.allclose(wide * np.sign((wide * w).sum(0)), w, atol=1e-7)
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert got.groupby("vec_id")["deviation"].first().loc[ids].tolist() == deviation.tolist()


def test_flat_spectrum_expands_to_the_full_dimension(spark):
    rng = np.random.default_rng(1)
    compare(spark, [(i, rng.standard_normal(60).tolist()) for i in range(300)])


def test_steep_spectrum_ends_with_few_columns(spark, monkeypatch):
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    rows = rng.standard_normal((400, 90)) * 40 * 0.5 ** np.arange(90) @ basis
    full = []
    eye = np.eye
    monkeypatch.setattr(whitening.np, "eye", lambda n: full.append(n) or eye(n))
    compare(spark, [(i, v.tolist()) for i, v in enumerate(rows)], 3)
    assert 90 not in full


def test_rows_that_take_no_part_ties_and_few_dimensions(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.standard_normal(7) * 3).tolist()) for i in range(50)]
    vectors += [(60, None), (61, [None] + [1.0] * 6), (62, [math.nan] + [1.0] * 6), (63, [math.inf] * 7), (64, vectors[3][1]), (65, vectors[3][1])]
    compare(spark, vectors)
    odd = [(70, []), (71, [1.0, 2.0]), (72, [1e38] * 7)]
    got = whitening.whiten(frame(spark, vectors + odd)).select("vec_id").distinct().collect()
    assert {r.vec_id for r in got} == {*range(50), 64, 65}


def test_tables_without_variance(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (None, [1.0, 3.0]), (3, [1.0, 2.0])])).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == [("1", 1), ("3", 1), ("None", 1)]


def test_deviations_are_exact_or_null():
    x = np.array([[10**6, 10**6 + 5], [10**6 + 3, 10**6 - 9]])
    n, sums = 2 * 10**9, (2 * 10**15 + 7, 2 * 10**15 - 11)
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening._deviations(x, n, sums) == [v if v < 2**63 else None for v in want]
    assert whitening._deviations(x, 3, (3 * 10**6 + 1, 3 * 10**6)) == [1 + 15**2, 8**2 + 27**2]


@pytest.mark.parametrize("dims", [1, 3])
def test_one_row(spark, dims):
    assert whitening.whiten(frame(spark, [(1, [0.5] * dims)])).count() == 0
