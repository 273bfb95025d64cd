import numpy as np
import pytest

from waymark.llm.queries import QUERIES
from waymark.llm.whitening import refined, whitened


def rows_of(df):
    return {(r["vec_id"], r["component"]): r for r in df.collect()}


def test_query_against_numpy(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = QUERIES["op12_whitening"](spark, sf).toPandas()
    ids = [r["vec_id"] for r in table]
    x = np.floor(64 * np.array([r["embedding"] for r in table], np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * 32 and set(got["n"]) == {n}
    deviation = dict(zip(ids, ((n * x - sums) ** 2).sum(axis=1).tolist()))
    assert (got["deviation"] == got["vec_id"].map(deviation)).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = centred @ vectors[:, :32] / np.sqrt(values[:32])
    sign = np.sign((wide * want).sum(axis=0))
    assert np.abs(wide * sign - want).max() < 1e-9
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, values[:32] / np.trace(v), rtol=1e-10)
    error = got["identity_error"].unique()
    assert len(error) == 1 and np.abs(wide.T @ wide / n - np.eye(32)).max() <= 1e-9 and error[0] < 1e-9


@pytest.mark.parametrize("gaps", [[3, 2, 1], [5, 1 + 1e-9, 1, 1 - 1e-9, 1e-3], [2, 2, 2, 1, 1], [1, 1e-7, 1e-12], [7, 1 + 1e-12, 1, 1e-5, 1e-5]])
def test_refinement_of_clustered_eigenvalues(gaps):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(24, 24)))
    truth = np.concatenate([gaps, np.linspace(0.5, 0.1, 24 - len(gaps))])
    a = (q * truth) @ q.T
    a = (a + a.T) / 2
    values, x = refined(a)
    eps = np.finfo(float).eps
    assert np.all(np.diff(values) <= 0) and np.abs(values - np.sort(truth)[::-1]).max() < 20 * eps * truth.max()
    assert np.abs(x.T @ x - np.eye(24)).max() < 8 * eps
    assert np.abs(a @ x - x * values).max() < 8 * eps * truth.max()
    _, plain = np.linalg.eigh(a.astype(np.float32))
    assert np.abs(a @ plain[:, ::-1] - plain[:, ::-1] * values).max() > 1e-9  # float32 alone is far from it


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -1.0, 3.0]), (1, [0.5, -1.0, 3.0]), (None, [2.0, 0.25, 3.0]), (4, [-0.0078125, 1.0, 3.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 2.0]), (9, [1.0, inf, 2.0]), (10, [1.0, -inf, 2.0]), (11, [1.0, 2.0]), (12, [1e300, 0.0, 0.0])]
    table = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as component", "'x' as whitened", "2 as id", "3 as v")
    got = whitened(table).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), c) for i, _ in good for c in (1, 2, 3))
    assert {r["n"] for r in got} == {4}
    x = np.floor(64 * np.array([v for _, v in good])).astype(int) + 1_000_000
    want = {str(i): int(((4 * row - x.sum(axis=0)) ** 2).sum()) for (i, _), row in zip(good, x)}
    assert all(r["deviation"] == want[str(r["vec_id"])] for r in got)
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)  # the third dimension never varies
    assert {r["explained"] for r in got if r["component"] == 3} == {0.0} and got[0]["identity_error"] < 1e-9
    same = whitened(table.where("vec_id = 1")).collect()
    assert {(r["whitened"], r["identity_error"], r["deviation"]) for r in same} == {(None, None, 0)}
    assert whitened(table.where("vec_id > 90")).collect() == [] and whitened(table.where("vec_id in (5, 6)")).collect() == []


def test_large_sums_stay_exact(spark):
    table = spark.createDataFrame([(1, [2.0**40, 1.0]), (2, [-(2.0**40), 2.0]), (3, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    x = np.array([[64 * 2**40 + 10**6, 64 + 10**6], [-64 * 2**40 + 10**6, 128 + 10**6], [64 + 10**6, 128 + 10**6]], object)
    want = ((3 * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist()
    got = {r["vec_id"]: r["deviation"] for r in whitened(table).collect()}
    assert got == {i + 1: w if w < 2**63 else None for i, w in enumerate(want)}
