"""Spectra against a dense solver, dimensions against plain sums."""

import numpy as np
import pytest

from weftline.operators import spectra


def frame(spark, x):
    return spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)


@pytest.mark.parametrize(("rows", "width", "kind"), [(200, 40, "flat"), (60, 300, "flat"), (400, 90, "steep"), (5, 20, "flat"), (50, 3, "flat"), (80, 30, "same")])
def test_top_eigenvalues_equal_a_dense_solver(spark, rows, width, kind):
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(rows, width)) + rng.normal(size=width)
    if kind == "steep":
        x *= 0.8 ** np.arange(width)
    if kind == "same":
        x[:] = x[0]
    got = [r.eigenvalue for r in spectra.top_eigenvalues(frame(spark, x), side=32, cells=32 * 32 * 7).orderBy("rank").collect()]  # several passes
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:16]
    assert len(got) == min(16, width) and got == pytest.approx(np.maximum(want, 0), rel=1e-7, abs=1e-8)


def test_no_spectrum_of_too_few_rows(spark):
    assert spectra.top_eigenvalues(frame(spark, np.zeros((0, 4)))).count() == 0 and spectra.top_eigenvalues(frame(spark, np.ones((1, 4)))).count() == 0
    assert spectra.top_eigenvalues(spark.createDataFrame([(None,), ([1.0, 2.0],), ([3.0, 2.0],)], "v array<double>")).first().eigenvalue == pytest.approx(2)


def test_associations_and_stable_dimensions(spark):
    rng = np.random.default_rng(3)
    labels, splits = rng.integers(0, 3, 300), rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 6))
    x[:, 2] += labels * 3
    x[:, 4] = 1.0
    x[:, 5] += labels * (splits == 0)
    rows = [(r.tolist(), f"l{a}", f"s{b}") for r, a, b in zip(x, labels, splits, strict=True)] + [(x[0].tolist(), None, "s0")]
    df = spark.createDataFrame(rows, "v array<double>, label string, split string")
    got = {(r.split, r.dim): r for r in spectra.dimension_associations(df, by="split").collect()}
    for s in (0, 1):
        own, lab = x[splits == s], labels[splits == s]
        for k in range(6):
            c = own[:, k]
            whole = ((c - c.mean()) ** 2).sum()
            between = sum((lab == v).sum() * (c[lab == v].mean() - c.mean()) ** 2 for v in range(3))
            r = got[f"s{s}", k]
            assert r.eta_squared == pytest.approx(between / whole if whole > 1e-12 else 0, abs=1e-8)
            assert r.dominant_label == max((c[lab == v].mean(), f"l{v}") for v in range(3))[1]
    assert got["s0", 2].rank == got["s1", 2].rank == 1 and got["s0", 4].rank == 6 and got["s0", 4].dominant_label == "l2"
    top = spectra.dimension_associations(df, by="split", top=2)
    sets = [{r.dim for r in top.where(f"split = 's{s}'").collect()} for s in (0, 1)]
    assert {r.dim for r in spectra.stable_dimensions(top, "split").collect()} == sets[0] & sets[1] and 2 in sets[0] & sets[1]
