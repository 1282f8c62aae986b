"""Least squares on factors against numpy, in the order of its terms."""

import numpy as np
import pytest

from pollweave.operators.impute import regression_summary
from pollweave.operators.regression import fit_factors, with_prediction


def rows(n=400):
    dice = np.random.default_rng(9)
    out = []
    for k in range(n):
        f, g, x, z = f"f{dice.integers(12)}", f"g{dice.integers(3)}", float(dice.normal(1e4)), float(dice.normal())
        y = 3 * x - z + int(f[1:]) + (5 if g == "g2" else 0) + float(dice.normal())
        out.append((k, None if k % 50 == 1 else f, g, x, None if k % 60 == 2 else z, None if k % 9 == 0 else y))
    return out


def design(data, f_first=False):
    """Columns in order as R names them, and the complete rows."""
    known = [r for r in data if None not in r]
    f, g = sorted({r[1] for r in known}), sorted({r[2] for r in known})
    names = ["(intercept)", "x", "z", *[f"f{v}" for v in f[1:]], *[f"g{v}" for v in g[1:]]]
    x = np.array([[1, r[3] - 1e4, r[4], *[r[1] == v for v in f[1:]], *[r[2] == v for v in g[1:]]] for r in known], float)
    return names, x, np.array([r[5] for r in known]), known


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "id INT, f STRING, g STRING, x DOUBLE, z DOUBLE, y DOUBLE").repartition(5)


def test_estimates_and_errors_equal_numpy(data):
    names, x, y, _ = design(rows())
    beta, (rss,), rank, _ = np.linalg.lstsq(x, y, rcond=None)
    covariance = np.linalg.inv(x.T @ x) * rss / (len(y) - rank)
    turn = np.eye(len(names))
    turn[0, 1] = -1e4  # numpy's x is centred
    beta, covariance = turn @ beta, turn @ covariance @ turn.T
    found = regression_summary(data, "y", ["x", "z"], ["f", "g"]).collect()
    assert [r.term for r in found] == names and found[0].n == len(y)
    for r, b, e in zip(found, beta, np.sqrt(np.diag(covariance))):
        assert (r.estimate, r.std_error) == (pytest.approx(b, rel=1e-6, abs=1e-6), pytest.approx(e, rel=1e-6)), r.term
        assert r.sigma == pytest.approx(np.sqrt(rss / (len(y) - rank))) and r.r2 == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum())


def test_terms_that_depend_on_earlier_ones_drop_out(data):
    odd = data.selectExpr("*", "2 * x - z + 7 AS mix", "3.0D AS constant", "f AS same")
    found = {r.term: r.estimate for r in regression_summary(odd, "y", ["x", "z", "mix", "constant"], ["f", "g", "same"]).collect()}
    plain = {r.term: r.estimate for r in regression_summary(data, "y", ["x", "z"], ["f", "g"]).collect()}
    dropped = {term for term, value in found.items() if value is None}
    assert dropped == {"mix", "constant", *[term for term in found if term.startswith("same")]}
    assert all(found[term] == pytest.approx(value, rel=1e-6, abs=1e-5) for term, value in plain.items())
    model = fit_factors(odd, "y", ["x", "z", "mix", "constant"], ["f", "g", "same"])
    one = {r.id: r.p for r in with_prediction(odd, model, "p").collect()}
    two = {r.id: r.p for r in with_prediction(data, fit_factors(data, "y", ["x", "z"], ["f", "g"]), "p").collect()}
    assert one.keys() == two.keys() and all((one[k] is None and two[k] is None) or one[k] == pytest.approx(two[k], rel=1e-8) for k in one)


def test_an_absorbed_factor_gives_the_same_model(data):
    whole, absorbed = fit_factors(data, "y", ["x", "z"], ["g", "f"]), fit_factors(data, "y", ["x", "z"], ["g", "f"], max_terms=5)
    assert whole.absorbed is None and absorbed.absorbed == "f"
    for name in ("r2", "sigma", "n"):
        assert getattr(absorbed, name) == pytest.approx(getattr(whole, name), rel=1e-9)
    known = {term: (estimate, error) for term, estimate, error in whole.terms}
    assert [t for t, *_ in absorbed.terms] == ["x", "z", "gg1", "gg2"]
    for term, estimate, error in absorbed.terms:
        assert known[term] == (pytest.approx(estimate, rel=1e-6, abs=1e-6), pytest.approx(error, rel=1e-6))
    one, two = ({r.id: r.p for r in with_prediction(data, m, "p").collect()} for m in (whole, absorbed))
    assert sum(p is None for p in one.values()) == sum(r[1] is None or r[4] is None for r in rows())
    assert all((one[k] is None) == (two[k] is None) and (one[k] is None or one[k] == pytest.approx(two[k], rel=1e-9)) for k in one)
    with pytest.raises(ValueError):
        fit_factors(data, "y", ["x"], ["g", "f"], max_terms=2)
    # A predictor that is constant within the absorbed labels depends on them.
    inner = fit_factors(data.selectExpr("*", "length(f) * 1.0D AS w"), "y", ["w", "x"], ["f"], max_terms=5)
    assert inner.terms[0] == ("w", None, None) and inner.terms[1][1] is not None


def test_without_complete_rows(spark, data):
    none = data.where("y IS NULL")
    model = fit_factors(none, "y", ["x"], ["f"])
    assert model.n == 0 and with_prediction(none, model, "p").where("p IS NOT NULL").count() == 0
    one = spark.createDataFrame([(1.0, 2.0, "a"), (None, 5.0, "a")], "y DOUBLE, x DOUBLE, f STRING")
    single = fit_factors(one, "y", ["x"], ["f"])
    assert single.terms[0][1] == pytest.approx(1.0) and single.terms[1][1] is None and np.isnan(single.sigma)
