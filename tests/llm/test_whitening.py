import math

import numpy as np
import pytest

from pollweave.llm import whitening
from pollweave.llm.queries import QUERIES

from .helpers import FOLDER


def brute(rows, components, scale=256):
    x = [(vec_id, [math.floor(scale * float(c)) for c in v]) for vec_id, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), float)
    n, sums = len(fit), [sum(int(c) for c in column) for column in fit.T]
    centred = fit - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    exact = [(vec_id, sum((n * c - s) ** 2 for c, s in zip(v, sums)), (np.array(v) - np.array(sums) / n) @ vectors / np.sqrt(values)) for vec_id, v in x]
    return n, exact, values / (centred**2).sum() * n


def check(found, rows, components, close=1e-7):
    n, want, explained = brute(rows, components)
    got = {}
    for r in found:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == components * len(rows) and set(got) == {vec_id for vec_id, _ in rows}
    signs = np.ones(components)
    for k in range(components):
        pairs = np.array([(got[vec_id][k + 1].whitened, z[k]) for vec_id, _, z in want])
        signs[k] = np.sign((pairs[:, 0] * pairs[:, 1]).sum())
        assert np.abs(pairs[:, 0] - signs[k] * pairs[:, 1]).max() < close
    for vec_id, deviation, _ in want:
        for k in range(components):
            r = got[vec_id][k + 1]
            assert r.n == n and int(r.deviation) == deviation and abs(r.explained / explained[k] - 1) < 1e-10 and r.identity_error < 1e-9


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_query_against_a_full_decomposition(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    check(QUERIES["op11_embedding_whitening"](spark, folder).collect(), rows, 4)


def test_pairs_of_hard_spectra():
    dice = np.random.default_rng(1)
    for spectrum in (
        np.r_[5.0, 5.0, 5.0, 5.0, np.linspace(4, 0, 60)],  # one eigenvalue four times
        np.linspace(1, 1.01, 200),  # crowded
        np.r_[1e6, 1.0, 1e-3, np.zeros(50)],  # far apart, singular
        np.geomspace(1, 1e-8, 300),
        np.zeros(9),
        np.array([3.0, 1.0]),
    ):
        d = len(spectrum)
        turn, _ = np.linalg.qr(dice.standard_normal((d, d)))
        matrix = (turn * spectrum) @ turn.T
        matrix, passes = (matrix + matrix.T) / 2, []
        values, vectors = whitening.leading_pairs(lambda b: passes.append(b.shape[1]) or matrix @ b, d, 4)
        k = min(4, d)
        top = max(spectrum.max(), 1e-300)
        assert np.allclose(values, np.sort(spectrum)[::-1][:k], rtol=0, atol=1e-12 * top)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() <= 1e-12 * top
        assert len(passes) < 400, len(passes)


def test_minres_solves():
    dice = np.random.default_rng(2)
    matrix = dice.standard_normal((30, 30))
    matrix, b = matrix + matrix.T, dice.standard_normal(30)
    x = whitening.corrections(lambda v: matrix @ v, np.zeros((30, 0)), np.zeros(1), -b[:, None], 200, 1e-12)[:, 0]
    assert np.linalg.norm(matrix @ x - b) < 1e-8


def test_awkward_rows(spark, monkeypatch):
    dice = np.random.default_rng(4)
    good = [(k, [float(c) for c in dice.standard_normal(6) * [9, 5, 3, 2, 1, 0.1]]) for k in range(80)]
    good += [(100 + k, good[0][1]) for k in range(40)]  # copies count once in the fit
    bad = [(200, None), (201, [1.0] * 5), (202, [1.0] * 7), (203, []), (204, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (205, [float("nan")] * 6), (206, [float("-inf")] + [0.0] * 5)]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS component", "'x' AS x", "'v' AS vector").repartition(5)
    for components in (4, 6):
        check(whitening.whiten(frame, components=components).collect(), good, components)
    monkeypatch.setattr(whitening, "MOST_PARTIALS", 1)
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 30)
    check(whitening.whiten(frame).collect(), good, 4)
    twice = whitening.whiten(frame.union(frame)).collect()
    assert len(twice) == 8 * len(good)
    # Three dimensions vary, so there are three components.
    flat = spark.createDataFrame([(k, v[:3] + [0.0, -0.0, 1.0]) for k, v in good] + [(None, [0.0] * 5 + [1.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(flat).collect()
    assert {r.component for r in rows} == {1, 2, 3} and sum(r.vec_id is None for r in rows) == 3


def test_nothing_varies(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_deviations_are_exact():
    dice = np.random.default_rng(5)
    for high in (1000, 2**27, 2**62):
        x = dice.integers(-high, high, (20, 7))
        sums = [int(s) for s in x.astype(object).sum(axis=0)]
        assert whitening.deviations(x, 20, sums) == [sum((20 * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]


def test_huge_entries(spark):
    rows = [(k, [float(c), 1e300 if k == 3 else 0.5 * k]) for k, c in enumerate([1, 2, 3, 4, 5])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()
    assert len(found) == 5 and all(math.isfinite(r.whitened) for r in found)
