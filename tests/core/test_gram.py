import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_boxes import grown, leaf_of

from thicket.operators import forest as fo
from thicket.operators import gram as gr
from thicket.plans.chain import Gaussian, Settings


class Fixed:
    """Normal draws of 0 or 1."""

    def __init__(self, value):
        self.value = value

    def standard_normal(self, n):
        return np.full(n, self.value)


@pytest.mark.parametrize("depths", [(3,), (0, 2), (4, 1, 3)])
def test_as_from_a_dense_basis(spark, depths):
    deal = random.Random(len(depths))
    forest = [grown(deal, d, 2) for d in depths]
    rows = [(deal.uniform(-1, 2), deal.randrange(8) / 4, deal.gauss(0.1, 0.4)) for _ in range(300)] + [(0.0, 0.0, None)]
    g = gr.leaf_gram(spark.createDataFrame(rows, "a double, b double, y double").repartition(3), forest, [F.col("a"), F.col("b")], F.col("y"))
    basis = np.array([[leaf_of(forest[t], r[:2]) == k for t, k in g.columns] for r in rows[:-1]], dtype=float)
    y = np.array([r[2] for r in rows[:-1]])
    assert g.columns == [(t, k) for t, tree in enumerate(forest) for k in fo.leaves(tree)] and g.rows == 300
    assert (g.counts == basis.T @ basis).all() and g.sums == pytest.approx(basis.T @ y) and g.squares == pytest.approx(y @ y)
    dense = Gaussian(Settings(n_trees=len(forest)))
    assert gr.log_marginal_many(g, 0.3, dense.f_sigma2) == pytest.approx(dense.log_marginal_many(basis, y, 0.3))
    mean, var = gr.leaf_posterior_many(g, 0.3, dense.f_sigma2)
    assert mean == pytest.approx(dense.draw_many(Fixed(0.0), basis, y, 0.3))
    assert np.sqrt(var) == pytest.approx(dense.draw_many(Fixed(1.0), basis, y, 0.3) - mean)


def test_no_rows_and_too_many_leaves(spark, monkeypatch):
    df = spark.createDataFrame([], "a double, y double")
    tree = {0: fo.split(0, 0.5), 1: fo.leaf(0.0), 2: fo.leaf(0.0)}
    g = gr.leaf_gram(df, [tree], [F.col("a")], F.col("y"))
    assert gr.log_marginal_many(g, 0.3, 0.1) == 0 and gr.leaf_posterior_many(g, 0.3, 0.1)[1] == pytest.approx([0.1, 0.1])
    monkeypatch.setattr(gr, "MOST_LEAVES", 1)
    with pytest.raises(ValueError):
        gr.leaf_gram(df, [tree], [F.col("a")], F.col("y"))
