"""Scoring rows by saved trees (A9): chunks across models, missing values, many rows a task."""

import numpy as np

from daygrain.operators import tree_jobs, trees as tr
from daygrain.operators.tree_jobs import TREE_COLUMNS


def _tree(rng, depth, width):
    """A full tree of random splits."""
    splits, value = {}, {}
    for p in range(1, 2**depth):
        splits[p] = (int(rng.integers(width)), round(float(rng.normal()), 1), bool(rng.integers(2)))
    for p in range(2**depth, 2**(depth + 1)):
        value[p] = float(rng.normal())
    nodes, rows = [(1, None, 0)], []
    while nodes:
        p, parent, side = nodes.pop()
        if parent is not None:
            rows[parent][side] = len(rows)
        if p in splits:
            nodes += [(2 * p + 1, len(rows), 5), (2 * p, len(rows), 4)]
            f, t, left = splits[p]
            rows.append([f, 0, t, left, 0, 0, 0.0])
        else:
            rows.append([-1, 0, 0.0, False, 0, 0, value[p]])
    return tr.Tree(*[np.array(c) for c in zip(*rows)])


def test_saved_trees_are_scored_together_in_chunks(spark, monkeypatch):
    """All models' trees in a few chunks, none of them row by row through the driver; the sums are those of the trees one by one."""
    monkeypatch.setattr(tree_jobs, "CHUNK_NODES", 100)
    rng = np.random.default_rng(5)
    trees = [(spec, t, _tree(rng, 1 + (spec + t) % 5, 3)) for spec in range(3) for t in range(6)]
    x = rng.normal(size=(200, 3)).round(1)
    x[rng.random(x.shape) < 0.2] = np.nan
    saved = spark.createDataFrame([(s, t, *[getattr(one, c).tolist() for c in TREE_COLUMNS]) for s, t, one in trees],
                                  f"spec int, tree int, {tree_jobs.TREE_SCHEMA}")
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "key long, x array<double>")
    iterated = []
    monkeypatch.setattr(type(saved), "toLocalIterator", lambda *a, **k: iterated.append(1))
    got = {(r["spec"], r["key"]): r["total"] for r in tree_jobs.score_many(rows, saved, 3).collect()}
    assert not iterated and len(got) == 3 * 200
    for spec in range(3):
        want = sum(one.leaf_values(x) for s, _, one in trees if s == spec)
        assert max(abs(got[spec, i] - v) for i, v in enumerate(want)) < 1e-12
    assert tree_jobs.score_many(rows, saved.where("spec < 0"), 3) is None


def test_missing_values_of_a_saved_forest_go_where_their_median_went():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)).round(1)
    x[rng.random(x.shape) < 0.2] = np.nan
    values = [np.unique(c[~np.isnan(c)]) for c in x.T]
    from daygrain.operators import coding
    layout = coding.Layout(["a", "b", "c"], [v[:-1] / 2 + v[1:] / 2 for v in values], values, np.ones(3, bool))
    codes, y = layout.code(x), (rng.random(400) < 0.5).astype(float)
    medians = np.array([len(v) // 2 for v in values])
    filled = tree_jobs.imputed(codes, layout, medians)
    tree, pred = tr.random_tree(filled, y, np.ones(400, np.int64), np.arange(400), tr.root_name(1, 1), layout, {"min_rows": 4, "column_share": 0.65}, np.ones(2))
    assert (tree_jobs._medians_side(tree, medians).leaf_values(x) == pred).all()
