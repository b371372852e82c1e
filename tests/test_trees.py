"""Tree fits: splits against an exhaustive search, both ways of fitting against each other, fold statistics against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrain.constants import MODEL_PROFILES
from daygrain.operators import coding, train, tree_jobs, trees as tr

GROWTHS = {"leaf": {"growth": "leaf", "trees": 4, "step": 0.3, "leaves": 7, "min_rows": 3, "min_hessian": 1e-3, "l1": 0.08, "l2": 2.5},
           "level": {"growth": "level", "trees": 4, "step": 0.3, "depth": 3, "min_hessian": 1.5, "l1": 0.05, "l2": 2.0},
           "symmetric": {"growth": "symmetric", "trees": 4, "step": 0.3, "depth": 3, "l2": 6.0}}


def _data(n=300, seed=0, missing=0.1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n, 2)).round(1), rng.integers(0, 2, (n, 1)), rng.integers(0, 5, (n, 1)), np.full((n, 1), 3.0)], axis=1)
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0] * 2 - x[:, 3] * (x[:, 2] - 0.5)))).astype(float)
    x[rng.random(x.shape) < missing] = np.nan
    x[:, 4] = np.where(rng.random(n) < 0.2, np.nan, 3.0)
    return x, y


def _layout(x):
    values = [np.unique(c[~np.isnan(c)]) for c in x.T]
    return coding.Layout([f"f{i}" for i in range(x.shape[1])], [v[:-1] / 2 + v[1:] / 2 for v in values], values, np.ones(x.shape[1], bool))


def _fit(profile, x, y, ahead=False):
    layout = _layout(x)
    codes = layout.code(x)
    flat = (codes + layout.offset).astype(np.int32)
    scale, base = tr.fixed_scale(len(y)), float(np.log(y.mean() / (1 - y.mean())))
    model, margin = tr.Boosted(profile, layout, 1, scale, base, ahead), np.full(len(y), base)
    while model.wanted:
        pair, cells, number = tr.gradients(margin, y, scale), tr.Cells(codes, layout.bins, np.arange(len(y))), model.number
        while model.wanted and model.number == number:
            model.receive({p: tr.histogram(flat, cells.of(p, model.splits), pair, layout.size) for p in model.wanted})
        tr.add_tree(margin, codes, layout, *model.done, model.symmetric)
    return model, margin


# -- an exhaustive search over raw values, without bins or histograms
def _soft(g, l1):
    return np.sign(g) * max(abs(g) - l1, 0.0)


def _score(g, h, p):
    return _soft(g, p.get("l1", 0.0)) ** 2 / (h + p["l2"])


def _sides(x, f, cut, missing_left):
    v = x[:, f]
    return np.where(np.isnan(v), missing_left, v <= cut)


def _candidates(x, f):
    v = np.unique(x[:, f][~np.isnan(x[:, f])])
    return [*(v[:-1] / 2 + v[1:] / 2), np.inf]


def _gain(x, g, h, f, cut, missing_left, p, bounded=True):
    left = _sides(x, f, cut, missing_left)
    sums = [(g[s].sum(), h[s].sum(), s.sum()) for s in (left, ~left)]
    if bounded and any(n < max(1, p.get("min_rows", 1)) or hh < p.get("min_hessian", 0.0) for _, hh, n in sums):
        return -np.inf
    return sum(_score(gg, hh, p) for gg, hh, _ in sums) - _score(g.sum(), h.sum(), p)


def _best(x, g, h, p):
    return max((_gain(x, g, h, f, c, m, p) for f in range(x.shape[1]) for c in _candidates(x, f) for m in (False, True)), default=-np.inf)


def _check_tree(tree, x, g, h, p):
    """Every split of the tree has the largest gain there is at its node (or level); leaves have the regularised value."""
    inside = {0: np.ones(len(g), bool)}
    depth = {0: 0}
    for node in range(len(tree.feature)):
        own = inside[node]
        if tree.feature[node] < 0:
            assert tree.value[node] == pytest.approx(-p["step"] * _soft(g[own].sum(), p.get("l1", 0.0)) / (h[own].sum() + p["l2"]), rel=1e-6, abs=1e-9)
            continue
        left = _sides(x, tree.feature[node], tree.threshold[node], tree.missing_left[node])
        inside[tree.left[node]], inside[tree.right[node]] = own & left, own & ~left
        depth[tree.left[node]] = depth[tree.right[node]] = depth[node] + 1
    inner = [n for n in range(len(tree.feature)) if tree.feature[n] >= 0]
    said = lambda n, own, bounded=True: _gain(x[own], g[own], h[own], tree.feature[n], tree.threshold[n], tree.missing_left[n], p, bounded)
    if p["growth"] == "symmetric":
        for d in {depth[n] for n in inner}:
            level = [n for n in inner if depth[n] == d]
            assert len(level) == 2**d and len({(tree.feature[n], tree.threshold[n], tree.missing_left[n]) for n in level}) == 1
            sums = [sum(_gain(x[inside[n]], g[inside[n]], h[inside[n]], f, c, m, p, False) for n in level)
                    for f in range(x.shape[1]) for c in _candidates(x, f) for m in (False, True)]
            assert sum(said(n, inside[n], False) for n in level) == pytest.approx(max(sums), rel=1e-6, abs=1e-7)
        return
    gains = {n: said(n, inside[n]) for n in inner}
    for n in inner:
        assert gains[n] == pytest.approx(_best(x[inside[n]], g[inside[n]], h[inside[n]], p), rel=1e-6, abs=1e-7) and gains[n] > 0
    leaves = [n for n in inside if tree.feature[n] < 0]
    if p["growth"] == "leaf":
        assert len(leaves) <= p["leaves"]
        if len(leaves) == p["leaves"]:  # best first: no leaf would have gained more than the least split that nothing follows from
            last = min(gains[n] for n in inner if all(tree.feature[c] < 0 for c in (tree.left[n], tree.right[n])))
            assert all(_best(x[inside[n]], g[inside[n]], h[inside[n]], p) <= last + 1e-7 for n in leaves
                       if not any(n in (tree.left[k], tree.right[k]) and gains[k] == last for k in inner))
    else:
        assert all(depth[n] == p["depth"] or _best(x[inside[n]], g[inside[n]], h[inside[n]], p) <= 1e-7 for n in leaves)


@pytest.mark.parametrize("growth", GROWTHS)
def test_splits_equal_an_exhaustive_search(growth):
    x, y = _data()
    p = GROWTHS[growth]
    model, _ = _fit(p, x, y)
    margin = np.full(len(y), model.trees[0].value[0])
    for tree in model.trees[1:]:
        q = 1 / (1 + np.exp(-margin))
        _check_tree(tree, x, q - y, q * (1 - q), p)
        margin += tree.leaf_values(x)


@pytest.mark.parametrize("growth", GROWTHS)
def test_asking_ahead_grows_the_same_trees(growth):
    x, y = _data(500, 3)
    (a, ma), (b, mb) = _fit(GROWTHS[growth], x, y), _fit(GROWTHS[growth], x, y, ahead=True)
    assert (ma == mb).all() and len(a.trees) == len(b.trees) == 5
    assert all((s.feature == t.feature).all() and (s.threshold == t.threshold).all() for s, t in zip(a.trees, b.trees))


def test_trees_draw_rows_and_columns():
    x, y = _data(400, 5)
    layout, p = _layout(x), {**GROWTHS["level"], "column_share": 0.4, "row_share": 0.5}
    model = tr.Boosted(p, layout, 3, 1.0, 0.0)
    h = tr.mix(np.arange(20_000))
    assert model.columns.sum() == 2 and abs(model.sampled(h).mean() - 0.5) < 0.02
    assert (tr.Boosted.sample(h, p, 3, 1) != tr.Boosted.sample(h, p, 3, 2)).any()
    assert {tuple(tr.Boosted(p, layout, s, 1.0, 0.0).columns) for s in range(20)} > {tuple(model.columns)}


# -- extremely randomised trees
def _random(x, y, seed, number, min_rows=4):
    layout = _layout(x)
    codes = np.where(np.isnan(x), 0, layout.code(x)).astype(np.uint8)
    drawn = tr.bootstrap(tr.mix(np.arange(len(y))), seed, number)
    weight = tr.class_weights(float((drawn * y).sum()), float((drawn * (1 - y)).sum()))
    tree, pred = tr.random_tree(codes, y, drawn, np.arange(len(y)), tr.root_name(seed, number), layout, {"min_rows": min_rows, "column_share": 0.65}, weight)
    return tree, pred, drawn, weight, np.where(np.isnan(x), [v[0] for v in layout.values], x)


def test_random_trees_leaves_and_cuts():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 6)).round(1)
    y = (x[:, 0] + rng.normal(size=900) > 0.5).astype(float)
    roots = set()
    for number in range(12):
        tree, pred, drawn, weight, filled = _random(x, y, 42, number)
        leaf = _leaf_of(tree, filled)
        held = np.bincount(leaf[drawn > 0], minlength=len(tree.feature))
        assert (held[tree.feature < 0] >= 4).all() and (tree.leaf_values(filled) == pred).all()
        for n in np.unique(leaf):
            a, b = (drawn * (1 - y))[leaf == n].sum() * weight[0], (drawn * y)[leaf == n].sum() * weight[1]
            assert tree.value[n] == pytest.approx(b / (a + b))
        assert weight[0] * (drawn * (1 - y)).sum() == pytest.approx(weight[1] * (drawn * y).sum())
        roots.add((int(tree.feature[0]), float(tree.threshold[0])))
    assert len(roots) >= 10  # cuts have about 70 places, so two may agree
    assert len({_random(x, y, s, 0)[0].threshold[0] for s in range(12)}) >= 10
    assert (_random(x, y, 7, 3)[0].threshold == _random(x, y, 7, 3)[0].threshold).all()


def _leaf_of(tree, x):
    numbered = tr.Tree(tree.feature, tree.cut, tree.threshold, tree.missing_left, tree.left, tree.right, np.arange(len(tree.feature)))
    return numbered.leaf_values(x)


def test_random_trees_have_no_depth_limit():
    x = np.arange(250.0).reshape(-1, 1)
    y = np.arange(250) % 2.0
    tree, *_ = _random(x, y, 1, 1, min_rows=1)
    assert len(tree.feature) > 150  # alternating classes: grown until leaves are pure


def test_random_cuts_lie_uniformly_between_the_ends():
    layout = coding.Layout(["a"], [np.arange(0.5, 99)], [np.arange(100.0)], np.ones(1, bool))
    names = tr.mix(np.arange(4000))
    chosen, cuts = tr.random_cuts(names, np.full((4000, 1), 20), np.full((4000, 1), 79), layout, 1.0)
    assert chosen.all() and cuts.min() == 20 and cuts.max() == 78
    assert np.abs(np.bincount((cuts[:, 0] - 20) // 10, minlength=6)[:5] / 4000 - 1 / 6).max() < 0.03


def test_bootstrap_counts_are_those_of_a_poisson_variable():
    drawn = tr.bootstrap(tr.mix(np.arange(100_000)), 1, 2)
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03 and abs((drawn == 0).mean() - np.exp(-1)) < 0.01


# -- Spark jobs
def _frames(spark, n=500, targets=("a", "b")):
    x, y = _data(n, 11)
    x[:, 0] = np.where(np.isnan(x[:, 0]), np.nan, x[:, 0] * 100 + np.arange(n) / n)  # more values than bins
    rows = [(f"k{i}", *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    matrix = spark.createDataFrame(rows, "key string, " + ", ".join(f"f{i} double" for i in range(x.shape[1])))
    labels = [(t, f"k{i}", "train" if i % 5 else "predict", float(y[i] if t == "a" else 1 - y[(i + 1) % n]) if i % 5 else None) for t in targets for i in range(n)]
    labels = spark.createDataFrame(labels, "target string, key string, split string, y double")
    folds = labels.where("split = 'train'").select("target", "key", (F.pmod(F.xxhash64("key", "target"), F.lit(3)) + 1).cast("int").alias("fold"))
    return matrix.repartition(5), labels, folds


SMALL = {"lightgbm": {"trees": 6, "step": 0.2}, "xgboost": {"trees": 6, "step": 0.2}, "catboost": {"trees": 6, "step": 0.2}, "extra_trees": {"trees": 5}}


def test_side_by_side_equals_rows_in_place(spark):
    matrix, labels, folds = _frames(spark, 240)
    data = train.model_input(matrix, labels, folds)
    got = [train.fit_all(data, list(SMALL), profile_overrides=SMALL, seeds=[42, 7], **sizes)
           for sizes in ({}, {"local_cells": 0, "cell_rows": 30, "refresh": 4})]
    for name, keys in (("oof", ["target", "key", "model", "fold"]), ("predictions", ["target", "key", "model"])):
        a, b = (g[name].toPandas().sort_values(keys, ignore_index=True) for g in got)
        assert len(a) == len(b) > 0 and (a[keys] == b[keys]).all().all()
        assert np.abs(a["pred"] - b["pred"]).max() < 1e-9
    imp = [{r["feature"]: r["importance"] for r in g["importance"].collect()} for g in got]
    assert imp[0] == imp[1] and sum(imp[0].values()) > 0
    # a forest's tree comes in parts there; all of them add up to the same scores
    for t in data.targets:
        parts = [g["models"]["trees"].where((F.col("model") == "extra_trees") & (F.col("target") == t) & (F.col("seed") == 42)) for g in got]
        assert parts[0].count() == 5 < parts[1].count()
        filled = matrix.na.fill(1.0)
        scores = [{r["key"]: r["pred"] for r in tree_jobs.score_trees(filled, data.layout.features, p, "forest", 5).collect()} for p in parts]
        assert scores[0].keys() == scores[1].keys() and max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-9


def test_oof_covers_each_row_once_and_learns(spark):
    matrix, labels, folds = _frames(spark)
    data = train.model_input(matrix, labels, folds)
    models = train.enabled_models()
    got = train.fit_all(data, models, profile_overrides={m: {"trees": 30, "step": 0.1} for m in models if m != "logistic"})
    oof = got["oof"].join(labels, ["target", "key"]).toPandas()
    assert len(oof) == len(oof[["target", "key", "model"]].drop_duplicates()) == 400 * 2 * len(models)
    assert (oof.groupby(["target", "key"])["fold"].nunique() == 1).all()
    of_a = oof[oof["target"] == "a"]
    base = of_a["y"].mean()
    none = -(base * np.log(base) + (1 - base) * np.log(1 - base))
    loss = -(of_a["y"] * np.log(of_a["pred"]) + (1 - of_a["y"]) * np.log(1 - of_a["pred"])).groupby(of_a["model"]).mean()
    assert (loss < none).all(), loss


def test_full_sizes_are_the_published_ones():
    p = MODEL_PROFILES
    assert (p["lightgbm"]["leaves"], p["lightgbm"]["min_rows"], p["lightgbm"]["l1"], p["lightgbm"]["l2"]) == (11, 12, 0.08, 2.5)
    assert (p["xgboost"]["depth"], p["xgboost"]["min_hessian"], p["xgboost"]["l2"]) == (3, 4.0, 2.0)
    assert (p["catboost"]["depth"], p["catboost"]["l2"], p["extra_trees"]["trees"], p["extra_trees"]["min_rows"]) == (4, 6.0, 700, 4)


def test_fold_statistics_equal_numpy(spark):
    matrix, labels, folds = _frames(spark, 700)
    matrix = matrix.withColumn("none", F.lit(None).cast("double")).withColumn("nan", F.when(F.col("f2") > 0, F.lit(float("nan"))).otherwise(F.col("f0")))
    data = coding.fit_table(matrix, labels, folds, [c for c in matrix.columns if c != "key"], max_bins=40)
    assert not data.layout.exact.all() and data.layout.exact.any() and max(data.layout.bins) <= 40
    got = coding.fold_statistics(data).toPandas()
    rows = labels.where("split = 'train'").join(folds, ["target", "key"]).join(matrix, "key").toPandas()
    for (target, vf, i), r in got.set_index(["target", "vf", "i"]).iterrows():
        own = rows[(rows["target"] == target) & (rows["fold"] != vf)][data.layout.features[i]].to_numpy(float)
        assert r["n"] == len(own) and r["n_values"] == (~np.isnan(own)).sum()
        if r["n_values"] == 0:
            assert np.isnan(r["median"]) and np.isnan(r["mean"])
            continue
        median = np.median(own[~np.isnan(own)])
        filled = np.where(np.isnan(own), median, own)
        assert r["median"] == pytest.approx(median, abs=1e-12)
        assert r["mean"] == pytest.approx(filled.mean(), abs=1e-9) and r["std"] == pytest.approx(filled.std(), abs=1e-7)
    assert len(got) == 2 * 4 * len(data.layout.features)


def test_fits_use_no_imputer_and_logistic_equals_brute_force(spark):
    matrix, labels, folds = _frames(spark, 400, ("a",))
    data = train.model_input(matrix, labels, folds)
    got = train.fit_all(data, ["logistic"], cv=False)
    params = got["models"]["linear"][0][3]
    rows = labels.where("split = 'train'").join(matrix, "key").toPandas()
    x, y = rows[data.layout.features].to_numpy(float), rows["y"].to_numpy()
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    w, b = np.array(params["coefficients"]), params["intercept"]
    p = 1 / (1 + np.exp(-(z @ w + b)))
    # at the optimum of the penalised loss its gradient vanishes
    assert np.abs(z.T @ (p - y) + w / 0.45).max() < 0.05 and abs((p - y).sum()) < 0.05


def test_rows_without_labels_or_keys_in_the_matrix(spark):
    matrix, labels, _ = _frames(spark, 60, ("a",))
    extra = labels.unionByName(spark.createDataFrame([("a", "absent", "train", 1.0), ("c", "k1", "predict", None)], labels.schema))
    got = train.fit_all(train.model_input(matrix, extra, None), ["xgboost", "extra_trees", "logistic"], cv=False,
                        profile_overrides={"xgboost": {"trees": 3}, "extra_trees": {"trees": 3}})
    pred = got["predictions"].collect()
    assert {r["pred"] for r in pred if r["target"] == "c"} == {0.5} and sum(r["target"] == "a" for r in pred) == 3 * 12


def _coded(n=3000, seed=3):
    """Readings, a transform of one, and the one-hot columns of a category."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)).round(2)
    kind = rng.integers(0, 9, n)
    x = np.concatenate([x, np.exp(x[:, :1]), kind[:, None] == np.arange(9)], axis=1)
    x[rng.random(n) < 0.1, 1] = np.nan
    x = x.round(1)
    return x, _layout(x), rng


def test_bundled_histograms_are_those_of_each_feature():
    """Dependent features are counted once, and the sums are the same whole numbers."""
    x, layout, rng = _coded()
    codes = layout.code(x)
    bundles = tr.Bundles(codes, layout, limit=300)
    assert len(bundles.parts) < 6  # 12 features
    pair = [rng.integers(-2**40, 2**40, len(x)).astype(float), rng.integers(0, 2**40, len(x)).astype(float)]
    flat = (codes + layout.offset).astype(np.int32)
    for rows in (np.arange(len(x)), np.flatnonzero(rng.random(len(x)) < 0.3), np.zeros(0, np.int64)):
        assert (bundles.histogram(rows, pair) == tr.histogram(flat, rows, pair, layout.size)).all()


def test_leaves_of_a_random_tree_cost_no_look_at_their_features():
    """Nodes of one class or of too few rows for two sides are leaves at once; the rows' values are those of their leaves."""
    x, layout, rng = _coded()
    x[np.isnan(x)] = 0.0
    codes, y = layout.code(x), (rng.random(len(x)) < 0.4).astype(float)
    drawn = tr.bootstrap(tr.mix(np.arange(len(x))), 1, 2)
    columns, seen = tr.Columns(codes, layout), []

    class Seen(tr.Columns):
        def best_splits(self, rows, sizes, weights, total, *rest):
            seen.append((sizes.min(), total[:, 1:].min(), len(rows) == sizes.sum()))
            return columns.best_splits(rows, sizes, weights, total, *rest)
    profile = {"min_rows": 4, "column_share": 0.65}
    scored = np.flatnonzero(rng.random(len(x)) < 0.5)
    tree, pred = tr.random_tree(Seen(codes, layout), y, drawn, scored, tr.root_name(1, 2), layout, profile, np.ones(2))
    assert all(size >= 8 and least > 0 and whole for size, least, whole in seen)
    assert (tree.leaf_values(x[scored]) == pred).all() and len(set(pred)) > 20


def test_one_hot_columns_share_a_column_of_the_random_trees():
    """Two-valued features of which a row has at most one are moved and counted as one column; others have columns of their own."""
    x, layout, rng = _coded()
    x[np.isnan(x)] = 0.0
    assert len(tr.Columns(layout.code(x), layout).by_column) == 3 + 1
    both = np.concatenate([x, rng.integers(0, 2, (len(x), 2))], axis=1)
    layout = _layout(both)
    columns = tr.Columns(layout.code(both), layout)
    assert len(columns.by_column) == 3 + 1 + 2
    rows = [np.arange(len(x)), np.flatnonzero(rng.random(len(x)) < 0.3)]
    for own in rows:
        for f in range(3, both.shape[1]):
            at = columns.by_column[:, own]
            assert (columns.goes_right(at, np.array([len(own)]), np.array([f]), np.array([0])) == (both[own, f] > 0)).all()


@pytest.mark.parametrize("big,products", [(1, 7), (40, 100), (10**9, 4096)])
def test_random_trees_do_not_depend_on_how_nodes_are_summed(monkeypatch, big, products):
    """Matrix products of big nodes and running sums of small ones give the same tree, with counts in one number or in three."""
    x, layout, rng = _coded(n=2000)
    x[np.isnan(x)] = 0.0
    codes, y = layout.code(x), (rng.random(len(x)) < 0.3 + 0.4 * (x[:, 0] > 0)).astype(float)
    drawn, scored = tr.bootstrap(tr.mix(np.arange(len(x))), 1, 2), np.arange(len(x))
    profile, name = {"min_rows": 4, "column_share": 0.65}, tr.root_name(1, 2)
    grow = lambda: tr.random_tree(codes, y, drawn, scored, name, layout, profile, np.ones(2))
    want, pred = grow()
    assert len(want.feature) > 100
    monkeypatch.setattr(tr, "BIG_NODE", big)
    monkeypatch.setattr(tr, "PRODUCT_ROWS", products)
    for apart in (False, True):
        if apart:
            class Apart(tr.Counts):
                def __init__(self, zeros, ones):
                    super().__init__(zeros, ones)
                    self.packed, self.channels = False, [np.ones(len(zeros)), zeros.astype(float), ones.astype(float)]
            monkeypatch.setattr(tr, "Counts", Apart)
        tree, again = grow()
        assert all((getattr(tree, c) == getattr(want, c)).all() for c in ("feature", "cut", "left", "right", "value")) and (again == pred).all()


def test_bundles_keep_few_bytes_a_row():
    """A histogram reads every part's numbers for each node: at most 1024 combinations need no eight bytes."""
    x, layout, _ = _coded()
    bundles = tr.Bundles(layout.code(x), layout, limit=300)
    assert {p[0].dtype.itemsize for p in bundles.parts} <= {1, 2}


def test_linear_fits_have_no_more_tasks_than_their_numbers_ask_for(spark, monkeypatch):
    """Each step of a linear fit is a job over all rows, so small tables are read by few tasks, large ones by many."""
    matrix, labels, _ = _frames(spark, 60, ("a",))
    data, seen = train.model_input(matrix.repartition(4), labels, None), []

    class Seen(train.LogisticRegression):
        def fit(self, rows, *rest):
            seen.append(rows.rdd.getNumPartitions())
            return super().fit(rows, *rest)
    monkeypatch.setattr(train, "LogisticRegression", Seen)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        small = train.fit_all(data, ["logistic"], cv=False)["predictions"].collect()
        monkeypatch.setattr(train, "LINEAR_CELLS", 16)
        large = train.fit_all(data, ["logistic"], cv=False)["predictions"].collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert seen[0] == 1 and seen[-1] > 1
    assert {r["key"]: round(r["pred"], 4) for r in small} == {r["key"]: round(r["pred"], 4) for r in large}
