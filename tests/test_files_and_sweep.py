"""Sources, sinks, history files, versions and the trial generators."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from daygrain.operators import sweep as sw
from daygrain.sources import files


def test_history_tolerant_reader(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "hist")
    files.append_history(spark, [{"trial_id": 1, "logloss": 0.61, "param_overrides": {}, "strategy": "baseline"}],
                         path)
    files.append_history(spark, [{"trial_id": 2, "logloss": math.inf, "param_overrides": {"a": 1.0},
                                  "error": "boom"}], path)
    with open(os.path.join(path, "part-broken.json"), "w") as fh:
        fh.write("\n{not json\n" + '{"trial_id": 3, "logloss": Infinity, "error": "x"}\n')
    h = files.load_history(spark, path)
    rows = sorted((r["trial_id"], r["logloss"]) for r in h.collect() if r["trial_id"] is not None)
    assert rows == [(1, 0.61), (2, math.inf), (3, math.inf)]
    params, loss = files.best_from_history(h)
    assert params == {} and loss == 0.61


def test_best_params_roundtrip_and_default(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "best")
    assert files.load_best(spark, p) == (None, math.inf)
    files.save_best(spark, p, {"training.prior.default_recent_weight": 0.171424}, 0.606865542224166, "now")
    assert files.load_best(spark, p) == ({"training.prior.default_recent_weight": 0.171424}, 0.606865542224166)


def test_versioned_output_and_latest(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "subs")
    df = spark.range(3)
    p1, v1 = files.write_versioned(df, base)
    p2, v2 = files.write_versioned(df, base)
    assert (v1, v2) == (1, 2) and files.latest_version(spark, base).endswith("version=2")


def test_csv_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    files.write_csv(df, os.path.join(tmpdir_path, "c"), single_file=True)
    back = files.read_csv(spark, os.path.join(tmpdir_path, "c"), "s string, n int")
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1), ("b", 2)]


def test_cache_follows_its_inputs(spark, tmpdir_path):
    src, base, calls = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "k"), []

    def build():
        calls.append(1)
        return spark.read.parquet(src).selectExpr("sum(id) AS s")

    def read(**params):
        return files.cached_table(spark, base, "sums", [src], build, **params).first()["s"]
    spark.range(4).write.parquet(src)
    assert [read(), read()] == [6, 6] and len(calls) == 1
    assert read(windows=3) == 6 and len(calls) == 2  # other parameters, another table
    spark.range(6).write.mode("overwrite").parquet(src)
    assert [read(), read()] == [15, 15] and len(calls) == 3
    assert read(force=True) == 15 and read() == 15 and len(calls) == 4


def test_cache_sees_no_unfinished_build_and_the_first_of_two_wins(spark, tmpdir_path):
    src, base = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "k")
    spark.range(4).write.parquet(src)

    def broken():
        raise OSError("cut short")
    with pytest.raises(OSError):
        files.cached_table(spark, base, "t", [src], broken)

    def build():  # another builder finishes while this one is at work
        files.cached_table(spark, base, "t", [src], lambda: spark.range(1))
        return spark.range(2)
    assert files.cached_table(spark, base, "t", [src], build).count() == 1


def test_writers_at_once_get_versions_of_their_own(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "subs")
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda i: files.write_versioned(spark.range(i, i + 1).coalesce(1), base), range(6)))
    assert sorted(n for _, n in done) == files.versions(spark, base) == [1, 2, 3, 4, 5, 6]
    assert sorted(int(r["id"]) for p, _ in done for r in files.read_csv(spark, p, "id long").collect()) == list(range(6))
    files.claim_version(spark, base)  # a writer that dies after its claim
    assert files.latest_version(spark, base).endswith("version=6")
    assert files.write_versioned(spark.range(1), base)[1] == 8


def test_appends_at_once_lose_no_record(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "hist")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: files.append_history(spark, [{"trial_id": i, "logloss": 0.5}], path), range(6)))
    assert sorted(r["trial_id"] for r in files.load_history(spark, path).collect()) == list(range(6))


def test_trial_strategies(spark):
    inc = {"training.model_blend_power": 3.0, "training.prior.subject_smoothing": 9.0}
    mixed = sw.trials(spark, 40, incumbent=inc).orderBy("trial_id").collect()
    assert [r["strategy"] for r in mixed[:2]] == ["sobol", "sobol"] and {r["strategy"] for r in mixed[2:]} == {"random", "perturb"}
    assert sw.trials(spark, 3).orderBy("trial_id").first()["strategy"] == "baseline"
    for r in sw.trials(spark, 20, strategy="perturb", incumbent=inc).collect():
        assert set(r["overrides"]) == set(inc) and 1 <= sum(r["overrides"][k] != v for k, v in inc.items()) <= 2


def test_random_trials_change_one_to_three(spark):
    tr = [r["overrides"] for r in sw.trials(spark, 40, strategy="random").collect()]
    assert all(1 <= len(ov) <= 3 for ov in tr)
    assert len({tuple(sorted(ov.items())) for ov in tr}) == 40   # no repeated trial
