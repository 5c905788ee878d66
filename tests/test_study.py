"""Splits, audits, preprocessing, samplers, metrics, configuration, stream and the whole study."""

import csv
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.cli import parser
from tidewatch.operators import metrics, models, policy, preprocess, splits
from tidewatch.plans import config as C
from tidewatch.plans import experiment
from tidewatch.sources import records, synthetic

from .test_windows import frame, got, plain, random_rows, same


def events(spark, rows):
    """(id, label, time, query) as a manifest's events."""
    return spark.createDataFrame([(str(i), lab, float(t), "f", i, q) for i, lab, t, q in rows], "event_id string, label int, timestamp double, source_file string, source_line long, query string")


@pytest.fixture
def mixed(spark):
    return events(spark, [(i, int(i % 5 == 0), i, f"h.s{i % 10}.com") for i in range(200)])


def test_splits(spark, mixed):
    for strategy, mode in (("stratified_random", "global"), ("chronological", "global"), ("chronological", "per_class")):
        out = splits.assign_subset(mixed, strategy, 0.3, 42, mode).collect()
        assert len(out) == 200 and sum(r["subset"] == "test" for r in out) == 60
        if strategy == "stratified_random" or mode == "per_class":
            assert sum(r["subset"] == "test" and r["label"] == 1 for r in out) == 12
        if mode == "global" and strategy == "chronological":
            assert min(r["timestamp"] for r in out if r["subset"] == "test") == 140
        again = splits.assign_subset(mixed.repartition(7), strategy, 0.3, 42, mode).collect()
        assert {(r["event_id"], r["subset"]) for r in out} == {(r["event_id"], r["subset"]) for r in again}
    apart = events(spark, [(i, int(i >= 100), i, "a.b.com") for i in range(120)])
    with pytest.raises(ValueError, match="both"):
        splits.assign_subset(apart, "chronological", 0.1)
    with pytest.raises(ValueError):
        splits.assign_subset(mixed, "no such")


def test_first_share_in_small_steps(spark):
    rows = [(f"e{i * 7919 % 1000:03d}", i % 3, None if i % 50 == 0 else [float("nan"), 5.0, 5.0, 5.0, float(i), -float(i % 7)][i % 6]) for i in range(600)]
    table = spark.createDataFrame(rows, "event_id string, label int, at double")
    order = lambda r: (float("-inf") if r[2] is None else float("inf") if r[2] != r[2] else r[2], r[0])
    for few in (5, 1 << 17):
        for share in (0.0, 0.1, 0.5, 0.63, 1.0):
            taken = splits.first_share(table, F.col("at"), ["label"], lambda n, s=share: round(n * s), few)
            got = {r["event_id"] for r in table.where(taken).collect()}
            wanted = set()
            for label in (0, 1, 2):
                mine = sorted((r for r in rows if r[1] == label), key=order)
                wanted |= {r[0] for r in mine[: round(len(mine) * share)]}
            assert got == wanted


def test_stratified_folds(spark, mixed):
    dealt = mixed.withColumn("fold", models.stratified_folds(mixed, 3, 42)).groupBy("label", "fold").count().collect()
    assert sorted((r["label"], r["fold"], r["count"]) for r in dealt) == [(0, 0, 53), (0, 1, 54), (0, 2, 53), (1, 0, 13), (1, 1, 14), (1, 2, 13)]


def test_group_split(spark):
    rows = [(i, 0, i, f"x.good{i % 10}.com") for i in range(500)] + [(1000 + i, 1, i, f"x.bad{i % 2}.com") for i in range(80)]
    out = splits.assign_subset(events(spark, rows), "group_sld", 0.3)
    tests = out.where("subset = 'test'").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in tests} == {0: 150, 1: 40}
    both = out.groupBy("query").agg(F.count_distinct("subset").alias("n")).where("n > 1").count()
    assert both == 0
    one = events(spark, [(i, 0, i, f"x.good{i % 10}.com") for i in range(50)] + [(100 + i, 1, i, "x.bad.com") for i in range(8)])
    with pytest.raises(ValueError, match="distinct SLDs"):
        splits.assign_subset(one, "group_sld", 0.3)


def test_manifest(spark, mixed, tmp_path):
    out = splits.assign_subset(mixed, "stratified_random")
    splits.write_manifest(out, f"file://{tmp_path}/m.csv")
    manifest = splits.read_manifest(spark, f"file://{tmp_path}/m.csv")
    again = splits.apply_manifest(mixed, manifest)
    assert {(r["event_id"], r["subset"]) for r in out.collect()} == {(r["event_id"], r["subset"]) for r in again.collect()}
    with pytest.raises(ValueError, match="not in the split manifest"):
        splits.apply_manifest(mixed, manifest.where("event_id <> '7'"))
    with pytest.raises(ValueError, match="unknown subsets"):
        splits.apply_manifest(mixed, manifest.withColumn("subset", F.when(F.col("event_id") == "3", "other").otherwise(F.col("subset"))))
    told = splits.summarize_split(out, "stratified_random", 0.3, 42)
    assert told["overlap_event_ids"] == 0 and told["test"]["total"] == 60


def test_dedupe(spark):
    base = [(f"e{i}", i % 2, float(i), "s", None, None, None, None, "q", None, None, ["a"] if i % 3 else None, None, None, None, None, None, None, i) for i in range(20)]
    copies = [(f"c{i}", *base[i][1:-1], 100 + i) for i in range(10)]
    flipped = [(f"f{i}", 1 - base[i][1], *base[i][2:-1], 200 + i) for i in range(3)]
    schema = "event_id string, label int, timestamp double, src_ip string, dst_ip string, src_port int, dst_port int, proto string, query string, qtype_name string, rcode_name string, answers array<string>, ttls array<double>, rejected boolean, aa boolean, tc boolean, rd boolean, ra boolean, source_line int"
    rows = spark.createDataFrame(base + copies + flipped, schema)
    kept = splits.deduplicate(rows)
    told = splits.dedupe_report(rows, kept)
    assert told["n_duplicates_removed"] == 10 and told["label_conflict_events"] == 6
    assert not {r["event_id"][0] for r in kept.collect()} & {"c"}


def test_selection():
    assert len(policy.select_features(False).columns) == 36 and len(policy.select_features(True).columns) == 57
    s = policy.select_features(True, feature_set="query_only", exclude=["query_length"], artifact_fields=["ttls"])
    assert s.dropped["ttl_min"] == "features.feature_set=query_only" and s.dropped["query_length"] == "features.exclude"
    assert not s.categorical and "win_ttl_mean" not in s.columns
    with pytest.raises(ValueError, match="unknown"):
        policy.select_features(True, exclude=["nope"])
    with pytest.raises(ValueError, match="no features"):
        policy.select_features(False, exclude=policy.EVENT_FEATURES)


def test_audits(spark):
    rng = random.Random(1)
    rows = [(str(i), i % 2, f"q{i}", f"s{i % 7}", float(i % 2), rng.random(), "A" if i % 2 else "B", 1 if i % 2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id string, label int, query string, sld string, c0 double, b0 double, cat0 string, ttls int")
    audit = {r["field"]: r for r in policy.schema_audit(df, 0.5).collect()}
    assert audit["ttls"]["flagged"] and audit["ttls"]["presence_tunnel"] == 1.0
    told = policy.leakage_audit(df, df, ["c0"], ["b0"], ["cat0"])
    assert told["top_single_feature_auc_train"]["c0"] == 1.0 and told["categorical_purity_train"]["cat0"]["purity"] == 1.0
    assert told["duplicates"]["test_rows_with_identical_vector_in_train"] == {"benign": 1.0, "tunnel": 1.0} and told["overlap_test_in_train"]["sld_overlap"] == {"benign": 1.0, "tunnel": 1.0}
    assert len(told["warnings"]) == 6


def test_preprocess(spark):
    df = spark.createDataFrame([(1.0, 1.0, "b"), (2.0, 0.0, "a"), (None, None, None), (6.0, 0.0, "a"), (float("nan"), 1.0, "c")], "x double, y double, z string").withColumn("void", F.lit(None).cast("double"))
    prep = preprocess.Preprocessor.fit(df, ["x", "void"], ["y"], ["z"])
    assert prep.medians == {"x": 2.0, "void": 0.0} and prep.modes == {"y": 0.0} and prep.categories["z"] == ["MISSING", "a", "b", "c"]
    new = spark.createDataFrame([(None, None, "new"), (5.0, 1.0, "b")], "x double, y double, z string").withColumn("void", F.lit(3.0))
    assert [tuple(r) for r in prep.transform(new).select("x", "y", "z").collect()] == [(2.0, 0.0, -1.0), (5.0, 1.0, 2.0)]
    vectors = [list(r["features"]) for r in prep.assemble(prep.transform(new)).select("features").collect()]
    assert vectors[0][:4] == [0, 0, 0, 0] and vectors[1][:4] == [0, 0, 1, 0] and prep.feature_names()[:2] == ["z=MISSING", "z=a"]
    scaled = preprocess.Preprocessor.fit(df, ["x", "void"], [], [], scale=True)
    assert scaled.deviations["void"] == 1.0 and scaled.deviations["x"] == pytest.approx((sum((v - 2.6) ** 2 for v in (1, 2, 2, 6, 2)) / 5) ** 0.5)


@pytest.fixture
def matrix(spark):
    rng = random.Random(3)
    rows = [(str(i), int(i >= 270), rng.random() + (i >= 270), rng.random(), float(rng.randrange(2)), float(rng.randrange(3))) for i in range(300)]
    return spark.createDataFrame(rows, "event_id string, label int, c0 double, c1 double, b0 double, cat0 double")


def test_samplers(matrix):
    for method, groups in (("random_oversampling", (["c0", "c1"], ["b0"], ["cat0"])), ("smote", (["c0", "c1"], ["b0"], [])), ("smotenc", (["c0", "c1"], ["b0"], ["cat0"]))):
        out = preprocess.resample(matrix, method, "auto", 42, *groups)
        assert preprocess.class_counts(out) == {0: 270, 1: 270} and out.where("_extra").count() == 240
        new = out.where("_extra").collect()
        old = matrix.where("label = 1").collect()
        assert min(r["c0"] for r in old) <= min(r["c0"] for r in new) and max(r["c0"] for r in new) <= max(r["c0"] for r in old)
        if method == "random_oversampling":
            assert {r["c0"] for r in new} <= {r["c0"] for r in old}
        else:
            assert len({r["c0"] for r in new}) > 200
        if method == "smotenc":
            assert {r["cat0"] for r in new} <= {0.0, 1.0, 2.0} and {r["b0"] for r in new} <= {0.0, 1.0}
    assert preprocess.class_counts(preprocess.resample(matrix, "random_oversampling", 0.5)) == {0: 270, 1: 135}
    assert preprocess.target_counts({0: 10, 1: 4}, {1: 7}) == {0: 10, 1: 7} and preprocess.target_counts({0: 10, 1: 4}, "minority") == {0: 10, 1: 10}
    with pytest.raises(ValueError, match="categorical"):
        preprocess.resample(matrix, "smote", categorical=["cat0"])
    with pytest.raises(ValueError, match="too few"):
        preprocess.safe_neighbours(5, 1)


def test_score_curve_over_many_ranges(spark):
    rows = [("ab"[i % 2], i % 3 % 2, None if i % 100 == 0 else float(i * 37 % 1009) / 7) for i in range(2000)]
    got = metrics.score_curve(spark.createDataFrame(rows, "name string, label int, score double"), "name").collect()
    assert len(got) == len({(r[0], r[2]) for r in rows})
    at = lambda x: float("-inf") if x is None else x
    for r in got:
        mine = [(y, at(x)) for name, y, x in rows if name == r["name"]]
        same, over = [y for y, x in mine if x == at(r["score"])], [y for y, x in mine if x >= at(r["score"])]
        want = (sum(same), len(same) - sum(same), sum(over), len(over) - sum(over), sum(y for y, _ in mine), sum(1 - y for y, _ in mine))
        assert tuple(r[k] for k in ("p", "n", "tp", "fp", "pos", "neg")) == want
    nothing = spark.createDataFrame([(1, None), (0, None)], "label int, score double")
    assert metrics.roc_auc(nothing).first()["roc_auc"] == 0.5 and metrics.roc_auc(nothing.limit(0)).first()["roc_auc"] is None


def test_metrics(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    points = [(t, sum(s >= t for s in pos), sum(s >= t for s in neg)) for t in sorted({s for _, s in rows}, reverse=True)]
    ap, last, f1s = 0.0, 0.0, []
    for t, tp, fp in points:
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
        f1s.append((2 * tp / (2 * tp + fp + len(pos) - tp), -t))
    m = metrics.all_metrics(df, 0.5)
    assert m["roc_auc"] == pytest.approx(auc) and m["average_precision"] == pytest.approx(ap)
    assert m["tp"] == sum(s >= 0.5 for s in pos) and m["tn"] == sum(s < 0.5 for s in neg)
    best = metrics.best_threshold(df).first()
    assert best["f1"] == pytest.approx(max(f1s)[0]) and best["threshold"] == -max(f1s)[1]
    one = metrics.all_metrics(df.where("label = 0"), 0.5)
    assert one["roc_auc"] is None and one["roc_auc_note"] and one["average_precision_note"] and one["recall"] == 0
    report = metrics.classification_report(m)
    assert report["accuracy"] == pytest.approx(m["accuracy"]) and report["weighted avg"]["support"] == 300


def test_config(tmp_path):
    assert C.check(C.load())["windows"]["sizes"] == [5, 10, 15, 30, 60]
    (tmp_path / "c.yaml").write_text("split: {test_size: 0.2}\nwindows: {sizes: [60, 5, 5.5, 5]}\n")
    c = C.check(C.override(C.load(str(tmp_path / "c.yaml")), {"split.strategy": "chronological", "random_seed": None}))
    assert c["split"] == {"strategy": "chronological", "test_size": 0.2, "chronological_mode": "global", "manifest_path": None} and c["windows"]["sizes"] == [5, 5.5, 60]
    for bad in ({"split.strategy": "x"}, {"split.test_size": 1.0}, {"models.enabled": []}, {"windows.sizes": [0]}, {"windows.history_policy": "train_carryover"}, {"balancing.sampling_strategy": True}, {"runtime.n_jobs": 0}, {"validation.required_fields": ["zz"]}):
        with pytest.raises(ValueError):
            C.check(C.override(C.load(), bad))
    (tmp_path / "c.yaml").write_text("nope: 1\n")
    with pytest.raises(ValueError, match="unknown"):
        C.load(str(tmp_path / "c.yaml"))
    assert C.sampling_strategy("0.5") == 0.5 and C.sampling_strategy({"1": 5}) == {1: 5}
    given = vars(parser().parse_args(["--benign", "b", "--windows", "5,10", "--tune"]))
    assert given["windows.sizes"] == [5.0, 10.0] and given["tuning.enabled"] is True and given["run_baseline"] is None
    assert experiment.experiment_id("sliding_window", 5, "mlp") != experiment.experiment_id("sliding_window", 5.5, "mlp")


def test_weights():
    assert models.weight_policy("none", "balanced") == "balanced"
    with pytest.raises(ValueError):
        models.weight_policy("smote", "balanced")
    assert "allowed" in models.weight_policy("smote", "balanced", True)


def test_stream_equals_batch(spark, tmp_path):
    from tidewatch.streaming.windows import stream_window_features

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted(random_rows(200, 8), key=lambda r: r["timestamp"])
    for k in range(2):  # two files, in order of time
        frame(spark, rows[k * 100 : k * 100 + 100]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = stream_window_features(stream, 15).writeStream.format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    out = got(spark.table("windows"))
    assert len(out) >= 190
    batch = plain(rows, 15)
    same(out, {k: batch[k] for k in out})


def test_whole_study(spark, tmp_path):
    benign, tunnel = synthetic.write_logs(spark, f"file://{tmp_path}/logs", 400, 80, seed=7, noise=True)
    config = C.check(C.override(C.load(), {
        "input.benign_path": benign, "input.tunnel_path": tunnel, "output_dir": str(tmp_path / "out"), "windows.sizes": [5.5], "models.enabled": ["random_forest"],
        "models.params": {"random_forest": {"n_estimators": 5, "max_depth": 4}}, "outputs.save_plots": False,
    }))
    rows = experiment.run(spark, config)
    assert [r["experiment_id"] for r in rows] == ["baseline_w00_random_forest", "sliding_window_w5_5_random_forest"]
    assert all(set(r) == set(experiment.RESULT) for r in rows)
    assert all(r["n_train_resampled"] > r["n_train_original"] and r["n_test"] == 145 for r in rows)
    assert rows[1]["n_features"] - rows[0]["n_features"] == 21 and min(r["roc_auc"] for r in rows) > 0.9
    with open(tmp_path / "out/results.csv", encoding="utf-8") as file:
        assert next(csv.reader(file)) == list(experiment.RESULT)
    told = json.loads((tmp_path / "out/dataset_summary.json").read_text())
    assert told["deduplication"]["n_duplicates_removed"] == 1 and told["split"]["overlap_event_ids"] == 0
    folder = tmp_path / "out/sliding_window_w5_5_random_forest"
    for name in ("metrics.json", "model_params.json", "feature_schema.json", "classification_report.txt", "confusion_matrix.csv", "feature_importance.csv", "predictions.csv", "model", "preprocessor.json"):
        assert (folder / name).exists(), name
    with pytest.raises(FileExistsError):
        experiment.run(spark, config)
    assert math.isfinite(rows[0]["inference_ms_per_event"]) and records.EVENT_COLUMNS


def test_neighbours_are_the_nearest(spark, monkeypatch):
    """All k of them, ties by number, when the class is many blocks."""
    monkeypatch.setattr(preprocess, "NEIGHBOUR_ROWS", 16)
    rng = random.Random(9)
    points = [[float(rng.randrange(6)), rng.choice([0.0, 1e3]) + rng.randrange(4), rng.random() * (i % 2)] for i in range(150)] + [[5e6, 0.0, 0.0]]
    own = spark.createDataFrame(list(enumerate(points)), "_n bigint, v array<double>")
    got = {r["_n"]: r["_near"] for r in preprocess._neighbours(own, "v", 5).collect()}
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    assert got == {i: sorted((j for j in range(len(points)) if j != i), key=lambda j: (far(points[i], points[j]), j))[:5] for i in range(len(points))}


def test_cuts_halve_the_rows():
    """The blocks of the neighbour search lie together; one value only cannot be cut."""
    import numpy as np

    x = np.random.default_rng(4).random((64, 3)) * [1, 50, 1]
    dims, cuts = preprocess._cuts(x, 2)
    node = np.zeros(64, int)
    for _ in range(2):
        node = 2 * node + 1 + (x[np.arange(64), dims[node]] > cuts[node])
    assert dims[0] == 1 and np.bincount(node)[3:].tolist() == [16] * 4
    assert np.isinf(preprocess._cuts(np.ones((9, 2)), 2)[1]).all()
