"""The whole study: load, dedupe, split, audits, features, windows, one model per configuration, results and artefacts."""

from __future__ import annotations

import json
import platform
import shutil
import sys
import time
from collections.abc import Mapping
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import FORBIDDEN, add_event_features
from ..functions.net import SuffixRules
from ..operators import metrics, models, policy, splits
from ..operators.windows import WINDOW_INPUT, add_window_features, window_features_with_history, window_label
from ..sources.records import class_distribution, load_labelled

#: Fixed names and order of a result row.
RESULT = (
    "experiment_id", "model", "approach", "window_seconds", "split_strategy", "window_history_policy", "balancing_method", "sampling_strategy", "random_seed",
    "n_train_original", "n_train_resampled", "n_test", "n_features", "accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "false_positive_rate",
    "tn", "fp", "fn", "tp", "feature_extraction_seconds", "training_seconds", "inference_seconds", "inference_ms_per_event", "n_features_transformed", "threshold",
    "threshold_mode", "class_weight_policy", "preprocessing_seconds", "model_inference_seconds", "feature_extraction_test_seconds", "batch_end_to_end_ms_per_event",
    "tuning_enabled", "tuning_seconds", "roc_auc_note", "train_neg_before", "train_pos_before", "train_neg_after", "train_pos_after", "data_origin", "experiment_dir",
)


def prepare_folder(path: Path, overwrite: bool) -> None:
    """Makes the folder; one that holds something is emptied only if that is asked for."""
    if path.exists() and any(path.iterdir()):
        if not overwrite:
            raise FileExistsError(f"{path} is not empty; name another one or allow overwriting")
        shutil.rmtree(path)
    path.mkdir(parents=True, exist_ok=True)


def dump(value, path: Path) -> None:
    """JSON; what JSON does not know becomes text, sets become lists."""
    path.write_text(json.dumps(value, indent=2, default=lambda x: sorted(x) if isinstance(x, (set, frozenset)) else x.item() if hasattr(x, "item") else str(x)), encoding="utf-8")


def environment() -> dict:
    def version(name: str) -> str:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return "not installed"

    return {"python": sys.version, "platform": platform.platform(), "packages": {n: version(n) for n in ("pyspark", "pyarrow", "pandas", "numpy", "PyYAML")}}


def experiment_id(approach: str, window: float, model: str) -> str:
    """Fractions of a window stay in the name, so 5 and 5.5 seconds do not meet."""
    return f"{approach}_w{window_label(window).zfill(2)}_{model}"


def rules_of(config: Mapping) -> SuffixRules:
    d = config["domain"]
    if d.get("suffix_file"):
        return SuffixRules.from_file(d["suffix_file"], d["include_private_suffixes"], d["local_suffixes"])
    return SuffixRules.default(d["include_private_suffixes"], d["local_suffixes"])


def _landed(df: DataFrame, place: str) -> DataFrame:
    """The table as Parquet, read again: later plans start there, and a lost executor costs nothing that was written."""
    df.write.mode("overwrite").parquet(place)
    return df.sparkSession.read.parquet(place)


def _timed(df: DataFrame, place: str) -> tuple[DataFrame, float]:
    """The table, written as Parquet and read again, and how long that took."""
    start = time.perf_counter()
    df = _landed(df, place)
    return df, time.perf_counter() - start


def _run_one(config: Mapping, name: str, approach: str, window: float, train: DataFrame, test: DataFrame, chosen: policy.Selection, seconds, folder: Path) -> dict:
    """Fits on train, scores test, writes the configuration's files and returns its result row."""
    seed, balancing, tuning, limit = config["random_seed"], config["balancing"], config["tuning"], config["threshold"]
    folder.mkdir(parents=True, exist_ok=True)
    groups = (chosen.continuous, chosen.binary, chosen.categorical)
    params = dict(config["models"]["params"].get(name, {}))
    weights = models.weight_policy(balancing["method"], balancing["class_weight"], bool(balancing["allow_class_weight_with_resampling"]))
    best, tuning_seconds = None, 0.0
    if tuning["enabled"] and tuning["param_grids"].get(name):
        start = time.perf_counter()
        best, _ = models.tune(train, name, groups, balancing, params, tuning["param_grids"][name], tuning["n_iter"], tuning["cv_folds"], tuning["scoring"], seed)
        tuning_seconds, params = time.perf_counter() - start, params | best
    threshold, told = float(limit["value"]), {}
    if limit["mode"] == "validation_f1":
        threshold, told = models.choose_threshold(train, name, groups, balancing, params, float(limit["validation_size"]), seed)
    start = time.perf_counter()
    fitted = models.Fitted.fit(train, name, groups, balancing, params, seed)
    training = time.perf_counter() - start
    start = time.perf_counter()
    fitted.preprocessed(test).select("features").write.format("noop").mode("overwrite").save()
    preprocessing = time.perf_counter() - start
    start = time.perf_counter()
    scored = fitted.score(test).select("event_id", "label", "score").persist()
    n_test = scored.count()
    inference = max(time.perf_counter() - start, preprocessing)
    m = metrics.all_metrics(scored, threshold)
    report = metrics.classification_report(m)
    (folder / "classification_report.txt").write_text(metrics.report_text(report), encoding="utf-8")
    (folder / "confusion_matrix.csv").write_text(f",pred_benign,pred_tunnel\ntrue_benign,{m['tn']},{m['fp']}\ntrue_tunnel,{m['fn']},{m['tp']}\n", encoding="utf-8")
    predictions = scored.select("event_id", F.col("label").alias("y_true"), F.col("score").alias("proba_tunnel"), (F.col("score") >= threshold).cast("int").alias("y_pred"))
    predictions.write.mode("overwrite").csv(f"file://{folder.resolve()}/predictions.csv", header=True)
    if config["outputs"]["save_plots"]:  # points of the curves; a plotting library is not needed
        metrics.roc_points(scored).orderBy("fpr", "tpr").coalesce(1).write.mode("overwrite").csv(f"file://{folder.resolve()}/roc_curve.csv", header=True)
        metrics.pr_points(scored).orderBy("recall").coalesce(1).write.mode("overwrite").csv(f"file://{folder.resolve()}/precision_recall_curve.csv", header=True)
    scored.unpersist()
    ranked = fitted.importances()[: int(config["outputs"]["top_k_importance"])]
    if ranked:
        (folder / "feature_importance.csv").write_text("feature,importance\n" + "".join(f"{n},{v!r}\n" for n, v in ranked), encoding="utf-8")
    features = fitted.prep.feature_names()
    row = train.agg(*[F.count(F.col(c)).alias(c) for c in chosen.columns]).first().asDict()
    dump(
        {"classifier": params, "preprocessing": fitted.prep.to_dict(), "class_weight_policy": weights, "tuning_best_params": best, "threshold": threshold, "threshold_selection": told},
        folder / "model_params.json",
    )
    dump(
        {
            "experiment_id": folder.name, "approach": approach, "window_seconds": window, "input_features": dict(zip(("continuous", "binary", "categorical"), groups, strict=True)),
            "transformed_feature_names": features, "features_entirely_missing_in_train": [c for c, n in row.items() if not n], "features_dropped_by_policy": chosen.dropped,
            "metadata_never_used_as_features": sorted(FORBIDDEN), "note": "Window features need each group's recent events at inference; the model does not hold them.",
        },
        folder / "feature_schema.json",
    )
    dump(m | {"classification_report": report, "train_class_counts_before_resampling": fitted.counts_before, "train_class_counts_after_resampling": fitted.counts_after}, folder / "metrics.json")
    if config["outputs"]["save_models"]:
        fitted.model.write().overwrite().save(f"file://{folder.resolve()}/model")
        dump(fitted.prep.to_dict() | {"continuous": chosen.continuous, "binary": chosen.binary, "categorical": chosen.categorical, "scale": fitted.prep.scale}, folder / "preprocessor.json")
    before, after = fitted.counts_before, fitted.counts_after
    return {
        "experiment_id": folder.name, "model": name, "approach": approach, "window_seconds": float(window), "split_strategy": config["split"]["strategy"],
        "window_history_policy": config["windows"]["history_policy"] if approach == "sliding_window" else "not_applicable", "balancing_method": balancing["method"],
        "sampling_strategy": str(balancing["sampling_strategy"]), "random_seed": seed, "n_train_original": sum(before.values()), "n_train_resampled": sum(after.values()), "n_test": n_test,
        "n_features": len(chosen.columns), **{k: m[k] for k in ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "false_positive_rate", "tn", "fp", "fn", "tp")},
        "feature_extraction_seconds": sum(seconds), "training_seconds": training, "inference_seconds": inference, "inference_ms_per_event": inference * 1000 / n_test,
        "n_features_transformed": len(features), "threshold": threshold, "threshold_mode": limit["mode"], "class_weight_policy": weights, "preprocessing_seconds": preprocessing,
        "model_inference_seconds": inference - preprocessing, "feature_extraction_test_seconds": seconds[1], "batch_end_to_end_ms_per_event": (seconds[1] + inference) * 1000 / n_test,
        "tuning_enabled": bool(tuning["enabled"]), "tuning_seconds": tuning_seconds, "roc_auc_note": m["roc_auc_note"], "train_neg_before": before.get(0, 0),
        "train_pos_before": before.get(1, 0), "train_neg_after": after.get(0, 0), "train_pos_after": after.get(1, 0), "data_origin": config["data_origin"], "experiment_dir": str(folder),
    }


def run(spark: SparkSession, config: dict, overwrite: bool = False) -> list[dict]:
    """All configurations: the baseline and each window size, times each model. Returns the result rows and writes the artefacts."""
    out = Path(config["output_dir"])
    models.weight_policy(config["balancing"]["method"], config["balancing"]["class_weight"], bool(config["balancing"]["allow_class_weight_with_resampling"]))
    prepare_folder(out, overwrite)
    dump(environment(), out / "environment.json")
    try:
        import yaml

        (out / "config_used.yaml").write_text(yaml.safe_dump(json.loads(json.dumps(config, default=str)), sort_keys=False), encoding="utf-8")
    except ImportError:
        dump(config, out / "config_used.json")
    given, checks = config["input"], config["validation"]
    events, reports, available = load_labelled(
        spark, given["benign_path"], given["tunnel_path"], float(checks["max_invalid_fraction"]), mapping=config["field_mapping"], fmt=given["format"], encoding=given["encoding"],
        required=checks["required_fields"],
    )
    work = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir') or f'file://{out.resolve()}'}/work-{out.name}"
    events = _landed(events, f"{work}/events")
    kept, dedupe = events, None
    if config["dedupe"]["enabled"]:
        kept = _landed(splits.deduplicate(events), f"{work}/kept")
        dedupe = splits.dedupe_report(events, kept)
        kept = kept.drop("label_conflict")
    rules, how = rules_of(config), config["split"]
    if how["manifest_path"]:
        split = splits.apply_manifest(kept, splits.read_manifest(spark, how["manifest_path"]))
    else:
        split = splits.assign_subset(kept, how["strategy"], how["test_size"], config["random_seed"], how["chronological_mode"], rules=rules)
    split = _landed(split, f"{work}/split")
    if not how["manifest_path"]:
        splits.write_manifest(split, f"file://{out.resolve()}/split_manifest.csv")
    train_raw, test_raw = (split.where(F.col("subset") == s).drop("subset") for s in ("train", "test"))
    audit = [r.asDict() for r in policy.schema_audit(train_raw, config["features"]["schema_artifact_threshold"]).collect()]
    artefacts = [r["field"] for r in audit if r["flagged"]]
    excluded = artefacts if config["features"]["schema_artifact_policy"] == "exclude" else []
    train, train_seconds = _timed(add_event_features(train_raw, available, rules), f"{work}/train")
    test, test_seconds = _timed(add_event_features(test_raw, available, rules), f"{work}/test")
    choose = lambda windows: policy.select_features(windows, config["features"]["include_categorical"], config["features"]["feature_set"], config["features"]["exclude"], excluded)
    base = choose(False)
    leaks = policy.leakage_audit(train, test, base.continuous, base.binary, base.categorical)
    dump(
        {
            "class_distribution": class_distribution(events).first().asDict(), "reports": reports, "field_availability": available, "deduplication": dedupe,
            "split": splits.summarize_split(split, how["strategy"] if not how["manifest_path"] else "manifest", how["test_size"], config["random_seed"]),
            "domain_kinds": {r["domain_kind"]: r["count"] for r in train.unionByName(test).groupBy("domain_kind").count().collect()},
            "n_groups": train.unionByName(test).select("src_ip", "sld").distinct().count(), "schema_artifact_audit": audit, "leakage_audit": leaks, "suffix_rules": rules.source,
        },
        out / "dataset_summary.json",
    )
    notes = [f"Data origin: {config['data_origin']}.", f"Schema artefacts: {', '.join(artefacts) or 'none'}.", *leaks["warnings"]]
    (out / "RUN_NOTES.md").write_text("# Notes of this run\n\n" + "\n".join(f"- {n}" for n in notes) + "\n", encoding="utf-8")
    rows = []
    if config["run_baseline"]:
        for name in config["models"]["enabled"]:
            rows.append(_run_one(config, name, "baseline", 0, train, test, base, (train_seconds, test_seconds), out / experiment_id("baseline", 0, name)))
    extra = [c for c in train.columns if c not in WINDOW_INPUT]
    for size in config["windows"]["sizes"]:
        chosen = choose(True)
        wide, a = _timed(add_window_features(train, size), f"{work}/train-{window_label(size)}")
        if config["windows"]["history_policy"] == "train_carryover":
            windowed = window_features_with_history(test, train, size).join(test.select("event_id", *[c for c in extra if c != "event_id"]), "event_id")
        else:
            windowed = add_window_features(test, size)
        wide_test, b = _timed(windowed, f"{work}/test-{window_label(size)}")
        for name in config["models"]["enabled"]:
            rows.append(_run_one(config, name, "sliding_window", size, wide, wide_test, chosen, (train_seconds + a, test_seconds + b), out / experiment_id("sliding_window", size, name)))
    with open(out / "results.csv", "w", encoding="utf-8", newline="") as file:
        import csv

        writer = csv.DictWriter(file, RESULT)
        writer.writeheader()
        writer.writerows(rows)
    comparison = {f"{r['approach']}_{window_label(r['window_seconds'])}": {} for r in rows}
    for r in rows:
        comparison[f"{r['approach']}_{window_label(r['window_seconds'])}"][r["model"]] = {k: r[k] for k in ("f1", "roc_auc", "average_precision")}
    dump(comparison, out / "comparison.json")
    return rows


