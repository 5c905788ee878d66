"""Command line: ``python -m tidewatch.cli --benign ... --tunnel ... --output ...``"""

from __future__ import annotations

import argparse

from .plans import config as C


def _words(kind=str):
    return lambda text: [kind(x) for x in text.replace(",", " ").split()]


#: Option, setting, and how it is read.
OPTIONS = (
    ("--benign", "input.benign_path", str), ("--tunnel", "input.tunnel_path", str), ("--format", "input.format", str), ("--encoding", "input.encoding", str),
    ("--output", "output_dir", str), ("--data-origin", "data_origin", str), ("--seed", "random_seed", int),
    ("--split", "split.strategy", str), ("--test-size", "split.test_size", float), ("--chronological-mode", "split.chronological_mode", str), ("--manifest", "split.manifest_path", str),
    ("--windows", "windows.sizes", _words(float)), ("--history-policy", "windows.history_policy", str),
    ("--models", "models.enabled", _words()), ("--balancing", "balancing.method", str), ("--sampling-strategy", "balancing.sampling_strategy", str), ("--class-weight", "balancing.class_weight", str),
    ("--feature-set", "features.feature_set", str), ("--exclude", "features.exclude", _words()), ("--threshold-mode", "threshold.mode", str), ("--threshold", "threshold.value", float),
    ("--n-jobs", "runtime.n_jobs", int),
)
SWITCHES = (
    ("--no-baseline", "run_baseline", False), ("--no-dedupe", "dedupe.enabled", False), ("--no-categorical", "features.include_categorical", False), ("--tune", "tuning.enabled", True),
    ("--no-plots", "outputs.save_plots", False), ("--no-models", "outputs.save_models", False),
)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    out.add_argument("--config", help="YAML file")
    out.add_argument("--overwrite", action="store_true", help="empty the output folder first")
    for name, setting, kind in OPTIONS:
        out.add_argument(name, dest=setting, type=kind, help=f"sets {setting}")
    for name, setting, value in SWITCHES:
        out.add_argument(name, dest=setting, action="store_const", const=value, help=f"sets {setting} to {value}")
    return out


def main(arguments: list[str] | None = None) -> int:
    given = vars(parser().parse_args(arguments))
    path, overwrite = given.pop("config"), given.pop("overwrite")
    config = C.check(C.override(C.load(path), given))
    from .plans.experiment import run
    from .session import configure, session

    for row in run(configure(session()), config, overwrite):
        print(f"{row['experiment_id']}: f1 {row['f1']:.4f}, roc_auc {row['roc_auc'] if row['roc_auc'] is not None else 'undefined'}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
