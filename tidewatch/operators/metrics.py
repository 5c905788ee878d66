"""Exact classification metrics as aggregates over (label, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group's scores.
RANGES = 256
NAMES = {0: "benign", 1: "dns_tunneling"}


def confusion(scored: DataFrame, threshold: float = 0.5, *by: str) -> DataFrame:
    """tn, fp, fn, tp, accuracy, precision, recall, f1 and false positive rate; undefined precision and recall are 0."""
    y, hit = F.col("label") == 1, F.col("score") >= F.lit(float(threshold))
    counts = scored.groupBy(*by).agg(F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(y & hit).alias("tp"))
    d = lambda a, b: F.when(b > 0, a.cast("double") / b.cast("double"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.withColumns(
        {
            "accuracy": d(tp + tn, tp + tn + fp + fn), "precision": zero(d(tp, tp + fp)), "recall": zero(d(tp, tp + fn)),
            "f1": zero(d(2 * tp, 2 * tp + fp + fn)), "false_positive_rate": d(fp, fp + tn),
        }
    )


def score_curve(scored: DataFrame, *by: str) -> DataFrame:
    """Per distinct score, from the highest: positives and negatives at it, at or above it, and in all.

    Rows are summed per score first. Approximate quantiles cut each group's distinct scores into ``RANGES`` ranges; running sums
    run within a range, and the sums of the ranges above are added, so no task sees all scores of a group.
    """
    per = scored.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).cast("double").alias("p"), F.count_if(F.col("label") == 0).cast("double").alias("n"))
    per = per.withColumn("_by", F.to_json(F.struct(*by)) if by else F.lit(""))
    cuts = per.groupBy("_by").agg(F.percentile_approx(F.col("score").cast("double"), [k / RANGES for k in range(1, RANGES)], 10_000).alias("_cuts"))
    below = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("score").cast("double"))), F.lit(0))
    placed = per.join(F.broadcast(cuts), "_by").withColumn("_range", below).drop("_cuts")
    sums = placed.groupBy("_by", "_range").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    whole = Window.partitionBy("_by")
    above = whole.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = sums.select(
        "_by", "_range", zero(F.sum("p").over(above)).alias("_tp"), zero(F.sum("n").over(above)).alias("_fp"), F.sum("p").over(whole).alias("pos"), F.sum("n").over(whole).alias("neg")
    )
    down = Window.partitionBy("_by", "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down)}).join(F.broadcast(sums), ["_by", "_range"])
    return out.select(*by, "score", "p", "n", (F.col("tp") + F.col("_tp")).alias("tp"), (F.col("fp") + F.col("_fp")).alias("fp"), "pos", "neg")


def roc_auc(scored: DataFrame, *by: str) -> DataFrame:
    """Area under the ROC curve with ties at half; null if a class is missing."""
    curve = score_curve(scored, *by)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    total = F.max("pos") * F.max("neg")
    return curve.groupBy(*by).agg(F.when(total > 0, area / total).alias("roc_auc"))


def average_precision(scored: DataFrame, *by: str) -> DataFrame:
    """Sum of precision times the gain in recall, over distinct scores; null without positives."""
    curve = score_curve(scored, *by)
    return curve.groupBy(*by).agg(F.when(F.max("pos") > 0, F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("pos")).alias("average_precision"))


def pr_points(scored: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at each distinct score."""
    curve = score_curve(scored)
    return curve.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).alias("recall"))


def roc_points(scored: DataFrame) -> DataFrame:
    """(threshold, false positive rate, true positive rate) at each distinct score."""
    curve = score_curve(scored)
    return curve.select(F.col("score").alias("threshold"), F.when(F.col("neg") > 0, F.col("fp") / F.col("neg")).alias("fpr"), F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).alias("tpr"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """One row (threshold, f1): the lowest score of the highest F1; 0.5 and null without rows."""
    points = pr_points(scored).where("recall IS NOT NULL")
    both = F.col("precision") + F.col("recall")
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(both, F.lit(1e-12))
    best = points.select("threshold", f1.alias("f1")).agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"), F.col("b.f1").alias("f1"))


def all_metrics(scored: DataFrame, threshold: float = 0.5) -> dict:
    """Every scalar metric; notes say why a ranking metric is undefined."""
    scored = scored.select(F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"))
    row = confusion(scored, threshold).first().asDict() | roc_auc(scored).first().asDict() | average_precision(scored).first().asDict()
    one = not (row["tp"] + row["fn"]) or not (row["tn"] + row["fp"])
    row["roc_auc_note"] = "undefined: one class only" if one else ""
    row["average_precision_note"] = "" if row["tp"] + row["fn"] else "undefined: no positive samples"
    return {"threshold": float(threshold)} | row


def classification_report(m: dict) -> dict:
    """Precision, recall, F1 and support by class, their plain and weighted means, and accuracy, from the confusion counts."""
    safe = lambda a, b: a / b if b else 0.0
    out = {}
    for name, hit, miss, wrong in ((NAMES[0], m["tn"], m["fp"], m["fn"]), (NAMES[1], m["tp"], m["fn"], m["fp"])):
        out[name] = {"precision": safe(hit, hit + wrong), "recall": safe(hit, hit + miss), "f1-score": safe(2 * hit, 2 * hit + miss + wrong), "support": hit + miss}
    total = sum(c["support"] for c in out.values())
    keys = ("precision", "recall", "f1-score")
    classes = list(out.values())
    return out | {
        "accuracy": safe(m["tn"] + m["tp"], total),
        "macro avg": {k: sum(c[k] for c in classes) / 2 for k in keys} | {"support": total},
        "weighted avg": {k: safe(sum(c[k] * c["support"] for c in classes), total) for k in keys} | {"support": total},
    }


def report_text(report: dict) -> str:
    lines = [f"{'':>14}{'precision':>11}{'recall':>11}{'f1-score':>11}{'support':>11}"]
    for name, row in report.items():
        if isinstance(row, dict):
            lines.append(f"{name:>14}" + "".join(f"{row[k]:>11.4f}" for k in ("precision", "recall", "f1-score")) + f"{row['support']:>11}")
        else:
            lines.append(f"{name:>14}{'':>22}{row:>11.4f}")
    return "\n".join(lines) + "\n"
