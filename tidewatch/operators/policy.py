"""Which features a configuration uses, and audits of what may leak the label."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import BINARY, CATEGORICAL, CONTINUOUS, check_no_metadata
from .metrics import roc_auc
from .windows import WINDOW_FEATURES

#: Features that a raw field gives.
FIELD_FEATURES = {
    "answers": ["num_answers", "win_answers_mean"],
    "ttls": ["num_ttls", "ttl_min", "ttl_max", "ttl_mean", "win_ttl_mean"],
    "aa": ["flag_aa"], "tc": ["flag_tc"], "rd": ["flag_rd"], "ra": ["flag_ra"], "rejected": ["rejected_flag"],
    "rcode_name": ["rcode_cat", "is_nxdomain", "win_nxdomain_count", "win_nxdomain_ratio"],
    "qtype_name": ["qtype_cat", "win_unique_qtypes"],
    "proto": ["proto_cat"],
    "dst_ip": ["win_unique_dst_ips"],
}
FEATURE_SETS = ("all", "query_only")
EVENT_FEATURES = (*CONTINUOUS, *BINARY, *CATEGORICAL)
LABELS = {0: "benign", 1: "tunnel"}


@dataclass
class Selection:
    """Features of one configuration in order, and the first reason for each one dropped."""

    continuous: list[str]
    binary: list[str]
    categorical: list[str]
    window: list[str]
    dropped: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.continuous + self.binary + self.categorical


def select_features(windows: bool, categorical: bool = True, feature_set: str = "all", exclude: Iterable[str] = (), artifact_fields: Iterable[str] = ()) -> Selection:
    """Reasons apply in order: no categorical features, query features only, named ones, schema artefacts."""
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"feature_set must be one of {FEATURE_SETS}")
    exclude = list(exclude)
    odd = sorted(set(exclude) - {*EVENT_FEATURES, *WINDOW_FEATURES})
    if odd:
        raise ValueError(f"unknown features to exclude: {odd}")
    reasons = [(n, "features.include_categorical=false") for n in CATEGORICAL if not categorical]
    reasons += [(n, "features.feature_set=query_only") for names in FIELD_FEATURES.values() for n in names if feature_set == "query_only"]
    reasons += [(n, "features.exclude") for n in exclude]
    reasons += [(n, f"schema_artifact:{f}") for f in artifact_fields for n in FIELD_FEATURES.get(f, [])]
    dropped: dict[str, str] = {}
    candidates = {*EVENT_FEATURES, *(WINDOW_FEATURES if windows else ())}
    for name, reason in reasons:
        if name in candidates:
            dropped.setdefault(name, reason)
    left = lambda names: [n for n in names if n not in dropped]
    window = left(WINDOW_FEATURES) if windows else []
    out = Selection(left(CONTINUOUS) + window, left(BINARY), left(CATEGORICAL), window, dropped)
    if not out.columns:
        raise ValueError("the feature policy leaves no features")
    check_no_metadata(out.columns)
    return out


def _unpivot(rows: DataFrame, names: Sequence[str], value, keep: Sequence[str] = ("label",)) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), value(n).alias("value")) for n in names])
    return rows.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.name", "p.value")


def schema_audit(train: DataFrame, threshold: float = 0.5, fields: Sequence[str] | None = None) -> DataFrame:
    """(field, presence_benign, presence_tunnel, abs_difference, flagged): a field whose presence alone tells the class."""
    fields = [f for f in (fields or FIELD_FEATURES) if f in train.columns]
    shares = {f"{f}|{k}": F.avg(F.when(F.col("label") == k, F.col(f).isNotNull().cast("double"))) for f in fields for k in (0, 1)}
    row = train.agg(*[c.alias(n) for n, c in shares.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}|0`").alias("presence_benign"), F.col(f"`{f}|1`").alias("presence_tunnel")) for f in fields])
    out = row.select(F.inline(rows)).withColumn("abs_difference", F.abs(F.col("presence_tunnel") - F.col("presence_benign")))
    return out.withColumn("flagged", F.coalesce(F.col("abs_difference") >= threshold, F.lit(False)))


def feature_aucs(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, auc) of each feature alone, missing values at its median, at least one half; 0.5 for constants.

    All features are ranked in one pass over (feature, distinct value).
    """
    medians = train.agg(*[F.median(F.col(n).cast("double")).alias(n) for n in names]).first().asDict()
    filled = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(medians[n]).cast("double"), F.lit(0.0))
    long = _unpivot(train, names, filled).withColumnRenamed("value", "score")
    auc = F.coalesce("roc_auc", F.lit(0.5))
    return roc_auc(long, "name").select("name", F.greatest(auc, 1 - auc).alias("auc"))


def category_purity(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, purity, n_categories): the share of rows that each category's larger class makes up."""
    long = _unpivot(train, names, lambda n: F.col(n).cast("string"))
    per = long.groupBy("name", "value").agg(F.count_if(F.col("label") == 0).alias("a"), F.count_if(F.col("label") == 1).alias("b"))
    return per.groupBy("name").agg((F.sum(F.greatest("a", "b")).cast("double") / F.sum(F.col("a") + F.col("b"))).alias("purity"), F.count(F.lit(1)).alias("n_categories"))


def tunnel_shares(train: DataFrame, name: str, n: int = 15) -> DataFrame:
    """(value, share) of the first categories in order."""
    return train.groupBy(F.col(name).cast("string").alias("value")).agg(F.avg((F.col("label") == 1).cast("double")).alias("share")).orderBy("value").limit(n)


def feature_vector(continuous: Sequence[str], binary: Sequence[str], categorical: Sequence[str]) -> Column:
    """What makes two rows equal to a model: numbers to six places (half to even), missing as -1, and categories."""
    numbers = [(F.bround(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(-1.0)), 6) + 0.0).alias(c) for c in (*continuous, *binary)]
    return F.struct(*numbers, *[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in categorical])


def duplicate_vectors(train: DataFrame, test: DataFrame, continuous, binary, categorical) -> dict:
    """Test rows by class whose vector is in train, vectors under both labels, and the share of distinct vectors in train."""
    vector = feature_vector(continuous, binary, categorical)
    both = train.select(vector.alias("v"), "label", F.lit(1).alias("own")).unionByName(test.select(vector.alias("v"), "label", F.lit(0).alias("own")))
    per = both.groupBy("v").agg(
        F.sum("own").alias("n_train"), F.count_if((F.col("own") == 0) & (F.col("label") == 0)).alias("t0"), F.count_if((F.col("own") == 0) & (F.col("label") == 1)).alias("t1"),
        (F.min("label") != F.max("label")).alias("mixed"),
    )
    seen = F.col("n_train") > 0
    row = per.agg(
        F.sum(F.when(seen, F.col("t0")).otherwise(0)).alias("s0"), F.sum("t0").alias("t0"), F.sum(F.when(seen, F.col("t1")).otherwise(0)).alias("s1"), F.sum("t1").alias("t1"),
        F.count_if("mixed").alias("mixed"), F.count_if(seen).alias("distinct"), F.sum("n_train").alias("n"),
    ).first()
    shares = {LABELS[k]: row[f"s{k}"] / row[f"t{k}"] for k in (0, 1) if row[f"t{k}"]}
    return {"test_rows_with_identical_vector_in_train": shares, "feature_vectors_with_both_labels": row["mixed"], "unique_vector_fraction_train": (row["distinct"] or 0) / max(row["n"] or 0, 1)}


def value_overlap(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(label, share) of test rows whose value occurs in train."""
    seen = train.select(F.col(column).alias("_seen")).distinct()
    marked = test.select("label", column).join(seen.withColumn("_in", F.lit(1.0)), F.col(column).eqNullSafe(F.col("_seen")), "left")
    return marked.groupBy("label").agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("share"))


def leakage_audit(train: DataFrame, test: DataFrame, continuous, binary, categorical, auc_flag=0.98, purity_flag=0.99, duplicate_flag=0.5, overlap_flag=0.9) -> dict:
    """Diagnostics of suspiciously good scores. AUC and purity look at train only; nothing is fitted or chosen by them."""
    warnings = []
    aucs = {r["name"]: r["auc"] for r in feature_aucs(train, [*continuous, *binary]).orderBy(F.desc("auc"), "name").limit(10).collect()} if [*continuous, *binary] else {}
    alone = [n for n, a in aucs.items() if a >= auc_flag]
    if alone:
        warnings.append(f"features that separate the classes alone: {', '.join(alone)}")
    purity = {}
    if categorical:
        for r in category_purity(train, categorical).collect():
            shares = {s["value"]: s["share"] for s in tunnel_shares(train, r["name"]).collect()}
            purity[r["name"]] = {"purity": r["purity"], "n_categories": r["n_categories"], "tunnel_share_by_category": shares}
            if r["purity"] >= purity_flag:
                warnings.append(f"the categories of {r['name']} nearly give the class")
    copies = duplicate_vectors(train, test, continuous, binary, categorical)
    for label, share in copies["test_rows_with_identical_vector_in_train"].items():
        if share >= duplicate_flag:
            warnings.append(f"{share:.0%} of the {label} test events equal a training event")
    if copies["feature_vectors_with_both_labels"]:
        warnings.append(f"{copies['feature_vectors_with_both_labels']} feature vectors occur with both labels")
    overlap = {f"{c}_overlap": {LABELS[r["label"]]: r["share"] for r in value_overlap(train, test, c).collect()} for c in ("query", "sld")}
    for label, share in overlap["sld_overlap"].items():
        if share >= overlap_flag:
            warnings.append(f"{share:.0%} of the {label} test events are of domains that train holds")
    return {
        "top_single_feature_auc_train": aucs, "categorical_purity_train": purity, "duplicates": copies, "overlap_test_in_train": overlap, "warnings": warnings,
        "thresholds": {"single_feature_auc": auc_flag, "category_purity": purity_flag, "duplicate_fraction": duplicate_flag, "sld_overlap": overlap_flag},
    }
