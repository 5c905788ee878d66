"""Duplicates, train/test splits and their manifests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import SuffixRules, with_domain_parts
from ..sources.records import class_distribution

#: Fixed names: fields that make two records the same.
CONTENT = (
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "query", "qtype_name", "rcode_name", "answers", "ttls",
    "rejected", "aa", "tc", "rd", "ra",
)
MANIFEST = ("event_id", "subset", "label", "source_file", "source_line", "timestamp")
#: Ranges into which a boundary search cuts the keys, and the number of keys that one task then sorts.
RANGES = 256
FEW = 1 << 17


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows alike in ``keys`` (nulls are alike) the first in ``order``. The order must be total among them.

    A minimum per key is combined before the shuffle, so a row repeated very often does not gather in a task.
    """
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(first.alias("_row")).select("_row.*")


def deduplicate(events: DataFrame, content: Sequence[str] = CONTENT, order: Sequence[str] = ("label", "source_line", "event_id")) -> DataFrame:
    """First events of equal content and label, with ``label_conflict``: the content occurs under both labels."""
    first = keep_first(events, [*content, "label"], order)
    labels = first.groupBy(*[F.col(c).alias(f"_k_{c}") for c in content]).agg((F.min("label") != F.max("label")).alias("label_conflict"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in content]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return first.join(labels.where("label_conflict"), condition, "left").select(*events.columns, F.coalesce("label_conflict", F.lit(False)).alias("label_conflict"))


def dedupe_report(events: DataFrame, kept: DataFrame) -> dict:
    before = {r["label"]: r["count"] for r in events.groupBy("label").count().collect()}
    after = {r["label"]: (r["n"], r["c"]) for r in kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("label_conflict").alias("c")).collect()}
    removed = {k: before[k] - after[k][0] for k in before}
    return {
        "n_before": sum(before.values()), "n_duplicates_removed": sum(removed.values()), "removed_benign": removed.get(0, 0), "removed_tunnel": removed.get(1, 0),
        "n_after": sum(n for n, _ in after.values()), "label_conflict_events": sum(c for _, c in after.values()),
        "definition": "equal content and label; the first one stays",
    }


def _prefix_nth(ids: DataFrame, n: int, few: int) -> str:
    """The n-th smallest id, one character after the other: only the ids that share the prefix found so far are counted."""
    prefix = ""
    while True:
        longer = F.substring("_id", 1, len(prefix) + 1)
        found = ids.where(F.startswith("_id", F.lit(prefix))).groupBy(longer.alias("start")).count().collect()
        for start, size in sorted(((r["start"], r["count"]) for r in found), key=lambda r: r[0].encode()):
            if n <= size:
                break
            n -= size
        if start == prefix:
            return start
        prefix = start
        if size <= few:
            return ids.where(F.startswith("_id", F.lit(prefix))).orderBy("_id").offset(n - 1).first()["_id"]


def _nth(keys: DataFrame, size: int, n: int, few: int) -> tuple[float, str]:
    """The n-th smallest (_at, _id) of ``size`` keys, exactly, without a sort of them all.

    Approximate quantiles cut the keys into ranges, a cut's own value being a range of its own; the counts tell which range holds
    the n-th key, and only that one is cut again, until it has at most ``few`` keys. Equal ``_at`` beyond that number go by the id's prefixes.
    """
    while size > few:
        marks = keys.agg(F.percentile_approx("_at", [k / RANGES for k in range(1, RANGES)], 10_000).alias("c")).first()["c"]
        cuts = list(dict.fromkeys(marks))
        array = F.array(*[F.lit(c) for c in cuts])
        place = F.size(F.filter(array, lambda c: c < F.col("_at"))) + F.size(F.filter(array, lambda c: c <= F.col("_at")))
        placed = keys.withColumn("_range", place)
        for at, size in sorted((r["_range"], r["count"]) for r in placed.groupBy("_range").count().collect()):
            if n <= size:
                break
            n -= size
        keys = placed.where(F.col("_range") == at).drop("_range")
        if at % 2 and size > few:
            return cuts[at // 2], _prefix_nth(keys, n, few)
    return tuple(keys.select("_at", "_id").orderBy("_at", "_id").offset(n - 1).first())


def first_share(events: DataFrame, key: Column, by: Sequence[str], n_of, few: int = FEW) -> Column:
    """True for the first ``n_of(size)`` events of each ``by`` in the order of ``key`` and id (null first).

    ``by`` has few values, as labels do. The events are read for the boundaries; what comes back is a comparison with these, so
    the marked table needs no shuffle. Events equal in key and id fall to one side.
    """
    at, name = F.coalesce(key.cast("double"), F.lit(float("-inf"))), F.coalesce(F.col("event_id").cast("string"), F.lit(""))
    keys = events.select(*by, at.alias("_at"), name.alias("_id"))
    taken = F.lit(False)
    for row in keys.groupBy(*by).count().collect():
        here = F.lit(True)
        for b in by:
            here = here & F.col(b).eqNullSafe(F.lit(row[b]))
        n = n_of(row["count"])
        if n > 0:
            last, last_id = _nth(keys.where(here), row["count"], n, few)
            taken = taken | (here & ((at < last) | ((at == last) & (name <= F.lit(last_id)))))
    return taken


def assign_subset(
    events: DataFrame, strategy: str = "stratified_random", test_size: float = 0.3, seed: int = 42, chronological_mode: str = "global",
    group: str | None = None, rules: SuffixRules | None = None,
) -> DataFrame:
    """Events with ``subset`` train or test.

    ``stratified_random``: per label, the events with the smallest hashes of seed and id; exact shares. ``chronological``: by time and id, the
    last share of all or of each label. ``group_sld``: whole domains. Both subsets must hold both labels.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    if strategy == "stratified_random":
        key = F.pmod(F.xxhash64(F.lit(seed), "event_id"), F.lit(1 << 52))
        taken = first_share(events, key, ["label"], lambda n: n - math.ceil(n * test_size))
        out = events.withColumn("subset", F.when(taken, "train").otherwise("test"))
    elif strategy == "chronological":
        if chronological_mode not in ("global", "per_class"):
            raise ValueError(f"unknown chronological_mode {chronological_mode!r}")
        by = ["label"] if chronological_mode == "per_class" else []
        taken = first_share(events, F.col("timestamp"), by, lambda n: math.floor(n * (1.0 - test_size)))
        out = events.withColumn("subset", F.when(taken, "train").otherwise("test"))
    elif strategy == "group_sld":
        named = events.withColumn("_group", F.col(group)) if group else with_domain_parts(events, "query", rules, "_p").withColumn("_group", F.col("_p.registrable")).drop("_p")
        chosen = test_groups(named, "_group", test_size, seed).withColumnRenamed("group", "_chosen")
        out = named.join(chosen, F.col("_group").eqNullSafe(F.col("_chosen")), "left")
        out = out.withColumn("subset", F.when(F.col("taken"), "test").otherwise("train")).drop("_group", "_chosen", "taken")
    else:
        raise ValueError(f"unknown split strategy {strategy!r}")
    check_both_classes(out, strategy)
    return out


def test_groups(events: DataFrame, group: str, test_size: float, seed: int) -> DataFrame:
    """(group, taken) of the groups that go to the test subset, by a greedy walk in hash order.

    A group is taken if no label then exceeds its share; a label that gets none takes the smallest group that holds it. One row per group
    reaches the driver, and each group's counts only; the walk has no parallel form.
    """
    counts = events.groupBy(F.col(group).alias("group")).agg(F.count_if(F.col("label") == 0).alias("c0"), F.count_if(F.col("label") == 1).alias("c1"))
    rows = counts.orderBy(F.xxhash64(F.lit(seed), "group"), "group").toLocalIterator()
    rows = [(r["group"], (r["c0"], r["c1"])) for r in rows]
    target = [test_size * sum(c[k] for _, c in rows) for k in (0, 1)]
    got, taken = [0, 0], set()
    for name, c in rows:
        if all(got[k] + c[k] <= target[k] for k in (0, 1)):
            taken.add(name)
            got = [got[0] + c[0], got[1] + c[1]]
    for k in (0, 1):
        left = sorted((c[k], str(name), name, c) for name, c in rows if c[k] and name not in taken)
        if not got[k] and left:
            _, _, name, c = left[0]
            taken.add(name)
            got = [got[0] + c[0], got[1] + c[1]]
    spark = events.sparkSession
    return spark.createDataFrame([(n, True) for n in taken], f"group {dict(counts.dtypes)['group']}, taken boolean")


def check_both_classes(events: DataFrame, strategy: str) -> None:
    rows = events.groupBy("subset").agg(F.collect_set("label").alias("labels")).collect()
    found = {r["subset"]: sorted(r["labels"]) for r in rows}
    for subset in ("train", "test"):
        if found.get(subset, []) != [0, 1]:
            raise ValueError(
                f"the {subset} subset of the {strategy} split has the classes {found.get(subset, [])}; both are needed. Files of different periods ask for "
                "chronological_mode=per_class or a stratified split, group_sld for several distinct SLDs per class."
            )


def build_manifest(split: DataFrame) -> DataFrame:
    return split.select(*MANIFEST)


def apply_manifest(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Events with the subset that the manifest names. Ids it lacks, or other subsets than train and test, raise; ids it has more are ignored."""
    known = manifest.select("event_id", "subset").dropDuplicates(["event_id"])
    out = events.drop("subset").join(known, "event_id", "left")
    row = out.agg(F.count_if(F.col("subset").isNull()).alias("missing"), F.collect_set(F.when(~F.col("subset").isin("train", "test"), F.col("subset"))).alias("odd")).first()
    if row["missing"]:
        raise ValueError(f"{row['missing']} events are not in the split manifest")
    if row["odd"]:
        raise ValueError(f"the manifest has unknown subsets {sorted(row['odd'])}")
    check_both_classes(out, "manifest")
    return out


def write_manifest(split: DataFrame, path: str) -> None:
    build_manifest(split).write.mode("overwrite").csv(path, header=True)


def read_manifest(spark, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="event_id string, subset string, label int, source_file string, source_line bigint, timestamp double")


def subset_summary(split: DataFrame) -> DataFrame:
    """Class distribution, first and last time of each subset."""
    times = split.groupBy(F.col("subset").alias("_s")).agg(F.min("timestamp").alias("time_min"), F.max("timestamp").alias("time_max"))
    return class_distribution(split, "subset").join(times, F.col("subset") == F.col("_s")).drop("_s")


def summarize_split(split: DataFrame, strategy: str, test_size: float, seed: int) -> dict:
    parts = {r["subset"]: r.asDict() for r in subset_summary(split).collect()}
    total = sum(p["total"] for p in parts.values())
    both = split.groupBy("event_id").agg(F.count_distinct("subset").alias("n")).where("n > 1").count()
    return {
        "strategy": strategy, "requested_test_size": test_size, "actual_test_fraction": parts["test"]["total"] / total if total and "test" in parts else None,
        "random_seed": seed, "train": parts.get("train"), "test": parts.get("test"), "overlap_event_ids": both,
    }
