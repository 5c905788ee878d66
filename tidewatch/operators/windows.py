"""Trailing time windows per (source, domain), exact to the microsecond and to ties.

The window of an event holds the events of its group with ``t - W < time <= t`` that do not come after it in the order of
time and event id. A RANGE frame ends before the event's own microsecond, a ROWS frame within (group, microsecond) adds
the ties before it; their sum needs no add-and-evict state. Distinct values are counted by the events at which a
value enters the window and those at which it leaves. One shuffle by group serves every window size: all
expressions of a kind share one Window operator for all sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed names and order.
WINDOW_FEATURES = (
    "win_count", "win_query_rate", "win_unique_queries", "win_unique_query_ratio", "win_unique_subdomains",
    "win_unique_subdomain_ratio", "win_query_len_mean", "win_query_len_std", "win_query_len_max", "win_entropy_mean",
    "win_entropy_std", "win_subdomain_len_mean", "win_digit_ratio_mean", "win_nxdomain_count", "win_nxdomain_ratio",
    "win_unique_qtypes", "win_unique_dst_ips", "win_answers_mean", "win_ttl_mean", "win_iat_mean", "win_iat_std",
)
#: Fixed names of the columns a window reads; the label is none of them.
WINDOW_INPUT = (
    "event_id", "timestamp", "src_ip", "sld", "query", "subdomain", "dst_ip", "qtype_cat", "query_length",
    "query_entropy", "subdomain_length", "digit_ratio", "is_nxdomain", "num_answers", "ttl_mean",
)
#: Variances of floating sums up to this are rounding.
NO_VARIANCE = 1e-12
DISTINCT = {"queries": "query", "subdomains": "subdomain", "qtypes": "qtype_cat", "dst_ips": "dst_ip"}
GROUP = ("src_ip", "sld")


def microseconds(seconds: Column) -> Column:
    return F.rint(seconds * 1e6).cast("long")


def window_us(seconds: float) -> int:
    if not seconds > 0:
        raise ValueError("a window must be longer than 0 seconds")
    return int(round(seconds * 1e6))


def window_label(seconds: float) -> str:
    """A name that keeps fractions: 5 and 5.5 differ."""
    return f"{seconds:g}".replace(".", "_")


def _flags(events: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Per distinct column and size: whether a value enters the window at this event, and whether it leaves W later."""
    out = events
    for name, column in DISTINCT.items():
        by_value = Window.partitionBy(*GROUP, column).orderBy("_us", "event_id")
        out = out.withColumns({f"_before_{name}": F.lag("_us").over(by_value), f"_after_{name}": F.lead("_us").over(by_value)})
    new = {}
    for name, column in DISTINCT.items():
        counts = (F.col(column) != "") if name == "subdomains" else F.col(column).isNotNull()
        counts = F.coalesce(counts, F.lit(False))
        before, after = F.col(f"_before_{name}"), F.col(f"_after_{name}")
        for label, w in sizes.items():
            new[f"_in_{name}_{label}"] = (counts & (before.isNull() | (F.col("_us") - before >= w))).cast("int")
            new[f"_out_{name}_{label}"] = (counts & (after.isNull() | (after - F.col("_us") >= w))).cast("int")
    return out.withColumns(new)


def add_window_features(events: DataFrame, seconds: float | Sequence[float], suffix: bool | None = None) -> DataFrame:
    """Events with the 21 window features for each size; with several sizes, names end in the size.

    Needs the columns ``WINDOW_INPUT``; all others are passed on. Null group keys are groups of their own. Means of answers and
    TTLs are over events that have them, null without any. A group lies in one task: if one (source, domain)
    pair makes up much of the data, cut it by time with an overlap of the largest size first (:func:`by_time_slices`).
    """
    several = not isinstance(seconds, (int, float))
    sizes = {window_label(s): s for s in (seconds if several else [seconds])}
    us = {label: window_us(s) for label, s in sizes.items()}
    missing = [c for c in WINDOW_INPUT if c not in events.columns]
    if missing:
        raise ValueError(f"window features need the columns {missing}")
    suffix = several if suffix is None else suffix
    base = events.withColumn("_us", microseconds(F.col("timestamp")))
    gap = F.col("_us") - F.lag("_us").over(Window.partitionBy(*GROUP).orderBy("_us", "event_id"))
    base = _flags(base, us).withColumn("_gap", gap)
    length = F.col("query_length").cast("long")
    sums = {
        "n": F.lit(1).cast("long"), "len": length, "len2": length * length, "ent": F.col("query_entropy").cast("double"),
        "ent2": F.col("query_entropy").cast("double") * F.col("query_entropy").cast("double"), "sub": F.col("subdomain_length").cast("double"),
        "dig": F.col("digit_ratio").cast("double"), "nx": F.col("is_nxdomain").cast("long"),
        "ans": F.col("num_answers").cast("double"), "ans_n": F.col("num_answers").isNotNull().cast("long"),
        "ttl": F.col("ttl_mean").cast("double"), "ttl_n": F.col("ttl_mean").isNotNull().cast("long"),
    }
    base = base.withColumns({f"_v_{k}": v for k, v in sums.items()})
    for label, w in us.items():  # a gap as long as the window lies outside it: its square need not be held
        square = F.when(F.col("_gap") < w, F.col("_gap").cast("decimal(19,0)") * F.col("_gap").cast("decimal(19,0)")).otherwise(F.lit(0))
        base = base.withColumn(f"_g2_{label}", square.cast("decimal(38,0)"))
    group = Window.partitionBy(*GROUP).orderBy("_us")
    ties = Window.partitionBy(*GROUP, "_us").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(*GROUP).orderBy("_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = {label: group.rangeBetween(-(w - 1), -1) for label, w in us.items()}
    first = lambda label: F.min(F.struct("_us", "event_id", F.col(f"_g2_{label}").alias("g2")))
    new: dict[str, Column] = {}
    for label in us:
        for k in sums:
            new[f"_a_{k}_{label}"] = F.sum(f"_v_{k}").over(earlier[label])
        new[f"_a_g2_{label}"] = F.sum(f"_g2_{label}").over(earlier[label])
        new[f"_a_max_{label}"] = F.max("_v_len").over(earlier[label])
        new[f"_a_first_{label}"] = first(label).over(earlier[label])
    for k in sums:
        new[f"_b_{k}"] = F.sum(f"_v_{k}").over(ties)
    new["_b_max"] = F.max("_v_len").over(ties)
    for label in us:
        new[f"_b_g2_{label}"] = F.sum(f"_g2_{label}").over(ties)
        new[f"_b_first_{label}"] = first(label).over(ties)
    for label, w in us.items():
        gone = group.rangeBetween(Window.unboundedPreceding, -w)
        for name in DISTINCT:
            new[f"_d_{name}_{label}"] = F.sum(f"_in_{name}_{label}").over(order) - F.coalesce(F.sum(f"_out_{name}_{label}").over(gone), F.lit(0))
    wide = base.withColumns(new)
    out = {}
    for label, size in sizes.items():
        end = f"_{label}" if suffix else ""
        out |= {f"{k}{end}": v for k, v in _features(label, float(size)).items()}
    return wide.withColumns(out).select(*events.columns, *out)


def _features(label: str, seconds: float) -> dict[str, Column]:
    both = lambda k: F.coalesce(F.col(f"_a_{k}_{label}"), F.lit(0)) + F.coalesce(F.col(f"_b_{k}"), F.lit(0))
    n = both("n")
    whole = n.cast("double")
    mean = lambda k: both(k).cast("double") / whole
    own_mean = lambda k: F.when(both(f"{k}_n") > 0, both(k) / both(f"{k}_n"))
    exact = both("len2").cast("decimal(38,0)") * n.cast("decimal(19,0)") - both("len").cast("decimal(19,0)") * both("len").cast("decimal(19,0)")
    spread = both("ent2") / whole - mean("ent") * mean("ent")
    first = F.coalesce(F.col(f"_a_first_{label}"), F.col(f"_b_first_{label}"))
    gaps = (n - 1).cast("decimal(19,0)")
    squares = F.coalesce(F.col(f"_a_g2_{label}"), F.lit(0)).cast("decimal(38,0)") + F.col(f"_b_g2_{label}").cast("decimal(38,0)") - first["g2"].cast("decimal(38,0)")
    span = (F.col("_us") - first["_us"]).cast("decimal(19,0)")
    numerator = (squares.cast("decimal(38,0)") * gaps).cast("decimal(38,0)") - (span * span).cast("decimal(38,0)")
    distinct = {name: F.col(f"_d_{name}_{label}").cast("double") for name in DISTINCT}
    return {
        "win_count": whole,
        "win_query_rate": whole / seconds,
        "win_unique_queries": distinct["queries"],
        "win_unique_query_ratio": distinct["queries"] / whole,
        "win_unique_subdomains": distinct["subdomains"],
        "win_unique_subdomain_ratio": distinct["subdomains"] / whole,
        "win_query_len_mean": mean("len"),
        "win_query_len_std": F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest(exact.cast("double"), F.lit(0.0))) / whole),
        "win_query_len_max": F.greatest(F.col(f"_a_max_{label}"), F.col("_b_max")).cast("double"),
        "win_entropy_mean": mean("ent"),
        "win_entropy_std": F.when((n >= 2) & (spread > NO_VARIANCE), F.sqrt(spread)).otherwise(0.0),
        "win_subdomain_len_mean": mean("sub"),
        "win_digit_ratio_mean": mean("dig"),
        "win_nxdomain_count": both("nx").cast("double"),
        "win_nxdomain_ratio": mean("nx"),
        "win_unique_qtypes": distinct["qtypes"],
        "win_unique_dst_ips": distinct["dst_ips"],
        "win_answers_mean": own_mean("ans"),
        "win_ttl_mean": own_mean("ttl"),
        "win_iat_mean": F.when(n < 2, seconds).otherwise(span.cast("double") / (whole - 1) / 1e6),
        "win_iat_std": F.when(n < 3, 0.0).otherwise(F.sqrt(F.greatest(numerator.cast("double"), F.lit(0.0))) / (whole - 1) / 1e6),
    }


def window_features_with_history(target: DataFrame, history: DataFrame, seconds: float | Sequence[float]) -> DataFrame:
    """Features of ``target`` whose windows may reach into ``history``; rows of the history are not returned."""
    both = history.select(*WINDOW_INPUT, F.lit(False).alias("_target")).unionByName(target.select(*WINDOW_INPUT, F.lit(True).alias("_target")))
    found = add_window_features(both, seconds).where("_target").drop("_target")
    return found


def by_time_slices(events: DataFrame, seconds: float, slice_seconds: float) -> DataFrame:
    """:func:`add_window_features` for one size where a single group is too large for a task.

    Each group is cut into slices of time that are groups of their own; events of the last ``seconds`` before a slice are
    added to it as history and dropped after. Slices must be longer than the window, so an event is copied once at most.
    """
    if slice_seconds <= seconds:
        raise ValueError("slices must be longer than the window")
    w, step = window_us(seconds), int(round(slice_seconds * 1e6))
    us = microseconds(F.col("timestamp"))
    own = F.floor(us / F.lit(step)).cast("long")
    inner = (own + 1) * step - us < w
    places = F.when(inner, F.array(F.struct(own.alias("s"), F.lit(True).alias("own")), F.struct((own + 1).alias("s"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(own.alias("s"), F.lit(True).alias("own")))
    )
    dealt = events.withColumn("_slice", F.explode(places)).withColumn("_sld", F.col("sld"))
    dealt = dealt.withColumn("sld", F.to_json(F.struct("sld", "_slice.s")))
    found = add_window_features(dealt, seconds).where("_slice.own")
    return found.withColumn("sld", F.col("_sld")).drop("_slice", "_sld")
