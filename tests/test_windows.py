"""Window features against a plain O(n^2) definition, and what must not change them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.windows import WINDOW_FEATURES, add_window_features, by_time_slices, window_features_with_history

COLUMNS = "event_id string, timestamp double, src_ip string, sld string, query string, subdomain string, dst_ip string, qtype_cat string, query_length int, query_entropy double, subdomain_length int, digit_ratio double, is_nxdomain int, num_answers double, ttl_mean double"


def event(i, t, src="A", sld="x", sub="aaa", q=None, **more):
    q = q or f"{sub}.{sld}"
    row = {
        "event_id": str(i), "timestamp": float(t), "src_ip": src, "sld": sld, "query": q, "subdomain": sub, "dst_ip": "d", "qtype_cat": "A", "query_length": len(q), "query_entropy": 1.0,
        "subdomain_length": len(sub), "digit_ratio": 0.0, "is_nxdomain": 0, "num_answers": 1.0, "ttl_mean": 5.0,
    }
    return row | more


def frame(spark, rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)


def plain(rows, seconds):
    out = {}
    w = round(seconds * 1e6)
    us = lambda r: round(r["timestamp"] * 1e6)
    for r in rows:
        group = [m for m in rows if (m["src_ip"], m["sld"]) == (r["src_ip"], r["sld"])]
        members = sorted((m for m in group if us(m) > us(r) - w and (us(m), m["event_id"]) <= (us(r), r["event_id"])), key=lambda m: (us(m), m["event_id"]))
        n = len(members)
        col = lambda c: [m[c] for m in members]
        mean = lambda xs: math.fsum(xs) / len(xs)
        std = lambda xs: math.sqrt(max(math.fsum((x - mean(xs)) ** 2 for x in xs) / len(xs), 0)) if len(xs) > 1 else 0.0
        some = lambda xs: (lambda ys: mean(ys) if ys else None)([x for x in xs if x is not None])
        gaps = [(us(b) - us(a)) / 1e6 for a, b in zip(members, members[1:], strict=False)]
        queries, subs = len(set(col("query"))), len({s for s in col("subdomain") if s})
        out[r["event_id"]] = [
            n, n / seconds, queries, queries / n, subs, subs / n, mean(col("query_length")), std(col("query_length")), max(col("query_length")), mean(col("query_entropy")), std(col("query_entropy")),
            mean(col("subdomain_length")), mean(col("digit_ratio")), sum(col("is_nxdomain")), mean(col("is_nxdomain")), len(set(col("qtype_cat"))), len({d for d in col("dst_ip") if d}),
            some(col("num_answers")), some(col("ttl_mean")), mean(gaps) if gaps else seconds, std(gaps),
        ]
    return out


def got(df, suffix=""):
    return {r["event_id"]: [r[f + suffix] for f in WINDOW_FEATURES] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for name, x, y in zip(WINDOW_FEATURES, a[k], b[k], strict=True):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (k, name, x, y)


def random_rows(n=300, seed=3):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.3 else x
    return [
        event(
            f"{i:04d}", round(rng.uniform(0, 120), 1), rng.choice("ABC"), rng.choice("xy"), rng.choice(["", "aa", "bbb", "cccc"]), dst_ip=maybe(rng.choice("pq")), qtype_cat=rng.choice(["A", "MISSING", "TXT"]),
            query_entropy=rng.random(), digit_ratio=rng.random(), is_nxdomain=rng.randrange(2), num_answers=maybe(float(rng.randrange(4))), ttl_mean=maybe(rng.random() * 100),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seconds", [5, 15, 60, 0.5])
def test_against_plain(spark, seconds):
    rows = random_rows()
    same(got(add_window_features(frame(spark, rows), seconds)), plain(rows, seconds))


def test_several_sizes_in_one_plan(spark):
    rows = random_rows(120)
    df = add_window_features(frame(spark, rows), [5, 5.5, 60])
    for size, suffix in ((5, "_5"), (5.5, "_5_5"), (60, "_60")):
        same(got(df, suffix), plain(rows, size))
    plan = add_window_features(frame(spark, rows), [5, 5.5, 60])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def counts(spark, rows, w):
    return [int(r["win_count"]) for r in add_window_features(frame(spark, rows), w).orderBy("timestamp", "event_id").collect()]


def test_boundaries_and_ties(spark):
    assert counts(spark, [event(i, t) for i, t in enumerate([0, 4.999, 5, 9.999, 10])], 5) == [1, 2, 2, 2, 2]
    assert counts(spark, [event(i, t) for i, t in enumerate([0, 5])], 5) == [1, 1]
    assert counts(spark, [event(i, t) for i, t in enumerate([0, 5])], 5.000001) == [1, 2]
    assert counts(spark, [event(i, 1) for i in "cab"], 5) == [1, 2, 3]
    groups = [event(0, 0, "A", "x"), event(1, 1, "B", "x"), event(2, 2, "A", "y"), event(3, 3, "A", "x")]
    assert counts(spark, groups, 60) == [1, 1, 1, 2]
    assert counts(spark, [event(0, 0, None, "x"), event(1, 1, None, "x")], 5) == [1, 2]


def test_constant_gaps_have_no_deviation(spark):
    rows = [event(f"{i:03d}", i * 28.994283) for i in range(60)]
    last = add_window_features(frame(spark, rows), 2000).orderBy(F.desc("timestamp")).first()
    assert last["win_iat_std"] == 0.0 and last["win_count"] == 60


def test_history(spark):
    train, test = [event(f"t{t}", t) for t in (6, 7, 8, 9, 12)], [event("z", 10)]
    alone = add_window_features(frame(spark, test), 5).first()
    carried = window_features_with_history(frame(spark, test), frame(spark, train), 5).collect()
    assert alone["win_count"] == 1 and len(carried) == 1 and carried[0]["win_count"] == 5


def test_future_and_order_do_not_matter(spark):
    rows = random_rows(150, 9)
    cut = [r for r in rows if r["timestamp"] < 60]
    full, part = got(add_window_features(frame(spark, rows), 15)), got(add_window_features(frame(spark, cut), 15))
    same({k: full[k] for k in part}, part)
    random.Random(1).shuffle(rows)
    same(got(add_window_features(frame(spark, rows).repartition(5), 15)), full)


def test_time_slices_give_the_same(spark):
    rows = random_rows(200, 5)
    same(got(by_time_slices(frame(spark, rows), 5, 20)), plain(rows, 5))


def test_errors_and_empty(spark):
    empty = frame(spark, [])
    assert add_window_features(empty, 5).collect() == []
    with pytest.raises(ValueError):
        add_window_features(empty, 0)
    with pytest.raises(ValueError, match="sld"):
        add_window_features(empty.drop("sld"), 5)
