"""Made-up logs of ordinary and tunnelling clients, from row numbers and hashes, so any size is made in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, SPAN = 1_700_000_000.0, 1800.0


def _unit(seed: int, salt: int) -> Column:
    """A number in [0, 1) of the row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(1 << 40)) / float(1 << 40)


def _pick(values, unit: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(unit * len(values)).cast("int") + 1)


def _record(ts: Column, source: Column, query: Column, qtype: Column, rcode: Column, answers: Column, ttls: Column) -> Column:
    return F.to_json(
        F.struct(
            F.round(ts, 6).alias("ts"), source.alias("id.orig_h"), F.lit("10.0.0.53").alias("id.resp_h"), (F.col("id") % 60000 + 1024).alias("id.orig_p"), F.lit(53).alias("id.resp_p"),
            F.lit("udp").alias("proto"), query.alias("query"), qtype.alias("qtype"), rcode.alias("rcode"), answers.alias("answers"), ttls.alias("TTLs"),
            F.lit(False).alias("AA"), F.lit(False).alias("TC"), F.lit(True).alias("RD"), F.lit(True).alias("RA"), F.lit(False).alias("rejected"),
        )
    )


def benign_records(spark: SparkSession, n: int = 7000, seed: int = 42) -> DataFrame:
    """(id, value): JSON lines; few domains are asked often, some names do not exist."""
    u = lambda k: _unit(seed, k)
    domain = F.concat(F.lit("site"), F.floor(F.pow(u(1), 3.0) * 120).cast("string"), _pick([".com", ".net", ".org", ".co.uk", ".io"], u(2)))
    query = F.concat(_pick(["www", "api", "cdn", "mail", "img", "static"], u(3)), F.lit("."), domain)
    missing = u(4) < 0.05
    answers = F.when(missing, F.expr("CAST(array() AS array<string>)")).otherwise(F.array(F.concat(F.lit("93.184."), F.floor(u(5) * 255).cast("string"), F.lit(".7"))))
    ttls = F.when(missing, F.expr("CAST(array() AS array<double>)")).otherwise(F.array(_pick([60.0, 300.0, 3600.0], u(6))))
    source = F.concat(F.lit("10.0.1."), (F.floor(u(7) * 40) + 2).cast("string"))
    return spark.range(n).select("id", _record(F.lit(START) + u(8) * SPAN, source, query, _pick([1, 1, 1, 28, 15], u(9)), F.when(missing, 3).otherwise(0), answers, ttls).alias("value"))


def tunnel_records(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """(id, value): JSON lines of bursts with long random labels under three domains."""
    u = lambda k: _unit(seed + 1, k)
    label = F.lower(F.translate(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "id").cast("binary"), 256), F.lit(1), (F.lit(28) + F.floor(u(1) * 30)).cast("int")), "0189", "ghjk"))
    client = F.col("id") % 3
    query = F.concat(label, F.lit(".t"), client.cast("string"), _pick([".example-tunnel.net", ".dnsx.com", ".data.org"], u(2) * 0 + client / 3.0))
    ts = F.lit(START) + client * 500 + F.floor(F.col("id") / 3) * 0.15 + u(3) * 0.05
    answers = F.array(F.substring(F.sha1(F.col("id").cast("string").cast("binary")), 1, 24))
    return spark.range(n).select("id", _record(ts, F.concat(F.lit("10.0.9."), client.cast("string")), query, _pick([16, 10, 16, 1], u(4)), F.lit(0), answers, F.array(F.lit(0.0))).alias("value"))


#: Lines that a loader must stand.
NOISE = ('{"ts": 1700000000.5, "query": "trunc', "", '{"ts": 1700000001, "query": ""}', '{"ts": 1700000002, "query": "no.answers.com", "answers": null}', '{"query": "no.time.com"}', "[1, 2, 3]")


def write_logs(spark: SparkSession, folder: str, n_benign: int = 7000, n_tunnel: int = 1000, seed: int = 42, noise: bool = False) -> tuple[str, str]:
    """A folder of JSON lines for each class (with ``noise`` also broken ones and a copy); returns the paths."""
    paths = []
    for name, rows in (("benign", benign_records(spark, n_benign, seed)), ("tunnel", tunnel_records(spark, n_tunnel, seed))):
        if noise and name == "benign":
            rows = rows.unionByName(rows.orderBy("id").limit(1)).unionByName(spark.createDataFrame([((1 << 40) + k, x) for k, x in enumerate(NOISE)], "id long, value string"))
        path = f"{folder}/{name}"
        rows.coalesce(1).sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)
        paths.append(path)
    return paths[0], paths[1]
