"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexical, net, parse
from .operators import metrics, models, policy, preprocess, splits
from .operators.windows import WINDOW_FEATURES, WINDOW_INPUT, add_window_features, window_features_with_history
from .session import configure
from .sources import records

DAY = 86_400
OFF = 1.23e-7
LEXICAL = (*lexical.LEXICAL_CONTINUOUS, *lexical.LEXICAL_BINARY)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Doubles to six places, without negative zeros. Window features that lie between two places, like halved microseconds, are moved off first."""
    shift = {c: F.col(c) + OFF if c.startswith("win_") else F.col(c) for c in df.columns}
    return df.select(*keys, *[(F.round(shift[c], 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


def dns_events(spark: SparkSession, sf: str, hourly: bool = False) -> DataFrame:
    """The events table as name queries: hosts come from pages, groups from users."""
    pages = _table(spark, sf, "pages").select("page_id", "url")
    n = pages.count()
    host = F.regexp_extract("url", "^https?://([^/:]+)", 1)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    us = us - us % 3_600_000_000 if hourly else us
    e = _table(spark, sf, "events").join(pages, F.col("event_id") % F.lit(n) == F.col("page_id"))
    e = e.select(
        F.col("event_id").cast("string").alias("event_id"), (us / 1e6).alias("timestamp"), F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
        F.array_join(F.slice(F.split(host, "[.]"), -2, 2), ".").alias("sld"),
        F.concat(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(1), (4 + F.col("event_id") % 28).cast("int")), F.lit("."), host).alias("query"),
        host.alias("host"), F.col("event_type").alias("qtype_cat"), (F.col("event_type") == "error").cast("int").alias("is_nxdomain"), (F.col("page_id") % 5 == 0).cast("int").alias("label"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("ttl_mean"), F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 4).cast("double")).alias("num_answers"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("10.1.0."), (F.col("event_id") % 3).cast("string"))).alias("dst_ip"), F.col("value"),
    )
    digits = F.length(F.regexp_replace("query", "[^0-9]", ""))
    return e.withColumns(
        {
            "subdomain": F.expr("substr(query, 1, length(query) - length(sld) - 1)"), "query_length": F.length("query"), "query_entropy": (F.length("query") % 7) / F.lit(4.0),
            "subdomain_length": F.length("query") - F.length("sld") - 1, "digit_ratio": digits / F.length("query"),
        }
    )


DNS = """
dns AS (SELECT CAST(event_id AS VARCHAR) AS event_id, {us} AS us, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
  array_to_string(string_split(host, '.')[-2:], '.') AS sld, substr(md5(CAST(event_id AS VARCHAR)), 1, CAST(4 + event_id % 28 AS INT)) || '.' || host AS query,
  host, event_type AS qtype_cat, CAST(event_type = 'error' AS INT) AS is_nxdomain, CAST(page_id % 5 = 0 AS INT) AS label,
  CASE WHEN event_id % 7 <> 0 THEN value END AS ttl_mean, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 4 AS DOUBLE) END AS num_answers,
  CASE WHEN event_id % 5 <> 0 THEN '10.1.0.' || (event_id % 3) END AS dst_ip, value
  FROM events JOIN (SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, count(*) OVER () AS n FROM pages) ON event_id % n = page_id),
d AS (SELECT *, substr(query, 1, length(query) - length(sld) - 1) AS subdomain, length(query) AS query_length, (length(query) % 7) / 4.0::DOUBLE AS query_entropy,
  length(query) - length(sld) - 1 AS subdomain_length, length(regexp_replace(query, '[^0-9]', '', 'g')) / length(query) AS digit_ratio FROM dns)"""
EXACT_US, HOUR_US = "epoch_us(ts)", "epoch_us(date_trunc('hour', ts))"


def _dns_sql(us: str = EXACT_US) -> str:
    return "WITH " + DNS.format(us=us).strip()


def _window_sql(seconds: float, us: str = EXACT_US, target: str = "TRUE", members: str = "TRUE") -> str:
    """All 21 features by a self-join of each group; ``target`` and ``members`` choose the rows of either side."""
    w = int(round(seconds * 1e6))
    r = lambda x, name: f"round(CAST({x} AS DOUBLE) + {OFF}, 6) + 0.0 AS {name}"
    return f"""{_dns_sql(us)},
o AS (SELECT *, row_number() OVER g AS rn FROM d WHERE ({target}) OR ({members}) WINDOW g AS (PARTITION BY src_ip, sld ORDER BY us, event_id)),
p AS (SELECT a.event_id, a.us, m.us AS mu, m.rn AS mr, CAST(m.us - lag(m.us) OVER (PARTITION BY a.event_id ORDER BY m.rn) AS HUGEINT) AS gap, m.query, m.subdomain, m.query_length AS ql,
  m.query_entropy AS qe, m.subdomain_length AS sl, m.digit_ratio AS dr, m.is_nxdomain AS nx, m.qtype_cat AS qt, m.dst_ip, m.num_answers AS ans, m.ttl_mean AS ttl
  FROM o a JOIN o m ON a.src_ip = m.src_ip AND a.sld = m.sld AND m.us > a.us - {w} AND m.rn <= a.rn AND (({members.replace('label', 'm.label').replace('event_id', 'm.event_id')}) OR m.event_id = a.event_id)
  WHERE {target.replace('label', 'a.label').replace('event_id', 'a.event_id')})
SELECT event_id, {r('count(*)', 'win_count')}, {r(f'count(*) / {float(seconds)}', 'win_query_rate')}, {r('count(DISTINCT query)', 'win_unique_queries')},
  {r('count(DISTINCT query) / count(*)', 'win_unique_query_ratio')}, {r("count(DISTINCT nullif(subdomain, ''))", 'win_unique_subdomains')},
  {r("count(DISTINCT nullif(subdomain, '')) / count(*)", 'win_unique_subdomain_ratio')}, {r('avg(ql)', 'win_query_len_mean')}, {r('stddev_pop(ql)', 'win_query_len_std')},
  {r('max(ql)', 'win_query_len_max')}, {r('avg(qe)', 'win_entropy_mean')}, {r('stddev_pop(qe)', 'win_entropy_std')}, {r('avg(sl)', 'win_subdomain_len_mean')},
  {r('avg(dr)', 'win_digit_ratio_mean')}, {r('sum(nx)', 'win_nxdomain_count')}, {r('avg(nx)', 'win_nxdomain_ratio')}, {r('count(DISTINCT qt)', 'win_unique_qtypes')},
  {r('count(DISTINCT dst_ip)', 'win_unique_dst_ips')}, {r('avg(ans)', 'win_answers_mean')}, {r('avg(ttl)', 'win_ttl_mean')},
  {r(f'CASE WHEN count(*) = 1 THEN {float(seconds)} ELSE (max(mu) - min(mu)) / (count(*) - 1) / 1e6 END', 'win_iat_mean')},
  {r('coalesce(stddev_pop(CAST(gap AS DOUBLE) / 1e6), 0)', 'win_iat_std')} FROM p GROUP BY event_id"""


def window_query(seconds: float, hourly: bool = False):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(add_window_features(dns_events(spark, sf, hourly), seconds).select("event_id", *WINDOW_FEATURES), "event_id")

    return query


def win_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Five sizes in one plan with one shuffle."""
    sizes = (3600, 6 * 3600, DAY, 3 * DAY, 7 * DAY)
    out = add_window_features(dns_events(spark, sf), sizes)
    return _rounded(out.select("event_id", *[f"{f}_{s}" for s in sizes for f in ("win_count", "win_unique_queries", "win_ttl_mean")]), "event_id")


WIN_MULTI_SQL = _dns_sql() + ",\n" + ",\n".join(
    f"w{s} AS (SELECT a.event_id, CAST(count(*) AS DOUBLE) AS win_count_{s}, CAST(count(DISTINCT m.query) AS DOUBLE) AS win_unique_queries_{s}, round(avg(m.ttl_mean) + {OFF}, 6) + 0.0 AS win_ttl_mean_{s} "
    f"FROM d a JOIN d m ON a.src_ip = m.src_ip AND a.sld = m.sld AND m.us > a.us - {s * 1_000_000} AND (m.us < a.us OR (m.us = a.us AND m.event_id <= a.event_id)) GROUP BY 1)"
    for s in (3600, 6 * 3600, DAY, 3 * DAY, 7 * DAY)
) + "\nSELECT * FROM w3600 JOIN w21600 USING (event_id) JOIN w86400 USING (event_id) JOIN w259200 USING (event_id) JOIN w604800 USING (event_id)"


def win_carryover(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of one part of the events that reach into the other."""
    e = dns_events(spark, sf, True)
    later = F.col("event_id").cast("long") % 3 == 0
    return _rounded(window_features_with_history(e.where(later), e.where(~later), DAY).select("event_id", *WINDOW_FEATURES), "event_id")


def win_isolated(spark: SparkSession, sf: str) -> DataFrame:
    e = dns_events(spark, sf, True).where(F.col("event_id").cast("long") % 3 == 0)
    return _rounded(add_window_features(e, DAY).select("event_id", *WINDOW_FEATURES), "event_id")


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's features of the same events, read as a file stream to its end."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    from .streaming.windows import stream_window_features

    folder = tempfile.mkdtemp(prefix="tidewatch-stream-") if spark.sparkContext.master.startswith("local[") else f"{spark.conf.get('spark.checkpoint.dir')}/stream-{id(object())}"
    source = dns_events(spark, sf, True).select(*WINDOW_INPUT)
    source.write.parquet(f"{folder}/in")
    try:
        stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
        out = stream_window_features(stream, DAY)
        running = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return _rounded(spark.read.parquet(f"{folder}/out").select("event_id", *WINDOW_FEATURES), "event_id")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per domain: events, busiest day window, its mean entropy and length, from lexical and window features."""
    e = dns_events(spark, sf).drop("query_entropy")
    e = e.withColumn("query_entropy", lexical.entropy(F.col("query")))
    w = add_window_features(e, DAY)
    return _rounded(
        w.groupBy("sld").agg(
            F.count(F.lit(1)).alias("n_events"), F.max("win_count").alias("busiest"), F.avg("query_entropy").alias("mean_entropy"), F.avg("win_query_len_mean").alias("mean_window_length"),
            F.avg("win_unique_subdomain_ratio").alias("mean_unique_ratio"),
        ),
        "sld",
    )


_ENTROPY = (
    "CASE WHEN length({c}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({c}, '')), lambda x: "
    "-((length({c}) - length(replace({c}, x, ''))) / length({c})) * log2((length({c}) - length(replace({c}, x, ''))) / length({c})))) END"
)
FLAGSHIP_SQL = f"""{_dns_sql()},
x AS (SELECT a.event_id, a.sld, count(*) AS c, avg(m.query_length) AS l, count(DISTINCT nullif(m.subdomain, '')) / count(*) AS u, any_value({_ENTROPY.format(c='a.query')}) AS h
  FROM d a JOIN d m ON a.src_ip = m.src_ip AND a.sld = m.sld AND m.us > a.us - 86400000000 AND (m.us < a.us OR (m.us = a.us AND m.event_id <= a.event_id)) GROUP BY a.event_id, a.sld)
SELECT sld, count(*) AS n_events, CAST(max(c) AS DOUBLE) AS busiest, round(avg(h), 6) + 0.0 AS mean_entropy, round(avg(l), 6) + 0.0 AS mean_window_length, round(avg(u), 6) + 0.0 AS mean_unique_ratio
FROM x GROUP BY sld"""


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of every kind, from pages."""
    host = F.regexp_extract("url", "^https?://([^/:]+)", 1)
    k = F.col("page_id") % 9
    name = (
        F.when(k == 0, F.concat(F.upper(host), F.lit("."))).when(k == 1, F.concat(F.lit("10.0.0."), (F.col("page_id") % 256).cast("string")))
        .when(k == 2, F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".office.local"))).when(k == 3, F.lit("wpad")).when(k == 4, F.lit("4.3.2.1.in-addr.arpa"))
        .when(k == 5, F.lit(" ")).when(k == 6, F.concat(F.lit("bad name."), host)).otherwise(host)
    )
    return _table(spark, sf, "pages").select("page_id", name.alias("query"))


NAMES_SQL = """
h AS (SELECT page_id, page_id % 9 AS k, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages),
n AS (SELECT page_id, k, CASE k WHEN 0 THEN host WHEN 1 THEN '10.0.0.' || (page_id % 256) WHEN 2 THEN 'p' || page_id || '.office.local' WHEN 3 THEN 'wpad' WHEN 4 THEN '4.3.2.1.in-addr.arpa'
  WHEN 5 THEN '' WHEN 6 THEN 'bad name.' || host ELSE host END AS q, replace(CASE k WHEN 6 THEN 'bad name.' || host ELSE host END, ' ', '_') AS s FROM h),
p AS (SELECT page_id, q AS normalized,
  CASE k WHEN 1 THEN '' WHEN 2 THEN 'p' || page_id WHEN 3 THEN '' WHEN 4 THEN '4.3' WHEN 5 THEN '' ELSE array_to_string(string_split(s, '.')[:-3], '.') END AS subdomain,
  CASE k WHEN 1 THEN q WHEN 2 THEN 'office.local' WHEN 3 THEN 'wpad' WHEN 4 THEN '2.1.in-addr.arpa' WHEN 5 THEN '__empty__' ELSE array_to_string(string_split(s, '.')[-2:], '.') END AS registrable,
  CASE k WHEN 1 THEN 'ip' WHEN 2 THEN 'local' WHEN 3 THEN 'single_label' WHEN 4 THEN 'reverse_dns' WHEN 5 THEN 'empty' WHEN 6 THEN 'invalid' ELSE 'registrable' END AS kind FROM n)"""


def domain_split(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("page_id", net.domain_parts(F.col("query")).alias("p")).select("page_id", "p.*")


def domain_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return domain_split(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def lexical_features(spark: SparkSession, sf: str) -> DataFrame:
    parts = _names(spark, sf).select("page_id", net.domain_parts(F.col("query")).alias("p"))
    columns = lexical.lexical_features(F.col("p"))
    return _rounded(parts.select("page_id", *[columns[c].alias(c) for c in ("sld", "subdomain", "domain_kind", *LEXICAL)]), "page_id", "sld", "subdomain", "domain_kind")


def _lexical_sql() -> str:
    q, s = "normalized", "subdomain"
    share = lambda x: f"CASE WHEN length({q}) = 0 THEN 0 ELSE ({x}) / length({q}) END"
    kept = lambda c: f"length(regexp_replace({q}, '[^{c}]', '', 'g'))"
    run = lambda c: f"coalesce(list_max(list_transform(regexp_extract_all({q}, '[{c}]+'), lambda x: length(x))), 0)"
    unique = f"CASE WHEN length({q}) = 0 THEN 0 ELSE len(list_distinct(string_split({q}, ''))) END"
    values = {
        "query_length": f"length({q})", "num_labels": f"CASE WHEN {q} = '' THEN 0 ELSE len(string_split({q}, '.')) END", "subdomain_length": f"length({s})",
        "subdomain_num_labels": f"CASE WHEN {s} = '' THEN 0 ELSE len(string_split({s}, '.')) END", "max_label_length": f"list_max(list_transform(string_split({q}, '.'), lambda x: length(x)))",
        "mean_label_length": f"list_avg(list_transform(string_split({q}, '.'), lambda x: length(x)))", "query_entropy": _ENTROPY.format(c=q), "subdomain_entropy": _ENTROPY.format(c=s),
        "digit_count": kept("0-9"), "digit_ratio": share(kept("0-9")), "letter_count": kept("a-z"), "letter_ratio": share(kept("a-z")), "hyphen_count": kept("-"), "hyphen_ratio": share(kept("-")),
        "unique_char_count": unique, "unique_char_ratio": share(unique), "longest_digit_run": run("0-9"), "longest_alpha_run": run("a-z"), "is_ip_query": "CAST(kind = 'ip' AS INT)",
        "is_reverse_dns": "CAST(kind = 'reverse_dns' AS INT)", "is_single_label": "CAST(kind = 'single_label' AS INT)", "is_valid_domain": "CAST(kind NOT IN ('empty', 'invalid') AS INT)",
    }
    listed = ", ".join(f"round(CAST({v} AS DOUBLE), 6) + 0.0 AS {k}" for k, v in values.items())
    return f"WITH {NAMES_SQL.strip()} SELECT page_id, registrable AS sld, subdomain, kind AS domain_kind, {listed} FROM p"


def ip_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses in several spellings to their canonical form."""
    i = F.col("page_id")
    text = F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.lower(F.hex(i % 65536)))
    return _table(spark, sf, "pages").select("page_id", net.canonical_ip(F.when(i % 3 == 0, text).when(i % 3 == 1, F.concat(F.lit("10.0.0."), i.cast("string"))).otherwise("x")).alias("ip"))


IP_SQL = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 65536 = 0 THEN '2001:db8::' ELSE '2001:db8::' || printf('%x', page_id % 65536) END
  WHEN page_id % 3 = 1 AND page_id <= 255 THEN '10.0.0.' || page_id END AS ip FROM pages"""


def event_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select(records.event_id(F.lit("benign"), F.col("event_id")).alias("id"), "event_id")


def _raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log lines of which some are broken, no objects, or lack a field."""
    k = F.col("event_id") % 10
    text = (
        F.when(k == 0, F.expr("concat('{\"ts\": ', event_id, ', \"query\": \"A', event_id, '.Example.COM.\", \"qtype\": 1, \"id\": {\"orig_h\": \"10.0.0.', event_id % 256, '\"}}')"))
        .when(k == 1, F.expr("concat('{\"ts\": \"', event_id, '.5\", \"TTLs\": [1, \"2\", null, -3], \"AA\": \"T\"}')")).when(k == 2, F.lit('{"ts": "soon"}')).when(k == 3, F.lit("[1, 2]"))
        .when(k == 4, F.lit('{"query": "x"}')).when(k == 5, F.lit('{"ts": 1, "query": ["a"]}')).when(k == 6, F.lit('{"ts": 1')).when(k == 7, F.lit('{"ts": 5, "id.orig_h": "nowhere", "qtype": 999, "answers": "a, -,b"}'))
        .when(k == 8, F.lit('{"ts": "1970-01-01T00:01:00Z", "id.orig_p": 70000}')).otherwise(F.lit('{"ts": 9, "answers": [], "ttls": 4, "rcode": 3, "rejected": 0}'))
    )
    rows = _table(spark, sf, "events").select(F.lit("log").alias("file"), F.col("event_id").alias("position"), text.alias("text")).withColumn("record", F.try_parse_json("text"))
    return records.normalize(records.with_errors(rows.withColumn("broken", F.col("record").isNull())))


def record_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _raw_records(spark, sf).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("anomalies")).alias("n_anomalies"))


RECORD_REASONS_SQL = """WITH r AS (SELECT ['valid', 'valid', 'invalid_timestamp', 'not_an_object', 'missing_required:timestamp', 'invalid_type:query', 'invalid_json', 'valid', 'valid', 'valid'][event_id % 10 + 1] AS reason,
  [0, 0, 0, 0, 0, 0, 0, 1, 1, 0][event_id % 10 + 1] AS a FROM events) SELECT reason, count(*) AS n, CAST(sum(a) AS BIGINT) AS n_anomalies FROM r GROUP BY reason"""


def record_values(spark: SparkSession, sf: str) -> DataFrame:
    loaded = records.Loaded(_raw_records(spark, sf), "log", 0)
    return loaded.events().select(
        F.col("source_line").alias("position"), "timestamp", "src_ip", "query", "qtype_name", "rcode_name", F.array_join("answers", "|").alias("answers"),
        F.size("ttls").cast("double").alias("n_ttls"), "aa", "rejected",
    )


RECORD_VALUES_SQL = """WITH e AS (SELECT event_id AS position, event_id % 10 AS k FROM events WHERE event_id % 10 IN (0, 1, 7, 8, 9))
SELECT position, CASE k WHEN 0 THEN CAST(position AS DOUBLE) WHEN 1 THEN position + 0.5 WHEN 7 THEN 5.0 WHEN 8 THEN 60.0 ELSE 9.0 END AS timestamp,
  CASE k WHEN 0 THEN '10.0.0.' || (position % 256) ELSE '__unknown_src__' END AS src_ip, CASE k WHEN 0 THEN 'a' || position || '.example.com' ELSE '' END AS query,
  CASE k WHEN 0 THEN 'A' WHEN 7 THEN 'TYPE999' END AS qtype_name, CASE k WHEN 9 THEN 'NXDOMAIN' END AS rcode_name, CASE k WHEN 7 THEN 'a|b' WHEN 9 THEN '' END AS answers,
  CASE k WHEN 1 THEN 2.0::DOUBLE WHEN 9 THEN 1.0::DOUBLE END AS n_ttls, CASE k WHEN 1 THEN TRUE END AS aa, CASE k WHEN 9 THEN FALSE END AS rejected FROM e"""


def code_names(spark: SparkSession, sf: str) -> DataFrame:
    code = (F.col("event_id") % 300).cast("long")
    out = parse.code_name(code, F.when(F.col("event_id") % 2 == 0, F.lit(None).cast("string")).otherwise("GIVEN"), parse.QTYPES, "TYPE")
    return _table(spark, sf, "events").select(out.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _code_sql() -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in parse.QTYPES.items())
    return f"SELECT CASE WHEN event_id % 2 <> 0 THEN 'GIVEN' ELSE CASE event_id % 300 {cases} ELSE 'TYPE' || (event_id % 300) END END AS name, count(*) AS n FROM events GROUP BY 1"


def _small_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a label, times and some missing fields, for splits and audits."""
    e = _table(spark, sf, "events")
    k = F.col("event_id")
    return e.select(
        k.cast("string").alias("event_id"), (k % 4 == 0).cast("int").alias("label"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.lit("events").alias("source_file"), k.alias("source_line"),
        "event_type", "value", F.when((k % 4 == 0) | (k % 10 == 0), F.col("user_id")).alias("answers"), F.when(k % 3 != 0, F.col("value")).alias("ttls"), "user_id",
    )


SMALL_SQL = """e AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(event_id % 4 = 0 AS INT) AS label, epoch_us(ts) / 1e6 AS timestamp, 'events' AS source_file, event_id AS source_line, event_type, value,
  CASE WHEN event_id % 4 = 0 OR event_id % 10 = 0 THEN user_id END AS answers, CASE WHEN event_id % 3 <> 0 THEN value END AS ttls, user_id FROM events)"""


def split_query(mode: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return splits.assign_subset(_small_events(spark, sf), "chronological", 0.3, chronological_mode=mode).select("event_id", "subset")

    return query


def _split_sql(by: str) -> str:
    return f"""WITH {SMALL_SQL} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY timestamp, event_id) <= floor(count(*) OVER (PARTITION BY {by}) * (1.0::DOUBLE - 0.3::DOUBLE)) THEN 'train' ELSE 'test' END AS subset FROM e"""


def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_subset(_small_events(spark, sf), "stratified_random", 0.3).groupBy("label", "subset").agg(F.count(F.lit(1)).alias("n"))


SPLIT_STRATIFIED_SQL = f"""WITH {SMALL_SQL}, c AS (SELECT label, count(*) AS n, CAST(ceil(count(*) * 0.3::DOUBLE) AS BIGINT) AS t FROM e GROUP BY label)
SELECT label, 'test' AS subset, t AS n FROM c UNION ALL SELECT label, 'train', n - t FROM c"""


def split_groups(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_subset(dns_events(spark, sf), "group_sld", 0.3, group="host").groupBy("host", "subset").agg(F.count(F.lit(1)).alias("n"))


def split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A split, its manifest, and the split made again from it."""
    events = _small_events(spark, sf)
    manifest = splits.build_manifest(splits.assign_subset(events, "chronological", 0.3, chronological_mode="per_class"))
    return splits.apply_manifest(events, manifest).select("event_id", "subset", "label")


def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = splits.subset_summary(splits.assign_subset(_small_events(spark, sf), "chronological", 0.3))
    return _rounded(out, "subset")


SPLIT_SUMMARY_SQL = f"""WITH s AS ({_split_sql('1')}), {SMALL_SQL}, j AS (SELECT * FROM e JOIN s USING (event_id)),
c AS (SELECT subset, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS tunnel, count(*) AS total, min(timestamp) AS a, max(timestamp) AS b FROM j GROUP BY subset)
SELECT subset, benign, tunnel, total, round(benign / tunnel, 6) + 0.0 AS ratio_benign_to_tunnel, printf('%.3f:1', benign / tunnel) AS ratio_text, round(a, 6) AS time_min, round(b, 6) AS time_max FROM c"""


def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(records.class_distribution(_small_events(spark, sf), "event_type"), "event_type")


CLASS_SQL = f"""WITH {SMALL_SQL}, c AS (SELECT event_type, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 1) AS tunnel, count(*) AS total FROM e GROUP BY 1)
SELECT event_type, benign, tunnel, total, round(benign / nullif(tunnel, 0), 6) + 0.0 AS ratio_benign_to_tunnel, printf('%.3f:1', benign / tunnel) AS ratio_text FROM c"""


def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    return splits.keep_first(_table(spark, sf, "documents"), ["text", "lang"], ["doc_id"]).select("doc_id", "lang", "n_chars")


def label_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("toxic").alias("label"), F.expr("n_chars % 50").alias("size"), "lang")
    kept = splits.deduplicate(rows, ["size", "lang"], ["doc_id"])
    return kept.select("doc_id", "label", "label_conflict")


LABEL_CONFLICTS_SQL = """WITH r AS (SELECT doc_id, toxic AS label, n_chars % 50 AS size, lang FROM documents JOIN labels USING (doc_id)),
f AS (SELECT min(doc_id) AS doc_id, label, size, lang FROM r GROUP BY label, size, lang)
SELECT doc_id, label, count(*) OVER (PARTITION BY size, lang) > 1 AS label_conflict FROM f"""


def field_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of rows that have each optional field, by class, and whether the difference gives the class away."""
    return _rounded(policy.schema_audit(_small_events(spark, sf), 0.5, ["answers", "ttls"]), "field")


FIELD_SQL = f"""WITH {SMALL_SQL}, p AS (SELECT 'answers' AS field, avg(CASE WHEN label = 0 THEN CAST(answers IS NOT NULL AS INT) END) AS a, avg(CASE WHEN label = 1 THEN CAST(answers IS NOT NULL AS INT) END) AS b FROM e
UNION ALL SELECT 'ttls', avg(CASE WHEN label = 0 THEN CAST(ttls IS NOT NULL AS INT) END), avg(CASE WHEN label = 1 THEN CAST(ttls IS NOT NULL AS INT) END) FROM e)
SELECT field, round(a, 6) + 0.0 AS presence_benign, round(b, 6) + 0.0 AS presence_tunnel, round(abs(b - a), 6) + 0.0 AS abs_difference, abs(b - a) >= 0.5 AS flagged FROM p"""


def feature_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(policy.feature_aucs(_small_events(spark, sf), ["value", "ttls", "user_id"]), "name")


def _auc_sql(rows: str) -> str:
    return f"""s AS (SELECT name, score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM ({rows}) GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER (PARTITION BY name ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY name ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY name) AS ps, sum(n) OVER (PARTITION BY name) AS ns FROM s)"""


FEATURE_AUC_SQL = f"""WITH {SMALL_SQL}, {_auc_sql("SELECT 'value' AS name, label, CAST(value AS DOUBLE) AS score FROM e UNION ALL SELECT 'user_id', label, user_id FROM e UNION ALL SELECT 'ttls', label, coalesce(ttls, (SELECT median(ttls) FROM e)) FROM e")},
a AS (SELECT name, sum(n * (tp - p / 2)) / max(ps * ns) AS auc FROM c GROUP BY name) SELECT name, round(greatest(auc, 1 - auc), 6) + 0.0 AS auc FROM a"""


def category_purity(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(policy.category_purity(_small_events(spark, sf), ["event_type", "answers"]), "name")


PURITY_SQL = f"""WITH {SMALL_SQL}, l AS (SELECT 'event_type' AS name, event_type AS v, label FROM e UNION ALL SELECT 'answers', CAST(answers AS VARCHAR), label FROM e),
p AS (SELECT name, v, count(*) FILTER (WHERE label = 0) AS a, count(*) FILTER (WHERE label = 1) AS b FROM l GROUP BY 1, 2)
SELECT name, round(CAST(sum(greatest(a, b)) AS DOUBLE) / sum(a + b), 6) + 0.0 AS purity, count(*) AS n_categories FROM p GROUP BY name"""


def duplicate_vectors(spark: SparkSession, sf: str) -> DataFrame:
    s = splits.assign_subset(_small_events(spark, sf), "chronological", 0.3).withColumn("value", F.floor(F.col("value") / 20).cast("double"))
    found = policy.duplicate_vectors(s.where("subset = 'train'"), s.where("subset = 'test'"), ["value"], [], ["event_type"])
    seen = found["test_rows_with_identical_vector_in_train"]
    row = (seen.get("benign"), seen.get("tunnel"), found["feature_vectors_with_both_labels"], found["unique_vector_fraction_train"])
    return _rounded(spark.createDataFrame([row], "benign double, tunnel double, both_labels long, unique_train double"))


DUPLICATE_SQL = f"""WITH s AS ({_split_sql('1')}), {SMALL_SQL}, j AS (SELECT label, subset, floor(value / 20) AS v, event_type AS t FROM e JOIN s USING (event_id)),
g AS (SELECT v, t, bool_or(subset = 'train') AS seen, min(label) <> max(label) AS mixed FROM j GROUP BY v, t)
SELECT (SELECT round(avg(CAST(seen AS INT)), 6) + 0.0 FROM j JOIN g USING (v, t) WHERE subset = 'test' AND label = 0) AS benign,
  (SELECT round(avg(CAST(seen AS INT)), 6) + 0.0 FROM j JOIN g USING (v, t) WHERE subset = 'test' AND label = 1) AS tunnel, (SELECT count(*) FROM g WHERE mixed) AS both_labels,
  round((SELECT count(*) FROM g WHERE seen) / (SELECT count(*) FROM j WHERE subset = 'train'), 6) + 0.0 AS unique_train"""


def sld_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s = splits.assign_subset(dns_events(spark, sf), "chronological", 0.3)
    return _rounded(policy.value_overlap(s.where("subset = 'train'"), s.where("subset = 'test'"), "host"), "label")


OVERLAP_SQL = f"""{_dns_sql()}, s AS (SELECT *, row_number() OVER (ORDER BY us / 1e6, event_id) <= floor(count(*) OVER () * (1.0::DOUBLE - 0.3::DOUBLE)) AS train FROM d)
SELECT label, round(avg(CAST(host IN (SELECT host FROM s WHERE train) AS INT)), 6) + 0.0 AS share FROM s WHERE NOT train GROUP BY label"""


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf, "customer").select(k.alias("event_id"), F.when(k % 4 != 0, F.col("c_acctbal").cast("double")).alias("balance"), F.when(k % 5 != 0, (k % 3 == 0).cast("double")).alias("flag"), F.when(k % 6 != 0, F.col("c_mktsegment")).alias("segment"))


def preprocess_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on the first half of the keys: imputed and scaled balance, imputed flag, code and one-hot columns of the segment."""
    rows = _customers(spark, sf)
    prep = preprocess.Preprocessor.fit(rows.where("event_id % 2 = 0"), ["balance"], ["flag"], ["segment"], scale=True)
    matrix = prep.transform(rows)
    known = prep.expanded()
    hot = sum((c for n, c in known.items() if "=" in n), F.lit(0.0))
    return _rounded(matrix.select("event_id", "balance", "flag", F.col("segment").alias("code"), hot.alias("n_hot")), "event_id")


PREPROCESS_SQL = """WITH r AS (SELECT c_custkey AS event_id, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 3 = 0 AS INT) END AS flag,
  coalesce(CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END, 'MISSING') AS segment FROM customer), t AS (SELECT * FROM r WHERE event_id % 2 = 0),
m AS (SELECT median(balance) AS med FROM t), s AS (SELECT avg(coalesce(balance, med)) AS a, stddev_pop(coalesce(balance, med)) AS sd FROM t, m),
f AS (SELECT flag AS mode FROM t WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1), c AS (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS code FROM (SELECT DISTINCT segment FROM t))
SELECT event_id, round((coalesce(balance, med) - a) / sd, 6) + 0.0 AS balance, CAST(coalesce(flag, mode) AS DOUBLE) AS flag, CAST(coalesce(code, -1) AS DOUBLE) AS code, CAST(code IS NOT NULL AS INT) + 0.0::DOUBLE AS n_hot
FROM r LEFT JOIN c USING (segment), m, s, f"""


def oversample_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"), F.col("toxic").alias("label"))
    return preprocess.random_oversample(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("_extra").alias("extra"))


OVERSAMPLE_SQL = "SELECT toxic AS label, max(count(*)) OVER () AS n, max(count(*)) OVER () - count(*) AS extra FROM labels GROUP BY toxic"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _small_events(spark, sf).select("event_id", "label", (F.floor(F.col("value")) % 40 / 40 * 0.7 + F.col("label") * 0.15).alias("score"))


SCORED_SQL = f"{SMALL_SQL}, r AS (SELECT event_id, label, (floor(value) % 40 / 40 * 0.7::DOUBLE + label * 0.15::DOUBLE) AS score FROM e)"


def metrics_at_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.confusion(_scored(spark, sf), 0.4))


METRICS_SQL = f"""WITH {SCORED_SQL}, c AS (SELECT count(*) FILTER (WHERE label = 0 AND score < 0.4) AS tn, count(*) FILTER (WHERE label = 0 AND score >= 0.4) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.4) AS fn, count(*) FILTER (WHERE label = 1 AND score >= 0.4) AS tp FROM r)
SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) + 0.0 AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1, round(fp / (fp + tn), 6) + 0.0 AS false_positive_rate FROM c"""


def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).withColumn("name", F.lit("all"))
    return _rounded(metrics.roc_auc(s, "name").join(metrics.average_precision(s, "name"), "name"), "name")


_CURVE_SQL = _auc_sql("SELECT 'all' AS name, label, score FROM r")
RANKING_SQL = f"WITH {SCORED_SQL}, {_CURVE_SQL} SELECT name, round(sum(n * (tp - p / 2)) / max(ps * ns), 6) + 0.0 AS roc_auc, round(sum(p * tp / (tp + fp)) / max(ps), 6) + 0.0 AS average_precision FROM c GROUP BY name"


def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.pr_points(_scored(spark, sf)))


PR_SQL = f"WITH {SCORED_SQL}, {_CURVE_SQL} SELECT round(score, 6) + 0.0 AS threshold, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / ps, 6) + 0.0 AS recall FROM c"


def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.roc_points(_scored(spark, sf)))


ROC_SQL = f"WITH {SCORED_SQL}, {_CURVE_SQL} SELECT round(score, 6) + 0.0 AS threshold, round(fp / ns, 6) + 0.0 AS fpr, round(tp / ps, 6) + 0.0 AS tpr FROM c"


def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.best_threshold(_scored(spark, sf)))


BEST_SQL = f"""WITH {SCORED_SQL}, {_CURVE_SQL}, q AS (SELECT score, tp / (tp + fp) AS p, tp / ps AS rc FROM c), x AS (SELECT score, 2 * p * rc / greatest(p + rc, 1e-12) AS f FROM q)
SELECT round(score, 6) + 0.0 AS threshold, round(f, 6) + 0.0 AS f1 FROM x ORDER BY f DESC, score LIMIT 1"""


def list_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = lexical.list_statistics(F.col("embedding"))
    return _rounded(_table(spark, sf, "embeddings").select("vec_id", *[c.alias(n) for n, c in stats.items()]), "vec_id")


LIST_SQL = "SELECT vec_id, CAST(len(embedding) AS DOUBLE) AS count, round(CAST(list_min(embedding) AS DOUBLE), 6) + 0.0 AS min, round(CAST(list_max(embedding) AS DOUBLE), 6) + 0.0 AS max, round(list_avg(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS mean FROM embeddings"


def model_query(name: str, params: dict, method: str = "none"):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        """Fitted on the earlier events, scored on the later ones."""
        e = splits.assign_subset(dns_events(spark, sf), "chronological", 0.3)
        groups = (["query_length", "digit_ratio", "ttl_mean", "num_answers"], ["is_nxdomain"], [] if method == "smote" else ["qtype_cat"])
        fitted = models.Fitted.fit(e.where("subset = 'train'"), name, groups, {"method": method}, params)
        return fitted.score(e.where("subset = 'test'")).select("event_id", "label", "score")

    return query


MOD = "CAST(event_id AS BIGINT) % 3 = 0"


def _carry_sql() -> str:
    return _window_sql(DAY, HOUR_US, target=MOD, members="TRUE")


def _isolated_sql() -> str:
    return _window_sql(DAY, HOUR_US, target=MOD, members=MOD)


def queries() -> dict:
    return {
        "flagship": flagship, "win_1d": window_query(DAY), "win_7d": window_query(7 * DAY), "win_60s": window_query(60), "win_5s": window_query(5), "win_half_second": window_query(0.5),
        "win_ties": window_query(DAY, True), "win_multi": win_multi, "win_carryover": win_carryover, "win_isolated": win_isolated, "stream_windows": stream_windows,
        "domain_split": domain_split, "domain_kind_counts": domain_kind_counts, "lexical_features": lexical_features, "ip_canonical": ip_canonical, "list_stats": list_stats,
        "event_ids": event_ids, "record_reasons": record_reasons, "record_values": record_values, "code_names": code_names,
        "dedupe_first": dedupe_first, "label_conflicts": label_conflicts, "split_chrono_global": split_query("global"), "split_chrono_per_class": split_query("per_class"),
        "split_stratified": split_stratified, "split_groups": split_groups, "split_manifest": split_manifest, "split_summary": split_summary, "class_distribution": class_distribution,
        "field_availability": field_availability, "feature_auc": feature_auc, "category_purity": category_purity, "duplicate_vectors": duplicate_vectors, "sld_overlap": sld_overlap,
        "preprocess": preprocess_customers, "oversample_counts": oversample_counts,
        "metrics_at_threshold": metrics_at_threshold, "ranking_metrics": ranking_metrics, "pr_curve": pr_curve, "roc_curve": roc_curve, "best_threshold": best_threshold,
        "model_random_forest": model_query("random_forest", {"n_estimators": 10, "max_depth": 5}), "model_lightgbm": model_query("lightgbm", {"n_estimators": 5}),
        "model_xgboost": model_query("xgboost", {"n_estimators": 5, "max_depth": 4}), "model_mlp": model_query("mlp", {"hidden_layer_sizes": [8], "max_iter": 10}),
        "model_logistic_regression": model_query("logistic_regression", {}, "random_oversampling"), "model_smote": model_query("logistic_regression", {}, "smote"), "model_smotenc": model_query("logistic_regression", {}, "smotenc"),
    }


def oracle_sql() -> dict:
    names = f"WITH {NAMES_SQL.strip()} "
    return {
        "flagship": FLAGSHIP_SQL, "win_1d": _window_sql(DAY), "win_7d": _window_sql(7 * DAY), "win_60s": _window_sql(60), "win_5s": _window_sql(5), "win_half_second": _window_sql(0.5),
        "win_ties": _window_sql(DAY, HOUR_US), "win_multi": WIN_MULTI_SQL, "win_carryover": _carry_sql(), "win_isolated": _isolated_sql(), "stream_windows": _window_sql(DAY, HOUR_US),
        "domain_split": names + "SELECT * FROM p", "domain_kind_counts": names + "SELECT kind, count(*) AS n FROM p GROUP BY kind", "lexical_features": _lexical_sql(), "ip_canonical": IP_SQL, "list_stats": LIST_SQL,
        "event_ids": "SELECT 'evt_' || substr(sha1('benign:' || event_id), 1, 16) AS id, event_id FROM events", "record_reasons": RECORD_REASONS_SQL, "record_values": RECORD_VALUES_SQL, "code_names": _code_sql(),
        "dedupe_first": "SELECT min(doc_id) AS doc_id, lang, any_value(n_chars) AS n_chars FROM documents GROUP BY text, lang", "label_conflicts": LABEL_CONFLICTS_SQL,
        "split_chrono_global": _split_sql("1"), "split_chrono_per_class": _split_sql("label"), "split_stratified": SPLIT_STRATIFIED_SQL,
        "split_manifest": f"WITH s AS ({_split_sql('label')}) SELECT event_id, subset, CAST(CAST(event_id AS BIGINT) % 4 = 0 AS INT) AS label FROM s", "split_summary": SPLIT_SUMMARY_SQL, "class_distribution": CLASS_SQL,
        "field_availability": FIELD_SQL, "feature_auc": FEATURE_AUC_SQL, "category_purity": PURITY_SQL, "duplicate_vectors": DUPLICATE_SQL, "sld_overlap": OVERLAP_SQL,
        "preprocess": PREPROCESS_SQL, "oversample_counts": OVERSAMPLE_SQL,
        "metrics_at_threshold": METRICS_SQL, "ranking_metrics": RANKING_SQL, "pr_curve": PR_SQL, "roc_curve": ROC_SQL, "best_threshold": BEST_SQL,
    }
