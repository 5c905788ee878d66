"""JSON logs to a typed event table, with a reason for every record that is left out.

Everything but the format detection is one lazy plan: scan, variant, lookup, parsers, one ``reason`` column. Valid
events, invalid ones and all counts come from the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions.net import canonical_ip, normalize_query, once

#: Fixed names and order of the event table.
EVENT_COLUMNS = (
    "event_id", "label", "source_file", "source_line", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "proto",
    "query", "qtype", "qtype_name", "rcode", "rcode_name", "answers", "ttls", "rejected", "aa", "tc", "rd", "ra",
)
#: Names under which logs hold each field, in order.
FIELD_MAPPING = {
    "timestamp": ["ts"], "src_ip": ["id.orig_h"], "dst_ip": ["id.resp_h"], "src_port": ["id.orig_p"], "dst_port": ["id.resp_p"],
    "proto": ["proto"], "query": ["query"], "qtype": ["qtype"], "qtype_name": ["qtype_name"], "rcode": ["rcode"],
    "rcode_name": ["rcode_name"], "answers": ["answers"], "ttls": ["TTLs", "ttls"], "rejected": ["rejected"], "aa": ["AA"],
    "tc": ["TC"], "rd": ["RD"], "ra": ["RA"],
}
PARSED = tuple(FIELD_MAPPING)
_PARSERS = {
    "timestamp": P.parse_timestamp, "qtype": P.parse_int, "rcode": P.parse_int, "src_port": P.parse_int, "dst_port": P.parse_int,
    "src_ip": P.clean_text, "dst_ip": P.clean_text, "proto": P.clean_text, "qtype_name": P.clean_text, "rcode_name": P.clean_text, "query": lambda v: v.text,
    "answers": P.parse_answers, "ttls": P.parse_ttls, "rejected": P.parse_bool, "aa": P.parse_bool, "tc": P.parse_bool, "rd": P.parse_bool, "ra": P.parse_bool,
}
#: Fields whose unreadable values are anomalies.
COERCED = ("src_ip", "dst_ip", "src_port", "dst_port", "qtype", "rcode", "answers", "ttls", "rejected", "aa", "tc", "rd", "ra")
BLANK = r"^[\s\x{FEFF}\x1C-\x1F\x85\p{Z}]*$"


def event_id(source: Column, position: Column) -> Column:
    """Unique, the same in every run, and unrelated to the label."""
    return F.concat(F.lit("evt_"), F.substring(F.sha1(F.concat_ws(":", source, position.cast("string")).cast("binary")), 1, 16))


def detect_format(spark: SparkSession, path: str) -> str:
    """``json_array`` if the first character that is not blank is ``[``, else ``jsonl``."""
    lines = spark.read.text(path).where(~F.col("value").rlike(BLANK)).limit(1).collect()
    first = lines[0]["value"].lstrip("﻿ \t\r\n") if lines else ""
    return "json_array" if first.startswith("[") else "jsonl"


def _raw(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, content) per file; bytes that are no text become the replacement character."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", encoding) if encoding.lower().replace("-", "") != "utf8" else F.try_validate_utf8("content")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.coalesce(text, F.make_valid_utf8("content")).alias("content"))


def scan_jsonl(spark: SparkSession, path: str, encoding: str = "utf-8", numbered: str = "exact") -> DataFrame:
    """(file, position, text) of lines that are not blank; blank ones count in the position.

    ``exact`` numbers the physical lines of each file from 1 and reads a file in one task. ``offset`` is for large files: these are
    split over tasks, and a line's position is its rank in the file by an index that a first pass has counted.
    """
    if numbered == "exact":
        lines = _raw(spark, path, encoding).select("file", F.posexplode(F.split("content", "\r\n|\n|\r", -1)).alias("at", "text"))
        out = lines.select("file", (F.col("at") + 1).cast("long").alias("position"), "text")
    else:
        lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))
        rows = lines.rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[1]))
        numbered_lines = spark.createDataFrame(rows, "file string, text string, at bigint")
        first = numbered_lines.groupBy("file").agg(F.min("at").alias("first"))
        out = numbered_lines.join(F.broadcast(first), "file").select("file", (F.col("at") - F.col("first") + 1).alias("position"), "text")
    return out.where(~F.col("text").rlike(BLANK)).withColumn("text", F.regexp_replace("text", r"^[\s\x{FEFF}]+", ""))


def records(spark: SparkSession, path: str, fmt: str = "auto", encoding: str = "utf-8", numbered: str = "exact") -> DataFrame:
    """(file, position, record VARIANT, error) of every record. A file that should be a JSON array and is not raises."""
    fmt = detect_format(spark, path) if fmt == "auto" else fmt
    if fmt == "json_array":
        whole = _raw(spark, path, encoding).withColumn("v", F.try_parse_json(F.regexp_replace("content", r"^\x{FEFF}+", "")))
        bad = F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("file"), F.lit("; if it has one record per line use the format jsonl")))
        whole = whole.withColumn("v", F.when(P.kind(F.col("v")) == "list", F.col("v")).otherwise(bad.cast("variant")))
        rows = whole.select("file", F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("at", "record"))
        rows = rows.withColumn("position", (F.col("at") + 1).cast("long")).withColumn("broken", F.lit(False))
    elif fmt == "jsonl":
        rows = scan_jsonl(spark, path, encoding, numbered).withColumn("record", F.try_parse_json("text")).withColumn("broken", F.col("record").isNull())
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return with_errors(rows)


def with_errors(rows: DataFrame) -> DataFrame:
    """(file, position, record, error) from rows with ``broken`` set where the text is no JSON."""
    error = F.when(F.col("broken"), "invalid_json").when(P.kind(F.col("record")) != "object", "not_an_object")
    return rows.select("file", "position", "record", error.alias("error"))


def _path(names: Sequence[str]) -> str:
    return "$" + "".join("['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']" for n in names)


def lookup(record: Column, names: Sequence[str]) -> Column:
    """The first name that is present, even if its value is null; a dotted name as such, then as a path."""
    found = []
    for name in names:
        found.append(F.try_variant_get(record, _path([name]), "variant"))
        if "." in name:
            found.append(F.try_variant_get(record, _path(name.split(".")), "variant"))
    return F.coalesce(*found) if found else F.lit(None).cast("variant")


def normalize(raw: DataFrame, mapping: Mapping[str, Sequence[str]] | None = None, required: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Typed columns of ``record``, with ``reason`` (null: valid) and ``anomalies``.

    Reasons in order: the record's own error, ``invalid_timestamp``, ``invalid_type:query``, ``missing_required:<field>``. Anomalies
    ``unparsable:<field>`` are fields that are there and cannot be read; they become null. Records that fail at timestamp or
    query have none.
    """
    mapping = dict(FIELD_MAPPING) | dict(mapping or {})
    unknown = [f for f in required if f not in mapping]
    if unknown:
        raise ValueError(f"unknown required fields {unknown}")
    out = once(raw, {f"_raw_{f}": F.when(F.col("error").isNull(), lookup(F.col("record"), mapping[f])) for f in PARSED})
    values = {f: P.Value.of(F.col(f"_raw_{f}")) for f in PARSED}
    out = once(out, {f"_kind_{f}": v.kind for f, v in values.items()} | {f"_text_{f}": v.text for f, v in values.items()})
    values = {f: P.Value(F.col(f"_raw_{f}"), F.col(f"_kind_{f}"), F.col(f"_text_{f}")) for f in PARSED}
    out = once(out, {f"_read_{f}": _PARSERS[f](v) for f, v in values.items()})
    read = {f: F.col(f"_read_{f}") for f in PARSED}
    new = dict(read)
    new["query"] = normalize_query(F.when(values["query"].kind == "text", read["query"]))
    new["proto"] = F.lower(read["proto"])
    for f in ("src_port", "dst_port"):
        new[f] = P.port(read[f])
    for f in ("src_ip", "dst_ip"):
        new[f] = canonical_ip(read[f])
    for code, names, prefix in (("qtype", P.QTYPES, "TYPE"), ("rcode", P.RCODES, "RCODE")):
        new[f"{code}_name"] = P.code_name(read[code], F.upper(read[f"{code}_name"]), names, prefix)
    out = once(out, new)
    there = {f: v.kind != "none" for f, v in values.items()}
    lost = []
    for f in COERCED:
        usable = read[f].isNotNull() if f.endswith("_ip") else F.lit(True)
        lost.append(F.when(there[f] & usable & F.col(f).isNull(), F.lit(f"unparsable:{f}")))
    first = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(there["timestamp"] & F.col("timestamp").isNull(), "invalid_timestamp")
        .when(there["query"] & (values["query"].kind != "text"), "invalid_type:query")
    )
    missing = F.coalesce(*[F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f"missing_required:{f}")) for f in required]) if required else F.lit(None).cast("string")
    out = out.withColumn("anomalies", F.when(first.isNull(), F.array_compact(F.array(*lost))).otherwise(F.expr("CAST(array() AS array<string>)")))
    return out.withColumn("reason", F.coalesce(first, missing)).drop(*[f"_{step}_{f}" for step in ("raw", "kind", "text", "read") for f in PARSED])


@dataclass(frozen=True)
class Loaded:
    """One file's records as a lazy table; events, report and counts derive from it."""

    rows: DataFrame
    source_name: str
    label: int
    path: str = ""
    fmt: str = ""

    def events(self) -> DataFrame:
        valid = self.rows.where("reason IS NULL").withColumns(
            {
                "event_id": event_id(F.lit(self.source_name), F.col("position")),
                "label": F.lit(self.label),
                "source_file": F.col("file"),
                "source_line": F.col("position"),
                "src_ip": F.coalesce("src_ip", F.lit(P.UNKNOWN_SOURCE)),
            }
        )
        return valid.select(*EVENT_COLUMNS)

    def reason_counts(self) -> DataFrame:
        return self.rows.where("reason IS NOT NULL").groupBy("reason").count()

    def anomaly_counts(self) -> DataFrame:
        return self.rows.select(F.explode("anomalies").alias("anomaly")).groupBy("anomaly").count()

    def report(self) -> dict:
        """Counts of seen, valid and invalid records, reasons, anomalies, missing values and presence, in one pass."""
        valid = F.col("reason").isNull()
        lacks = {f: F.sum((valid & (F.col(f).isNull() | ((F.col(f) == "") if f == "query" else F.lit(False)))).cast("long")) for f in PARSED}
        row = self.rows.agg(F.count(F.lit(1)).alias("seen"), F.count_if(valid).alias("valid"), *[c.alias(f) for f, c in lacks.items()]).first()
        seen, good = row["seen"], row["valid"]
        missing = {f: row[f] for f in PARSED if row[f]}
        return {
            "source_name": self.source_name, "path": self.path, "label": self.label, "detected_format": self.fmt,
            "n_records_seen": seen, "n_valid": good, "n_invalid": seen - good, "invalid_fraction": (seen - good) / seen if seen else 0.0,
            "invalid_reasons": {r["reason"]: r["count"] for r in self.reason_counts().collect()},
            "anomalies_coerced_to_missing": {r["anomaly"]: r["count"] for r in self.anomaly_counts().collect()},
            "missing_counts_among_valid": missing,
            "field_presence_fraction": {f: 1.0 - n / good for f, n in missing.items()} if good else {},
        }


def load_file(
    spark: SparkSession, path: str, label: int, source_name: str, mapping=None, fmt: str = "auto", encoding: str = "utf-8",
    required: Sequence[str] = ("timestamp",), numbered: str = "exact",
) -> Loaded:
    """One labelled log file; the label is the file's, a field of that name in it is ignored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"no input file at {path}")
    fmt = detect_format(spark, path) if fmt == "auto" else fmt
    return Loaded(normalize(records(spark, path, fmt, encoding, numbered), mapping, required), source_name, label, path, fmt)


def load_labelled(spark: SparkSession, benign_path: str, tunnel_path: str, max_invalid_fraction: float = 0.5, **options) -> tuple[DataFrame, dict, dict]:
    """(events, reports, availability) of a benign and a tunnel file. Too many invalid records, or a broken table, raise."""
    if not benign_path or not tunnel_path:
        raise ValueError("both a benign and a tunnel path are needed")
    parts, reports = [], {}
    for name, label, path in (("benign", 0, benign_path), ("tunnel", 1, tunnel_path)):
        loaded = load_file(spark, path, label, name, **options)
        told = reports[name] = loaded.report()
        if told["n_records_seen"] and told["invalid_fraction"] > max_invalid_fraction:
            raise ValueError(f"{path}: {told['invalid_fraction']:.1%} of the records are invalid ({told['invalid_reasons']}); check format and field mapping")
        parts.append(loaded.events())
    events = parts[0].unionByName(parts[1])
    check_events(events)
    return events, reports, field_availability(events)


def check_events(events: DataFrame) -> None:
    """Raises unless the table has its columns, rows, unique ids, labels 0 and 1 only, and finite times."""
    missing = [c for c in ("event_id", "label", "timestamp", "src_ip", "query") if c not in events.columns]
    if missing:
        raise ValueError(f"the event table lacks {missing}")
    by_id = events.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("labels"),
        F.bool_and(F.coalesce(F.abs(F.col("timestamp")) < float("inf"), F.lit(False))).alias("times"),
    )
    row = by_id.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.bool_and("labels").alias("labels"), F.bool_and("times").alias("times")).first()
    for bad, what in ((not row["n"], "no valid records"), (row["n"] and row["most"] > 1, "duplicate event ids"), (row["labels"] is False, "labels other than 0 and 1"), (row["times"] is False, "times that are not finite")):
        if bad:
            raise ValueError(f"event table: {what}")


def field_availability(events: DataFrame) -> dict[str, bool]:
    """Which fields have a usable value anywhere in the data set."""
    names = ("dst_ip", "src_port", "dst_port", "proto", "qtype_name", "rcode_name", "answers", "ttls", "rejected", "aa", "tc", "rd", "ra")
    there = {c: F.bool_or(F.col(c).isNotNull()) if c in events.columns else F.lit(False) for c in names}
    there |= {"query": F.bool_or(F.col("query") != ""), "src_ip": F.bool_or(F.col("src_ip") != P.UNKNOWN_SOURCE)}
    return {k: bool(v) for k, v in events.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in there.items()]).first().asDict().items()}


def class_distribution(events: DataFrame, *by: str) -> DataFrame:
    """benign, tunnel, total, ratio and its text, of all events or by columns; no ratio without tunnel events."""
    counts = events.groupBy(*by).agg(F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("tunnel"))
    ratio = F.when(F.col("tunnel") > 0, F.col("benign") / F.col("tunnel"))
    text = F.when(F.col("tunnel") > 0, F.format_string("%.3f:1", ratio)).otherwise("undefined (no tunnel events)")
    return counts.withColumns({"total": F.col("benign") + F.col("tunnel"), "ratio_benign_to_tunnel": ratio, "ratio_text": text})
