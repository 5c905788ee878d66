"""Loader: formats, reasons, anomalies, reports."""

import pytest

from tidewatch.sources import records, synthetic

LINES = [
    '{"ts": 1.5, "id.orig_h": "10.0.0.1", "id": {"orig_h": "9.9.9.9", "resp_h": "8.8.8.8"}, "query": "A.Example.com.", "qtype": 1, "rcode": 3, "answers": [], "TTLs": [1, 2.5, "3", null, true, -1], "AA": true, "RD": "T", "proto": "UDP"}',
    '{"ts": 2, "quer', "", "[1, 2, 3]", "12345", '{"ts": "not-a-time", "query": "x"}', '{"query": "x"}', '{"ts": 1, "query": ["a"]}', '{"ts": 1.0}',
    '{"ts": 1, "id.orig_h": "not-an-ip", "answers": "-", "TTLs": null, "ttls": 7, "qtype": 999, "id.orig_p": 70000, "label": 1}',
    '{"ts": "2024-01-02T03:04:05.5+01:00", "answers": "a, b,-", "TTLs": "5, x,6", "AA": "yes", "rejected": 2}',
    '{"ts": "-"}', '{"ts": true}',
]


@pytest.fixture
def loaded(spark, tmp_path):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    (tmp_path / "log.jsonl").write_text("\n".join(LINES))
    return records.load_file(spark, str(tmp_path / "log.jsonl"), 0, "benign")


def test_report(loaded):
    told = loaded.report()
    assert (told["n_records_seen"], told["n_valid"], told["n_invalid"], told["detected_format"]) == (12, 4, 8, "jsonl")
    assert told["invalid_reasons"] == {"invalid_json": 1, "not_an_object": 2, "invalid_timestamp": 3, "missing_required:timestamp": 1, "invalid_type:query": 1}
    assert told["anomalies_coerced_to_missing"] == {"unparsable:src_ip": 1, "unparsable:src_port": 1, "unparsable:rejected": 1}
    assert told["missing_counts_among_valid"]["query"] == 3 and "timestamp" not in told["missing_counts_among_valid"]


def test_values(loaded):
    rows = {r["source_line"]: r for r in loaded.events().collect()}
    a, b, c = rows[1], rows[10], rows[11]
    assert (a["src_ip"], a["dst_ip"], a["query"], a["qtype_name"], a["rcode_name"], a["proto"]) == ("10.0.0.1", "8.8.8.8", "a.example.com", "A", "NXDOMAIN", "udp")
    assert (a["answers"], a["ttls"], a["aa"], a["rd"], a["tc"]) == ([], [1.0, 2.5, 3.0], True, True, None)
    assert (b["src_ip"], b["answers"], b["ttls"], b["qtype_name"], b["src_port"], b["label"]) == ("__unknown_src__", [], None, "TYPE999", None, 0)
    assert (c["timestamp"], c["answers"], c["ttls"], c["aa"], c["rejected"]) == (1704161045.5, ["a", "b"], [5.0, 6.0], True, None)
    assert rows[9]["event_id"].startswith("evt_") and len(rows[9]["event_id"]) == 20


def test_large_file_numbering(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(LINES))
    exact, split = (sorted(r["position"] for r in records.scan_jsonl(spark, str(tmp_path / "log.jsonl"), numbered=n).collect()) for n in ("exact", "offset"))
    assert exact == split == [1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]


def test_array_and_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿ [{"ts": 1, "query": "a"}, 5, {"ts": true}]')
    told = records.load_file(spark, str(tmp_path / "a.json"), 1, "tunnel").report()
    assert told["detected_format"] == "json_array" and told["invalid_reasons"] == {"not_an_object": 1, "invalid_timestamp": 1} and told["n_valid"] == 1
    (tmp_path / "bad.json").write_text('[{"ts": 1}, ')
    with pytest.raises(Exception, match="not a JSON array"):
        records.load_file(spark, str(tmp_path / "bad.json"), 1, "tunnel").report()
    with pytest.raises(FileNotFoundError):
        records.load_file(spark, str(tmp_path / "none.json"), 1, "tunnel")
    (tmp_path / "l.jsonl").write_bytes('{"ts": 1, "query": "caf\xe9"}'.encode("latin-1"))
    assert records.load_file(spark, str(tmp_path / "l.jsonl"), 0, "x", encoding="ISO-8859-1").events().first()["query"] == "café"


def test_labelled_load_and_checks(spark, tmp_path):
    benign, tunnel = synthetic.write_logs(spark, f"file://{tmp_path}", 300, 60, seed=7, noise=True)
    events, reports, there = records.load_labelled(spark, benign, tunnel)
    assert reports["benign"]["n_valid"] == 303 and reports["tunnel"]["n_valid"] == 60
    assert there["answers"] and there["ttls"] and events.where("label = 1").count() == 60
    row = records.class_distribution(events).first()
    assert (row["benign"], row["tunnel"], row["ratio_text"]) == (303, 60, "5.050:1")
    assert records.class_distribution(events.where("label = 0")).first()["ratio_text"].startswith("undefined")
    with pytest.raises(ValueError, match="invalid"):
        records.load_labelled(spark, benign, tunnel, max_invalid_fraction=0.001)
    with pytest.raises(ValueError, match="duplicate"):
        records.check_events(events.union(events.limit(1)))
    with pytest.raises(ValueError, match="no valid"):
        records.check_events(events.limit(0))
