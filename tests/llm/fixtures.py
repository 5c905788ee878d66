"""Rows that every corpus operator must stand: nulls, empty and very long texts, ties, repeated rows."""

import pyarrow.parquet as pq

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "Lorem ipsum dolor sit amet, Consectetur 42 élan. " * 6000


def base_rows(n=60):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, n).to_pylist()
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table]


def odd_rows():
    return [
        (100_001, None, None, None, None),
        (100_002, "", "en", "src0", 0),
        (100_003, " \t\n\x0b", "en", None, 4),
        (100_004, LONG, "en", "src0", len(LONG)),
        (100_005, LONG, "en", "src1", len(LONG)),
        (100_006, "same words here", "en", "src1", 1),
        (100_006, "same words here", "en", "src1", 1),
        (100_007, "Same  words\nhere", "en", "src2", 1),
        (None, "no id at all", "en", "src2", 1),
        (100_008, "NUL \x00 and \U0001f600 emoji ÄÖÜ İ \u212a", "de", "", 1),
    ]


def table(spark, name, rows, schema=SCHEMA, folder=None):
    """Writes rows where a query finds them; returns the folder."""
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder
