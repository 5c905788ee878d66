"""Names, addresses and lexical features."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import lexical, net

CASES = {
    "a.b.example.com": ("a.b", "example.com", "registrable"), "a.example.co.id": ("a", "example.co.id", "registrable"), "www.bbc.co.uk": ("www", "bbc.co.uk", "registrable"),
    "WWW.Example.COM.": ("www", "example.com", "registrable"), "": ("", "__empty__", "empty"), None: ("", "__empty__", "empty"), "...": ("", "__empty__", "empty"), "wpad": ("", "wpad", "single_label"),
    "192.168.1.10": ("", "192.168.1.10", "ip"), "2001:db8::1": ("", "2001:db8::1", "ip"), "4.3.2.1.in-addr.arpa": ("4.3", "2.1.in-addr.arpa", "reverse_dns"), "1.in-addr.arpa": ("", "1.in-addr.arpa", "reverse_dns"),
    "printer.office.local": ("printer", "office.local", "local"), "x.y.home.arpa": ("x", "y.home.arpa", "local"), "co.id": ("", "co.id", "public_suffix"), "foo.bar.notatld": ("foo", "bar.notatld", "unlisted_suffix"),
    "a..example.com": ("a", "example.com", "invalid"), "bad name.example.org": ("bad_name", "example.org", "invalid"), "..a": ("", "a", "invalid"), "user.github.io": ("user", "github.io", "registrable"),
    "a.www.ck": ("a", "www.ck", "registrable"), "b.foo.ck": ("", "b.foo.ck", "registrable"), "in-addr.arpa": ("", "in-addr.arpa", "public_suffix"),
}


def test_domain_parts(spark):
    df = spark.createDataFrame([(q,) for q in CASES], "q string")
    got = {r["q"]: (r["p"]["subdomain"], r["p"]["registrable"], r["p"]["kind"]) for r in df.select("q", net.domain_parts(F.col("q")).alias("p")).collect()}
    assert got == CASES
    many = net.SuffixRules.of([*net.PUBLIC_SUFFIXES, *[f"zone{i}.example" for i in range(net.IN_PLACE)]])
    joined = {r["q"]: tuple(r["p"])[1:] for r in net.with_domain_parts(df, "q", many, "p").collect()}
    assert joined == CASES
    private = df.where("q = 'user.github.io'").select(net.domain_parts(F.col("q"), net.SuffixRules.default(private=True)).alias("p")).first()["p"]
    assert private["registrable"] == "user.github.io"


def test_ip_addresses(spark):
    rng = random.Random(2)
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.4", "12345::", "1::2::3", "g::", ":1:2", "1:2:3:4:5:6:7:8", "", "x"]
    for _ in range(200):
        groups = [rng.choice([0, 0, 0, 1, rng.randrange(65536)]) for _ in range(8)]
        texts.append(":".join(f"{g:0{rng.choice([1, 4])}X}" for g in groups))
    want = {}
    for t in texts:
        try:
            want[t] = str(ipaddress.ip_address(t.lower()))
        except ValueError:
            want[t] = None
    want["::ffff:1.2.3.4"] = "::ffff:102:304"
    got = {r["t"]: r["ip"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", net.canonical_ip(F.col("t")).alias("ip")).collect()}
    assert got == want


def test_lexical_vector(spark):
    df = spark.createDataFrame([("a1b2.example.com",), ("",), ("--9",)], "q string")
    parts = df.select("q", net.domain_parts(F.col("q")).alias("p"))
    rows = {r["q"]: r for r in parts.select("q", *[c.alias(n) for n, c in lexical.lexical_features(F.col("p")).items()]).collect()}
    r = rows["a1b2.example.com"]
    assert [r[c] for c in ("query_length", "num_labels", "subdomain_length", "subdomain_num_labels", "max_label_length", "digit_count", "letter_count", "hyphen_count", "unique_char_count", "longest_digit_run", "longest_alpha_run")] == [16, 3, 4, 1, 7, 2, 12, 0, 12, 1, 7]
    assert r["mean_label_length"] == pytest.approx(14 / 3)
    assert rows[""]["num_labels"] == 0 and rows[""]["query_entropy"] == 0 and rows[""]["unique_char_count"] == 0 and rows[""]["is_valid_domain"] == 0
    assert rows["--9"]["hyphen_count"] == 2


def test_entropy(spark):
    df = spark.createDataFrame([(x,) for x in ("", "aaaa", "aabb", "abcd", "aabc")], "t string")
    got = {r["t"]: r["h"] for r in df.select("t", lexical.entropy(F.col("t")).alias("h")).collect()}
    assert got == pytest.approx({"": 0, "aaaa": 0, "aabb": 1, "abcd": 2, "aabc": 1.5}) and str(got["aaaa"]) == "0.0"


def test_list_statistics(spark):
    df = spark.createDataFrame([([10.0, 30.0],), ([],), (None,)], "v array<double>")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in lexical.list_statistics(F.col("v")).items()]).collect()]
    assert got == [(2, 10, 30, 20), (0, None, None, None), (0, None, None, None)]
    assert [tuple(r) for r in df.select(*[c.alias(n) for n, c in lexical.list_statistics(F.col("v"), False).items()]).distinct().collect()] == [(None,) * 4]
