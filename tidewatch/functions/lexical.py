"""Features of one name and of one response, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .net import SuffixRules, once, with_domain_parts

#: Fixed names and order of the feature groups.
LEXICAL_CONTINUOUS = (
    "query_length", "num_labels", "subdomain_length", "subdomain_num_labels", "max_label_length", "mean_label_length",
    "query_entropy", "subdomain_entropy", "digit_count", "digit_ratio", "letter_count", "letter_ratio", "hyphen_count",
    "hyphen_ratio", "unique_char_count", "unique_char_ratio", "longest_digit_run", "longest_alpha_run",
)
LEXICAL_BINARY = ("is_ip_query", "is_reverse_dns", "is_single_label", "is_valid_domain")
RESPONSE_CONTINUOUS = ("num_answers", "num_ttls", "ttl_min", "ttl_max", "ttl_mean")
RESPONSE_BINARY = ("is_nxdomain", "flag_aa", "flag_tc", "flag_rd", "flag_ra", "rejected_flag")
CATEGORICAL = ("qtype_cat", "rcode_cat", "proto_cat")
CONTINUOUS = LEXICAL_CONTINUOUS + RESPONSE_CONTINUOUS
BINARY = LEXICAL_BINARY + RESPONSE_BINARY
METADATA = ("sld", "subdomain", "domain_kind")
#: Fixed names that no classifier may see.
FORBIDDEN = frozenset("src_ip dst_ip query sld subdomain domain_kind timestamp event_id source_file source_line label".split())
#: Fields whose presence in the whole data set decides whether their features exist.
OPTIONAL_FIELDS = ("answers", "ttls", "aa", "tc", "rd", "ra", "rejected")


def entropy(col: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for the empty text."""
    n = F.length(col).cast("double")
    share = lambda c: (n - F.length(F.replace(col, c, F.lit("")))) / n
    total = F.aggregate(F.array_distinct(F.split(col, "")), F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c)))
    return F.when(F.length(col) == 0, F.lit(0.0)).otherwise(F.lit(0.0) - total)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _kept(col: Column, others: str) -> Column:
    return F.length(F.regexp_replace(col, others, ""))


def _longest(col: Column, run: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(col, F.lit(run), F.lit(0)), F.length)), F.lit(0))


def lexical_features(parts: Column) -> dict[str, Column]:
    """The lexical features and the metadata of a ``domain_parts`` struct."""
    q, sub, kind = parts["normalized"], parts["subdomain"], parts["kind"]
    n = F.length(q)
    labels, sub_labels = F.split(q, r"\.", -1), F.split(sub, r"\.", -1)
    lengths = F.transform(labels, F.length)
    digits, letters, hyphens = _kept(q, "[^0-9]"), _kept(q, "[^a-z]"), _kept(q, "[^-]")
    unique = F.when(n == 0, 0).otherwise(F.size(F.array_distinct(F.split(q, ""))))
    numbers = {
        "query_length": n,
        "num_labels": F.when(n == 0, 0).otherwise(F.size(labels)),
        "subdomain_length": F.length(sub),
        "subdomain_num_labels": F.when(sub == "", 0).otherwise(F.size(sub_labels)),
        "max_label_length": F.array_max(lengths),
        "mean_label_length": F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / F.size(labels),
        "query_entropy": entropy(q),
        "subdomain_entropy": entropy(sub),
        "digit_count": digits,
        "digit_ratio": ratio(digits, n),
        "letter_count": letters,
        "letter_ratio": ratio(letters, n),
        "hyphen_count": hyphens,
        "hyphen_ratio": ratio(hyphens, n),
        "unique_char_count": unique,
        "unique_char_ratio": ratio(unique, n),
        "longest_digit_run": _longest(q, "[0-9]+"),
        "longest_alpha_run": _longest(q, "[a-z]+"),
        "is_ip_query": kind == "ip",
        "is_reverse_dns": kind == "reverse_dns",
        "is_single_label": kind == "single_label",
        "is_valid_domain": ~kind.isin("empty", "invalid"),
    }
    return {"sld": parts["registrable"], "subdomain": sub, "domain_kind": kind} | {k: v.cast("double") for k, v in numbers.items()}


def list_statistics(values: Column, available: bool = True) -> dict[str, Column]:
    """count (0 for null), min, max and mean (null for null and empty) of an array; all null if the field does not exist."""
    if not available:
        return {k: F.lit(None).cast("double") for k in ("count", "min", "max", "mean")}
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return {
        "count": F.coalesce(F.size(values), F.lit(0)).cast("double"),
        "min": F.array_min(values).cast("double"),
        "max": F.array_max(values).cast("double"),
        "mean": F.when(F.size(values) > 0, total / F.size(values)),
    }


def response_features(available: Mapping[str, bool]) -> dict[str, Column]:
    """Features of a response's fields; a field that the data set lacks gives nulls."""
    answers, ttls = F.col("answers"), list_statistics(F.col("ttls"), available["ttls"])
    flag = lambda name: (F.col(name).cast("double") if available[name] else F.lit(None).cast("double"))
    rcode = F.coalesce(F.col("rcode_name"), F.lit("MISSING"))
    return {
        "num_answers": F.coalesce(F.size(answers), F.lit(0)).cast("double") if available["answers"] else F.lit(None).cast("double"),
        "num_ttls": ttls["count"], "ttl_min": ttls["min"], "ttl_max": ttls["max"], "ttl_mean": ttls["mean"],
        "is_nxdomain": (rcode == "NXDOMAIN").cast("double"),
        "flag_aa": flag("aa"), "flag_tc": flag("tc"), "flag_rd": flag("rd"), "flag_ra": flag("ra"), "rejected_flag": flag("rejected"),
        "qtype_cat": F.coalesce(F.col("qtype_name"), F.lit("MISSING")), "rcode_cat": rcode, "proto_cat": F.coalesce(F.col("proto"), F.lit("MISSING")),
    }


def resolve_availability(events: DataFrame, given: Mapping[str, bool] | None = None) -> dict[str, bool]:
    """Which optional fields the data set has; what is not given is found by one aggregate."""
    given = dict(given or {})
    ask = [c for c in OPTIONAL_FIELDS if c not in given and c in events.columns]
    found = events.agg(*[F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in ask]).first().asDict() if ask else {}
    return {c: bool(given.get(c, found.get(c, False))) for c in OPTIONAL_FIELDS}


def add_event_features(events: DataFrame, availability: Mapping[str, bool] | None = None, rules: SuffixRules | None = None) -> DataFrame:
    """Events with the 36 event features and the three metadata columns; nothing is shuffled for them."""
    available = resolve_availability(events, availability)
    out = with_domain_parts(events, "query", rules, "_parts")
    out = once(out, {"_parts": F.col("_parts")})
    columns = lexical_features(F.col("_parts")) | response_features(available)
    return out.withColumns({c: columns[c] for c in (*METADATA, *CONTINUOUS, *BINARY, *CATEGORICAL)}).drop("_parts")


def feature_groups(categorical: bool = True) -> tuple[list[str], list[str], list[str]]:
    return list(CONTINUOUS), list(BINARY), list(CATEGORICAL) if categorical else []


def check_no_metadata(names) -> None:
    used = sorted(FORBIDDEN & set(names))
    if used:
        raise ValueError(f"metadata must not become features: {used}")
