"""Typed parsers of VARIANT values as Column expressions: null for what is missing or cannot be read.

The value's own type decides (a JSON ``true`` is no number), so every parser reads a :class:`Value`, which holds the type.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .net import let, strip

#: Texts that mean "missing", and the source of events without one.
MISSING = ("", "-", "(empty)")
UNKNOWN_SOURCE = "__unknown_src__"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
#: Names of DNS codes.
QTYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 12: "PTR", 13: "HINFO", 15: "MX", 16: "TXT", 17: "RP",
    18: "AFSDB", 24: "SIG", 25: "KEY", 28: "AAAA", 33: "SRV", 35: "NAPTR", 39: "DNAME", 41: "OPT", 43: "DS",
    46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 64: "SVCB", 65: "HTTPS",
    99: "SPF", 250: "TSIG", 251: "IXFR", 252: "AXFR", 255: "ANY", 257: "CAA",
}
RCODES = {
    0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED", 6: "YXDOMAIN", 7: "YXRRSET",
    8: "NXRRSET", 9: "NOTAUTH", 10: "NOTZONE",
}


def kind(value: Column) -> Column:
    """text, bool, int, real, list, object or none."""
    return let(F.schema_of_variant(value), lambda of: _kind(value, of))


def _kind(value: Column, of: Column) -> Column:
    return (
        F.when(value.isNull() | (of == "VOID"), "none")
        .when(of == "STRING", "text")
        .when(of == "BOOLEAN", "bool")
        .when(of.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | of.rlike(r"^DECIMAL\([0-9]+,0\)$"), "int")
        .when(of.isin("FLOAT", "DOUBLE") | of.startswith("DECIMAL"), "real")
        .when(of.startswith("ARRAY"), "list")
        .otherwise("object")
    )


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _real(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _finite(number: Column) -> Column:
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def text_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


class Value(NamedTuple):
    """A variant with its type and its stripped text. The columns are best computed once (:func:`.net.once`), as parsers name them often."""

    raw: Column
    kind: Column
    text: Column

    @classmethod
    def of(cls, raw: Column) -> Value:
        return cls(raw, kind(raw), strip(_text(raw)))


def clean_text(value: Value) -> Column:
    """Stripped text, or a scalar's text form; null for placeholders, lists and objects."""
    return (
        F.when((value.kind == "text") & ~value.text.isin(*MISSING), value.text)
        .when(value.kind == "bool", F.initcap(value.text))
        .when(value.kind == "int", value.text)
        .when(value.kind == "real", _finite(_real(value.raw)).cast("string"))
    )


def parse_timestamp(value: Value) -> Column:
    """Seconds since 1970 from a number or its text, not negative, or from ISO-8601 (without a zone: UTC)."""
    is_text = value.kind == "text"
    number = F.when(value.kind.isin("int", "real"), _real(value.raw)).when(is_text, text_number(value.text))
    moment = F.when(is_text & value.text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(value.text))
    iso = F.unix_micros(moment) / F.lit(1e6)
    return F.when(number.isNotNull(), F.when(_finite(number) >= 0, number)).otherwise(iso)


def parse_int(value: Value) -> Column:
    """Whole numbers of up to 64 bits; what lies beyond is null, as no column type here holds it."""
    real = _finite(_real(value.raw))
    return (
        F.when(value.kind == "int", F.try_variant_get(value.raw, "$", "bigint"))
        .when((value.kind == "real") & (real == F.floor(real)), real.try_cast("bigint"))
        .when((value.kind == "text") & value.text.rlike(INTEGER), value.text.try_cast("bigint"))
    )


def port(number: Column) -> Column:
    """A whole number as a port; null beyond 16 bits."""
    return F.when(number.between(0, 65535), number).cast("int")


def parse_bool(value: Value) -> Column:
    is_text, text = value.kind == "text", F.lower(value.text)
    return (
        F.when(value.kind == "bool", F.try_variant_get(value.raw, "$", "boolean"))
        .when(value.kind.isin("int", "real") & _real(value.raw).isin(0.0, 1.0), _real(value.raw) == 1.0)
        .when(is_text & text.isin("t", "true", "1", "yes"), True)
        .when(is_text & text.isin("f", "false", "0", "no"), False)
    )


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def parse_answers(value: Value) -> Column:
    """Texts of a list or of a comma-separated text, without placeholders; null and empty differ."""
    listed = F.filter(F.transform(_items(value.raw), lambda v: clean_text(Value.of(v))), lambda x: x.isNotNull())
    parts = F.filter(F.transform(F.split(_text(value.raw), ",", -1), strip), lambda x: ~x.isin(*MISSING))
    return F.when(value.kind == "list", listed).when(value.kind == "text", parts)


def parse_ttls(value: Value) -> Column:
    """Numbers from a number, a list or a comma-separated text, finite and not negative; others are left out."""
    keep = lambda x: F.coalesce(_finite(x) >= 0, F.lit(False))
    of_item = lambda v: F.when(v.kind.isin("int", "real"), _real(v.raw)).when(v.kind == "text", text_number(v.text))
    listed = F.filter(F.transform(_items(value.raw), lambda v: of_item(Value.of(v))), keep)
    parts = F.filter(F.transform(F.split(_text(value.raw), ",", -1), lambda p: text_number(strip(p))), keep)
    one = F.filter(F.array(_real(value.raw)), keep)
    return F.when(value.kind == "list", listed).when(value.kind == "text", parts).when(value.kind.isin("int", "real"), one)


def code_name(code: Column, name: Column, names: dict[int, str], prefix: str) -> Column:
    """The given name, else the code's, else prefix and code."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(name, F.try_element_at(table, code.cast("int")), F.concat(F.lit(prefix), code.cast("string")))
