"""Addresses and query names as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that is cut off at the ends, beyond ASCII too.
SPACE = r"[\t-\r\x1C-\x1F\x85\p{Z}]"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?=[0-9])|$)){4}(?<=[0-9])$"
EMPTY, INVALID = "__empty__", "__invalid__"
#: Names under which networks hold their own hosts, in order of precedence.
LOCAL_SUFFIXES = ("local", "lan", "home", "internal", "localdomain", "corp", "intranet", "home.arpa")
#: A small part of the public suffix list; ``*.`` matches any label, ``!`` takes one back.
PUBLIC_SUFFIXES = (
    "com net org edu gov mil int info biz name arpa io co me tv cc app dev xyz online site cloud top club shop "
    "de fr es it nl be ch at se no dk fi pl cz pt gr ie ru ua cn jp kr in id au nz uk us ca br mx ar za eu asia "
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk co.id ac.id or.id go.id web.id sch.id net.id my.id "
    "com.au net.au org.au edu.au gov.au co.nz org.nz net.nz ac.nz govt.nz co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr "
    "com.br net.br org.br gov.br com.cn net.cn org.cn gov.cn edu.cn com.mx com.ar co.za org.za co.in net.in org.in "
    "com.sg sg com.my my com.tr tr com.tw tw com.hk hk th co.th vn com.vn ph com.ph in-addr.arpa ip6.arpa "
    "*.ck !www.ck *.bd *.np *.kawasaki.jp !city.kawasaki.jp"
).split()
#: Suffixes that companies run, used on demand only.
PRIVATE_SUFFIXES = "github.io gitlab.io blogspot.com herokuapp.com netlify.app vercel.app pages.dev workers.dev cloudfront.net s3.amazonaws.com azurewebsites.net firebaseapp.com web.app".split()
#: More rules than this are joined instead of compared in place.
IN_PLACE = 400


@dataclass(frozen=True)
class SuffixRules:
    """Suffix rules and local suffixes of domain splitting."""

    plain: tuple[str, ...]
    wildcard: tuple[str, ...] = ()
    exception: tuple[str, ...] = ()
    local: tuple[str, ...] = LOCAL_SUFFIXES
    source: dict = field(default_factory=dict, compare=False, hash=False)

    @classmethod
    def of(cls, lines, local=LOCAL_SUFFIXES, **source) -> SuffixRules:
        rules = [x.strip().lower() for x in lines]
        local = tuple(x.strip().lower().strip(".") for x in local if x.strip())
        return cls(
            tuple(r for r in rules if r[0] not in "!*"), tuple(r[2:] for r in rules if r.startswith("*.")), tuple(r[1:] for r in rules if r.startswith("!")), local, source
        )

    @classmethod
    def default(cls, private: bool = False, local=LOCAL_SUFFIXES) -> SuffixRules:
        return cls.of([*PUBLIC_SUFFIXES, *(PRIVATE_SUFFIXES if private else ())], local, rules="built in", private=private)

    @classmethod
    def from_file(cls, path: str, private: bool = False, local=LOCAL_SUFFIXES) -> SuffixRules:
        """A file in the public suffix list's format; private rules stand behind its marker."""
        import hashlib

        raw = Path(path).read_bytes()
        public, _, own = raw.decode("utf-8").partition("===BEGIN PRIVATE DOMAINS===")
        lines = [x.split()[0] for x in (public + (own if private else "")).splitlines() if x.strip() and not x.startswith("//")]
        return cls.of(lines, local, rules=path, sha256=hashlib.sha256(raw).hexdigest(), private=private)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns, computed once a row whatever later steps do with them.

    The optimiser copies a column's expression into every filter and expression above it; it does not look through the row
    generator in which the columns are wrapped here.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = df.select(*kept, F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_once"))
    return packed.select(*kept, F.explode(F.array("_once")).alias("_once")).select(*kept, *[F.col("_once").getField(n).alias(n) for n in columns])


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def normalize_query(col: Column) -> Column:
    """Stripped, lower-cased, without dots at the end; null becomes empty."""
    return F.regexp_replace(F.lower(strip(F.coalesce(col, F.lit("")))), r"\.+$", "")


def is_ipv4(col: Column) -> Column:
    return F.coalesce(col.rlike(IPV4), F.lit(False))


def _quad_as_groups(low: Column) -> Column:
    """An IPv4 address at the end as two groups."""
    head, quad = F.regexp_extract(low, r"^(.*:)", 1), F.regexp_extract(low, r"^.*:((?:[0-9]+\.){3}[0-9]+)$", 1)
    part = lambda q, k: F.element_at(F.split(q, r"\."), k).try_cast("int")
    pair = lambda q, a, b: F.lower(F.hex(part(q, a) * 256 + part(q, b)))
    return let(quad, lambda q: F.when(q == "", low).when(q.rlike(IPV4), F.concat(head, pair(q, 1, 2), F.lit(":"), pair(q, 3, 4))))


def _groups(text: Column) -> Column:
    """The eight groups of an IPv6 address, null if they are not eight."""
    none = F.expr("CAST(array() AS array<string>)")

    def filled(halves):
        side = lambda k: F.when(F.coalesce(F.get(halves, F.lit(k)), F.lit("")) == "", none).otherwise(F.split(F.get(halves, F.lit(k)), ":", -1))
        return let(
            F.struct(side(0).alias("l"), side(1).alias("r")),
            lambda x: let(
                8 - F.size(x["l"]) - F.size(x["r"]),
                lambda gap: F.when(((F.size(halves) == 2) & (gap >= 1)) | ((F.size(halves) == 1) & (gap == 0)), F.concat(x["l"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), x["r"])),
            ),
        )

    return let(F.split(text, "::", -1), filled)


def _compressed(full: Column) -> Column:
    """The first of the longest runs of two or more zero groups as ``::``."""
    out = full
    for run in range(2, 9):
        pattern = r"^(.*?)(?:^|:)0(?::0){%d}(?:$|:)(.*)$" % (run - 1)
        found = F.concat(F.regexp_extract(full, pattern, 1), F.lit("::"), F.regexp_extract(full, pattern, 2))
        out = F.when(full.rlike(pattern), found).otherwise(out)
    return out


def canonical_ip(col: Column) -> Column:
    """Text form of an IPv4 or IPv6 address (longest run of zeros compressed, first of equals); null for anything else."""
    valid = lambda g: g.isNotNull() & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
    joined = lambda g: F.array_join(F.transform(g, lambda x: F.regexp_replace(x, "^0+(?=.)", "")), ":")
    six = lambda low: let(_groups(_quad_as_groups(low)), lambda g: F.when(valid(g), let(joined(g), _compressed)))
    return let(F.lower(col), lambda low: F.when(is_ipv4(low), low).when(F.contains(low, F.lit(":")), six(low)))


def is_ip_literal(col: Column) -> Column:
    return F.coalesce(F.when(F.contains(col, F.lit(":")) | col.rlike("^[0-9]"), canonical_ip(col).isNotNull()), F.lit(False))


def is_valid_name(col: Column) -> Column:
    """At most 253 characters in labels of 1 to 63 of ``a-z 0-9 _ * -``."""
    return F.coalesce((F.length(col) <= 253) & col.rlike(r"^[a-z0-9_*-]{1,63}(?:\.[a-z0-9_*-]{1,63})*$"), F.lit(False))


def _tail(labels: Column, n) -> Column:
    """The last n labels, joined; all if there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.greatest(n, F.lit(0))), ".")


def _head(labels: Column, n) -> Column:
    """All but the last n labels, joined."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - n, F.lit(0))), ".")


def _one_of(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("CAST(array() AS array<string>)")


def suffix_labels(labels: Column, rules: SuffixRules) -> Column:
    """Labels that the public suffix has: an exception's less one, else of the longest rule; null if none fits."""
    places = F.when(F.size(labels) > 0, F.sequence(F.lit(1), F.size(labels))).otherwise(F.expr("CAST(array() AS array<int>)"))
    rest = lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    plain, wild, back = _one_of(rules.plain), _one_of(rules.wildcard), _one_of(rules.exception)
    ends = F.filter(places, lambda k: F.array_contains(plain, rest(k)) | ((k < F.size(labels)) & F.array_contains(wild, rest(k + 1))))
    exceptions = F.filter(places, lambda k: F.array_contains(back, rest(k)))
    start = F.when(F.size(exceptions) > 0, F.array_min(exceptions) + 1).otherwise(F.array_min(ends))
    return F.size(labels) - start + 1


def _split(labels: Column, n_suffix: Column, rules: SuffixRules) -> Column:
    """(subdomain, registrable, kind) of a usable name's labels."""
    local = F.array(*[F.struct(F.lit(x).alias("suffix"), F.lit(x.count(".") + 2).alias("keep")) for x in rules.local] or [F.struct(F.lit("").alias("suffix"), F.lit(0).alias("keep"))])
    of = lambda sub, reg, kind: F.struct(sub.alias("subdomain"), reg.alias("registrable"), F.lit(kind).alias("kind"))

    def by_name(name):
        fits = F.filter(local, lambda x: (x["suffix"] != "") & ((name == x["suffix"]) | F.endswith(name, F.concat(F.lit("."), x["suffix"]))))
        return let(
            F.get(fits, F.lit(0)),
            lambda first: F.when(F.size(labels) == 1, of(F.lit(""), name, "single_label"))
            .when(first["suffix"] == name, of(F.lit(""), name, "public_suffix"))
            .when(first.isNotNull(), of(_head(labels, first["keep"]), _tail(labels, first["keep"]), "local"))
            .when(n_suffix.isNull(), of(_head(labels, 2), _tail(labels, 2), "unlisted_suffix"))
            .when(n_suffix >= F.size(labels), of(F.lit(""), name, "public_suffix"))
            .otherwise(of(_head(labels, n_suffix + 1), _tail(labels, n_suffix + 1), "registrable")),
        )

    return let(F.array_join(labels, "."), by_name)


def _usable_labels(q: Column) -> Column:
    """Labels of the name; of an invalid one, those that are not empty with odd characters as underscores."""
    salvaged = F.transform(F.filter(F.split(q, r"\.", -1), lambda x: x != ""), lambda x: F.regexp_replace(x, "[^a-z0-9_*-]", "_"))
    return F.when(is_valid_name(q), F.split(q, r"\.", -1)).otherwise(salvaged)


def _parts(q: Column, labels: Column, n_suffix: Column, rules: SuffixRules) -> Column:
    of = lambda sub, reg, kind: F.struct(q.alias("normalized"), sub.alias("subdomain"), reg.alias("registrable"), F.lit(kind).alias("kind"))
    out = F.when(q == "", of(F.lit(""), F.lit(EMPTY), "empty")).when(is_ip_literal(q), of(F.lit(""), q, "ip"))
    for suffix, keep in (("in-addr.arpa", 2), ("ip6.arpa", 4)):
        before = F.split(F.substring(q, F.lit(1), F.length(q) - len(suffix) - 1), r"\.", -1)
        out = out.when(F.endswith(q, F.lit(f".{suffix}")), of(_head(before, keep), F.concat(_tail(before, keep), F.lit(f".{suffix}")), "reverse_dns"))
    found = _split(labels, n_suffix, rules)
    split = let(
        _split(labels, n_suffix, rules),
        lambda x: F.struct(q.alias("normalized"), x["subdomain"].alias("subdomain"), x["registrable"].alias("registrable"), F.when(is_valid_name(q), x["kind"]).otherwise("invalid").alias("kind")),
    )
    return out.when(F.size(labels) == 0, of(F.lit(""), F.lit(INVALID), "invalid")).otherwise(split)


def domain_parts(col: Column, rules: SuffixRules | None = None) -> Column:
    """Struct (normalized, subdomain, registrable, kind) of a query name, computed in place.

    Kinds: empty, ip, reverse_dns, single_label, local, registrable, public_suffix, unlisted_suffix, invalid. For rule sets beyond
    ``IN_PLACE`` use :func:`with_domain_parts`.
    """
    rules = rules or SuffixRules.default()
    by_labels = lambda q: lambda labels: let(suffix_labels(labels, rules), lambda n: _parts(q, labels, n, rules))
    return let(normalize_query(col), lambda q: let(_usable_labels(q), by_labels(q)))


def with_domain_parts(df: DataFrame, col: str, rules: SuffixRules | None = None, out: str = "parts") -> DataFrame:
    """Adds the struct of :func:`domain_parts`.

    A large rule set becomes a table that is joined by hash to the suffixes of the distinct names, so the cost of a name does
    not grow with the rules; the names' parts are then joined back.
    """
    rules = rules or SuffixRules.default()
    if len(rules.plain) + len(rules.wildcard) + len(rules.exception) <= IN_PLACE:
        return df.withColumn(out, domain_parts(F.col(col), rules))
    spark = df.sparkSession
    rows = [(r, 0) for r in rules.plain] + [(r, 1) for r in rules.wildcard] + [(r, 2) for r in rules.exception]
    known = spark.createDataFrame(rows, "rule string, kind int")
    names = df.select(F.coalesce(F.col(col), F.lit("")).alias("_name")).distinct()
    names = names.withColumn("_q", normalize_query(F.col("_name"))).withColumn("_labels", _usable_labels(F.col("_q")))
    n = F.size("_labels")
    tails = names.select("_name", n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice("_labels", k, F.greatest(n, F.lit(1))), ".")))).select(
        "_name", "n", (F.col("n") - F.col("pos")).alias("size"), F.col("col").alias("rule")
    )
    size = F.when(F.col("kind") == 0, F.col("size")).when((F.col("kind") == 1) & (F.col("size") < F.col("n")), F.col("size") + 1).when(F.col("kind") == 2, F.col("size") - 1)
    best = tails.join(known, "rule").select("_name", "kind", size.alias("size")).where("size IS NOT NULL").groupBy("_name").agg(
        F.coalesce(F.max(F.when(F.col("kind") == 2, F.col("size"))), F.max("size")).alias("_size")
    )
    solved = names.join(best, "_name", "left").select("_name", _parts(F.col("_q"), F.col("_labels"), F.col("_size"), rules).alias(out))
    return df.join(solved, F.coalesce(F.col(col), F.lit("")) == F.col("_name"), "left").drop("_name")
