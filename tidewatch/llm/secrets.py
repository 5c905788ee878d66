"""Secrets in texts, and whether each belongs to one owner or is copied about.

Every kind has a literal gate; only texts that contain it run the kind's regular expression. The values found are
hashed and counted by distinct owners and distinct repositories over the whole corpus: a value that several owners
publish, or very many repositories, is an example from documentation, one that few places of a single owner hold looks live. Counting goes through
(hash, owner, repository) rows that are made distinct before the shuffle, so a value in a third of all texts costs a row
per owner and task. All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import settle, table
from ._spans import match_places


@dataclass(frozen=True)
class Kind:
    """``gates``: a text without any of these (lower-cased if ``fold``) holds no match. ``least``: characters of the group."""

    name: str
    pattern: str
    gates: tuple[str, ...]
    group: int = 0
    least: int = 1
    fold: bool = False


#: Fixed values of the contract, in its order.
BASE_KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 6, True),
    Kind("access", r"AKIA[A-Z0-9]+", ("AKIA",), 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", (), 0, 24),
)
#: Formats of public services and files.
MORE_KINDS = (
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{20,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Kind("google", r"AIza[0-9A-Za-z_-]{35}", ("AIza",)),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", ("eyJ",)),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Kind("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}", ("k_live_",)),
    Kind("userinfo", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/@]{1,100}@", ("://",)),
)
KINDS = BASE_KINDS + MORE_KINDS
#: Owners, or repositories whoever owns them, from which on a value counts as copied about.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 20
SPAN = "array<struct<start:int,place:int,end:int,kind:string,value:string>>"


def _found(text: Column, low: Column, at: int, kind: Kind) -> Column:
    gate = F.lit(False)
    for g in kind.gates:
        gate = gate | F.contains(low if kind.fold else text, F.lit(g))
    if not kind.gates:
        gate = text.rlike(kind.pattern)
    places = F.filter(match_places(text, kind.pattern, kind.group), lambda m: F.length(m["own"]) >= kind.least)
    spans = F.transform(
        places,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(at).alias("place"), m["end"].alias("end"), F.lit(kind.name).alias("kind"), m["own"].alias("value")
        ),
    )
    return F.when(gate, spans).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def find_secrets(docs: DataFrame, text_col: str = "text", kinds=KINDS) -> DataFrame:
    """``docs`` with ``secrets``: array of (start, place, end, kind, value) by start, then by the kinds' order.

    Null and empty texts have none. The text is read once for each kind whose gate it passes; time goes with its length and, by a small
    factor, its number of matches, so very long texts are no worse than many short ones. A column called ``secrets`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    found = F.concat(*[_found(text, low, i, k) for i, k in enumerate(kinds)])
    return docs.drop("secrets").withColumn("secrets", F.array_sort(found))


def _digests() -> Column:
    return F.array_distinct(F.transform("secrets", lambda s: F.unhex(F.sha2(s["value"], 256))))


def value_owners(found: DataFrame, owner_col: str, repository_col: str) -> DataFrame:
    """(digest, owners, repositories) for every value in ``secrets``; null owners and repositories count as one each."""
    pairs = found.where(F.size("secrets") > 0).select(
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"),
        F.explode(_digests()).alias("digest"),
    )
    by_repository = pairs.distinct()
    by_owner = by_repository.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan_secrets(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", copied: int = COPIED_OWNERS,
    copied_repositories: int = COPIED_REPOSITORIES, keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``secrets`` and, of their distinct values, how many look live (``n_live``) or copied (``n_copied``).

    ``keep`` names the columns of ``docs`` that come back, all if null. A document is a repository: rows that repeat an id are one; null ids
    are told apart by their text. Every row comes back, those without a secret past all joins. The spans are found once and written, with
    the kept columns, to the shared folder. Columns called like the new ones are replaced.
    """
    docs = docs.drop("secrets", "n_live", "n_copied", "_owner", "_repository", "_row", "_held")
    keep = docs.columns if keep is None else keep
    text_hash = F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    repository = F.when(F.size("secrets") > 0, F.coalesce(F.col(id_col).cast("string"), text_hash))
    found = find_secrets(docs, text_col).select(
        *keep, "secrets", F.col(owner_col).cast("string").alias("_owner"), repository.alias("_repository"), F.monotonically_increasing_id().alias("_row")
    )
    found = settle(found, "secrets")
    held = found.where(F.size("secrets") > 0)
    common = (F.col("owners") >= copied) | (F.col("repositories") >= copied_repositories)
    verdicts = (
        held.select(F.col("_row").alias("_held"), F.explode(_digests()).alias("digest"))
        .join(value_owners(held, "_owner", "_repository"), "digest")
        .groupBy("_held")
        .agg(F.sum((~common).cast("long")).alias("n_live"), F.sum(common.cast("long")).alias("n_copied"))
    )
    judged = held.join(verdicts, F.col("_row") == F.col("_held")).select(*keep, "secrets", "n_live", "n_copied")
    none = F.lit(0).cast("long")
    return judged.unionByName(found.where(F.size("secrets") == 0).select(*keep, "secrets", none.alias("n_live"), none.alias("n_copied")))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(name: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == name)).cast("long")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; text is reduced to its spans before anything is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    base = F.filter("secrets", lambda s: s["place"] < len(BASE_KINDS))
    count = {f"n_{k.name}": _of_kind(k.name) for k in BASE_KINDS}
    return scan_secrets(docs, keep=["doc_id"]).select(
        "doc_id",
        *[c.alias(n) for n, c in count.items()],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("secrets")).alias("spans"),
        "n_live",
        "n_copied",
    )
