"""Mixing sources to target weights by hash thresholds.

Every document gets a 36-bit hash. A histogram sums words by source and the hash's first 12 bits; the running sum tells
in which bucket a source's budget ends, the next histogram looks only into that bucket, and so on three times. What lies
below the last threshold is taken by a filter; nothing is sorted and no document is moved for it. A larger budget only
raises the threshold, so the mix of a smaller one is always contained in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import settle, table, word_count

#: Bits of the hash that one histogram resolves, and how many histograms there are.
LEVEL_BITS = 12
LEVELS = 3
#: Weights of the sources in order, repeating, and the times that a source may be taken at most.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources take the weights in order of their code points, null last. Targets share ``share`` of all words by weight; none exceeds
    ``most_times`` its source's size, and what is cut off goes to the others by weight. One row per source is
    summed before the shuffle; the windows below see only those rows. With sources in order of cap by weight, the first
    ``k`` are cut for the one level at which the rest, by weight, take what remains and fit.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    code_points = Window.orderBy(F.col("source").isNull(), F.col("source"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    own = by_source.withColumn("weight", F.element_at(listed, ((F.row_number().over(code_points) - 1) % len(weights)) + 1))
    own = own.withColumn("cap", F.col("source_size") * float(most_times))
    whole = Window.partitionBy()
    cut_first = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = cut_first.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = own.withColumns({"total": F.sum("source_size").over(whole), "weights": F.sum("weight").over(whole)}).withColumn("level", level)
    first_fit = F.min_by(F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")))
    chosen = levelled.where(F.col("cap") >= F.col("level") * F.col("weight")).agg(first_fit.alias("chosen"))
    return levelled.join(chosen).select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("chosen"), F.lit(float("inf"))) * F.col("weight")).alias("target")
    )


def _bucket(level: int) -> Column:
    """The hash's bits of one histogram."""
    shift = LEVEL_BITS * (LEVELS - 1 - level)
    return F.shiftrightunsigned(F.col("hash"), shift).bitwiseAND((1 << LEVEL_BITS) - 1)


def hash_thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold) such that the sizes of a source's rows with ``hash < threshold`` come near its budget.

    ``docs`` has source, size and hash, ``budgets`` has source and budget. The boundary bucket of the last histogram is
    taken if that comes nearer.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - level)
        inside = docs.join(
            state.withColumnRenamed("source", "own"),
            F.col("source").eqNullSafe(F.col("own")) & (F.shiftrightunsigned(F.col("hash"), shift) == F.col("prefix")),
        )
        histogram = inside.groupBy("own", "budget", "prefix", "below", _bucket(level).alias("bucket")).agg(F.sum("size").alias("size"))
        running = Window.partitionBy("own").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("below") + F.coalesce(F.sum("size").over(running), F.lit(0))
        ends = histogram.withColumn("start", start).where((F.col("start") <= F.col("budget")) & (F.col("start") + F.col("size") > F.col("budget")))
        found = ends.select(
            F.col("own").alias("found"), F.col("start"), F.col("size").alias("last_size"), (F.col("prefix") * (1 << LEVEL_BITS) + F.col("bucket")).alias("next")
        )
        state = settle(
            state.join(found, F.col("source").eqNullSafe(F.col("found"))).select(
                "source", "budget", F.col("next").alias("prefix"), F.col("start").cast("long").alias("below"), "last_size"
            ),
            f"mix-{level}",
        )
        if level < LEVELS - 1:
            state = state.drop("last_size")
    nearer = F.abs(F.col("below") + F.col("last_size") - F.col("budget")) < F.abs(F.col("below") - F.col("budget"))
    return state.select("source", (F.col("prefix") + nearer.cast("long")).alias("threshold"))


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 64 - LEVEL_BITS * LEVELS)


def _plan(rows: DataFrame, weights, most_times: int, share: float) -> DataFrame:
    """(own, source_size, target, whole, threshold): one row per source."""
    targets = settle(source_targets(rows, weights, most_times, share), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    budgets = targets.select("source", (F.col("target") - whole * F.col("source_size")).alias("budget"))
    thresholds = hash_thresholds(rows, budgets).withColumnRenamed("source", "own")
    return targets.join(thresholds, F.col("source").eqNullSafe(F.col("own")), "left").select(
        F.col("source").alias("own"), "source_size", "target", whole.alias("whole"), F.coalesce("threshold", F.lit(0)).alias("threshold")
    )


def _times(most_times: int) -> Column:
    return F.col("whole") + ((F.col("hash") < F.col("threshold")) & (F.col("whole") < most_times)).cast("int")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, most_times: int = MOST_TIMES, share: float = 1.0, seed: int = 17,
) -> DataFrame:
    """(id, source, size, source_size, target, times) for every row: how often the mix takes it, 0 for not at all.

    A target of ``k`` and a bit times its source takes every row ``k`` times and, by hash threshold, some rows once more. Null texts have
    no words; null sources are a source of their own. The hash is of seed, id and text, so reruns agree and repeated rows are taken
    alike. Rows without words cost nothing and follow their hash. Extra columns are ignored.
    """
    rows = settle(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _hash(id_col, text_col, seed).alias("hash")
        ),
        "mix-sizes",
    )
    plan = _plan(rows, weights, most_times, share)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("own"))).select("id", "source", "size", "source_size", "target", _times(most_times).alias("times"))


def mix_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, most_times: int = MOST_TIMES, share: float = 1.0, seed: int = 17,
) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as the mix takes it.

    Only sizes and hashes are gathered for the thresholds; rows then pass a filter where they are. The thresholds, one row per
    source, are broadcast if Spark finds them small, else joined.
    """
    rows = settle(
        docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _hash(id_col, text_col, seed).alias("hash")), "mix-sizes"
    )
    plan = _plan(rows, weights, most_times, share).select("own", "whole", "threshold")
    kept = docs.columns
    out = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), _hash(id_col, text_col, seed).alias("hash"))
    out = out.join(plan, F.col(f"row.{source_col}").eqNullSafe(F.col("own"))).withColumn("times", _times(most_times)).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )
