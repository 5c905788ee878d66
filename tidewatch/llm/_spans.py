"""Places of regular-expression matches as array columns, without Python on the executors.

``aggregate`` copies the array it builds at every step, so a running sum over all matches of a very long text would take time in the
square of their number. Arrays are cut into blocks: each block is summed by itself, the blocks' sums are added up, and every block's items are moved by
what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a block.
BLOCK = 128
_PLACE = "array<struct<start:int,end:int,value:string,own:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks_of(items: Column) -> Column:
    """The array as an array of arrays of ``BLOCK`` items; one empty block for none. ``items`` must be cheap to name."""
    last = F.greatest(F.size(items) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), (last / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def _within(block: Column) -> Column:
    """(at, found): the characters of a block of gaps and matches, and its matches' places from the block's begin."""

    def add(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["value"])
        place = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"), p["own"].alias("own"))
        return F.when(p["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["found"], F.array(place)).alias("found")))

    return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {_PLACE})").alias("found")), add)


def match_places(text: Column, pattern, group: int = 0) -> Column:
    """Array of (start, end, value, own) for leftmost, non-overlapping matches, in code points, end exclusive.

    What lies between the matches comes from ``split`` on the same pattern, so a match begins after the lengths of all
    gaps and matches before it. ``value`` is the whole match, ``own`` the given group of it. Matches must not be empty.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    own = F.regexp_extract_all(text, pattern, F.lit(group)) if group else whole
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("value"), own.alias("own"))

    def moved(block, before):
        return F.transform(
            block["found"],
            lambda m: F.struct((m["start"] + before).alias("start"), (m["end"] + before).alias("end"), m["value"].alias("value"), m["own"].alias("own")),
        )

    def joined(blocks):
        zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("starts"))
        starts = F.aggregate(
            blocks,
            zero,
            lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        )["starts"]
        return F.flatten(F.zip_with(blocks, starts, moved))

    return let(parts, lambda p: let(F.transform(blocks_of(p), _within), joined))
