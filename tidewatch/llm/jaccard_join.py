"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Pigeonhole over a partitioned universe. The 64-bit hashes of shingles are cut into ``m`` equal segments, a number that
depends on the band of set sizes. Two sets of similarity ``t`` differ in at most ``(1-t)/(1+t) * (|x|+|y|)`` shingles, so
among segments whose credits (1 for an exact one, 2 for one that allows a deletion) add up to more than
that, at least one holds subsets that are equal, or differ by one deletion where that is allowed. Each document files the hash of each segment's subset, and
under segments that allow a deletion those of all subsets without one shingle. A cost model with the number of documents
of each band sets how many segments allow deletions and how much slack there is: credits add up to that much more than
needed, so a document may leave out as many segments. One part of the slack is for empty exact segments, the other for
values that many documents share; a document with more of either than the slack leaves out none of them.

Candidates go through exact bounds (sizes, and a parity sketch that a shingle can change in one bit only), then
both texts are compared. Nothing is decided by a hash of a set alone.

The steps: 1. sizes, digests, sketches; equal sets become one class. 2. A few segments of each class find most
links early: every document is compared with the smallest one that shares such a segment, which is linear in the
documents. 3. All segments; within a segment's value only documents of different components are compared. 4. Components.
Where the links themselves are asked for, steps 2 and 4 are left out and every class is a component of its own in 3.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop_settled, free_unused, settle, shuffle_width, small_batches, table, trimmed, workspace
from .components import connected_components

#: Words of a shingle; the similarity asked for, as a fraction.
SHINGLE, NEED = 5, (4, 5)
#: Segments of each document under each of two partitions in the second step.
FIRST_SEGMENTS = 6
#: Components, or documents of several components, that share a segment's value beyond which it counts as common.
COMMON, COMMON_DOCS = 12, 64
#: Chance, for the cost model, that a shingle of one document is in an unrelated one.
SHARED = 0.001
#: Rows that cost as much as one comparison of two texts.
PAIR_COST = 50
#: Width of a segment that allows a deletion, in exact ones.
WIDE = 3
#: Sets of fewer shingles are linked with equal ones only.
LEAST = 4
#: 64-bit words of the parity sketch, and of its fold, which is compared first.
SKETCH_WORDS, FOLD_WORDS = 32, 8
#: Bits of the filter of ids that keeps most texts out of a shuffle; fixed, whatever the number of ids.
FILTER_BITS = 1 << 20
#: Documents of one packed block; buckets per shuffle partition.
BLOCK_DOCS, BUCKETS_EACH = 2500, 4
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text, the distinct hashes of its shingles in ascending order."""
    split = [(t or "").encode().lower().split() for t in texts]
    names = list(set().union(*split))
    hashes = dict(zip(names, map(xxhash.xxh64_intdigest, names), strict=True))
    out = []
    for words in split:
        n = len(words)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        if n < SHINGLE:
            out.append(_mix((h * _STEPS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
            continue
        total = h[: n - SHINGLE + 1] * _STEPS[0]
        for k in range(1, SHINGLE):
            total = total + h[k : n - SHINGLE + 1 + k] * _STEPS[k]
        h = _mix(total)
        h.sort()
        out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
    return out


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, of ascending hashes."""
    if not len(x) or not len(y):
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if NEED[1] * len(small) < NEED[0] * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return NEED[1] * both >= NEED[0] * (len(x) + len(y) - both)


def bands(largest: int) -> list[tuple[int, int]]:
    """Inclusive ranges of set sizes; linked sets lie in the same or in neighbouring ones."""
    out, low = [(1, 1)], 2
    while low <= max(largest, 2):
        high = low * NEED[1] // NEED[0]
        out.append((low, high))
        low = high + 1
    return out


@dataclass(frozen=True)
class Allocation:
    """Segments of a band, of which the first ``loose`` ones allow a deletion.

    Of its exact segments a document may leave out ``slack`` empty ones. ``common`` credits more may be lost to values
    that many documents share; as a linked pair without such values meets that often more, rarer meetings are chance.
    """

    segments: int
    loose: int
    slack: int
    common: int


def allocate(high: int, n_docs: int) -> Allocation:
    """The cheapest allocation for sets of up to ``high`` shingles and partners a band above."""
    differ = (high + high * NEED[1] // NEED[0]) // 9
    common = min(3, differ // 6)
    best = None
    for slack in [k for k in (0, 1, 2, 3, 4, 5, 6, 8, 11, 15, 20, 27, 36, 48, 64, 85, 113, 150, 200) if k <= differ]:
        wanted = differ + 1 + slack + common
        for loose in {0, wanted // 8, wanted // 4, wanted // 2, (wanted + 1) // 2}:
            exact = max(wanted - 2 * loose, 0)
            if slack > exact:
                continue
            fill = high * 0.9 / (exact + WIDE * loose)
            wide = fill * WIDE
            rows = exact + loose * (1 + wide)
            alike = exact * max(math.exp(-2 * fill * (1 - SHARED)) - math.exp(-2 * fill + fill * SHARED), 0.0)
            empty = exact * math.exp(-fill)
            term = left = math.exp(-empty)
            for k in range(1, slack + 1):
                term *= empty / k
                left += term
            more = 1 - left
            again = 1 - math.exp(-alike) * sum(alike**k / math.factorial(k) for k in range(common + 1))
            nearly = loose * (math.exp(-wide) * (1 + wide)) ** 2  # a deletion can empty a loose segment
            compare = PAIR_COST * max(1.0, high / 100)  # long texts cost more
            cost = rows + n_docs * (alike + compare * (max(again, 0.0) + max(more, 0.0) ** 2) + nearly)
            if best is None or cost < best[0]:
                best = cost, Allocation(exact + loose, loose, slack, common)
    return best[1]


@lru_cache(maxsize=256)
def _edges(given: Allocation) -> np.ndarray:
    """Where the segments after the first begin; loose ones are ``WIDE`` times as wide."""
    exact = given.segments - given.loose
    ends = [WIDE * k for k in range(1, given.loose + 1)] + [WIDE * given.loose + k for k in range(1, exact + 1)]
    return np.array([(e << 64) // ends[-1] for e in ends[:-1]], np.uint64)


def segment_values(hashes: np.ndarray, band: int, given: Allocation) -> tuple[np.ndarray, np.ndarray]:
    """(values, empty): one per segment, then one per shingle of a loose segment without that shingle.

    ``empty`` marks exact segments without shingles.
    """
    with np.errstate(over="ignore"):
        own = _mix(hashes + np.uint64(0x2545F4914F6CDD1D))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
        cuts = np.concatenate([[0], np.searchsorted(hashes, _edges(given)), [len(hashes)]])
        subset = sums[cuts[1:]] - sums[cuts[:-1]]
        place = (np.arange(given.segments, dtype=np.uint64) + np.uint64((band << 32) % (1 << 64))) * np.uint64(0x9FB21C651E98DF25)
        values = _mix(subset + place)
        empty = (cuts[1:] == cuts[:-1]) & (np.arange(given.segments) >= given.loose)
        if given.loose:
            of = np.repeat(np.arange(given.loose), np.diff(cuts[: given.loose + 1]))
            less = _mix(subset[of] - own[: cuts[given.loose]] + place[of])
            values = np.concatenate([values, less])
            empty = np.concatenate([empty, np.zeros(len(less), bool)])
    return values, empty


def _sketch(hashes: np.ndarray) -> list[int]:
    """Parities of the shingles by their low bits, behind their fold: either way a shingle turns one bit."""
    bits = np.bincount((hashes & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    words = np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")
    return [*np.bitwise_xor.reduce(words.reshape(-1, FOLD_WORDS)).tolist(), *words.tolist()]


_CLASS = "id bigint, n bigint, digest binary, first array<bigint>, sketch array<bigint>"
_CLASS_SCHEMA = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("first", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def _describe(batches):
    """Size, digest, sketch and the first segments of every set."""
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            rows = []
            for doc_id, h in zip(part["id"].to_pylist(), shingle_sets(part["text"].to_pylist()), strict=True):
                first = _first_values(h).view(np.int64).tolist()
                rows.append((doc_id, len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), first, _sketch(h)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CLASS_SCHEMA, strict=True)], schema=_CLASS_SCHEMA)


def _first_values(h: np.ndarray) -> np.ndarray:
    """The smallest values of exact segments under two partitions, of which documents of like sizes have one in common at least."""
    if len(h) < LEAST:
        return np.empty(0, np.uint64)
    power = max(1 << (len(h).bit_length() - 3), 1)
    found = []
    for segments in (power, 2 * power):
        values, empty = segment_values(h, -segments, Allocation(segments, 0, 0, 0))
        found.append(np.sort(values[~empty])[:FIRST_SEGMENTS])
    return np.concatenate(found)


def _id_filter(ids: DataFrame, id_col: str, work):
    """A condition that holds for all the ids, and for few others while they are fewer than the filter's bits.

    The filter is a table of one row that plans name as a scalar subquery; as a literal it would be part of every plan's text.
    """
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(FILTER_BITS))
    bytes_ = ids.select(F.shiftright(place, 3).cast("int").alias("at"), F.pmod(place, F.lit(8)).cast("int").alias("bit"))
    found = bytes_.groupBy("at").agg(F.expr("bit_or(shiftleft(1, bit))").cast("int").alias("bits")).toArrow()
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    held[found["at"].to_numpy()] = found["bits"].to_numpy()
    row = ids.sparkSession.createDataFrame(pa.table({"held": pa.array([held.tobytes()], pa.binary())}))
    sent = work.settle(row.coalesce(1), "id-filter").scalar()

    def condition(col):
        p = F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))
        byte = F.conv(F.hex(F.substring(sent, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), F.pmod(p, F.lit(8)).cast("int") + 1)) != 0

    return condition


def _fits():
    """Sizes (na, nb) and sketches (sa, sb) that a linked pair may have: each shingle that differs turns one bit of the sketch."""
    turned = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    fold = sum((turned(F.col("sa")[k], F.col("sb")[k]) for k in range(1, FOLD_WORDS)), turned(F.col("sa")[0], F.col("sb")[0]))
    whole = F.aggregate(F.zip_with("sa", "sb", turned), -fold, lambda total, x: total + x)  # the fold's words come first
    limit = F.col("na") + F.col("nb")
    return (NEED[1] * F.least("na", "nb") >= NEED[0] * F.greatest("na", "nb")) & (9 * fold <= limit) & (9 * whole <= limit)


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and sketches allow to be linked."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(_fits()).select("a", "b")


def _compare(batches):
    last, kept = None, None
    for batch in batches:
        hits = []
        for k in range(0, len(batch), 128):
            part = batch.slice(k, 128)
            a, b, left = part["a"].to_pylist(), part["b"].to_pylist(), part["text_a"]
            right = shingle_sets(part["text_b"].to_pylist())
            for i, y in enumerate(right):
                if a[i] != last:
                    last, kept = a[i], shingle_sets([left[i].as_py()])[0]
                if linked(kept, y):
                    hits.append((a[i], b[i]))
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, work) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts are linked. Only texts of the pairs are moved."""
    ids = pairs.select(F.col("a").alias("need")).union(pairs.select("b")).distinct()
    near = texts.where(_id_filter(ids, "need", work)(F.col("id")))
    wanted = settle(near.join(ids.hint("merge"), F.col("id") == F.col("need"), "left_semi").dropDuplicates(["id"]), "texts")
    second = pairs.join(wanted.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    out = work.settle(both.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(_compare), "a bigint, b bigint"), "linked")
    drop_settled(wanted)
    free_unused(texts.sparkSession)
    return out


_BLOCK = "bucket int, docs binary, labels binary, sizes binary, vals binary, owners binary, flags binary"


def _pack(values, dtype: str) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, dtype=dtype).tobytes(), 1)


def _unpack(raw: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), dtype=dtype)


def _file_segments(plan: list[tuple[int, int]], given: dict[int, Allocation], buckets: int):
    """Blocks of documents as packed rows by bucket of the segments' values.

    Flags: bit 0 for a document from the band above (two of those do not meet here), bit 1 for a value of a loose segment,
    and from bit 2 the credits of common values that it may leave out.
    """
    highs = np.array([h for _, h in plan])

    def filed(block):
        docs, labels, sets = zip(*block, strict=True)
        docs = np.array(docs, np.int64)
        order = np.argsort(docs, kind="stable")
        values, owners, flags = [], [], []
        for place, i in enumerate(order.tolist()):
            h = sets[i]
            own = int(np.searchsorted(highs, len(h)))
            for band in (own, own - 1):
                if band < 0 or band not in given or (band < own and NEED[1] * plan[band][1] < NEED[0] * len(h)):
                    continue
                v, empty = segment_values(h, band, given[band])
                f = np.full(len(v), (band < own) + 4 * given[band].common, np.uint8)
                f[: given[band].loose] |= 2
                f[given[band].segments :] |= 2
                if int(empty.sum()) <= given[band].slack:
                    v, f = v[~empty], f[~empty]
                values.append(v)
                owners.append(np.full(len(v), place, np.uint32))
                flags.append(f)
        if not values:
            return None
        values, owners, flags = np.concatenate(values), np.concatenate(owners), np.concatenate(flags)
        by = np.argsort(values, kind="stable")
        values, owners, flags = values[by], owners[by], flags[by]
        ends = np.searchsorted(values, np.array([((k + 1) << 64) // buckets - 1 for k in range(buckets)], np.uint64), side="right")
        rows, a = [], 0
        docs, labels = docs[order], np.array(labels, np.int64)[order]
        sizes = np.array([len(sets[i]) for i in order])
        for bucket, b in enumerate(ends.tolist()):
            if b > a:
                used, local = np.unique(owners[a:b], return_inverse=True)
                ids = docs[used]
                rows.append(
                    (bucket, _pack(np.diff(ids, prepend=0), "<i8"), _pack(ids - labels[used], "<i8"), _pack(sizes[used], "<u4"),
                     _pack(np.diff(values[a:b], prepend=np.uint64(0)), "<u8"), _pack(local, "<u2"), _pack(flags[a:b], "u1"))
                )
            a = b
        names = ["bucket", "docs", "labels", "sizes", "vals", "owners", "flags"]
        kinds = [pa.int32()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        block = []
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                sets = shingle_sets(part["text"].to_pylist())
                block += [x for x in zip(part["id"].to_pylist(), part["label"].to_pylist(), sets, strict=True) if len(x[2]) >= LEAST]
                if len(block) >= BLOCK_DOCS:
                    if (out := filed(block)) is not None:
                        yield out
                    block = []
        if block and (out := filed(block)) is not None:
            yield out

    return run


_FOUND = "value bigint, a bigint, b bigint, flags int, credits bigint, label bigint"


def _meet(batches):
    """Within each value: pairs (a, b) of different components, or, if those or their documents are many, its documents (a, null).

    Of the pairs, sizes must fit and one document at least must be of the value's own band. They come with the credits of the
    bucket's values at which they meet, and in ``flags`` with those that common values may cost.
    """

    def bucket(rows):
        parts = [np.cumsum(_unpack(r["vals"], "<u8"), dtype=np.uint64) for r in rows]
        ordered = np.sort(np.concatenate(parts))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        docs, labels, sizes, values, flags = [], [], [], [], []
        for r, v in zip(rows, parts, strict=True):
            at = np.searchsorted(twice, v)
            at[at == len(twice)] = 0
            kept = np.flatnonzero(twice[at] == v) if len(twice) else np.empty(0, np.int64)
            ids = np.cumsum(_unpack(r["docs"], "<i8"))
            own = _unpack(r["owners"], "<u2")[kept]
            docs.append(ids[own])
            labels.append((ids - _unpack(r["labels"], "<i8"))[own])
            sizes.append(_unpack(r["sizes"], "<u4")[own].astype(np.int64))
            values.append(v[kept])
            flags.append(_unpack(r["flags"], "u1")[kept])
        values, labels, docs, sizes, flags = (np.concatenate(x) for x in (values, labels, docs, sizes, flags))
        if not len(values):
            return
        order = np.lexsort((docs, labels, values))
        values, labels, docs, sizes, flags = (x[order] for x in (values, labels, docs, sizes, flags))
        start = np.concatenate([[True], values[1:] != values[:-1]])
        run = np.cumsum(start) - 1
        other = np.concatenate([[False], (labels[1:] != labels[:-1]) & ~start[1:]])
        kinds = np.bincount(run, weights=other).astype(np.int64) + 1
        firsts = np.flatnonzero(start)
        ends = np.concatenate([firsts[1:], [len(values)]])
        out_a, out_b, out_f = [], [], []
        shared = (kinds > COMMON) | ((kinds > 1) & (ends - firsts > COMMON_DOCS))
        for r in np.flatnonzero((kinds > 1) & ~shared).tolist():
            s = slice(firsts[r], ends[r])
            d, c, n, f = docs[s], labels[s], sizes[s], flags[s] & 1
            kind = int(flags[s.start]) & ~1
            for at in range(len(d) - 1):
                fit = (c[at + 1 :] != c[at]) & (NEED[1] * np.minimum(n[at + 1 :], n[at]) >= NEED[0] * np.maximum(n[at + 1 :], n[at])) & ((f[at + 1 :] & f[at]) == 0)
                if fit.any():
                    found = d[at + 1 :][fit]
                    out_a.append(np.minimum(found, d[at]))
                    out_b.append(np.maximum(found, d[at]))
                    out_f.append(np.full(len(found), kind, np.int64))
        common = shared[run]
        one, two, kind = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b, out_f))
        order = np.lexsort((two, one))
        one, two, kind = one[order], two[order], kind[order]
        new = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.empty(0, bool))
        credits = np.add.reduceat(1 + ((kind >> 1) & 1), new) if len(new) else np.empty(0, np.int64)
        n, k = len(new), int(common.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(n, np.int64), values[common].view(np.int64)])),
                pa.array(np.concatenate([one[new], docs[common]])),
                pa.array([*two[new].tolist(), *[None] * k], pa.int64()),
                pa.array(np.concatenate([kind[new] >> 2, flags[common].astype(np.int64)]).astype(np.int32)),
                pa.array(np.concatenate([credits, np.zeros(k, np.int64)])),
                pa.array(np.concatenate([one[new], labels[common]])),
            ],
            names=["value", "a", "b", "flags", "credits", "label"],
        )

    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["bucket"] != last:
                yield from bucket(rows)
                rows = []
            last = row["bucket"]
            rows.append(row)
    if rows:
        yield from bucket(rows)


def _common_credits(common: DataFrame) -> DataFrame:
    """(doc, credits, allowed): what a document has in common values, and may leave out of them."""
    credits = F.sum(1 + F.shiftright(F.col("flags").bitwiseAND(2), 1))
    return common.groupBy(F.col("a").alias("doc")).agg(credits.alias("credits"), F.min(F.shiftright("flags", 2)).alias("allowed"))


def _sides(asking: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = asking.select("value", F.col("a").alias("x"), F.col("flags").alias("fx"), F.col("label").alias("lx"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = asking.select("value", F.col("a").alias("y"), F.col("flags").alias("fy"), F.col("label").alias("ly"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return left, right


def _common_pairs(asking: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels that values of many documents leave over, of documents that have more of these than they may leave out.

    A linked pair that met by such values only has, on either side, more of them than that. Sizes and sketches are part of the join's
    condition, so pairs that cannot be linked are never made.
    """
    left, right = _sides(asking)
    apart = (F.col("x") < F.col("y")) & (F.col("lx") != F.col("ly")) & (F.col("fx").bitwiseAND(F.col("fy")).bitwiseAND(1) == 0)
    met = left.join(right, "value").where(apart & _fits())
    pairs = met.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum(1 + F.shiftright(F.col("fx").bitwiseAND(2), 1)).alias("credits"), F.min(F.shiftright("fx", 2)).alias("allowed"))
    return pairs.where("credits > allowed").select("a", "b")


def _first_of_labels(asking: DataFrame) -> DataFrame:
    """Pairs (a, b) to try first: of any two labels that share a value, one document each."""
    own = asking.groupBy("value", "label").agg(F.min_by(F.struct(*[c for c in asking.columns if c not in ("value", "label")]), "a").alias("r"))
    left, right = _sides(own.select("value", "label", "r.*"))
    apart = (F.col("lx") < F.col("ly")) & (F.col("fx").bitwiseAND(F.col("fy")).bitwiseAND(1) == 0)
    met = left.join(right, "value").where(apart & _fits()).groupBy("lx", "ly").agg(F.min(F.struct("x", "y")).alias("p"))
    return met.select(F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, class_id, component_id) for every row.

    A set is a text's distinct shingles of five white-space separated words, A-Z lower-cased; fewer words are one
    shingle. ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable by links of
    similarity 0.8 or more. Texts without words, null ones too, are linked with nothing: both are the row's own id. Rows of one id must
    have one text; repeated rows each come back. Rows with a null id are told apart by their row and come back with a null
    id and component: they join nothing. Extra columns are ignored.
    """
    with small_batches(docs.sparkSession), workspace(docs.sparkSession) as work:
        return settle(_components(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work), "jaccard")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b), a < b: every link of similarity 0.8 or more between two classes, by their smallest ids.

    Sets, classes and nulls are those of ``jaccard_components``; documents of one class are linked with each other and, all alike, with
    the classes that theirs is linked with. No component stands in for a link: all candidates are compared.
    """
    with small_batches(docs.sparkSession), workspace(docs.sparkSession) as work:
        source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        _, _, member, heads = _classes(source, work)
        return settle(_all_links(source, member, heads, work), "links")


def jaccard_link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links) for every row: the number of other classes that the row's class is linked with."""
    with small_batches(docs.sparkSession), workspace(docs.sparkSession) as work:
        source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        classes, least, member, heads = _classes(source, work)
        links = _all_links(source, member, heads, work)
        ends = links.select(F.col("a").alias("node")).unionAll(links.select("b"))
        counts = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        out = _own_class(classes, least).join(counts.hint("merge"), F.col("class_id") == F.col("node"), "left")
        return settle(out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "link-counts")


def _classes(source: DataFrame, work) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sets of all rows, smallest id by digest, class of every id with a set, and the sets of the classes' smallest ids."""
    classes = work.settle(source.mapInArrow(trimmed(_describe), _CLASS), "sets")
    sets = classes.where("n > 0 AND id IS NOT NULL")
    least = work.settle(sets.groupBy("digest").agg(F.min("id").alias("class_id")), "classes")
    member = sets.join(least.hint("merge"), "digest").select("id", "class_id")
    heads = work.settle(sets.join(least.select(F.col("class_id").alias("id")).hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "heads")
    return classes, least, member, heads


def _own_class(classes: DataFrame, least: DataFrame) -> DataFrame:
    out = classes.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("own"))
    return out.join(least.hint("merge"), F.col("own") == F.col("digest"), "left")


def _all_links(source: DataFrame, member: DataFrame, heads: DataFrame, work) -> DataFrame:
    copies = member.where("id <> class_id").select("id", F.lit(None).cast("long").alias("label"))
    return _cross_links(source, heads, work.settle(copies, "copies"), work)


def _components(source: DataFrame, work) -> DataFrame:
    classes, least, member, heads = _classes(source, work)
    filed = heads.where(F.col("n") >= LEAST).select("id", F.explode("first").alias("value"))
    shared = filed.groupBy("value").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").select("value", "a")
    stars = filed.join(work.settle(shared, "shared").hint("merge"), "value").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = _verified(work.settle(_possible(stars, heads), "star-pairs"), source, work)
    labels = work.keep(connected_components(links))
    moved = work.settle(
        member.where("id <> class_id").select("id", F.lit(None).cast("long").alias("label")).union(
            labels.where("node <> component").select("node", "component").join(heads.select("id"), F.col("node") == F.col("id"), "left_semi")
        ),
        "moved",
    )
    more = _cross_links(source, heads, moved, work, joined=links)
    final = work.keep(connected_components(links.union(more)))
    out = _own_class(classes, least).join(final.hint("merge"), F.col("class_id") == F.col("node"), "left")
    return out.select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component", "class_id", "id").alias("component_id")
    )


def _cross_links(source: DataFrame, heads: DataFrame, moved: DataFrame, work, joined: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of the classes' smallest ids whose labels differ.

    A document's label is its own id unless ``moved`` has another; those with a null label there are left out. With ``joined``, the
    links behind the labels, links that these and the ones found imply are left out.
    """
    spark = source.sparkSession
    stats = heads.where(F.col("n") >= LEAST).groupBy("n").agg(F.count(F.lit(1)).alias("docs"))
    top = stats.agg(F.max("n")).first()[0] or 1
    plan = bands(int(top))
    edges = F.array(*[F.lit(h) for _, h in plan])
    band_docs = {r["band"]: r["docs"] for r in stats.groupBy(F.size(F.filter(edges, lambda h: h < F.col("n"))).alias("band")).agg(F.sum("docs").alias("docs")).collect()}
    given = {b: allocate(plan[b][1], band_docs.get(b, 0) + band_docs.get(b + 1, 0)) for b in range(len(plan)) if band_docs.get(b)}

    is_moved = _id_filter(moved.select("id"), "id", work)
    once = source.where("id IS NOT NULL")
    still = once.where(~is_moved(F.col("id"))).withColumn("label", F.col("id"))
    check = moved.select(F.col("id").alias("own"), "label", F.lit(True).alias("known"))
    asked = once.where(is_moved(F.col("id"))).join(check.hint("merge"), F.col("id") == F.col("own"), "left").where("known IS NULL OR label IS NOT NULL")
    placed = still.select("id", "text", "label").union(asked.select("id", "text", F.coalesce("label", "id").alias("label")))
    buckets = BUCKETS_EACH * shuffle_width(spark)
    blocks = placed.mapInArrow(trimmed(_file_segments(plan, given, buckets)), _BLOCK)
    dealt = blocks.repartition(shuffle_width(spark), "bucket").sortWithinPartitions("bucket")
    found = work.settle(dealt.mapInArrow(trimmed(_meet), _FOUND), "met")
    free_unused(spark)
    met = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("credits").alias("credits"), F.min("flags").alias("allowed"))
    common = found.where("b IS NULL")
    lost = work.settle(_common_credits(common), "lost")
    often = met.join(lost.select(F.col("doc").alias("a"), F.col("credits").alias("la")), "a", "left")
    often = often.join(lost.select(F.col("doc").alias("b"), F.col("credits").alias("lb")), "b", "left")
    often = often.where(F.col("credits") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))) > F.col("allowed")).select("a", "b")
    lots = lost.where("credits > allowed").select(F.col("doc").alias("a"))
    asking = work.settle(common.join(lots, "a", "left_semi").join(heads.select(F.col("id").alias("a"), "n", "sketch"), "a"), "asking")
    early = None
    if joined is not None and asking.where("label <> a").limit(1).count():
        early = _verified(work.settle(_possible(often.union(_first_of_labels(asking)).distinct(), heads), "first-pairs"), source, work)
        asking = _relabelled(asking, joined.union(early), work)
        often = None
    last = _common_pairs(asking)
    last = last if often is None else often.union(last).distinct()
    links = _verified(work.settle(_possible(last, heads), "cross-pairs"), source, work)
    return links if early is None else work.settle(links.union(early).distinct(), "cross-links")


def _relabelled(asking: DataFrame, links: DataFrame, work) -> DataFrame:
    """``asking`` with the components of the links found so far as labels."""
    now = work.keep(connected_components(links))
    out = asking.join(now.hint("merge"), F.col("a") == F.col("node"), "left")
    return work.settle(out.withColumn("label", F.coalesce("component", "a")).drop("node", "component"), "asking-now")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id")


def op1_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document and the number of other classes it is linked with."""
    return jaccard_link_counts(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.i >= 80 * (na.n + nb.n - p.i)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT doc_id, min(seen) AS component FROM r GROUP BY doc_id),
q AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM (SELECT doc_id, list_sort(list(sh)) AS k FROM s GROUP BY doc_id))
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id, coalesce(q.class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)
"""
