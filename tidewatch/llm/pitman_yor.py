"""Language-model scores by a hierarchical Pitman-Yor model.

Restaurants: one for the words as such, whose base is uniform, and under it one for each context. A context is the word
before, whichever it is; before a text's first word it is the end of a text. Tables of the context restaurants are
customers of the parent.

Nothing of the vocabulary's size is held in one place. Texts are cut into chunks; a chunk sends the distinct (word,
context) pairs of its texts, with their training counts, to buckets of the words' hash. A bucket adds the counts up,
keeps the seating of its words, and answers each chunk with a probability for each pair it asked about. A context's
words lie in many buckets: after each Gibbs sweep every bucket reports its contexts' tables to their homes, ranges of the
contexts' hash, which add them up and answer with the totals. Only sums over all restaurants pass through the driver. Buckets and
homes are numbered by the texts' bytes, so what a task holds at a time does not grow with them.

A sweep takes each dish of each restaurant in turn: its customers leave, with their tables and what those sent to the parent, and sit
down again one after the other by the Chinese restaurant process. How many sit down before the next table opens is drawn at once,
exactly. Dishes see each other's tables as they stood before the sweep. The predictive probabilities of the sweeps after the first are averaged.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ._common import drop_settled, free_unused, remove, scratch, settle, shuffle_width, table, trimmed

#: Words of a chunk, about; bytes of text for each bucket; buckets of a task, and buckets to each home of contexts.
CHUNK_WORDS, BUCKET_BYTES, TASK_BUCKETS, HOME_BUCKETS = 3_000_000, 8 << 20, 4, 8
#: Gibbs sweeps, of which the first ones are not averaged.
SWEEPS, BURN_IN = 3, 1
STRENGTH = 1.0
#: Log probabilities are sent to the chunks in steps of one part in so many.
LOG_STEPS = 2048
#: Bits of a context's hash that tell it apart; words are told apart by all 64.
CONTEXT_MASK = np.uint64((1 << 64) - (1 << 12))
END = b" "  # no word holds a space


def _pack(values, dtype: str) -> bytes:
    """Numbers as compressed planes of bytes: the empty high bytes of small numbers cost nothing."""
    plain = np.ascontiguousarray(values, dtype=dtype)
    return zstandard.compress(np.ascontiguousarray(plain.view(np.uint8).reshape(-1, plain.itemsize).T).tobytes(), 1)


def _unpack(raw: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def _pack_rising(values: np.ndarray) -> bytes:
    """Numbers in ascending order, by their differences."""
    values = np.asarray(values).astype(np.uint64)
    return _pack(np.diff(values, prepend=np.uint64(0)), "<u8")


def _unpack_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, "<u8"), dtype=np.uint64)


def _places(raw: bytes) -> np.ndarray:
    return _unpack_rising(raw).astype(np.int64)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(n, pa.list_(kinds[t[6:-1]]) if t.startswith("array") else kinds[t]) for n, t in (part.split() for part in ddl.split(", "))])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_PARTS = "chunk bigint, bucket int, words binary, heads binary, keys binary, counts binary, lengths binary, places binary, ids array<bigint>, held array<boolean>"
_PART_SCHEMA = _schema(_PARTS)


def bucket_edges(buckets: int) -> np.ndarray:
    """Upper ends of the buckets' ranges of 64-bit hashes."""
    return np.array([((k + 1) << 64) // buckets - 1 for k in range(buckets)], dtype=np.uint64)


class _Chunk:
    """Texts as places in the list of the chunk's distinct (word, context) pairs."""

    def __init__(self):
        self.local: dict[bytes, int] = {END: 0}
        self.tokens, self.lengths, self.ids, self.held, self.size = [], [], [], [], 0

    def add(self, doc_id, held: bool, text: str | None) -> None:
        words = (text or "").encode().lower().split()
        words.append(END)
        local = self.local
        for w in set(words).difference(local):
            local[w] = len(local)
        self.tokens.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
        self.lengths.append(len(words))
        self.ids.append(doc_id)
        self.held.append(held)
        self.size += len(words)

    def rows(self, buckets: int) -> list[tuple]:
        names = list(self.local)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        lengths = np.array(self.lengths)
        tokens = np.concatenate(self.tokens)
        self.tokens, self.local = [], {}
        pairs = rank[tokens]
        pairs *= len(names)
        pairs[1:] += rank[tokens[:-1]]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        pairs[starts] = rank[tokens[starts]] * len(names) + rank[0]
        del tokens
        keys, places = np.unique(pairs, return_inverse=True)
        del pairs
        learnt = np.repeat(~np.array(self.held, bool), lengths)
        counts = np.bincount(places[learnt], minlength=len(keys))
        del learnt
        sorted_hashes = hashes[order]
        word_cuts = np.searchsorted(sorted_hashes, bucket_edges(buckets), side="right")
        pair_cuts = np.searchsorted(keys, word_cuts * len(names))
        chunk, out, w0, p0 = uuid.uuid4().int >> 65, [], 0, 0
        out.append((chunk, -1, None, None, None, None, _pack(lengths, "<u4"), _pack(places, "<u4"), self.ids, self.held))
        for bucket, (w1, p1) in enumerate(zip(word_cuts.tolist(), pair_cuts.tolist(), strict=True)):
            if w1 > w0:
                own = keys[p0:p1]
                heads, local = np.unique(sorted_hashes[own % len(names)] & CONTEXT_MASK, return_inverse=True)
                packed = _pack_rising((own // len(names) - w0) * len(heads) + local)
                out.append((chunk, bucket, _pack_rising(sorted_hashes[w0:w1]), _pack_rising(heads), packed, _pack(counts[p0:p1], "<u4"), None, None, None, None))
            w0, p0 = w1, p1
        return out


def _chunks(buckets: int):
    def run(batches):
        chunk = _Chunk()
        for batch in batches:
            for doc_id, held, text in zip(batch["id"].to_pylist(), batch["held"].to_pylist(), batch["text"], strict=True):
                chunk.add(doc_id, held, text.as_py())
                if chunk.size >= CHUNK_WORDS:
                    yield _rows(chunk.rows(buckets), _PART_SCHEMA)
                    chunk = _Chunk()
        if chunk.ids:
            yield _rows(chunk.rows(buckets), _PART_SCHEMA)

    return trimmed(run)


def _by(key: str, batches):
    """Rows of a key, which come one after the other, as lists of dicts."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != last:
                yield last, rows
                rows = []
            last = row[key]
            rows.append(row)
    if rows:
        yield last, rows


_BUCKET = "bucket int, words binary, heads binary, keys binary, counts binary, asked array<struct<chunk:bigint,places:binary>>"
_ASKED = pa.list_(pa.struct([("chunk", pa.int64()), ("places", pa.binary())]))


def _add_up(batches):
    """A bucket's words and pairs with their counts, and for each chunk the places of the pairs it asked about."""
    for bucket, rows in _by("bucket", batches):
        names = np.unique(np.concatenate([_unpack_rising(r["words"]) for r in rows]))
        heads = np.unique(np.concatenate([_unpack_rising(r["heads"]) for r in rows]))
        keys = []
        for r in rows:
            word, head = np.searchsorted(names, _unpack_rising(r["words"])), np.searchsorted(heads, _unpack_rising(r["heads"]))
            own = _places(r["keys"])
            keys.append(word[own // len(head)] * len(heads) + head[own % len(head)])
        known = np.unique(np.concatenate(keys))
        total, asked = np.zeros(len(known), np.int64), []
        for k, r in enumerate(rows):
            # a chunk's contexts whose hashes agree in the bits kept are one key there too, so its keys are in ascending order
            at = np.searchsorted(known, keys[k])
            np.add.at(total, at, _unpack(r["counts"], "<u4").astype(np.int64))
            asked.append({"chunk": r["chunk"], "places": _pack_rising(at)})
            keys[k] = None
        columns = [
            pa.array([bucket], pa.int32()), pa.array([_pack_rising(names)], pa.binary()), pa.array([_pack_rising(heads)], pa.binary()),
            pa.array([_pack_rising(known)], pa.binary()), pa.array([_pack(total, "<u8")], pa.binary()), pa.array([asked], _ASKED),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "words", "heads", "keys", "counts", "asked"])


def seat(customers: np.ndarray, weight, discount: float, rng) -> np.ndarray:
    """Tables of each dish after its customers sat down one after the other; the first one always takes a new table.

    The next customer, after ``k`` at ``t`` tables, opens one with weight ``weight(dishes, t)`` against ``k - discount * t``. While no table
    opens, that weight holds; the number of customers until the next one opens is then geometric with a chance drawn from
    Beta(weight, k - discount * t), so each step opens a table of every dish that is left.
    """
    tables = (customers > 0).astype(np.int64)
    dish = np.flatnonzero(customers > 1)
    seated, size = np.ones(len(dish)), customers[dish].astype(float)
    while len(dish):
        t = tables[dish]
        chance = rng.beta(np.maximum(weight(dish, t), 1e-300), seated - discount * t)
        with np.errstate(divide="ignore", over="ignore"):
            seated = seated + 1 + np.floor(np.log1p(-rng.random(len(dish))) / np.log1p(-np.minimum(chance, 1 - 1e-16)))
        opened = seated <= size
        dish, seated, size = dish[opened], seated[opened], size[opened]
        tables[dish] += 1
    return tables


class _Seats:
    """A bucket's words and pairs under given totals; ``context`` is the pair's place among the bucket's heads."""

    def __init__(self, row: dict):
        self.bucket = row["bucket"]
        self.hashes, self.heads = _unpack_rising(row["words"]), _unpack_rising(row["heads"])
        keys = _places(row["keys"])
        self.word, self.context = keys // len(self.heads), keys % len(self.heads)
        self.count = _unpack(row["counts"], "<u8").astype(np.int64)
        self.seen = self.sums(self.count)

    def sums(self, per_pair: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights=per_pair, minlength=len(self.hashes)).astype(np.int64)

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """One table for each dish, of contexts' restaurants and of the parent."""
        tables = (self.count > 0).astype(np.int64)
        return tables, (self.sums(tables) > 0).astype(np.int64)

    def parent(self, customers, tables, g: dict, extra=0) -> np.ndarray:
        """Probability of words with so many customers and tables in the parent, which has ``extra`` customers more than ``g`` says."""
        base = (STRENGTH + g["d0"] * g["tables0"]) / g["kinds"]
        return (np.maximum(customers - g["d0"] * np.minimum(tables, customers), 0) + base) / (STRENGTH + g["customers0"] + extra)

    def sweep(self, state: tuple, g: dict, contexts: np.ndarray, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The state after every dish's customers left and sat down again; ``contexts`` has the tables of each context's restaurant."""
        tables, at_parent = state
        rng = np.random.default_rng(seed)
        customers = self.sums(tables)
        left = customers[self.word] - tables
        others = contexts[self.context] - tables

        def new_table(pairs, t):
            word = self.word[pairs]
            kept = np.maximum(at_parent[word], 1)
            p = self.parent(left[pairs] + t, kept, g, t - tables[pairs])
            return (STRENGTH + g["d1"] * (others[pairs] + t)) * p

        tables = seat(self.count, new_table, g["d1"], rng)
        of_parent = lambda words, t: (STRENGTH + g["d0"] * (g["tables0"] - at_parent[words] + t)) / g["kinds"]
        return tables, seat(self.sums(tables), of_parent, g["d0"], rng)

    def predict(self, state: tuple, g: dict, guests: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Probability of each pair's word in its context; restaurants have so many ``guests`` at the tables of ``contexts``."""
        tables, at_parent = state
        p = self.parent(self.sums(tables), at_parent, g)[self.word]
        own = np.maximum(self.count - g["d1"] * tables, 0)
        return (own + (STRENGTH + g["d1"] * contexts[self.context]) * p) / (STRENGTH + guests[self.context])


_HOMES = "home int, asked array<struct<bucket:int,places:binary>>"
_REPORT = "home int, bucket int, customers binary, tables binary, sums array<bigint>, pairs binary, parents binary"
_REPORT_SCHEMA = _schema(_REPORT)
_TOTALS = "bucket int, home int, customers binary, tables binary"
_TOTALS_SCHEMA = _schema(_TOTALS)


def _slices(heads: np.ndarray, homes: int):
    """(home, start, end) of the ordered heads of each home that has some."""
    cuts = np.searchsorted(heads, bucket_edges(homes), side="right").tolist()
    return [(h, a, b) for h, (a, b) in enumerate(zip([0, *cuts], cuts)) if b > a]


def _to_homes(homes: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                heads = _unpack_rising(row["heads"])
                rows = [(home, row["bucket"], _pack_rising(heads[a:b])) for home, a, b in _slices(heads, homes)]
                yield _rows(rows, _schema("home int, bucket int, heads binary"))

    return run


def _settle_homes(batches):
    """For each home, and each bucket that has contexts there, their places among the home's contexts."""
    for home, rows in _by("home", batches):
        known = np.unique(np.concatenate([_unpack_rising(r["heads"]) for r in rows]))
        asked = [{"bucket": r["bucket"], "places": _pack_rising(np.searchsorted(known, _unpack_rising(r["heads"])))} for r in rows]
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("places", pa.binary())]))
        yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), pa.array([asked], kind)], names=["home", "asked"])


def _add_reports(batches):
    """The reports of a home's buckets added up, and the totals for each bucket. Customers come with the first reports only."""
    for batch in batches:
        for row in batch.to_pylist():
            places = {a["bucket"]: _places(a["places"]) for a in row["asked"]}
            size = max(int(p[-1]) for p in places.values()) + 1
            sums = {}
            for name in ("customers", "tables"):
                given = [r for r in row["reports"] if r[name] is not None]
                sums[name] = np.zeros(size, np.int64) if given else None
                for r in given:
                    sums[name][places[r["bucket"]]] += _unpack(r[name], "<u8").astype(np.int64)
            for bucket, p in places.items():
                packed = [None if sums[name] is None else _pack(sums[name][p], "<u8") for name in ("customers", "tables")]
                yield _rows([(bucket, row["home"], *packed)], _TOTALS_SCHEMA)


def _local(totals: list[dict], name: str) -> np.ndarray:
    """A bucket's totals by place: those of its homes one after the other."""
    return np.concatenate([_unpack(r[name], "<u8").astype(np.int64) for r in sorted(totals, key=lambda r: r["home"])])


def _state(row: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_unpack(row[f"s{k}"][n], "<u8").astype(np.int64) for n in ("pairs", "parents"))


def _report(g: dict | None, sweep: int, homes: int):
    """Of each bucket: customers and tables of its contexts for their homes; home -1 has sums over all of them and the bucket's state."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = _Seats(row)
                if g is None:
                    state = s.first()
                else:
                    k = sweep - 1
                    state = s.sweep(_state(row, k), g, _local(row[f"t{k}"], "tables"), [sweep, s.bucket])
                add = lambda per_pair: np.bincount(s.context, weights=per_pair, minlength=len(s.heads))  # noqa: E731, B023
                customers, tables = add(s.count) if g is None else None, add(state[0])
                out = [
                    (home, s.bucket, None if customers is None else _pack(customers[a:b], "<u8"), _pack(tables[a:b], "<u8"), None, None, None)
                    for home, a, b in _slices(s.heads, homes)
                ]
                at = s.sums(state[0])
                sums = (at.sum(), state[1].sum(), s.seen.sum(), (s.seen > 0).sum(), (s.count == 1).sum(), (s.count == 2).sum(), (at == 1).sum(), (at == 2).sum())
                out.append((-1, s.bucket, None, None, [int(x) for x in sums], *[_pack(x, "<u8") for x in state]))
                yield _rows(out, _REPORT_SCHEMA)

    return trimmed(run)


def _gather(words: DataFrame, places: DataFrame, g: dict | None, sweep: int, homes: int) -> tuple[dict, DataFrame, DataFrame]:
    """Sums over all restaurants after a sweep, (bucket, s) with each bucket's state, (bucket, t) with the totals of its contexts."""
    reports = settle(words.mapInArrow(_report(g, sweep, homes), _REPORT), "lm-reports")
    row = reports.where("home < 0").agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)).alias(f"s{k}") for k in range(8)]).first()
    customers0, tables0, tokens, vocabulary, once, twice, once_word, twice_word = map(int, row)

    def discount(once: int, twice: int) -> float:
        return float(min(max(once / (once + 2 * twice), 0.1), 0.95)) if once else 0.5

    by_home = reports.where("home >= 0").groupBy("home").agg(F.collect_list(F.struct("bucket", "customers", "tables")).alias("reports"))
    totals = settle(places.join(by_home.hint("merge"), "home").mapInArrow(_add_reports, _TOTALS), "lm-totals")
    state = settle(reports.where("home < 0").select("bucket", F.struct("pairs", "parents").alias(f"s{sweep}")), "lm-state")
    drop_settled(reports)
    sums = {
        "customers0": customers0, "tables0": tables0, "tokens": tokens, "vocabulary": vocabulary, "kinds": float(vocabulary + 1),
        "d1": discount(once, twice), "d0": discount(once_word, twice_word),
    }
    return sums, state, totals


def _by_bucket(totals: DataFrame, sweep: int) -> DataFrame:
    return totals.groupBy("bucket").agg(F.collect_list(F.struct("home", "customers", "tables")).alias(f"t{sweep}"))


_ANSWER = "chunk bigint, bucket int, logs binary, seen binary, runs binary, lengths binary, places binary, ids array<bigint>, held array<boolean>"
_ANSWER_SCHEMA = _schema(_ANSWER)


def _answer(sums: list[dict], sweeps: list[int]):
    """Probabilities for the chunks: pairs' logs in steps, and how often each of their words was seen, with its number of pairs."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s, guests = _Seats(row), _local(row["t0"], "customers")
                p = sum(s.predict(_state(row, k), sums[k], guests, _local(row[f"t{k}"], "tables")) for k in sweeps) / len(sweeps)
                steps = np.minimum(np.rint(-np.log10(p) * LOG_STEPS), (1 << 16) - 1)
                for ask in row["asked"]:
                    at = _places(ask["places"])
                    words = s.word[at]
                    first = np.flatnonzero(np.diff(words, prepend=-1))
                    runs = np.diff(first, append=len(words))
                    rows = [(ask["chunk"], s.bucket, _pack(steps[at], "<u2"), _pack(s.seen[words[first]], "<u8"), _pack(runs, "<u4"), None, None, None, None)]
                    yield _rows(rows, _ANSWER_SCHEMA)

    return trimmed(run)


_SCORES = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_SCORE_SCHEMA = _schema(_SCORES)


def _score(tokens: int, vocabulary: int):
    def run(batches):
        for _, rows in _by("chunk", batches):
            docs, answers = rows[0], rows[1:]  # bucket -1 comes first, then the pairs in order
            logs = np.concatenate([_unpack(r["logs"], "<u2") for r in answers]).astype(float) / -LOG_STEPS
            seen = np.concatenate([np.repeat(_unpack(r["seen"], "<u8"), _unpack(r["runs"], "<u4")) for r in answers]).astype(float)
            base = np.log10((seen + 1) / (tokens + vocabulary + 1))
            places, lengths = _unpack(docs["places"], "<u4"), _unpack(docs["lengths"], "<u4").astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            columns = [
                docs["ids"], docs["held"], lengths, np.add.reduceat((seen > 0)[places].astype(np.int64), starts), np.full(len(lengths), tokens, np.int64),
                np.add.reduceat(base[places], starts), np.add.reduceat(logs[places], starts),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORE_SCHEMA, strict=True)], schema=_SCORE_SCHEMA)

    return trimmed(run)


def held_out(id_col, parts: int = 7, part: int = 2):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == part


def score_texts(docs: DataFrame, held=None, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; scores are log10 probabilities.

    ``held`` is a condition; rows for which it holds (or is null: no row) are scored but not learnt from. Without any training row, all
    words are as likely as the one unseen. Null texts are empty: they consist of the end token. Repeated rows are learnt from and
    scored each; ids may be null. Extra columns are ignored. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    held = held_out(F.col(id_col)) if held is None else held
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    if not buckets:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(shuffle_width(spark), -(-size // BUCKET_BYTES))
    tasks = max(shuffle_width(spark), -(-buckets // TASK_BUCKETS))
    homes = max(1, buckets // HOME_BUCKETS)
    path = scratch(spark, "lm-chunks")
    source.mapInArrow(_chunks(buckets), _PARTS).withColumn("kind", F.when(F.col("bucket") < 0, "texts").otherwise("pairs")).write.partitionBy("kind").parquet(path)
    parts = spark.read.schema(f"{_PARTS}, kind string").parquet(path)
    pairs = parts.where("kind = 'pairs'").select("bucket", "chunk", "words", "heads", "keys", "counts")
    dealt = pairs.repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk")
    added = settle(dealt.mapInArrow(trimmed(_add_up), _BUCKET), "lm-buckets")
    del pairs, dealt
    remove(spark, f"{path}/kind=pairs")
    free_unused(spark)
    lean = added.select("bucket", "words", "heads", "keys", "counts").repartition(tasks, "bucket").persist(StorageLevel.DISK_ONLY)
    heads = added.select("bucket", "heads").mapInArrow(_to_homes(homes), "home int, bucket int, heads binary")
    homed = settle(heads.repartition(tasks, "home").sortWithinPartitions("home", "bucket").mapInArrow(_settle_homes, _HOMES), "lm-homes")
    places = homed.repartition(tasks, "home").persist(StorageLevel.DISK_ONLY)
    sums, states, totals = [], [], []
    for sweep in range(SWEEPS + 1):
        words = lean
        if sweep:
            words = lean.join(states[-1].hint("merge"), "bucket").join(_by_bucket(totals[-1], sweep - 1).hint("merge"), "bucket")
        g, state, after = _gather(words, places, sums[-1] if sweep else None, sweep, homes)
        sums.append(g)
        states.append(state)
        totals.append(after)
    del words
    for kept in (lean, places):
        kept.unpersist(True)
    del lean, places
    drop_settled(homed)
    for k in range(BURN_IN + 1):
        drop_settled(states[k])
        if k:
            drop_settled(totals[k])
    free_unused(spark)
    sweeps = list(range(BURN_IN + 1, SWEEPS + 1))
    every = added.join(_by_bucket(totals[0], 0).hint("merge"), "bucket")
    for k in sweeps:
        every = every.join(states[k].hint("merge"), "bucket").join(_by_bucket(totals[k], k).hint("merge"), "bucket")
    answers = every.mapInArrow(_answer(sums, sweeps), _ANSWER)
    empty = [F.lit(None).cast("binary").alias(n) for n in ("logs", "seen", "runs")]
    texts = parts.where("kind = 'texts'").select("chunk", "bucket", *empty, "lengths", "places", "ids", "held")
    both = texts.unionByName(answers).repartition(tasks, "chunk").sortWithinPartitions("chunk", "bucket")
    out = settle(both.mapInArrow(_score(sums[0]["tokens"], sums[0]["vocabulary"]), _SCORES), "lm-scores")
    for used in (added, totals[0], *[x[k] for k in sweeps for x in (states, totals)]):
        drop_settled(used)
    remove(spark, path)
    return out


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
