"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton of all items is built on the driver in blocks of bounded size, each written to the shared folder, and walked once per
training word: the state and the longest match that ends there say which item passages end at that word. A worker takes a batch
of texts through all blocks in turn and holds one block at a time, so a benchmark of any size is done with the memory of one block.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import UPPER, WORD_BYTES, filesystem, scratch, table, trimmed, with_columns

#: Words that make a window; an item of fewer is one window.
WINDOW = 13
#: Words of items in one automaton, which has at most twice as many states.
BLOCK_WORDS = 200_000
#: A document is contaminated if hit words make up at least one in so many of its words.
ONE_IN = 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; none for null."""
    return (text or "").encode().translate(WORD_BYTES).split()


class SuffixAutomaton:
    """All passages of the items. Item ends are kept apart, so no passage crosses from one item into the next."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        owners: list[set[int]] = [set()]
        whole: list[set[int]] = [set()]
        for number, (_, words) in enumerate(items):
            last, path = 0, []
            for word in words:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)), owners, whole)
                path.append(last)
            for state in path:
                owners[state].add(number)
            if words and len(words) < window:
                whole[path[-1]].add(number)
        self._close(owners, whole, [len(words) for _, words in items])

    def _new(self, length: int, step: dict, link: int, owners, whole) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        owners.append(set())
        whole.append(set())
        return len(self.length) - 1

    def _split(self, parent: int, word: int, owners, whole) -> int:
        """The state for exactly ``length[parent] + 1`` words of what ``parent`` reaches by ``word``."""
        old = self.step[parent][word]
        if self.length[old] == self.length[parent] + 1:
            return old
        new = self._new(self.length[parent] + 1, dict(self.step[old]), self.link[old], owners, whole)
        self.link[old] = new
        while parent >= 0 and self.step[parent].get(word) == old:
            self.step[parent][word] = new
            parent = self.link[parent]
        return new

    def _extend(self, last: int, word: int, owners, whole) -> int:
        if word in self.step[last]:
            return self._split(last, word, owners, whole)
        new = self._new(self.length[last] + 1, {}, 0, owners, whole)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, owners, whole)
        return new

    def _close(self, owners, whole, sizes) -> None:
        """For each state: the items that hold its passages, and (words, item) of short items that end there."""
        order = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for state in order:
            if self.length[self.link[state]] >= self.window:  # only these are asked for
                owners[self.link[state]] |= owners[state]
        self.owners = [tuple(sorted(o)) for o in owners]
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        for state in reversed(order):
            own = tuple((sizes[i], i) for i in sorted(whole[state]))
            self.short[state] = own + self.short[self.link[state]]
        self.any_short = any(self.short)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words, [start, end), that windows cover, merged, and the items whose windows occur."""
        step, link, length, window = self.step, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state = matched = 0
        for at, word in enumerate(map(self.vocabulary.get, words)):
            if word is None:
                state = matched = 0
                continue
            while word not in step[state] and state:
                state = link[state]
                matched = length[state]
            state = step[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                self._add(spans, at + 1 - window, at + 1)
                here = state
                while length[link[here]] >= window:
                    here = link[here]
                items.update(self.owners[here])
            if self.any_short:
                for size, item in self.short[state]:
                    if size <= matched:
                        self._add(spans, at + 1 - size, at + 1)
                        items.add(item)
        return spans, items

    @staticmethod
    def _add(spans, start: int, end: int) -> None:
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append((start, end))


@dataclass(frozen=True)
class Limits:
    """What goes: spans of more than ``words`` hit words, and all hit spans of texts of which one word in ``one_in`` is hit."""

    words: int = WINDOW - 1
    one_in: int = ONE_IN


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """Lists of (id, words) of about ``block_words`` words; the driver holds one at a time. Longer items stand alone."""
    block, size = [], 0
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
    for row in items.orderBy("i", "t").toLocalIterator(prefetchPartitions=False):
        words = words_of(row["t"])
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["i"], words))
        size += len(words)
    yield block


def find_items(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: Limits | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged [start, end) in words) and ``hit_items`` (ids as strings, distinct, sorted).

    Null texts have no words; null or empty items make no window; items that share an id count as one, with the windows of each.
    With ``cut``, spans beyond these limits are taken out of the text on the way, as ``cut_spans`` does; the new columns tell of the whole text.
    Rows are kept as they are otherwise, repeated ones too. Columns called like the new ones are replaced. Very long texts cost in proportion.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    folder = scratch(spark, "automata")
    store, place = filesystem(folder)
    store.create_dir(place, recursive=True)
    blocks = []
    for k, block in enumerate(item_blocks(benchmark, item_col, item_text, block_words)):
        blocks.append(f"block-{k}.bin")
        with store.open_output_stream(f"{place}/{blocks[-1]}") as out:
            out.write(zlib.compress(pickle.dumps(SuffixAutomaton(block, window), pickle.HIGHEST_PROTOCOL), 1))
    out = docs.withColumns(
        {"n_words": F.lit(0).cast("long"), "hit_spans": F.expr("CAST(array() AS array<array<int>>)"), "hit_items": F.expr("CAST(array() AS array<string>)")}
    )
    return out.mapInArrow(trimmed(_walker(folder, blocks, text_col, cut)), out.schema)


def _walker(folder: str, blocks: list[str], text_col: str, cut: Limits | None):
    def walk(batches):
        store, place = filesystem(folder)
        held = {}

        def automaton(name: str) -> SuffixAutomaton:
            if name not in held:
                held.clear()
                with store.open_input_stream(f"{place}/{name}") as file:
                    held[name] = pickle.loads(zlib.decompress(file.read()))
            return held[name]

        for batch in batches:
            counts = [0] * len(batch)
            spans: list[list] = [[] for _ in counts]
            items: list[set] = [set() for _ in counts]
            for name in blocks:
                block = automaton(name)
                for k, text in enumerate(batch[text_col]):
                    words = words_of(text.as_py())
                    counts[k] = len(words)
                    new_spans, new_items = block.hits(words)
                    items[k].update(block.names[i] for i in new_items)
                    if spans[k] and new_spans:
                        merged: list = []
                        for a, b in sorted(spans[k] + new_spans):
                            SuffixAutomaton._add(merged, a, b)
                        new_spans = merged
                    spans[k] = new_spans or spans[k]
            new = {"n_words": counts, "hit_spans": spans, "hit_items": [sorted(i) for i in items]}
            if cut and any(spans):
                new[text_col] = [shortened(t.as_py(), s, n, cut) for t, s, n in zip(batch[text_col], spans, counts, strict=True)]
            yield with_columns(batch, **new)

    return walk


def _n_hit():
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + F.element_at(s, 2) - F.element_at(s, 1))


def contaminated(one_in: int = ONE_IN):
    """At least one word in ``one_in`` is hit."""
    return (_n_hit() > 0) & (one_in * _n_hit() >= F.col("n_words"))


def shortened(text: str | None, spans, n_words: int, limits: Limits) -> str | None:
    """The text without the spans beyond the limits, each cut from word to word."""
    total = sum(b - a for a, b in spans)
    gone = [s for s in spans if s[1] - s[0] > limits.words or limits.one_in * total >= n_words]
    if not gone:
        return text
    raw = text.encode()
    at = [(m.start(), m.end()) for m in WORD.finditer(raw)]
    for a, b in reversed(gone):
        raw = raw[: at[a][0]] + raw[at[b - 1][1] :]
    return raw.decode()


def cut_spans(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The output of ``find_items`` with the spans beyond the limits cut out of the text."""

    def cut(batches):
        for batch in batches:
            rows = zip(batch[text_col].to_pylist(), batch["hit_spans"].to_pylist(), batch["n_words"].to_pylist(), strict=True)
            yield with_columns(batch, **{text_col: [shortened(text, spans, n, limits) for text, spans, n in rows]})

    return docs.mapInArrow(cut, docs.schema)


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), p AS (
  SELECT DISTINCT item, n, array_to_string(ws[j:j + n - 1], ' ') AS g
  FROM (SELECT item, ws, least(len(ws), {WINDOW}) AS n, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS j FROM i WHERE len(ws) > 0)
), m AS (
  SELECT k, j, n, array_to_string(ws[j:j + n - 1], ' ') AS g
  FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)
), h AS (SELECT DISTINCT k, j, n, item FROM m JOIN p USING (n, g)),
c AS (SELECT k, count(DISTINCT pos) AS n_hit FROM (SELECT k, unnest(range(j, j + n)) AS pos FROM h) GROUP BY k),
l AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN l USING (k)
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark occurs in every document."""
    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        _n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
