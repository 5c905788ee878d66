"""Toxicity by class-conditional Kneser-Ney models of words' letters.

Two models, one of toxic and one of ordinary documents, give each byte of a word its probability after the four before
it. The highest order counts each class for itself; all lower orders are shared continuation counts of both
classes, so an expression that one class has hardly shown is smoothed by what both have. The difference of the
two log-likelihoods, by word, is summed and normalised by the document's length; beside it stand the numbers of words whose difference
passes some limits. A logistic curve turns these into a score. It is fitted on the labelled rows the models learn from, each
scored by models that have not seen the row's own part of the labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD_BYTES, drop_settled, settle, table, trimmed

ORDER = 5
#: Bound of the labelled rows of each class that are learnt from; of equal hashes the smaller id counts.
CLASS_DOCS = 8_000
#: Parts of the labelled rows that are learnt from, by the remainder of the id's hash by 5; 0 is held out.
PARTS = (1, 2, 3, 4)
#: Words whose difference a worker keeps.
KEPT_WORDS = 150_000
#: A document's words count when their difference passes these.
LIMITS = np.array([1.5, 2.5, 3.5, 4.5])
N_FEATURES = 4 + 2 * len(LIMITS)
_PAD = b" " * (ORDER - 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(WORD_BYTES).split()


def gram_codes(words: list[bytes]) -> np.ndarray:
    """The ``ORDER`` bytes up to and including each byte of each word and its end, as numbers."""
    if not words:
        return np.empty(0, np.int64)
    raw = np.frombuffer(_PAD + _PAD.join(words) + b" ", np.uint8).astype(np.int64)
    code = np.zeros(len(raw) - ORDER + 1, np.int64)
    for k in range(ORDER):
        code = (code << 8) | raw[k : len(raw) - ORDER + 1 + k]
    return code[(code & 255 != 32) | ((code >> 8) & 255 != 32)]


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=values, minlength=len(found))


def _discount(counts: np.ndarray) -> float:
    """Of counts of counts, kept off the ends."""
    once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


def _look(table_keys: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(table_keys, keys), max(len(table_keys) - 1, 0))
    if not len(table_keys):
        return np.full(len(keys), default)
    return np.where(table_keys[at] == keys, values[at], default)


def _shared(grams: np.ndarray, order: int) -> np.ndarray:
    """Probability of each gram's last byte by continuation counts of this and lower orders. ``grams`` are distinct and in order."""
    if order == 0:
        return np.full(len(grams), 1 / 256)
    keep = (1 << 8 * order) - 1
    lower, continuations = _sums(grams & keep, np.ones(len(grams)))
    below = _shared(lower, order - 1)
    context, total = _sums(lower >> 8, continuations)
    _, kinds = _sums(lower >> 8, np.ones(len(lower)))
    at = np.searchsorted(context, lower >> 8)
    d = _discount(continuations)
    p = (np.maximum(continuations - d, 0) + d * kinds[at] * below) / total[at]
    return p[np.searchsorted(lower, grams & keep)]


@dataclass
class KneserNeyContrast:
    """log P(byte | before, toxic) - log P(byte | before, ordinary): by gram, and by context where neither has the gram."""

    grams: np.ndarray
    differences: np.ndarray
    contexts: np.ndarray
    fallbacks: np.ndarray

    @classmethod
    def fit(cls, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> KneserNeyContrast:
        """``grams`` distinct and in order, with their counts in each class."""
        if not len(grams):
            return cls(*[np.empty(0, t) for t in (np.int64, float, np.int64, float)])
        shared = _shared(grams, ORDER - 1)
        contexts = np.unique(grams >> 8)
        at = np.searchsorted(contexts, grams >> 8)
        logs, weights = [], []
        for counts in (toxic, ordinary):
            d = _discount(counts)
            total = np.bincount(at, weights=counts, minlength=len(contexts))
            kinds = np.bincount(at, weights=counts > 0, minlength=len(contexts))
            left = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            logs.append(np.log(np.maximum(counts - d, 0) / np.maximum(total[at], 1) + left[at] * shared))
            weights.append(np.log(left))
        return cls(grams, logs[0] - logs[1], contexts, weights[0] - weights[1])

    def by_word(self, words: list[bytes]) -> np.ndarray:
        """Sum of the differences over each word's bytes and its end."""
        if not words:
            return np.empty(0)
        codes = gram_codes(words)
        value = _look(self.grams, self.differences, codes, np.nan)
        missing = np.isnan(value)
        value[missing] = _look(self.contexts, self.fallbacks, codes[missing] >> 8, 0.0)
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.diff(np.concatenate([[0.0], np.cumsum(value)[ends - 1]]))


class _Scorer:
    """Features of documents; differences of words are kept."""

    def __init__(self, contrast: KneserNeyContrast):
        self.contrast, self.kept = contrast, {}

    def features(self, text: str | None) -> list[float]:
        words = words_of(text)
        if not words:
            return [0.0] * N_FEATURES
        new = [w for w in set(words) if w not in self.kept]
        if new:
            if len(self.kept) + len(new) > KEPT_WORDS:
                self.kept.clear()
                new = list(set(words))
            self.kept.update(zip(new, self.contrast.by_word(new).tolist(), strict=True))
        value = np.fromiter(map(self.kept.__getitem__, words), float, len(words))
        total, n = float(value.sum()), len(words)
        top = np.sort(np.partition(value, -2)[-2:]) if n > 1 else np.repeat(value, 2)
        beyond = (value > LIMITS[:, None]).sum(1)
        return [total / n, total / n**0.5, float(top[1]), float(top[0]), *(beyond / n**0.5).tolist(), *np.log1p(beyond).tolist()]


@dataclass
class ToxicityModel:
    """The contrast and the logistic curve over a document's features, each scaled."""

    contrast: KneserNeyContrast
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -20, 20)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps, with a ridge; each row counts so many times."""
    if len(x) == 0:
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.concatenate([[-1.0], np.zeros(N_FEATURES)])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -20, 20)])
    w = np.zeros(a.shape[1])
    pull = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (times * p * (1 - p))[:, None]).T @ a + pull
        w -= np.clip(np.linalg.solve(h, a.T @ (times * (p - y)) + pull @ w), -5, 5)
    return mean, scale, w


def held_out(id_col, parts: int = 5):
    """Rows that nothing is learnt from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == 0


def _bounded(labels: DataFrame, n: int) -> DataFrame:
    return labels.orderBy(F.xxhash64("own_id"), "own_id").limit(n)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", class_docs: int = CLASS_DOCS
) -> ToxicityModel:
    """Learns from labelled rows whose crc32 of the id, as text, is no multiple of 5.

    At most ``class_docs`` rows of each class are used, those whose ids have the smallest hashes; so the list of ids that is sent to the
    executors, the counts and the model are bounded whatever the input. In the curve each class counts as often as it is labelled. An id
    labelled twice counts as toxic if any label says so; null ids and null labels are left out. Null texts have no words; very long ones
    cost in proportion.
    """
    known = (
        labels.select(F.col(id_col).alias("own_id"), F.col(label_col).cast("int").alias("label"))
        .where("own_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("own_id")
        .agg(F.max("label").alias("label"))
        .withColumn("part", (F.crc32(F.col("own_id").cast("string").cast("binary")) % 5).cast("int"))
        .where(F.col("part").isin(*PARTS))
    )
    chosen = _bounded(known.where("label = 1"), class_docs).union(_bounded(known.where("label <> 1"), class_docs))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc") == F.col("own_id"))
    rows = settle(rows.select("text", (F.col("label") == 1).cast("int").alias("label"), "part").repartition(8), "labelled")
    all_of = {r["toxic"]: r["n"] for r in known.groupBy((F.col("label") == 1).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.mapInArrow(trimmed(_count), "cell int, gram bigint, n bigint").groupBy("gram").agg(
        *[F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * len(PARTS))]
    )
    found = counts.toArrow()
    order = np.argsort(found["gram"].to_numpy())
    grams = found["gram"].to_numpy()[order]
    cells = [found[f"c{c}"].to_numpy()[order].astype(float) for c in range(2 * len(PARTS))]
    del found, order
    sent = docs.sparkSession.sparkContext.broadcast({part: _contrast(grams, cells, k) for k, part in enumerate(PARTS)})
    seen = rows.mapInArrow(_feature_rows(sent), "features array<double>, label int").toArrow()
    sent.destroy()
    drop_settled(rows)
    x = np.array(seen["features"].to_pylist()).reshape(-1, N_FEATURES)
    y = seen["label"].to_numpy().astype(float)
    times = np.where(y == 1, all_of.get(1, 0) / max(y.sum(), 1), all_of.get(0, 0) / max((1 - y).sum(), 1))
    return ToxicityModel(_contrast(grams, cells), *_curve(x, y, times / max(times.mean(), 1e-9) if len(times) else times))


def _contrast(grams: np.ndarray, cells: list[np.ndarray], without: int | None = None) -> KneserNeyContrast:
    """The contrast of all parts but one; the cell of a part and class is twice the part's place, plus one if toxic."""
    own = [k for k in range(len(PARTS)) if k != without]
    toxic, ordinary = (np.sum([cells[2 * k + c] for k in own], axis=0) for c in (1, 0))
    known = toxic + ordinary > 0
    return KneserNeyContrast.fit(grams[known], toxic[known], ordinary[known])


def _count(batches):
    for batch in batches:
        rows = list(zip(batch["text"].to_pylist(), batch["label"].to_pylist(), batch["part"].to_pylist(), strict=True))
        for cell in range(2 * len(PARTS)):
            words = [w for text, label, part in rows if 2 * PARTS.index(part) + label == cell for w in words_of(text)]
            grams, n = np.unique(gram_codes(words), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), cell, np.int32)), pa.array(grams), pa.array(n)], names=["cell", "gram", "n"])


def _feature_rows(sent):
    def run(batches):
        scorers = {part: _Scorer(c) for part, c in sent.value.items()}
        for batch in batches:
            rows = [scorers[part].features(t.as_py()) for t, part in zip(batch["text"], batch["part"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch["label"]], names=["features", "label"])

    return trimmed(run)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` in 0..1; only the text counts. Null and empty texts get the score of no evidence.

    A column called ``score`` is replaced; repeated rows each come back.
    """
    docs = docs.drop("score")
    out = docs.withColumn("score", F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _Scorer(sent.value.contrast)
        for batch in batches:
            x = np.array([scorer.features(t.as_py()) for t in batch[text_col]]).reshape(-1, N_FEATURES)
            names = batch.schema.names
            columns = [pa.array(sent.value.probability(x)) if n == "score" else batch[n] for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return out.mapInArrow(trimmed(run), out.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
