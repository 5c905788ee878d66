"""Toxicity: held-out accuracy, Kneser-Ney probabilities, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from tidewatch.llm import toxicity

from .fixtures import SCHEMA, odd_rows, table

ORDINARY = "river stone window garden table letter morning summer paper music bridge forest".split()
TOXIC = "scumbag loathsome vermin".split()


def made(n=900, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(ORDINARY) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.3
        for _ in range(rng.randrange(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(TOXIC) + rng.choice(["", "s", "!"]))
        docs.append((i, " ".join(words), "en", "s", 1))
        if i % 4:
            labels.append((i, 1, int(bad)))
    return docs, labels, {d[0]: int(any(t in d[1] for t in TOXIC)) for d in docs}


def test_held_out_accuracy_and_odd_rows(spark, tmp_path):
    docs, labels, truth = made()
    folder = table(spark, "documents", docs + odd_rows(), folder=str(tmp_path))
    labels += [(None, 1, 1), (5, 1, None), (100_001, 0, 0), (100_006, 0, 0), (100_006, 0, 0), (999_999, 0, 1)]
    table(spark, "labels", labels, "doc_id bigint, quality int, toxic int", folder)
    got = toxicity.op7_toxicity(spark, folder).collect()
    assert len(got) == len(docs) + len(odd_rows())
    held = [g for g in got if g["held_out"]]
    assert {g["doc_id"] for g in held if g["doc_id"]} == {d[0] for d in docs + odd_rows() if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[0]}
    assert all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5) for g in got)
    mine = [g for g in held if g["doc_id"] in truth]
    assert np.mean([g["predicted"] == truth[g["doc_id"]] for g in mine]) > 0.97
    scores = {g["doc_id"]: g["score"] for g in got}
    assert scores[100_001] == scores[100_002] == scores[100_003] < 0.5


def test_nothing_to_learn(spark, tmp_path):
    docs, _, _ = made(20)
    folder = table(spark, "documents", docs, folder=str(tmp_path))
    table(spark, "labels", [], "doc_id bigint, quality int, toxic int", folder)
    assert {g["predicted"] for g in toxicity.op7_toxicity(spark, folder).collect()} == {0}
    table(spark, "documents", [], SCHEMA, folder)
    assert toxicity.op7_toxicity(spark, folder).collect() == []


def test_probabilities_sum_to_one():
    """Over all next bytes, each model's probabilities add up, whatever the context."""
    words = toxicity.words_of("the then there that other this those thin")
    grams, counts = np.unique(toxicity.gram_codes(words), return_counts=True)
    shared = toxicity._shared(grams, 4)
    assert ((0 < shared) & (shared < 1)).all()
    contexts = np.unique(grams >> 8)
    for context in contexts:
        mine = shared[(grams >> 8) == context]
        assert mine.sum() <= 1 + 1e-9
    same = toxicity.KneserNeyContrast.fit(grams, counts.astype(float), counts.astype(float))
    assert np.allclose(same.by_word(words), 0)


def test_word_sums_do_not_depend_on_neighbours():
    words = toxicity.words_of("alpha beta gamma alpha")
    grams, counts = np.unique(toxicity.gram_codes(words[:3]), return_counts=True)
    c = toxicity.KneserNeyContrast.fit(grams, counts.astype(float), np.zeros(len(grams)))
    one = [float(c.by_word([w])[0]) for w in words]
    assert np.allclose(c.by_word(words), one) and c.by_word([]).size == 0


def plain_contrast(toxic, ordinary):
    """The difference of a word's log-likelihoods, from dictionaries of byte strings."""
    split = lambda word: [(b"    " + word + b" ")[k : k + 5] for k in range(len(word) + 1)]
    counts = [Counter(g for w in words for g in split(w)) for words in (toxic, ordinary)]
    grams = set(counts[0]) | set(counts[1])

    def discount(values):
        once, twice = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5

    below = {b"": 1 / 256}
    levels = [grams]
    for _ in range(4):
        levels.append({g[1:] for g in levels[-1]})
    for longer in reversed(levels[:-1]):
        cont = Counter(g[1:] for g in longer)
        d = discount(cont.values())
        total, kinds = Counter(), Counter(g[:-1] for g in cont)
        for g, n in cont.items():
            total[g[:-1]] += n
        below = {g: (max(n - d, 0) + d * kinds[g[:-1]] * below[g[1:]]) / total[g[:-1]] for g, n in cont.items()}

    def log_likelihoods(g):
        out = []
        for own in counts:
            d = discount(own.values())
            total = sum(n for h, n in own.items() if h[:-1] == g[:-1])
            left = d * sum(h[:-1] == g[:-1] for h in own) / total if total else 1.0
            shared = below[g[1:]] if g in grams else 1.0
            out.append(math.log((max(own[g] - d, 0) / total if total else 0.0) + left * shared))
        return out

    known = {g[:-1] for g in grams}
    return lambda word: sum(a - b for g in split(word) if g[:-1] in known for a, b in [log_likelihoods(g)])


def test_contrast_and_score_against_plain_python():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aber") for _ in range(rng.randrange(1, 7))).encode()
    ordinary, toxic = [word() for _ in range(300)], [word() for _ in range(60)] + [b"bad", b"badder"] * 9
    rows = [np.unique(toxicity.gram_codes(words), return_counts=True) for words in (toxic, ordinary)]
    grams = np.unique(np.concatenate([r[0] for r in rows]))
    given = [np.array([dict(zip(r[0].tolist(), r[1].tolist())).get(g, 0.0) for g in grams.tolist()]) for r in rows]
    model = toxicity.KneserNeyContrast.fit(grams, *given)
    plain = plain_contrast(toxic, ordinary)
    asked = [*ordinary[:40], *toxic[:40], b"badb", b"zz", b"never"]
    assert np.allclose(model.by_word(asked), [plain(w) for w in asked])
    values = sorted((plain(w) for w in asked), reverse=True)
    n = len(values)
    beyond = [sum(v > limit for v in values) for limit in (1.5, 2.5, 3.5, 4.5)]
    want = [sum(values) / n, sum(values) / n**0.5, *values[:2], *[k / n**0.5 for k in beyond], *[math.log(1 + k) for k in beyond]]
    assert np.allclose(toxicity._Scorer(model).features(b" ".join(asked).decode()), want)
    weights = np.linspace(-0.5, 0.5, toxicity.N_FEATURES + 1)
    curve = toxicity.ToxicityModel(model, np.ones(toxicity.N_FEATURES), np.full(toxicity.N_FEATURES, 2.0), weights)
    z = weights[0] + sum(w * min(max((x - 1) / 2, -20), 20) for w, x in zip(weights[1:], want, strict=True))
    assert np.isclose(curve.probability(np.array([want]))[0], 1 / (1 + math.exp(-min(max(z, -30), 30))))
