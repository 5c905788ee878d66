"""Pitman-Yor scores: exact counts against plain Python, proper probabilities, seating, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tidewatch.llm import pitman_yor

from .fixtures import SCHEMA, base_rows, odd_rows, table


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def is_held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def test_counts_and_base(spark, tmp_path):
    rows = base_rows(150) + odd_rows()
    folder = table(spark, "documents", rows, folder=str(tmp_path))
    got = pitman_yor.op8_lm_score(spark, folder).collect()
    seen = Counter(t for r in rows if not is_held(r[0]) for t in tokens(r[1]))
    total, kinds = sum(seen.values()), len(seen)
    want = {}
    for r in rows:
        own = tokens(r[1])
        base = sum(math.log10((seen[t] + 1) / (total + kinds + 1)) for t in own)
        want.setdefault(r[0], []).append((is_held(r[0]), len(own), sum(seen[t] > 0 for t in own), total, base))
    assert len(got) == len(rows)
    for g in got:
        assert any(tuple(g)[1:5] == w[:4] and math.isclose(g["base_score"], w[4], rel_tol=1e-9) for w in want[g["doc_id"]])
        assert g["score"] < 0
    held = [g for g in got if g["held_out"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)


def test_small_chunks_and_buckets_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in base_rows(60)], "doc_id long, text string, bucket string")
    one = {r["id"]: r for r in pitman_yor.score_texts(docs, buckets=3).collect()}
    monkeypatch.setattr(pitman_yor, "CHUNK_WORDS", 500)
    two = {r["id"]: r for r in pitman_yor.score_texts(docs, buckets=3).collect()}
    for i, r in one.items():
        assert r["n_known"] == two[i]["n_known"] and math.isclose(r["base_score"], two[i]["base_score"], rel_tol=1e-9)
        assert math.isclose(r["score"], two[i]["score"], rel_tol=1e-3)


def test_nothing_to_learn(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["id"]: r for r in pitman_yor.score_texts(docs, F.lit(True)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and got[1]["base_score"] == 0 and abs(got[1]["score"]) < 1e-6
    folder = table(spark, "documents", [], SCHEMA, str(tmp_path))
    assert pitman_yor.op8_lm_score(spark, folder).collect() == []


def test_seating_follows_the_process():
    rng, plain = np.random.default_rng(5), random.Random(5)
    d = 0.6
    for n, start, more in ((60, 2.5, 0.0), (60, 0.05, 0.5), (7, 1.0, 1.0), (3000, 0.3, 0.1)):
        many = pitman_yor.seat(np.full(3000, n), lambda dishes, t: start + more * t, d, rng)  # noqa: B023

        def one():
            t = 1
            for k in range(1, n):  # noqa: B023
                w = start + more * t  # noqa: B023
                t += plain.random() < w / (w + k - d * t)
            return t

        slow = [one() for _ in range(1000)]
        assert abs(many.mean() - np.mean(slow)) < 5 * np.std(slow) / 1000**0.5 + 0.01
        assert abs(many.std() - np.std(slow)) < 0.15 * np.std(slow) + 0.05
    assert (pitman_yor.seat(np.array([0, 1, 2]), lambda dishes, t: np.ones(len(dishes)), d, rng) <= [0, 1, 2]).all()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(1, 1 << 60, 50).astype(np.uint64))
    counts = rng.integers(0, 30, 150)
    row = {
        "bucket": 0, "words": pitman_yor._pack_rising(hashes), "heads": pitman_yor._pack_rising(np.array([5, 9, 70])), "keys": pitman_yor._pack_rising(np.arange(150)),
        "counts": pitman_yor._pack(counts, "<u8"),
    }
    s = pitman_yor._Seats(row)
    add = lambda x: np.bincount(s.context, weights=x, minlength=3)
    state = s.first()
    for sweep in range(3):
        g = {"tables0": int(state[1].sum()), "customers0": int(state[0].sum()), "kinds": 51.0, "d0": 0.6, "d1": 0.7}
        state = s.sweep(state, g, add(state[0]), [sweep])
        assert ((state[0] <= counts) & ((state[0] > 0) == (counts > 0))).all() and (state[1] <= s.sums(state[0])).all()
    g |= {"tables0": int(state[1].sum()), "customers0": int(state[0].sum())}
    p = s.predict(state, g, add(s.count), add(state[0]))
    unseen = (1 + g["d0"] * g["tables0"]) / 51 / (1 + g["customers0"])
    for c in range(3):
        back = (1 + g["d1"] * add(state[0])[c]) / (1 + add(s.count)[c])
        assert abs(p[s.context == c].sum() + back * unseen - 1) < 1e-9


class PlainModel:
    """The same hierarchy in plain Python: every customer leaves and sits down again on its own."""

    def __init__(self, texts, seed):
        self.rng = random.Random(seed)
        pairs = Counter((a, b) for t in texts for a, b in zip([None, *t], t))
        self.kinds = len({b for _, b in pairs}) + 1
        self.customers = [(u, w) for (u, w), n in pairs.items() for _ in range(n)]
        self.n, self.t = Counter(), Counter()
        for u, w in self.customers:
            self.n[u] += 1
        self.own = {key: [n] for key, n in pairs.items()}
        self.top = {}
        for (u, w), n in pairs.items():
            self.t[u] += 1
            self.top.setdefault(w, [0])[0] += 1
        self.d1 = self.discount(pairs.values())

    @staticmethod
    def discount(counts):
        once, twice = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
        return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5

    def parent(self, w):
        sizes = self.top.get(w, [])
        base = (1 + self.d0 * sum(map(len, self.top.values()))) / self.kinds
        return (sum(sizes) - self.d0 * len(sizes) + base) / (1 + sum(map(sum, self.top.values())))

    def sit(self, sizes, weight, d):
        at = self.rng.random() * (sum(sizes) - d * len(sizes) + weight)
        for k, n in enumerate(sizes):
            at -= n - d
            if at < 0:
                sizes[k] += 1
                return False
        sizes.append(1)
        return True

    def leave(self, sizes):
        k = self.rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    def sweep(self):
        self.d0 = self.discount([sum(s) for s in self.top.values()])
        for u, w in self.customers:
            if self.leave(self.own[u, w]):
                self.t[u] -= 1
                self.leave(self.top[w])
            if self.sit(self.own[u, w], (1 + self.d1 * self.t[u]) * self.parent(w), self.d1):
                self.t[u] += 1
                tables = sum(map(len, self.top.values()))
                self.sit(self.top[w], (1 + self.d0 * tables) / self.kinds, self.d0)

    def probability(self, u, w):
        sizes = self.own.get((u, w), [])
        return (sum(sizes) - self.d1 * len(sizes) + (1 + self.d1 * self.t[u]) * self.parent(w)) / (1 + self.n[u])


def test_scores_against_plain_gibbs(spark):
    """Dishes that leave and sit down together come to the same scores as customers that do so one by one."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    text = lambda: " ".join(words[min(int(rng.expovariate(0.15)) + 3 * (k % 3), 39)] for k in range(rng.randrange(3, 30)))
    rows = [(k, text()) for k in range(120)] + [(500, "never seen"), (501, None)]
    held = [r for r in rows if is_held(r[0]) or r[0] >= 500]
    split = lambda t: [*(t or "").split(), None]
    model = PlainModel([split(t) for i, t in rows if not (is_held(i) or i >= 500)], 1)
    sums = {i: [0.0] * len(split(t)) for i, t in held}
    for sweep in range(14):
        model.sweep()
        if sweep >= 4:
            for i, t in held:
                own = split(t)
                for k, (a, b) in enumerate(zip([None, *own], own)):
                    sums[i][k] += model.probability(a, b) / 10
    want = {i: sum(map(math.log10, p)) for i, p in sums.items()}
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    where = pitman_yor.held_out(F.col("doc_id")) | (F.col("doc_id") >= 500)
    got = {r["id"]: r["score"] for r in pitman_yor.score_texts(docs, where, buckets=3).collect()}
    for i, value in want.items():
        assert abs(got[i] - value) < 0.05 * abs(value) + 0.05, (i, got[i], value)
    assert abs(sum(got[i] for i in want) / sum(want.values()) - 1) < 0.01


def test_every_word_is_a_context(spark):
    """Which word follows is learnt after long words and other scripts too, and contexts beyond a few thousand stay apart."""
    from pyspark.sql import functions as F

    pairs = [("предыдущее", "слово"), ("другое", "дело"), ("longer", "context")] + [(f"before{k}", f"after{k}") for k in range(6000)]
    rows = [(1, f"{a} {b}") for a, b in pairs for _ in range(4)]
    asked = [*pairs[:3], *pairs[3::500]]
    rows += [(10 + 2 * k, f"{a} {b}") for k, (a, b) in enumerate(asked)] + [(11 + 2 * k, f"{a} {asked[k - 1][1]}") for k, (a, _) in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["score"] for r in pitman_yor.score_texts(docs, F.col("doc_id") >= 10).where("held_out").collect()}
    assert all(got[10 + 2 * k] > got[11 + 2 * k] + 2 for k in range(len(asked)))
