"""Jaccard components against all pairs, over texts that lie just above and below the limit."""

import random
import re

import numpy as np
import pytest

from tidewatch.llm import components, jaccard_join

from .fixtures import SCHEMA, odd_rows, table


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(rng, n):
    out = []
    line = " ".join(f"common{k}" for k in range(60))
    for _ in range(n // 6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 5, 8, 9, 12, 20, 30, 60, 150, 400]))]
        if rng.random() < 0.4:
            words[len(words) // 2 : len(words) // 2] = line.split()
        for _ in range(6):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, max(len(words) // 50, 1)])):
                at = rng.randrange(len(own))
                kind = rng.random()
                if kind < 0.4:
                    own[at] = f"x{rng.randrange(9)}"
                elif kind < 0.7:
                    del own[at:]
                else:
                    own.insert(rng.choice([0, len(own)]), "extra")
                own = own or ["one"]
            out.append(rng.choice(["  ", " ", "\n"]).join(own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON", [64, 2, 3][seed - 1])
    rng = random.Random(seed)
    rows = [(i * 3 % 1000, t, "en", "s", 1) for i, t in enumerate(texts(rng, 330))] + [r for r in odd_rows() if r[0]]
    folder = table(spark, "documents", rows, folder=str(tmp_path))
    want = brute([(r[0], r[1]) for r in rows])
    got = jaccard_join.op1_jaccard_join(spark, folder).collect()
    assert len(got) == len(rows)
    assert {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in got} == want


@pytest.mark.parametrize("common", [64, 3])
def test_links_against_all_pairs(spark, tmp_path, common, monkeypatch):
    """Links within a group of near copies are found too, not only those that its component needs."""
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    rng = random.Random(common)
    near = [" ".join(f"n{k}" for k in range(120) if k != j) for j in (*range(0, 12), 30, 60, 119)]
    rows = [(i * 3 % 1000, t, "en", "s", 1) for i, t in enumerate([*texts(rng, 150), *near, near[0]])] + [r for r in odd_rows() if r[0]]
    folder = table(spark, "documents", rows, folder=str(tmp_path))
    sets = {r[0]: shingles(r[1]) for r in rows}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i] or i, i)
    heads = [i for i in sorted(least.values()) if sets[i]]
    want = {(a, b) for k, a in enumerate(heads) for b in heads[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    n_links = {i: sum(least[sets[i] or i] in pair for pair in want) for i in sets}
    found = jaccard_join.jaccard_links(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert len(found) == len(want) and {(r["a"], r["b"]) for r in found} == want
    got = jaccard_join.op1_jaccard_links(spark, folder).collect()
    assert len(got) == len(rows)
    assert {g["doc_id"]: (g["class_id"], g["n_links"]) for g in got} == {i: (least[sets[i] or i], n_links[i]) for i in sets}


def test_tight_sizes(spark, tmp_path):
    """Sets of 4 to 12 shingles of which one is the other's beginning: linked exactly from four fifths on."""
    rows = [(100 * b + n, " ".join(f"b{b}w{k}" for k in range(n + 4)), "en", "s", 1) for b in range(8) for n in (4 + b, (4 + b) * 5 // 4, (4 + b) * 5 // 4 + 1)]
    rows = list({r[0]: r for r in rows}.values())
    folder = table(spark, "documents", rows, folder=str(tmp_path))
    got = {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in jaccard_join.op1_jaccard_join(spark, folder).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])


def test_odd_rows(spark, tmp_path):
    folder = table(spark, "documents", [], SCHEMA, str(tmp_path))
    assert jaccard_join.op1_jaccard_join(spark, folder).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got == [(2, 2, 2), (2, 2, 2), (3, 0, 3), (None, 2, None)]


def test_segments_never_miss():
    """Every linked pair shares a value within its credits, whatever the allocation."""
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(5, 200))
        x = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        d = int(rng.integers(0, n // 9 + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[d:], rng.integers(0, 1 << 63, d).astype(np.uint64)]))
        if not jaccard_join.linked(x, y):
            continue
        plan = jaccard_join.bands(400)
        band = min(np.searchsorted([h for _, h in plan], min(len(x), len(y))), len(plan))
        given = jaccard_join.allocate(plan[band][1], int(rng.choice([10, 10**4, 10**7])))
        (v, ev), (w, ew) = (jaccard_join.segment_values(s, int(band), given) for s in (x, y))
        if ev.sum() <= given.slack:
            v = v[~ev]
        if ew.sum() <= given.slack:
            w = w[~ew]
        assert np.intersect1d(v, w).size > 0


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    loose = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    links = chain + star + loose + [(None, 3), (5, 5), (0, 1)]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            up[q] = p
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in up}
