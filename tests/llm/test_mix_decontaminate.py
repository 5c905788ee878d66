"""Mixing and decontamination against plain Python."""

import hashlib
import random
import re

import pytest

from tidewatch.llm import decontaminate, mixing

from .fixtures import SCHEMA, base_rows, odd_rows, table


def key(r):
    return tuple((x is not None, x) for x in r)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fair_targets(sizes, weights=(5, 2, 1), times=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > times * sizes[n]]
        if not over:
            return out | {n: left * weight[n] / total for n in open_}
        for n in over:
            out[n] = times * sizes[n]
        left -= sum(out[n] for n in over)
        open_ -= set(over)
    return out


def test_mix(spark, tmp_path):
    rows = base_rows(200) + odd_rows()
    folder = table(spark, "documents", rows, folder=str(tmp_path))
    got = mixing.op2_mix_sources(spark, folder).collect()
    assert sorted((g["doc_id"], g["size"]) for g in got if g["doc_id"]) == sorted((r[0], size(r[1])) for r in rows if r[0])
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = fair_targets(sizes)
    of = {r[0]: r[3] for r in rows}
    taken, longest = {}, {}
    for g in got:
        s = of[g["doc_id"]]
        assert g["source_size"] == sizes[s] and g["target"] == pytest.approx(want[s])
        assert g["taken"] <= 3 * g["size"] and (g["size"] == 0 or g["taken"] % g["size"] == 0)
        taken[s] = taken.get(s, 0) + g["taken"]
        longest[s] = max(longest.get(s, 0), 2 * g["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in sizes)
    again = mixing.op2_mix_sources(spark, folder).collect()
    assert sorted(map(tuple, again), key=key) == sorted(map(tuple, got), key=key)


def test_mix_is_nested(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    small, large = ({r["id"] for r in mixing.mix_sources(docs, share=s).where("times > 0").collect()} for s in (0.2, 0.5))
    assert small < large
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    assert {r["target"] for r in mixing.mix_sources(docs.limit(0).union(spark.createDataFrame([(1, None, "a")], docs.schema))).collect()} == {0.0}


def brute(docs, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = low(text)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for d in docs:
        w, hit, found = low(d[1]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                here = windows.get(tuple(w[i : i + n]))
                if here:
                    hit |= set(range(i, i + n))
                    found |= here
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d[0], len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decontaminate(spark, tmp_path, seed):
    rng = random.Random(seed)
    vocabulary = "a b Ab cd é x1".split()
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 2, 5, 9, 13, 14, 30, 60]))) for i in range(40)] + [(99, None), (7, "only twelve words are here so this is one single window yes"), (3, "")]
    items += [(100, items[5][1]), (5, items[9][1])]
    docs = [(i, " ".join([text(rng.randrange(40)), rng.choice(items)[1] or "", text(rng.randrange(200)), "Zz", rng.choice(items)[1] or ""]), "en", "s", 1) for i in range(120)]
    docs += odd_rows()
    folder = table(spark, "documents", docs, folder=str(tmp_path))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = sorted(map(tuple, decontaminate.op4_decontaminate(spark, folder).collect()), key=key)
    assert got == sorted(brute(docs, items), key=key)
    source = spark.read.parquet(f"{folder}/documents.parquet").drop("n_chars").withColumnRenamed("lang", "n_words")
    small = decontaminate.find_items(source, spark.read.parquet(f"{folder}/benchmark.parquet"), block_words=50)
    assert sorted((r["n_words"], len(r["hit_items"])) for r in small.collect()) == sorted((g[1], g[3]) for g in got)


def test_real_benchmark(spark, sf):
    import pyarrow.parquet as pq

    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    got = sorted(map(tuple, decontaminate.op4_decontaminate(spark, sf).collect()))
    assert got == sorted(brute(docs, items)) and any(g[5] for g in got)


def test_cut_and_empty(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, f"Keep this. {item.title()}! And this."), (2, None), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(decontaminate.find_items(docs, bench)).collect()}
    assert got == {1: "Keep this. ! And this.", 2: None, 3: "clean"}
    for words, want in ((12, {1: "Keep this. ! And this.", 2: None, 3: "clean"}), (14, {r["doc_id"]: r["text"] for r in docs.collect()})):
        found = decontaminate.find_items(docs, bench, cut=decontaminate.Limits(words=words, one_in=1))
        assert {r["doc_id"]: (r["text"], len(r["hit_spans"])) for r in found.collect()} == {i: (t, int(i == 1)) for i, t in want.items()}
    assert decontaminate.find_items(docs.limit(0), bench).collect() == []
    assert [r["hit_items"] for r in decontaminate.find_items(docs, bench.limit(0)).collect()] == [[], [], []]
    folder = table(spark, "documents", [], SCHEMA, str(tmp_path))
    assert mixing.op2_mix_sources(spark, folder).collect() == []
