"""Each stage's decisions against plain Python, on the stage's own input."""

import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tidewatch.llm import _common, token_files

from .fixtures import odd_rows, table
from .test_jaccard_join import brute as components
from .test_mix_decontaminate import brute as contamination
from .test_mix_decontaminate import fair_targets, size
from .test_toxicity import TOXIC, made


def test_stages(spark, tmp_path):
    docs, labels, truth = made(500)
    item = "some passage that a benchmark holds and nobody else would write down in just these words at all"
    for k in range(10):
        docs.append((9000 + k, docs[k][1], "en", "copy", 1))
        docs.append((9100 + k, f"{item} {docs[k + 20][1]}"[: 120 + 400 * (k % 2)], "en", None, 1))
    passage = " ".join(f"p{k}" for k in range(55))
    short = " ".join(f"q{k}" for k in range(20))
    river = " ".join(f"river{k % 7} stone{k % 11}" for k in range(900))
    docs += [(9200, f"{river[:6000]} {passage.upper()}. {river[6000:]}", "en", "long", 1), (9201, f"garden {river} {short}", "en", "long", 1)]
    docs += odd_rows()
    folder = table(spark, "documents", docs, folder=str(tmp_path))
    table(spark, "labels", labels, "doc_id bigint, quality int, toxic int", folder)
    table(spark, "benchmark", [(1, item), (2, passage), (3, short)], "item_id bigint, text string", folder)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    before = [tuple(r) for r in now.collect()]
    after = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/stage{k}"
        stage(spark, now, folder).write.parquet(path)
        now = spark.read.parquet(path)
        after = [tuple(r) for r in now.collect()]
        if k < 4:
            assert now.columns == columns
            assert {r[0] for r in after} <= {r[0] for r in before}
        if name == "toxicity":
            wrong = [r for r in before if r[0] in truth and (r in after) == bool(truth[r[0]])]
            assert len(wrong) <= 5 and all(r in after for r in odd_rows() if not (r[1] or "").strip())
        elif name == "ngram_jaccard_join":
            found = components([(r[0], r[1]) for r in before])
            assert sorted(r[0] for r in after if r[0]) == sorted({c for _, c in found.values()})
            assert sum(r[0] is None for r in after) == sum(r[0] is None for r in before)
        elif name == "benchmark_decontamination":
            bad = {r[0] for r in contamination(before, [(1, item), (2, passage), (3, short)]) if r[5]}
            cut = f"{river[:6000]} . {river[6000:]}"  # the passage of 55 words is gone, the one of 20 stays
            want = [(9200, cut, "en", "long", len(cut)) if r[0] == 9200 else r for r in before if r[0] not in bad]
            assert bad and {9200, 9201} <= {r[0] for r in want} and sorted(map(str, after)) == sorted(map(str, want))
        elif name == "source_mixing":
            sizes, taken, longest = {}, {}, {}
            for r in before:
                sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
                longest[r[3]] = max(longest.get(r[3], 0), size(r[1]))
            for r in after:
                taken[r[3]] = taken.get(r[3], 0) + size(r[1])
            for source, target in fair_targets(sizes).items():
                assert abs(taken.get(source, 0) - target) <= longest[source] + 1
            assert max(after.count(r) for r in after) <= 3
        else:
            tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
            want, start = [], 0
            rows = sorted((r[0] is None, r[0] or 0, [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in before)
            for null, doc_id, ids in rows:
                want.append((None if null else doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
                start += len(ids)
            assert sorted(after, key=lambda r: r[1]) == want
        before = after
    assert sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(map(str, after))
    assert TOXIC


def test_memory_between_stages(spark):
    """Executors collect garbage between the stages, and token files are written from batches of bounded rows."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = count()
    _common.free_unused(spark)
    assert count() >= before + 2  # the driver's and, in this session in the same process, the executor's
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    with _common.small_batches(spark):
        sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"id": [b.num_rows]}) for b in batches), "id long").collect()
    assert max(r["id"] for r in sizes) <= 1024 and spark.conf.get(name) == kept
