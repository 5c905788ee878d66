"""Token files: ids equal to the library's on whole texts, exact round trip, random access."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import token_files

from .fixtures import SCHEMA, base_rows, odd_rows, table

ODD = [
    "It's  the WORD's <|endoftext|> and <|ENDOFTEXT|> '' 'll don't,",
    "café, Á b —, x—, naïve... (é) ß! ×, ÷; 12,34 a1b2　c \x1cd\x1d e\x85f",
    "Ⅰ   ſ ﬁ 𝔘𝔫𝔦 한국어 İ İ ΩΩ,",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_files.default_tokenizer())


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_same_ids_as_library(tokenizer):
    with open(token_files.default_tokenizer(), encoding="utf-8") as file:
        encoder = token_files.WordEncoder(file.read())
    texts = [r[1] for r in base_rows(200) + odd_rows()] + ODD
    for text, packed in zip(texts, encoder.encode(texts, 1), strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == ids(tokenizer, text), text


def test_query(spark, tokenizer, tmp_path):
    rows = base_rows(80) + odd_rows() + [(300_000 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    folder = table(spark, "documents", rows, folder=str(tmp_path))
    got = token_files.op10_token_files(spark, folder).collect()
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        own = ids(tokenizer, r[1])
        want.append((r[0], start, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.op10_token_files(spark, table(spark, "documents", [], SCHEMA, str(tmp_path / "none"))).collect() == []


def test_random_access_and_dictionary(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(r[0], r[1], "clash") for r in base_rows(40)], "doc_id long, text string, shard string")
    folder = f"file://{tmp_path}/out"
    told = token_files.write_token_files(docs, folder, token_files.default_tokenizer(), shards=2)
    text = {r[0]: r[1] for r in base_rows(40)}
    seen = 0
    for row in spark.read.parquet(f"{folder}/manifest").collect():
        reader = token_files.ShardReader(folder, row["file"], told["dictionary"])
        for k, doc_id in enumerate(reader.ids):
            assert reader.document(k).tolist() == ids(tokenizer, text[doc_id])
            seen += 1
        with pytest.raises(ValueError, match="another dictionary"):
            token_files.ShardReader(folder, row["file"], b"other")
    assert seen == 40
