"""Token ids in binary files with a shared zstandard dictionary.

A file (shard) holds one compressed frame per document, in ascending order of document ids, and ends with an index::

    magic  frame frame ...  index  trailer

    index    ids of the documents, then (documents + 1) offsets of frames and of token ids, all as little-endian 64-bit
    trailer  sha256 of the dictionary, documents, null ids, bytes per token id, start of the index, magic

Each frame is the document's id array, compressed alone with the dictionary that all files share, so one short document
is read by two seeks and one decompression. The dictionary lies beside the files and is checked by its hash. A shard is
written under a name of its own attempt and moved into place, so a repeated task replaces the same bytes.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import filesystem, scratch, shuffle_width, small_batches, table, trimmed

MAGIC = b"TIDETOK1"
TRAILER = struct.Struct("<32sQQQQ8s")
#: Bounds of what the dictionary is trained on, and its size: documents, characters of each, bytes.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 8_000, 1 << 16
LEVEL = 1
#: Words whose ids a worker keeps, but for those of the 256 texts at hand; the store is emptied when it has grown beyond.
KEPT_WORDS = 1_000_000
READ_BYTES = 4 << 20
#: Bytes of text that go to one file, if the shuffle is not wider anyway.
SHARD_BYTES = 64 << 20


class WordEncoder:
    """Ids of whole texts as bytes, the same as ``tokenizer.encode(text, add_special_tokens=False).ids``.

    The tokenizer drops white space and never joins characters across it, so a text's ids are those of its words one
    after the other, and each word is encoded by the library once. A word of Latin letters with ASCII punctuation behind
    it (without an apostrophe) is two of the tokenizer's pieces. Such pieces are encoded many at a time, with spaces
    between: the last id of each, and no other, is one of a word's end. Other words are encoded one by one. A text with
    ``<|`` may hold special tokens and is encoded whole.
    """

    #: UTF-8 of a run of lower-case Latin letters; ASCII punctuation without the apostrophe.
    LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
    TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}

    def pack(self, ids) -> bytes:
        return np.asarray(ids, dtype=f"<u{self.width}").tobytes()

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that the tokenizer takes as one each."""
        out = []
        for k in range(0, len(pieces), 512):
            some = pieces[k : k + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                out += self._one_by_one([p.decode() for p in some])
                continue
            raw, cuts = self.pack(ids), (ends * self.width).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return out

    def _learn(self, words: set[bytes]) -> None:
        kept, letters, tail = self.kept, self.LETTERS.fullmatch, self.TAIL
        pairs, odd, wanted = [], [], set()
        for word in words:
            core = word.rstrip(tail)
            if core.isalpha() or letters(core):
                if len(core) < len(word):
                    pairs.append((word, core, word[len(core) :]))
                    wanted.add(word[len(core) :])
                wanted.add(core)
            elif core:
                odd.append(word)
            else:
                wanted.add(word)
        pieces = [p for p in wanted if p not in kept]
        kept.update(zip(pieces, self._pieces(pieces), strict=True))
        for word, core, rest in pairs:
            kept[word] = kept[core] + kept[rest]
        kept.update(zip(odd, self._one_by_one([w.decode() for w in odd]), strict=True))

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Packed ids of each text, with the end id."""
        out, last = [], self.pack([end])
        for k in range(0, len(texts), 256):
            raws = [(t or "").encode() for t in texts[k : k + 256]]
            split = [None if b"<|" in raw else raw.lower().split() for raw in raws]
            if len(self.kept) > KEPT_WORDS:
                self.kept.clear()
            get = self.kept.get
            found = [list(map(get, own or ())) for own in split]
            new = {w for own, ids in zip(split, found, strict=True) if None in ids for w, i in zip(own, ids, strict=True) if i is None}
            if new:
                self._learn(new)
            for at, (own, ids) in enumerate(zip(split, found, strict=True)):
                if own is None:
                    out.append(self.pack(self.tokenizer.encode(texts[k + at], add_special_tokens=False).ids) + last)
                elif None in ids:
                    out.append(b"".join([get(w) if i is None else i for w, i in zip(own, ids, strict=True)]) + last)
                else:
                    out.append(b"".join(ids) + last)
        return out


@functools.lru_cache(maxsize=1)
def _encoder(spec: str) -> WordEncoder:
    """A worker's encoder lives as long as the worker, for all its tasks."""
    return WordEncoder(spec)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; of too few samples for training, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


class ShardWriter:
    """Appends frames to a new file; memory holds the index only."""

    def __init__(self, folder: str, name: str, dictionary_hash: bytes, width: int):
        self.fs, place = filesystem(folder)
        self.fs.create_dir(place, recursive=True)
        self.final, self.temporary = f"{place}/{name}", f"{place}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.hash, self.width = dictionary_hash, width
        self.ids, self.nulls, self.frames, self.tokens = [], 0, [len(MAGIC)], [0]

    def add(self, doc_id: int | None, frame: bytes, n_tokens: int) -> None:
        self.nulls += doc_id is None
        self.ids.append(0 if doc_id is None else doc_id)
        self.out.write(frame)
        self.frames.append(self.frames[-1] + len(frame))
        self.tokens.append(self.tokens[-1] + n_tokens)

    def close(self) -> None:
        index = b"".join(np.asarray(x, dtype="<i8").tobytes() for x in (self.ids, self.frames, self.tokens))
        self.out.write(index)
        self.out.write(TRAILER.pack(self.hash, len(self.ids), self.nulls, self.width, self.frames[-1], MAGIC))
        self.out.close()
        if self.fs.get_file_info(self.final).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.final)
        self.fs.move(self.temporary, self.final)


class ShardReader:
    """Random and sequential access to one file. Null ids come last in it."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        self.fs, place = filesystem(folder)
        self.file = self.fs.open_input_file(f"{place}/{name}")
        size = self.file.size()
        self.file.seek(size - TRAILER.size)
        found, n, nulls, self.width, start, magic = TRAILER.unpack(self.file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token file")
        if found != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.file.seek(start)
        index = np.frombuffer(self.file.read(8 * (3 * n + 2)), dtype="<i8")
        self.ids = [*index[: n - nulls].tolist(), *[None] * nulls]
        self.frames, self.tokens = index[n : 2 * n + 1], index[2 * n + 1 :]
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def _ids(self, frame: bytes, k: int) -> np.ndarray:
        size = int(self.tokens[k + 1] - self.tokens[k]) * self.width
        return np.frombuffer(self.decompress(frame, max_output_size=size), dtype=f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, with the end id."""
        a, b = int(self.frames[k]), int(self.frames[k + 1])
        self.file.seek(a)
        return self._ids(self.file.read(b - a), k)

    def documents(self):
        """(id, start within the file, ids) of all documents; reads a few MB at a time."""
        k, n = 0, len(self.ids)
        while k < n:
            last = max(k + 1, int(np.searchsorted(self.frames, self.frames[k] + READ_BYTES)))
            last = min(last, n)
            a = int(self.frames[k])
            self.file.seek(a)
            block = self.file.read(int(self.frames[last]) - a)
            for i in range(k, last):
                yield self.ids[i], int(self.tokens[i]), self._ids(block[int(self.frames[i]) - a : int(self.frames[i + 1]) - a], i)
            k = last


FRAMES = "doc_id bigint, shard int, n_tokens bigint, crc bigint, frame binary"


def _encode(spec, dictionary: bytes, end: int):
    def run(batches):
        encoder = _encoder(spec.value)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary)).compress
        for batch in batches:
            packed = encoder.encode(batch["text"].to_pylist(), end)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["shard"],
                    pa.array([len(p) // encoder.width for p in packed], pa.int64()),
                    pa.array([zlib.crc32(p) for p in packed], pa.int64()),
                    pa.array([compress(p) for p in packed], pa.binary()),
                ],
                names=["doc_id", "shard", "n_tokens", "crc", "frame"],
            )

    return run


MANIFEST = "shard int, file string, docs bigint, tokens bigint"


def _write(folder: str, dictionary_hash: bytes, width: int):
    def run(batches):
        done, writer, shard = [], None, None

        def close():
            if writer:
                writer.close()
                done.append((shard, writer.final.rpartition("/")[2], len(writer.ids), writer.tokens[-1]))

        for batch in batches:
            for doc_id, at, n, _, frame in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != shard:
                    close()
                    shard, writer = at, ShardWriter(folder, f"shard-{at:06d}.tok", dictionary_hash, width)
                writer.add(doc_id, frame, n)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["shard", "file", "docs", "tokens"])

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None
) -> dict:
    """Encodes whole texts and writes them to ``folder`` in ascending order of ids, null ids last.

    Null texts are empty: they hold the end id only. Equal ids keep an order by content, so reruns write the same files. Extra columns are ignored.
    Texts are encoded where they are read; only compressed frames are moved, to the ranges of ids that
    a count over the id column has set. Returns the folder's description.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or max(shuffle_width(spark), -(-size // SHARD_BYTES))
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    encoder = WordEncoder(spec)
    drawn = source.where(F.rand(11) < 1.2 * SAMPLE_DOCS / max(source.select("doc_id").count(), 1)).limit(SAMPLE_DOCS)
    room = F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))
    piece = F.substring("text", F.pmod(F.xxhash64("text"), room).cast("int") + 1, F.lit(SAMPLE_CHARS))  # from any place of a long text
    texts = [r["text"] for r in drawn.select(piece.alias("text")).collect()]
    dictionary = train_dictionary(encoder.encode(texts, end))
    digest = hashlib.sha256(dictionary).digest()
    store, place = filesystem(folder)
    store.create_dir(place, recursive=True)
    with store.open_output_stream(f"{place}/dictionary.zdict") as out:
        out.write(dictionary)
    cuts = source.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(cuts)) if shards > 1 else []
    listed = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.expr("CAST(array() AS array<bigint>)")
    shard = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.size(F.filter(listed, lambda b: b <= F.col("doc_id")))).cast("int")
    frames = source.select("doc_id", shard.alias("shard"), "text").mapInArrow(trimmed(_encode(spark.sparkContext.broadcast(spec), dictionary, end)), FRAMES)
    ordered = frames.repartition(len(bounds) + 2, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "n_tokens", "crc")
    with small_batches(spark):
        ordered.mapInArrow(_write(folder, digest, encoder.width), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return {"folder": folder, "dictionary_sha256": digest.hex(), "dictionary": dictionary, "width": encoder.width}


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    store, place = filesystem(folder)
    with store.open_input_stream(f"{place}/dictionary.zdict") as file:
        dictionary = file.read()
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("base"))

    def run(batches):
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                rows = [
                    (doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc_id, start, ids in ShardReader(folder, name, dictionary).documents()
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(shuffle_width(spark), "file").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def default_tokenizer() -> str:
    """Where the public vocabulary file of the contract lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes ``docs`` to token files in the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    write_token_files(docs, folder, tokenizer_path or default_tokenizer())
    return read_token_files(spark, folder)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, number and checksum of every document's token ids, from the files."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
