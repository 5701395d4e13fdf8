"""Token ids of documents in files of independently compressed frames that share a zstandard dictionary.

A file is a table of blocks in ascending order of documents. A block holds, after a header with the hash of the
dictionary, the ids of its documents (doc_id), their numbers of tokens, an index of frame offsets, and one frame for each
document, so a short document is read by decompressing its frame alone. The dictionary is trained on the serialized ids
of a bounded sample of texts (``SAMPLE_DOCS``); where they are too few for the trainer, they are the dictionary themselves.

Defined cases: null and empty texts hold the end id alone; rows that repeat a doc_id stand together, ordered by the
hash of their text; a null doc_id comes first; an empty table gives an empty file, the only one without a dictionary;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bounded, new_path, written
from .bpe import byte_alphabet
from .token_counts import COMMON, WORDS

MAGIC = b"LTB1"
#: Documents whose ids the dictionary is trained on at most, chunks of each at most, and bytes of a chunk and the dictionary.
SAMPLE_DOCS, SAMPLE_CHUNKS, CHUNK, DICTIONARY = 1000, 16, 4096, 64 << 10
#: A block is closed at so many documents or bytes of frames.
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20


@functools.cache
def library(tokenizer: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer)
    found.no_truncation()
    found.no_padding()
    return found


class WordIds(dict):
    """word -> its ids as the tokenizers library gives them, packed; it is asked once for each word. When the words seen lately
    are ``KEPT`` they take the place of those before, so common words stay; long ones are not kept."""

    KEPT, LONGEST = 500_000, 64

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.asked(word)).tobytes()
        if len(word) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def asked(self, word: str) -> list[int]:
        return self.encode(word, add_special_tokens=False).ids


class ModelIds(WordIds):
    """The same by the library's model alone, which takes the bytes of one word in the alphabet of byte-level files: ``encode`` is
    its ``tokenize``. A whole call of the library for a single word takes about twice as long."""

    ALPHABET = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})

    def asked(self, word: str) -> list[int]:
        return [t.id for t in self.encode(word.encode().decode("latin-1").translate(self.ALPHABET))]


@functools.cache
def common_words():
    """``WORDS`` on texts of ``COMMON`` characters, as a pattern of ``re``, which is faster: letters and digits are spelled out."""
    import regex

    common = [c for c in map(chr, range(0x2100)) if re.fullmatch(COMMON, c)]
    letters, digits = ("".join(c for c in common if regex.fullmatch(kind, c)) for kind in (r"\p{L}", r"\p{N}"))
    return re.compile(WORDS.replace(r"\s\p{L}\p{N}", rf"\s{letters}{digits}").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")).findall


def splits_by_words(tokenizer: str) -> bool:
    """Whether a tokenizer file encodes text word by word, the words being those of ``WORDS``."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    first = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)


@functools.cache
def encoder(tokenizer: str):
    """text -> ids of the tokenizers library. A text of common characters without added strings is encoded word by word, so
    that the library meets each word once; it splits and encodes all other texts, and those of other kinds of files, itself."""
    encode = library(tokenizer).encode
    whole = lambda text: np.array(encode(text, add_special_tokens=False).ids, np.uint32)
    if not splits_by_words(tokenizer):
        return whole
    words, common = common_words(), re.compile(COMMON).fullmatch
    added = [t.content for t in library(tokenizer).get_added_tokens_decoder().values()]
    known = ModelIds(library(tokenizer).model.tokenize)

    def by_words(text: str) -> np.ndarray:
        if not common(text) or any(a in text for a in added):
            return whole(text)
        return np.frombuffer(b"".join(map(known.__getitem__, words(text))), np.uint32)

    return by_words


def id_width(tokenizer: str) -> int:
    return 2 if library(tokenizer).get_vocab_size() <= 1 << 16 else 4


def pack_block(rows: list[tuple], before: int, width: int, dict_hash: bytes) -> bytes:
    """rows: (doc_id or None, n_tokens, frame)."""
    ids = np.array([r[0] if r[0] is not None else 0 for r in rows], "<i8")
    null = np.array([r[0] is None for r in rows], "u1")
    counts = np.array([r[1] for r in rows], "<u8")
    offsets = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype("<u8")
    head = MAGIC + struct.pack("<BQI", width, before, len(rows)) + dict_hash
    return b"".join([head, ids.tobytes(), null.tobytes(), counts.tobytes(), offsets.tobytes(), *(r[2] for r in rows)])


class Block:
    """A block read from its bytes; frames are decompressed one by one on request."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.width, self.before, n = struct.unpack_from("<BQI", data, 4)
        at = 4 + struct.calcsize("<BQI")
        if data[at : at + 32] != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at += 32
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.null = np.frombuffer(data, "u1", n, at + 8 * n)
        self.counts = np.frombuffer(data, "<u8", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 17 * n)
        self.frames = at + 25 * n + 8
        self.data = data
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        a, b = self.frames + int(self.offsets[k]), self.frames + int(self.offsets[k + 1])
        return np.frombuffer(self.open.decompress(self.data[a:b]), f"<u{self.width}")

    def find(self, doc_id: int) -> list[np.ndarray]:
        a, b = np.searchsorted(self.doc_ids, [doc_id, doc_id + 1]) if not self.null.any() else (0, len(self.doc_ids))
        return [self.ids(k) for k in range(a, b) if self.doc_ids[k] == doc_id and not self.null[k]]


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, end_id: int = 0) -> bytes:
    """From the distinct rows of the smallest hashes; of equal rows one is taken."""
    import zstandard

    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("hash"))
    chosen = keyed.select("hash").distinct().orderBy("hash").limit(SAMPLE_DOCS)

    def chunks(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                data = np.append(encode(text or ""), np.uint32(end_id)).astype(f"<u{width}").tobytes()
                every = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
                out.append(every[:: max(1, -(-len(every) // SAMPLE_CHUNKS))])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.binary()))], names=["hash", "chunks"])

    # At most SAMPLE_DOCS hashes are sent, and as many groups come back, however often a row is repeated.
    rows = keyed.join(F.broadcast(chosen), "hash", "left_semi").select("text", "hash").mapInArrow(chunks, "hash long, chunks array<binary>")
    samples = sorted(bytes(c) for r in rows.groupBy("hash").agg(F.first("chunks").alias("chunks")).collect() for c in r["chunks"])
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY].ljust(8, b"\0")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids of all documents, each with ``end_id`` after it; returns the folder with tables blocks and dictionary."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    docs = docs.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text")
    width = id_width(tokenizer)
    dictionary = train_dictionary(docs, tokenizer, width, end_id)
    dict_hash = hashlib.sha256(dictionary).digest()

    def frames(batches):
        import zstandard

        encode = encoder(tokenizer)
        if dictionary:
            shared = zstandard.ZstdCompressionDict(dictionary)
            shared.precompute_compress(level=3)
            pack = zstandard.ZstdCompressor(level=3, dict_data=shared)
        else:
            pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ties, counts, out = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                ids = np.append(encode(text), np.uint32(end_id))
                ties.append(hashlib.blake2b(text.encode(), digest_size=8).digest())
                counts.append(len(ids))
                out.append(pack.compress(ids.astype(f"<u{width}").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ties, pa.binary()), pa.array(counts, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "tie", "n_tokens", "frame"])

    single = written(docs.mapInArrow(frames, "doc_id long, tie binary, n_tokens long, frame binary"), "frames")
    ordered = single.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("shard", F.spark_partition_id())

    def blocks(batches):
        rows, shard, number, before, held = [], None, 0, 0, 0

        def close():
            total = sum(r[1] for r in rows)
            data = pack_block(rows, before, width, dict_hash)
            return total, pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([rows[0][0]], pa.int64()), pa.array([rows[-1][0]], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], names=["shard", "block", "first_doc", "last_doc", "n_tokens", "data"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame", "shard"))):
                rows.append(row[:3])
                shard, held = row[3], held + len(row[2])
                if len(rows) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                    total, out = close()
                    yield out
                    rows, number, before, held = [], number + 1, before + total, 0
        if rows:
            yield close()[1]

    schema = "shard int, block int, first_doc long, last_doc long, n_tokens long, data binary"
    ordered.select("doc_id", "n_tokens", "frame", "shard").mapInArrow(blocks, schema).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(dict_hash), bytearray(dictionary))], "hash binary, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return path


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.schema("hash binary, dictionary binary").parquet(f"{path}/dictionary").first()["dictionary"])


def read_token_files(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """Reads the files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, with ``keep``, ids."""
    schema = "shard int, block int, first_doc long, last_doc long, n_tokens long, data binary"
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
    dictionary = _dictionary(spark, path)
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    shards = written(shards.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shard_start")), "shards")

    def rows(batches):
        for batch in batches:
            for data, shard in zip(batch.column(0), batch.column(1).to_pylist()):
                block = Block(data.as_py(), dictionary)
                n = len(block.doc_ids)
                ids = [block.ids(k) for k in range(n)]
                sizes = np.array([len(x) for x in ids], np.int64)
                starts = block.before + np.cumsum(sizes) - sizes
                arrays = [pa.array([shard] * n, pa.int32()), pa.array(block.doc_ids, mask=block.null.astype(bool)), pa.array(starts, pa.int64()), pa.array(sizes), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                names = ["shard", "doc_id", "start", "n_tokens", "ids_crc32"]
                if keep:
                    arrays.append(pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep
    out = blocks.select("data", "shard").mapInArrow(rows, schema).join(bounded(shards), "shard")
    return out.select("doc_id", (F.col("shard_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep)


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """Ids of a few documents, a list for each row of a doc_id: only blocks whose range holds them are read, and only their
    frames decompressed."""
    dictionary = _dictionary(spark, path)
    hit = functools.reduce(lambda a, b: a | b, [(F.col("first_doc") <= d) & (F.col("last_doc") >= d) for d in doc_ids], F.lit(False)) | F.col("first_doc").isNull()
    out: dict[int, list[list[int]]] = {}
    for row in spark.read.parquet(f"{path}/blocks").where(hit).orderBy("shard", "block").select("data").toLocalIterator():
        block = Block(bytes(row[0]), dictionary)
        for d in doc_ids:
            if found := block.find(d):
                out.setdefault(d, []).extend(ids.tolist() for ids in found)
    return out
