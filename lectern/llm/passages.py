"""Substring dedup by content-defined chunking.

A gear rolling hash over the bytes of a text cuts it after each byte whose hash is the greatest within ``WINDOW`` bytes on
either side. A cut depends on the bytes around it alone, never on the cut before, so chunks find themselves again right
after an insertion. Chunks are deduplicated by digest; a run of adjacent chunks that other documents hold too is a repeated
passage where it has ``PASSAGE`` bytes. A run is reported in stretches whose chunks have one first document, so every
shared chunk is first exactly in the first document that holds it, and leaving out the other stretches loses no text.

Defined cases: null and empty texts have no chunks; long texts are chunked whole; rows that repeat a doc_id count as one
document (what only they share is not reported), but positions are those of each text, told apart by text_hash; equal rows
count once; rows without doc_id count as one document that comes after all others; repeats inside one document are not
reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import aside, bounded, written

#: Bytes on either side of a cut whose hashes are no greater; most bytes of a chunk; least bytes of a passage.
WINDOW, MOST, PASSAGE = 28, 512, 80
#: Bytes that a hash depends on, and bits by which each of them moves it.
REACH, SHIFT = 16, 2
#: Bytes that are hashed at a time.
GROUP_BYTES = 1 << 20
#: A digest of so many rows is hot, or of a share of all rows that is more; hot digests are at most 50,000 by that.
HOT, HOT_SHARE = 100_000, 50_000
#: The document number of rows without doc_id.
UNNAMED = (1 << 63) - 1
_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def gear(data: np.ndarray, gaps: np.ndarray | None = None) -> np.ndarray:
    """h[i] = 4 h[i-1] + gear[data[i]] modulo 2^32 at every byte: the sum over the last 16 bytes, by doubling. Bytes at
    ``gaps`` count as nothing."""
    h = _GEAR[data]
    if gaps is not None:
        h[gaps] = 0
    step = 1
    while step < REACH:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(SHIFT * step)
        h += shifted
        step *= 2
    return h


def _moved(h: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(h)
    if by >= 0:
        out[by:] = h[: len(h) - by]
    else:
        out[:by] = h[-by:]
    return out


def peaks(h: np.ndarray) -> np.ndarray:
    """Where a hash is greater than the ``WINDOW`` before it and no less than those after it."""
    wide, size = h, 1  # the greatest of the last ``size``
    while 2 * size <= WINDOW:
        wide = np.maximum(wide, _moved(wide, size))
        size *= 2
    before = np.maximum(_moved(wide, 1), _moved(wide, 1 + WINDOW - size))
    after = np.maximum(_moved(wide, -size), _moved(wide, -WINDOW))
    return np.flatnonzero((h > before) & (h >= after))


def cuts(texts: list[bytes]) -> list[list[int]]:
    """The ends of the chunks of each text, whichever texts stand beside it: a gap between them keeps hashes and windows
    apart."""
    joined = np.frombuffer(bytes(WINDOW).join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    gaps = (starts[:, None] + sizes[:, None] + np.arange(WINDOW)).ravel()
    h = gear(joined, gaps)
    h[gaps] = 0
    marks = peaks(h) + 1
    first, last_ = np.searchsorted(marks, starts, side="right"), np.searchsorted(marks, starts + sizes, side="right")
    out = []
    for k, text in enumerate(texts):
        n, last, ends = len(text), 0, []
        for end in [*(marks[first[k] : last_[k]] - starts[k]).tolist(), n]:
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end > last:
                ends.append(end)
                last = end
        out.append(ends)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(UNNAMED)).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (doc_id or UNNAMED), text_hash, start, size (bytes), digest (of 96 bits, in two parts), one row for each chunk."""

    def emit(keys, texts):
        every = cuts(texts)
        counts = np.array([len(e) for e in every])
        ends = np.fromiter(chain.from_iterable(every), np.int32, counts.sum())
        first = np.cumsum(counts) - counts
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int32)
        starts[first[counts > 0]] = 0
        digest = hashlib.blake2b
        digests = b"".join([digest(text[a:b], digest_size=12).digest() for text, e in zip(texts, every) for a, b in zip([0, *e], e)])
        parts = np.frombuffer(digests, [("one", "<i8"), ("two", "<i4")])
        doc, text_hash = (np.repeat(np.array(k, np.int64), counts) for k in zip(*keys))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, text_hash, starts, ends - starts, parts["one"].copy(), parts["two"].copy())], names=["doc", "text_hash", "start", "size", "digest1", "digest2"])

    def run(batches):
        for batch in batches:
            keys, texts, held = [], [], 0
            for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append(key)
                texts.append((text or "").encode())
                held += len(texts[-1])
                if held >= GROUP_BYTES:
                    yield emit(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield emit(keys, texts)

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc long, text_hash long, start int, size int, digest1 long, digest2 int")


def repeated_passages(docs: DataFrame, least: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each stretch of a passage that other documents hold too: doc_id, start, end (bytes), first_doc_id (the
    first document that holds it), is_first, text_hash. With ``least`` = 1 every shared chunk counts."""
    every = written(chunks(docs, id_col, text_col), "chunks")
    digest = ["digest1", "digest2"]
    # Counted before any join, with partial sums, so a chunk that a third of all rows hold is a few rows.
    shared = every.groupBy(*digest).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("rows"))
    shared = written(shared.where("first < last").select(*digest, "first", "rows"), "shared")
    hot = written(shared.where(F.col("rows") >= max(HOT, every.count() // HOT_SHARE)).drop("rows"), "hot")
    shared = shared.drop("rows")
    if hot.isEmpty():
        hits = every.join(shared, digest)
    else:
        # Rows of a hot digest stay where they are; the others meet by digest.
        hits = every.join(bounded(hot, 16 << 20), digest)
        hits = hits.unionByName(every.join(bounded(hot.select(*digest), 16 << 20), digest, "left_anti").join(shared, digest))
    hits = hits.select("doc", "text_hash", "start", "size", "first").distinct()
    order = W.partitionBy("doc", "text_hash").orderBy("start")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    apart = F.coalesce(F.col("start") != F.lag(F.col("start") + F.col("size")).over(order), F.lit(True))
    hits = hits.withColumn("apart", apart).withColumn("turn", F.col("apart") | (F.col("first") != F.lag("first").over(order)))
    hits = hits.withColumn("run", F.sum(F.col("apart").cast("int")).over(so_far)).withColumn("stretch", F.sum(F.col("turn").cast("int")).over(so_far))
    hits = hits.withColumn("length", F.sum("size").over(W.partitionBy("doc", "text_hash", "run"))).where(F.col("length") >= least)
    found = hits.groupBy("doc", "text_hash", "stretch", "first").agg(F.min("start").cast("long").alias("start"), F.max(F.col("start") + F.col("size")).cast("long").alias("end"))
    named = lambda c: F.when(F.col(c) != UNNAMED, F.col(c))
    return found.select(named("doc").alias("doc_id"), "start", "end", named("first").alias("first_doc_id"), (F.col("first") == F.col("doc")).alias("is_first"), "text_hash")


def without_repeats(docs: DataFrame, least: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with each repeated passage left out of all texts but its first document's, in whole characters."""
    docs, back = aside(docs, id_col, text_col)
    spans = repeated_passages(docs, least, id_col, text_col).where("not is_first")
    # A text has at most as many stretches as chunks.
    spans = spans.groupBy(F.coalesce("doc_id", F.lit(UNNAMED)).alias("__doc"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(UNNAMED))
    rows = docs.join(spans, (key == F.col("__doc")) & (F.xxhash64(text_col) == F.col("__hash")), "left").drop("__doc", "__hash")
    columns = docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new = [remove(text, spans) if spans else text for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist())]
            yield batch.select(list(range(len(columns)))).set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return back(rows.mapInArrow(run, docs.schema))


def remove(text: str, spans: list[dict]) -> str:
    """The text without spans of its bytes, ascending; of a character that a span holds in part nothing is left out."""
    data, out, at = text.encode(), [], 0
    inside = lambda k: k < len(data) and 0x80 <= data[k] < 0xC0
    for span in spans:
        a, b = span["start"], span["end"]
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append(data[at:a])
            at = b
    return b"".join([*out, data[at:]]).decode()
