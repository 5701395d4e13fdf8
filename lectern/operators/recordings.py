"""Audio files of any number of chunks without a task that holds one: segments with byte offsets, and parts made of them.

Chunks are parsed apart from one another. How many bytes come before a chunk is summed up by a scan over ranges, the header of a
file is made from the sums alone, and every segment is a row with its place in the file. Parts of bounded size are put together from
neighbouring segments, each in a task of its own, for stores that take a file in parts.

Defined cases: a file of one chunk is that chunk as it is; the first chunk's header is the file's, with its sizes renewed; a file
beyond 4 GiB is an error, found from the sums; a chunk that is no WAV is an error; null audio is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audio import little
from ..shared import kept
from .scan import running

#: Bytes of a part.
PART = 8 << 20
#: The audio of a chunk out of the column that it is made of.
Made = Callable[[Column], Column]


#: Chunks of a WAV that are gone over at first; where the audio is not among them, as many as its bytes can hold.
FEW = 8


def _walked(data: Column, chunks: Column) -> Column:
    """(at, size, wrong) after so many chunks of a WAV: the place (from 0) of the audio, or of the next chunk; the bytes that the
    audio is said to have, null before it is found; the size of a chunk that is too large."""
    state = lambda at, size=None, wrong=None: F.struct(at.cast("long").alias("at"), (F.lit(None) if size is None else size).cast("long").alias("size"), (F.lit(None) if wrong is None else wrong).cast("long").alias("wrong"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        digits = F.hex(data.substr((at + 5).cast("int"), F.lit(4)))
        size = F.conv(F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")
        done = s["size"].isNotNull() | s["wrong"].isNotNull() | (at + 8 > F.octet_length(data))
        audio = data.substr((at + 1).cast("int"), F.lit(4)) == F.lit(b"data")
        return F.when(done, s).when(size > (1 << 31) - 1, state(at, wrong=size)).when(audio, state(at + 8, size)).otherwise(state(at + 8 + size + size % 2))

    return F.aggregate(F.sequence(F.lit(1), chunks), state(F.lit(12)), step)


def parsed(rows: DataFrame, audio: str) -> DataFrame:
    """``rows`` with head, data and rest of a WAV in place of it; together they are its bytes. Row by row in the JVM, as ``header``
    does for one in memory: batches of audio on their way to Python and back would hold hundreds of megabytes."""
    data, size = F.col(audio), F.octet_length(audio)
    fail = lambda *parts: F.raise_error(F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts)))
    wav = (F.substring(data, 1, 4) == F.lit(b"RIFF")) & (F.substring(data, 9, 4) == F.lit(b"WAVE"))
    rows = rows.withColumn("__few", F.when(size < 44, fail("too short for WAV: ", size, " bytes")).when(~wav, fail("not WAV")).otherwise(_walked(data, F.lit(FEW))))
    open_ = F.col("__few.size").isNull() & F.col("__few.wrong").isNull() & (F.col("__few.at") + 8 <= size)
    rows = rows.withColumn("__at", F.when(open_, _walked(data, (size / 8).cast("int"))).otherwise(F.col("__few")))
    at, most = F.col("__at.at").cast("int"), F.col("__at.size").cast("int")
    head = F.when(F.col("__at.wrong").isNotNull(), fail("chunk too large: ", F.col("__at.wrong"))).when(most.isNull(), fail("no audio in WAV")).otherwise(data.substr(F.lit(1), at))
    most = F.least(most, size - at)
    pieces = {"head": head, "data": data.substr(at + 1, most), "rest": data.substr(at + most + 1, size)}
    return rows.select(*[c for c in rows.columns if c not in (audio, "__few", "__at")], *(c.alias(n) for n, c in pieces.items()))


def _placed(chunks: DataFrame, key: str, order: str, audio: str, made: Made) -> DataFrame:
    """(key, at, audio) of the chunks with their places: their file's first chunk, number of chunks and bytes of audio in all, the
    bytes of its header, the bytes of audio before the chunk, and (begin, size) of the audio within the chunk. Audio is made to be
    measured, and not kept: it may be hundreds of times as large as what it is made of."""
    chunks = chunks.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(audio).alias("audio"))
    measured = parsed(chunks.select("key", "at", made(F.col("audio")).alias("audio")).where(F.col("audio").isNotNull()), "audio")
    sizes = kept(measured.select("key", "at", F.octet_length("data").cast("long").alias("size"), F.octet_length("head").alias("head_size")))
    placed = running(sizes, ["key"], ["at"], inclusive=False, before=("sum", F.col("size")))
    files = kept(sizes.groupBy("key").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("chunks"), F.min(F.struct("at", "head_size")).alias("first")))
    files = files.select("key", "total", "chunks", F.col("first.at").alias("first"), F.col("first.head_size").alias("top"))
    too_large = F.col("top") + F.col("total") > (1 << 32) - 1
    files = files.withColumn("total", F.when((F.col("chunks") > 1) & too_large, F.raise_error(F.concat(F.lit("joined audio too large: "), F.col("total").cast("string"), F.lit(" bytes"))).cast("long")).otherwise(F.col("total")))
    # Places and sums meet first, as they are narrow; what audio is made of is dealt out once.
    return chunks.join(placed.join(files, "key"), ["key", "at"])


def _pieces(rows: DataFrame) -> Column:
    """The pieces that a placed chunk gives to its file, by kind: its header, its audio, what comes after it (of a single chunk)."""
    n, none = F.col("size"), F.lit(None).cast(dict(rows.dtypes)["at"])
    piece = lambda kind, at, offset: F.struct(F.lit(kind).alias("kind"), at.alias("at"), offset.alias("offset"))
    start = F.col("top") + F.col("before")
    every = F.array(piece("head", none, F.lit(0).cast("long")), piece("data", F.col("at"), start), piece("rest", F.col("at"), start + n))
    return F.filter(every, lambda p: ((p["kind"] == "head") & (F.col("at") == F.col("first"))) | ((p["kind"] == "data") & (n > 0)) | ((p["kind"] == "rest") & (F.col("chunks") == 1)))


def _bytes(kind: Column, wav: Column, x: Callable[[str], Column]) -> Column:
    """The bytes of a piece, cut out of its chunk's WAV; ``x`` gives the chunk's numbers."""
    top, total, n = x("top").cast("int"), x("total"), x("head_size")
    renewed = F.concat(F.substring(wav, 1, 4), little(top + total - 8), wav.substr(F.lit(9), n - 12), little(total))
    head = F.when(x("chunks") > 1, renewed).otherwise(wav.substr(F.lit(1), n))
    end = n + x("size").cast("int")
    return F.when(kind == "head", head).when(kind == "data", wav.substr(n + 1, x("size").cast("int"))).otherwise(wav.substr(end + 1, F.octet_length(wav)))


def segments(chunks: DataFrame, key: str, order: str, audio: str, made: Made = lambda c: c) -> DataFrame:
    """(key, order, offset, bytes): the pieces of each file by their place; order is null for the file's header. Empty pieces are left
    out. Where the audio of a chunk is ``made`` of a column, that column is kept and dealt out in place of it."""
    rows = _placed(chunks, key, order, audio, made)
    rows = rows.withColumn("wav", made(F.col("audio"))).withColumn("p", F.explode(_pieces(rows)))
    out = rows.select(F.col("key").alias(key), F.col("p.at").alias(order), F.col("p.offset").alias("offset"), _bytes(F.col("p.kind"), F.col("wav"), F.col).alias("bytes"))
    return out.where(F.octet_length("bytes") > 0)


def files(chunks: DataFrame, key: str, order: str, audio: str, made: Made = lambda c: c, most: int = PART) -> DataFrame:
    """The parts of files out of their chunks, as ``parts`` puts segments together; but audio that is ``made`` of a column is made
    only when a part is put together, by the task that does so."""
    rows = _placed(chunks, key, order, audio, made)
    numbers = ("head_size", "size", "top", "total", "chunks")
    rows = rows.withColumn("p", F.explode(_pieces(rows))).select("key", F.expr(f"p.offset div {most}").alias("part"), F.struct("p.offset", "p.kind", "audio", *numbers).alias("s"))
    rows = rows.groupBy("key", "part").agg(F.array_sort(F.collect_list("s")).alias("s"))
    # Bytes under the name of a text, which are joined as they are.
    cut = lambda s: _bytes(s["kind"], made(s["audio"]), lambda name: s[name]).cast("string")
    whole = F.concat_ws("", F.transform("s", cut)).cast("binary")
    rows = rows.select(F.col("key").alias(key), "part", F.element_at("s", 1)["offset"].alias("offset"), whole.alias("bytes"))
    return rows.where(F.octet_length("bytes") > 0)


def parts(pieces: DataFrame, key: str, most: int = PART) -> DataFrame:
    """(key, part, offset, bytes): neighbouring segments of a file put together, those that begin within the same ``most`` bytes."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        return pa.table({"key": table["key"][:1], "part": table["part"][:1], "offset": table["offset"][:1], "bytes": pa.array([b"".join(table["bytes"].to_pylist())], pa.binary())})

    kind = dict(pieces.dtypes)[key]
    rows = pieces.select(F.col(key).alias("key"), F.expr(f"offset div {most}").alias("part"), "offset", "bytes")
    return rows.groupBy("key", "part").applyInArrow(join, f"key {kind}, part long, offset long, bytes binary").withColumnRenamed("key", key)
