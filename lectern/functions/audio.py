"""WAV bytes: tones, headers, and ordered joining. Binary layouts are beyond SQL, so these are Arrow functions over columns."""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, FREQUENCY, LOUDNESS = 16_000, 220.0, 0.2
#: Seconds of a tone: a base, one more for so many bytes of text, and the most.
BASE, BYTES_PER_SECOND, MOST = 0.5, 2000.0, 3.0


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """Mono PCM of 16 bits under a header of 44 bytes."""
    data = samples.astype("<i2").tobytes()
    if not 0 <= rate <= (1 << 31) - 1:
        raise ValueError(f"invalid sample rate: {rate}")
    if len(data) > (1 << 32) - 1 - 36:
        raise ValueError(f"too much audio: {len(data)} bytes")
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def header(data: bytes) -> tuple[bytes, bytes]:
    """(header up to the audio, the audio); a declared size beyond the data is cut to it."""
    if len(data) < 44:
        raise ValueError(f"too short for WAV: {len(data)} bytes")
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not WAV")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if size > (1 << 31) - 1:
            raise ValueError(f"chunk too large: {size}")
        if data[at : at + 4] == b"data":
            return data[: at + 8], data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no audio in WAV")


def concatenated(parts: list[bytes]) -> bytes:
    """Audio one after another under the first header, its sizes renewed."""
    if not parts:
        raise ValueError("nothing to join")
    if len(parts) == 1:
        return parts[0]
    head = bytearray(header(parts[0])[0])
    data = b"".join(header(p)[1] for p in parts)
    if len(head) + len(data) > (1 << 32) - 1:
        raise ValueError(f"joined audio too large: {len(data)} bytes")
    head[4:8] = struct.pack("<I", len(head) + len(data) - 8)
    head[-4:] = struct.pack("<I", len(data))
    return bytes(head) + data


def tone_seconds(text: Column) -> Column:
    """How long a stand-in tone for a text lasts."""
    return F.least(F.lit(BASE) + F.octet_length(text) / F.lit(BYTES_PER_SECOND), F.lit(MOST))


def little(n: Column) -> Column:
    """Four bytes of a number, the lowest first."""
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1))))


@cache
def _longest_tone() -> bytes:
    """The longest tone as WAV; a shorter one is a prefix of it but for its sizes."""
    t = np.arange(int(MOST * RATE)) / RATE
    return wav(np.trunc(np.sin(2 * np.pi * FREQUENCY * t) * LOUDNESS * 32767))


def tone(text: Column) -> Column:
    """A stand-in tone for a text as WAV, longer for longer texts. Made row by row in the JVM: audio is much larger than its text,
    so batches of it would hold a gigabyte."""
    longest = _longest_tone()
    seconds = F.least(F.lit(BASE) + F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(BYTES_PER_SECOND), F.lit(MOST))
    # Durations are whole nanoseconds, as clocks count them.
    size = (2 * F.floor(F.floor(seconds * 1e9) / F.lit(1e9) * RATE)).cast("int")
    return F.concat(F.lit(longest[:4]), little(size + 36), F.lit(longest[8:40]), little(size), F.substring(F.lit(longest[44:]), 1, size))


def joined_audio(chunks: DataFrame, key: str, order: str, audio: str) -> DataFrame:
    """One WAV for each key, its chunks in order. Chunks of a key meet in one task, as one file is made of them."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        return pa.table({key: table[key][:1], audio: pa.array([concatenated(table[audio].to_pylist())], pa.binary())})

    kind = dict(chunks.dtypes)[key]
    return chunks.select(key, order, audio).groupBy(key).applyInArrow(join, f"{key} {kind}, {audio} binary")
