"""Media columns: payloads stored losslessly as WebP images, read back, and described by features of their pixels.

``store`` writes a table of media (a BINARY column) to the shared folder; ``describe`` reads the stored bytes back, decodes
them into arrays of samples and computes features of those. See ``webp`` for the format.

Defined cases: null text counts as empty; an empty text is one row of spaces; a long text is one file of several images of
a bounded number of rows, so steps stay bounded; equal texts have equal media; repeated rows and rows without doc_id stay;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import written
from .webp import ROW, decode_payloads, encode_payloads

#: Bytes of texts, or of media, that are coded at a time.
GROUP_BYTES = 8 << 20


def payload_of(text: str) -> tuple[int, bytes]:
    data = text.encode()
    return len(data), data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b" ")


def feature(payload: bytes) -> str:
    """Rows, mean level, mean step to the next sample and to the next row (in thousandths), and eight shares of levels."""
    s = np.frombuffer(payload, np.uint8)
    grid = s.reshape(-1, ROW).astype(np.int32)
    part = lambda total, n: int(total) * 1000 // max(1, n)
    across, down = np.abs(np.diff(grid, axis=1)), np.abs(np.diff(grid, axis=0))
    levels = np.bincount(s >> 5, minlength=8)
    numbers = [part(grid.sum(), s.size), part(across.sum(), across.size), part(down.sum(), down.size), *(part(x, s.size) for x in levels)]
    return f"{len(grid)}x{ROW}:" + ",".join(map(str, numbers))


def _groups(batches, size):
    """Rows (tuples) of Arrow batches in lists of about GROUP_BYTES, so that many images are coded together."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            held += size(row)
            if held >= GROUP_BYTES:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table doc_id, n_bytes, media."""

    def run(batches):
        for rows in _groups(batches, lambda r: len(r[1] or "")):
            payloads = [payload_of(t or "") for _, t in rows]
            media = encode_payloads([p for _, p in payloads])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([n for n, _ in payloads], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text")
    return written(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def describe(media: DataFrame) -> DataFrame:
    """Of ``store``: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width and
    pixels, the 8-bit samples row by row; all but n_bytes from the stored bytes."""

    def run(batches):
        for rows in _groups(batches, lambda r: len(r[2])):
            ids, sizes, files = zip(*rows)
            payloads = decode_payloads(list(files))
            arrays = [
                pa.array(ids, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                pa.array([len(m) for m in files], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in files], pa.string()),
                pa.array([feature(p) for p in payloads], pa.string()),
                pa.array([ROW] * len(files), pa.int32()),
                pa.array(payloads, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "pixels"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, pixels binary"
    return media.mapInArrow(run, schema)
