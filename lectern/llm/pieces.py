"""Encoding and decoding whole texts with a sentencepiece model, exactly as its library does.

Encoding is by backtracking (see ``bpe``); decoding is the library's ``decode(ids)``.

Defined cases: null and empty texts have no ids and decode to the empty text; very long texts are encoded cut by cut,
where no piece can reach across; repeated rows and ties of doc_id stay as they are; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import piece_coder


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_decode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and those of ids (array) and decoded (text) that ``keep`` names."""
    kinds = {"ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.string(), "string")}

    def run(batches):
        coder = piece_coder(model)
        for batch in batches:
            out: list[list] = [[] for _ in range(3 + len(keep))]
            for text in batch.column(1).to_pylist():
                joined = coder.encode_text(text or "")
                ids = np.fromstring(joined, np.int32, sep=",").tolist() if joined else []
                decoded = coder.library.decode(ids) if ids else ""
                made = {"ids": ids, "decoded": decoded}
                for column, x in zip(out, (len(ids), sha256(joined.encode()), sha256(decoded.encode()), *(made[c] for c in keep))):
                    column.append(x)
            types = (pa.int64(), pa.string(), pa.string(), *(kinds[c][0] for c in keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, types)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {kinds[c][1]}" for c in keep)
    return docs.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text").mapInArrow(run, schema)
