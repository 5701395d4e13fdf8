"""Packing marked-up sentences into chunks of bounded bytes, by prefix sums over all documents of a batch at once."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shared import sliced

#: Most bytes of a chunk, its wrapper counted.
LIMIT = 900
OPEN, CLOSE = "<speak>", "</speak>"
_WRAP = len(OPEN) + len(CLOSE)
_TEXTS = pa.list_(pa.string())


def marked_sentences(c: Column) -> Column:
    """The <s>...</s> blocks. A plain <s> anywhere later is taken before an <s with attributes> in front of it."""
    plain = F.regexp_extract_all(c, F.lit(r"(?s)<s>.*?</s>"), 0)
    # What stands behind the last plain block may hold blocks with attributes.
    rest = F.regexp_replace(c, r"(?s)^.*<s>.*?</s>", "")
    return F.concat(plain, F.regexp_extract_all(rest, F.lit(r"(?s)<s .*?</s>"), 0))


def pack_starts(sizes: np.ndarray, owners: np.ndarray, room: int) -> np.ndarray:
    """Where packs start when items are packed greedily, each owner's apart: a pack takes items while their sizes fit into the
    room, and one item at least. Owners are ascending; True for the first item of each pack.

    The item after a pack that starts at an item is found for all items at once, by a binary search among the prefix sums of
    sizes; the starts are then the path along these successors from each owner's first item, found by doubling."""
    n = len(sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    last = np.searchsorted(owners, owners, side="right")
    follow = np.minimum(np.maximum(np.searchsorted(ends, begins + room, side="right"), np.arange(n) + 1), last)
    starts = np.ones(n + 1, bool)
    starts[1:n] = owners[1:] != owners[:-1]
    # After k rounds a step goes over 2^k packs; every start so far takes it, and steps double.
    step = np.append(follow, n)
    while True:
        reached = starts.copy()
        reached[step[starts]] = True
        if (reached == starts).all():
            return starts[:n]
        starts, step = reached, step[step]


def _bytes(items: list[str]) -> np.ndarray:
    return np.fromiter((len(x.encode()) for x in items), np.int64, len(items))


def _packs(lists: list[list[str]], room: int, more: int, join: str) -> list[list[str]]:
    """Each list's items (of their bytes and ``more`` each) packed and joined."""
    items = list(chain.from_iterable(lists))
    out: list[list[str]] = [[] for _ in lists]
    if not items:
        return out
    owners = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    places = np.flatnonzero(pack_starts(_bytes(items) + more, owners, room))
    for owner, a, b in zip(owners[places].tolist(), places.tolist(), [*places[1:].tolist(), len(items)], strict=True):
        out[owner].append(join.join(items[a:b]))
    return out


# White space of markup: blanks and line ends of ASCII, the next-line sign, and Unicode's separators.
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_PARTS = re.compile("[^.!?]*[.!?]|[^.!?]+")


def _raw(texts: list[str | None], limit: int) -> list[list[str] | None]:
    long_ = [t is not None and len(t.encode()) > limit for t in texts]
    packed = _packs([_PARTS.findall(t) if over else [] for t, over in zip(texts, long_, strict=True)], limit, 0, "")
    return [None if t is None else pack if over else [t] for t, over, pack in zip(texts, long_, packed, strict=True)]


def _marked(lists: list[list[str]], limit: int) -> list[list[str]]:
    """Sentences of each document packed; one that is too long for a chunk is cut between words, which share no chunk with
    other sentences."""
    room = limit - _WRAP
    runs: list[list[str]] = []  # documents, cut at sentences that are too long
    parts: list[list[tuple[str, int]]] = []
    words: list[list[str]] = []
    for sentences in lists:
        own: list[tuple[str, int]] = []
        run: list[str] = []
        for x in [*sentences, None]:
            if x is not None and len(x.encode()) <= room:
                run.append(x)
                continue
            if run:
                own.append(("run", len(runs)))
                runs.append(run)
                run = []
            if x is not None:
                own.append(("words", len(words)))
                words.append([w for w in _BLANKS.split(re.sub(r"^\s*<s>", "", x.removesuffix("</s>").removeprefix("<s>"), flags=re.A)) if w])
        parts.append(own)
    packed = _packs(runs, room, 0, "")
    cut = _packs(words, room - len("<s></s>"), 1, " ")
    wrapped = lambda kind, k: packed[k] if kind == "run" else [f"<s>{x}</s>" for x in cut[k]]
    return [[f"{OPEN}{x}{CLOSE}" for kind, k in own for x in wrapped(kind, k)] for own in parts]


def raw_pieces(c: Column, limit: int = LIMIT) -> Column:
    """Unmarked text: whole if short, else cut after . ! ? and packed; not wrapped."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return sliced(lambda t: pa.array(_raw(t.to_pylist(), limit), _TEXTS), _TEXTS, texts)

    return cut(c)


def chunked(c: Column, limit: int = LIMIT) -> Column:
    """A marked-up document as wrapped chunks of at most ``limit`` bytes; only a single longer word goes beyond."""

    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        plain, lists = texts.to_pylist(), found.to_pylist()
        raw = _raw([t if not own else "" for t, own in zip(plain, lists, strict=True)], limit)
        marked = _marked([own or [] for own in lists], limit)
        return pa.array([b if own else a for a, b, own in zip(raw, marked, lists, strict=True)], _TEXTS)

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        return sliced(run, _TEXTS, texts, found)

    return cut(c, marked_sentences(c))
