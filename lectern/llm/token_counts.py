"""Exact token counts of every prefix of a text, by dynamic programming over the merge table of a byte-level encoder.

The tokenizer first splits a text into words; within a word the table ``MergeTable.prefixes`` holds the number of tokens
of every prefix (see ``bpe``). A prefix of a text is split like the text up to the word it ends in, with three exceptions:
blanks at its end are one word, the first letters of a cut contraction are not part of it, and a cut added string is plain
text. The first two are settled by the table of the blanks or letters alone, the third by counting its few prefixes.

The counts are stored, as compressed steps from each prefix to the next, and questions are answered from them: the tokens
of any prefix, the whole count, and the longest prefix within a budget, without encoding a text again.

Defined cases: null and empty texts have 0 tokens; strings of added tokens inside a text count as that token, as is the
library's default; very long words take time in proportion to their length; repeated rows and rows without doc_id stay; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from array import array
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import written
from .bpe import byte_level

#: How byte-level encoders of this family split texts into words (fixed value of the public tokenizer files).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only are split by ``regex``; for others, where versions of Unicode differ, the library splits.
COMMON = r"[\x00-\x1b\x20-ɏ‐-‧€]*"


#: Words of three characters whose first two are no word of their own: both count alone in a prefix.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: Blanks as Unicode has them (White_Space), which Python's classes widen by U+001C to U+001F.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = re.compile(f"[{BLANK}]+").fullmatch
#: Blanks that are split before their last one, as something else follows; and the first blank after something else.
_SPLIT_BLANKS = re.compile(f"[{BLANK}][{BLANK}][^{BLANK}]").search
_FIRST_BLANKS = re.compile(f"(?<=[^{BLANK}])[{BLANK}]")


class PrefixCounter:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.table, self.ids, self.added = byte_level(path)
        self.library = Tokenizer.from_file(path)
        self.split_words = regex.compile(WORDS).findall
        self.common = re.compile(COMMON).fullmatch
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        #: Words seen lately, and before that, with the steps of their counts as bytes of 16-bit numbers: when the first are
        #: full they take the place of the second, so common words stay.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The text cut into words and added strings."""
        return [w for part in self._parts(text) for w in ([part] if part in self.added else self._words(part))]

    def _parts(self, text: str) -> list[str]:
        return self.added_split(text) if self.added and any(a in text for a in self.added) else [text]

    def _words(self, text: str) -> list[str]:
        if self.common(text):
            return self.split_words(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def word_prefixes(self, word: str) -> list[int]:
        """The number of tokens of each prefix of a word, by code points."""
        counts = self.table.prefixes(word.encode().decode("latin-1"))[1]
        return [counts[e - 1] for e in accumulate(len(c.encode()) for c in word)]

    def _steps(self, word: str) -> bytes:
        if (steps := self.older.get(word)) is None:
            counts = self.table.prefixes(word)[1] if word.isascii() else self.word_prefixes(word)
            if word in CONTRACTIONS:
                counts[1] = counts[0] + self.word_prefixes(word[1])[0]
            steps = array("h", map(sub, counts, [0, *counts])).tobytes()
        if len(word) <= 64:
            if len(self.kept) >= 200_000:
                self.kept, self.older = {}, self.kept
            self.kept[word] = steps
        return steps

    def counts(self, text: str) -> tuple[list[str], list[int]]:
        """The words of the text and the number of tokens up to the end of each."""
        words = self.words(text)
        return words, list(accumulate(1 if w in self.added else self.word_prefixes(w)[-1] for w in words))

    def _count(self, text: str) -> int:
        """Tokens of a short text without added strings."""
        return sum(self.word_prefixes(w)[-1] for w in self._words(text))

    def steps(self, text: str) -> np.ndarray:
        """The change of the number of tokens from each prefix of the text to the one that is a code point longer."""
        parts = self._parts(text)
        if len(parts) == 1:
            return self._plain_steps(text)
        out = []
        for k, part in enumerate(parts):
            if k % 2 == 0:
                out.append(self._plain_steps(part))
                continue
            # Cut short, the added string is plain text that may go on with the word before it: all that follows the last
            # place where something else ends and blanks begin.
            before = parts[k - 1]
            place = [m.start() for m in _FIRST_BLANKS.finditer(before)][-1:] or [0]
            tail = before[place[0] :]
            base = self._count(tail)
            counts = [self._count(tail + part[:n]) - base for n in range(1, len(part))] + [1]
            out.append(np.diff(np.array(counts, np.int32), prepend=np.int32(0)).astype(np.int16))
        return np.concatenate(out)

    def _plain_steps(self, text: str) -> np.ndarray:
        words = self._words(text)
        found = list(map(self.kept.get, words))
        if None in found:
            found = [self.kept.get(w) or self._steps(w) for w in words]
        if not _SPLIT_BLANKS(text):
            return np.frombuffer(b"".join(found), np.int16)
        out = np.frombuffer(bytearray().join(found), np.int16)
        at = 0
        for k, (word, after) in enumerate(zip(words, words[1:])):
            at += len(word)
            if _BLANKS(word) and _BLANKS(after[0]):
                # Up to here the blanks are one word; the next character splits the last one off again.
                more = self.word_prefixes(word + after[0])[-1] - self.word_prefixes(word)[-1] - int(out[at])
                out[at] += more
                if at + 1 < len(out):
                    out[at + 1] -= more
        return out

    def every_prefix(self, text: str) -> list[int]:
        """The number of tokens of each prefix of the text, by code points, from 0 on."""
        return [0, *np.cumsum(self.steps(text), dtype=np.int64).tolist()]


@functools.cache
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


class Prefixes:
    """The stored counts of a text."""

    def __init__(self, stored: bytes):
        import zlib

        self.counts = np.cumsum(np.frombuffer(zlib.decompress(stored), np.int16), dtype=np.int64)

    @staticmethod
    def stored(steps: np.ndarray) -> bytes:
        import zlib

        return zlib.compress(steps.tobytes(), 1)

    def count(self, code_points: int | None = None) -> int:
        """The tokens of a prefix, or of all."""
        n = len(self.counts) if code_points is None else min(code_points, len(self.counts))
        return int(self.counts[n - 1]) if n > 0 else 0

    def longest_within(self, budget: int) -> int:
        """The most code points that a prefix of at most ``budget`` tokens can have."""
        good = np.flatnonzero(self.counts <= budget)
        return int(good[-1]) + 1 if len(good) else 0


def prefix_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table doc_id, n_bytes, counts: for each text the stored counts of its prefixes (see ``Prefixes``)."""

    def run(batches):
        counter = prefix_counter(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([Prefixes.stored(counter.steps(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "counts"])

    rows = docs.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text")
    return written(rows.mapInArrow(run, "doc_id long, n_bytes long, counts binary"), "prefixes", compression="none")


def token_counts(table: DataFrame, limit: int = 1024) -> DataFrame:
    """Of a ``prefix_table``: doc_id, n_bytes, n_tokens, over_limit and chars_within, the code points of the longest prefix that
    has at most ``limit`` tokens."""

    def run(batches):
        for batch in batches:
            found = [Prefixes(x) for x in batch.column(2).to_pylist()]
            n = [x.count() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array([x.longest_within(limit) for x in found], pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"])

    return table.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long")
