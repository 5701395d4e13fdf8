"""Merge tables of public byte-pair encoders, and two exact ways to encode with them.

``MergeTable`` holds pieces (strings of unit characters) by merge order. Two adjacent tokens can stand side by side in
an encoding exactly if merging their joint text again gives the same two tokens; ``fits`` decides that by taking the
later merges at the seam apart. On it rest

* ``encode``: backtracking. Take the longest piece at each position (found by Aho-Corasick), try shorter ones where the
  seam does not fit, step back where none fits, and keep a bitfield of positions that failed, so none is tried twice;
* ``prefixes``: dynamic programming. For each prefix the one last token whose seam fits what stands before it, and so
  the exact number of tokens of every prefix.

Nothing here is trained; the files of the public tokenizers are read where they are installed.
"""

from __future__ import annotations

import functools
import json
from collections import defaultdict

import ahocorasick
import numpy as np


class MergeTable:
    """pieces: by rank, the single units first or anywhere; splits: for each rank the two ranks merged into it, or None for a
    unit. Pieces that their own text never leads to have to be left out by the caller."""

    def __init__(self, pieces: list[str], splits: list[tuple[int, int] | None]):
        self.pieces, self.n = pieces, len(pieces)
        self.rank = {p: i for i, p in enumerate(pieces)}
        self.left = [i if s is None else s[0] for i, s in enumerate(splits)]
        self.right = [i if s is None else s[1] for i, s in enumerate(splits)]
        self.size = [len(p) for p in pieces]
        self.merged: dict[int, int] = {}
        for i, s in enumerate(splits):
            if s is not None:
                self.merged[s[0] * self.n + s[1]] = i
        self.any_merge = self.merged.get
        self.seams: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        #: the same without single units, which stand wherever nothing longer does
        self.joint = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            if len(p) > 1:
                self.joint.add_word(p, (len(p) - 1, i))
        self.joint.make_automaton()
        #: the longest proper prefix of each piece that is a piece, or -1
        self.shorter = [-1] * self.n
        rank = self.rank
        for i, p in enumerate(pieces):
            for k in range(len(p) - 1, 0, -1):
                if p[:k] in rank:
                    self.shorter[i] = rank[p[:k]]
                    break

    def merge_of(self, a: int, b: int) -> int | None:
        return self.any_merge(a * self.n + b)

    def fits(self, a: int, b: int) -> bool:
        """Whether re-merging the text of a and b gives a and b again: no merge across the seam, between what each side
        has been at some time, comes before the merges that made the sides."""
        key = a * self.n + b
        known = self.seams.get(key)
        if known is not None:
            return known
        if len(self.seams) > 500_000:
            self.seams.clear()
        x, y, limit = a, b, self.n
        ok = True
        while True:
            m = self.merge_of(x, y)
            if m is not None and m < limit:
                ok = False
                break
            # Undo the later merge of the two sides; on equal ranks the left one came first.
            x_unit, y_unit = self.right[x] == x, self.left[y] == y
            if x_unit and y_unit:
                break
            if y_unit or (not x_unit and x > y):
                # Left merge x is undone: a merge across the seam must come before it to prevent it.
                limit, x = x, self.right[x]
            else:
                # Right merge y: a seam merge of the same rank stands further left and would come first.
                limit, y = y + 1, self.left[y]
        self.seams[key] = ok
        return ok

    def longest(self, text: str) -> list[int]:
        """For each position the longest piece that starts there."""
        out = list(map(self.rank.__getitem__, text))
        # Matches come by their ends, so of those that start at one place the last is the longest.
        for end, (back, i) in self.joint.iter(text):
            out[end - back] = i
        return out

    def encode(self, text: str) -> list[int]:
        """Ranks of the tokens of ``text``; all its characters must be units of the table."""
        longest, n = self.longest(text), len(text)
        open_, size, shorter, fits = bytearray(b"\x01") * (n + 1), self.size, self.shorter, self.fits
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + size[token]
                if open_[end] and (last < 0 or fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            else:
                open_[at] = 0
                if not out:
                    raise ValueError("a character is not a unit of the table")
                token = out.pop()
                at -= size[token]
        return out

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """For each length 1.. of a prefix: its last token and its number of tokens."""
        n, size, fits = len(text), self.size, self.fits
        last, count = [-1] * n, [0] * n
        done = -1
        for end, i in self.automaton.iter(text):
            if end == done:
                continue
            at = end - size[i]
            if at < 0:
                last[end], count[end], done = i, 1, end
            elif fits(last[at], i):
                last[end], count[end], done = i, count[at] + 1, end
        return last, count


@functools.cache
def byte_alphabet() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 for itself, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.cache
def byte_level(path: str) -> tuple[MergeTable, list[int], dict[str, int]]:
    """Of a byte-level tokenizer file (JSON): the table over Latin-1 text of bytes, ids by rank, added strings to ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: chr(b) for b, c in byte_alphabet().items()}
    plain = lambda s: "".join(map(back.__getitem__, s))
    vocab = spec["model"]["vocab"]
    units = [byte_alphabet()[b] for b in range(256)]
    pieces, ids, splits = [plain(u) for u in units], [vocab[u] for u in units], [None] * 256
    rank = {u: i for i, u in enumerate(units)}
    for pair in spec["model"]["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        rank[a + b] = len(pieces)
        pieces.append(plain(a + b))
        ids.append(vocab[a + b])
        splits.append((rank[a], rank[b]))
    return MergeTable(pieces, splits), ids, {t["content"]: t["id"] for t in spec["added_tokens"]}


def merge_again(parts: list[str], score: dict[str, float]) -> list[str]:
    """Merging from scratch: the best-scored joint piece first, the leftmost among equals. With a heap, so long runs
    take n log n steps."""
    import heapq

    n = len(parts)
    parts, after, before, alive = list(parts), [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and (s := score.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (-s, i, len(parts[i]) + len(parts[j]), j))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, size, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and len(parts[i]) + len(parts[j]) == size):
            continue
        parts[i] += parts[j]
        alive[j] = False
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p, a in zip(parts, alive) if a]


class PieceCoder:
    """A sentencepiece model of the merge type with byte fallback and no normalisation, encoded by backtracking.

    The text is cut where no piece can reach across (before a word mark that follows another character, and around
    characters that are in no piece); each cut is encoded once and kept. Runs of word marks may hold pieces of equal
    score, for which seams are not unique; these runs are merged from scratch."""

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.library = s = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(s.get_piece_size())
        self.bytes = {int(s.id_to_piece(i)[3:5], 16): i for i in every if s.is_byte(i)}
        self.ids = {s.id_to_piece(i): i for i in every if not (s.is_byte(i) or s.is_control(i) or s.is_unknown(i) or s.is_unused(i))}
        self.score = {p: s.get_score(i) for p, i in self.ids.items()}
        if any(self.MARK in p.lstrip(self.MARK) for p in self.ids):
            raise ValueError("a piece holds a word mark after other characters")
        order = sorted(self.ids, key=lambda p: (len(p) > 1, -self.score[p]))
        pieces, splits, rank = [], [], {}
        for p in order:
            if len(p) == 1:
                split = None
            elif set(p) == {self.MARK}:
                continue
            else:
                parts = self._last_merge(p, rank)
                if parts is None:
                    continue
                split = parts
            rank[p] = len(pieces)
            pieces.append(p)
            splits.append(split)
        self.table = _AnyPair(pieces, splits)
        self.by_rank = [self.ids[p] for p in pieces]
        self.units = {p for p in pieces if len(p) == 1}
        import re

        m, every = self.MARK, "".join(f"{p}\0" for p in self.ids)
        newline = "" if "\n" in every else r"\n"
        # Where no piece has a full stop or comma right after a letter, words end before them.
        letter = "[A-Za-zÀ-ÖØ-öø-ɏ]"
        stop = "" if re.search(f"{letter}[.,]", every) else f"{m}*+{letter}++(?=[.,])|"
        self.cuts = re.compile(f"{stop}{newline}{'|' * bool(newline)}{m}*+[^{m}{newline}]++|{m}++").findall
        # Cuts seen lately and before that: when the first is full it takes the place of the second, so common ones stay.
        self.kept: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _last_merge(self, piece: str, rank: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces that the text of ``piece`` comes to just before its last merge; None if it never gets there."""
        parts = list(piece)
        if any(c not in rank for c in parts):
            return None
        while len(parts) > 2:
            best = min(((rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return rank[parts[0]], rank[parts[1]]

    def _cut_ids(self, cut: str) -> list[int]:
        m = self.MARK
        if cut[:2] == m + m:
            return [i for p in merge_again(list(cut), self.score) for i in self._of(p)]
        if self.units.issuperset(cut):
            return [self.by_rank[r] for r in self.table.encode(cut)]
        out: list[int] = []
        run = ""
        for c in cut:
            if c in self.units:
                run += c
                continue
            if run:
                out += [self.by_rank[r] for r in self.table.encode(run)]
                run = ""
            out += [self.bytes[b] for b in c.encode()]
        if run:
            out += [self.by_rank[r] for r in self.table.encode(run)]
        return out

    def _of(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]

    def encode_text(self, text: str) -> str:
        """The ids of the text, in decimals joined by commas."""
        if not text:
            return ""
        cuts = self.cuts(self.MARK + text.replace(" ", self.MARK))
        out = list(map(self.kept.get, cuts))
        if None in out:
            out = [self._keep(cut) if got is None else got for cut, got in zip(cuts, out)]
        return ",".join(out)

    def _keep(self, cut: str) -> str:
        got = self.kept.get(cut) or self.older.get(cut) or ",".join(map(str, self._cut_ids(cut)))
        if len(cut) <= 64:
            if len(self.kept) >= 250_000:
                self.kept, self.older = {}, self.kept
            self.kept[cut] = got
        return got

    def encode(self, text: str) -> list[int]:
        return np.fromstring(self.encode_text(text), np.int32, sep=",").tolist() if text else []


class _AnyPair(MergeTable):
    """Any two pieces whose joint text is a piece merge into it, whichever way that piece is usually made."""

    def merge_of(self, a: int, b: int) -> int | None:
        return self.rank.get(self.pieces[a] + self.pieces[b])


@functools.cache
def piece_coder(path: str) -> PieceCoder:
    return PieceCoder(path)
