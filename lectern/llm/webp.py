"""Lossless WebP (VP8L) in NumPy and plain Python: a full decoder, and an encoder for samples and pixel arrays.

The decoder reads prefix codes (simple and normal, with meta prefix codes), back-references with the two-dimensional
distance map, and the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.
``decode_streams`` decodes many images at once: those of one green code whose other colours are fixed, with back-references
or a colour cache or neither, are read together, as arrays; all others (several groups of codes, references beside a cache,
colours) take the general path.

The content of a page decides how it is stored (``choose``): whichever of all features makes it smallest.

A file of several images is an animation whose frames are tiles of one canvas, so a payload of any length is one file.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_CODES, DISTANCE_CODES, CACHE_MULTIPLIER = 24, 40, 0x1E35A7BD
#: Nearby places by distance, then by |x|, right before left: the meaning of distance codes 1 to 120.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

#: Samples in a row and rows in a page of stored samples; longest code of their pages.
ROW, PAGE_ROWS, MOST_BITS = 192, 128, 11
#: Symbols that are read one by one in the time of a step in lockstep.
STEP_SYMBOLS = 60
#: Bytes of streams with back-references that are read at a time.
TOKEN_BYTES = 1 << 15
#: Shortest back-reference, samples of one that are compared, longest.
LEAST, REACH, LONGEST = 4, 64, 4096
#: Predictor modes that look at the row above only; tile sizes and cache bits of stored samples, as powers of two.
FROM_ABOVE, TILE_BITS, ONE_TILE, CACHE_BITS = (2, 3, 4, 8, 9), 6, 9, 6
#: Half of the freed memory that a process keeps for its next arrays.
KEPT_BYTES = 24 << 20
#: Share of its bits that counts must promise to save before a page is coded in another way as well.
WORTH = 0.01
#: Tiles of groups of codes, as a power of two; bytes of pages whose coding is chosen together.
META_BITS, CHOICE_BYTES = 3, 1 << 18


class Bits:
    """Reads bits, lowest first, at most 57 at once."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        at = self.at
        first = at >> 3
        value = int.from_bytes(self.data[first : first + 8], "little") >> (at & 7)
        self.at = at + n
        return value & ((1 << n) - 1)


class Sink:
    """Writes bits, lowest first."""

    def __init__(self):
        self.value, self.size, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n
        if self.size >= 512:
            whole = self.size >> 3
            self.parts.append((self.value & ((1 << (8 * whole)) - 1)).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.size -= 8 * whole

    def bits(self) -> int:
        return 8 * sum(map(len, self.parts)) + self.size

    def done(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes((self.size + 7) >> 3, "little")


def _reversed(bits: int) -> list[int]:
    out = [0]
    for k in range(bits):
        out += [x | 1 << (bits - 1 - k) for x in out]
    return out


#: Numbers of up to 15 bits with their bits the other way round.
_REVERSED = _reversed(15)


def reverse(code: int, n: int) -> int:
    return _REVERSED[code] >> (15 - n)


@functools.cache
def turned(width: int) -> np.ndarray:
    """All numbers of ``width`` bits with their bits the other way round."""
    return np.array(_REVERSED, np.int64)[: 1 << width] >> (15 - width)


@functools.cache
def keep_freed() -> None:
    """glibc gives large blocks back to the system when they are freed, and the arrays of the next pages have to be paged in anew,
    a sixth of the time of encoding them. After a block of this size was freed once it keeps up to twice as much for itself."""
    np.empty(KEPT_BYTES, np.uint8)


def numbers_at(data: np.ndarray, kind: str) -> np.ndarray:
    """The number of type ``kind``, lowest byte first, that begins at each byte, as far as whole ones do."""
    return np.ndarray(len(data) - np.dtype(kind).itemsize + 1, kind, data, 0, (1,)).copy()


def walked(onward: np.ndarray) -> np.ndarray:
    """Places on the way from 0 on, ascending: ``onward`` has the place after each, its length being the end. Only every eighth
    place is reached one after another; those between follow from these, all at once."""
    n = len(onward)
    one = np.append(onward, n)
    two = one[one]
    four = two[two]
    jump, at, found = four[four].data, 0, []
    while at < n:
        found.append(at)
        at = jump[at]
    places = np.array(found, np.int64)
    for more in (four, two, one):
        places = np.concatenate([places, more[places]])
    mark = np.zeros(n + 1, bool)
    mark[places] = True
    return np.flatnonzero(mark[:n])


def canonical(lengths: list[int] | np.ndarray) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, length)"""
    out, code, last = {}, 0, 0
    for n, symbol in sorted((int(n), s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[symbol] = (reverse(code, n), n)
        code, last = code + 1, n
    return out


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes with their first bit lowest, of complete prefix codes of at least two symbols (along the last axis)."""
    order = np.argsort(np.where(lengths > 0, lengths, 16).astype(np.uint8), -1, kind="stable")
    bits = np.take_along_axis(lengths, order, -1)
    room = np.where(bits > 0, 1 << (15 - bits), 0)
    out = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(out, order, turned(15)[np.minimum(np.cumsum(room, -1) - room, (1 << 15) - 1)], -1)
    return np.where(lengths > 0, out, 0)


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a complete prefix code for the symbols that occur, none over ``most``; 1 for a single symbol."""
    out = np.zeros(len(counts), np.int64)
    symbols = np.flatnonzero(counts)
    if len(symbols) < 2:
        out[symbols] = 1
        return out
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    n = len(order)
    weight, parent = counts[order].tolist(), [0] * (2 * n - 1)
    leaf, node = 0, n
    for new in range(n, 2 * n - 1):  # two queues: leaves by count, and joined nodes, which come in order
        total = 0
        for _ in range(2):
            if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, node = node, node + 1
            parent[pick] = new
            total += weight[pick]
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    out[order] = _limited(depth[:n], weight, most)
    return out


def _limited(lengths: list[int], weight: list[int], most: int) -> list[int]:
    """Lengths of a complete code (the rarest symbols first) with none over ``most``."""
    n = len(lengths)
    if lengths[0] > most:  # the rarest come first and are deepest
        lengths = [min(x, most) for x in lengths]
        room = (1 << most) - sum(1 << (most - x) for x in lengths)
        i = n - 1
        while room < 0:
            i = max((k for k in range(n) if lengths[k] < most), key=lambda k: lengths[k])
            room += 1 << (most - lengths[i] - 1)
            lengths[i] += 1
        while room > 0:
            i = max((k for k in range(n) if 1 << (most - lengths[k]) <= room), key=lambda k: weight[k])
            room -= 1 << (most - lengths[i])
            lengths[i] -= 1
    return lengths


def all_code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """``code_lengths`` of each row, all rows joined together step by step."""
    rows, far = len(counts), np.int64(1) << 60
    n = (counts > 0).sum(1)
    out = (counts > 0).astype(np.int64)
    order = np.argsort(np.where(counts > 0, counts, far), 1, kind="stable")[:, : max(2, int(n.max()))]
    width = order.shape[1]
    sorted_counts = np.take_along_axis(counts, order, 1)
    # By row, leaves and then joined nodes; rows that are done go on with what weighs too much to matter.
    span = 4 * width
    weight = np.full((rows, span), far)
    weight[:, :width] = np.where(sorted_counts > 0, sorted_counts, far)
    flat, nodes = weight.reshape(-1), 2 * width
    leaf = np.arange(rows) * span
    node = leaf + nodes
    both = leaf + node
    first = np.empty((2 * width - 2, rows), bool)
    for new in range(width - 1):
        own, other = flat[leaf], flat[node]
        np.less_equal(own, other, out=first[2 * new])
        total = np.minimum(own, other)
        leaf += first[2 * new]
        both += 1
        np.subtract(both, leaf, out=node)
        own, other = flat[leaf], flat[node]
        np.less_equal(own, other, out=first[2 * new + 1])
        total += np.minimum(own, other)
        leaf += first[2 * new + 1]
        both += 1
        np.subtract(both, leaf, out=node)
        weight[:, nodes + new] = total
    # The picks 2k and 2k + 1 are joined as node k.
    first, pick = first.T, np.arange(2 * width - 2)
    used, each = pick < 2 * n[:, None] - 2, np.arange(width)
    joins = np.where(n > 1, n - 2, 0)[:, None]
    parent = np.repeat(joins, width, 1)  # the root is its own
    parent[each < joins] = np.nonzero(~first & used)[1] >> 1
    depth = (each < joins).astype(np.int64)
    while (parent < joins).any():
        depth += np.take_along_axis(depth, parent, 1)
        parent = np.take_along_axis(parent, parent, 1)
    mine = (each < n[:, None]) & (n[:, None] > 1)
    above = np.zeros((rows, width), np.int64)
    above[mine] = np.nonzero(first & used)[1] >> 1
    found = np.take_along_axis(depth, above, 1) + 1
    for k in np.flatnonzero(n > 1).tolist():
        size = found[k, : n[k]]
        out[k, order[k, : n[k]]] = size if size[0] <= most else _limited(size.tolist(), sorted_counts[k, : n[k]].tolist(), most)
    return out


# ---------------------------------------------------------------- decoding


class Code:
    """A prefix code as a table over the next ``width`` bits."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths = lengths
        used = {s: n for s, n in lengths.items() if n}
        if not used:
            raise ValueError("a prefix code without symbols")
        self.used, self.single = used, next(iter(used)) if len(used) == 1 else None
        if self.single is None:
            self.width, self.tables = max(used.values()), {}
            if sum(map((1 << 15).__rshift__, used.values())) != 1 << 15:
                raise ValueError("a prefix code that is not complete")

    @functools.cached_property
    def table(self) -> list[tuple[int, int]]:
        """(symbol, length) by the next ``width`` bits."""
        out, start = [(0, 0)] * (1 << self.width), 0
        for n, symbol in sorted([(n, s) for s, n in self.used.items()]):
            out[reverse(start >> (15 - n), n) :: 1 << n] = [(symbol, n)] * (1 << (self.width - n))
            start += 1 << (15 - n)
        return out

    def entries(self, width: int) -> np.ndarray:
        """symbol << 4 | length by the next ``width`` bits; a single symbol takes none."""
        if self.single is not None:
            return np.full(1 << width, self.single << 4, np.uint16)
        if width not in self.tables:
            entry = np.array(sorted([n << 16 | s for s, n in self.used.items()]))
            bits = entry >> 16
            self.tables[width] = np.repeat(((entry & 0xFFFF) << 4 | bits).astype(np.uint16), 1 << (width - bits))[turned(width)]
        return self.tables[width]

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        at = bits.at
        symbol, n = self.table[(int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)) & ((1 << self.width) - 1)]
        bits.at = at + n
        return symbol


def tables(codes: list[Code]) -> np.ndarray:
    """``entries`` of MOST_BITS of each code, all codes together."""
    lengths = np.full((len(codes), 1 + max(max(c.used) for c in codes)), 16, np.uint8)
    for row, c in zip(lengths, codes):
        row[list(c.used)] = list(c.used.values()) if c.single is None else 0
    order = np.argsort(lengths, 1, kind="stable")
    bits = np.take_along_axis(lengths, order, 1).astype(np.int64)
    room = np.where(bits < 16, 1 << np.maximum(MOST_BITS - bits, 0), 0)
    return np.repeat((order << 4 | bits).astype(np.uint16).reshape(-1), room.reshape(-1)).reshape(len(codes), -1)[:, turned(MOST_BITS)]


def read_lengths(bits: Bits, size: int) -> dict[int, int]:
    head = bits.read(4)
    if head & 1:
        lengths = {head >> 3 | bits.read(7) << 1 if head & 4 else head >> 3: 1}
        if head & 2:
            lengths[bits.read(8)] = 1
        return lengths
    n = 4 + (head >> 1 | bits.read(1) << 3)
    sizes = bits.read(3 * n)
    inner = Code({CODE_LENGTH_ORDER[k]: sizes >> 3 * k & 7 for k in range(n)})
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths: dict[int, int] = {}
    symbol, previous = 0, 8
    table, mask = (inner.table, (1 << inner.width) - 1) if inner.single is None else ([(inner.single, 0)], 0)
    at = bits.at
    ahead, held = 0, 0  # the next bits, and their number
    while symbol < size and left:
        left -= 1
        if held < 14:
            ahead = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 24], "little") >> (at & 7)
            held = 185
        x, n = table[ahead & mask]
        ahead >>= n
        if x < 16:
            if x:
                lengths[symbol] = previous = x
            symbol += 1
        elif x == 16:
            for _ in range(3 + (ahead & 3)):
                lengths[symbol] = previous
                symbol += 1
            ahead, n = ahead >> 2, n + 2
        elif x == 17:
            symbol += 3 + (ahead & 7)
            ahead, n = ahead >> 3, n + 3
        else:
            symbol += 11 + (ahead & 127)
            ahead, n = ahead >> 7, n + 7
        at, held = at + n, held - n
    bits.at = at
    if symbol > size:
        raise ValueError("more code lengths than symbols")
    return lengths


def read_group(bits: Bits, cache_bits: int) -> list[Code]:
    sizes = (256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    return [Code(read_lengths(bits, size)) for size in sizes]


def prefixed(bits: Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _prefixes() -> tuple[np.ndarray, np.ndarray]:
    """Extra bits and least value of each prefix code."""
    extra = np.array([max(0, (k - 2) >> 1) for k in range(DISTANCE_CODES)])
    least = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(DISTANCE_CODES)])
    return extra, least


EXTRA, LEAST_OF = _prefixes()
#: The last distance code whose extra bits are read at once.
MOST_FAR = int(np.flatnonzero(EXTRA <= 17)[-1])
#: Bits that a green symbol (128 more for a copy) or a distance takes with its extra bits, by its entry in the table of its code.
_ENTRY = np.arange(1 << 13)
STEP_OF = ((_ENTRY & 15) + np.where(_ENTRY >> 4 >= 256, 128 + EXTRA[np.clip((_ENTRY >> 4) - 256, 0, LENGTH_CODES - 1)], 0)).astype(np.uint8)
FAR_STEP_OF = ((_ENTRY & 15) + EXTRA[np.minimum(_ENTRY >> 4, DISTANCE_CODES - 1)]).astype(np.uint8)


def read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Pixels of an entropy-coded image (flat, ARGB)."""
    cache_bits, groups, meta, step = read_image_head(bits, width, height, top)
    return read_pixels(bits, width, height, cache_bits, groups, meta, step)


def read_image_head(bits: Bits, width: int, height: int, top: bool):
    cached = bits.read(1)
    cache_bits = bits.read(4) if cached else 0
    if cache_bits > 11 or cached and not cache_bits:
        raise ValueError("a colour cache of 0 or more than 11 bits")
    meta, step, count = None, 0, 1
    if top and bits.read(1):
        step = bits.read(3) + 2
        meta_width = (width + (1 << step) - 1) >> step
        meta_height = (height + (1 << step) - 1) >> step
        meta = ((read_image(bits, meta_width, meta_height, False) >> 8) & 0xFFFF).reshape(meta_height, meta_width)
        count = int(meta.max()) + 1
    return cache_bits, [read_group(bits, cache_bits) for _ in range(count)], meta, step


def read_pixels(bits: Bits, width: int, height: int, cache_bits: int, groups: list[list[Code]], meta, step: int) -> np.ndarray:
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    cached = 0  # pixels before this one are in the cache
    at = 0
    group = groups[0]
    while at < total:
        if meta is not None:
            group = groups[meta[(at // width) >> step, (at % width) >> step]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 256 + LENGTH_CODES:
            length = prefixed(bits, s - 256)
            far = prefixed(bits, group[4].read(bits))
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + length > total:
                raise ValueError("a back-reference outside the image")
            if far >= length:
                out[at : at + length] = out[at - far : at - far + length]
            else:
                unit = out[at - far : at]
                out[at : at + length] = (unit * (length // far + 1))[:length]
            at += length
        else:
            if cache is None:
                raise ValueError("a cache code without a cache")
            while cached < at:
                cache[(CACHE_MULTIPLIER * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[at] = cache[s - 256 - LENGTH_CODES]
            at += 1
    return np.array(out, np.uint32)


def channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) as alpha, red, green, blue."""
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left, top, top_right, top_left):
    """The prediction for one pixel, of sequences of four channels."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda v: [min(255, max(0, x)) for x in v]
    if mode == 0:
        return (255, 0, 0, 0)
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left))
        return left if to_left < to_top else top
    if mode == 12:
        return clamp([x + t - c for x, t, c in zip(left, top, top_left)])
    if mode == 13:
        return clamp([m + int((m - c) / 2) for m, c in zip(half(left, top), top_left)])
    return (255, 0, 0, 0)


def _around(rows: list, x: int, y: int, width: int, mode: int):
    """The prediction at (x, y); rows holds the pixels of the image so far."""
    if y == 0:
        return rows[0][x - 1] if x else (255, 0, 0, 0)
    above = rows[y - 1]
    if x == 0:
        return above[0]
    corner = above[x + 1] if x + 1 < width else rows[y][0]
    return predict(mode, rows[y][x - 1], above[x], corner, above[x - 1])


def _above(mode: int, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The predictions for whole rows (bytes) by a mode that looks at the row above only."""
    half = lambda a, b: ((a.astype(np.uint16) + b) >> 1).astype(np.uint8)
    return {2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 8: lambda: half(top_left, top), 9: lambda: half(top, top_right)}[mode]()


def _undo_from_above(residual: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """residual (height, width, 4) -> pixels, row by row; bytes wrap around."""
    out = np.empty_like(residual)
    first = residual[0].astype(np.int64)
    first[0, 0] += 255
    out[0] = np.cumsum(first, 0).astype(np.uint8)
    for y in range(1, len(out)):
        top = out[y - 1]
        out[y, 0] = residual[y, 0] + top[0]
        right, left = np.concatenate([top[1:], out[y, :1]]), np.concatenate([top[:1], top[:-1]])
        row = modes[y >> bits]
        used = np.unique(row).tolist()
        guess = _above(used[0], top, right, left).copy()
        for mode in used[1:]:
            here = np.repeat(row == mode, 1 << bits)[: len(top)]
            guess[here] = _above(mode, top, right, left)[here]
        out[y, 1:] = residual[y, 1:] + guess[1:]
    return out


def residuals(pixels: np.ndarray, mode: int) -> np.ndarray:
    """What one mode leaves of pixels (height, width, channels), of which the first is alpha; not taken modulo 256."""
    flat = pixels.reshape(-1, pixels.shape[-1])
    width = pixels.shape[1]
    before = lambda n: np.concatenate([np.zeros_like(flat[:n]), flat])[: len(flat)]
    left, top, right, corner = before(1), before(width), before(width - 1) if width > 1 else flat, before(width + 1)
    half = lambda a, b: (a + b) >> 1
    away = lambda a, b: np.abs(a - b).sum(-1, keepdims=True)
    black = np.array([255] + [0] * (flat.shape[1] - 1), flat.dtype)
    guess = {
        1: lambda: left,
        2: lambda: top,
        3: lambda: right,
        4: lambda: corner,
        5: lambda: half(half(left, right), top),
        6: lambda: half(left, corner),
        7: lambda: half(left, top),
        8: lambda: half(corner, top),
        9: lambda: half(top, right),
        10: lambda: half(half(left, corner), half(top, right)),
        11: lambda: np.where(away(top, corner) < away(left, corner), left, top),
        12: lambda: np.clip(left + top - corner, 0, 255),
        13: lambda: np.clip(half(left, top) + ((d := half(left, top) - corner) + (d < 0) >> 1), 0, 255),
    }.get(mode, lambda: np.broadcast_to(black, flat.shape))()
    out = (flat - guess).reshape(pixels.shape)
    out[1:, 0] = pixels[1:, 0] - pixels[:-1, 0]
    out[0, 1:] = pixels[0, 1:] - pixels[0, :-1]
    out[0, 0] = pixels[0, 0] - black
    return out


def undo_predictor(argb: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    if np.isin(modes & 15, FROM_ABOVE).all():
        residual = argb.reshape(height, width).astype(">u4").view(np.uint8).reshape(height, width, 4)
        return _undo_from_above(residual, modes & 15, bits).view(">u4").astype(np.uint32).reshape(-1)
    residual = channels(argb.reshape(height, width)).tolist()
    rows: list = []
    for y in range(height):
        rows.append([])
        for x in range(width):
            p = _around(rows, x, y, width, int(modes[y >> bits, x >> bits]) & 15)
            rows[y].append([(a + b) & 255 for a, b in zip(residual[y][x], p)])
    return joined(np.array(rows)).reshape(-1)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x + 128) & 255) - 128


def _spread(tiles: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    return np.repeat(np.repeat(tiles, 1 << bits, 0), 1 << bits, 1)[:height, :width]


def cross_color(argb: np.ndarray, width: int, height: int, tiles: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """tiles: ARGB elements that hold red_to_blue, green_to_blue and green_to_red."""
    c, t = channels(argb.reshape(height, width)), channels(_spread(tiles, width, height, bits))
    delta = lambda a, b: (_signed(a) * _signed(b)) >> 5
    sign = 1 if undo else -1
    red = c[..., 1] + sign * delta(t[..., 3], c[..., 2])
    original = red & 255 if undo else c[..., 1]
    blue = c[..., 3] + sign * (delta(t[..., 2], c[..., 2]) + delta(t[..., 1], original))
    return joined(np.stack([c[..., 0], red, c[..., 2], blue], -1)).reshape(-1)


def subtract_green(argb: np.ndarray, undo: bool) -> np.ndarray:
    c = channels(argb)
    sign = 1 if undo else -1
    c[..., 1] += sign * c[..., 2]
    c[..., 3] += sign * c[..., 2]
    return joined(c)


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def undo_palette(argb: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    b = palette_bits(len(palette))
    green = ((argb >> 8) & 255).reshape(height, -1)
    if b:
        per, depth = 1 << b, 8 >> b
        green = ((green[:, :, None] >> (depth * np.arange(per))) & ((1 << depth) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[green].reshape(-1)


class Header:
    """What stands before the pixel data: size, transforms, prefix codes."""

    def __init__(self, data: bytes):
        bits = Bits(data)
        if bits.read(8) != 0x2F:
            raise ValueError("not a lossless WebP stream")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("an unknown version")
        self.transforms, self.coded_width, self.bits = [], self.width, bits
        while bits.read(1):
            kind = bits.read(2)
            if kind in (PREDICTOR, CROSS_COLOR):
                b = bits.read(3) + 2
                w, h = (self.coded_width + (1 << b) - 1) >> b, (self.height + (1 << b) - 1) >> b
                tiles = read_image(bits, w, h, False).reshape(h, w)
                self.transforms.append((kind, self.coded_width, (tiles, b)))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind, self.coded_width, None))
            else:
                n = bits.read(8) + 1
                steps = channels(read_image(bits, n, 1, False))
                self.transforms.append((kind, self.coded_width, joined(np.cumsum(steps, 0) & 255)))
                b = palette_bits(n)
                self.coded_width = (self.coded_width + (1 << b) - 1) >> b
        self.cache_bits, self.groups, self.meta, self.step = read_image_head(bits, self.coded_width, self.height, True)

    def plain(self) -> bool:
        """Whether the data are symbols of a green code of at most MOST_BITS only, none a back-reference, in images of one other
        colour."""
        if self.meta is not None:
            return False
        green, *rest = self.groups[0]
        if any(c.single is None for c in rest[:3]) or any(256 <= s < 256 + LENGTH_CODES for s in green.lengths):
            return False
        return green.single < 256 if green.single is not None else green.width <= MOST_BITS

    def referenced(self) -> bool:
        """Whether the data are literals and back-references of one green code, in images of one other colour without a cache."""
        if self.meta is not None or self.cache_bits or any(c.single is None for c in self.groups[0][1:4]):
            return False
        green, far = self.groups[0][0], self.groups[0][4]
        return green.single is None and green.width <= MOST_BITS and (far.single is not None or far.width <= MOST_BITS) and max(far.used) <= MOST_FAR

    def base(self) -> int:
        """The pixel of a plain image whose green is 0."""
        red, blue, alpha = (c.single for c in self.groups[0][1:4])
        return alpha << 24 | red << 16 | blue

    def finish(self, argb: np.ndarray) -> np.ndarray:
        for kind, width, more in reversed(self.transforms):
            if kind == PREDICTOR:
                argb = undo_predictor(argb, width, self.height, (more[0] >> 8) & 255, more[1])
            elif kind == CROSS_COLOR:
                argb = cross_color(argb, width, self.height, more[0], more[1], True)
            elif kind == SUBTRACT_GREEN:
                argb = subtract_green(argb, True)
            else:
                argb = undo_palette(argb, width, self.height, more)
        return argb.reshape(self.height, self.width)


def chunks_of(data: bytes, at: int, end: int) -> list[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks of a RIFF list."""
    out = []
    while at + 8 <= end:
        n = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > end:
            raise ValueError("a chunk that is cut off")
        out.append((data[at : at + 4], at + 8, at + 8 + n))
        at += 8 + n + (n & 1)
    return out


def tiles(data: bytes) -> tuple[int, int, list[tuple[int, int, bytes]]]:
    """The canvas (width, height) of a lossless WebP file and the tiles (x, y, VP8L stream) on it: one image, or the frames of an
    animation."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or len(data) < 8 + struct.unpack_from("<I", data, 4)[0]:
        raise ValueError("not a WebP file")
    number = lambda at: int.from_bytes(data[at : at + 3], "little")
    size, out = None, []
    for name, a, b in chunks_of(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        if name == b"VP8X":
            size = number(a + 4) + 1, number(a + 7) + 1
        elif name == b"VP8L":
            out.append((0, 0, data[a:b]))
        elif name == b"ANMF":
            inner = [data[c:d] for kind, c, d in chunks_of(data, a + 16, b) if kind == b"VP8L"]
            if len(inner) != 1:
                raise ValueError("a frame that is not lossless")
            out.append((2 * number(a), 2 * number(a + 3), inner[0]))
    if not out:
        raise ValueError("no lossless image")
    head = int.from_bytes(out[0][2][1:5], "little")
    width, height = size or ((head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1)
    return width, height, out


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width) of a file as ARGB; of an animation, the canvas with all frames laid on it."""
    width, height, parts = tiles(data)
    images = decode_streams([p[2] for p in parts])
    if len(parts) == 1 and images[0].shape == (height, width):
        return images[0]
    canvas = np.zeros((height, width), np.uint32)
    for (x, y, _), image in zip(parts, images):
        if y + image.shape[0] > height or x + image.shape[1] > width:
            raise ValueError("a frame outside the canvas")
        canvas[y : y + image.shape[0], x : x + image.shape[1]] = image
    return canvas


def _lockstep(heads: list[Header]) -> list[np.ndarray | None]:
    """Green samples of plain images, all advancing together, longest first; None for those that take an empty place of their
    colour cache, which holds another colour than theirs."""
    out: list = [None] * len(heads)
    for cached in (False, True):
        mine = [k for k, h in enumerate(heads) if bool(h.cache_bits) == cached]
        for k, green in zip(mine, _greens([heads[k] for k in mine], cached)):
            out[k] = green
    return out


def _greens(heads: list[Header], cached: bool) -> list[np.ndarray | None]:
    out: list = [None] * len(heads)
    sizes = np.array([h.coded_width * h.height for h in heads], np.int64)
    order = np.argsort(-sizes, kind="stable")
    # A step costs the same for one image as for many, so the longest are read alone where that is less work.
    alone = np.concatenate([[0], np.cumsum(sizes[order])]) + STEP_SYMBOLS * np.concatenate([sizes[order], [0]])
    done = int(alone.argmin())
    for i in order[:done]:
        out[i] = _green_alone(heads[i])
    while done < len(order):
        n = max(1, min(len(order) - done, 4096, (24 << 20) // int(sizes[order[done]])))
        mine = order[done : done + n]
        done += n
        tables = np.zeros((n, 1 << MOST_BITS), np.uint16)
        data, starts, offset = [], np.zeros(n, np.int64), 0
        for k, i in enumerate(mine):
            head = heads[i]
            tables[k] = head.groups[0][0].entries(MOST_BITS)
            data.append(head.bits.data)
            starts[k] = 8 * offset + head.bits.at
            offset += len(head.bits.data)
        window = numbers_at(np.frombuffer(b"".join([*data, bytes(5)]), np.uint8), "<u4")
        flat, base, at = tables.reshape(-1), np.arange(n) << MOST_BITS, starts
        longest = int(sizes[mine[0]])
        symbols = np.zeros((longest, n), np.uint8)
        ends = np.searchsorted(-sizes[mine], -np.arange(longest), side="left")  # images that still have a symbol at each step
        if cached:
            caches, lanes, strange = np.full((n, 1 << max(heads[i].cache_bits for i in mine)), -1, np.int16), np.arange(n), np.zeros(n, bool)
            places = np.stack([cache_places(heads[i].base(), heads[i].cache_bits) for i in mine])
        live = n
        for step, now in enumerate(ends.tolist()):
            if now != live:
                live, at, base = now, at[:now], base[:now]
            code = window[at >> 3] >> (at & 7).astype(np.uint32)
            entry = flat[base + (code & ((1 << MOST_BITS) - 1))]
            at = at + (entry & 15)
            if cached:
                value = (entry >> 4).astype(np.int64)
                from_cache = np.flatnonzero(value >= 256)
                value[from_cache] = caches[from_cache, value[from_cache] - 256 - LENGTH_CODES]
                if value.min() < 0:
                    strange[:live] |= value < 0
                    value = np.maximum(value, 0)
                caches[lanes[:live], places[lanes[:live], value]] = value
                symbols[step, :live] = value
            else:
                symbols[step, :live] = entry >> 4
        by_image = np.ascontiguousarray(symbols.T)
        for k, i in enumerate(mine):
            if not (cached and strange[k]):
                out[i] = by_image[k, : sizes[i]]
    return out


def _green_alone(head: Header) -> np.ndarray | None:
    """The green samples of one plain image, symbol by symbol."""
    green, total = head.groups[0][0], head.coded_width * head.height
    if green.single is not None:
        return np.full(total, green.single, np.uint8)
    table, mask, data, at = green.table, (1 << green.width) - 1, head.bits.data + b"\0\0\0", head.bits.at
    read, out = int.from_bytes, bytearray(total)
    if not head.cache_bits:
        for k in range(total):
            first = at >> 3
            out[k], n = table[(read(data[first : first + 3], "little") >> (at & 7)) & mask]
            at += n
        return np.frombuffer(out, np.uint8)
    cache, places, offset = [-1] * (1 << head.cache_bits), cache_places(head.base(), head.cache_bits).tolist(), 256 + LENGTH_CODES
    for k in range(total):
        first = at >> 3
        s, n = table[(read(data[first : first + 3], "little") >> (at & 7)) & mask]
        at += n
        if s >= 256:
            s = cache[s - offset]
            if s < 0:
                return None
        out[k] = s
        cache[places[s]] = s
    return np.frombuffer(out, np.uint8)


def _with_references(heads: list[Header]) -> list[np.ndarray]:
    """Green samples of referenced images, a bounded number of bytes at a time: copies are followed to literals at the end."""
    out, at = [], 0
    while at < len(heads):
        first, data, total = at, 0, 0
        while at < len(heads) and (at == first or data < TOKEN_BYTES and total < 1 << 20):
            data, total = data + len(heads[at].bits.data), total + heads[at].coded_width * heads[at].height
            at += 1
        mine = heads[first:at]
        ends = np.cumsum([h.coded_width * h.height for h in mine])
        green = _follow(*_tokens(mine, ends), int(ends[-1]))
        out += np.split(green, ends[:-1])
    return out


def _tokens(heads: list[Header], ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places and values of all literals; places, lengths and distances of all copies. Places count over all images, whose
    last ones are before ``ends``. The bits that a symbol takes are looked up for every bit as if one began there, so that only
    the walk from symbol to symbol is one after another."""
    datas = [h.bits.data for h in heads]
    starts = np.cumsum([0] + [len(d) for d in datas])
    window = numbers_at(np.frombuffer(b"".join([*datas, bytes(8)]), np.uint8), "<u4")
    code = ((window.astype(np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64((1 << MOST_BITS) - 1)).reshape(-1).view(np.int64)
    greens, fars = (tables([h.groups[0][k] for h in heads]).reshape(-1) for k in (0, 4))
    steps = STEP_OF[greens] | FAR_STEP_OF[fars].astype(np.uint16) << 8
    both = np.zeros(len(code), "<u2")
    for k, (a, b) in enumerate(zip(8 * starts, 8 * starts[1:])):
        np.take(steps[k << MOST_BITS : (k + 1) << MOST_BITS], code[a:b], out=both[a:b], mode="clip")
    step, far_step = both.view(np.uint8)[::2] & 127, both.view(np.uint8)[1::2]
    copy = np.flatnonzero((both & 128).astype(bool))
    step[copy] += far_step[np.minimum(copy + step[copy], len(code) - 1)]
    # One way through all streams: from the end of one to its successor's first symbol, which its first bit never is.
    end = 8 * int(starts[-1])
    onward = np.arange(end) + step[:end]
    for h, a, b in zip(heads, (8 * starts).tolist(), (8 * starts[1:]).tolist()):
        tail = onward[max(a, b - 64) : b]
        np.minimum(tail, b, out=tail)
        onward[a] = min(a + h.bits.at, b)
    at = walked(onward)
    at = np.delete(at, np.searchsorted(at, 8 * starts[:-1]))
    counts = np.diff(np.searchsorted(at, 8 * starts))
    image = np.repeat(np.arange(len(heads)), counts)
    peek = lambda at: window[np.minimum(at >> 3, len(window) - 1)] >> (at & 7).astype(np.uint32)
    entry = greens[(image << MOST_BITS) + code[at]]
    symbol = (entry >> 4).astype(np.int64)
    length = np.ones(len(at), np.int64)
    c = np.flatnonzero(symbol >= 256)
    kind, now = symbol[c] - 256, at[c] + (entry[c] & 15)
    length[c] = LEAST_OF[kind] + (peek(now) & ((1 << EXTRA[kind]) - 1))
    now = np.minimum(now + EXTRA[kind], len(code) - 1)
    entry = fars[(image[c] << MOST_BITS) + code[now]]
    kind, now = (entry >> 4).astype(np.int64), now + (entry & 15)
    far = LEAST_OF[kind] + (peek(now) & ((1 << EXTRA[kind]) - 1))
    near = {w: np.array([0, *(max(1, x + y * w) for x, y in NEAR)]) for w in {h.coded_width for h in heads}}
    near = np.stack([near[h.coded_width] for h in heads])
    far = np.where(far > 120, far - 120, near[image[c], np.minimum(far, 120)])
    # The bits that fill the last byte may look like symbols.
    begins = np.cumsum([0, *counts])[:-1]
    run = np.cumsum(length) - length
    place = run - np.repeat(run[begins], counts)
    first = np.concatenate([[0], ends[:-1]])
    size = (ends - first)[image]
    used = place < size
    last = np.flatnonzero(used & (place + length >= size))
    if len(last) < len(heads) or (used & (place + length > size)).any() or (far > place[c])[used[c]].any():
        raise ValueError("a back-reference outside the image, or an image cut off")
    place = place + first[image]
    literal, c, far = used & (symbol < 256), c[used[c]], far[used[c]]
    return place[literal], symbol[literal].astype(np.uint8), place[c], length[c], far


def _follow(where: np.ndarray, what: np.ndarray, first: np.ndarray, length: np.ndarray, far: np.ndarray, total: int) -> np.ndarray:
    """Samples of literals and copies: every copied place is taken back along the copies until it is a literal."""
    out = np.zeros(total, np.uint8)
    out[where] = what
    copied = np.repeat((first - np.cumsum(length) + length).astype(np.int32), length) + np.arange(int(length.sum()), dtype=np.int32)
    source = np.arange(total, dtype=np.int32)
    source[copied] = copied - np.repeat(far.astype(np.int32), length)
    left = copied
    while len(left):
        now = source[left]
        further = source[now]
        source[left] = further
        left = left[now != further]
    out[copied] = out[source[copied]]
    return out


def cache_places(base: int, cache_bits: int) -> np.ndarray:
    """The place in the colour cache of each green sample on top of ``base``."""
    pixels = np.uint64(base) | np.arange(256, dtype=np.uint64) << np.uint64(8)
    return ((pixels * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """Pixels (height, width) of many VP8L streams."""
    keep_freed()
    heads = [Header(p) for p in streams]
    plain = [h.plain() for h in heads]
    referenced = [not p and h.referenced() for h, p in zip(heads, plain)]
    greens = iter(_lockstep([h for h, p in zip(heads, plain) if p]))
    copies = iter(_with_references([h for h, r in zip(heads, referenced) if r]))
    out = []
    for h, p, r in zip(heads, plain, referenced):
        green = next(greens) if p else next(copies) if r else None
        if green is None:
            out.append(h.finish(read_pixels(h.bits, h.coded_width, h.height, h.cache_bits, h.groups, h.meta, h.step)))
            continue
        green = green.astype(np.uint32)
        if [t[0] for t in h.transforms] == [SUBTRACT_GREEN] and not h.base() & 0xFFFFFF:
            out.append((green * 0x010101 | h.base()).reshape(h.height, h.width))
        else:
            out.append(h.finish(green << 8 | h.base()))
    return out


# ---------------------------------------------------------------- encoding


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix code, extra bits, their value) of a length or distance from 1 on."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 1
    half = (v >> (n - 1)) & 1
    return 2 * n + half, n - 1, v & ((1 << (n - 1)) - 1)


def write_lengths(sink: Sink, lengths: np.ndarray) -> None:
    """A prefix code: simple where it has one or two symbols of 8 bits, else by lengths, runs of zeros folded."""
    tokens = length_tokens(lengths)
    inner = paired(code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)[None]) if tokens else lengths[None]
    sink.put(*length_bits(lengths, tokens, inner[0], reversed_codes(inner)[0]))


def paired(lengths: np.ndarray) -> np.ndarray:
    """Codes (rows) of lengths with a second symbol where one has a single symbol."""
    alone = np.flatnonzero((lengths > 0).sum(1) == 1)
    lengths[alone, np.where(lengths[alone, 0] > 0, 1, 0)] = 1
    return lengths


def length_tokens(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, extra bits, their value) of the lengths of a code; none for a simple one."""
    used = np.flatnonzero(lengths)
    values, used = lengths[used].tolist(), used.tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        return []
    tokens, at = [], 0
    for s, length in zip(used, values):
        gap = s - at
        while gap:
            if gap < 3:
                run, token = 1, (0, 0, 0)
            elif gap <= 10:
                run, token = gap, (17, 3, gap - 3)
            else:
                run = min(gap, 138)
                token = (18, 7, run - 11)
            tokens.append(token)
            gap -= run
        tokens.append((length, 0, 0))
        at = s + 1
    return tokens


def length_bits(lengths: np.ndarray, tokens: list[tuple[int, int, int]], inner: np.ndarray, codes: np.ndarray) -> tuple[int, int]:
    """The bits of a prefix code, and their number; ``inner`` and ``codes``: lengths and codes of its tokens."""
    if not tokens:
        used = np.flatnonzero(lengths).tolist()
        first = used[0] if used else 0
        value, at = 1 | (len(used) == 2) << 1 | (first > 1) << 2 | first << 3, 11 if first > 1 else 4
        return (value | used[1] << at, at + 8) if len(used) == 2 else (value, at)
    codes, inner = codes.tolist(), inner.tolist()
    n = max(4, max(k for k in range(19) if inner[CODE_LENGTH_ORDER[k]]) + 1)
    value, at = (n - 4) << 1, 5
    for k in range(n):
        value |= inner[CODE_LENGTH_ORDER[k]] << at
        at += 3
    wide = max(0, ((len(tokens) - 2).bit_length() - 1) // 2)
    value |= (1 | wide << 1 | (len(tokens) - 2) << 4) << at
    at += 6 + 2 * wide
    for symbol, extra, rest in tokens:
        n = inner[symbol]
        value |= (codes[symbol] | rest << n) << at
        at += n + extra
    return value, at


def matches(pixels: list[int], least: int = 4, most: int = 4096) -> list[tuple]:
    """Greedy back-references over the pixels: ("copy", length, distance) and ("pixel", value)."""
    out, seen, at, n = [], {}, 0, len(pixels)
    while at < n:
        key = tuple(pixels[at : at + least])
        back = seen.get(key) if len(key) == least else None
        if back is None:
            seen[key] = at
            out.append(("pixel", pixels[at]))
            at += 1
            continue
        length = least
        top = min(most, n - at)
        while length < top and pixels[back + length] == pixels[at + length]:
            length += 1
        out.append(("copy", length, at - back))
        seen[key] = at
        at += length
    return out


def write_image(
    sink: Sink, argb: np.ndarray, width: int, height: int, top: bool, cache_bits: int = 0, match: bool | list[tuple] = False, meta_bits: int = 0, meta: np.ndarray | None = None
) -> None:
    """An entropy-coded image, with back-references as given or found by ``matches``, or without. With ``meta_bits`` (top image
    only) tiles have the groups of codes that ``meta`` gives, or alternate between two."""
    pixels = argb.reshape(-1).tolist()
    tokens = match if isinstance(match, list) else matches(pixels) if match else [("pixel", p) for p in pixels]
    near = {}
    for code, (x, y) in enumerate(NEAR):
        near.setdefault(max(1, x + y * width), code + 1)
    cache, shift = {}, 32 - cache_bits
    coded, at = [], 0
    for t in tokens:
        if t[0] == "pixel":
            place = (CACHE_MULTIPLIER * t[1] & 0xFFFFFFFF) >> shift if cache_bits else 0
            if cache_bits and cache.get(place) == t[1]:
                coded.append((at, [(0, 256 + LENGTH_CODES + place, 0, 0)]))
            else:
                p = t[1]
                coded.append((at, [(0, (p >> 8) & 255, 0, 0), (1, (p >> 16) & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]))
            n = 1
        else:
            n = t[1]
            a, b = prefix_of(n), prefix_of(near.get(t[2], t[2] + 120))
            coded.append((at, [(0, 256 + a[0], a[1], a[2]), (4, b[0], b[1], b[2])]))
        if cache_bits:
            for p in pixels[at : at + n]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
        at += n
    sink.put(bool(cache_bits), 1)
    if cache_bits:
        sink.put(cache_bits, 4)
    groups = 1
    which = lambda at: 0
    if top:
        sink.put(bool(meta_bits), 1)
        if meta_bits:
            sink.put(meta_bits - 2, 3)
            w, h = (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits
            tiles = (np.add.outer(np.arange(h), np.arange(w)) % 2 if meta is None else meta).astype(np.uint32)
            groups = int(tiles.max()) + 1
            write_image(sink, tiles << 8 | 0xFF000000, w, h, False)
            which = lambda at: int(tiles[(at // width) >> meta_bits, (at % width) >> meta_bits])
    sizes = (256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(groups)]
    for at, symbols in coded:
        g = counts[which(at)]
        for kind, s, _, _ in symbols:
            g[kind][s] += 1
    codes = []
    for g in counts:
        codes.append([])
        for c in g:
            lengths = code_lengths(c)
            write_lengths(sink, lengths)
            codes[-1].append({s: (0, 0) for s in np.flatnonzero(c).tolist()} if np.count_nonzero(c) < 2 else canonical(lengths))
    for at, symbols in coded:
        g = codes[which(at)]
        for kind, s, extra, value in symbols:
            sink.put(*g[kind][s])
            if extra:
                sink.put(value, extra)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def wrap(data: bytes) -> bytes:
    """A file of one VP8L stream."""
    body = b"WEBP" + _chunk(b"VP8L", data)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wrap_tiles(width: int, height: int, parts: list[tuple[int, int, bytes]]) -> bytes:
    """A file of tiles (x, y, VP8L stream) at even places of a canvas: frames without duration that are neither blended nor
    disposed of, played once."""
    number = lambda n: n.to_bytes(3, "little")
    body = [b"WEBP", _chunk(b"VP8X", b"\x02\0\0\0" + number(width - 1) + number(height - 1)), _chunk(b"ANIM", b"\0" * 4 + struct.pack("<H", 1))]
    for x, y, data in parts:
        size = int.from_bytes(data[1:5], "little")
        frame = number(x // 2) + number(y // 2) + number(size & 0x3FFF) + number(size >> 14 & 0x3FFF) + number(0) + b"\x02"
        body.append(_chunk(b"ANMF", frame + _chunk(b"VP8L", data)))
    body = b"".join(body)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _head(sink: Sink, width: int, height: int, alpha: bool) -> None:
    sink.put(0x2F, 8)
    sink.put(width - 1, 14)
    sink.put(height - 1, 14)
    sink.put(alpha, 1)
    sink.put(0, 3)


def encode(
    argb: np.ndarray,
    transforms: tuple = (),
    cache_bits: int = 0,
    match: bool | list[tuple] = True,
    meta_bits: int = 0,
    tile_bits: int = 3,
    seed: int = 0,
    meta: np.ndarray | None = None,
    modes: np.ndarray | None = None,
    multipliers: int | None = None,
) -> bytes:
    """The VP8L stream of pixels (height, width) in ARGB. Transforms are applied in the order given; predictor modes and colour
    multipliers of tiles are those given (multipliers: one element for all tiles), else go round from ``seed`` on."""
    height, width = argb.shape
    sink = Sink()
    _head(sink, width, height, bool((argb >> 24 != 255).any()))
    now, coded = argb.astype(np.uint32).reshape(-1), width
    for kind in transforms:
        sink.put(1, 1)
        sink.put(kind, 2)
        w, h = (coded + (1 << tile_bits) - 1) >> tile_bits, (height + (1 << tile_bits) - 1) >> tile_bits
        if kind == PREDICTOR:
            sink.put(tile_bits - 2, 3)
            modes = ((np.arange(w * h) + seed) % 14).reshape(h, w) if modes is None else modes
            write_image(sink, (modes << 8).astype(np.uint32) | 0xFF000000, w, h, False)
            pixels = channels(now.reshape(height, coded))
            each, found = _spread(modes, coded, height, tile_bits), np.empty_like(pixels)
            for mode in np.unique(modes).tolist():
                here = each == mode
                found[here] = residuals(pixels, mode)[here]
            now = joined(found).reshape(-1)
        elif kind == CROSS_COLOR:
            sink.put(tile_bits - 2, 3)
            k = np.arange(w * h) + seed
            tiles = (0xFF000000 | (k * 37 % 256) << 16 | (k * 91 % 256) << 8 | (k * 53 % 256)).astype(np.uint32).reshape(h, w)
            if multipliers is not None:
                tiles = np.full((h, w), multipliers, np.uint32)
            write_image(sink, tiles, w, h, False)
            now = cross_color(now, coded, height, tiles, tile_bits, False)
        elif kind == SUBTRACT_GREEN:
            now = subtract_green(now, False)
        else:
            palette, index = np.unique(now, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("more than 256 colours")
            sink.put(len(palette) - 1, 8)
            write_image(sink, joined(np.diff(channels(palette), axis=0, prepend=0)), len(palette), 1, False)
            b = palette_bits(len(palette))
            per, depth = 1 << b, 8 >> b
            grid = index.reshape(height, coded).astype(np.uint32)
            grid = np.pad(grid, ((0, 0), (0, -coded % per)))
            coded = grid.shape[1] >> b
            packed = (grid.reshape(height, coded, per) << (depth * np.arange(per, dtype=np.uint32))).sum(-1) if b else grid
            now = (packed.astype(np.uint32) << 8 | 0xFF000000).reshape(-1)
    sink.put(0, 1)
    write_image(sink, now, coded, height, True, cache_bits, match, meta_bits, meta)
    return sink.done()


def predicted(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of grey samples (bytes), and the mode of each tile: that of FROM_ABOVE whose residuals are least."""
    height, width = grid.shape
    across = grid - np.concatenate([[0], grid[0, :-1]]).astype(np.uint8)
    top = grid[:-1]
    right, left = np.concatenate([top[:, 1:], grid[1:, :1]], 1), np.concatenate([top[:, :1], top[:, :-1]], 1)
    found = np.stack([np.concatenate([across[:1], grid[1:] - _above(m, top, right, left)]) for m in FROM_ABOVE])
    found[:, 1:, 0] = grid[1:, 0] - grid[:-1, 0]
    cost = np.abs(found.view(np.int8).astype(np.int32))
    edge = 1 << TILE_BITS
    cost = np.add.reduceat(np.add.reduceat(cost, np.arange(0, height, edge), 1), np.arange(0, width, edge), 2)
    best = cost.argmin(0)
    pick = _spread(best, width, height, TILE_BITS)
    return np.take_along_axis(found, pick[None], 0)[0], np.array(FROM_ABOVE)[best]


@functools.lru_cache(4096)
def _tile_image(pixels: tuple[int, ...], width: int, height: int) -> tuple[int, int]:
    """The bits of a small image of tiles, and their number."""
    sink = Sink()
    write_image(sink, np.array(pixels, np.uint32), width, height, False)
    return int.from_bytes(sink.done(), "little"), sink.bits()


class Page:
    """Grey samples to be coded as symbols of one green code, and what their header says."""

    def __init__(self, samples: np.ndarray, kind: str):
        sink = Sink()
        height = len(samples) // ROW
        _head(sink, ROW, height, False)
        self.symbols, self.alpha, cache_bits = samples.astype(np.int64), 255, 0
        if kind == "predicted":
            # Cross-colour takes all of green off red and blue (multipliers of 32 / 32).
            residual, modes = predicted(samples.reshape(height, ROW))
            self.symbols, self.alpha = residual.reshape(-1).astype(np.int64), 0
            sink.put(1 | PREDICTOR << 1 | (TILE_BITS - 2) << 3, 6)
            sink.put(*_tile_image(tuple((modes.reshape(-1) << 8 | 0xFF000000).tolist()), modes.shape[1], modes.shape[0]))
            sink.put(1 | CROSS_COLOR << 1 | (ONE_TILE - 2) << 3, 6)
            sink.put(*_tile_image((0xFF002020,), 1, 1))
        else:
            sink.put(1 | SUBTRACT_GREEN << 1, 3)
            if kind == "cached":
                cache_bits = CACHE_BITS
                place = cache_places(0xFF000000, cache_bits)[self.symbols]
                order = np.argsort(place, kind="stable")
                # The cache holds the last sample of a place.
                same = (place[order][1:] == place[order][:-1]) & (self.symbols[order][1:] == self.symbols[order][:-1])
                hits = order[1:][same]
                self.symbols[hits] = 256 + LENGTH_CODES + place[hits]
        sink.put(0, 1)
        sink.put(bool(cache_bits), 1)
        if cache_bits:
            sink.put(cache_bits, 4)
        sink.put(0, 1)  # no meta codes
        self.sink, self.size = sink, 256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0)


#: Symbols that a page may have at most, as a power of two.
SYMBOL_BITS = 9


def encode_pages(pages: list[tuple[np.ndarray, str]]) -> list[bytes]:
    """VP8L streams of grey samples (a multiple of ROW each) by kind, the bits of all pages laid out together: plain, or in one of
    two fixed ways (predicted, cached) that choices are compared with."""
    n = len(pages)
    codes, lengths = np.zeros((n, 1 << SYMBOL_BITS), np.uint64), np.zeros((n, 1 << SYMBOL_BITS), np.uint64)
    heads, symbols = [], []
    for k, (samples, kind) in enumerate(pages):
        page = Page(samples, kind)
        sink = page.sink
        size = code_lengths(np.bincount(page.symbols, minlength=page.size), MOST_BITS)
        write_lengths(sink, size)
        sink.put(0b0001, 4)  # red and blue are 0 everywhere
        sink.put(0b0001, 4)
        if page.alpha:
            sink.put(0b101 | page.alpha << 3, 11)
        else:
            sink.put(0b0001, 4)
        sink.put(0b0001, 4)
        bits = sink.bits()
        heads.append((int.from_bytes(sink.done(), "little"), bits))
        symbols.append(page.symbols)
        if np.count_nonzero(size) > 1:
            codes[k, : len(size)], lengths[k, : len(size)] = reversed_codes(size), size
    sizes = np.array([len(x) for x in symbols])
    which = np.repeat(np.arange(n) << SYMBOL_BITS, sizes) + np.concatenate(symbols)
    c, n = codes.reshape(-1)[which].reshape(-1, 3), lengths.reshape(-1)[which].reshape(-1, 3)
    return _laid(c[:, 0] | c[:, 1] << n[:, 0] | c[:, 2] << (n[:, 0] + n[:, 1]), n.sum(1).astype(np.int64), sizes // 3, heads)


def _laid(value: np.ndarray, total: np.ndarray, sizes: np.ndarray, heads: list[tuple[int, int]]) -> list[bytes]:
    """Streams of units (values of ``total`` bits, at most 33; ``sizes`` of them in each stream) behind heads (value, bits)."""
    ends = np.cumsum(total)
    last = np.cumsum(sizes) - 1
    data_bits = np.diff(np.concatenate([[0], ends[last]]))
    head_bits = np.array([h[1] for h in heads])
    lanes = (head_bits + data_bits + 31) // 32 + 2
    first = np.concatenate([[0], np.cumsum(lanes)])
    shift = 32 * first[:-1] + head_bits - np.concatenate([[0], ends[last][:-1]])
    at = ends - total + np.repeat(shift, sizes)
    value = value << (at & 31).astype(np.uint64)
    lane = at >> 5
    # The bits of different symbols never meet, so sums are exact and as good as a bitwise or.
    out = np.bincount(lane, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), first[-1])
    out += np.bincount(lane + 1, (value >> np.uint64(32)).astype(np.float64), first[-1])
    raw = out.astype(np.uint32).view(np.uint8)
    done = []
    for k, (head, bits) in enumerate(heads):
        mine = raw[4 * first[k] : 4 * first[k] + (bits + int(data_bits[k]) + 7) // 8].copy()
        front = np.frombuffer(head.to_bytes((bits + 7) // 8, "little"), np.uint8)
        mine[: len(front)] |= front
        done.append(mine.tobytes())
    return done


# ---------------------------------------------------------------- the choice of a page's coding


def _prefix_table(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By value: prefix code, extra bits, their value."""
    return tuple(np.array(x) for x in zip((0, 0, 0), *map(prefix_of, range(1, most + 1))))


CODE_OF, EXTRA_OF, REST_OF = _prefix_table(ROW * PAGE_ROWS + 120)
#: The distance that is written for each distance in pixels of rows of ROW samples.
WRITTEN = np.arange(ROW * PAGE_ROWS + 1) + 120
for _code, (_x, _y) in reversed(list(enumerate(NEAR))):
    WRITTEN[max(1, _x + _y * ROW)] = _code + 1
EXTRA_WRITTEN = EXTRA_OF[WRITTEN]


class Parsed:
    """Literals and back-references of pages (samples one after another), and the bits that both ways of coding take."""

    def __init__(self, pages: list[np.ndarray]):
        sizes = np.array([len(p) for p in pages])
        s = np.concatenate(pages)
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        page = np.repeat(np.arange(len(pages), dtype=np.int32), sizes)
        left = np.repeat(ends.astype(np.int32), sizes) - np.arange(len(s), dtype=np.int32)
        level = np.repeat(np.arange(len(pages)) << 8, sizes) + s
        self.levels = np.bincount(level, minlength=len(pages) << 8).reshape(-1, 256)
        share = np.log2(np.maximum(self.levels, 1))
        cost = (np.log2(sizes)[:, None] - share).astype(np.float32)
        literal = np.zeros(len(s) + 1)
        np.cumsum(cost.reshape(-1)[level], dtype=np.float64, out=literal[1:])
        here, length, far = _earlier(s, page, left, self.starts)
        # A copy takes about four bits for its length and its distance each, and their extra bits.
        gain = (literal[here + length] - literal[here] - 8 - EXTRA_OF[length] - EXTRA_WRITTEN[far]).astype(np.float32)
        gains = np.zeros(len(s) + 1, np.float32)
        gains[here] = gain
        better = (gain > 0) & (gain >= gains[here + 1])
        here, length, far = here[better], length[better], far[better]
        step, away = np.ones(len(s), np.int64), np.zeros(len(s), np.int64)
        step[here], away[here] = length, far
        self.at = walked(np.arange(len(s)) + step)
        self.length, self.far = step[self.at], away[self.at]
        self.page, copy = page[self.at], self.far > 0
        self.green = np.where(copy, 256 + CODE_OF[self.length], s[self.at])
        self.written = WRITTEN[self.far]
        self.greens = np.bincount(self.page * 280 + self.green, minlength=len(pages) * 280).reshape(-1, 280)
        self.fars = np.bincount(self.page[copy] * 40 + CODE_OF[self.written[copy]], minlength=len(pages) * 40).reshape(-1, 40)
        extra = np.bincount(self.page[copy], EXTRA_OF[self.length[copy]] + EXTRA_OF[self.written[copy]], len(pages))
        self.samples, self.copy = s, copy
        self.bits_plain = _bits(self.levels)
        self.bits_far = _bits(self.fars) + extra
        self.bits_matched = np.where(self.fars.any(1), _bits(self.greens) + self.bits_far, np.inf)
        self.firsts = np.searchsorted(self.page, np.arange(len(pages) + 1))

    def part(self, page: int) -> slice:
        return slice(self.firsts[page], self.firsts[page + 1])

    def tokens(self, page: int) -> list[tuple]:
        """The page's symbols as ``matches`` gives them, of green samples in opaque pixels."""
        mine = self.part(page)
        rows = zip(self.length[mine].tolist(), self.far[mine].tolist(), self.green[mine].tolist())
        return [("copy", n, far) if far else ("pixel", 0xFF000000 | green << 8) for n, far, green in rows]

    def streams(self, which: np.ndarray) -> list[bytes]:
        """VP8L streams of the pages ``which`` (ascending) with their back-references."""
        heads = []
        codes, bits = np.zeros((len(which), 320), np.uint64), np.zeros((len(which), 320), np.int64)
        parts = []
        for part, counts in ((slice(0, 280), self.greens[which]), (slice(280, 320), self.fars[which])):
            sizes = all_code_lengths(counts, MOST_BITS)
            tokens = [length_tokens(x) for x in sizes]
            used = np.array([np.bincount([t[0] for t in x], minlength=19) if x else np.zeros(19, np.int64) for x in tokens])
            inner = paired(all_code_lengths(used, 7))
            parts.append([length_bits(*x) for x in zip(sizes, tokens, inner, reversed_codes(inner))])
            several = np.flatnonzero((sizes > 0).sum(1) > 1)
            codes[several, part], bits[several, part] = reversed_codes(sizes[several]), sizes[several]
        for p, green, far in zip(which.tolist(), *parts):
            sink = Sink()
            _head(sink, ROW, (int(self.levels[p].sum())) // ROW, False)
            sink.put(1 | SUBTRACT_GREEN << 1, 3)
            sink.put(0, 3)  # no more transforms, no cache, no meta codes
            sink.put(*green)
            sink.put(0b00010001, 8)  # red and blue are 0 everywhere
            sink.put(0b101 | 255 << 3, 11)
            sink.put(*far)
            n = sink.bits()
            heads.append((int.from_bytes(sink.done(), "little"), n))
        row = np.full(len(self.levels), -1)
        row[which] = np.arange(len(which))
        mine = np.flatnonzero(row[self.page] >= 0)
        lane, copy = row[self.page[mine]] * 320, self.copy[mine]
        codes, bits = codes.reshape(-1), bits.reshape(-1)
        value, total = codes[lane + self.green[mine]], bits[lane + self.green[mine]]
        length, written = self.length[mine], self.written[mine]
        value[copy] |= REST_OF[length[copy]].astype(np.uint64) << total[copy].astype(np.uint64)
        total[copy] += EXTRA_OF[length[copy]]
        code = lane[copy] + 280 + CODE_OF[written[copy]]
        far = codes[code] | REST_OF[written[copy]].astype(np.uint64) << bits[code].astype(np.uint64)
        after = np.flatnonzero(copy) + 1
        value, total = np.insert(value, after, far), np.insert(total, after, bits[code] + EXTRA_OF[written[copy]])
        sizes = np.bincount(lane // 320, minlength=len(which)) + np.bincount(lane[copy] // 320, minlength=len(which))
        return _laid(value, total, sizes, heads)


def _bits(counts: np.ndarray) -> np.ndarray:
    """About the bits that a code and its symbols take, by their counts (the last axis)."""
    n = counts.sum(-1)
    return n * np.log2(np.maximum(n, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(-1) + 5 * (counts > 0).sum(-1) + 20


def _last(key: np.ndarray, place: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal keys (hashes of 64 bits, of which the highest count): each and the one before it."""
    width = np.uint64(total.bit_length())
    # They stand side by side when the hash is sorted with the place in its low bits.
    key = np.sort(key >> width << width | place.astype(np.uint64))
    place = (key & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int32)
    same = np.flatnonzero(key[1:] >> width == key[:-1] >> width)
    return place[same + 1], place[same]


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of eight samples each, those that agree before the first that differs."""
    differ = a ^ b
    return np.bitwise_count((differ & -differ) - np.uint64(1)) >> 3  # 8 where nothing differs


def _agreeing(eight: np.ndarray, here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Samples that agree at two places, at most REACH; ``eight`` holds eight of them at each place."""
    length = _agree(eight[here], eight[there]).astype(np.int32)
    going = np.flatnonzero(length == 8)
    for k in range(8, REACH, 8):
        agree = _agree(eight[here[going] + k], eight[there[going] + k])
        length[going] += agree
        going = going[agree == 8]
    return length


def _earlier(s: np.ndarray, page: np.ndarray, left: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where LEAST samples stand that stood in the page before: place, samples that agree, distance. The last such place
    counts, in pages that repeat themselves the last one where 16 or 48 samples agree, if there is one."""
    padded = np.concatenate([s, np.zeros(REACH + 8, np.uint8)])
    eight, place = numbers_at(padded, "<u8"), np.arange(len(s), dtype=np.int32)
    # Equal samples of a page stand side by side, by place, when they are sorted with the place in the low bits.
    key = numbers_at(padded, "<u4")[: len(s)].astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(s)]):
        key[a:b].sort()
    same = key[1:] >> np.uint64(32) == key[:-1] >> np.uint64(32)
    same[starts[1:] - 1] = False
    same = np.flatnonzero(same)
    place_of = key.view("<u4")[::2].astype(np.int32)
    here, there = place_of[same + 1], place_of[same]
    length = np.minimum(_agreeing(eight, here, there), left[here])
    if (length < LEAST).any():  # across the end of a page
        here, there, length = (x[length >= LEAST] for x in (here, there, length))
    whole, back = np.zeros(len(s) + 1, np.int32), np.zeros(len(s) + 1, np.int32)
    whole[here], back[here] = length, here - there
    often = 4 * np.add.reduceat(whole[:-1] >= 8, starts, dtype=np.int64) > np.diff(starts, append=len(s))
    again = often.any()
    if again:
        often, mix = often[page], np.uint64(0x9E3779B97F4A7C15)
        own = page.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for long in (16, 48) if again else ():
        mine = place[often & (left >= long)]
        key = own[mine]
        for k in range(0, long, 8):
            key = (key ^ eight[mine + k]) * mix
            key ^= key >> np.uint64(29)
        here, there = _last(key * mix, mine, len(s))
        same = (whole[here] < long) & (page[here] == page[there])
        here, there = here[same], there[same]
        length = np.minimum(_agreeing(eight, here, there), left[here])
        here, there, length = (x[length >= long] for x in (here, there, length))
        whole[here], back[here] = length, here - there
    here = np.flatnonzero(whole[:-1] > 0)
    going = here[whole[here] == REACH]
    while len(going):
        # What agrees as far as was looked goes on where the same distance agrees from there on.
        beyond = going + whole[going]
        on = (back[beyond] == back[going]) & (whole[going] < left[going])
        going, beyond = going[on], beyond[on]
        whole[going] += whole[beyond]
    return here, np.minimum(whole[here], LONGEST), back[here]


def grey(samples: np.ndarray) -> np.ndarray:
    """Samples as rows of opaque grey pixels."""
    return (samples.astype(np.uint32) * 0x010101 | 0xFF000000).reshape(-1, ROW)


def _predictions(pages: list[np.ndarray], bits_plain: np.ndarray) -> list[int]:
    """The pages that literals of a predictor's residuals may code in fewer bits than literals of the samples. Modes of several
    neighbours are tried where a mode of one of them takes at most an eighth more than none."""
    samples = np.concatenate(pages)
    first = np.repeat(np.arange(len(pages)) << 8, [len(p) for p in pages])
    least = np.full(len(pages), np.inf)
    for back in (1, ROW, ROW - 1, ROW + 1):
        found = samples.copy()
        found[back:] -= samples[:-back]
        least = np.minimum(least, _bits(np.bincount(first + found, minlength=len(pages) << 8).reshape(-1, 256)))
    out = []
    for k in np.flatnonzero(least < 1.125 * bits_plain).tolist():
        pixels = np.stack([np.zeros(len(pages[k]), np.int16), pages[k].astype(np.int16)], -1).reshape(-1, ROW, 2)
        if min(_bits(np.bincount(residuals(pixels, m)[..., 1].astype(np.uint8).reshape(-1), minlength=256)) for m in range(1, 14)) < bits_plain[k]:
            out.append(k)
    return out


def _fitted_modes(samples: np.ndarray) -> np.ndarray:
    """Of all 14 modes, the one that leaves each tile the residuals of the lowest entropy."""
    pixels = np.stack([np.zeros(len(samples), np.int16), samples.astype(np.int16)], -1).reshape(-1, ROW, 2)
    across = -(-ROW >> TILE_BITS)
    tile = (np.arange(len(pixels)) >> TILE_BITS)[:, None] * across + (np.arange(ROW) >> TILE_BITS)
    n = int(tile.max()) + 1
    found = [_bits(np.bincount(((tile << 8) + (residuals(pixels, m)[..., 1] & 255)).reshape(-1), minlength=n << 8).reshape(n, 256)) for m in range(14)]
    return np.argmin(found, 0).reshape(-1, across)


def _fitted_cache(samples: np.ndarray, literal: np.ndarray, others: np.ndarray) -> tuple[float, int]:
    """The fewest bits that the ``literal`` places of a page take with a colour cache, beside ``others`` (counts of symbols), and
    the size of that cache in bits."""
    found, mine = [], np.zeros(len(samples), bool)
    mine[literal] = True
    for bits in range(1, 12):
        place = cache_places(0xFF000000, bits)[samples]
        order = np.argsort(place.astype(np.uint16), kind="stable")
        hits = order[1:][(place[order][1:] == place[order][:-1]) & (samples[order][1:] == samples[order][:-1])]
        symbols = samples.astype(np.int64)
        symbols[hits] = 256 + LENGTH_CODES + place[hits]
        counts = np.bincount(symbols[mine], minlength=256 + LENGTH_CODES)
        counts[: len(others)] += others
        found.append((float(_bits(counts)), bits))
    return min(found)


def _splits(parsed: Parsed) -> tuple[np.ndarray, np.ndarray]:
    """Of each page the bits with one group of codes above the best row of tiles and another below, and that row (0: none)."""
    n, edge = len(parsed.levels), ROW << META_BITS
    rows = -(-parsed.levels.sum(1) // edge)
    base = np.cumsum(rows) - rows
    block = base[parsed.page] + (parsed.at - parsed.starts[parsed.page]) // edge
    total = int(rows.sum())
    page = np.repeat(np.arange(n), rows)
    within = np.arange(total) - base[page]
    bits, extra = np.full(total, 100.0), EXTRA_OF[parsed.length] + EXTRA_OF[parsed.written]
    bits += np.bincount(parsed.page[parsed.copy], extra[parsed.copy], n)[page]
    far = CODE_OF[parsed.written[parsed.copy]]
    for where, symbols, size in ((block, parsed.green, 280), (block[parsed.copy], far, DISTANCE_CODES)):
        counts = np.zeros((total + 1, size), np.int64)
        counts[1:] = np.cumsum(np.bincount(where * size + symbols, minlength=total * size).reshape(total, size), 0)
        above = counts[np.arange(total)] - counts[base[page]]
        bits += _bits(above) + _bits(counts[(base + rows)[page]] - counts[base[page]] - above)
    bits[within == 0] = np.inf
    least = np.minimum.reduceat(bits, base)
    return least, np.maximum.reduceat(np.where(bits == least[page], within, 0), base)


def choose(pages: list[np.ndarray]) -> list[tuple[str, bytes]]:
    """How each page (a multiple of ROW samples) is stored, and its VP8L stream: the smallest that was found. Literals and
    back-references are weighed by counts. What else the content speaks for is coded as well and its size compared: a predictor
    whose mode is fitted to each tile, where residuals need fewer bits than samples; a palette, where there are at most 16 levels;
    two groups of codes, where counts of an upper and a lower part promise to save WORTH; a colour cache, where they do so with
    its codes, tried where samples come back at once or parts differ (it gives one level two names, which pays only if levels
    that share a place come in runs). Of grey residuals both subtract-green and cross-colour leave green alone; both are coded."""
    parsed = Parsed(pages)
    matched = parsed.bits_matched < parsed.bits_plain
    out: list = [None] * len(pages)
    if matched.any():
        for k, data in zip(np.flatnonzero(matched).tolist(), parsed.streams(np.flatnonzero(matched))):
            out[k] = "matched", data
    if not matched.all():
        plain = np.flatnonzero(~matched).tolist()
        for k, data in zip(plain, encode_pages([(pages[k], "plain") for k in plain])):
            out[k] = "plain", data
    best = np.minimum(parsed.bits_matched, parsed.bits_plain)
    split, row = _splits(parsed)
    grouped = split < (1 - WORTH) * best
    samples, literal = parsed.samples, np.flatnonzero(~parsed.copy & (parsed.at > 1))
    at = parsed.at[literal]
    again = (samples[at] == samples[at - 1]) | (samples[at] == samples[at - 2])
    page, n = parsed.page[literal], len(pages)
    cached = grouped | (np.bincount(page, again, n) * 4 > np.bincount(page, minlength=n))
    tries: dict[int, list] = {k: [] for k in range(n)}
    for k in _predictions(pages, parsed.bits_plain):
        modes = _fitted_modes(pages[k])
        tries[k] += [("predicted", lambda a, m=modes: encode(a, (PREDICTOR, SUBTRACT_GREEN), modes=m, tile_bits=TILE_BITS))]
        tries[k] += [("predicted", lambda a, m=modes: encode(a, (PREDICTOR, CROSS_COLOR), modes=m, tile_bits=TILE_BITS, multipliers=0xFF002020))]
    for k in np.flatnonzero((parsed.levels > 0).sum(1) <= 16).tolist():
        tries[k] += [("palette", lambda a: encode(a, (PALETTE,)))]
    for k in np.flatnonzero(cached).tolist():
        a = parsed.starts[k]
        literal, rest = parsed.at[parsed.part(k)][~parsed.copy[parsed.part(k)]] - a, parsed.greens[k] * (np.arange(280) >= 256)
        for places, others, tokens in ((np.arange(len(pages[k])), rest * 0, False), (literal, rest, parsed.tokens(k))):
            bits, size = _fitted_cache(pages[k], places, others)
            if bits + (parsed.bits_far[k] if tokens else 0) < (1 - WORTH) * best[k]:
                tries[k] += [("cached", lambda a, b=size, m=tokens: encode(a, (SUBTRACT_GREEN,), b, m))]
    for k in np.flatnonzero(grouped).tolist():
        rows = -(-len(pages[k]) // (ROW << META_BITS))
        meta = np.repeat((np.arange(rows) >= row[k])[:, None], -(-ROW >> META_BITS), 1)
        tries[k] += [("grouped", lambda a, m=meta, t=parsed.tokens(k): encode(a, (SUBTRACT_GREEN,), match=t, meta_bits=META_BITS, meta=m))]
    for k, found in tries.items():
        for name, code in found:
            data = code(grey(pages[k]))
            if len(data) < len(out[k][1]):
                out[k] = name, data
    return out


def kind_of(samples: np.ndarray) -> str:
    """How a page is stored: plain, matched, predicted, palette, cached or grouped."""
    return choose([samples])[0][0]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of ROW bytes) as grey samples in one file: an image of up to PAGE_ROWS rows, or a canvas of such
    images one below the other."""
    keep_freed()
    step = ROW * PAGE_ROWS
    pages = [(k, np.frombuffer(p, np.uint8, min(step, len(p) - i), i)) for k, p in enumerate(payloads) for i in range(0, len(p), step)]
    out: list[list[bytes]] = [[] for _ in payloads]
    at = 0
    while at < len(pages):
        first, size = at, 0
        while at < len(pages) and (size < CHOICE_BYTES or at == first):
            size += len(pages[at][1])
            at += 1
        for (k, _), (_, data) in zip(pages[first:at], choose([s for _, s in pages[first:at]])):
            out[k].append(data)
    return [wrap(x[0]) if len(x) == 1 else wrap_tiles(ROW, len(p) // ROW, [(0, PAGE_ROWS * k, data) for k, data in enumerate(x)]) for p, x in zip(payloads, out)]


def decode_payloads(media: list[bytes]) -> list[bytes]:
    """The payloads that ``encode_payloads`` stored, from their files alone."""
    files = [tiles(m)[2] for m in media]
    images = iter(decode_streams([part[2] for parts in files for part in parts]))
    return [b"".join((next(images) & 255).astype(np.uint8).tobytes() for _ in parts) for parts in files]
