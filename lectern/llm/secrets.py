"""Secret scan with multipart credential linking.

A credential often has several parts: an identifier, a secret and an endpoint. Parts of a fixed form (assignments,
access identifiers, long hex runs) are reported on their own. Weak candidates (a user or client identifier, a mixed
token, an address) are reported only where complementary parts stand nearby: candidates of a text are interval-joined,
by a sorted sweep, within the same scope (a block between blank lines). A caller may also bound the gap between them, from the end
of one to the start of the other, by a window of code points, of which what candidates cover does not count; by default the
scope alone decides. A linked group is one part with all that stand near it, and is reported whole.

Defined cases: null text counts as empty; texts of any length are scanned whole; the join takes n log n steps in the
number of candidates, however many a text has; repeated rows stay; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed forms of the base kinds, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")

# Weak kinds, in the order in which they are listed after the base kinds.
WEAK_ID = re.compile(r"""\b(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.I | re.A)
ADDRESS = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""", re.A)
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.A)
WEAK = ("weak_id", "weak_secret", "endpoint")
KINDS = (*BASE, *WEAK)

#: Code points, outside of all candidates, between parts that are still joined; None: the scope alone decides.
WINDOW: int | None = None
BLANK_LINE = re.compile(r"\n[^\S\n]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind). A match that is too short still uses up its text, so lengths are checked afterwards; for runs
    of one class of characters it makes no difference."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _mixed(token: str) -> bool:
    classes = (any("a" <= c <= "z" for c in token), any("A" <= c <= "Z" for c in token), any("0" <= c <= "9" for c in token))
    return classes[2] and sum(classes) >= 2


def weak_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    starts = [s[0] for s in base]
    furthest, ends = 0, []
    for s in base:
        furthest = max(furthest, s[1])
        ends.append(furthest)

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k == 0 or ends[k - 1] <= a

    out = [(m.start(), m.end(), "weak_id") for m in WEAK_ID.finditer(text) if free(m.start(), m.end())] if "=" in text or ":" in text else []
    out += [(m.start(), m.end(), "endpoint") for m in ADDRESS.finditer(text)] if "://" in text else []
    taken = sorted(out)
    tops, top = [], 0
    for s in taken:
        top = max(top, s[1])
        tops.append(top)
    for m in MIXED.finditer(text):
        if _mixed(m[0]) and free(m.start(), m.end()):
            k = bisect_left(taken, (m.end(),))
            if k == 0 or tops[k - 1] <= m.start():
                out.append((m.start(), m.end(), "weak_secret"))
    return out


class Joined:
    """The parts of a text by kind, in their order, for interval joins. Parts of one kind do not overlap, so those near a part
    are a range of their kind."""

    def __init__(self, text: str, parts: list[tuple[int, int, str]], window: int | None):
        self.window = len(text) if window is None else window
        self.scopes = [m.end() for m in BLANK_LINE.finditer(text)]
        self.parts: dict[str, list[tuple[int, int, str]]] = {k: [] for k in KINDS}
        self.starts: dict[str, list[int]] = {k: [] for k in KINDS}
        # Starts and ends less what candidates cover before them.
        self.lefts: dict[str, list[int]] = {k: [] for k in KINDS}
        self.rights: dict[str, list[int]] = {k: [] for k in KINDS}
        self.bare, top, covered = {}, 0, 0
        for part in sorted(parts):
            start, end, kind = part
            left = start - covered + max(0, top - start)
            covered += max(0, end - max(top, start))
            top = max(top, end)
            self.bare[part] = left, top - covered
            for column, x in ((self.parts, part), (self.starts, start), (self.lefts, left), (self.rights, top - covered)):
                column[kind].append(x)
        self.ends = len(text) + 1
        #: For each kind, by how many more groups hold the part at this place than the one before it.
        self.turns = {k: [0] * (len(self.starts[k]) + 1) for k in WEAK}

    def near(self, part: tuple[int, int, str], kind: str) -> tuple[int, int]:
        """The range of the parts of a kind that are joined with this part."""
        k = bisect_right(self.scopes, part[0])
        low, high = self.scopes[k - 1] if k else 0, self.scopes[k] if k < len(self.scopes) else self.ends
        left, right = self.bare[part]
        first = max(bisect_left(self.starts[kind], low), bisect_left(self.rights[kind], left - self.window))
        return first, max(first, min(bisect_left(self.starts[kind], high), bisect_right(self.lefts[kind], right + self.window)))

    def link(self, part: tuple[int, int, str], *wanted: tuple[str, ...]) -> None:
        """If parts of each of the wanted sets of kinds are near, the part and all of them are one linked group."""
        ranges = [[(kind, *self.near(part, kind)) for kind in kinds] for kinds in wanted]
        if all(any(a < b for _, a, b in some) for some in ranges):
            if part[2] in WEAK:
                k = bisect_left(self.parts[part[2]], part)
                ranges.append([(part[2], k, k + 1)])
            for kind, a, b in chain.from_iterable(ranges):
                if kind in WEAK and a < b:
                    self.turns[kind][a] += 1
                    self.turns[kind][b] -= 1

    def linked(self) -> list[tuple[int, int, str]]:
        return [part for kind in WEAK for part, n in zip(self.parts[kind], accumulate(self.turns[kind])) if n]


#: Kinds that are identifiers, and those that are secrets.
IDENTIFIERS, SECRETS = ("access", "weak_id"), ("assign", "hex", "weak_secret")


def scan(text: str, window: int | None = WINDOW) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the weak ones that are reported as complementary parts co-occur. With ``window`` None only scopes keep
    parts apart.

    A weak identifier is linked with a base secret, a weak secret with an access identifier; and an identifier, a secret and
    an endpoint, weak or not, are linked where one of the three has the other two near it."""
    base = base_spans(text)
    weak = weak_candidates(text, base)
    if not weak or not (base or len(weak) > 2):
        return base, []
    joined = Joined(text, [*base, *weak], window)
    for part in [*base, *weak]:
        if part[2] == "weak_id":
            joined.link(part, ("assign", "hex"))
        if part[2] == "weak_secret":
            joined.link(part, ("access",))
        if part[2] == "endpoint":
            joined.link(part, IDENTIFIERS, SECRETS)
        elif joined.parts["endpoint"]:
            joined.link(part, ("endpoint",), SECRETS if part[2] in IDENTIFIERS else IDENTIFIERS)
    return base, joined.linked()


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame, keep: bool = True, window: int | None = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked and, with ``keep``, redacted (text)."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, linked = scan(text or "", window)
                counts = [sum(s[2] == k for s in base) for k in BASE]
                row = (*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest([*base, *linked]), len(linked))
                rows.append((*row, redact(text, [*base, *linked]) if text is not None else None) if keep else row)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * keep
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"] + ["redacted"] * keep
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long" + ", redacted string" * keep
    return docs.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text").mapInArrow(run, schema)


def redacted_documents(docs: DataFrame, window: int | None = WINDOW, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The columns of ``docs``, secrets in the text replaced by the name of their kind, n_chars counted anew."""
    columns = docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new = []
            for text in batch.column(at).to_pylist():
                base, linked = scan(text or "", window)
                new.append(redact(text, [*base, *linked]) if base or linked else text)
            out = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if count_col in columns:
                k = batch.schema.get_field_index(count_col)
                changed = [n if a == b else len(b) for n, a, b in zip(batch.column(k).to_pylist(), batch.column(at).to_pylist(), new)]
                out = out.set_column(k, batch.schema.field(k), pa.array(changed, batch.schema.field(k).type))
            yield out

    return docs.mapInArrow(run, docs.schema)
