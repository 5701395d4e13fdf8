"""Scalar text functions as Column expressions, so they stay in whole-stage codegen.

Regular expressions follow RE2's meaning where Java's differs: classes are ASCII, ends of text are ``\\z``, and word
boundaries are written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "аеёиоуыэюяАЕЁИОУЫЭЮЯ"
#: What ends a sentence, and what may close it.
ENDS, CLOSERS = ".!?…", "»\"“„)\\]…"


def trimmed(c: Column) -> Column:
    """Without leading and trailing Unicode white space (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+\z", "")


def collapsed(c: Column) -> Column:
    """Runs of space, tab and line ends as one space, trimmed."""
    return trimmed(F.regexp_replace(c, "[ \n\r\t]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "-"), r"^-+|-+\z", "")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)\z", 1)


def split_anchor(c: Column) -> Column:
    """struct(path, anchor), cut at the first #."""
    at = F.instr(c, "#")
    return F.struct(F.substring_index(c, "#", 1).alias("path"), F.when(at > 0, F.substr(c, at + 1)).otherwise("").alias("anchor"))


def resolve_href(base: Column, href: Column) -> Column:
    """A reference without fragment, joined with a folder and cleaned of . and .. parts."""
    path = F.substring_index(href, "#", 1)
    joined = F.when(F.length(base) > 0, F.concat_ws("/", base, path)).otherwise(path)
    steps = F.filter(F.split(joined, "/"), lambda x: (x != "") & (x != "."))
    # A step .. takes the last kept step away, unless there is none (or only further ..).
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, x: F.when((x == "..") & (F.size(done) > 0) & (F.element_at(done, F.greatest(F.size(done), F.lit(1))) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    out = F.array_join(kept, "/")
    return F.when(out == "", ".").otherwise(out)


def title_deduplicated(c: Column) -> Column:
    """A text that starts with the same line twice keeps it once, a blank line after it."""
    first = trimmed(F.substring_index(c, "\n", 1))
    rest = F.regexp_replace(F.regexp_extract(c, r"(?s)^[^\n]*\n(.*)\z", 1), r"^[\n\r \t]+", "")
    second = trimmed(F.substring_index(rest, "\n", 1))
    tail = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^\n]*\n(.*)\z", 1), r"^[\n\r \t]+", "")
    repeated = F.contains(c, F.lit("\n")) & (first != "") & (rest != "") & (second == first)
    return F.when(~repeated, c).when(F.contains(rest, F.lit("\n")), F.concat(first, F.lit("\n\n"), tail)).otherwise(first)


def without_tags(c: Column) -> Column:
    """Tags removed; an unclosed one takes the rest, and a stray > goes."""
    return F.replace(F.regexp_replace(c, r"<[^>]*(>|\z)", ""), F.lit(">"), F.lit(""))


def without_colors(c: Column) -> Column:
    return F.regexp_replace(c, "\x1b\\[[^m]*m", "")


def log_snippet(c: Column) -> Column:
    """Of a log entry about a text, up to 40 code points of that text."""
    return F.substring(trimmed(without_tags(F.regexp_extract(c, r"(?s)for text '([^']*)'", 1))), 1, 40)


def paragraphs(c: Column) -> Column:
    """Cut on blank lines if there are any, else on lines; trimmed, empty ones dropped."""
    parts = F.when(F.contains(c, F.lit("\n\n")), F.split(c, "\n\n")).otherwise(F.split(c, "\n"))
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Cut after each end mark and its closers; a text without any is one sentence."""
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"[^{ENDS}]*[{ENDS}][{CLOSERS}]*|[^{ENDS}]+"), 0), trimmed), lambda x: x != "")
    whole = trimmed(c)
    return F.when(F.size(found) > 0, found).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def stress_sentences(c: Column) -> Column:
    """Cut after each . ! ? and line end."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?\n])"), trimmed), lambda x: x != "")


def sanitized_stress(c: Column) -> Column:
    """Without plus signs that do not stand before a vowel."""
    return F.regexp_replace(c, rf"\+(?![{VOWELS}])", "")


def has_valid_stress(c: Column) -> Column:
    return F.rlike(c, F.lit(rf"\+[{VOWELS}]"))


def without_combining(c: Column) -> Column:
    return F.regexp_replace(c, "[̀-ͯ]+", "")


def has_latin(c: Column) -> Column:
    return F.rlike(c, F.lit("[A-Za-z]"))


_BAD = r"[\p{L}&&[^\p{IsCyrillic}A-Za-z]]"


def has_bad_symbols(c: Column) -> Column:
    """Any letter that is neither Cyrillic nor ASCII Latin."""
    return F.rlike(c, F.lit(_BAD))


def bad_symbols(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({_BAD})"), 1)))


def without_bad_symbols(c: Column) -> Column:
    return F.regexp_replace(c, _BAD, "")


def latin_words(c: Column) -> Column:
    """Distinct runs of letters with a Latin one in them, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), 1), has_latin)))


def is_acronym(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[A-Z]{2,}\z"))


def contains_ignoring_case(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b))


def quoted(term: str) -> str:
    return "".join(x if x.isalnum() or x.isspace() else "\\" + x for x in term)


def word_replaced(c: Column, term: str, replacement: str) -> Column:
    """Every occurrence of a term at letter or digit boundaries, in any case, replaced literally."""
    pattern = rf"(?iu)(?<![\p{{L}}\p{{Nd}}]){quoted(term)}(?![\p{{L}}\p{{Nd}}])"
    return F.regexp_replace(c, pattern, replacement.replace("\\", "\\\\").replace("$", "\\$"))


def vocabulary_applied(c: Column, entries: list[tuple[str, str]]) -> Column:
    """A small vocabulary applied in its order; empty and unchanged entries are passed over."""
    for term, stressed in entries:
        if term and stressed and term != stressed:
            c = word_replaced(c, term, stressed)
    return c


def byte_prefix(c: Column, n: int) -> Column:
    """The first n bytes and "..." of longer texts, without the code point that the cut would split."""
    data = F.hex(F.substring(F.encode(c, "UTF-8"), 1, n))
    split_point = "(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})"
    whole = F.regexp_replace(data, rf"^((?:[0-9A-F]{{2}})*?){split_point}\z", "$1")
    return F.when(F.octet_length(c) > n, F.concat(F.decode(F.unhex(whole), "UTF-8"), F.lit("..."))).otherwise(c)


def numbered(pattern: str, *columns: Column) -> Column:
    """File names with padded numbers; long numbers stay whole."""
    return F.format_string(pattern, *columns)


def custom_id(prefix: str, chapter: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-chapter-"), chapter.cast("string"))


def chapter_of(custom: Column, prefix: str) -> Column:
    """The chapter in a custom id; 0 where it has none. What follows the number is passed over."""
    return F.coalesce(F.regexp_extract(custom, rf"^{prefix}-chapter-([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def choice(c: Column, most: Column) -> Column:
    """A choice from 1 on, or null."""
    n = F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
    return F.when(n.between(1, most), n)


def space_split(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def bitrate(c: Column) -> Column:
    """An encoder's bit rate: 128k where none is set; a number without a unit gets one."""
    value = F.coalesce(c, F.lit(""))
    return F.when(value == "", "128k").when(F.endswith(F.lower(value), F.lit("k")), value).otherwise(F.concat(value, F.lit("k")))
