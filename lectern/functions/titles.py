"""Title classification: ordered rules, the first that matches decides; skip rules come before keep rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

# Fixed rules: (name, pattern), in order; all ignore case. \b is an ASCII word boundary.
SKIP_RULES = (
    ("cover", r"^cover(\s|$)"),
    ("copyright", r"copyright"),
    ("title-page", r"^title\s*page"),
    ("contents", r"^(table\s+of\s+)?contents?$"),
    ("toc", r"^toc$"),
    ("acknowledgements", r"^acknowledg(e)?ments"),
    ("about-author", r"^about\s+the\s+author"),
    ("about-book", r"^about\s+(the\s+)?book"),
    ("dedication", r"^dedication"),
    ("also-by", r"^also\s+by"),
    ("colophon", r"^colophon"),
    ("preview", r"^preview"),
    ("excerpt", r"^excerpt"),
    ("discussion", r"^discussion\s+questions"),
    ("praise", r"^praise\s+for"),
    ("information", r"^information$"),
    ("notes", r"^notes$"),
    ("references", r"^references$"),
    ("index", r"^index$"),
    ("glossary", r"^glossary$"),
    ("map", r"^map$"),
    ("illustrations", r"^list\s+of\s+illustrations"),
    ("figures", r"^list\s+of\s+figures"),
)
KEEP_RULES = (
    ("chapter-num", r"^chapter\s+(\d+|[ivxlcdm]+)\b"),
    ("chapter-word", r"^chapter\s+([a-z]|[ivxlcdm]+)\b"),
    ("chapter-any", r"^chapter\b"),
    ("part", r"^part\s+(\d+|[ivxlcdm]+)\b"),
    ("book-num", r"^book\s+(\d+|[ivxlcdm]+)\b"),
    ("volume", r"^volume\s+(\d+|[ivxlcdm]+)\b"),
    ("prologue", r"^prologue\b"),
    ("epilogue", r"^epilogue\b"),
    ("preface", r"^preface\b"),
    ("introduction", r"^introduction\b"),
    ("foreword", r"^foreword\b"),
    ("afterword", r"^afterword\b"),
    ("appendix", r"^appendix\b"),
)


def java(pattern: str) -> str:
    """A rule in Java's dialect: ASCII boundaries, and $ at the very end only. In the rules \\b always follows a letter or digit."""
    return "(?i)" + pattern.replace(r"\b", "(?![0-9A-Za-z_])").replace("$", r"\z").replace(r"\d", "[0-9]")


def classify(title: Column) -> Column:
    """struct(decision KEEP, SKIP or AMBIGUOUS; rule)."""
    t = trimmed(F.coalesce(title, F.lit("")))
    out = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("rule"))
    rules = [("SKIP", *r) for r in SKIP_RULES] + [("KEEP", *r) for r in KEEP_RULES]
    first, *rest = rules
    start = F.when(t == "", out("SKIP", "empty-title"))
    return reduce(lambda c, r: c.when(F.rlike(t, F.lit(java(r[2]))), out(r[0], r[1])), rules, start).otherwise(out("AMBIGUOUS", ""))


def is_keep(title: Column) -> Column:
    return classify(title)["decision"] == "KEEP"


def is_skip(title: Column) -> Column:
    return classify(title)["decision"] == "SKIP"


def decision_label(d: Column) -> Column:
    return F.when(d == "KEEP", "keep").when(d == "SKIP", "skip").when(d == "AMBIGUOUS", "ambiguous").otherwise("unknown")


def classify_sql(title: str) -> str:
    """The decision and rule as DuckDB SQL (whose expressions are RE2's): 'DECISION/rule'."""
    t = f"regexp_replace(coalesce({title}, ''), '^[\\s\\x{{85}}\\pZ]+|[\\s\\x{{85}}\\pZ]+$', '', 'g')"
    cases = "".join(f" WHEN regexp_matches(t, '(?i){p}') THEN '{d}/{n}'" for d, rules in (("SKIP", SKIP_RULES), ("KEEP", KEEP_RULES)) for n, p in rules)
    return f"(SELECT CASE WHEN t = '' THEN 'SKIP/empty-title'{cases} ELSE 'AMBIGUOUS/' END FROM (SELECT {t} AS t))"
