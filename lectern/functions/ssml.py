"""Speech markup: escaping, transliteration, and the generator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import paragraphs, sanitized_stress, sentences, trimmed

# Latin letters with a Cyrillic look-alike (or the same sound), and their Cyrillic letters.
LATIN = "ABCDEHKMOPRSTVXYZabcdehkmoprstvxyz"
LOOK_ALIKE = "АВСДЕНКМОРРСТВХУЗавсденкморрствхуз"
# The other Latin letters by sound.
PHONETIC = {"F": "Ф", "f": "ф", "G": "Г", "g": "г", "I": "И", "i": "и", "J": "ДЖ", "j": "дж", "L": "Л", "l": "л", "N": "Н", "n": "н", "Q": "К", "q": "к", "U": "У", "u": "у", "W": "В", "w": "в"}
# How capital Latin letters are spelled aloud, A to Z.
SPELLED = {
    "A": "А", "B": "БЭ", "C": "ЦЭ", "D": "ДЭ", "E": "Е", "F": "ЭФ", "G": "ГЭ", "H": "АШ", "I": "И",
    "J": "ДЖИ", "K": "КА", "L": "ЭЛЬ", "M": "ЭМ", "N": "ЭН", "O": "О", "P": "ПЭ", "Q": "КУ", "R": "ЭР",
    "S": "ЭС", "T": "ТЭ", "U": "У", "V": "ВЭ", "W": "ДАБЛЮ", "X": "ИКС", "Y": "УАЙ", "Z": "ЗЭД",
}
EMPTY = "<speak></speak>"


def escaped(c: Column) -> Column:
    """The three XML escapes, and look-alikes for Latin letters; those without one stay."""
    text = F.translate(c, LATIN, LOOK_ALIKE)
    # Escapes are written in Latin letters, so they come after.
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), text)


def transliterated(c: Column) -> Column:
    """All Latin letters as Cyrillic: words of two or more Latin capitals are spelled out, a space after each letter; others are
    written by look-alikes and sounds. Words are runs of letters."""
    spelled = F.create_map(*[F.lit(x) for kv in SPELLED.items() for x in kv])
    written = lambda w: reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), PHONETIC.items(), F.translate(w, LATIN, LOOK_ALIKE))
    spell = lambda w: F.array_join(F.transform(F.split(w, ""), lambda x: F.concat(F.element_at(spelled, x), F.lit(" "))), "")
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, lambda w: F.when(F.rlike(w, F.lit(r"^[A-Z]{2,}\z")), spell(w)).otherwise(written(w))), "")


def generated(c: Column) -> Column:
    """A document of paragraphs and sentences."""
    text = trimmed(c)
    one = lambda p: F.concat(F.lit("<p>"), F.array_join(F.transform(sentences(p), lambda s: F.concat(F.lit("<s>"), escaped(s), F.lit("</s>"))), ""), F.lit("</p>\n"))
    body = F.array_join(F.transform(paragraphs(sanitized_stress(text)), one), "")
    return F.when(text == "", EMPTY).otherwise(F.concat(F.lit("<speak>\n"), body, F.lit("</speak>")))
