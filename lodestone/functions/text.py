"""Scalar text functions as column expressions. Patterns name Unicode behaviour themselves, so that they don't depend on the engine's defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Letters of the two scripts.
CYRILLIC, LATIN = "[а-яёА-ЯЁ]", "[a-zA-Z]"
#: Transliteration of letters, one to one, then one to many.
TRANSLIT_FROM, TRANSLIT_TO = "абвгдеёзийклмнопрстуфхцыэ", "abvgdeeziiklmnoprstufhcye"
TRANSLIT_LONG = (("ж", "zh"), ("ч", "ch"), ("щ", "sch"), ("ш", "sh"), ("ю", "yu"), ("я", "ya"), ("ъ", ""), ("ь", ""))
#: Titles that say nothing.
GENERIC_TITLES = ("", "document", "документ microsoft word", "презентация powerpoint", "powerpoint presentation", "microsoft word - document1")


def clean_whitespace(text: Column) -> Column:
    """Runs of blanks, tabs and no-break spaces become one blank, lines are trimmed, one empty line stays at most."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85  ]", "\n"), r"[ \t ]+", " ")
    trimmed = F.regexp_replace(lines, r"(?m)^(?U:[\s&&[^\n]])+|(?U:[\s&&[^\n]])+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", "")


def detect_lang(text: Column, sample: int = 5000, ru: float = 0.7, en: float = 0.3) -> Column:
    head = F.substring(text, 1, sample)
    cyrillic, latin = F.regexp_count(head, F.lit(CYRILLIC)), F.regexp_count(head, F.lit(LATIN))
    share = cyrillic / (cyrillic + latin)
    return F.when(cyrillic + latin == 0, "ru").when(share >= ru, "ru").when(share <= en, "en").otherwise("mixed")


def title(property_title: Column, stem: Column) -> Column:
    named = F.trim(property_title)
    return F.when(named.isNotNull() & ~F.lower(named).isin(*GENERIC_TITLES), named).otherwise(F.trim(F.replace(stem, F.lit("_"), F.lit(" "))))


def year(stem: Column, property_year: Column, text: Column, this_year: int, least: int = 1950) -> Column:
    """The last year in the file's name, else the property, else the first in the text's start; what is out of bounds falls through."""
    pattern = F.lit("(19[0-9]{2}|20[0-9]{2})")
    fits = lambda y: F.when(y.between(least, this_year + 1), y)
    from_name = F.try_element_at(F.regexp_extract_all(stem, pattern, F.lit(1)), F.lit(-1)).cast("int")
    from_text = F.try_element_at(F.regexp_extract_all(F.substring(text, 1, 2000), pattern, F.lit(1)), F.lit(1)).cast("int")
    return F.coalesce(fits(from_name), fits(property_year.cast("int")), fits(from_text))


def split_authors(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, "[;/\n,]"), lambda x: F.trim(x)), lambda x: x != "")


def year_of_pdf_date(raw: Column) -> Column:
    digits = F.regexp_extract(raw, "^(?:D:)?([0-9]{4})", 1)
    return F.when(digits != "", digits.cast("int"))


def parse_number(raw: Column) -> Column:
    return F.translate(raw, ",  ", ".").cast("double")


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; text without any gives the start of its MD5."""
    out = F.translate(F.lower(F.trim(text)), TRANSLIT_FROM, TRANSLIT_TO)
    for letter, latin in TRANSLIT_LONG:
        out = F.replace(out, F.lit(letter), F.lit(latin))
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(out == "", F.substring(F.md5(text), 1, 12)).otherwise(out)


def node_id(kind: Column, canon: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), slug(canon))


def short_sha1(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha1(text), 1, digits)


def mostly_latin(text: Column) -> Column:
    latin, cyrillic = F.regexp_count(text, F.lit(LATIN)), F.regexp_count(text, F.lit(CYRILLIC))
    return (latin > 0) & (latin > cyrillic)


def mostly_cyrillic(text: Column) -> Column:
    latin, cyrillic = F.regexp_count(text, F.lit(LATIN)), F.regexp_count(text, F.lit(CYRILLIC))
    return (cyrillic > 0) & (cyrillic >= latin)


def other_script_name(canon: Column, synonyms: Column) -> Column:
    """The first synonym in the other script than the name's; empty where there is none."""
    latin, cyrillic = F.get(F.filter(synonyms, mostly_latin), 0), F.get(F.filter(synonyms, mostly_cyrillic), 0)
    return F.coalesce(F.when(mostly_cyrillic(canon), latin).otherwise(cyrillic), F.lit(""))


def marker_hits(text: Column, markers: Sequence[str]) -> Column:
    """Markers that start a word of the (lower-cased) text, in their order."""
    return F.filter(F.array(*(F.when(text.rlike(rf"(?U)\b\Q{m}\E"), m) for m in markers)), lambda x: x.isNotNull())


def geography(text: Column, ru: Sequence[str], foreign: Sequence[str], least: int = 3, evidence: int = 5) -> Column:
    """struct(geography, ru_hits, foreign_hits, evidence) by the number of different markers of each side."""
    a, b = marker_hits(text, ru), marker_hits(text, foreign)
    where = F.when((F.size(a) >= least) & (F.size(b) >= least), "global").when(F.size(a) >= least, "ru").when(F.size(b) >= least, "foreign").otherwise("unknown")
    return F.struct(where.alias("geography"), F.size(a).alias("ru_hits"), F.size(b).alias("foreign_hits"), F.concat(F.slice(a, 1, evidence), F.slice(b, 1, evidence)).alias("evidence"))


def topic_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How often the keywords start a word of the text, in any case."""
    total = F.lit(0)
    for k in keywords:
        total = total + F.regexp_count(text, F.lit(rf"(?iu)(?<![а-яёА-ЯЁa-zA-Z0-9])\Q{k}\E"))
    return total


def quote(text: Column, limit: int = 300) -> Column:
    """The trimmed text, or its first ``limit`` characters up to the last blank, with an ellipsis."""
    whole = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    head = F.substring(whole, 1, limit)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)\A(.*) ", 1)).otherwise(head)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(cut, F.lit("…")))


def first_sentences(text: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(text, r"\. "), 1, n), ". ")


def question_key(question: Column) -> Column:
    one = F.regexp_replace(F.regexp_replace(F.lower(question), r"(?U)\s+", " "), r"\A +| +\z", "")
    return F.regexp_replace(one, r"[?!. ]+\z", "")


def strip_think(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"\A```[a-zA-Z]*\s*|\s*```\z", ""))
