"""Numbers with units in text, as constraints: parameter, operator, value, normalised value and unit.

All of it is column expressions. Marks are put around every range in a text, then around
every single number that stands in no range; the text between the marks gives where each hit stands, and a row is made for each.
The operator is a sign in front of the number or else the phrase that ends closest before
it; the parameter is the keyword that ends closest before it. Neither crosses a sentence's
end. Texts without a number in front of a unit are filtered out by the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions.text import parse_number

# Patterns of units with their normal unit and factor, of numbers, operators and parameters.
NUMBER = r"\d{1,3}(?:[  ]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
UNITS = (
    (r"мг\s*/\s*дм\s*3|мг\s*/\s*дм\s*³", "мг/л", 1.0),
    (r"мг\s*/\s*л", "мг/л", 1.0),
    (r"г\s*/\s*дм\s*3|г\s*/\s*дм\s*³", "мг/л", 1000.0),
    (r"г\s*/\s*л", "мг/л", 1000.0),
    (r"°\s*[CС]|градус(?:ов|а|ы)?(?:\s+Цельси\w*)?", "°C", 1.0),
    (r"м\s*3\s*/\s*ч|м\s*³\s*/\s*ч", "м³/ч", 1.0),
    (r"т\s*/\s*сут", "т/сут", 1.0),
    (r"%|процент(?:ов|а|ы)?", "%", 1.0),
)
SIGNS = {"<": "<", ">": ">", "≤": "<=", "≥": ">="}
PHRASES = (
    (r"не\s+более", "<="), (r"не\s+менее", ">="), (r"не\s+ниже", ">="), (r"не\s+выше", "<="), (r"не\s+превыша\w*", "<="),
    (r"\bдо\b", "<="), (r"\bменее\b", "<"), (r"\bниже\b", "<"), (r"\bсвыше\b", ">"), (r"\bболее\b", ">"), (r"\bвыше\b", ">"),
    (r"\bот\b", ">="), (r"составля\w*|равн\w*", "="),
)
PARAMETERS = (
    (r"содержани\w*\s+([A-Za-zА-Яа-яЁё]+)", None), (r"минерализаци\w*", "минерализация"), (r"сульфат\w*", "сульфаты"), (r"хлорид\w*", "хлориды"),
    (r"\bCa\b|кальци\w*", "кальций"), (r"\bMg\b|магни\w*", "магний"), (r"\bNa\b|натри\w*", "натрий"), (r"сухо(?:й|го)\s+остат\w*", "сухой остаток"),
    (r"температур\w*", "температура"), (r"скорост\w*\s+потока", "скорость потока"), (r"расход\w*", "расход"), (r"давлени\w*", "давление"),
    (r"влажност\w*", "влажность"), (r"плотност\w*", "плотность"), (r"производительност\w*", "производительность"), (r"глубин\w*", "глубина"),
    (r"концентраци\w*", "концентрация"),
)
OPERATOR_REACH, PARAMETER_REACH, BEFORE, AFTER = 30, 60, 30, 15


UNIT = "|".join(f"(?:{p})" for p, _, _ in UNITS)
SPAN_WORDS = rf"от\s+({NUMBER})\s+до\s+({NUMBER})\s*({UNIT})"
SPAN_DASH = rf"(?:от\s+)?({NUMBER})\s*[-–—−]\s*({NUMBER})\s*({UNIT})"
SINGLE = rf"([<>≤≥])?\s*({NUMBER})\s*({UNIT})"
#: Any case, and Unicode letters, digits and blanks.
FLAGS = "(?iU)"
#: Marks around a hit and between its fields, and the kinds of hits.
OPEN, CLOSE, FIELD, RANGE, ONE = "\u0001", "\u0002", "\u0003", "R", "S"

CONSTRAINT = "param string, op string, value double, value_max double, unit string, norm_value double, norm_unit string, source_text string"


@dataclass(frozen=True)
class Constraint:
    param: str
    op: str
    value: float
    value_max: float | None
    unit: str
    norm_value: float
    norm_unit: str
    source_text: str


def has_constraint(text: Column) -> Column:
    """Whether a number stands in front of a unit."""
    return text.rlike(rf"{FLAGS}\d\s*(?:{UNIT})")


def pieces(text: Column) -> Column:
    """A text cut at its hits: what stands before the first one, the hit, what stands behind it, and so on.

    A hit is written as its fields: kind, lower number, upper number or sign, unit, and itself.
    """
    fields = lambda kind, *groups: OPEN + FIELD.join((kind, *groups, "$0")) + CLOSE
    plain = F.translate(text, OPEN + CLOSE + FIELD, "   ")
    # Groups of the form that didn't match are empty.
    spans = F.regexp_replace(plain, f"{FLAGS}{SPAN_WORDS}|{SPAN_DASH}", fields(RANGE, "$1$4", "$2$5", "$3$6"))
    marked = F.regexp_replace(spans, f"{FLAGS}{SINGLE}(?![^{OPEN}]*{CLOSE})", fields(ONE, "$2", "$1", "$3"))
    return F.split(marked, f"[{OPEN}{CLOSE}]")


def hits(cut: Column) -> Column:
    """Of ``pieces``: array of struct(start, fields), a hit and how many characters stand before it."""
    sizes = F.transform(cut, lambda p, i: F.length(F.when(i % 2 == 1, F.substring_index(p, FIELD, -1)).otherwise(p)))
    found = F.transform(cut, lambda p, i: F.when(i % 2 == 1, F.struct(F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda n, x: n + x).alias("start"), F.split(p, FIELD).alias("fields"))))
    return F.filter(found, lambda x: x.isNotNull())


def sentence_before(text: Column, at: Column, reach: int) -> Column:
    """Up to ``reach`` characters in front of place ``at``, from the last sentence's end in them."""
    return F.regexp_extract(F.substring(text, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach))), r"([^.!?;\n]*)\z", 1)


def beginnings(pattern: str) -> list[str]:
    """The letters that each alternative of a pattern begins with."""
    whole = re.sub(r"\(\?:[^)]*\)", "", pattern)
    return [re.match(r"(?:\\b)?(\w+?)(?=\\|$|\W)", x)[1].lower() for x in whole.split("|")]


def ends(before: Column, patterns: Sequence[str]) -> Column:
    """Where each pattern ends last in ``before``; 0 where it doesn't occur. Only patterns whose first letters occur are tried."""
    low = F.lower(before)
    upto = lambda p: F.regexp_extract(before, f"(?iUs)\\A.*(?:{p})", 0)
    tried = (F.when(reduce(Column.__or__, [low.contains(x) for x in beginnings(p)]), upto(p)).otherwise("") for p in patterns)
    # Functions on arrays keep the many patterns out of one generated method, which would be too long to be compiled.
    return F.transform(F.array(*tried), F.length)


def last_of(found: Column) -> Column:
    """Which pattern (from 1 on) ends last, the first such one where several do; 0 for none."""
    return F.when(F.array_max(found) > 0, F.array_position(found, F.array_max(found)).cast("int")).otherwise(0)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def constraint_table(chunks: DataFrame) -> DataFrame:
    """One row for each constraint of (chunk_id, text), numbered in ``ord`` by where they stand; null and blank texts give none."""
    found = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text").filter(has_constraint(F.col("text")))
    cut = found.withColumn("cut", pieces(F.col("text")))
    rows = cut.select("chunk_id", "text", F.posexplode(hits(F.col("cut"))).alias("ord", "hit")).select("chunk_id", "ord", "text", "hit.start", "hit.fields")
    text, start, field = F.col("text"), F.col("start"), lambda k: F.get("fields", F.lit(k))
    single = F.col("kind") == ONE
    rows = rows.select("chunk_id", "ord", "text", "start", field(0).alias("kind"), field(1).alias("low"), field(2).alias("second"), field(3).alias("raw_unit"), field(4).alias("piece"))
    # A range is looked up from its start on, a single number from the number on.
    rows = rows.withColumns({"sign": F.when(single, F.col("second")).otherwise(""), "high": F.when(~single, F.col("second")), "at": start + F.when(single, F.instr("piece", F.col("low")) - 1).otherwise(0)})
    piece = F.col("piece")
    rows = rows.withColumn("known", F.coalesce(*(F.when(F.col("raw_unit").rlike(rf"{FLAGS}\A(?:{p})\z"), F.lit(k)) for k, (p, _, _) in enumerate(UNITS))))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("known"))
    # Columns of their own, so that what several expressions read is worked out once.
    rows = rows.withColumns({"lead": sentence_before(text, F.col("at"), PARAMETER_REACH), "near": sentence_before(text, F.col("at"), OPERATOR_REACH)})
    # Phrases of one operator are one pattern; operators stand in the order of their first phrases.
    phrases = {op: "|".join(p for p, o in PHRASES if o == op) for _, op in PHRASES}
    rows = rows.withColumns({"lead_ends": ends(F.col("lead"), [p for p, _ in PARAMETERS]), "near_ends": ends(F.col("near"), list(phrases.values()))})
    rows = rows.withColumns({"lead_last": last_of(F.col("lead_ends")), "near_last": last_of(F.col("near_ends"))})
    free = next((k, p) for k, (p, name) in enumerate(PARAMETERS, 1) if name is None)
    named = F.get(F.array(F.lit(""), *(F.lit(n) for _, n in PARAMETERS)), F.col("lead_last"))
    of_name = F.when(F.col("lead_last") == free[0], F.concat(F.lit("содержание "), F.regexp_extract("lead", rf"(?iUs)\A.*(?:{free[1]})", 1))).otherwise(named)
    signed = F.coalesce(*(F.when(F.col("sign") == sign, F.lit(op)) for sign, op in SIGNS.items()))
    op = F.when(~single, "range").when(F.col("sign") != "", signed).otherwise(F.get(F.array(*map(F.lit, ["=", *phrases])), F.col("near_last")))
    first = F.greatest(start - BEFORE, F.lit(0))
    return rows.select(
        "chunk_id", "ord", of_name.alias("param"), op.alias("op"), parse_number(F.col("low")).alias("value"), parse_number(F.col("high")).alias("value_max"),
        trimmed(F.col("raw_unit")).alias("unit"), F.round(parse_number(F.col("low")) * pick([f for _, _, f in UNITS]), 6).alias("norm_value"), pick([u for _, u, _ in UNITS]).alias("norm_unit"),
        trimmed(F.substring(text, first + 1, start + F.length(piece) + AFTER - first)).alias("source_text"),
    )


def extract(text: str | None) -> list[Constraint]:
    """Constraints of one text in order of where they stand."""
    spark = SparkSession.builder.getOrCreate()
    one = spark.createDataFrame([("", text)], "chunk_id string, text string")
    names = list(Constraint.__dataclass_fields__)
    return [Constraint(*(r[c] for c in names)) for r in sorted(constraint_table(one).collect(), key=lambda r: r["ord"])]
