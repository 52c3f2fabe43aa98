"""Catalog cards: periods, years, kinds, titles and descriptions from folder names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import short_sha1
from lodestone.sources.corpus import cards

# Names of periods, bounds of years, roots and topics of folders.
MONTHS = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")
PERIODS = (*MONTHS, "годовые издания", "дневные издания", "ежемесячные издания", "квартальные издания", "недельные издания", "quaterly", "quarterly", "q1", "q2", "q3", "q4")
ENGLISH_MONTH = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*\d{0,4}$"
FIRST_YEAR, LAST_YEAR = 1980, 2026
JOURNALS, MARKET, TOPIC = "Журналы", ("МПГ", "Источники данных"), r"(?iu)^Источники данных о (.+)$"


def is_period(name: Column) -> Column:
    """A year, a month, a quarter or another period of a publication."""
    n = F.trim(name)
    return n.rlike(r"^(19\d{2}|20\d{2})([-\s].*)?$") | F.lower(n).isin(*PERIODS) | n.rlike(ENGLISH_MONTH)


def card_of(folder: Column) -> Column:
    """The folder without the period names at its end; its first part always stays."""
    parts = F.split(folder, "/")
    last = F.array_max(F.transform(parts, lambda x, i: F.when((i == 0) | ~is_period(x), i).otherwise(0)))
    return F.array_join(F.slice(parts, F.lit(1), last + 1), "/")


def years(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(19\d{2}|20\d{2})"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(FIRST_YEAR, LAST_YEAR))


def kind(path: Column) -> Column:
    market = F.lit(False)
    for word in MARKET:
        market = market | path.contains(word)
    return F.when(F.substring_index(path, "/", 1) == JOURNALS, "journal").when(market, "market_analytics").otherwise("conference")


def title(path: Column, of: Column) -> Column:
    parts, name = F.split(path, "/"), F.substring_index(path, "/", -1)
    topic = F.coalesce(F.get(F.filter(F.transform(parts, lambda p: F.regexp_extract(p, TOPIC, 1)), lambda t: t != ""), 0), F.when(F.array_contains(parts, MARKET[0]), MARKET[0]))
    market = F.when(topic.isNull(), F.concat(F.lit("Рыночная аналитика: "), name)).otherwise(F.concat(F.lit("Рыночная аналитика "), topic, F.lit(": "), name))
    meeting = F.concat(F.lit("Конференция "), F.regexp_replace(F.regexp_replace(F.trim(name), ",+$", ""), r"\s+", " "))
    return F.when(of == "journal", F.concat(F.lit("Журнал «"), name, F.lit("»"))).when(of == "market_analytics", market).when(F.size(parts) == 1, "Материалы конференций: отдельные документы").otherwise(meeting)


def files_word(n: Column) -> Column:
    return F.when((n % 10 == 1) & (n % 100 != 11), "файл").when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), "файла").otherwise("файлов")


def entries(paths: DataFrame) -> DataFrame:
    """Cards of (path): files count for the deepest card above them; cards without files of their own are left out."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    folders = paths.select(card_of(folder).alias("card")).distinct()
    counted = cards(paths, folders).filter("n_files > 0")
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("card"))
    own = above.join(folders, "card").groupBy("path").agg(F.max_by("card", F.length("card")).alias("card"))
    seen = own.select("card", F.explode(years(F.col("path"))).alias("y")).groupBy("card").agg(F.min("y").alias("year_from"), F.max("y").alias("year_to"))
    rows = counted.join(seen, "card", "left").withColumn("kind", kind(F.col("card"))).withColumn("title", title(F.col("card"), F.col("kind")))
    when = F.when(F.col("year_from").isNull(), "год не определён").when(F.col("year_from") != F.col("year_to"), F.concat(F.lit("выпуски "), F.col("year_from").cast("string"), F.lit("–"), F.col("year_to").cast("string"))).otherwise(F.concat(F.col("year_from").cast("string"), F.lit(" год")))
    description = F.concat("title", F.lit(", "), when, F.lit(", "), F.col("n_files").cast("string"), F.lit(" "), files_word(F.col("n_files")), F.lit(". Содержимое не индексировано, метаданные по названию."))
    return rows.select(short_sha1(F.col("card")).alias("catalog_id"), F.col("card").alias("path"), "title", "kind", "year_from", "year_to", F.col("n_files").cast("int").alias("n_files"), description.alias("description"))
