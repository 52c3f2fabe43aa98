"""The thesaurus, and the routing of questions to templates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.functions.constraints import Constraint, extract
from lodestone.operators.graph import ENTITY_TYPES

# Terms that the templates' slots name, with synonyms; a whole thesaurus comes from a file.
DEFAULT_TERMS = (
    ("обессоливание", "Process", ("десалинация", "desalination", "обессоливание воды", "деминерализация воды", "demineralization")),
    ("минерализация", "Property", ("минерализация воды", "общая минерализация", "сухой остаток", "солесодержание", "total dissolved solids", "TDS", "dry residue")),
    ("обратный осмос", "Process", ("reverse osmosis", "RO", "гиперфильтрация")),
    ("электродиализ", "Process", ("electrodialysis", "ED")),
    ("нанофильтрация", "Process", ("nanofiltration", "NF")),
    ("католит", "Material", ("catholyte",)),
    ("электроэкстракция", "Process", ("electrowinning",)),
    ("электролиз", "Process", ("electrolysis",)),
    ("штейн", "Material", ("matte",)),
    ("шлак", "Material", ("slag",)),
    ("платиноиды", "Material", ("МПГ", "PGM")),
    ("золото", "Material", ("gold", "Au")),
    ("серебро", "Material", ("silver", "Ag")),
    ("шахтные воды", "Material", ("mine water",)),
    ("закачка шахтных вод", "Process", ("mine water injection",)),
)
# Topics of questions, in order of precedence.
TOPICS = (
    ("desalination_methods", r"обессолив|десалинац|опреснен|обратн\w*\s+осмос|электродиализ|нанофильтрац|demineraliz|desalinat|reverse\s+osmosis|electrodialysis|nanofiltration"),
    ("catholyte_circulation", r"католит|электроэкстракц|электровыделен\w*\s+никел|catholyte|electrowinning"),
    ("experiments_publications_by_topic", r"штейн|шлак|мпг\b|платино\w*\s+метал|платиноид|\bmatte\b|\bslag\b|\bpgm\b|platinum\s+group"),
    ("mine_water_injection", r"шахтн\w*\s+вод|рудничн\w*\s+вод|закачк\w*.{0,20}(вод|горизонт|скважин)|глубок\w*\s+горизонт|mine\s*.?water|underground\s+injection"),
)
# Canonical terms of each template's slots.
SLOTS = {
    "desalination_methods": {"process": ("обессоливание", "обратный осмос", "электродиализ", "нанофильтрация"), "property": ("минерализация",)},
    "catholyte_circulation": {"material": ("католит",), "process": ("электроэкстракция", "электролиз")},
    "experiments_publications_by_topic": {"material": ("штейн", "шлак", "платиноиды", "золото", "серебро")},
    "mine_water_injection": {"process": ("закачка шахтных вод",), "material": ("шахтные воды",)},
}
# Markers of geography and years.
COMPARE = r"в\s+росси\w*\s+и\s+за\s+рубеж|миров\w*\s+практик|миров\w*\s+опыт|сравни"
FOREIGN = r"зарубежн\w*|за\s+рубеж\w*"
DOMESTIC = r"отечественн\w*|российск\w*\s+практик|\bросси\w*\b"
YEARS = (r"((?:19|20)\d{2})\s*[–\-—]\s*((?:19|20)\d{2})", r"последн\w*\s+(\d+)\s*(?:лет|год\w*)", r"\bс\s+((?:19|20)\d{2})\b")


#: Names of a thesaurus that are sent to all executors at most; a larger one is joined by its key.
MOST_BROADCAST = 100_000


class Thesaurus:
    """Canonical terms with synonyms; look-ups ignore case, and a later record wins a shared name."""

    def __init__(self, records: Iterable[tuple[str, str, Sequence[str]]] = DEFAULT_TERMS):
        self.records = {c: (kind, tuple(s)) for c, kind, s in records}
        if bad := sorted({k for k, _ in self.records.values()} - set(ENTITY_TYPES)):
            raise ValueError(f"GRAPH-003: no entity type {', '.join(bad)}")
        self.index = {name.strip().lower(): c for c, (_, s) in self.records.items() for name in (c, *s)}

    @classmethod
    def from_yaml(cls, path: str) -> Thesaurus:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls((t["canonical"], t["type"], t.get("synonyms") or ()) for t in yaml.safe_load(f)["terms"])

    def canonical(self, term: str) -> str | None:
        return self.index.get(term.strip().lower())

    def expand(self, term: str, least: int = 1) -> list[str]:
        """The term, its canonical name and all synonyms, lower-cased and in order."""
        term = term.strip()
        if not term:
            return []
        canon = self.canonical(term) or term
        return sorted({x.lower() for x in (term, canon, *self.records.get(canon, ("", ()))[1]) if len(x) >= least})

    def expand_all(self, terms: Iterable[str], least: int = 1) -> list[str]:
        return sorted({x for t in terms for x in self.expand(t, least)})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.index.items()), "key string, canonical string")

    def expanded(self, rows: DataFrame, column: str, out: str) -> DataFrame:
        """``rows`` with the terms of a column expanded: itself, its canonical name and all synonyms, lower-cased and in order."""
        names = [(key, sorted({x.lower() for x in (canon, *self.records[canon][1])})) for key, canon in sorted(self.index.items())]
        known = rows.sparkSession.createDataFrame(names, "__key string, __names array<string>")
        known = F.broadcast(known) if len(names) <= MOST_BROADCAST else known
        own = F.lower(F.trim(F.col(column)))
        every = F.array_sort(F.array_union(F.coalesce("__names", F.array().cast("array<string>")), F.array(own)))
        return rows.join(known, own == F.col("__key"), "left").withColumn(out, F.when(own != "", every).otherwise(F.array().cast("array<string>"))).drop("__key", "__names")

    def canonicalised(self, rows: DataFrame, column: str, out: str) -> DataFrame:
        """``rows`` with the canonical name of a column, or the name itself."""
        known = self.table(rows.sparkSession).withColumnRenamed("canonical", "__canonical")
        known = F.broadcast(known) if len(self.index) <= MOST_BROADCAST else known
        return rows.join(known, F.lower(F.trim(F.col(column))) == F.col("key"), "left").withColumn(out, F.coalesce("__canonical", column)).drop("key", "__canonical")


@dataclass(frozen=True)
class Intent:
    question: str
    template: str
    slots: dict[str, str] = field(default_factory=dict)
    year_from: int | None = None
    year_to: int | None = None
    geography: str | None = None
    compare_geography: bool = False
    numeric: tuple[Constraint, ...] = ()


def term_pattern(term: str) -> str:
    """A term in any inflection: every word without its last letters (two of over five, one of four or five)."""
    return r"\b" + r"\s+".join(re.escape(w[: len(w) - (len(w) > 3) - (len(w) > 5)]) + r"\w*" for w in term.lower().split())


def slot_table(thesaurus: Thesaurus) -> list[tuple[str, str, str, str]]:
    """(template, slot, canonical term, pattern of all its names) in order of preference."""
    names = lambda canon: [n for n in (canon, *thesaurus.records.get(canon, ("", ()))[1]) if n.strip()]
    return [(t, slot, canon, "|".join(map(term_pattern, names(canon)))) for t, slots in SLOTS.items() for slot, canons in slots.items() for canon in canons]


def routed(questions: DataFrame, column: str = "question", *, thesaurus: Thesaurus | None = None, this_year: int) -> DataFrame:
    """``questions`` with template, slots (a column each, null where nothing fits), year_from, year_to, geography and compare_geography.

    Column expressions only: a question is scanned once for each pattern. Null questions go to ``rag_fallback``.
    """
    q = F.coalesce(F.col(column), F.lit(""))
    says = lambda pattern: q.rlike(f"(?iU){pattern}")
    rows = questions.withColumn("template", F.coalesce(*(F.when(says(p), t) for t, p in TOPICS), F.lit("rag_fallback")))
    by_slot: dict[str, list[Column]] = {}
    for template, slot, canon, pattern in slot_table(thesaurus or Thesaurus()):
        by_slot.setdefault(slot, []).append(F.when((F.col("template") == template) & says(pattern), canon))
    number = lambda k, group: F.regexp_extract(q, f"(?iU){YEARS[k]}", group).try_cast("int")
    compare, foreign, domestic = (says(p) for p in (COMPARE, FOREIGN, DOMESTIC))
    both = compare | (foreign & domestic)
    return rows.withColumns({slot: F.coalesce(*found) for slot, found in by_slot.items()} | {
        "year_from": F.coalesce(number(0, 1), this_year + 1 - number(1, 1), number(2, 1)),
        "year_to": number(0, 2),
        "geography": F.when(both, None).when(foreign, "foreign").when(domestic, "ru"),
        "compare_geography": both,
    })


def route(question: str, thesaurus: Thesaurus | None = None, today: date | None = None) -> Intent:
    """The template that one question's topic names (or rag_fallback), its slots and filters."""
    one = SparkSession.builder.getOrCreate().createDataFrame([(question,)], "question string")
    r = routed(one, thesaurus=thesaurus, this_year=(today or date.today()).year).first()
    slots = {s: r[s] for s in SLOTS.get(r.template, {}) if r[s] is not None}
    return Intent(question, r.template, slots, r.year_from, r.year_to, r.geography, r.compare_geography, tuple(extract(question)))


#: Arguments of the templates: terms of a slot, terms of the first slot that is filled, parameters named by the question or else a default, or a filter.
ARGUMENTS = {
    "desalination_methods": {"process_terms": ("slot", "process"), "param_terms": ("named", "минерализация"), "limit": 30},
    "catholyte_circulation": {"material_terms": ("slot", "material"), "param_terms": ("named", "скорость потока"), "limit": 30},
    "experiments_publications_by_topic": {"material_terms": ("slot", "material"), "year": ("filter", "year_from"), "limit": 30},
    "mine_water_injection": {"process_terms": ("slot", "process"), "material_terms": ("slot", "material"), "param_terms": ("named", None), "limit": 30},
    "compare_ru_foreign": {"terms": ("any", "topic process material"), "limit": 50},
    "gap_matrix": {"material_terms": ("slot", "material"), "process_terms": ("slot", "process"), "limit": 30},
}


def parameters(intent: Intent, thesaurus: Thesaurus) -> dict:
    """Arguments of the intent's template."""
    if intent.template not in ARGUMENTS:
        raise ValueError(f"SEARCH-008: no template {intent.template!r}")
    filled = {k: v for k, v in intent.slots.items() if v.strip()}
    named = sorted({c.param.strip().lower() for c in intent.numeric} - {""})
    read = {
        "slot": lambda k: thesaurus.expand_all([filled[k]] if k in filled else SLOTS.get(intent.template, {}).get(k, ())),
        "named": lambda default: named or (thesaurus.expand(default) if default else []),
        "any": lambda keys: thesaurus.expand(next((filled[k] for k in keys.split() if k in filled), "")),
        "filter": lambda field: getattr(intent, field),
    }
    return {name: read[how[0]](how[1]) if isinstance(how, tuple) else how for name, how in ARGUMENTS[intent.template].items()}
