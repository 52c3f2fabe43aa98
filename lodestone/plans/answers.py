"""From a question to cited evidence, and what is shown of it. Plans stay lazy; only the answer's few rows are collected."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.functions import terms, text
from lodestone.operators import vector
from lodestone.operators.graph import CONTRADICTS, GraphTables
from lodestone.plans import templates

log = logging.getLogger("lodestone")


@dataclass(frozen=True)
class Citation:
    doc_id: str
    chunk_id: str
    title: str = ""
    year: int | None = None
    quote: str = ""

    def line(self) -> str:
        base = f"{self.title.strip() or self.doc_id} ({self.year or 'б/г'})"
        return f"{base} — «{self.quote.strip()}»" if self.quote.strip() else base


@dataclass
class Answer:
    question: str
    text: str
    found: bool
    citations: list[Citation] = field(default_factory=list)
    contradictions: list[tuple[str, str, Citation]] = field(default_factory=list)
    node_ids: list[str] = field(default_factory=list)


def event(code: str, detail: str, level: int = logging.INFO) -> None:
    """One JSON line to the log."""
    log.log(level, json.dumps({"event": code, "detail": detail[:500]}, ensure_ascii=False))


def evidence(g: GraphTables, intent: terms.Intent, thesaurus: terms.Thesaurus, question: Sequence[float] | None, top_k: int = 8, execute: Callable[..., dict[str, DataFrame]] = templates.execute) -> dict[str, DataFrame]:
    """Chunks (at most 12) from the graph and the vector search, and contradictions among the graph's nodes.

    Without a template, or where planning it fails (SEARCH-006), the vector side stands alone;
    without a vector (SEARCH-004) the graph does, in order of chunk ids; without both there are no chunks.
    """
    hits = vector.vector_search(g.chunks, question, top_k) if question is not None else g.chunks.select("*", F.lit(0.0).alias("score")).limit(0)
    found = None
    if intent.template != "rag_fallback":
        try:
            found = execute(g, intent.template, **terms.parameters(intent, thesaurus))
        except Exception as error:
            event("SEARCH-006", f"{intent.template}: {error}", logging.WARNING)
    order = lambda rows: rows.select("chunk_id", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")).alias("rank"))
    if found is None:
        event("SEARCH-001", intent.question)
        picked, pairs, nodes = order(hits).select("chunk_id", F.col("rank").alias("position")), None, None
    else:
        # The merge takes twelve at most, so the best twelve of the graph are enough for it.
        candidates = found["chunk_ids"].withColumn("ord", F.col("chunk_id"))
        scored = vector.rank_graph_chunks(candidates, hits, g.chunks, question) if question is not None else candidates.withColumn("score", F.lit(0.0))
        ranked = scored.orderBy(F.desc("score"), "chunk_id").limit(12)
        picked, pairs, nodes = vector.merge_with_quota(order(ranked), order(hits)), found["contradiction_pairs"], found["node_ids"]
    rows = picked.join(g.chunks.select("chunk_id", "doc_id", "text"), "chunk_id").join(g.documents.select("doc_id", "title", "year"), "doc_id", "left")
    rows = rows.select("position", "chunk_id", "doc_id", "title", "year", "text", text.quote(F.col("text")).alias("quote"))
    return {"chunks": rows, "contradictions": pairs, "node_ids": nodes}


def context_block(rows: Sequence[dict]) -> str:
    """Numbered fragments for a synthesis."""
    head = lambda r: f"{r.get('title') or r.get('doc_id') or '?'}{', ' + str(r['year']) if r.get('year') else ''}"
    return "\n\n".join(f"[Фрагмент {i}] ({head(r)}):\n{(r.get('text') or '').strip()}" for i, r in enumerate(rows, 1))


def extract(rows: Sequence[dict], sentences: int = 2) -> str:
    """The first sentences of every chunk, in place of a synthesis."""
    out = []
    for i, r in enumerate(rows, 1):
        start = ". ".join(s for s in (r.get("text") or "").strip().replace("\n", " ").split(". ")[:sentences] if s).strip()
        out.append(f"[{i}] {start + ('' if start.endswith(('.', '…', '!', '?')) else '…') if start else '(пустой фрагмент)'}")
    return "\n".join(out)


def answer(g: GraphTables, question: str, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], *, thesaurus: terms.Thesaurus | None = None, synthesise: Callable[[str, str], str] | None = None, top_k: int = 8, most_nodes: int = 5000, most_pairs: int = 200) -> Answer:
    """Route, collect evidence, synthesise (twice at most, else extracts) and cite.

    The driver gets twelve chunks, and ``most_nodes`` and ``most_pairs`` at most of the rest, in order of their ids.
    """
    thesaurus = thesaurus or terms.Thesaurus()
    intent = terms.route(question, thesaurus)
    try:
        asked = list(embed([question])[0])
    except Exception as error:  # a service may fail in any way
        event("SEARCH-004", str(error), logging.WARNING)
        asked = None
    found = evidence(g, intent, thesaurus, asked, top_k)
    rows = [r.asDict() for r in found["chunks"].orderBy("position").collect()]
    nodes = [r.id for r in found["node_ids"].orderBy("id").limit(most_nodes).collect()] if found["node_ids"] is not None else []
    if not rows:
        return Answer(question, "в корпусе не найдено", False, node_ids=nodes)
    said = None
    for asked in (question, f"Кратко и по фактам, без рассуждений: {question}") if synthesise else ():
        try:
            said = synthesise(asked, context_block(rows))
            break
        except Exception as error:  # a model may fail in any way
            event("SEARCH-005", str(error), logging.WARNING)
    if said is None:
        event("SEARCH-007", question, logging.WARNING)
        said = extract(rows)
    cite = lambda r: Citation(r["doc_id"] or "", r["chunk_id"], r["title"] or "", r["year"], r["quote"] or "")
    against = []
    if found["contradictions"] is not None:
        known = g.chunks.select("chunk_id", F.col("text")).join(found["contradictions"].select("chunk_id").distinct(), "chunk_id", "left_semi")
        pairs = found["contradictions"].join(known, "chunk_id", "left").join(g.documents.select("doc_id", "title", "year"), "doc_id", "left").withColumn("quote", text.quote(F.col("text")))
        against = [(r.name_a or r.node_a_id, r.name_b or r.node_b_id, cite(r.asDict())) for r in pairs.orderBy("node_a_id", "node_b_id", "chunk_id").limit(most_pairs).collect()]
    return Answer(question, said, True, [cite(r) for r in rows], against, nodes)


def between_years(rows: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of these years; a row without a year stays."""
    inside = F.lit(True)
    if first is not None:
        inside = inside & (F.col("year") >= first)
    if last is not None:
        inside = inside & (F.col("year") <= last)
    return rows.filter(F.col("year").isNull() | inside)


def shown_nodes(nodes: DataFrame, types: Sequence[str] | None, most: int = 60) -> DataFrame:
    """The ``most`` most mentioned nodes of the types, ties by id."""
    kept = nodes if types is None else nodes.filter(F.col("type").isin(*types))
    rank = [F.desc_nulls_last("n_mentions")] if "n_mentions" in nodes.columns else []
    return kept.orderBy(*rank, "id").limit(most)


def shown_edges(edges: DataFrame, nodes: DataFrame, least: float = 0.0) -> DataFrame:
    """Edges between shown nodes with enough confidence; contradictions always."""
    ids = nodes.select("id").distinct()
    inside = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    return inside.filter((F.col("type") == CONTRADICTS) | (F.coalesce("confidence", F.lit(0.0)) >= least))


def answer_markdown(a: Answer) -> str:
    lines = [f"# {a.question}", ""]
    if not a.found:
        lines += ["> В корпусе не найдено прямого ответа.", ""]
    lines += [a.text, ""]
    if a.citations:
        lines += ["## Источники", "", *(f"{i}. {c.line()}" for i, c in enumerate(a.citations, 1)), ""]
    if a.contradictions:
        lines += ["## Противоречия в источниках", ""]
        for i, (x, y, c) in enumerate(a.contradictions, 1):
            lines += [f"{i}. «{x}» **противоречит** «{y}»", f"   - {c.line()}"]
    return "\n".join(lines)


def gap_markdown(cells: Sequence[dict], only_ru: Sequence[str] = (), only_foreign: Sequence[str] = ()) -> str:
    lines = ["# Карта пробелов", "", "| Материал | Процесс | Условие | Источников | Пробел |", "|---|---|---|---|---|"]
    lines += [f"| {c['material']} | {c['process']} | {c.get('condition') or '—'} | {c['n_sources']} | {'нет' if c['n_sources'] else '**да**'} |" for c in cells]
    for title, topics in (("Темы только в отечественной литературе", only_ru), ("Темы только в зарубежной литературе", only_foreign)):
        if topics:
            lines += ["", f"## {title}", "", *(f"- {t}" for t in topics)]
    return "\n".join(lines)


class AnswerCache:
    """Answers by normalised question, in a JSON file that is replaced as a whole."""

    def __init__(self, path: str):
        self.path = path

    @staticmethod
    def key(question: str) -> str:
        return " ".join(question.lower().split()).rstrip("?!.… ")

    def _all(self) -> dict:
        import os

        if not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def get(self, question: str) -> str | None:
        return self._all().get(self.key(question))

    def put(self, question: str, markdown: str) -> None:
        import os

        held = self._all() | {self.key(question): markdown}
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(held, f, ensure_ascii=False)
        os.replace(f"{self.path}.new", self.path)
