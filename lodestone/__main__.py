"""``python -m lodestone``: route a question, run a registered query, or convert a corpus."""

from __future__ import annotations

import argparse
import dataclasses
import json
from datetime import date

from lodestone import session
from lodestone.functions import terms
from lodestone.plans import registry, runs


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    steps = parser.add_subparsers(dest="step", required=True)
    route = steps.add_parser("route", help="template, slots and filters of a question")
    route.add_argument("question")
    query = steps.add_parser("query", help="rows of a registered query as JSON lines")
    query.add_argument("name", choices=sorted(registry.queries()))
    query.add_argument("tables", help="folder of Parquet tables")
    query.add_argument("--limit", type=int, default=20)
    ingest = steps.add_parser("ingest", help="files of a corpus to documents, texts, chunks and skipped")
    ingest.add_argument("folder")
    ingest.add_argument("out")
    ingest.add_argument("--core", nargs="+", required=True, help="folders right below that hold the files")
    given = parser.parse_args(argv)
    spark = session.prepare(session.local_session())
    if given.step == "route":
        intent = terms.route(given.question)
        print(json.dumps(dataclasses.asdict(intent), ensure_ascii=False))
    elif given.step == "query":
        for row in registry.queries()[given.name](spark, given.tables).limit(given.limit).toJSON().toLocalIterator():
            print(row)
    else:
        for name, rows in runs.corpus_run(spark, given.folder, tuple(given.core), given.out, this_year=date.today().year).items():
            print(json.dumps({"table": name, "rows": rows.count()}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
