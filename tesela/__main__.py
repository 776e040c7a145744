"""python -m tesela index|sync|dry-run|ask|eval|sweep|watch --corpus DIR --store DIR, with the offline stand-ins.

ask takes --question TEXT, once for each; eval and sweep take --cases FILE, sweep also --alpha WEIGHT, once for each; watch ends with Ctrl+C.
"""

from __future__ import annotations

import argparse
import json

from tesela.operators.evaluation import evaluation_report
from tesela.plans.service import Service
from tesela.session import local_session
from tesela.sources.cases import load_questions

#: Weights that a sweep compares if none are given.
ALPHAS = (0.0, 0.3, 0.5, 0.7, 1.0)


def main() -> None:
    ap = argparse.ArgumentParser(prog="tesela", description=__doc__)
    ap.add_argument("command", choices=["index", "sync", "dry-run", "ask", "eval", "sweep", "watch"])
    ap.add_argument("--corpus", required=True)
    ap.add_argument("--store", required=True)
    ap.add_argument("--question", action="append", default=[])
    ap.add_argument("--cases")
    ap.add_argument("--alpha", action="append", type=float, default=[])
    args = ap.parse_args()
    if args.command in ("eval", "sweep") and not args.cases:
        ap.error("--cases is missing")
    spark = local_session()
    service = Service(spark, args.store, args.corpus)
    if args.command == "ask":
        asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(args.question)], "query_id string, question string")
        for line in service.ask(asked).toJSON().collect():
            print(line)
    elif args.command == "eval":
        scored = service.evaluate(load_questions(spark, args.cases))
        for line in [*scored.toJSON().collect(), *evaluation_report(scored).toJSON().collect()]:
            print(line)
    elif args.command == "sweep":
        for line in service.compare(load_questions(spark, args.cases), {service.settings.llm_model: service.completer}, args.alpha or ALPHAS).toJSON().collect():
            print(line)
    elif args.command == "watch":
        service.watch(f"{args.store.rstrip('/')}/watch").awaitTermination()
    elif args.command == "dry-run":
        service.state().orderBy("status", "source").show(1000, truncate=False)
    else:
        print(json.dumps(service.index() if args.command == "index" else service.sync()))
    spark.stop()


if __name__ == "__main__":
    main()
