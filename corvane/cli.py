"""python -m corvane.cli sync [--since T] [--recreate] [--no-index] | reindex | evaluate --dataset F [--k N] [--top-k N] | serve"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .sources.files import read_jsonl
from .sources.settings import settings


def configure_logging(level: str = "INFO") -> None:
    """Once, however often it is called."""
    root = logging.getLogger("corvane")
    if not root.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        root.addHandler(handler)
    root.setLevel(level)


def main(args: list[str] | None = None, engine: Engine | None = None) -> int:
    """0 if all went well, 1 with errors in single pages, 2 if the scan broke off."""
    parser = argparse.ArgumentParser(prog="corvane", description=__doc__)
    parser.add_argument("--recorded", help="a folder of recorded pages in place of the wiki")
    sub = parser.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sync")
    s.add_argument("--since")
    s.add_argument("--recreate", action="store_true")
    s.add_argument("--no-index", action="store_true")
    sub.add_parser("reindex")
    e = sub.add_parser("evaluate")
    e.add_argument("--dataset", required=True)
    e.add_argument("--k", type=int, default=5)
    e.add_argument("--top-k", type=int)
    v = sub.add_parser("serve")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8000)
    a = parser.parse_args(args)
    config = settings()
    configure_logging(config.log_level)
    log = logging.getLogger("corvane.cli")
    engine = engine or Engine(SparkSession.builder.appName("corvane").getOrCreate(), config, recorded=a.recorded)
    if a.command in ("sync", "reindex"):
        try:
            counted = engine.run_sync(since=getattr(a, "since", None), index=not getattr(a, "no_index", False), recreate=a.command == "reindex" or a.recreate)
        except Exception as error:
            log.error("the scan broke off: %s", error)
            return 2
        log.info("%s", counted)
        return int(counted["errors"] > 0)
    if a.command == "evaluate":
        rows, misses = engine.evaluate(read_jsonl(engine.spark, a.dataset), a.k, a.top_k)
        for row in rows.collect():
            print(f"reranker {row['reranker']}: hit rate@{a.k} {row['hit_rate']:.3f}, MRR {row['mrr']:.3f}")
        for row in misses.orderBy("reranker", "qid").toLocalIterator():
            print(f"missed, reranker {row['reranker']}: rank {row['first'] or '-'}: {row['question']} (wanted {', '.join(row['gold_page_ids'])})")
        return 0
    from .service import serve

    serve(engine, a.host, a.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
