"""The engine over HTTP: POST /query, GET /health, POST /webhook. Requests are dealt with one at a time."""

from __future__ import annotations

import json
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

from .engine import Engine
from .streaming.events import DELETE, authorised, routed


def handle(engine: Engine, method: str, path: str, headers: dict[str, str], body: bytes) -> tuple[int, dict]:
    """Status and answer of a request."""
    where = urllib.parse.urlsplit(path)
    spark = engine.spark
    if (method, where.path) == ("GET", "/health"):
        found = engine.health()
        return (200 if found["status"] == "ok" else 503), found
    try:
        payload = json.loads(body or b"{}")
    except ValueError:
        return 400, {"detail": "not JSON"}
    if (method, where.path) == ("POST", "/query"):
        question = str((payload if isinstance(payload, dict) else {}).get("question") or "").strip()
        if not question:
            return 422, {"detail": "question must not be empty"}
        row = engine.answer(spark.createDataFrame([(0, question)], "qid int, question string")).first()
        return 200, {"answer": row["answer"], "citations": [c.asDict() for c in row["citations"]], "used_context": row["used_context"]}
    if (method, where.path) == ("POST", "/webhook"):
        secret = urllib.parse.parse_qs(where.query).get("secret", [None])[0]
        lower = {k.lower(): v for k, v in headers.items()}
        if not authorised(lower.get("x-webhook-secret"), secret, engine.settings.webhook_secret):
            return 401, {"detail": "wrong secret"}
        event = routed(spark.createDataFrame([(json.dumps(payload),)], "value string")).first()
        if event["page_id"] is None:
            return 422, {"detail": "no page id"}
        ids = spark.createDataFrame([(event["page_id"],)], "page_id string")
        if event["action"] == DELETE:
            engine.delete_pages(ids)
            return 200, {"status": "deleted", "page_id": event["page_id"]}
        return 200, {"status": "synced", "page_id": event["page_id"], "stats": engine.sync_pages(ids)}
    return 404, {"detail": "not found"}


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, answer = handle(engine, self.command, self.path, dict(self.headers), body)
            data = json.dumps(answer, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

    HTTPServer((host, port), Handler).serve_forever()
