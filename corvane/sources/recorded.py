"""A wiki from a folder of recorded pages, with the answers of the REST API: pages.jsonl has a raw page a line, restrictions.jsonl {"id", ...}."""

from __future__ import annotations

import json
import re
from pathlib import Path

from .retry import HttpError


def _lines(path: Path) -> list[dict]:
    return [json.loads(x) for x in path.read_text("utf-8").splitlines() if x.strip()] if path.is_file() else []


def recorded_fetch(folder: str):
    pages = _lines(Path(folder, "pages.jsonl"))
    restrictions = {str(r["id"]): r for r in _lines(Path(folder, "restrictions.jsonl"))}

    def listing(rows: list[dict], params: dict) -> dict:
        start, limit = int(params.get("start", 0)), int(params.get("limit", 50))
        part = rows[start : start + limit]
        return {"results": part, "size": len(part), "_links": {"next": "more"} if start + limit < len(rows) else {}}

    def fetch(path: str, params: dict) -> dict:
        if path == "/rest/api/content":
            rows = [p for p in pages if p["space"]["key"] == params["spaceKey"]]
            if not rows:
                raise HttpError(404, path)
            return listing([p for p in rows if p.get("type", "page") == "page" and p.get("status", "current") == "current"], params)
        if path == "/rest/api/content/search":
            since, keys = re.search(r'>= "([^"]*)"', params["cql"])[1], re.findall(r'"([^"]*)"', params["cql"].partition(" and lastModified")[0])
            rows = [p for p in pages if p["space"]["key"] in keys and p["version"]["when"] >= since]
            return listing(sorted(rows, key=lambda p: p["version"]["when"]), params)
        m = re.fullmatch(r"/rest/api/content/([^/]+)(/restriction/byOperation/read)?", path)
        if m and m[2]:
            if "status" in restrictions.get(m[1], {}):  # a recorded failure
                raise HttpError(restrictions[m[1]]["status"], path)
            return restrictions.get(m[1], {"restrictions": {"user": {"size": 0, "results": []}, "group": {"size": 0, "results": []}}})
        found = [p for p in pages if m and str(p["id"]) == m[1]]
        if not found:
            raise HttpError(404, path)
        return found[0]

    return fetch
