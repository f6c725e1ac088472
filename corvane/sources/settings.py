"""Settings from the environment and an optional .env file."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from functools import lru_cache
from pathlib import Path


def _list(value: str | list[str]) -> list[str]:
    return [x for x in (p.strip() for p in value.split(",")) if x] if isinstance(value, str) else list(value)


@dataclass(frozen=True)
class Settings:
    """One field per setting; names are matched without regard to case, unknown ones are ignored. A model without an address is the engine's own; without webhook_secret no event is taken."""

    wiki_base_url: str = ""
    wiki_token: str = ""
    space_allowlist: list[str] = field(default_factory=list)
    catalog_dir: str = "catalog"
    state_dir: str = "state"
    llm_base_url: str = ""
    llm_api_key: str = ""
    llm_model: str = ""
    llm_max_tokens: int = 1500
    llm_temperature: float = 0.0
    llm_disable_thinking: bool = True
    embed_base_url: str = ""
    embed_api_key: str = ""
    embed_model: str = ""
    embed_dim: int = 1024
    embed_batch: int = 64
    rerank_url: str = ""
    rerank_api_key: str = ""
    rerank_model: str = ""
    chunk_max_tokens: int = 512
    chunk_hard_max_tokens: int = 5000
    retrieve_top_k: int = 20
    rerank_top_n: int = 5
    rerank_score_min: float = 0.3
    webhook_secret: str = ""
    log_level: str = "INFO"

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None, dotenv: str | None = ".env") -> Settings:
        """The environment goes before the file. wiki_pat is another name of wiki_token."""
        given: dict[str, str] = {}
        if dotenv and Path(dotenv).is_file():
            for line in Path(dotenv).read_text("utf-8").splitlines():
                key, sep, value = line.partition("=")
                if sep and not key.lstrip().startswith("#"):
                    given[key.strip().lower()] = value.strip().strip("'\"")
        given |= {k.lower(): v for k, v in (os.environ if env is None else env).items()}
        given.setdefault("wiki_token", given.get("wiki_pat", ""))
        out: dict = {}
        for f in fields(cls):
            if (raw := given.get(f.name)) is None:
                continue
            kind = str(f.type)
            if kind.startswith("list"):
                out[f.name] = _list(raw)
            elif kind == "bool":
                out[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif kind in ("int", "float"):
                out[f.name] = {"int": int, "float": float}[kind](raw)
            else:
                out[f.name] = raw.rstrip("/") if f.name.endswith("_url") else raw
        return cls(**out)


@lru_cache(1)
def settings() -> Settings:
    return Settings.read()
