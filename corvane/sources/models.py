"""Models behind HTTP as functions of columns: embeddings, reranker, chat. Each request is one Arrow batch's share."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.answer import SYSTEM_PROMPT, user_message
from .retry import HttpError, with_retries
from .settings import Settings

#: Seconds that a request may take; a fixed value.
TIMEOUT = 30.0


def post(url: str, body: dict, key: str = "", timeout: float = TIMEOUT) -> dict:
    """POST JSON and read JSON; with a key as bearer token. What may pass is tried again."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})

    def once() -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return json.load(response)
        except urllib.error.HTTPError as error:
            raise HttpError(error.code, url) from error

    return with_retries(once)


def remote_embedding(s: Settings):
    """text to array<float>: POST {embed_base_url}/embeddings, embed_batch texts a request."""
    url, model, key, size = f"{s.embed_base_url}/embeddings", s.embed_model, s.embed_api_key, s.embed_batch

    def embed(text: Column) -> Column:
        def vectors(texts: pd.Series) -> pd.Series:
            out: list = []
            given = texts.fillna("").tolist()
            for lo in range(0, len(given), size):
                data = post(url, {"model": model, "input": given[lo : lo + size]}, key)["data"]
                out += [d["embedding"] for d in data]
            return pd.Series(out, index=texts.index, dtype=object)

        return pandas_udf(vectors, "array<float>").asNondeterministic()(text)

    return embed


def remote_score(s: Settings):
    """(question, text) to a relevance: POST {model, query, documents} to rerank_url, one request for the candidates of a question in a batch."""
    url, model, key = s.rerank_url, s.rerank_model, s.rerank_api_key

    def score(question: Column, text: Column) -> Column:
        def relevance(questions: pd.Series, texts: pd.Series) -> pd.Series:
            out = pd.Series(float("nan"), index=questions.index)
            for q, at in questions.groupby(questions).groups.items():
                found = post(url, {"model": model, "query": q, "documents": texts.loc[at].fillna("").tolist()}, key)["results"]
                for r in found:
                    out[at[int(r["index"])]] = float(r["relevance_score"])
            return out

        return pandas_udf(relevance, "double").asNondeterministic()(question, text)

    return score


def remote_generate(s: Settings):
    """(question, context) to an answer: POST {llm_base_url}/chat/completions, one request a question. A null context asks nothing."""
    url, key = f"{s.llm_base_url}/chat/completions", s.llm_api_key
    fixed: dict = {"model": s.llm_model, "max_tokens": s.llm_max_tokens, "temperature": s.llm_temperature}
    if s.llm_disable_thinking:
        fixed["chat_template_kwargs"] = {"enable_thinking": False}

    def generate(question: Column, context: Column) -> Column:
        def replies(messages: pd.Series) -> pd.Series:
            def one(message: str | None) -> str | None:
                if message is None:
                    return None
                said = [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": message}]
                return post(url, fixed | {"messages": said}, key)["choices"][0]["message"]["content"]

            return messages.map(one)

        return pandas_udf(replies, "string").asNondeterministic()(user_message(question, context))

    return generate


def models_of(s: Settings) -> dict:
    """The models that settings name, as arguments of the engine; what has no address keeps the engine's default."""
    given = {"embed": (s.embed_base_url, remote_embedding), "score": (s.rerank_url, remote_score), "generate": (s.llm_base_url, remote_generate)}
    return {name: make(s) for name, (address, make) in given.items() if address}


__all__ = ["F", "models_of", "post", "remote_embedding", "remote_generate", "remote_score"]
