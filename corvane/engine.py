"""The engine as one object: crawl, index, search, answer, evaluate."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .operators import answer, evaluate, extract, rerank, search, sync
from .operators.index import Embed, chunks_of, hashing_embedding, points
from .operators.state import Snapshots
from .sources import schemas
from .sources.files import materialised
from .sources.models import models_of
from .sources.settings import Settings
from .sources.wiki import read_pages, read_wiki
from .streaming.events import sync_stream

log = logging.getLogger("corvane.engine")


@dataclass
class Engine:
    """Models are functions of columns: embed(text), score(question, text), generate(question, context). Where none is given, those that settings address serve, else defaults that need no model."""

    spark: SparkSession
    settings: Settings
    embed: Embed | None = None
    score: rerank.Score | None = None
    generate: answer.Generate | None = None
    recorded: str | None = None

    def __post_init__(self) -> None:
        given = models_of(self.settings)
        self.embed = self.embed or given.get("embed") or hashing_embedding(self.settings.embed_dim)
        self.score = self.score or given.get("score") or rerank.overlap
        self.generate = self.generate or given.get("generate") or answer.quoting
        self.index = Snapshots(self.spark, f"{self.settings.catalog_dir}/index", schemas.POINT, order=("space_key",))
        self.state = Snapshots(self.spark, f"{self.settings.state_dir}/pages", schemas.STATE)

    # Crawling.

    def _source(self) -> dict[str, str]:
        out = {"spaces": ",".join(self.settings.space_allowlist), "base_url": self.settings.wiki_base_url, "token": self.settings.wiki_token}
        return out | ({"recorded": self.recorded} if self.recorded else {})

    def _extracted(self, rows: DataFrame) -> DataFrame:
        """Rows of the wiki as pages, with what went wrong with each and whether it is restricted (null: not known)."""
        answer_ = F.from_json("restriction", schemas.RESTRICTED)
        raw = rows.select(F.from_json("json", schemas.RAW_PAGE).alias("x"), "id", "error", extract.is_restricted(answer_).alias("restricted")).select("x.*", F.col("id").alias("_id"), "error", "restricted")
        return extract.extract_pages(raw.withColumn("id", F.coalesce("id", "_id")).drop("_id"), self.settings.wiki_base_url)

    def pages(self, since: str | None = None) -> DataFrame:
        """The pages of the spaces, their restrictions looked up; with ``since``, those changed from then on."""
        return self._extracted(read_wiki(self.spark, **self._source(), restrictions="true", **({"since": since} if since else {})))

    def pages_by_id(self, ids: DataFrame) -> DataFrame:
        """The pages of ids (page_id), each fetched on its own, whatever their space."""
        return self._extracted(read_pages(ids, **self._source()))

    def index_pages(self, pages: DataFrame) -> None:
        """Replace the points of the pages; only the index's buckets that hold them are written."""
        self.index.create()
        s = self.settings
        self.index.replace(pages.select("page_id"), points(chunks_of(pages, s.chunk_max_tokens, s.chunk_hard_max_tokens), self.embed))

    def run_sync(self, restricted: DataFrame | None = None, since: str | None = None, index: bool = True, recreate: bool = False, purge_restricted: bool = False) -> dict[str, int]:
        """A full crawl, or with ``since`` the pages changed from then on. Whether a page is restricted is asked of the wiki, unless ``restricted`` (page_id) tells. recreate: begin with empty tables."""
        if recreate:
            self.recreate()
        on_index = self.index_pages if index else (lambda pages: None)
        return sync.sync(self.pages(since), restricted, self.state, on_index, purge_restricted, self.index.replace if index else (lambda ids: None))

    def recreate(self) -> None:
        self.index.write(self.spark.createDataFrame([], schemas.POINT))
        self.state.write(self.spark.createDataFrame([], schemas.STATE))

    def sync_pages(self, ids: DataFrame) -> dict[str, int]:
        """Fetch and sync the pages of ids (page_id), whatever their space."""
        return sync.sync(self.pages_by_id(ids), None, self.state, self.index_pages)

    def delete_pages(self, ids: DataFrame) -> None:
        sync.delete_pages(ids, self.state, self.index)

    def follow(self, events: DataFrame, checkpoint: str, order: tuple[str, ...] = ("seq",), available_now: bool = True) -> StreamingQuery:
        """Keep index and state current from a stream of change events (value, and the order columns)."""
        return sync_stream(events, self.sync_pages, self.delete_pages, checkpoint, order, available_now)

    # Questions.

    def candidates(self, questions: DataFrame, top_k: int | None = None, spaces: list[str] | None = None) -> DataFrame:
        """questions (qid, question) to candidates with payload."""
        asked = questions.withColumn("qvec", self.embed(F.col("question")))
        index = self.index.read()
        found = search.hybrid(asked, index, top_k or self.settings.retrieve_top_k, spaces).withColumnRenamed("score", "fusion")
        return search.candidates(found, index).join(questions.select("qid", "question"), "qid")

    def answer(self, questions: DataFrame, spaces: list[str] | None = None) -> DataFrame:
        best = rerank.rerank(self.candidates(questions, spaces=spaces), self.score, self.settings.rerank_top_n, self.settings.rerank_score_min)
        return answer.answer(questions, best, self.generate)

    def judged(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        """questions (question, gold_page_ids): (reranker, qid, question, gold_page_ids, first), first being the rank of the first gold page without and with the reranker, 0 if there is none."""
        asked = materialised(questions.withColumn("qid", F.monotonically_increasing_id()))
        found = materialised(self.candidates(asked.select("qid", "question"), top_k))
        both = (("off", found), ("on", rerank.reordered(found, self.score)))
        rows = [evaluate.first_gold(evaluate.page_ranks(f), asked).withColumn("reranker", F.lit(name)) for name, f in both]
        return rows[0].unionByName(rows[1]).join(asked, "qid").select("reranker", "qid", "question", "gold_page_ids", "first")

    def evaluate(self, questions: DataFrame, k: int = 5, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """One row per configuration (without and with reranker): hit_rate, mrr; and the misses of each."""
        judged = materialised(self.judged(questions, top_k))
        rows = [evaluate.metrics(judged.where(F.col("reranker") == name), k).withColumn("reranker", F.lit(name)) for name in ("off", "on")]
        return rows[0].unionByName(rows[1]), evaluate.misses(judged, k)

    def health(self) -> dict[str, object]:
        """Each part's state; ok only if all are."""
        parts: dict[str, Callable[[], object]] = {"index": lambda: self.index.read().limit(1).count(), "embeddings": lambda: self._one(self.embed), "llm": lambda: self._one(lambda c: self.generate(c, c))}
        out: dict[str, object] = {}
        for name, check in parts.items():
            try:
                check()
                out[name] = "ok"
            except Exception as error:
                out[name] = f"error: {type(error).__name__}"
        rows = self.spark.createDataFrame([(0, v) for v in out.values()], "one int, state string")
        return {"status": "ok" if evaluate.all_ok(rows, "one").first()["ok"] else "degraded", "checks": out}

    def _one(self, f: Callable[[Column], Column]) -> None:
        self.spark.createDataFrame([("ping",)], "x string").select(f(F.col("x"))).collect()
