"""A wiki's REST API as a Spark data source: one partition per space, read page by page."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition

from .retry import HttpError, UnknownSpace, with_retries

#: Rows a request, and what the rows are expanded by; fixed values of the API.
PAGE_SIZE, EXPAND = 50, "body.view,space,version,ancestors,metadata.labels"
ROW = "id string, space_key string, last_modified string, json string, restriction string, error string"
Fetch = Callable[[str, dict], dict]


def http_fetch(base_url: str, token: str, timeout: float = 30.0) -> Fetch:
    """GET with a bearer token; a response beyond 2xx raises, what is worth it is tried again."""

    def once(path: str, params: dict) -> dict:
        url = f"{base_url.rstrip('/')}{path}?{urllib.parse.urlencode(params)}"
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}", "Accept": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return json.load(response)
        except urllib.error.HTTPError as error:
            raise HttpError(error.code, url) from error

    return lambda path, params: with_retries(lambda: once(path, params))


def paged(fetch: Fetch, path: str, params: dict) -> Iterator[dict]:
    """All results of a listing; it ends without a next link or with an empty page."""
    start = 0
    while True:
        data = fetch(path, params | {"start": start, "limit": PAGE_SIZE})
        rows = data.get("results") or []
        yield from rows
        if not rows or not (data.get("_links") or {}).get("next"):
            return
        start += len(rows)


def space_pages(fetch: Fetch, space: str) -> Iterator[dict]:
    """All current pages of a space."""
    try:
        yield from paged(fetch, "/rest/api/content", {"spaceKey": space, "type": "page", "status": "current", "expand": EXPAND})
    except HttpError as error:
        if error.status == 404:
            raise UnknownSpace(space) from error
        raise


def quoted(value: str) -> str:
    """A string of the query language; quotes and backslashes in it end nothing."""
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def changed_query(since: str, spaces: list[str]) -> str:
    return f"type = page and space in ({','.join(map(quoted, spaces))}) and lastModified >= {quoted(since)} order by lastModified"


def changed_pages(fetch: Fetch, since: str, spaces: list[str]) -> Iterator[dict]:
    yield from paged(fetch, "/rest/api/content/search", {"cql": changed_query(since, spaces), "expand": EXPAND})


def one_page(fetch: Fetch, page_id: str) -> dict:
    return fetch(f"/rest/api/content/{page_id}", {"expand": EXPAND})


def read_restrictions(fetch: Fetch, page_id: str) -> dict:
    return fetch(f"/rest/api/content/{page_id}/restriction/byOperation/read", {"expand": "restrictions.user,restrictions.group"})


def made_fetch(options: dict) -> Fetch:
    if folder := options.get("recorded"):  # recorded answers, for use without a network
        from .recorded import recorded_fetch

        return recorded_fetch(folder)
    return http_fetch(options["base_url"], options.get("token", ""), float(options.get("timeout", 30)))


def row(fetch: Fetch, page: dict, restrictions: bool) -> tuple:
    """A page as ROW, with its read restrictions if asked for. A lookup that fails is the page's error and ends nothing else."""
    page_id, restriction, error = str(page.get("id", "")), None, None
    if restrictions:
        try:
            restriction = json.dumps(read_restrictions(fetch, page_id))
        except Exception as failure:
            error = f"restrictions: {failure}"
    return page_id, (page.get("space") or {}).get("key", ""), (page.get("version") or {}).get("when", ""), json.dumps(page), restriction, error


def row_of(fetch: Fetch, page_id: str, restrictions: bool) -> tuple:
    """One page by its id as ROW; a fetch that fails is the page's error."""
    try:
        page = one_page(fetch, page_id)
    except Exception as failure:
        return page_id, "", "", None, None, f"page: {failure}"
    return row(fetch, page, restrictions)


class Space(InputPartition):
    pass


class Ids(InputPartition):
    """Pages to look up one by one."""


class WikiReader(DataSourceReader):
    #: Ids that one task looks up.
    IDS = 50

    def __init__(self, options: dict) -> None:
        self.options = options
        self.spaces = [s for s in (x.strip() for x in options.get("spaces", "").split(",")) if s]
        self.since = options.get("since")
        self.ids: list[str] | None = None
        self.restrictions = options.get("restrictions", "false").lower() == "true"

    def pushFilters(self, filters):
        """Spaces, ids and the lower bound of the last change go to the source; Spark checks all again."""
        for f in filters:
            if isinstance(f, (In, EqualTo)):
                values = list(f.value) if isinstance(f, In) else [f.value]
                if f.attribute == ("space_key",):
                    self.spaces = [s for s in self.spaces if s in values]
                elif f.attribute == ("id",):
                    self.ids = [i for i in (values if self.ids is None else self.ids) if i in values]
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("last_modified",):
                self.since = max(self.since or "", f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.ids is not None:
            return [Ids(self.ids[lo : lo + self.IDS]) for lo in range(0, len(self.ids), self.IDS)]
        return [Space(s) for s in self.spaces]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = made_fetch(self.options)
        if isinstance(partition, Ids):  # the pages that a crawl would meet, and no others
            for page_id in partition.value:
                try:
                    page = one_page(fetch, page_id)
                except HttpError as error:
                    if error.status == 404:
                        continue
                    raise
                if (page.get("space") or {}).get("key") in self.spaces and page.get("type", "page") == "page" and page.get("status", "current") == "current":
                    yield row(fetch, page, self.restrictions)
            return
        space = partition.value
        for page in changed_pages(fetch, self.since, [space]) if self.since else space_pages(fetch, space):
            yield row(fetch, page, self.restrictions)


class WikiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return WikiReader(dict(self.options))


def read_wiki(spark: SparkSession, **options: str) -> DataFrame:
    """Rows of ROW: options base_url, token, spaces (separated by commas), since, timeout, restrictions (true: look those of each page up), or recorded (a folder)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses a reader that takes filters
    spark.dataSource.register(WikiSource)
    return spark.read.format("wiki").options(**options).load()


def read_pages(ids: DataFrame, **options: str) -> DataFrame:
    """Rows of ROW of the pages of ids (page_id), with their restrictions, whatever their space: each task looks its ids up."""
    import pyarrow as pa

    names = [c.split()[0] for c in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = made_fetch(options)
        for batch in batches:
            rows = [row_of(fetch, i, True) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [()] * len(names))], names=names)

    return ids.select("page_id").where("page_id is not null").distinct().mapInArrow(run, ROW)
