"""URL filters with redirect equivalence.

Rules decide the urls they fit. Redirects and canonical links make urls aliases; over these edges, connected components
carry a block decision to all aliases that no rule decides, unless the component holds an explicit allow, which goes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .markup import START, attributes_of, events


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


ALLOW, BLOCK = "allow", "block"
ABSOLUTE = re.compile(r"[a-zA-Z][\w+.-]*://")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule, as a struct (name, verdict), or null; of equally long ones an allow, then the first by name."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == ALLOW, r.name)):  # later ones win
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def resolved(url: str, base: str, target: str) -> str:
    """The absolute url of a link's target; empty if it has none."""
    if ABSOLUTE.match(target):
        return target
    try:
        found = urljoin(urljoin(url, base), target)
    except ValueError:
        return ""
    return found if ABSOLUTE.match(found) else ""


REFRESH = re.compile(r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*(?:\"([^\"]*)|'([^']*)|(.*))")


def targets(html: str) -> tuple[str, list[str]]:
    """The base of a page's links, and the targets of its canonical links and refresh redirects, from its tags alone: not from comments, scripts and the like."""
    base, found = "", []
    for event, name, text in events(html):
        if event != START or name not in ("base", "link", "meta"):
            continue
        given: dict[str, str] = {}
        for k, v in attributes_of(text):  # of several of a name the first counts
            given.setdefault(k, unescape(v).strip())
        if name == "base":
            base = base or given.get("href", "")
        elif name == "link":
            if "canonical" in given.get("rel", "").lower().split():
                found.append(given.get("href", ""))
        elif given.get("http-equiv", "").lower() == "refresh" and (m := REFRESH.match(given.get("content", ""))):
            found.append((m[1] or m[2] or m[3] or "").strip())
    return base, [t for t in found if t]


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b) urls: a page and the target of its canonical link or of its refresh redirect, relative ones resolved against the page's base. Pages that hold neither word stay in the JVM."""
    has = F.lower("html").contains("canonical") | F.lower("html").contains("refresh")
    some = pages.where("url is not null and html is not null").where(has).select("url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for url, html in zip(batch.column(0), batch.column(1), strict=True):
                page = url.as_py()
                base, found = targets(html.as_py())
                for t in found:
                    if to := resolved(page, base, t):
                        a.append(page)
                        b.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    return some.mapInArrow(run, "a string, b string")


def judge(pages: DataFrame, edges: DataFrame, rules: tuple[Rule, ...], default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url).

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest decides. Without one, an
    allow anywhere in the url's component allows it, else a block there blocks it, else ``default``. edges: (a, b)
    urls, which need not be pages. Null urls and urls without ``://`` have an empty host and path, fit no rule and, if null,
    no edge. Repeated rows are judged alike; an empty table gives an empty result.
    """
    url = F.col("url")
    parsed = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    roots = components(edges)
    member = roots.withColumn("r", best_rule(host_of(F.col("node")), path_of(F.col("node")), rules))
    decided = member.where("r is not null").groupBy("root").agg(F.max(F.col("r.verdict") == ALLOW).alias("allowed"))
    alias = roots.join(decided, "root").select(F.col("node").alias("_node"), "allowed")
    from_alias = F.when(F.col("allowed"), ALLOW).when(~F.col("allowed"), BLOCK).otherwise(default)
    # Only urls without a rule ask their component.
    by_rule = ruled.where("r is not null").select("page_id", "host", "path", F.col("r.name").alias("rule"), F.col("r.verdict").alias("verdict"))
    # A url that very many rows have is met by AQE's skew join: the left side of a left join can be split.
    rest = ruled.where("r is null").join(alias, F.col("url") == F.col("_node"), "left")
    return by_rule.unionByName(rest.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), from_alias.alias("verdict")))
