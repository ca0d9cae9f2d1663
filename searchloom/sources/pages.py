"""Pages by following links: seeds, listings, articles, next pages, in rounds over whole frontiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import fresh_dir
from .html import NEWS, Profile, extract


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    steps = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    kept = F.aggregate(
        steps,
        F.expr("cast(array() as array<string>)"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    closed = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path == "", path).otherwise(F.concat(F.lit("/"), F.array_join(closed, "/")))


def resolve(base: Column, href: Column) -> Column:
    """A link as an absolute URL without its fragment (RFC 3986); null for what is no other web page.

    Dot segments are removed, scheme and host are in lower case, so that a page
    has one name however it is linked.
    """
    link, page = F.regexp_replace(F.trim(href), "(?s)#.*$", ""), F.regexp_replace(base, "(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1))
    origin = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    folder = F.regexp_extract(path, "^(.*/)[^/]*$", 1)
    whole = (
        F.when(link == "", F.lit(None))
        .when(link.rlike("^(?i:https?):"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )
    part = lambda i: F.regexp_extract(whole, r"(?s)^((?i:https?)://[^/?]+)([^?]*)(\?.*)?$", i)
    return F.when(part(1) != "", F.concat(F.lower(part(1)), _without_dots(part(2)), F.coalesce(part(3), F.lit(""))))


def from_table(pages: DataFrame, every: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A fetcher that finds (url, html) in a table, of several pages of one URL the least by html, or ``every`` one; ``paced`` asks live sites."""
    found = lambda urls: pages.join(urls, "url", "left_semi")
    return found if every else lambda urls: found(urls).groupBy("url").agg(F.min("html").alias("html"))


def traverse(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], profile: Profile = NEWS, max_depth: int | None = None) -> DataFrame:
    """(url, depth, the fields of an article) of every page reached from the seeds (url), each URL fetched once.

    A round fetches a whole frontier; what it found is written, so a lost
    executor costs a round at most.  The links and next pages that no round had
    are the next frontier, until there is none; a URL that can't be fetched is
    left out.  ``max_depth``: follow links from pages of lesser depth only.
    """
    spark = seeds.sparkSession
    folder = fresh_dir(spark, "crawl")
    schema, frontier, asked = None, seeds.select("url").where("url <> ''").distinct(), f"{folder}/asked"
    depth = 0
    while max_depth is None or depth <= max_depth:
        frontier.withColumn("depth", F.lit(depth)).write.mode("append").parquet(asked)
        now = spark.read.parquet(asked).where(F.col("depth") == depth).select("url")
        if now.isEmpty():
            break
        found = extract(fetch(now), profile).withColumn("depth", F.lit(depth))
        schema = found.schema
        found.write.parquet(f"{folder}/found/round-{depth}")
        own = spark.read.schema(schema).parquet(f"{folder}/found/round-{depth}")
        after = own.select("url", F.explode(F.concat("links", F.array("next_page"))).alias("href")).select(resolve(F.col("url"), F.col("href")).alias("url")).where("url is not null").distinct()
        frontier = after.join(spark.read.parquet(asked).select("url"), "url", "left_anti")
        depth += 1
    if schema is None:
        return extract(seeds.limit(0).select("url", F.lit("").alias("html")), profile).withColumn("depth", F.lit(0))
    return spark.read.schema(schema).parquet(f"{folder}/found/*")
