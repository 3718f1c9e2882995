"""Fetching as an operator over a table of addresses, with whatever client is given as backend; the engine opens no connection."""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import robots as rb
from weftline.functions.urls import authority, origin, pick_agent

FETCHED = "url string, agent string, status int, html string, etag string, last_modified string, error string"
_SCHEMA = pa.schema([("url", pa.string()), ("agent", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("etag", pa.string()), ("last_modified", pa.string()), ("error", pa.string())])


def fetch(urls: DataFrame, backend: str, agents: list[str], robots: DataFrame | None = None, delays: DataFrame | None = None, delay: float = 1.0) -> DataFrame:
    """FETCHED of every distinct url. Null addresses and those without an authority have no row.

    backend names a function, as module:function, from (url, request headers) to (status, body, response headers). The pages of
    an authority are asked for one after the other by one task, `delay` seconds apart or as its row in delays(authority, delay)
    says, since politeness allows no more; different authorities run side by side. Addresses that robots(authority, body)
    forbids are left out. Columns etag and last_modified of urls make a request conditional: an unchanged page answers 304 and
    has no body. A status of 400 and more gives no body either, and a request that fails gives a row with its error.
    """
    held = [c for c in ("etag", "last_modified") if c in urls.columns]
    u = urls.filter(F.col("url").isNotNull()).groupBy("url").agg(*[F.max(c).alias(c) for c in held], F.count(F.lit(1)).alias("__n")).drop("__n")
    for c in {"etag", "last_modified"} - set(held):
        u = u.withColumn(c, F.lit(None).cast("string"))
    if robots is not None:
        u = rb.allowed(u, rb.rules(robots), agents[0]).filter("allowed").drop("allowed")
    u = u.withColumn("authority", authority(F.col("url"))).filter("authority is not null").withColumn("agent", pick_agent(F.col("url"), agents))
    if delays is not None:
        u = u.join(delays.select("authority", F.col("delay").cast("double").alias("delay")), "authority", "left").withColumn("delay", F.coalesce("delay", F.lit(float(delay))))
    else:
        u = u.withColumn("delay", F.lit(float(delay)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, _, name = backend.partition(":")
        call = getattr(importlib.import_module(module), name)
        last: dict[str, float] = {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                wait = last.get(r["authority"], 0.0) + r["delay"] - time.monotonic()
                if r["authority"] in last and wait > 0:
                    time.sleep(wait)
                given = {"User-Agent": r["agent"], "If-None-Match": r["etag"], "If-Modified-Since": r["last_modified"]}
                try:
                    status, body, answer = call(r["url"], {k: v for k, v in given.items() if v})
                    answer = {k.lower(): v for k, v in dict(answer or {}).items()}
                    out.append((r["url"], r["agent"], status, body if status is not None and status < 300 else None, answer.get("etag"), answer.get("last-modified"), None))
                except Exception as e:  # a page that fails is a row with its error
                    out.append((r["url"], r["agent"], None, None, None, None, str(e)))
                last = {r["authority"]: time.monotonic()}  # rows are sorted, so only the last one matters
            cols = list(zip(*out, strict=True)) or [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)

    return u.repartition("authority").sortWithinPartitions("authority", "url").select("url", "authority", "agent", "etag", "last_modified", "delay").mapInArrow(ask, FETCHED)


def cleaned(cleaned_html: Column, html: Column) -> Column:
    """What a browser gives of a page: its cleaned form, else the page as it is, else an empty text."""
    return F.coalesce(F.nullif(cleaned_html, F.lit("")), F.nullif(html, F.lit("")), F.lit(""))


def robots_urls(urls: DataFrame) -> DataFrame:
    """url: the robots.txt of every origin among the addresses, once."""
    return urls.select(F.concat(origin(F.col("url")), F.lit("/robots.txt")).alias("url")).filter("url is not null").distinct()


def robots_bodies(fetched: DataFrame) -> DataFrame:
    """authority, body of fetched robots files: a missing file (404) is an empty one, which allows everything; any other failure
    leaves no rules known (null body), which forbids nothing either."""
    body = F.when(F.col("status") == 200, F.coalesce("html", F.lit(""))).when(F.col("status") == 404, "")
    return fetched.select(authority(F.col("url")).alias("authority"), body.alias("body")).groupBy("authority").agg(F.max("body").alias("body"))


def conditional(known: DataFrame, addresses: DataFrame) -> DataFrame:
    """url, etag, last_modified: addresses(domain, url) with what known(domain, etag, last_modified) holds of the last visit."""
    k = known.filter("domain is not null").groupBy("domain").agg(F.max(F.struct("last_modified", "etag")).alias("__k"))
    return addresses.join(k, "domain", "left").select("url", F.col("__k.etag").alias("etag"), F.col("__k.last_modified").alias("last_modified"))
