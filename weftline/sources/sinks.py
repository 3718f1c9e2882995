"""Writers for results, chunks, configuration, registries and logs."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import is_header_only, output_path
from weftline.functions.urls import sanitize_filename


def store_results(articles: DataFrame, path: str, arrival: str = "arrival") -> None:
    """JSON lines, one per file name: the name is made of link, url or id, and the last to arrive wins."""
    name = F.concat(sanitize_filename(F.coalesce(F.nullif(F.col("link"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.col("id"))), F.lit(".json"))
    rest = [c for c in articles.columns if c != arrival]
    last = articles.withColumn("__name", name).groupBy("__name").agg(F.max(F.struct(arrival, *rest)).alias("__l"))
    last.select(F.col("__name").alias("file_name"), "__l.*").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def render_chunk(head: dict[str, Column], text: Column) -> Column:
    """Front matter and text of a chunk file; lists are written as in Python."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit("None"))) for k, v in head.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), text)


def write_chunks(chunks: DataFrame, path: str, group: str) -> None:
    """Chunk texts (column value) as text files in one folder per group."""
    chunks.select(group, "value").write.mode("overwrite").partitionBy(group).text(path)


def save_config(sources: DataFrame, path: str) -> bool:
    """Whole-file rewrite of the (small) configuration; true once it is written."""
    sources.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return True


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def stored_count(df: DataFrame) -> int:
    return df.count()


def write_files(rows: DataFrame, root: str) -> int:
    """Rows (path, value) as one file each below root, a folder that all executors have mounted; the number of files.

    Of rows with one path the greatest value is written (give rows one path each to choose yourself). A file appears whole or
    not at all, so tasks that run twice do no harm. Null paths and values write nothing; a path that leads out of root fails.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top = 0, os.path.realpath(root)
        for b in batches:
            for path, value in zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True):
                to = os.path.realpath(os.path.join(top, path))
                if os.path.commonpath([top, to]) != top:
                    raise ValueError(f"{path} leads out of {root}")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                fd, held = tempfile.mkstemp(dir=os.path.dirname(to), prefix=".")
                with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
                    f.write(value)
                os.replace(held, to)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    one = rows.filter("path is not null and value is not null").groupBy("path").agg(F.max("value").alias("value"))
    return one.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def article_files(articles: DataFrame, arrival: str = "arrival") -> DataFrame:
    """path, value of the articles as JSON files, for write_files; the last to arrive of a name wins."""
    name = F.concat(sanitize_filename(F.coalesce(F.nullif(F.col("link"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.col("id"))), F.lit(".json"))
    rest = [c for c in articles.columns if c != arrival]
    last = articles.withColumn("path", name).groupBy("path").agg(F.max(F.struct(arrival, *rest)).alias("__l"))
    return last.select("path", F.to_json(F.struct(*[F.col("__l")[c].alias(c) for c in rest]), {"ignoreNullFields": "false"}).alias("value"))


def chunk_files(chunks: DataFrame, root: str) -> DataFrame:
    """path, value of chunk records: front matter and text under <folder>/<file slug>/<topic slug>/<id>.md, for write_files."""
    plain = {k: F.col(k).cast("string") for k in ("id", "cluster", "topic", "title", "description")}
    listed = {k: F.concat(F.lit("["), F.array_join(F.transform(k, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")) for k in ("keywords", "section_hierarchy")}
    return chunks.select(output_path(F.col("file_path"), root, F.coalesce("topic", F.lit("")), F.col("id")).alias("path"), render_chunk({**plain, **listed}, F.col("text")).alias("value"))


def topic_files(topics: DataFrame) -> DataFrame:
    """path, value of topics(slug, text): <slug>.md; topics that are a heading alone are left out."""
    return topics.filter(~is_header_only(F.col("text"))).select(F.concat("slug", F.lit(".md")).alias("path"), F.col("text").alias("value"))
