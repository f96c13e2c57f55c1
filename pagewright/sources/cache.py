"""Responses kept between runs: a table by source, options and hash of the content."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DISABLED = "<disabled>"
ENV = "PAGEWRIGHT_CACHE"
KEY = ("source", "options", "content_hash")


def cache_path(given: str | None = None) -> str | None:
    """The argument, else the environment, else none; DISABLED hides the environment."""
    return None if given == DISABLED else given or os.environ.get(ENV)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def keyed(pages: DataFrame, source: str, options: str = "", content: str = "content") -> DataFrame:
    return pages.withColumns({"source": F.lit(source), "options": F.lit(options), "content_hash": content_hash(F.col(content).cast("binary"))})


def looked_up(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with their response, pages that have none)."""
    held = cache.dropDuplicates(list(KEY))
    return pages.join(held, list(KEY)), pages.join(held, list(KEY), "left_anti")


def cached(spark: SparkSession, pages: DataFrame, source: str, compute: Callable[[DataFrame], DataFrame], path: str | None, options: str = "") -> DataFrame:
    """Pages with a column response. Only pages that the table at path lacks are computed, and then added to it.

    compute takes pages and adds response. Pages of equal content are computed once. A path without a table is empty.
    """
    keys = keyed(pages, source, options)
    if path is None:
        return compute(keys)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    missing = looked_up(keys, spark.read.parquet(path).select(*KEY))[1] if there else keys
    compute(missing.dropDuplicates(list(KEY))).select(*KEY, "response").write.mode("append").parquet(path)
    return looked_up(keys, spark.read.parquet(path))[0]
