"""Connectors to text-recognition sources, and their choice by name.

A connector is a function from the content of a page to a response; it runs inside mapInArrow, with one client for each
partition. What differs between sources (shape of the response, defaults) is a row of a table.
"""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagewright.sources import responses
from pagewright.sources.cache import cached


class UnknownSource(ValueError):
    """No source of this name."""


@dataclass(frozen=True)
class Retry:
    """Calls again after an error, with a delay that may grow and vary."""

    tries: int = 3
    delay: float = 1.0
    factor: float = 1.0
    jitter: float = 0.0

    def __call__(self, call: Callable[[], object], sleep: Callable[[float], None] = time.sleep) -> object:
        delay = self.delay
        for k in range(self.tries):
            try:
                return call()
            except Exception:
                if k == self.tries - 1:
                    raise
                sleep(delay * (1 + random.uniform(-self.jitter, self.jitter)))
                delay *= self.factor
        raise AssertionError


@dataclass(frozen=True)
class Poll:
    """Asks for the result of a started request until it is there; found tells whether it is, an error comes after too long."""

    delay: float = 0.1
    longest: float = 120.0

    def __call__(self, ask: Callable[[], object], found: Callable[[object], bool], sleep: Callable[[float], None] = time.sleep) -> object:
        waited = 0.0
        while not found(answer := ask()):
            if waited >= self.longest:
                raise TimeoutError(f"no result after {waited:.1f} s")
            sleep(self.delay)
            waited += self.delay
        return answer


@dataclass(frozen=True)
class Source:
    """What is fixed for a kind of source."""

    name: str
    flatten: Callable[..., DataFrame]
    schema: str
    max_size: int = 1024
    samples: int = 1
    retry: Retry = field(default_factory=Retry)
    rotation: Callable[..., DataFrame] | None = None


#: The sources, with the largest side of an image that they are sent and how they are called again.
SOURCES = {
    s.name: s
    for s in (
        Source("google", responses.flatten_tree, responses.TREE, 1024, 2, Retry(3, 1.0), responses.tree_rotation),
        Source("azure", responses.flatten_lines, responses.LINES, 2048, 1, Retry(5, 0.5, 2.0, 0.1), responses.lines_rotation),
        Source("aws", responses.flatten_blocks, responses.BLOCKS),
        Source("easyocr", responses.flatten_tuples, responses.TUPLES),
        Source("paddleocr", responses.flatten_tuples, responses.TUPLES),
        Source("checkboxes", responses.flatten_marks, responses.MARKS, 4096),
        Source("barcodes", responses.flatten_codes, responses.CODES),
    )
}
COMBINED, COMBINED_SIZE = "googleazure", 4096
#: Other names of sources.
ALIASES = {"googleocr": "google", "azureocr": "azure", "awsocr": "aws", "easy_ocr": "easyocr", "paddle": "paddleocr", "googleazureocr": COMBINED}
ENV_SOURCE, ENV_MAPPING = "OCR_PROVIDER", "OCR_PROVIDER_MAPPING"
DEFAULT = "google"


def parsed_overrides(text: str) -> dict[str, str]:
    """ "a=b,c=d" as a dict; an entry without exactly one = is an error."""
    out = {}
    for entry in filter(None, text.split(",")):
        name, _, value = entry.partition("=")
        if not _ or "=" in value:
            raise ValueError(f"not name=name: {entry}")
        out[name.strip().lower()] = value.strip().lower()
    return out


def select_source(name: str | None = None) -> str:
    """The argument, else the environment, else the default; then the overrides of the environment, applied once."""
    name = (name or os.environ.get(ENV_SOURCE) or DEFAULT).lower()
    name = parsed_overrides(os.environ.get(ENV_MAPPING, "")).get(name, name)
    name = ALIASES.get(name, name)
    if name not in SOURCES and name != COMBINED:
        raise UnknownSource(name)
    return name


def setting(given: str | None, env: str, file: dict[str, str] | None = None, key: str = "") -> str:
    """The argument, else the environment, else a settings file; missing everywhere is an error."""
    found = given or os.environ.get(env) or (file or {}).get(key)
    if not found:
        raise ValueError(f"neither argument, {env} nor settings file")
    return found


def recognise_cached(pages: DataFrame, source: str, client: Callable[[], Callable[[bytes], object]], path: str | None, options: str = "") -> DataFrame:
    """As recognise, but only for pages that the table at path does not hold for this source and these options yet."""
    return cached(pages.sparkSession, pages, source, lambda missing: recognise(missing, source, client), path, options)


def recognise(pages: DataFrame, source: str, client: Callable[[], Callable[[bytes], object]], content: str = "content") -> DataFrame:
    """pages with a column response of the source's schema: client() is made once for each partition and called, again
    after errors, for each page. Its result is the response as JSON text or as plain lists and dicts."""
    spec = SOURCES[source]
    at = pages.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = client()
        for batch in batches:
            found = []
            for x in batch.column(at).to_pylist():
                r = spec.retry(lambda x=x: call(x))
                found.append(r if isinstance(r, str) else json.dumps(r))
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "_response"])

    schema = StructType([*pages.schema.fields, StructField("_response", StringType())])
    return pages.mapInArrow(run, schema).withColumn("response", F.from_json("_response", spec.schema)).drop("_response")
