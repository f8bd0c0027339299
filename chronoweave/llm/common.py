"""What the operators of this folder share: scratch tables, Arrow mapping, texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.scratch import drop_stored, scratch_dir, stored

__all__ = ["BLANKS", "SLICE_CHARS", "drop_stored", "map_texts", "plain", "scratch_dir", "slices", "small_batches", "stored", "table", "trim", "whole", "word_count"]
#: Space, tab, line feed, vertical tab, form feed, carriage return: what parts words.
BLANKS = " \t\n\x0b\x0c\r"
#: Characters of text that one step of a Python worker holds.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(name: str, taken: list[str]) -> str:
    """A column name that df does not use yet, for helper columns."""
    out, low = name, {x.lower() for x in taken}
    while out.lower() in low:
        out = f"_{out}"
    return out


def whole(text: Column | str) -> Column:
    """The text; empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column | str) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    inner = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with about `chars` of text at most (or one row), and their texts with "" for null."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.utf8_length(column), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > chars:
                yield batch.slice(start, i - start), [x or "" for x in column.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start), [x or "" for x in column.slice(start).to_pylist()]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches between Spark and Python hold this many rows where the session has Spark's default of 10,000:
    rows of this folder's tables hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Give back what a task of a worker that lives on has freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_texts(df: DataFrame, text: str, start: Callable[[], Callable[[list[str]], list[list]]], added: T.StructType, keep_text: bool = True) -> DataFrame:
    """df with the columns `added`, made from its text column by Arrow batches.

    start() runs once in each task and returns what turns a list of texts into a list of columns.
    Added names that clash replace df's. No shuffle; memory is bounded by a batch and one slice of texts.
    """
    names = {f.name.lower() for f in added}
    keep = [c for c in df.columns if c.lower() not in names and (keep_text or c != text)]
    source = plain("_text", keep)
    frame = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(source))
    if text in keep:  # not sent twice
        source, frame = text, frame.drop(source)
    schema = T.StructType([f for f in frame.schema.fields if f.name in keep] + list(added.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        make = start()
        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        for part, texts in slices(batches, source):
            made = make(texts)
            columns = [part.column(i) for i, n in enumerate(part.schema.names) if n in keep]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=[f.name for f in schema.fields])
        del make
        trim()

    return frame.mapInArrow(run, schema)
