"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and bytes of text, that a Python task turns into objects at a time; one longer text is a turn of its own.
CHUNK_ROWS = 256
CHUNK_BYTES = 1_000_000
#: Bytes of rows that Spark and a Python task hand each other at a time; Spark's own bound is 64 MB for each of them.
BATCH_BYTES = 2 << 20


def turns(columns: Sequence[pa.Array], rows: int = CHUNK_ROWS, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Start and length of consecutive parts of a batch, bounded by rows and by the bytes of its texts."""
    n = len(columns[0]) if columns else 0
    sizes = np.zeros(n, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (held + size > most or i - start >= rows):
            yield start, i - start
            start, held = i, 0
        held += size
    if n > start:
        yield start, n - start


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key's text, modulo ``by``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def through_python(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` in batches of some BATCH_BYTES, one row at least, for which the session's bound is lowered.

    A batch lies in the executor's memory beside the heap and again in its
    Python worker, so the bound counts twice for every task at work.
    """
    conf = df.sparkSession.conf
    if _in_bytes(conf.get(_BOUND)) > BATCH_BYTES:
        conf.set(_BOUND, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def _in_bytes(size: str) -> float:
    """A size as Spark writes it, in bytes; a negative one is no bound."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)[a-z]*", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit if unit in ("k", "m", "g", "t", "p") else " ") if int(number) > 0 else math.inf


def with_columns(df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable], fields: str) -> DataFrame:
    """``df`` and the columns of ``fields``, which a Python function computes from ``inputs``.

    ``make`` is called once per task and returns a function from lists (one per
    input) to a list per field. Columns of ``df`` with the name of a field are
    replaced. Rows pass in order, in small chunks, so memory follows the
    largest texts and not the size of a partition.
    """
    added = T._parse_datatype_string(fields)
    taken = {f.name.lower() for f in added}
    passed = [c for c in df.columns if c.lower() not in taken]
    staged = df.select(*[F.col(f"`{c}`") for c in passed], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)])
    arrow = to_arrow_schema(added)
    n = len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for start, length in turns(batch.columns[n:]):
                part = batch.slice(start, length)
                columns = compute(*[c.to_pylist() for c in part.columns[n:]])
                new = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *new], names=[*passed, *arrow.names])

    schema = T.StructType([*[staged.schema[i] for i in range(n)], *added.fields])
    return through_python(staged, run, schema)


def flat_rows(df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable], fields: str) -> DataFrame:
    """Rows that a Python function makes from chunks of ``inputs``; as many or as few as it likes."""
    schema = T._parse_datatype_string(fields)
    arrow = to_arrow_schema(schema)
    staged = df.select(*[F.col(f"`{c}`") for c in inputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for start, length in turns(batch.columns):
                columns = compute(*[c.to_pylist() for c in batch.slice(start, length).columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return through_python(staged, run, schema)
