"""Helpers shared by the operators: batches of texts, row numbers, free column names, short tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from callqc.plans.graph import connected_components  # noqa: F401 - general helpers, used from here
from callqc.plans.stored import new_folder, temporary_tables, written  # noqa: F401

#: White space of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` and
#: ``bytes.lower()`` follow exactly these bytes and A-Z, so UTF-8 text is handled as bytes.
WORD_BREAKS = "[\\x20\\x09-\\x0D]+"


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_rows(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` as a written table with a column of row numbers, and that column's name.

    Whatever an operator finds out about a row is joined back by this number, never by an id of
    the user's, which may be null or stand for several rows.
    """
    row = free_name(docs, "row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Values of a string or binary column as bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL string; made on the driver, tasks take it along."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def giving_back(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` (for ``mapInArrow``), with what Arrow has freed given back to the system as it goes.

    Arrow's allocator keeps the pages of batches that are gone, and an idle Python worker would
    hold them while its executor does the next steps.
    """

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        try:
            for batch in run(batches):
                yield batch
                del batch
                pool.release_unused()
        finally:
            pool.release_unused()

    return lean


def short_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A few rows of the driver's as a table.

    They go by Arrow: a list of rows would be read by plain Python workers, a second set of them
    beside those of the Arrow batches on every executor.
    """
    schema = arrow_schema(ddl)
    columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def map_texts(
    df: DataFrame, keys: list[str], text: str, schema: str, rows: Callable[..., Iterator[tuple]]
) -> DataFrame:
    """``rows(batches)`` over batches ``(key values..., texts as bytes or None)``; Arrow both ways.

    ``rows`` yields lists of columns (one list of values for each field of ``schema``).
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = ([*(b.column(i) for i in range(b.num_columns - 1)), as_bytes(b.column(b.num_columns - 1))]
                 for b in batches)
        for columns in rows(taken):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, out, strict=True)],
                schema=out)

    return df.select(*keys, F.col(text).cast("binary").alias("_text")).mapInArrow(giving_back(run), schema)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts as empty."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_BREAKS)
    # an empty text, and white space at either end, give empty parts at the ends alone
    empty_last = (F.element_at(parts, -1) == "").cast("int")
    empty_first = ((F.size(parts) > 1) & (F.element_at(parts, 1) == "")).cast("int")
    return (F.size(parts) - empty_first - empty_last).cast("long")
