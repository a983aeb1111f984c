"""Small helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import wraps
from inspect import signature

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rackwise.sources.workspace import stored

SLICE_ROWS = 512  # rows turned into Python values at a time

__all__ = ["add_columns", "any_names", "fixed_rows", "in_fold", "mapped", "read_table", "stored", "unused", "without"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id's text, modulo ``folds``, is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add; upper and lower case are the same."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fixed_rows(spark: SparkSession, rows: Iterable[tuple], names: list[str]) -> DataFrame:
    """A few constant rows as part of the plan, so that Spark knows how small they are."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def any_names(*columns: str) -> Callable:
    """For operators that add columns to their first argument: its columns may have any names.

    Inside the operator they are ``c0``, ``c1``, ..., so no helper column can meet one of them; ``columns`` are the
    parameters that name one. Outside, the operator's own columns replace those of the same name
    (upper and lower case are the same), and all others it kept are back under their names.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        form = signature(operator)

        @wraps(operator)
        def run(*args, **kwargs) -> DataFrame:
            given = form.bind(*args, **kwargs)
            given.apply_defaults()
            table = next(iter(form.parameters))
            df = given.arguments[table]
            inside = {name: f"c{k}" for k, name in enumerate(df.columns)}
            folded = {name.lower(): inner for name, inner in inside.items()} | inside
            for column in columns:
                name = given.arguments[column]
                if name is not None:
                    given.arguments[column] = folded.get(name) or folded.get(name.lower(), name)
            given.arguments[table] = df.toDF(*inside.values())
            out = operator(*given.args, **given.kwargs)
            added = [c for c in out.columns if c not in inside.values()]
            taken = {c.lower() for c in added}
            kept = [F.col(inner).alias(name) for name, inner in inside.items() if inner in out.columns and name.lower() not in taken]
            return out.select(*kept, *added)

        return run

    return wrap


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], result: T.StructType) -> DataFrame:
    """``df.mapInArrow(run, result)`` for columns of any name: inside, columns go by their place only."""
    inner = [f"r{k}" for k in range(len(result.fields))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(inner, result.fields, strict=True)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, inner)

    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(renamed, schema).toDF(*result.names)


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all names in ``taken``."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def add_columns(df: DataFrame, setup: Callable[[], Callable[..., Sequence]], reads: Sequence[str], fields: Sequence[T.StructField], drop: Sequence[str] = ()) -> DataFrame:
    """Add ``fields``, computed from the values of ``reads``, ``SLICE_ROWS`` rows at a time; other columns pass as they came.

    ``setup`` is called once in each task and returns a function that takes a list of values for
    each of ``reads`` and returns a list (or array) for each of ``fields``. Columns in ``drop`` go.
    """
    given = df.schema.fields
    kept = [k for k, f in enumerate(given) if f.name not in drop]
    result = T.StructType([*[given[k] for k in kept], *fields])
    names, added = [f.name for f in given], to_arrow_schema(T.StructType(list(fields))).types
    places = [names.index(c) for c in reads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = setup()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                values = compute(*[batch.column(k).to_pylist() for k in places])
                columns = [batch.column(k) for k in kept] + [pa.array(v, t) for v, t in zip(values, added, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, result.names)

    return mapped(df, run, result)
