"""What the operators need from the session, and how they carry columns they don't look at."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import cut, scratch, shared_dir, ship

__all__ = ["Carried", "cut", "lean", "scratch", "shared_dir", "ship", "table", "whole_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_id(df: DataFrame, name: str) -> Column:
    """The id column as long; ids of other types have no order that a least id could be taken by."""
    kind = df.select(F.col(name)).schema[0].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"{name} must be of an integer type, not {kind.simpleString()}")
    return F.col(name).cast("long")


def lean(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches whose worker gives memory back: large arrays when they are freed, the rest when its partition ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: arrays from 4 MB on are mapped, so freed ones leave the process
        except (OSError, AttributeError):  # not glibc
            libc = None
        yield from each(batches)
        pa.default_memory_pool().release_unused()
        if libc is not None and hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


class Carried:
    """The columns of a frame that pass through an operator, packed in one struct: no name of theirs can clash with the operator's.

    Columns named as one that the operator adds are replaced by it.
    """

    def __init__(self, df: DataFrame, added: tuple[str, ...], without: tuple[str, ...] = ()):
        gone = {c.lower() for c in (*added, *without)}
        self.fields = [f for f in df.schema.fields if f.name.lower() not in gone]
        self.packed: Column = F.struct(*[F.col(f"`{f.name}`") for f in self.fields], F.lit(0).alias("_last")).alias("_row")

    def schema(self, *more: tuple[str, str]) -> T.StructType:
        """_row and the added fields (name, type)."""
        own = T.StructType([T.StructField(f.name, f.dataType, True) for f in self.fields] + [T.StructField("_last", T.IntegerType(), True)])
        return T.StructType([T.StructField("_row", own, True), *[T.StructField(n, T.DataType.fromDDL(k), True) for n, k in more]])

    def unpacked(self, df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(f"_row.`{f.name}`").alias(f.name) for f in self.fields], *more)
