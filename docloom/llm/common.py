"""Small helpers that the operators of this package share."""

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(count: int, salt: int) -> np.ndarray:
    """Fixed 64-bit numbers: the same in every process and every run."""
    return mix(np.arange(1, count + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(salt))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    return next(
        x for x in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1)))
        if x.lower() not in taken
    )


def texts(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one after another; null is the empty text."""
    for value in column:
        yield value.as_py() or ""


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The same as UTF-8 bytes."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of fewer rows, so that what a step builds from a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return what Arrow holds of the batches of a task that are gone to the system.

    Workers outlive their tasks and take turns, so each would keep its largest batches while
    others work.
    """
    pa.default_memory_pool().release_unused()


def bit_filter(df: DataFrame, value: str, width: int, bits: int) -> np.ndarray:
    """A filter of ``2**bits`` bits over ``value``, evenly spread numbers of ``width`` bits.

    A number that is in ``df`` always passes. The size does not depend on the data: the more
    numbers, the more others pass too, so it only saves work ahead of an exact join.
    """
    place = F.shiftrightunsigned(value, width - bits)
    words = (
        df.select(place.alias("_place"))
        .groupBy(F.shiftrightunsigned("_place", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out.view(U)


def passes(table: np.ndarray, values: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Which ``values`` (unsigned) pass the filter ``table``."""
    places = values >> U(width - bits)
    return (table[places >> U(6)] >> (places & U(63))) & U(1) == U(1)
