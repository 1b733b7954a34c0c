"""Walks over the rows of many groups, where what becomes of a row depends on the rows before it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARROW = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
#: Rows of a batch that goes back.
ROWS = 10_000


def listed(column: pa.Array) -> list:
    """A column's values; a number that is missing is no number (NaN), which compares as false."""
    values, kind = column.to_pylist(), column.type
    plain = pa.types.is_integer(kind) or pa.types.is_floating(kind)
    return [float("nan") if v is None else v for v in values] if plain and column.null_count else values


def column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v != v else int(v) if pa.types.is_integer(kind) else v for v in values], kind)


def walked(rows: DataFrame, by: list[str], order: list[str], walk: Callable[[Iterator[tuple]], Iterable[tuple]], out: dict[str, str]) -> DataFrame:
    """What `walk` makes of each group of rows: it takes the group's rows one after another in `order` (missing values
    last), as tuples of the columns that aren't in `by`, and gives tuples of the columns `out` (name: type).

    Rows are dealt by group and sorted, and each task walks its groups in turn: a small group costs no call of its own,
    and of a large one only that is held which the walk holds."""
    rest = [c for c in rows.columns if c not in by]
    k, kinds = len(by), {c: rows.schema[c].dataType.simpleString() for c in by}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.DataType] = []

        def tuples() -> Iterator[tuple]:
            for batch in batches:
                keys[:] = [c.type for c in batch.columns[:k]]
                yield from zip(*map(pa.Array.to_pylist, batch.columns[:k]), *map(listed, batch.columns[k:]), strict=True)

        groups = groupby(tuples(), itemgetter(slice(k)))
        made = chain.from_iterable(((*key, *r) for r in walk(r[k:] for r in own)) for key, own in groups)
        while part := list(islice(made, ROWS)):
            columns = [pa.array(v, t) for v, t in zip(list(zip(*part, strict=True))[:k], keys, strict=True)]
            columns += [column(v, ARROW[t]) for v, t in zip(list(zip(*part, strict=True))[k:], out.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*by, *out])

    dealt = rows.select(*by, *rest).repartition(*by).sortWithinPartitions(*by, *(F.asc_nulls_last(c) for c in order))
    return dealt.mapInArrow(task, ", ".join(f"`{c}` {t}" for c, t in (kinds | out).items()))
