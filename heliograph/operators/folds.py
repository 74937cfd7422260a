"""Ordered folds: what a row gets depends on the rows of its key before it, through a small state.

A key's rows stream through one task in sorted batches; no group is held whole. Rows pass as they came, in Arrow, so
columns keep their types and nulls; a null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


class Fold(Protocol):
    """What a key's rows run through. Both give the output values of rows in order, of the row itself or of earlier ones."""

    def row(self, *values) -> list[tuple]: ...

    def end(self) -> list[tuple]: ...


class Stepwise:
    """A fold that knows each row's values at once: ``step`` gives them."""

    def row(self, *values) -> list[tuple]:
        return [self.step(*values)]

    def end(self) -> list[tuple]:
        return []


def ordered_fold(df: DataFrame, keys: list[str], order: list, values: list[Column], new: Callable[[], Fold], outputs: str) -> DataFrame:
    """df with the columns of ``outputs`` (a schema, columns of these names are replaced): for each key in order, ``new()`` folds ``values`` (one at least)."""
    made = T.StructType.fromDDL(outputs)
    names = made.names
    kept = [c for c in df.columns if c not in names]
    types = [to_arrow_type(f.dataType) for f in made.fields]
    count = len(values)
    whole = F.to_json(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]))
    asked = df.withColumns({"__key": whole} | {f"__{i}": v for i, v in enumerate(values)})
    dealt = asked.repartition("__key").sortWithinPartitions("__key", *order).select(*[f"`{c}`" for c in kept], "__key", *[f"__{i}" for i in range(count)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        known: list[tuple] = []
        fold, now = None, None

        def ready() -> Iterator[pa.RecordBatch]:
            while waiting and len(known) >= waiting[0].num_rows:
                batch = waiting.pop(0)
                mine = known[: batch.num_rows]
                del known[: batch.num_rows]
                columns = [pa.array([m[i] for m in mine], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *names])

        for batch in batches:
            waiting.append(batch)
            rows = zip(*(batch.column(len(kept) + 1 + i).to_pylist() for i in range(count)))
            for key, row in zip(batch.column(len(kept)).to_pylist(), rows):
                if fold is None or key != now:
                    known.extend(fold.end() if fold else [])
                    fold, now = new(), key
                known.extend(fold.row(*row))
            yield from ready()
        known.extend(fold.end() if fold else [])
        yield from ready()

    schema = T.StructType([df.schema[c] for c in kept] + made.fields)
    return dealt.mapInArrow(run, schema)
