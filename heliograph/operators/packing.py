"""Sequential packing: parts of an export and the names in them, rows of a gallery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.operators.folds import Stepwise, ordered_fold


class _Parts(Stepwise):
    """The part of each file: one is closed when the next file would pass the limit."""

    def __init__(self, limit: float, overhead: float):
        self.limit, self.overhead, self.part, self.used = limit, overhead, 0, 0.0

    def step(self, size: float) -> tuple:
        if self.used and self.used + size + self.overhead > self.limit:
            self.part, self.used = self.part + 1, 0.0
        self.used += size + self.overhead
        return (self.part,)


def _size(column: str) -> Column:
    """A missing size, or none that is a number, counts as nothing."""
    size = F.col(column).cast("double")
    return F.when(~F.isnan(size), size).otherwise(0.0)


def size_parts(df: DataFrame, key: str, order: list[str], size: str, limit: float, overhead: float = 0.0) -> DataFrame:
    """df with the part each row falls into: a part is closed when the next row would pass the limit.

    Where a part begins depends on all that came before in its key. The state is a part number and its size. A null key is a
    key; a row without a size takes only the overhead.
    """
    return ordered_fold(df, [key], order, [F.coalesce(_size(size), F.lit(0.0))], lambda: _Parts(limit, overhead), "part long")


class _Rows:
    """Rows of a gallery: filled until no higher than wanted; a picture more is taken back if that comes nearer."""

    def __init__(self, width: float, height: float, gap: float):
        self.width, self.height, self.gap = width, height, gap
        self.number, self.ratios = 0, []

    def _fit(self, ratios: list[float]) -> float:
        return (self.width - self.gap * (len(ratios) - 1)) / sum(ratios)

    def _close(self, count: int, height: float) -> list[tuple]:
        out = [(self.number, height)] * count
        self.number += 1
        self.ratios = self.ratios[count:]
        return out

    def row(self, ratio: float) -> list[tuple]:
        self.ratios.append(ratio)
        height, out = self._fit(self.ratios), []
        if height > self.height:
            return out
        before = self.ratios[:-1]
        if before and abs(self._fit(before) - self.height) < abs(height - self.height):
            out = self._close(len(before), self._fit(before))
            height = self._fit(self.ratios)
            if height > self.height:
                return out
        return out + self._close(len(self.ratios), height)

    def end(self) -> list[tuple]:
        return self._close(len(self.ratios), min(self.height, self._fit(self.ratios))) if self.ratios else []


def justified_rows(df: DataFrame, key: str, order: list[str], aspect: str, width: float, height: float, gap: float = 4.0) -> DataFrame:
    """df with the row of each picture and that row's height: a row is filled until it is no higher than wanted.

    A picture more is taken back if the row is nearer to the wanted height without it; the last row keeps
    the wanted height. Only the open row's pictures wait for its height. A null key is a key; a picture without an aspect is square.
    """
    ratio = F.col(aspect).cast("double")
    return ordered_fold(df, [key], order, [F.when((ratio > 0) & (ratio < float("inf")), ratio).otherwise(1.0)], lambda: _Rows(width, height, gap), "row long, row_height double")


def write_parts(df: DataFrame, path: str) -> None:
    """One folder for each part of each key, named by them."""
    df.write.partitionBy(df.columns[0], "part").mode("overwrite").parquet(path)


def numbered_name(name: str, taken: dict[str, int]) -> str:
    """The name, or from its second use on with _(n) before its extension; taken counts names, and gets the new one.

    A number whose name is taken already, by a file that is called so, is passed over.
    """
    taken[name] = taken.get(name, 0) + 1
    if taken[name] == 1:
        return name
    stem, dot, tail = name.rpartition(".")
    while (made := f"{stem}_({taken[name]}).{tail}" if dot else f"{name}_({taken[name]})") in taken:
        taken[name] += 1
    taken[made] = 1
    return made


class _Names(Stepwise):
    def __init__(self) -> None:
        self.taken: dict[str, int] = {}

    def step(self, name: str | None) -> tuple:
        return (None if name is None else numbered_name(name, self.taken),)


def named_once(df: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """df with ``entry``: the name, with _(2), _(3) and so on before its extension from its second use in the keys on.

    No entry occurs twice in its keys. What is taken depends on the rows before, so the keys (the parts of archives) should be of
    bounded size: their names are the state. A null name has no entry.
    """
    return ordered_fold(df, keys, order, [F.col(name).cast("string")], _Names, "entry string")


class _Entries(Stepwise):
    """Parts and the names in them, in one pass: names start anew in each part, and the overhead is only asked for."""

    def __init__(self, limit: float, overhead: float):
        self.limit, self.overhead = limit, overhead
        self.part, self.used, self.names = 0, None, _Names()

    def step(self, first: float, size: float, name: str | None) -> tuple:
        if self.used is None:
            self.used = first
        if self.used > 0 and self.used + size + self.overhead > self.limit:
            self.part, self.used, self.names = self.part + 1, 0.0, _Names()
        self.used += size
        return (self.part, *self.names.step(name))


def archive_entries(df: DataFrame, key: str, order: list[str], size: str, name: str, limit: float, overhead: float = 100.0, first: str | None = None) -> DataFrame:
    """df with the part and the entry of each file: parts by size and names that are free within the part, as one fold.

    An archive counts the sizes of its files; whether one more fits is asked with ``overhead`` bytes more. ``first`` is a
    column with the size of what stands first in the first part.
    """
    before = F.coalesce(_size(first), F.lit(0.0)) if first else F.lit(0.0)
    return ordered_fold(df, [key], order, [before, F.coalesce(_size(size), F.lit(0.0)), F.col(name).cast("string")], lambda: _Entries(limit, overhead), "part long, entry string")
