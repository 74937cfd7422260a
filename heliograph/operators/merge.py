"""Upserts, merges, soft deletes and purges, as DataFrames before and after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.shared import cut


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """All rows of both; where keys meet, the new row if replace, else the old."""
    win, lose = (new, old) if replace else (old, new)
    return win.unionByName(lose.join(win.select(*keys), keys, "left_anti"))


def fill_nulls(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with their missing values taken from new rows of the same key, the smallest of several."""
    other = new.groupBy(key).agg(*[F.min(c).alias(f"__{c}") for c in columns])
    return old.join(other, key, "left").select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in old.columns])


def scoped_merge(local: DataFrame, payload: DataFrame, scope: str, keys: list[str]) -> DataFrame:
    """The payload's rows, and local rows of those scopes that the payload does not mention at all."""
    mentioned = payload.select(scope).distinct()
    return payload.unionByName(local.join(mentioned, scope, "left_anti").select(*payload.columns))


def soft_delete(live: DataFrame, ids: DataFrame, key: str, at: Column, keep_days: int) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes to the trash with deleted_at and expires_at)."""
    gone = live.join(ids.select(key).distinct(), key, "left_semi").withColumn("deleted_at", at).withColumn("expires_at", F.col("deleted_at") + F.make_interval(days=F.lit(keep_days)))
    return live.join(ids.select(key).distinct(), key, "left_anti"), gone


def restore(live: DataFrame, trash: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(live with the restored rows that are not there yet, the trash without them)."""
    back = trash.join(ids.select(key).distinct(), key, "left_semi").select(*live.columns).join(live.select(key), key, "left_anti")
    return live.unionByName(back.select(*live.columns)), trash.join(ids.select(key).distinct(), key, "left_anti")


def purge(trash: DataFrame, live: DataFrame, now: Column, file: str) -> tuple[DataFrame, DataFrame]:
    """(trash that stays, files of expired rows that no live or remaining row refers to)."""
    expired, stays = trash.where(F.col("expires_at") <= now), trash.where(F.col("expires_at") > now)
    used = live.select(file).unionByName(stays.select(file)).where(F.col(file).isNotNull()).distinct()
    return stays, expired.select(file).where(F.col(file).isNotNull()).distinct().join(used, file, "left_anti")


def rekey(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """df with the column's values replaced by mapping(old, new), by the smallest of several new ones."""
    m = mapping.groupBy(F.col("old").alias(column)).agg(F.min("new").alias("__new"))
    return df.join(m, column, "left").select(*[F.coalesce("__new", column).alias(column) if c == column else F.col(c) for c in df.columns])


def scrub(df: DataFrame, columns: list[str], when: Column) -> DataFrame:
    """df with the columns emptied where the condition holds."""
    return df.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c in columns})


def reconcile(cached: DataFrame, server: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action): insert, update (a field differs) or delete, to make the cache equal to the server."""
    c = cached.select(key, F.struct(*fields).alias("mine"), F.lit(True).alias("cached"))
    s = server.select(key, F.struct(*fields).alias("theirs"), F.lit(True).alias("served"))
    both = c.join(s, key, "full")
    action = F.when(F.col("cached").isNull(), "insert").when(F.col("served").isNull(), "delete").when(~F.col("mine").eqNullSafe(F.col("theirs")), "update")
    return both.withColumn("action", action).where("action is not null").select(key, "action")


def run_status(done, failed) -> Column:
    """success without failures, error without anything done, else partial."""
    d, f = F.col(done), F.col(failed)
    return F.when(f == 0, "success").when(d == 0, "error").otherwise("partial")


def split_group(members: DataFrame, moved: DataFrame, ident: str, group: str, new: Column) -> DataFrame:
    """members(ident, group, ...) with the moved(ident) ones in the group ``new``."""
    gone = moved.select(ident).distinct().withColumn("__moved", F.lit(True))
    return members.join(gone, ident, "left").withColumn(group, F.when(F.col("__moved"), new).otherwise(F.col(group))).select(*members.columns)


def stored_groups(members: DataFrame, component: str, ident: str, stored: str) -> DataFrame:
    """members with ``group``: the stored group of the component's first member (by id) that has one, else the component's smallest id."""
    known = F.min_by(stored, F.when(F.col(stored).isNotNull(), F.col(ident)))
    named = members.groupBy(component).agg(F.coalesce(known, F.min(ident)).alias("group"))
    return members.join(named, component)


def match_local(local: DataFrame, server: DataFrame, ident: str, rules: list[list[str]], take: list[str]) -> DataFrame:
    """local rows with the fields of the server row that is the same item, and its id as ``server_id``.

    rules are lists of columns that have to be equal, tried in order; a rule with a missing value does not apply. A server
    row serves one local row: of several the one with the smallest id.
    """
    rest, done = local, None
    free = server
    for rule in rules:
        whole = lambda d: d.where(" and ".join(f"`{c}` is not null" for c in rule))  # noqa: E731, B023
        mine = whole(rest).groupBy(*rule).agg(F.min(ident).alias(ident))
        theirs = whole(free).groupBy(*rule).agg(F.min_by(F.struct(F.col(ident).alias("server_id"), *[F.col(c).alias(f"__{c}") for c in take]), ident).alias("s"))
        hits = cut(mine.join(theirs, rule).select(ident, "s.*"), "matches")
        done = hits if done is None else done.unionByName(hits)
        rest = rest.join(hits.select(ident), ident, "left_anti")
        free = free.join(hits.select(F.col("server_id").alias(ident)), ident, "left_anti")
    return local.join(done, ident, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in take else F.col(c) for c in local.columns], "server_id")


def state_document(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, row): the full state of some tables, one JSON object a row; written as text it is one document in lines."""
    return reduce(DataFrame.unionAll, [df.select(F.lit(name).alias("name"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")) for name, df in tables.items()])
