"""Collapsing, paging, picking, set and exclusion operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.shared import cut


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Only the conditions that are given."""
    return reduce(lambda d, c: d.where(c), [c for c in conditions if c is not None], df)


def collapse(df: DataFrame, group: str, ident: str, order: list) -> DataFrame:
    """One row of each group, the first in order (of ties the smallest id), with the group's size; rows without a group stay, with no size.

    An empty group name is none. Tasks count and pick within themselves first, so a large group is not one task's sort.
    """
    named = F.nullif(F.col(group).cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("g:"), named), F.concat(F.lit("i:"), F.col(ident).cast("string")))
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.groupBy(key.alias("__key")).agg(F.min_by(row, F.struct(*order, F.col(ident))).alias("row"), F.count(F.lit(1)).alias("n"))
    return first.select("row.*", F.when(F.col("__key").startswith("g:"), F.col("n")).alias("burst_count"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place in the whole order: ranges are sorted and counted apart, then shifted."""
    ranges = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranges.withColumn("__rn", within).join(starts, "__part").withColumn(name, F.col("__rn") + F.col("__before")).drop("__part", "__rn", "__before")


def day_groups(df: DataFrame, at: str, ident: str, zone: str = "UTC") -> DataFrame:
    """df with ``day``, the date on a zone's clocks, and ``place`` in it, newest first (of one time by id).

    Ranges of time are sorted apart, so no day is one task.
    """
    local = F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), zone))
    rows = df.withColumns({"day": local, "__newest": -F.unix_micros(at)}).withColumn("__late", -F.unix_date("day"))
    placed = numbered(rows, ["__late", "__newest", ident], "__n")
    first = placed.groupBy("day").agg(F.min("__n").alias("__first"))
    return placed.join(first, "day").withColumn("place", F.col("__n") - F.col("__first") + 1).drop("__newest", "__late", "__n", "__first")


#: Smart albums by the kinds they hold (none: all), and those whose bursts count once, on the web and on phones.
ALBUMS = {"all": [], "photos": ["photo", "gif"], "gifs": ["gif"], "videos": ["video"], "audio": ["audio"]}
COLLAPSED = {"web": list(ALBUMS), "phone": ["all", "photos"]}


def smart_albums(items: DataFrame, ident: str, kind: str, group: str) -> DataFrame:
    """(client, album, items) of the albums by kind: a burst counts once where the client collapses it; '' is no burst."""
    burst = F.coalesce(F.concat(F.lit("g:"), F.nullif(F.col(group).cast("string"), F.lit(""))), F.concat(F.lit("i:"), F.col(ident).cast("string")))
    inside = [F.struct(F.lit(c).alias("client"), F.lit(a).alias("album"), F.lit(a in COLLAPSED[c]).alias("once"), (F.col(kind).isin(kinds) if kinds else F.lit(True)).alias("has")) for c in COLLAPSED for a, kinds in ALBUMS.items()]
    each = items.select(F.col(ident).alias("__id"), burst.alias("__burst"), F.explode(F.array(*inside)).alias("a")).select("__id", "__burst", "a.*")
    counted = F.when(F.col("has"), F.when(F.col("once"), F.col("__burst")).otherwise(F.col("__id").cast("string")))
    return each.groupBy("client", "album").agg(F.countDistinct(counted).alias("items"))


def stage_progress(rows: DataFrame, pending: dict[str, Column], after: dict[str, list[str]]) -> DataFrame:
    """(stage, total, pending, done, active, waits) in one pass: a stage waits while one that it comes after has work left."""
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"p_{k}") for k, c in pending.items()])
    busy = lambda k: reduce(lambda a, b: a | b, [F.col(f"p_{x}") > 0 for x in after.get(k, [])], F.lit(False))
    stages = F.array(*[F.struct(F.lit(k).alias("stage"), F.col(f"p_{k}").alias("pending"), busy(k).alias("waits")) for k in pending])
    each = counts.select("total", F.explode(stages).alias("s")).select("s.stage", "total", "s.pending", "s.waits")
    return each.select("stage", "total", "pending", F.greatest(F.col("total") - F.col("pending"), F.lit(0)).alias("done"), ((F.col("pending") > 0) & ~F.col("waits")).alias("active"), "waits")


def page_with_more(df: DataFrame, at: str, ident: str, limit: int, after: tuple | None = None, most: int = 500) -> DataFrame:
    """page() with ``has_more``: one row more is asked for, and only tells whether there are more."""
    limit = max(1, min(limit, most))
    ahead = page(df, at, ident, limit + 1, after, most + 1)
    order = Window.orderBy(F.col(at).desc(), F.col(ident))  # over one page
    marked = ahead.withColumns({"__rn": F.row_number().over(order), "has_more": F.count(F.lit(1)).over(Window.partitionBy()) > limit})
    return marked.where(F.col("__rn") <= limit).drop("__rn")


def library_search(rows: DataFrame, fields: list[str], query: Column, at: str, ident: str, group: str, whole: bool = False, limit: int = 100, most: int = 500) -> DataFrame:
    """The newest matches of a search over rows(ident, at, group, tag, ...), collapsed, with all their tags.

    rows has one row for each item and tag. ``query`` is a condition on a column ``searched``, the joined fields. By default a
    row has to match alone, so words of two tags do not match together; ``whole`` joins an item's rows first. Group
    sizes are counted over all matches, before the limit.
    """
    clean = F.concat_ws(" ", *[F.col(c).cast("string") for c in fields])
    tags = rows.where("tag is not null").groupBy(ident).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    if whole:
        text = rows.groupBy(ident).agg(F.array_join(F.array_sort(F.collect_set(clean)), " ").alias("searched"))
    else:
        text = rows.select(ident, clean.alias("searched"))
    found = text.where(query).select(ident).distinct()
    items = rows.select(ident, at, group).distinct().join(found, ident, "left_semi")
    newest = page(collapse(items, group, ident, [-F.unix_micros(at)]), at, ident, limit, most=most)
    return newest.join(tags, ident, "left")


def page(df: DataFrame, at: str, ident: str, limit: int, after: tuple | None = None, most: int = 500) -> DataFrame:
    """The next rows by (at descending, ident ascending) after the last returned row (at, ident)."""
    limit = max(1, min(limit, most))
    if after is not None:
        when, last = after
        df = df.where((F.col(at) < F.lit(when)) | ((F.col(at) == F.lit(when)) & (F.col(ident) > F.lit(last))))
    return df.orderBy(F.col(at).desc(), F.col(ident)).limit(limit)


def page_after(df: DataFrame, at: str, ident: str, limit: int, last: DataFrame, most: int = 500) -> DataFrame:
    """page() after the row that last(at, ident) holds, which is read as the page is; without one there is no page."""
    end = last.select(F.col(at).alias("__at"), F.col(ident).alias("__id")).limit(1)
    behind = (F.col(at) < F.col("__at")) | ((F.col(at) == F.col("__at")) & (F.col(ident) > F.col("__id")))
    return page(df.join(F.broadcast(end), behind).drop("__at", "__id"), at, ident, limit, most=most)


def latest_per_group(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key in order; Spark keeps n rows a task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def mode_of(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), value)).alias(name))


def ids_of(df: DataFrame, columns: list[str], name: str = "id") -> DataFrame:
    """The distinct non-null values of some columns, in one pass."""
    return df.select(F.explode(F.array_compact(F.array(*[F.col(c).cast("string") for c in columns]))).alias(name)).where(F.col(name) != "").distinct()


def without(df: DataFrame, column: str, hidden: DataFrame) -> DataFrame:
    """Rows whose value is not among the first column of hidden; rows without a value stay."""
    return df.join(hidden.select(F.col(hidden.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct(), column, "left_anti")


def join_either(left: DataFrame, right: DataFrame, left_id: str, columns: list[str]) -> DataFrame:
    """Pairs whose left id equals any of the right columns, each once: a union of equi joins, not a nested loop."""
    alias = right.withColumn("__alias", F.explode(F.array_distinct(F.array_compact(F.array(*columns)))))
    return left.join(alias, left[left_id] == alias["__alias"]).drop("__alias")


def with_default_setting(df: DataFrame, settings: DataFrame, user: str, default: bool) -> DataFrame:
    """Rows of users that switched a setting(user, value) on, or left a default that is on; of several values the largest counts."""
    joined = df.join(settings.groupBy(F.col("user").alias(user)).agg(F.max("value").alias("__value")), user, "left")
    return joined.where(F.coalesce(F.col("__value") == "true", F.lit(default))).drop("__value")


def best_with_fill(df: DataFrame, keys: list[str], score: str, tie: str, fill: list[str]) -> DataFrame:
    """The lowest score of each key, its missing attributes filled from the next best row that has them."""
    order = F.struct(score, tie)
    rest = [c for c in df.columns if c not in {*keys, *fill}]
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in rest], *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fill])


def match_cascade(left: DataFrame, right: DataFrame, ident: str, rules: list[tuple[Column, Column]], value: str) -> DataFrame:
    """left with ``match``: the value of the first rule (left key, right key) under which a right row fits, the smallest of several.

    Every rule is an equi join against one row a key.
    """
    out = left
    for i, (mine, theirs) in enumerate(rules):
        keyed = right.select(theirs.alias(f"__k{i}"), F.col(value)).where(F.col(f"__k{i}").isNotNull()).groupBy(f"__k{i}").agg(F.min(value).alias(f"__m{i}"))
        out = out.withColumn(f"__l{i}", mine).join(keyed, F.col(f"__l{i}") == F.col(f"__k{i}"), "left")
    matches = [f"__m{i}" for i in range(len(rules))]
    return out.select(*left.columns, F.coalesce(*matches).alias("match"))
