"""URL filtering by a blocked Bloom filter in front of an exact join.

A list holds canonical (host, path) entries with a verdict. An entry fits a URL if the URL's host is the
entry's host or below it, and the URL's path starts with the entry's path; of the fitting entries the
longest wins, ``block`` before ``allow`` among equals. The candidates of a URL are its host's suffixes
(of the label counts that the list has) joined with its path's prefixes (of the lengths that the list has).

Only candidates that pass the blocked Bloom filter of the list (see bloom.py) reach the exact hash join
with the list, which removes the false positives. URLs are judged once each.

URLs of any length are judged whole; an empty table gives no rows, an empty list fits nothing.
A null URL and one without "://" have an empty host and path and fit no entry. Rows with null ids,
repeated rows and further columns are kept as they are; columns named like the added ones get ``page_`` before their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.bloom import maybe_in
from heliograph.llm.common import quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, entries: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host, path, entry, entry_kind and entry_verdict (null where none fits).

    entries(host, path, verdict, kind): within the longest fitting entries of each kind, see above.
    """
    listed = entries.select(F.concat("host", "path").alias("entry"), "verdict", "kind", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n")).distinct()
    shapes = [(r["labels"], r["n"]) for r in listed.select("labels", "n").distinct().collect()]
    maybe = maybe_in(listed.select(F.xxhash64("entry").alias("h")).distinct())
    added = {"host", "path", "entry", "entry_kind", "entry_verdict"}
    own = [F.col(quoted(c)).alias(f"page_{c}" if c.lower() in added else c) for c in pages.columns]
    url = F.col(quoted(url_col))
    parsed = pages.select(*own, host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.")
    keys = [F.when((F.size(labels) >= n) & (F.length("path") >= k) & (F.col("host") != ""), F.concat(F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), "."), F.substring("path", 1, k))) for n, k in shapes]
    if not keys:
        null = F.lit(None).cast("string")
        return parsed.withColumns({"entry": null, "entry_kind": null, "entry_verdict": null})
    urls = parsed.select("host", "path").distinct()
    asked = urls.select("host", "path", F.explode(F.array_compact(F.array(*keys))).alias("entry"))
    passed = asked.where(maybe(F.xxhash64("entry")))
    exact = passed.join(listed, "entry")  # false positives go
    best = exact.groupBy("host", "path").agg(F.max(F.struct((F.col("kind") == "rule").alias("rule"), F.length("entry").alias("n"), (F.col("verdict") == "block").alias("b"), "entry", "kind", "verdict")).alias("best"))
    found = best.select("host", "path", "best.entry", F.col("best.kind").alias("entry_kind"), F.col("best.verdict").alias("entry_verdict"))
    return parsed.join(found, ["host", "path"], "left")
