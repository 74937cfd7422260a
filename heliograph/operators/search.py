"""Substring and fuzzy search by an index of trigrams.

Every three letters that follow each other in a lower-cased text are a gram. A posting has a gram and the ids of those texts of
one batch that hold it, so there are about as many rows as grams times batches. Postings lie in folders by the gram's hash and are
sorted in them, so a search reads the folders of its own grams only and skips what is not theirs. What the postings leave is looked up in the index's copy of the texts, sorted by id, and checked exactly as a scan would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import text as words
from heliograph.shared import folder_exists

#: Folders of postings.
FOLDERS = 64
#: Letters of texts that share postings, and tasks that write a folder at most.
BATCH_LETTERS = 1_000_000
TURNS = 4
#: Grams of a word that are looked up at most; its others are left to the exact check.
MOST_GRAMS = 8
#: Ids that a lookup names in its filter; more are joined.
NAMED_IDS = 500


def _grams(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams, counts, places): the distinct grams of all texts, in how many texts each is, and these texts' places, gram by gram."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(data):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.flatnonzero(np.bincount(data))
    base = len(letters)
    if base**3 > (1 << 62) // len(texts):  # more letters than a long holds with the texts' places
        half = len(texts) // 2
        left, right = _grams(texts[:half]), _grams(texts[half:])
        return left[0] + right[0], np.concatenate([left[1], right[1]]), np.concatenate([left[2], right[2] + half])
    code = np.zeros(int(letters[-1]) + 1, np.int64)
    code[letters] = np.arange(base)
    c = code[data]
    owner = np.repeat(np.arange(len(texts)), lengths)
    whole = owner[2:] == owner[:-2] if len(owner) > 2 else np.zeros(0, bool)
    keys = np.sort((((c[:-2] * base + c[1:-1]) * base + c[2:]) * len(texts) + owner[:-2])[whole]) if len(owner) > 2 else np.zeros(0, np.int64)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    gram, place = np.divmod(keys, len(texts))
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    made = gram[starts]
    names = np.stack([letters[made // base**2], letters[made // base % base], letters[made % base]], 1).astype(np.uint32)
    text = names.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + 3] for i in range(0, len(text), 3)], np.diff(np.append(starts, len(gram))), place


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ids) of lower-cased texts, each gram of some BATCH_LETTERS letters once."""

    def made(idents: list, texts: list[str]) -> pa.RecordBatch:
        grams, counts, places = _grams(texts)
        ids = pa.array(idents, pa.int64()).take(pa.array(places))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.ListArray.from_arrays(offsets, ids)], names=["gram", "ids"])

    idents, texts, letters = [], [], 0
    for batch in batches:
        for ident, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            idents.append(ident)
            texts.append(low)
            letters += len(low)
            if letters >= BATCH_LETTERS:
                yield made(idents, texts)
                idents, texts, letters = [], [], 0
    if texts:
        yield made(idents, texts)


def _folder(gram: Column) -> Column:
    return F.pmod(F.crc32(F.encode(gram, "UTF-8")), F.lit(FOLDERS)).cast("int")


def build_index(docs: DataFrame, ident: str, text: Column, folder: str) -> None:
    """Write the postings and a copy of (id, text) below a folder; a null text has no postings, an id's repeated rows share them."""
    rows = docs.select(F.col(ident).cast("long").alias("id"), text.alias("text"))
    rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/texts")
    low = rows.where("text is not null").select("id", F.lower("text").alias("low")).where(F.length("low") >= 3)
    postings = low.mapInArrow(_postings, "gram string, ids array<long>").withColumn("folder", _folder(F.col("gram")))
    # A folder's grams go to several tasks, as a few grams may have most of the postings.
    dealt = postings.withColumn("turn", F.pmod(F.xxhash64("gram", "ids"), F.lit(TURNS)))
    dealt.repartition("folder", "turn").sortWithinPartitions("folder", "gram").drop("turn").write.mode("overwrite").partitionBy("folder").parquet(f"{folder}/postings")


def _python_grams(word: str) -> list[str]:
    return list(dict.fromkeys(word[i : i + 3] for i in range(len(word) - 2)))


def _alternatives(token: str, fuzzy: bool) -> list[tuple[list[str], int]] | None:
    """What a text that matches a token has: for one of these, so many of the grams. None if that can't be told from grams."""
    out = []
    for stem in words.stems(token):
        if len(stem) < 3:
            return None
        out.append((_python_grams(stem)[:MOST_GRAMS], min(MOST_GRAMS, len(_python_grams(stem)))))
    if fuzzy and len(token) >= 3:
        out.append(([token[:3]], 1))  # a word that is a prefix of the token
        if len(token) >= 7:
            grams = _python_grams(token)
            # An edit spoils at most three places, and so at most three different grams.
            if len(grams) < 4:
                return None
            out.append((grams, len(grams) - 3))
    return out


def candidates(spark: SparkSession, folder: str, query: str, fuzzy: bool = False) -> DataFrame | None:
    """(id) of the texts that can match, from the postings; None if every text can."""
    needs = [a for a in (_alternatives(t, fuzzy) for t in words.query_tokens(query)) if a is not None]
    if not needs:
        return None
    asked = [(token, way, gram, least) for token, ways in enumerate(needs) for way, (grams, least) in enumerate(ways) for gram in grams]
    named = spark.createDataFrame(asked, "token int, way int, gram string, least int").withColumn("folder", _folder(F.col("gram")))  # a few rows a token
    folders = sorted({r["folder"] for r in named.select("folder").collect()})
    read = postings_of(spark, folder, folders)
    if read is None:
        return spark.createDataFrame([], "id long")
    some = read.where(F.col("gram").isin(sorted({g for _, _, g, _ in asked}))).select(F.explode("ids").alias("id"), "gram")
    met = some.join(F.broadcast(named.drop("folder")), "gram")
    hits = met.groupBy("id", "token", "way", "least").agg(F.count(F.lit(1)).alias("n")).where("n >= least").select("id", "token").distinct()
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(needs)).select("id")


def postings_of(spark: SparkSession, folder: str, folders: list[int]) -> DataFrame | None:
    there = [f"{folder}/postings/folder={f}" for f in folders if folder_exists(spark, f"{folder}/postings/folder={f}")]
    return spark.read.schema("gram string, ids array<long>").parquet(*there) if there else None


def search(spark: SparkSession, folder: str, query: str, fuzzy: bool = False) -> DataFrame:
    """(id, text) of the indexed rows that match, as ``matches_all`` (or ``fuzzy_matches``) on all of them would find them."""
    texts = spark.read.schema("id long, text string").parquet(f"{folder}/texts")
    found = candidates(spark, folder, query, fuzzy)
    if found is not None:
        few = [r["id"] for r in found.limit(NAMED_IDS + 1).collect()]
        nameless = texts.where("id is null")  # has no postings of its own
        texts = (texts.where(F.col("id").isin([i for i in few if i is not None])) if len(few) <= NAMED_IDS else texts.join(found, "id", "left_semi")).unionAll(nameless)
    matches = words.fuzzy_matches if fuzzy else words.matches_all
    return texts.where(matches("text", query))


def bytes_of(df: DataFrame) -> int:
    """The bytes of the files that a table is read from."""
    spark = df.sparkSession
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def bytes_asked(spark: SparkSession, folder: str, query: str, fuzzy: bool = False) -> tuple[int, int]:
    """(bytes of the postings that a search opens, bytes of all texts that a scan would read)."""
    needs = [a for a in (_alternatives(t, fuzzy) for t in words.query_tokens(query)) if a is not None]
    grams = sorted({g for ways in needs for some, _ in ways for g in some})
    folders = {r["f"] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram")).alias("f")).collect()} if grams else set()
    read = postings_of(spark, folder, sorted(folders))
    return (bytes_of(read) if read is not None else 0), bytes_of(spark.read.parquet(f"{folder}/texts"))
