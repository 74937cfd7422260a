"""Byte-level BPE, whitening and phrase mining on small tables."""

import hashlib
import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from heliograph.llm import bytebpe, collocations, queries, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the and of that with " * 60_000 + "x" * 100_000 + " " * 5000 + "\n"
EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (None, "It's Straße 東京 1234 🙂 é   end", "en", None, 27),
    (6, "the house of the rising sun", "en", "a", 27),
    (6, "the house of the rising sun", "en", "a", 27),
    (7, LONG, "en", "a", len(LONG)),
]


@pytest.fixture(scope="module")
def edges(spark):
    odd = spark.createDataFrame(EDGES, SCHEMA)
    for clash in ("id", "ids", "score", "key", "rank", "word", "chunk", "x", "n", "decoded"):
        odd = odd.withColumn(clash, F.lit("clash"))
    return odd


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11: byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bytebpe.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def _ids(library, text):
    return np.array(library.encode_ordinary(text or ""), "<u4").tobytes()


def test_perfect_hash_is_minimal_and_perfect(vocabulary):
    assert sorted(vocabulary.hash.slots(list(vocabulary.ranks)).tolist()) == list(range(len(vocabulary.ranks)))
    for n in (0, 1, 2, 3, 5, 64, 1000):
        keys = [f"{n}-{i}".encode() for i in range(n)]
        assert sorted(bytebpe.PerfectHash(keys).slots(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        bytebpe.PerfectHash([b"a", b"a"])
    assert vocabulary.whole([b"the", b"no such token"]) == [vocabulary.ranks[b"the"], -1]


def test_bpe_of_every_character_as_the_library(vocabulary, library):
    worker = bytebpe.Encoder(vocabulary)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        text = "a".join(f"{chr(c)}{chr(c)} {chr(c)}1" for c in points[at : at + 20_000])
        assert worker.encode(text) == _ids(library, text)


def test_bpe_of_long_and_cut_texts(vocabulary, library, monkeypatch):
    worker = bytebpe.Encoder(vocabulary)
    for text in ("a" * 30_000, "ab" * 20_000, " " * 30_000 + "x", "東京" * 5000, LONG):
        assert worker.encode(text) == _ids(library, text)
    monkeypatch.setattr(bytebpe, "SEGMENT", 30)
    monkeypatch.setattr(bytebpe, "REMEMBERED_BYTES", 2000)
    rnd = random.Random(5)
    for _ in range(200):
        text = "".join(rnd.choice("  \n\tab's1.é日'") for _ in range(300))
        assert worker.encode(text) == _ids(library, text)


def test_bpe_query_as_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op11_byte_bpe(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = _ids(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_bpe_edges(spark, vocabulary, library, edges, none):
    shared = spark.sparkContext.broadcast(vocabulary)
    got = bytebpe.round_trip(edges, shared).collect()
    assert Counter((r["id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == Counter((i, _ids(library, t), (t or "").encode()) for i, t, *_ in EDGES)
    apart = bytebpe.decode(bytebpe.encode(edges, shared), shared).collect()
    assert Counter(map(str, apart)) == Counter(map(str, got))
    assert bytebpe.round_trip(none, shared).count() == 0
    nulls = bytebpe.decode(spark.createDataFrame([(1, None)], "id long, ids binary"), shared).collect()
    assert [tuple(r) for r in nulls] == [(1, None, None)]
    with pytest.raises(ValueError):
        bytebpe.Vocabulary({b"a": 1}, ".")


# --- 12: whitening


def _whitened(vectors, most=16):
    """Plain whitening: (n, S, deviations, components, eigenvalues, explained)."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array((n * fit - sums) / n, float)
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    kept = [i for i in np.argsort(values)[::-1] if values[i] > values.max() * 1e-10][:most]
    y = np.array((n * x - sums) / n, float) @ vectors_[:, kept] / np.sqrt(values[kept])
    return n, ((n * x - sums) ** 2).sum(1), y, values[kept] / values.sum()


def _compare(rows, vectors, ids):
    n, deviations, y, explained = _whitened(vectors)
    assert len(rows) == len(vectors) * y.shape[1]
    by = {}
    for r in rows:
        by.setdefault(r["id"], {})[r["component"]] = r
    got = np.array([[by[i][k + 1]["whitened"] for k in range(y.shape[1])] for i in ids])
    assert np.allclose(got * np.sign((got * y).sum(0)), y, atol=1e-8)
    for at, i in enumerate(ids):
        assert {(r["n"], r["deviation"]) for r in by[i].values()} == {(n, deviations[at])}
        assert np.allclose([by[i][k + 1]["explained"] for k in range(y.shape[1])], explained, rtol=1e-9)


def test_whitening_against_numpy(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    got = queries.op12_embedding_whitening(spark, DATA).withColumnRenamed("vec_id", "id").collect()
    _compare(got, [r["embedding"] for r in rows], [r["vec_id"] for r in rows])
    assert {r["identity_error"] < 1e-10 for r in got} == {True} and len({r["identity_error"] for r in got}) == 1


def test_moments_merge_like_one_batch():
    x = np.random.default_rng(3).integers(999_000, 1_001_000, (500, 7))
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 3, 250, 499])]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merged(p)
    whole = whitening.Moments.of(x)
    assert merged.sums == whole.sums == x.sum(0).tolist() and merged.n == 500
    assert np.allclose(merged.scatter, whole.scatter, rtol=1e-9, atol=1e-3) and np.allclose(merged.mean, whole.mean)


def test_whitening_edges(spark):
    rnd = np.random.default_rng(1)
    good = [(i, [float(c) for c in rnd.normal(size=5)]) for i in range(40)]
    copies = [(100 + i, good[0][1]) for i in range(5)] + [good[1]]  # copies count once; a repeated row gives its rows again
    lengths = [(200, [1.0, 2.0]), (201, [1.5, 2.0]), (202, [1.0, 9.0]), (203, [7.0])]
    bad = [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [float("nan")] * 5), (304, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (305, [1e30, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(good + copies[:-1] + lengths + bad + [(None, good[2][1])], "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("id", F.lit("clash"))
    grid = whitening.on_grid(table)
    model = whitening.fit(grid)
    rows = whitening.components(grid, model).collect()
    five = [r for r in rows if r["id"] is not None and r["id"] < 200]
    _compare(five, [v for _, v in good + copies[:-1]], [i for i, _ in good + copies[:-1]])
    assert sum(r["id"] is None for r in rows) == 5
    two = [r for r in rows if r["id"] in (200, 201, 202, 203)]
    assert {r["n"] for r in two} == {3} and 203 not in {r["id"] for r in two}  # one distinct vector has no variance
    assert not {r["id"] for r in rows} & {300, 301, 302, 303, 304, 305} and model.identity_error < 1e-8
    twice = whitening.on_grid(table.unionAll(table))
    assert whitening.components(twice, whitening.fit(twice)).count() == 2 * len(rows)
    empty = whitening.on_grid(table.where("false"))
    nothing = whitening.fit(empty)
    assert nothing.identity_error == 0 and whitening.components(empty, nothing).count() == 0


def test_whitening_beyond_64_bits(spark):
    table = spark.createDataFrame([(1, [2.0**50, 0.0]), (2, [-(2.0**50), 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    grid = whitening.on_grid(table)
    model = whitening.fit(grid)
    assert model.lengths[2].sums == [3_000_000, 3_000_000 + 3 * 64]
    assert {r["id"]: r["deviation"] for r in whitening.transform(grid, model).collect()} == {1: None, 2: None, 3: (3 * 64) ** 2}


# --- 13: phrases


def _mine(rows, least, most, cover=100):
    """Plain phrase mining."""
    counts, words = {}, Counter()
    for lang, text in rows:
        lang, low = "und" if lang is None else lang, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            words[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covered[p[i : i + n]] = max(covered[p[i : i + n]], a)
        rows_ = []
        for p, a in found.items():
            if p in covered and 100 * covered[p] >= cover * a:
                continue
            score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("most,cover", [(1000, 100), (7, 100), (1000, 60)])
def test_phrases_against_plain_counting(spark, monkeypatch, most, cover):
    monkeypatch.setattr(collocations, "CHUNK", 2000)
    monkeypatch.setattr(collocations, "HELD", 5000)
    monkeypatch.setattr(collocations, "RANGE_BYTES", 300)
    rnd = random.Random(11)
    vocabulary = ["a", "b", "B", "ab", "a\x01", "é", "É", "x-y", "the", "of", "東京", "\x1f", " "]
    rows = []
    for i in range(150):
        text = "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "\t", "  ", " ", ". ", ",", "\n", "\x0c", "\r\n"]) for _ in range(rnd.randint(0, 60)))
        rows.append((i % 40 or None, text + "the best of all the b" * rnd.randint(0, 3), rnd.choice(["en", "de", None, "und", ""])))
    rows += [rows[3]] * 5 + [(1, None, "en"), (2, "", "de"), (3, " .\n,", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("word", F.lit("clash")).withColumn("key", F.lit(1)).repartition(5)
    got = sorted(map(tuple, collocations.mine(docs, least=6, most=most, cover=cover).collect()))
    assert got == _mine([(lang, text) for _, text, lang in rows], 6, most, cover) and len(got) > 10


def test_phrases_query_as_its_sql(spark):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    want = con.execute(queries.ORACLES["op13_phrase_collocations"])
    columns = [c[0] for c in want.description]
    got = queries.op13_phrase_collocations(spark, data)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_phrases_edges(spark, edges, none):
    got = collocations.mine(edges, least=100).collect()
    assert sorted((r["phrase"], r["a"]) for r in got) == sorted((r[2], r[3]) for r in _mine([(lang, text) for _, text, lang, *_ in EDGES], 100, 2000))
    assert collocations.mine(none).count() == 0 and collocations.mine(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.mine(edges.where("doc_id = 6"), least=100).count() == 0


def test_radix_order_and_run_lengths():
    rnd = np.random.default_rng(2)
    for width, top in ((1, 200), (2, 60_000), (3, 1 << 22), (5, 1 << 38)):
        places = rnd.integers(0, top, (300, 5)).astype(np.uint64) % np.uint64(max(3, top // 2))
        order = collocations.radix_sorted(places, width)
        assert [tuple(places[i]) for i in order] == sorted(map(tuple, places))
    keys = np.array([[1, 1, 2, 0, 0], [1, 1, 2, 1, 0], [1, 2, 0, 0, 0], [3, 1, 0, 0, 0]], np.uint8)
    assert sorted(collocations.run_lengths(keys, np.array([2, 1, 5, 1]), 1, 3)) == [(b"\1\1", 3), (b"\1\1\2", 3), (b"\1\2", 5), (b"\3\1", 1)]


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**15, 4 * 10**17, 10**15, 10**15)], "f long, n long, l long, r long")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    assert rows.select(collocations.score_of(exact("f"), exact("n"), exact("l"), exact("r"))).first()[0] == 1000 * 4 * 10**17 // 10**15
