"""SimHash, embeddings, URL filters and the pipeline against brute force."""

import itertools
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from heliograph.llm import bloom, langid, neardup_vectors, queries, secrets, simhash, urlfilter
from heliograph.operators.components import connected_components
from tests.llm.brute import contaminated as _brute_contaminated

DATA = "/root/testdata/sf0.001"


def _reach(nodes, pairs):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    random = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (200, 201), (201, 202)] + [tuple(map(int, random.integers(300, 400, 2))) for _ in range(60)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    want = _reach({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == r for n, r in want.items())


# --- 8


def _plain_fingerprint(text, width):
    words = (text or "").encode().translate(simhash.LOWER).split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < width else [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_bit_slices_find_all_close_pairs():
    random = np.random.default_rng(2)
    fps = random.integers(0, 1 << 63, 700, np.uint64)
    for i in range(0, 500, 2):
        fps[i + 1] = fps[i] ^ np.uint64(sum(1 << int(b) for b in random.choice(64, int(random.integers(0, 9)), replace=False)))
    for radius in (0, 1, 4, 13):
        left, right = simhash.close_pairs(fps, radius)
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius, 1))
        assert sorted(zip(left.tolist(), right.tolist())) == sorted(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("block", [2048, 8])
def test_simhash_groups_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    base = [r["text"] for r in docs.where("doc_id < 12").collect()]
    more = [(1000 + 10 * i + k, t if k == 0 else f"{t} extra{k}") for i, t in enumerate(base) for k in range(3)] + [(5000, None), (5001, ""), (5002, "..."), (5003, "..."), (5003, "..."), (5004, " \t")]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("fp", F.lit("clash"))
    got = sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.group(every, width=4, radius=4).collect())
    rows = every.collect()
    fps = [(r["doc_id"], _plain_fingerprint(r["text"], 4)) for r in rows]
    pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(fps, 2) if (x ^ y).bit_count() <= 4]
    roots = _reach({i for i, _ in fps}, pairs)
    assert got == sorted((i, f, roots[i]) for i, f in fps)


def test_simhash_edges(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (None, "zz yy xx")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.group(frame).collect()), key=str)
    assert got == [(2, 2), (3, 2), (None, 2), (None, None)]
    assert simhash.group(frame.limit(0)).count() == 0 and simhash.deduplicate(frame.limit(0)).count() == 0


def test_deduplicate_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    extra = spark.createDataFrame([(None, None, None, None, None), (9000, "", None, None, 0), (9001, None, None, None, None)], docs.schema)
    twice = docs.where("doc_id = 5")
    every = docs.unionByName(twice).unionByName(extra).withColumn("row", F.lit("clash"))
    kept = simhash.deduplicate(every)
    assert kept.columns == every.columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=str)
    texts = {r["doc_id"]: r["text"] for r in every.collect() if r["doc_id"] is not None}
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert got == sorted(set(_reach(set(texts), pairs).values()), key=str)


def test_deduplicate_compares_equal_fingerprints(spark, monkeypatch):
    # All texts share one fingerprint: only similar sets may merge.
    monkeypatch.setattr(simhash, "signatures", lambda *a, inner=simhash.signatures: inner(*a).withColumn("fp", F.lit(5).cast("long")))
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[1] + " more"), (4, texts[2]), (5, texts[2].upper())]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]


def test_deduplicate_keeps_texts_that_share_a_repeated_line(spark):
    line = " ".join(f"line{i}" for i in range(13))
    rows = [(k, " ".join(f"own{k}x{i}" for i in range(40)) + f" {line}" * 60) for k in range(2)]
    assert simhash.fingerprint(rows[0][1], 5) == simhash.fingerprint(rows[1][1], 5)
    assert simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_candidates_at_the_threshold():
    random, found, n = np.random.default_rng(8), 0, 1500
    for _ in range(n):
        size = int(random.integers(40, 400))
        own = round(size * (1 - 0.8) / (1 + 0.8) - 0.5)  # both texts have that many of their own
        h = random.integers(0, 1 << 63, size + own, np.uint64)
        a, b = h[:size], h[own:]
        near = (simhash.majority(a) ^ simhash.majority(b)).bit_count() <= simhash.WIDE_RADIUS
        found += near and bool((simhash.table_keys(a) == simhash.table_keys(b)).any())
    assert found >= 0.998 * n


@pytest.mark.parametrize("radius", [20, 80])
def test_bit_slices_of_long_fingerprints(radius):
    random = np.random.default_rng(radius)
    fps = random.integers(0, 1 << 63, (300, simhash.WORDS), np.uint64)
    for i in range(0, 300, 2):
        flipped = np.zeros(64 * simhash.WORDS, np.uint8)
        flipped[random.choice(len(flipped), int(random.integers(0, 100)), replace=False)] = 1
        fps[i + 1] = fps[i] ^ np.packbits(flipped).view(np.uint64)
    left, right = simhash.close_pairs(fps, radius)
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(-1) <= radius, 1))
    assert len(a) and sorted(zip(left.tolist(), right.tolist())) == sorted(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("k", [7, 9, 12])
def test_fingerprint_tables_find_what_is_similar(k):
    random, found, n, places = np.random.default_rng(k), 0, 1000, simhash.tables_of_bits(k)
    for _ in range(n):
        size = int(random.integers(10, 400))
        own = round(size * (1 - 0.8) / (1 + 0.8) - 0.5)
        h = random.integers(0, 1 << 63, size + own, np.uint64)
        a, b = simhash.wide_fingerprint(h[:size]), simhash.wide_fingerprint(h[own:])
        keys = simhash.keys_of(np.stack([a, b]), places)
        found += np.bitwise_count(a ^ b).sum() <= simhash.WIDE_RADIUS and bool((keys[0] == keys[1]).any())
    assert found >= 0.998 * n


def test_deduplicate_in_blocks_by_tables_of_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, f"{t} more") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = simhash.signatures(docs, 5, "doc_id", "text").select("node", "fp", "more", "row")
    assert simhash.similar_links(docs, classes, 5, 0.8, "doc_id", "text").count() >= 40
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == list(range(40))


def test_deduplicate_finds_copies_at_the_threshold(spark):
    random = np.random.default_rng(9)
    words = [[f"w{k}x{i}" for i in random.permutation(9000)[:200]] for k in range(60)]
    # Of 196 shingles 20 change, each in both texts: a similarity of 176 / 216 = 0.815.
    rows = [(k, " ".join(w)) for k, w in enumerate(words)] + [(1000 + k, " ".join([*(f"v{i}" for i in range(20)), *w[20:]])) for k, w in enumerate(words)]
    rows += [(2000, f"{rows[0][1]} {rows[1][1][:0]}" + (" " + " ".join(f"l{i}" for i in range(13))) * 60), (2001, rows[0][1])]
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(kept & set(range(60))) == 60 and len(kept & set(range(1000, 1060))) <= 1 and 2001 not in kept and 2000 not in kept


def test_deduplicate_leaves_clashing_columns_alone(spark):
    rows = [(1, "a b c d e f", "mine", 1, "x"), (2, "a b c d e f", "yours", 2, "y"), (3, "g h i j k", "ours", 3, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string, maybe int, `stays.or` string")
    assert sorted(map(tuple, simhash.deduplicate(frame).collect())) == [rows[0], rows[2]]


# --- 4


def _vectors(random, n=300):
    base = random.normal(size=(n, 64))
    near = base[:120] + random.normal(size=(120, 64)) * 0.04
    some = base[:60] + random.normal(size=(60, 64)) * 0.055
    return np.concatenate([base, near, some, base[:20], base[:1].repeat(30, axis=0)])


@pytest.mark.parametrize("block", [1024, 16])
def test_vector_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup_vectors, "BLOCK", block)
    x = _vectors(np.random.default_rng(5))
    odd = [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] + [1.0] * 63), (2003, [float("inf")] + [1.0] * 63), (2004, [1.0]), (2005, [None] + [1.0] * 63), (None, x[0].tolist())]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash")).withColumn("n", F.lit(1))
    rows = neardup_vectors.near_duplicates(frame).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == len(x) + len(odd)
    assert all(got[i] == (0, i, True) for i in range(2000, 2006)) and got[None] == (0, None, False)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[i][0] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.97 * near.sum()
    roots = _reach(range(len(x)), zip(*map(np.ndarray.tolist, np.nonzero(near))))
    assert np.mean([got[i][1] == roots[i] and got[i][2] == (roots[i] == i) for i in range(len(x))]) > 0.97
    assert neardup_vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_of_every_length_link_among_themselves(spark):
    rows = [(1, [1.0, 2.0]), (2, [5.0, -1.0]), (3, [-3.0, 1.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.01]), (6, [1.0]), (7, [2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}


def test_vector_recall_at_the_threshold():
    random = np.random.default_rng(6)
    x = random.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = random.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    (a, more_a), (b, more_b) = neardup_vectors.buckets(x), neardup_vectors.buckets(y)
    met = ((a == b) | (a[:, :, None] == more_b).any(2) | (b[:, :, None] == more_a).any(2)).any(1)
    assert met.mean() > 0.97


# --- 10


def test_bloom_filter_passes_all_members(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    maybe = bloom.maybe_in(keys)
    assert keys.where(maybe("h")).count() == 20_000
    assert spark.range(1 << 40, (1 << 40) + 20_000).where(maybe(F.xxhash64("id"))).count() < 1000
    assert spark.range(50).where(bloom.maybe_in(keys.limit(0))(F.xxhash64("id"))).count() == 0


def _judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=(0, None, None))
    listed = path.startswith("/") and any(host == f"{s}.{d}" or host.endswith(f".{s}.{d}") for s in queries.LISTED_SITES for d in queries.LISTED_DOMAINS)
    return host, path, rule[1], rule[2] or ("block" if listed else "allow")


def test_urls_against_brute_force(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.EXAMPLE.COM/en/x?y#z", "http://example.com/en/", "http://b.example.com/en/q", "http://notexample.com/en/", "x://spam-farm.example.org/a", "x://m.spam-farm.example.org", "http://a.net/es/1", "http://a.net/es", "http://net/fr/", "http://É.COM/p", "http://a.com://b.net/es/", "http://a?b.com/", "http://a.b..net/fr/x\ny", *["http://a.com/"] * 3, "http://" + "a." * 3000 + "com/" + "p" * 5000]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries.op10_url_filters(spark, str(tmp_path)).collect())
    assert got == [(i, *_judged(u)) for i, u in enumerate(urls)]
    own = spark.createDataFrame([(1, "http://a.com/x", "mine", "too")], "page_id long, url string, host string, path string")
    entry = spark.createDataFrame([("com", "/", "block", "rule")], "host string, path string, verdict string, kind string")
    row = urlfilter.judge(own, entry).first()
    assert (row["page_host"], row["page_path"], row["host"], row["path"], row["entry"]) == ("mine", "too", "a.com", "/x", "com/")
    none = spark.createDataFrame([], "page_id long, url string")
    entries = spark.createDataFrame([("com", "/", "block", "rule")], "host string, path string, verdict string, kind string")
    assert urlfilter.judge(none, entries).count() == 0
    assert set(urlfilter.judge(none, entries.limit(0)).columns) == set(urlfilter.judge(none, entries).columns)


# --- pipeline


def _plain_pipeline(spark, rows, items):
    """(doc_id, piece, start, length, ids_crc32) of what the five stages leave, one document at a time."""
    from tokenizers import Tokenizer

    labelled = [(t, lang) for _, t, lang in rows if t is not None and lang is not None]
    langs, sure = langid.predict(langid.train(*map(list, zip(*sorted(labelled)))), [t for _, t, _ in rows])
    rows = [(i, t) for (i, t, _), lang, s in zip(rows, langs, sure) if lang != "und" and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    first = set(_reach(set(sets), pairs).values())
    rows = [(i, t) for i, t in rows if i in first]
    found = _brute_contaminated([t for _, t in rows], items)
    rows = [r for r, f in zip(rows, found) if not f]
    spans = {}
    for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["start"] + r["length"]))
    tokenizer, out = Tokenizer.from_file(queries.tokenizer_path()), []
    for i, t in rows:
        for a, b in sorted(spans.get(i, []), reverse=True):
            t = t[:a] + secrets.MASK + t[b:]
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4")
        out += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    return sorted(out), {i for i, _ in rows}, spans


def test_pipeline_against_plain_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 200 and length(text) < 2500").select("doc_id", "text", "lang", "source", "n_chars")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").limit(8).collect()]
    base = [r["text"] for r in docs.where("length(text) > 600 and doc_id > 20").orderBy("doc_id").limit(6).collect()]
    key = "dGhpc0lzQVZlcnlTZWNyZXRLZXk4NDcyMzQ"
    planted = [(9000, base[0]), (9001, base[1] + " and three more words"), (9002, "9 8 7"), (9003, None), (9004, f"{base[2][:90]} own words here {items[0][1]} end"), (9005, f'the house and the garden of the man api_key = "{key}" and that is the end of it all')]
    every = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in planted], docs.schema))
    every.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, left, spans = _plain_pipeline(spark, sorted((r["doc_id"], r["text"], r["lang"]) for r in every.collect()), items)
    assert not left & {9000, 9001, 9002, 9003, 9004} and 9005 in left and 9005 in spans
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(packed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, seq in packed.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum().tolist()[:-1]] and seq["length"].sum() <= 4096


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_vectors_that_share_an_id_have_links_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.999, 0.01]), (2, [0.998, 0.02]), (3, [0.0, 1.0]), (3, [0.998, 0.02])]
    got = neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (3, 3, 1, False)]
