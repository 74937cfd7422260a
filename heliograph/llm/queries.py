"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import bytebpe, collocations, decontaminate, langid, neardup_vectors, packing, pii, quality, secrets, simhash, substring_dedup, urlfilter, whitening
from heliograph.llm.common import crc_mod, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each finding, with the secret's digest in place of the secret."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("secret", 256).alias("secret_sha256"), "score")


#: A deployment passes its own key.
PII_KEY = b"heliograph example key"


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with an entity, with its rewritten text; all others are as they were."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document; all others are clean."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Rules (host, path, verdict), longest first to win.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Sites whose canonical roots are listed for blocking, under each of the domains.
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_DOMAINS = ["example.com", "example.net", "example.org"]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = [(f"{site}.{domain}", "/", "block", "listed") for site in LISTED_SITES for domain in LISTED_DOMAINS]
    entries = spark.createDataFrame([(*rule, "rule") for rule in URL_RULES] + listed, "host string, path string, verdict string, kind string")
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), entries)
    rule = F.when(F.col("entry_kind") == "rule", F.col("entry"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("entry_verdict", F.lit("allow")).alias("verdict"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bytebpe.shared_vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    both = bytebpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return both.select(F.col("id").alias("doc_id"), n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector and component."""
    grid = whitening.on_grid(table(spark, sf_dir, "embeddings"))
    model = whitening.fit(grid)
    return whitening.components(grid, model).withColumnRenamed("id", "vec_id").withColumn("identity_error", F.lit(model.identity_error))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), least=100, most=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_url_filters": op10_url_filters,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_phrase_collocations": op13_phrase_collocations,
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op10_url_filters": """
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parsed AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), judged AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
                regexp_matches('.' || host, '[.](ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]example[.](com|net|org)$') AND starts_with(path, '/') AS listed
            FROM parsed
        )
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
               CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
        FROM judged
    """,
    "op13_phrase_collocations": r"""
        WITH lowered AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), pieces AS (
            SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS words
            FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM lowered)
        ), grams AS (
            SELECT lang, words[i : i + k - 1] AS phrase, k
            FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
        ), f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL
        ), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
        ), candidates AS (SELECT lang, phrase, k, f AS a FROM f WHERE k >= 2 AND f >= 100
        ), inside AS (
            SELECT lang, phrase[i : i + m - 1] AS phrase, max(a) AS longer
            FROM (SELECT lang, phrase, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
            GROUP BY ALL
        ), kept AS (
            SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
        ), scored AS (
            SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) c
            JOIN f l ON l.lang = c.lang AND l.phrase = c.phrase[1 : cut] JOIN f r ON r.lang = c.lang AND r.phrase = c.phrase[cut + 1 :] JOIN totals t ON t.lang = c.lang
        ), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), ranked AS (
            SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM lowest
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM ranked QUALIFY rank <= 2000
    """,
}
