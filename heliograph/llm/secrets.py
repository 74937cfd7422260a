"""Secret scanning with a random forest that removes false positives; DataFrame functions only.

Candidates are runs of 16 or more key characters, of any length, that hold a digit or begin as known keys do,
without the name that an equals sign sets off, and quoted or bare values of 8 or more characters assigned to a
name that ends like password, token or api_key. Each gets features of itself (length, character
transitions, character classes, distinct characters, dictionary coverage), of the path it may be part of
and of its neighbouring words. A random forest trained on labelled findings scores it, and candidates
below THRESHOLD are dropped as false positives.

The labelled findings are made by rule: FINDINGS rows of key-like strings in the places where secrets
stand (assignments, headers, environment files) and in those where look-alikes stand (commit ids, checksums,
identifiers, file paths, card numbers, placeholders), drawn from digests of the row number. Their number
is fixed, so training does not grow with the corpus.

Null and empty texts have no candidates. A candidate found twice in a text is two findings. Exactly
repeated rows give their findings once. Findings of rows with a null id have a null id.
An empty table has no findings. Columns of the texts that are named like an added one keep their values where rows are redacted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from heliograph.llm.common import as_rows, quoted
from heliograph.shared import cut

THRESHOLD = 0.5
FINDINGS = 2000
TREES, DEPTH, SEED = 24, 7, 5
#: Characters kept on either side of a candidate.
AROUND = 64
MASK = "[SECRET]"

#: Keys that issuers mark; these need no digit.
KNOWN = r"(?:AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|xox[abeprs]-|[rs]k_(?:live|test)_|sk-|eyJ)"
RUN = rf"(?=[\w+/=.\-]{{16}})(?=[A-Za-z+/_=.\-]*+[0-9]|{KNOWN})[\w+/=.\-]{{16,}}+"
#: The name before an equals sign in a run.
SET = r"[A-Za-z_][\w.\-]{0,63}+={1,2}"
#: The name and the quote belong to the match, not to the candidate. The first look ahead leaves most words at once.
NAMED = r"(?=[\w.\-]{3,}+[\"']?\s{0,2}[:=])[\w.\-]*?(?i:passw(?:or)?d|passphrase|pwd|secret|token|credential|(?:api|access|auth|private|secret|account|encryption|signing|ssh)[_.\-]?key)(?:s|_?id|_?value)?[\"']?\s{0,2}[:=]\s{0,2}[\"']?"
VALUE = r"(?![\s\"'])[^\s\"']{8,}+"
#: Both kinds begin where no word goes on, which is looked at once.
CANDIDATE = rf"(?<![\w.\-])(?:{NAMED}{VALUE}|(?<![+/=])(?=[\w+/=.\-]{{16}})(?:{SET}(?={RUN}))?{RUN})"
#: What of a candidate's match comes before the candidate.
LEAD = rf"^(?:{NAMED}(?={VALUE})|{SET}(?={RUN}))"

#: Parts of identifiers, paths and placeholders that real keys hold only by chance.
DICTIONARY = ["access", "admin", "archive", "backup", "build", "cache", "change", "class", "client", "config", "count", "create", "data", "debug", "default", "demo", "document", "download", "dummy", "error", "example", "export", "field", "file", "final", "folder", "global", "group", "here", "home", "image", "import", "index", "input", "insert", "item", "label", "library", "local", "login", "main", "message", "model", "module", "name", "number", "output", "package", "page", "password", "path", "placeholder", "print", "python", "query", "release", "report", "request", "result", "sample", "script", "secret", "server", "service", "session", "source", "state", "static", "status", "string", "style", "system", "table", "temp", "test", "text", "time", "title", "token", "type", "update", "upload", "user", "value", "version", "your"]
SECRET_WORDS = r"(?i)(token|secret|passw|passphrase|api.?key|access.?key|private|auth|bearer|credential|pwd)[^\n]{0,12}$"
OTHER_WORDS = r"(?i)(sha\d*|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|version|build|order|invoice|card|phone|serial|isbn|\bid|image|see|file|path|from|ref)\W{0,6}$"

FEATURES = ["length", "transitions", "digits", "uppers", "marks", "distinct", "dictionary", "hex", "numeric", "path", "secret_word", "other_word", "assigned", "quoted"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, ordinal, start, cand, before, after): every candidate; start counts characters from 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(CANDIDATE))
    cut = rows.select("id", F.xxhash64("text").alias("text_hash"), F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("found"), F.split("text", CANDIDATE, -1).alias("parts"))
    each = cut.select("id", "text_hash", F.posexplode(F.arrays_zip(F.col("found").alias("cand"), F.transform("parts", lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(AROUND)).alias("last"), F.left(p, F.lit(AROUND)).alias("first"))).alias("part"), F.slice(F.transform("parts", lambda p: F.left(p, F.lit(AROUND))), 2, F.size("parts")).alias("after"))).alias("ordinal", "z"))
    flat = each.where("z.cand is not null").select("id", "text_hash", "ordinal", "z.cand", F.col("z.part.n").alias("n"), F.col("z.part.last").alias("before"), F.col("z.after").alias("after"))
    flat = flat.dropDuplicates(["id", "text_hash", "ordinal"])
    # The name of an assignment goes to what stands before.
    name = F.regexp_extract("cand", LEAD, 0)
    flat = flat.withColumns({"n": F.col("n") + F.length(name), "before": F.right(F.concat("before", name), F.lit(AROUND)), "cand": F.substr("cand", F.length(name) + 1)})
    upto = Window.partitionBy("id", "text_hash").orderBy("ordinal")
    ends = F.sum(F.col("n") + F.length("cand")).over(upto)
    return flat.select("id", "text_hash", "ordinal", (ends - F.length("cand")).cast("long").alias("start"), "cand", "before", "after")


def distinct_characters(text: Column) -> Column:
    """How many different characters a text of any length has, looked at in runs of 4096."""
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 4096).cast("int")), lambda i: F.array_distinct(F.split(F.substr(text, i * 4096 + 1, F.lit(4096)), "")))
    return F.size(F.array_remove(F.array_distinct(F.flatten(runs)), ""))


def features(found: DataFrame) -> DataFrame:
    """found(cand, before, after, ...) with the FEATURES as doubles."""
    cand, before, after = F.col("cand"), F.col("before"), F.col("after")
    n = F.length(cand).cast("double")
    without = lambda rx: n - F.length(F.regexp_replace(cand, rx, ""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(cand, r"[0-9]", "\u0001"), r"[a-z]", "\u0002"), r"[A-Z]", "\u0003"), r"[^\x01\x02\x03]", "\u0004")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {
        "length": F.least(n, F.lit(200.0)),
        "transitions": (runs - 1) / n,
        "digits": without(r"[0-9]") / n,
        "uppers": without(r"[A-Z]") / n,
        "marks": without(r"[^A-Za-z0-9]") / n,
        "distinct": distinct_characters(cand) / F.least(n, F.lit(40.0)),
        "dictionary": (n - F.length(F.regexp_replace(F.lower(cand), "|".join(DICTIONARY), ""))) / n,
        "hex": flag(cand.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "numeric": flag(cand.rlike(r"^[0-9.\-]+$")),
        "path": flag(cand.rlike(r"/[A-Za-z_.\-]+/|\.[a-z]{2,4}$|^[./]") | before.rlike(r"(://\S{0,60}|[/\\@])$") | after.rlike(r"^[/\\@]")),
        "secret_word": flag(before.rlike(SECRET_WORDS) | cand.rlike(r"(?i)^(akia|ghp_|xox|sk_live|glpat)")),
        "other_word": flag(before.rlike(OTHER_WORDS)),
        "assigned": flag(before.rlike(r"[:=]\s{0,2}[\"']?$")),
        "quoted": flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()})


def labelled_findings(spark: SparkSession) -> DataFrame:
    """(cand, before, after, label): FINDINGS made findings, the same at every call."""
    i = F.col("id")
    seed = lambda salt: F.sha2(F.concat(F.lit(f"finding {salt} "), i.cast("string")), 256)
    size = lambda low, high, salt: (F.lit(low) + F.pmod(F.crc32(F.concat(F.lit(salt), i.cast("string")).cast("binary")), F.lit(high - low + 1))).cast("int")
    hexes = lambda n, salt="h": F.substring(F.concat(seed(salt), seed(salt + "2")), F.lit(1), n if isinstance(n, Column) else F.lit(n))
    mixed = lambda n, salt="m": F.substring(F.translate(F.base64(F.unhex(F.concat(seed(salt), seed(salt + "2")))), "+/=\r\n", "xZ"), F.lit(1), n if isinstance(n, Column) else F.lit(n))
    digits = lambda n, salt="d": F.substring(F.translate(seed(salt), "abcdef", "019283"), 1, n)
    word = lambda salt: F.element_at(F.array(*map(F.lit, ["report", "user", "index", "sample", "export", "value", "client", "module"])), size(1, 8, salt))
    prose = F.element_at(F.array(*map(F.lit, ["and then we had the ", "it was shown in ", "des les pour ", "und der mit ", "que las con "])), size(1, 5, "prose"))
    quote = F.element_at(F.array(*map(F.lit, ['"', "'", ""])), size(1, 3, "quote"))
    name = lambda *names: F.element_at(F.array(*map(F.lit, names)), size(1, len(names), "name"))
    assign = F.element_at(F.array(*map(F.lit, [" = ", "=", ": "])), size(1, 3, "assign"))
    made = [  # label, before, candidate
        (1, F.concat(prose, name("token", "TOKEN", "auth_token", "access_token"), assign, quote), hexes(size(32, 44, "n1"))),
        (1, F.concat(name("api_key", "apikey", "API_KEY", "x-api-key"), assign, quote), mixed(size(24, 40, "n2"))),
        (1, F.concat(name("password", "passwd", "db_password", "PASSWORD"), assign, quote), mixed(size(10, 22, "n3"))),
        (1, F.concat(name("password", "passwd", "secret", "PASSWORD"), assign, quote), F.concat(F.substring(F.translate(seed("w"), "0123456789", "ghkmnprtvw"), F.lit(1), size(5, 10, "n0")), digits(3))),
        (1, F.concat(F.lit("Authorization: "), name("Bearer ", "bearer ", "token ")), mixed(size(40, 70, "n4"))),
        (1, F.concat(name("secret", "client_secret", "SECRET"), assign, quote), hexes(size(32, 64, "n5"))),
        (1, F.concat(name("aws_access_key_id", "key", "id"), assign, quote), F.concat(F.lit("AKIA"), F.upper(mixed(16)))),
        (1, prose, F.concat(name("ghp_", "sk_live_", "glpat-", "xoxb-"), mixed(size(24, 40, "n6")))),
        (1, F.concat(prose, name("private key ", "credential ", "secret token ")), mixed(size(28, 48, "n7"))),
        (0, F.concat(prose, name("commit ", "revision ", "ref ")), hexes(40)),
        (0, F.concat(name("sha256:", "sha1 ", "checksum: ", "digest=", "md5 "), quote), hexes(size(32, 64, "n8"))),
        (0, F.concat(name("id: ", "uuid ", "request id=", "see "), quote), F.concat_ws("-", hexes(8, "a"), hexes(4, "b"), hexes(4, "c"), hexes(4, "d"), hexes(12, "e"))),
        (0, prose, digits(16)),
        (0, F.concat(name("token", "password", "api_key", "secret"), assign, quote), F.concat(name("your", "example", "test", "dummy", "sample"), F.lit("_"), name("token", "password", "value", "placeholder"), F.lit("_"), name("here", "string", "default"), digits(2))),
        (0, F.concat(prose, name("in ", "file ", "from ")), F.concat(F.lit("/"), word("w1"), F.lit("/"), word("w2"), F.lit("/"), word("w3"), F.lit("_"), digits(4), name(".txt", ".py", ".csv", ".json"))),
        (0, F.concat(name("password", "secret", "token", "key"), assign, quote), F.concat(F.repeat(name("x", "X", "0", "-"), 16), digits(2))),
        (0, prose, F.concat_ws("-", digits(4, "y"), digits(2, "mo"), digits(2, "da"), digits(2, "ho"), digits(2, "mi"), digits(3, "se"))),
        (0, prose, F.concat_ws("_", word("v1"), word("v2"), word("v3"), digits(2))),
        (0, F.concat(F.lit("http"), name("s://", "://"), name("mail", "cdn", "www"), F.lit(".")), F.concat(name("example.com", "example.org"), F.lit("/"), word("u1"), F.lit("/"), digits(6))),
        (0, prose, F.concat_ws(".", digits(4, "p1"), digits(4, "p2"), digits(4, "p3"), digits(4, "p4"))),
        (0, F.concat(name("card ", "order ", "phone ", "invoice "), quote), digits(18)),
    ]
    each = FINDINGS // len(made)
    parts = [spark.range(k * each, (k + 1) * each, 1, 1).select(cand.alias("cand"), before.alias("before"), F.concat(F.regexp_extract(before, r"[\"']$", 0), F.lit(" and more")).alias("after"), F.lit(float(label)).alias("label")) for k, (label, before, cand) in enumerate(made)]
    return reduce(DataFrame.unionAll, parts)


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest on labelled findings(cand, before, after, label)."""
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(findings)).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(data.coalesce(1))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, text_hash, ordinal, start, length, secret, score) of the candidates that the forest keeps."""
    # Read from one file, the features are planned once, not in every branch of the union.
    model = model or train(cut(labelled_findings(docs.sparkSession).coalesce(1), "findings"))
    found = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs, id_col, text_col)))
    scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    kept = scored.where(F.col("score") >= threshold)
    return kept.select(F.col("id").alias(id_col), "text_hash", "ordinal", "start", F.length("cand").cast("long").alias("length"), F.col("cand").alias("secret"), "score")


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every kept finding replaced by MASK; rows, other columns and clean texts stay as they are.

    Only texts with a candidate are shuffled, to meet their findings.
    """
    text = F.col(quoted(text_col))
    suspect = F.coalesce(text.rlike(CANDIDATE), F.lit(False))
    found = scan(docs.select(F.col(quoted(id_col)).alias("id"), text.alias("text")), model, "id", "text").groupBy("id", "text_hash").agg(F.collect_list("ordinal").alias("kept"))
    some = docs.where(suspect).select(as_rows(docs).alias("doc"))
    own = F.col("doc").getField
    met = some.join(found, own(id_col).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(own(text_col)) == F.col("text_hash")), "left")
    parts, cands = F.split(own(text_col), CANDIDATE, -1), F.regexp_extract_all(own(text_col), F.lit(CANDIDATE), 0)
    masked = F.transform(cands, lambda c, i: F.when(F.array_contains("kept", i), F.concat(F.regexp_extract(c, LEAD, 0), F.lit(MASK))).otherwise(c))
    whole = F.array_join(F.zip_with(parts, masked, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    new = F.when(F.col("kept").isNull(), own(text_col)).otherwise(whole)
    clean = met.select(*[(new if c == text_col else own(c)).alias(c) for c in docs.columns])
    return docs.where(~suspect).unionByName(clean.to(T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])))
