"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte trigrams of the whole text plus a few repetition terms (how much of the
document its own words and lines repeat). Counts are damped by a logarithm, weighted by inverse
document frequency and projected on the leading singular vectors of a bounded labelled sample. The
sample's vectors are broadcast; each batch of documents is compared with all of them by an exact
blocked cosine product, and the labels of the nearest are averaged, weighted by similarity.

Null and empty texts have one term ("empty") and are scored like any other. Without labels the
score is 0.5. Equal similarities keep the sample's order. Columns other than the id and the text
are ignored. Long texts count whole, by hashed terms of a fixed number. Repeated rows are scored one by one; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import bound_batches, quoted
from heliograph.llm.wordhash import hash_texts, mix

#: Hash buckets of trigrams; levels of each repetition term.
BUCKETS = 8192
LEVELS = 16
WIDTH = BUCKETS + 3 * LEVELS + 1
#: Expected rows of each label in the sample, the most rows of all, and the characters of a text in it: of a longer
#: text the sample has a run of as many, from a place that the row's hash chooses.
SAMPLE_PER_LABEL = 1000
SAMPLE_ROWS = 2 * 2 * SAMPLE_PER_LABEL
SAMPLE_CHARS = 65_536
DIMENSIONS = 64
NEIGHBOURS = 15
#: Similarities are raised to this power before they weigh a vote.
SHARPNESS = 8
THRESHOLD = 0.7
#: Bytes that are looked at together; longer texts take no more memory.
SEGMENT = 1 << 20


@dataclass
class QualityModel:
    weights: np.ndarray  # of terms
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # dimensions x sample, unit length
    labels: np.ndarray


def _level(share: float) -> int:
    return min(LEVELS - 1, int(share * LEVELS))


def term_counts(texts: list[str | None]) -> np.ndarray:
    """One row of damped counts for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, counts = hash_texts(data)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    for row, text, a, b in zip(out, data, firsts, firsts[1:]):
        if not text:
            row[-1] = 1
            continue
        raw = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(text), SEGMENT):  # a byte more on either side, a space at the text's ends
            part = np.frombuffer(text[max(0, at - 1) : at + SEGMENT + 1], np.uint8)
            wide = np.concatenate([[32] if at == 0 else [], part, [32] if at + SEGMENT >= len(text) else []]).astype(np.uint32)
            codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
            raw += np.bincount((codes * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=BUCKETS)
        row[:BUCKETS] = np.log1p(raw)
        norm = float(np.sqrt(np.einsum("i,i", row, row)))
        own = words[a:b]
        lines = [x for x in text.split(b"\n") if x]
        follow = mix(own[:-1] * np.uint64(3) + (own[1:] >> np.uint64(1)))
        for k, (n, distinct) in enumerate(((len(own), len(np.unique(own))), (len(follow), len(np.unique(follow))), (len(lines), len(set(lines))))):
            row[BUCKETS + k * LEVELS + _level(1 - distinct / n if n else 0.0)] = 0.35 * norm
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """The rows of x, in place, at unit length."""
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def _embed(texts: list[str | None], weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    x = term_counts(texts)
    x *= weights
    return _unit(_unit(x) @ basis)


def train(texts: list[str | None], labels: list[int]) -> QualityModel | None:
    if not labels:
        return None
    x = term_counts(texts)
    weights = (np.log((1 + len(texts)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    x *= weights
    x = _unit(x)
    gram = (x @ x.T).astype(np.float64)  # documents are fewer than terms
    values, vectors = np.linalg.eigh(gram)
    top = [i for i in np.argsort(-values)[:DIMENSIONS] if values[i] > 1e-9]
    basis = (x.T @ vectors[:, top] / np.sqrt(values[top])).astype(np.float32)
    v = _unit(x @ basis)
    return QualityModel(weights, basis, np.ascontiguousarray(v.T), np.array(labels, np.float64))


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest of each row, in the columns' order; of equal ones the first."""
    edge = np.partition(cosines, -k, axis=1)[:, -k, None]
    over, even = cosines > edge, cosines == edge
    even &= np.cumsum(even, axis=1) <= k - over.sum(1, keepdims=True)
    return np.nonzero(over | even)[1].reshape(len(cosines), k)


def predict(model: QualityModel | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    out = []
    k = min(NEIGHBOURS, len(model.labels))
    prior = np.array([1 / max(1, (model.labels == y).sum()) for y in model.labels])  # the sample's labels count alike
    for i in range(0, len(texts), 256):
        cosines = _embed(texts[i : i + 256], model.weights, model.basis) @ model.vectors
        near = nearest(cosines, k)
        w = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** SHARPNESS * prior[near]
        out.append((w * model.labels[near]).sum(1) / w.sum(1))
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | None:
    """Draw about SAMPLE_PER_LABEL rows of each label by the ids' hashes, and train on them.

    An id that is labelled twice has its larger label. Rows equal in id and text are drawn once.
    """
    marks = labels.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(label_col)).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1 << 20, (SAMPLE_PER_LABEL << 20) // n))) for y, n in sorted(sizes.items())])
    drawn = marks.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < share)
    texts = docs.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(text_col)).alias("t"))
    # The drawn ids are bounded by SAMPLE_PER_LABEL for each of the two labels; their rows by SAMPLE_ROWS.
    found = texts.join(F.broadcast(drawn), "i").withColumns({"h": F.xxhash64("i"), "k": F.xxhash64("t")})
    run = F.substr("t", F.pmod("k", F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))
    rows = found.dropDuplicates(["h", "i", "k"]).select("h", "i", "k", "y", run.alias("t"))
    sample = rows.orderBy("h", "i", "k").limit(SAMPLE_ROWS).toPandas()
    return train([t if isinstance(t, str) else None for t in sample["t"]], sample["y"].tolist())


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with its score and prediction; the model is bounded by the sample and broadcast."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = np.clip(predict(shared.value, [t if isinstance(t, str) else None for t in batch["text"]]), 0, 1)
            yield pd.DataFrame({"id": batch["id"], "score": s, "predicted": (s >= THRESHOLD).astype("int32")})

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(vote, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
