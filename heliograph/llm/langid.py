"""Language identification by string kernels.

A text is the set of its distinct character n-grams (n = 1, 2, 3; lower case, every non-letter one
separator). The blended-spectrum presence kernel of two texts is the number of n-grams they share
over the geometric mean of their set sizes. Some labelled texts serve as Nystroem landmarks; a
one-versus-rest kernel ridge regression on the Nystroem map is solved in closed form on a bounded
labelled sample, and a batch of documents is scored by two matrix products: presence x landmark
n-grams gives the kernel block, kernel block x dual weights gives one score per language.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the language that sorts
first. Without any labelled text every document is ``und``. Columns other than the id and the text
are ignored and may have any name. Texts are read whole, whatever their length; only a labelled one gives a run of
characters to the sample. Repeated rows are judged one by one; an empty table gives no rows, and fits no model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import bound_batches, kept_by, quoted

#: The labelled sample: expected rows a language, the most rows of all, the languages that are learnt (the most frequent
#: ones), and the characters of a text in it: of a longer text the sample has a run of as many, from a place that the
#: row's hash chooses.
SAMPLE_PER_LANG = 1200
SAMPLE_ROWS = 6000
LANGUAGES = 256
SAMPLE_CHARS = 8_192
#: Landmarks a language and of all, the bytes of their matrix, and the lengths (characters) a landmark may have. Where the
#: n-grams of the landmarks would need a larger matrix, they are hashed into as many rows as it may have.
LANDMARKS_PER_LANG = 48
MOST_LANDMARKS = 512
MATRIX_BYTES = 64 << 20
LANDMARK_CHARS = (150, 4000)
#: Letters of the landmarks that keep a class of their own; all others share one. With up to 62 letters every n-gram
#: has its own number; with more, the numbers are hashed into as many places.
ALPHABET = 8192
RIDGE = 1e-3
#: Characters that are looked at together; longer texts take no more memory.
SEGMENT = 1 << 20
CLASSES = 64
GRAMS = CLASSES + CLASSES**2 + CLASSES**3


@dataclass
class LanguageModel:
    langs: list[str]
    classes: np.ndarray  # code point -> letter class, 0 for what is no letter
    columns: np.ndarray  # n-gram numbers of the landmarks
    presence: np.ndarray  # n-grams x landmarks, scaled by the landmarks' norms
    dual: np.ndarray  # landmarks x languages
    bias: np.ndarray
    rows: np.ndarray | None = None  # the matrix row of each n-gram, where they share rows


def _letter_classes(texts: list[str]) -> np.ndarray:
    counts: dict[str, int] = {}
    for text in texts:
        for ch in text.lower():
            if ch.isalpha():
                counts[ch] = counts.get(ch, 0) + 1
    kept = sorted(counts, key=lambda ch: (-counts[ch], ch))[:ALPHABET]
    classes = np.zeros(0x110000, np.uint16)
    classes[[cp for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha()]] = max(CLASSES - 1, len(kept) + 1)
    for i, ch in enumerate(kept):
        classes[ord(ch)] = i + 1
    return classes


def _places(numbers: np.ndarray) -> np.ndarray:
    """The places of n-grams whose numbers are too many for places of their own."""
    return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def _gram_flags(text: str, classes: np.ndarray, flags: np.ndarray) -> bool:
    """Mark the distinct n-grams of the whole text in flags; False if it has no letter."""
    flags[:] = False
    some = False
    base = max(CLASSES, int(classes.max()) + 1)
    for at in range(0, len(text), SEGMENT):  # two characters more on the left, so that no n-gram is cut
        part = text[max(0, at - 2) : at + SEGMENT]
        points = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = classes[points].astype(np.int64)
        some |= bool(c.any())
        if base > CLASSES:
            pairs = c[:-1] * base + c[1:]
            for numbers in (c, base + pairs, base + base**2 + pairs[:-1] * base + c[2:]):
                flags[_places(numbers)] = True
            continue
        pairs = c[:-1] * CLASSES + c[1:]
        flags[c] = True
        flags[CLASSES + pairs] = True
        flags[CLASSES + CLASSES**2 + pairs[:-1] * CLASSES + c[2:]] = True
    return some


def _kernel_rows(texts: list[str | None], model_columns: np.ndarray, presence: np.ndarray, classes: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The kernel block of the texts against all landmarks, and which texts have a letter."""
    if rows is not None and len(texts) > 64:  # wide rows: few texts at once
        parts = [_kernel_rows(texts[i : i + 64], model_columns, presence, classes, rows) for i in range(0, len(texts), 64)]
        return np.concatenate([p for p, _ in parts]), np.concatenate([s for _, s in parts])
    flags = np.zeros(GRAMS, bool)
    x = np.zeros((len(texts), len(presence)), np.float32)
    some = np.zeros(len(texts), bool)
    norms = np.ones(len(texts), np.float32)
    for i, text in enumerate(texts):
        if text and _gram_flags(text, classes, flags):
            some[i] = True
            if rows is None:
                x[i] = flags[model_columns]
            else:
                x[i, rows[flags[model_columns]]] = 1
            norms[i] = np.sqrt(np.count_nonzero(flags))
    return (x @ presence) / norms[:, None], some


def train(texts: list[str], langs: list[str]) -> LanguageModel | None:
    """Fit on a bounded labelled sample; landmarks are its first eligible texts of each language."""
    rows = [(t, lang) for t, lang in zip(texts, langs) if t and lang is not None]
    names = sorted({lang for _, lang in rows})
    if not names:
        return None
    low, high = LANDMARK_CHARS
    landmarks: list[str] = []
    each = max(1, min(LANDMARKS_PER_LANG, MOST_LANDMARKS // len(names)))
    for name in names:
        own = [t for t, lang in rows if lang == name]
        landmarks += ([t for t in own if low <= len(t) <= high] or own)[:each]
    classes = _letter_classes(landmarks)
    flags = np.zeros(GRAMS, bool)
    marks = []
    for text in landmarks:
        if _gram_flags(text, classes, flags):
            marks.append(np.flatnonzero(flags))
    if not marks:
        return None
    columns = np.unique(np.concatenate(marks))
    most = max(1, MATRIX_BYTES // (4 * len(marks)))
    shared = _places(columns) % most if len(columns) > most else None
    presence = np.zeros((min(len(columns), most), len(marks)), np.float32)
    for j, grams in enumerate(marks):
        at = np.searchsorted(columns, grams)
        presence[at if shared is None else shared[at], j] = 1 / np.sqrt(len(grams))
    wide = presence.astype(np.float64)
    k_mm = wide.T @ wide
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    parts = [_kernel_rows([t for t, _ in rows[i : i + 512]], columns, presence, classes, shared)[0] for i in range(0, len(rows), 512)]
    phi = np.concatenate(parts).astype(np.float64) @ root
    y = np.where(np.array([lang for _, lang in rows])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1 / np.maximum((y > 0).sum(0), 1)[y.argmax(1)]  # every language counts alike
    weight = (weight / weight.mean())[:, None]
    mean_phi, mean_y = (weight * phi).mean(0), (weight * y).mean(0)
    centred = phi - mean_phi
    gram = centred.T @ (weight * centred) + RIDGE * len(rows) * np.eye(phi.shape[1])
    w = np.linalg.solve(gram, centred.T @ (weight * (y - mean_y)))
    return LanguageModel(names, classes, columns, presence, (root @ w).astype(np.float32), (mean_y - mean_phi @ w).astype(np.float32), shared)


def predict(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts))
    kernel, some = _kernel_rows(texts, model.columns, model.presence, model.classes, model.rows)
    scores = kernel @ model.dual + model.bias
    best = scores.argmax(1)
    sure = np.clip((scores[np.arange(len(texts)), best].astype(np.float64) + 1) / 2, 0, 1)
    return [model.langs[b] if s else "und" for b, s in zip(best, some)], np.where(some, sure, 0.0)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Draw the bounded sample by the rows' hashes, about SAMPLE_PER_LANG rows a language, and train on it.

    Rows equal in id, text and language are drawn once, so neither repeated nor missing ids make the sample larger.
    """
    rows = labelled.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(text_col)).alias("t"), F.col(quoted(lang_col)).alias("l")).where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()}
    if not sizes:
        return None
    each = min(SAMPLE_PER_LANG, max(1, SAMPLE_ROWS // len(sizes)))
    share = F.coalesce(*[F.when(F.col("l") == lang, F.lit(min(1 << 20, (each << 20) // n))) for lang, n in sorted(sizes.items())], F.lit(0))
    hashed = rows.withColumns({"h": F.xxhash64("i", "t"), "k": F.xxhash64("t")})
    run = F.substr("t", F.pmod("k", F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))
    sample = hashed.where(F.pmod("h", F.lit(1 << 20)) < share).select("h", "i", "k", "l", run.alias("t")).dropDuplicates(["h", "i", "k", "l"])
    drawn = sample.orderBy("h", "i", "l").limit(2 * SAMPLE_ROWS).select("t", "l").toArrow()
    return train(drawn["t"].to_pylist(), drawn["l"].to_pylist())


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with lang_pred and score; the model (a few MB, bounded by the landmarks) is broadcast."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_by("langid")
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            langs, sure = predict(shared.value, texts)
            yield pd.DataFrame({"id": batch["id"], "lang_pred": langs, "score": sure})

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(score, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def accept(docs: DataFrame, model: LanguageModel | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a language with a score of at least ``least``, unchanged."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        kept_by("langid")
        langs, sure = predict(shared.value, [t if isinstance(t, str) else None for t in texts])
        return pd.Series([lang != "und" and s >= least for lang, s in zip(langs, sure)], dtype=bool)

    return docs.where(good(F.col(quoted(text_col))))
