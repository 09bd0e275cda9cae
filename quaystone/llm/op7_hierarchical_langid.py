"""Language identification in two steps: family first, then close relatives apart.

Features are shares of hashed byte trigrams of the folded text.  Linear support vector machines, one for
each pair, vote among families; within the chosen family one for each pair of its languages votes again
(dual coordinate descent on the hinge loss).  They are fitted on a bounded sample of labelled rows
(SAMPLE rows, shared evenly by the languages, chosen by hash, and LEAST of each language where they are many,
so that every labelled language is learned); every whole text is scored.

Defined cases: a null text, or one without a letter, is `und` with score 0; without labelled rows all are
`und`; languages outside FAMILIES form families of their own; repeated rows score alike; an empty table
gives an empty result; a null doc_id is neither held out nor learned from, and of rows that repeat a doc_id with one
language one is learned from; other columns are carried on request and those with a result's name are replaced.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of, with_text_columns

SAMPLE, LEAST, DIMS, EPOCHS, C = 2000, 20, 8192, 15, 1.0
#: Languages by family (ISO 639-1).
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "mr", "ur", "gu", "pa", "ne"],
    "semitic": ["ar", "he", "mt", "am"],
}
FAMILY_OF = {lang: name for name, langs in FAMILIES.items() for lang in langs}
FOLD = np.full(256, 0x20, dtype=np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
for _c in range(26):
    FOLD[[0x41 + _c, 0x61 + _c]] = 0x61 + _c
LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text.decode(errors="ignore")))


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in a row and where each text starts; two spaces part the texts."""
    raw = np.frombuffer(b"".join(b" " + t + b" " for t in texts) + b"  ", dtype=np.uint8)
    x = FOLD[raw]
    upper = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) + 1  # Latin-1 capitals
    x[upper] += 0x20
    x = x.astype(np.uint32)
    h = ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(0x9E3779B1)
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    return (h >> np.uint32(32 - 13)).astype(np.int64), np.cumsum(sizes) - sizes


def support_vectors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (last: bias) of a linear machine; y is -1 or 1."""
    x = np.column_stack([x, np.ones(len(x), dtype=x.dtype)])
    w, alpha, norm = np.zeros(x.shape[1], dtype=np.float64), np.zeros(len(x)), (x * x).sum(axis=1)
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / norm[i], 0.0), C)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def fit(texts: list[bytes], langs: list[str]) -> dict:
    """Pairwise machines as one weight table: a column for each pair."""
    known = sorted(set(langs))
    families = sorted({FAMILY_OF.get(x, x) for x in known})
    model = {"families": families, "langs": {f: [x for x in known if FAMILY_OF.get(x, x) == f] for f in families}, "pairs": [], "weights": np.zeros((DIMS, 0)), "bias": np.zeros(0)}
    if not texts:
        return model
    x = np.zeros((len(texts), DIMS), dtype=np.float32)
    h, starts = trigrams(texts)
    ends = np.r_[starts[1:], len(h)]
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        x[k] = np.bincount(h[a:b], minlength=DIMS) / (b - a)
    scale = 1 / (x.std(axis=0) + 1e-4) / np.sqrt(DIMS)
    mean = x.mean(axis=0)
    x = (x - mean) * scale
    lang = np.array(langs)
    family = np.array([FAMILY_OF.get(v, v) for v in langs])
    jobs = [("family", a, b, family) for a, b in itertools.combinations(families, 2)]
    jobs += [(f, a, b, lang) for f in families for a, b in itertools.combinations(model["langs"][f], 2)]
    columns, bias = [], []
    for kind, a, b, of in jobs:
        at = np.flatnonzero((of == a) | (of == b))
        w = support_vectors(x[at], np.where(of[at] == a, 1.0, -1.0))
        columns.append(w[:-1] * scale)
        bias.append(w[-1] - (w[:-1] * scale) @ mean)
        model["pairs"].append((kind, a, b))
    if columns:
        model |= {"weights": np.column_stack(columns).astype(np.float32), "bias": np.array(bias)}
    return model


def vote(model: dict, kind: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner of the pairwise votes (the sum of margins parts ties) and the winner's least margin, per row."""
    total, votes = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
    least = np.full((len(margins), len(names)), np.inf)
    for k, (own, a, b) in enumerate(model["pairs"]):
        if own == kind:
            m, i, j = margins[:, k], names.index(a), names.index(b)
            total[:, i] += m
            total[:, j] -= m
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
    best = (votes + np.tanh(total / 100) * 0.4).argmax(axis=1)
    return best, least[np.arange(len(best)), best]


def predict(model: dict, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    out, score = ["und"] * len(texts), np.zeros(len(texts))
    at = [k for k, t in enumerate(texts) if has_letter(t)]
    if not at or not model["families"]:
        return out, score
    h, starts = trigrams([texts[k] for k in at])
    n = np.diff(np.r_[starts, len(h)])
    margins = np.column_stack([np.add.reduceat(w[h], starts, dtype=np.float64) / n for w in np.ascontiguousarray(model["weights"].T)] or [np.zeros((len(at), 0))]) + model["bias"]
    family, sure = vote(model, "family", model["families"], margins)
    sigmoid = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -50, 50)))
    for f, name in enumerate(model["families"]):
        rows = np.flatnonzero(family == f)
        names = model["langs"][name]
        best, own = vote(model, name, names, margins[rows])
        value = sigmoid(sure[rows]) * sigmoid(own)
        for r, b, v in zip(rows.tolist(), best.tolist(), value.tolist(), strict=True):
            out[at[r]], score[at[r]] = names[b], v
    return out, score


def train_model(docs: DataFrame, *, fold: int = 3, held_out: int = 1) -> dict:
    """Fit on labelled rows outside the held-out fold; SAMPLE rows at most come to the driver, or LEAST a language."""
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(F.crc32(F.col("doc_id").cast("string")) % fold != held_out)
    n_langs = rows.select("lang").distinct().count()
    if not n_langs:
        return fit([], [])
    # ids first: only the sample's are broadcast, so texts are neither sorted nor sent beyond it; each task
    # keeps the first of every language before the shuffle, so a language with most rows makes no large group
    each = max(LEAST, SAMPLE // max(4, n_langs))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = rows.select("doc_id", "lang").distinct().withColumn("_n", first).where(F.col("_n") <= each).select("doc_id", "lang")
    picked = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    picked = [r for r in sorted(picked, key=lambda r: (r["lang"], r["doc_id"], r["text"])) if has_letter(r["text"].encode())]
    texts, of = [r["text"].encode() for r in picked], [r["lang"] for r in picked]
    return fit(texts, of)


def identify(docs: DataFrame, model: dict, *, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x pairs of languages

    def factory():
        def fn(batch):
            lang, score = predict(shared.value, texts_of(batch.column("text")))
            return [pa.array(lang, pa.string()), pa.array(score)]

        return fn

    return with_text_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], factory, keep)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train_model(docs), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
