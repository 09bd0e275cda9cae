"""Toxicity by a linear-chain conditional random field.

Training, on a bounded sample of labelled rows (SAMPLE: toxic, other): words and word prefixes that a
binomial test finds in toxic documents far beyond their share give token labels; a two-state chain (states
clean and toxic, features: word, prefixes, suffix; transitions) is fitted to them by gradient steps on the
exact likelihood.  Scoring reads every whole text: forward-backward marginals of each line's tokens are
aggregated (expected toxic tokens, largest marginal) and calibrated to a document score, and tokens with a
marginal of at least one half give the offending spans.

Defined cases: null or empty text scores as a text without tokens; labels that are null or not 0/1 are not
learned from; without any toxic label the score is close to 0 (2e-9); repeated rows score alike, and of rows that
repeat a doc_id one is learned from; a null doc_id is neither held out nor learned from; an empty table gives an
empty result; other columns are carried on request and those with a result's name are replaced.
"""

from __future__ import annotations

import math
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Forest, Remembered, texts_of, with_text_columns

#: Rows the model is fitted on at most: toxic, others.
SAMPLE = (1000, 2000)
P_VALUE, MIN_PRECISION, MIN_COUNT, STEPS, L2 = 1e-6, 0.6, 5, 40, 1e-2
#: Distinct tokens whose score a task remembers in each of two generations, the bytes of a token beyond which it does not,
#: and the bytes of text it holds as tokens at a time: about 25 MB of memo and 100 MB of arrays a task.
CACHE, LONG_TOKEN, SLICE = 80_000, 32, 1 << 20
EDGE = ".,;:!?\"'()[]{}<>*#$%&|…«»„“”¿¡-–—"


def features(token: str) -> list[str]:
    w = token.strip(EDGE).lower()
    if not w:
        return []
    return [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k), "*" + w[-4:]]


def tail(hits: int, n: int, share: float) -> float:
    """P(Binomial(n, share) >= hits)."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(hits, n + 1)]
    return math.fsum(map(math.exp, logs))


def toxic_features(toxic: list[bytes], other: list[bytes], features_of) -> set[str]:
    """Features whose documents are toxic far beyond chance; a group of copies counts once."""
    docs = [*toxic, *other]
    group = groups_of_copies(docs)
    bad = {int(x) for x in group[: len(toxic)]}
    share = min(0.999, len(bad) / max(1, len(set(group.tolist()))))
    least = max(3, math.ceil(math.log(P_VALUE) / math.log(share)))
    count: dict[str, int] = {}
    for t in toxic:
        for f in {f for w in set(t.split()) for f in features_of(w)}:
            count[f] = count.get(f, 0) + 1
    hits: dict[str, set[int]] = {f: set() for f, n in count.items() if n >= least and not f.startswith("*")}
    del count
    for k, t in enumerate(docs):
        for w in set(t.split()):
            for f in features_of(w):
                if f in hits:
                    hits[f].add(int(group[k]))
    return {f for f, g in hits.items() if (a := len(g & bad)) >= MIN_PRECISION * len(g) and a >= 3 and tail(a, len(g), share) < P_VALUE}


def chain_marginals(unary: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(state toxic) of every token, and on request the expected count of each transition.

    ``unary`` is the toxic state's score over the clean state's; ``trans[a, b]`` scores a step a -> b.
    With two states, forward and backward messages are one odds ratio each; chains run side by side, the
    tokens of a step lie together.
    """
    if not len(unary):
        return np.zeros(0), np.zeros((2, 2))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")  # chains longer than t
    cut = np.r_[0, np.cumsum(active)]
    t_of = np.repeat(np.arange(len(active)), active)
    place = starts[np.arange(len(unary)) - cut[t_of]] + t_of
    (m00, m01), (m10, m11) = np.exp(trans)
    e = np.exp(np.clip(unary[place], -30, 30))
    f, g = np.empty_like(e), np.ones_like(e)
    f[: active[0]] = e[: active[0]]
    for t in range(1, len(active)):
        prev = f[cut[t - 1] : cut[t - 1] + active[t]]
        f[cut[t] : cut[t + 1]] = e[cut[t] : cut[t + 1]] * (m01 + m11 * prev) / (m00 + m10 * prev)
    for t in range(len(active) - 2, -1, -1):
        nxt = e[cut[t + 1] : cut[t + 2]] * g[cut[t + 1] : cut[t + 2]]
        g[cut[t] : cut[t] + active[t + 1]] = (m10 + m11 * nxt) / (m00 + m01 * nxt)
    odds = f * g
    p = np.empty_like(odds)
    p[place] = odds / (1 + odds)
    if not pairs:
        return p, None
    back, ahead = np.empty_like(f), np.empty_like(f)
    back[place], ahead[place] = f, e * g
    inner = np.ones(len(unary), dtype=bool)
    inner[starts] = False
    i = np.flatnonzero(inner)
    x, y = back[i - 1], ahead[i]
    both = x * y
    share = 1 / (m00 + m01 * y + m10 * x + m11 * both)
    return p, np.array([[m00 * share.sum(), m01 * (y @ share)], [m10 * (x @ share), m11 * (both @ share)]])


def groups_of_copies(docs: list[bytes]) -> np.ndarray:
    """Near copies share a number, so that a copied text counts once: equal pairs of MinHash values over rarer words."""
    hashed = [np.unique(np.array([xxhash.xxh3_64_intdigest(w) for w in set(t.split())], dtype=np.uint64)) for t in docs]
    values, n = np.unique(np.concatenate(hashed), return_counts=True)
    rare = values[n <= max(2, len(docs) // 50)]
    forest, first = Forest(len(docs)), {}
    odd = np.random.default_rng(5).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k, d in enumerate(hashed):
        h = d[np.isin(d, rare, assume_unique=True)]
        if len(h):
            with np.errstate(over="ignore"):
                v = ((h[:, None] * odd) >> np.uint64(20)).min(axis=0).tolist()
            for j in range(0, 64, 2):
                forest.join(first.setdefault((j, v[j], v[j + 1]), k), k)
    return np.array([forest.find(k) for k in range(len(docs))])


def chains(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all lines in a row, each chain's start and length, and the document of every token."""
    tokens: list[bytes] = []
    lengths, of = [], []
    for k, t in enumerate(texts):
        before = len(tokens)
        for line in t.split(b"\n"):
            words = line.split()
            if words:
                tokens += words
                lengths.append(len(words))
        of.append(len(tokens) - before)
    length = np.array(lengths, dtype=np.int64)
    return tokens, np.cumsum(length) - length, length, np.repeat(np.arange(len(texts)), of)


def summary(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: 1, log(1 + expected toxic tokens), largest marginal."""
    top = np.zeros(n)
    np.maximum.at(top, doc, p)
    sure = np.bincount(doc, weights=np.where(p >= 0.05, p, 0), minlength=n)  # noise of long texts stays out
    return np.column_stack([np.ones(n), np.log1p(sure), top])


def fit(toxic: list[bytes], other: list[bytes], prior: float | None = None) -> dict:
    """Weights of the chain and of the calibration; ``prior`` is the share of toxic labels."""
    if not toxic:
        return {"weights": {}, "bias": -20.0, "trans": np.zeros((2, 2)), "final": np.array([-20.0, 0.0, 0.0])}
    seen: dict[bytes, tuple[str, ...]] = {}

    def of(token: bytes) -> tuple[str, ...]:
        if token not in seen:
            if len(seen) > 100_000:
                seen.clear()
            seen[token] = tuple(map(sys.intern, features(token.decode(errors="replace"))))
        return seen[token]

    bad = toxic_features(toxic, other, of)
    train = toxic + other[: len(toxic)]
    lines = [line for k, t in enumerate(train) for line in t.split(b"\n") if line.split()]
    from_toxic = [k < len(toxic) for k, t in enumerate(train) for line in t.split(b"\n") if line.split()]
    marked = [k for k, x in enumerate(lines) if from_toxic[k] and any(not bad.isdisjoint(of(w)) for w in x.split())]
    plain = [k for k in range(len(lines)) if not from_toxic[k]]
    plain = plain[:: max(1, len(plain) // max(1, len(marked)))]
    tokens, starts, lengths, doc = chains([lines[k] for k in [*marked, *plain]])
    label = np.array([k < len(marked) and not bad.isdisjoint(of(w)) for k, w in zip(doc.tolist(), tokens, strict=True)], dtype=bool)
    place: dict[bytes, int] = {}
    word = np.array([place.setdefault(w, len(place)) for w in tokens], dtype=np.int32)  # features are held once a distinct word
    number: dict[str, int] = {}
    count: dict[str, int] = {}
    for w, n in zip(place, np.bincount(word).tolist(), strict=True):
        for f in of(w):
            count[f] = count.get(f, 0) + n
    flat, sizes = array("l"), array("l")
    for w in place:
        own = [number.setdefault(f, len(number)) for f in of(w) if count[f] >= MIN_COUNT]
        flat.extend(own)
        sizes.append(len(own))
    n_words = len(place)
    at, flat = np.repeat(np.arange(n_words), np.array(sizes, dtype=np.int64)), np.array(flat, dtype=np.int64)
    del count, place
    v = np.zeros(len(number) + 5)  # weights, bias, transitions
    mom, var = np.zeros_like(v), np.zeros_like(v)
    inner = np.ones(len(tokens), dtype=bool)
    inner[starts] = False
    i = np.flatnonzero(inner)
    seen_pairs = np.bincount(2 * label[i - 1] + label[i], minlength=4).astype(float)
    for step in range(1, STEPS + 1):
        unary = (np.bincount(at, weights=v[flat], minlength=n_words) + v[-5])[word]
        p, pairs = chain_marginals(unary, starts, lengths, v[-4:].reshape(2, 2), pairs=True)
        miss = label - p
        by_word = np.bincount(word, weights=miss, minlength=n_words)
        g = np.r_[np.bincount(flat, weights=by_word[at], minlength=len(number)), miss.sum(), seen_pairs - pairs.ravel()] - L2 * v
        mom, var = 0.9 * mom + 0.1 * g, 0.99 * var + 0.01 * g * g
        v += 0.3 * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(v[k]) for f, k in number.items()}
    parts = []
    for k in range(0, len(train), 200):
        tokens, starts, lengths, doc = chains(train[k : k + 200])
        memo = {w: v[-5] + sum(weights.get(f, 0.0) for f in of(w)) for w in set(tokens)}
        p, _ = chain_marginals(np.array([memo[w] for w in tokens]), starts, lengths, v[-4:].reshape(2, 2))
        parts.append(summary(p, doc, len(train[k : k + 200])))
    x, y = np.concatenate(parts), np.r_[np.ones(len(toxic)), np.zeros(len(train) - len(toxic))]
    final = np.zeros(3)
    # the sample is balanced, the labels are not: without the weights a text without evidence would score its half
    prior = len(toxic) / (len(toxic) + max(1, len(other))) if prior is None else prior
    w = np.where(y == 1, prior, (1 - prior) * len(toxic) / max(1, len(train) - len(toxic)))
    ridge = 0.1 * w.mean()
    for _ in range(50):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-(x @ final)))
        h = (x * (w * q * (1 - q))[:, None]).T @ x + ridge * np.eye(3)
        final += np.linalg.solve(h, x.T @ (w * (y - q)) - ridge * final)
    return {"weights": weights, "bias": float(v[-5]), "trans": v[-4:].reshape(2, 2).copy(), "final": final}


def train_model(docs: DataFrame, labels: DataFrame, *, fold: int = 5, held_out: int = 0) -> dict:
    """Fit on labelled rows outside the held-out fold; at most SAMPLE rows, chosen by hash, come to the driver."""
    known = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % fold != held_out))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    picked = []
    for v, n in zip((1, 0), SAMPLE, strict=True):
        # ids first: at most n rows are broadcast, so texts are neither shuffled nor sorted
        ids = known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id")
        rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
        picked.append([r["text"].encode() for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))])
    return fit(*picked, prior=counts.get(1, 0) / max(1, sum(counts.values())))


def score_documents(docs: DataFrame, model: dict, *, keep: list[str] | None = None, with_spans: bool = False, prefix: str = "") -> DataFrame:
    """``docs`` with score and predicted, and spans (start and end in code points) on request."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of SAMPLE rows at most
    fields = [T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "predicted", T.IntegerType())]
    if with_spans:
        span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
        fields.append(T.StructField(prefix + "spans", T.ArrayType(span)))

    def factory():
        weights, bias, trans, final = (shared.value[k] for k in ("weights", "bias", "trans", "final"))
        known = Remembered(CACHE)

        def fn(batch):
            texts = texts_of(batch.column("text"))
            tokens, starts, lengths, doc = chains(texts)
            new = set(tokens)
            new -= known.young.keys()
            known.promote(new)
            for w in new:
                known.young[w] = bias + sum(weights.get(f, 0.0) for f in features(w.decode(errors="replace")))
            unary = np.fromiter(map(known.young.__getitem__, tokens), dtype=float, count=len(tokens))
            for w in new:
                if len(w) > LONG_TOKEN:
                    del known.young[w]
            known.turn()
            p, _ = chain_marginals(unary, starts, lengths, trans)
            score = 1 / (1 + np.exp(-(summary(p, doc, len(texts)) @ final)))
            out = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            if with_spans:
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                out.append([spans(t, p[a:b]) for t, a, b in zip(texts, cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
            return out

        return fn

    return with_text_columns(docs, fields, factory, keep, size=SLICE)


WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Runs of tokens that are toxic with a marginal of at least one half, as code points."""
    found: list[dict] = []
    if (p >= 0.5).any():
        last, done, points = -2, 0, 0
        for k, m in enumerate(WORD.finditer(text)):
            if p[k] >= 0.5:
                start = points + len(text[done : m.start()].decode())
                end = start + len(m[0].decode())
                if last == k - 1:
                    found[-1]["end"] = end
                else:
                    found.append({"start": start, "end": end})
                last, done, points = k, m.end(), end
    return found


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_documents(docs, train_model(docs, labels), keep=["doc_id"], with_spans=True)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", "predicted", "spans")


def clean(docs: DataFrame, all_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of ``docs`` that are not predicted toxic, with their columns."""
    marked = score_documents(docs, train_model(all_docs, labels), prefix="_toxic_")
    return marked.where("_toxic_predicted = 0").select(docs.columns)
