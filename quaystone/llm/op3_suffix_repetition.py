"""Quality rules by suffix-array repetition.

The words of a slice of documents are one array; its suffix array is built by prefix doubling with the
document in the first key, so suffixes meet only inside their document.  Longest common prefixes of
neighbours come from the doubling ranks; each suffix's deepest LCP interval gives the maximal repeated
substring that starts there, the union of their spans is what repeats.  Limits: the share of words inside
repeats of at least ``long_words`` words, and the longest repeat.

Base rules: fewer than ``min_words`` words, or over half of the words inside repeats of three words.

Defined cases: null or empty text has no words and fails the base; a text of any length is used whole;
repeated rows get equal rows; an empty table gives an empty result; other columns are carried on request,
those with a result's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SLICE_BYTES, texts_of, with_text_columns

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_BASE_SHARE = 50, 3, 0.5
#: Limits on repeats of LONG_WORDS words and more: share of the words, words of the longest.  The base allows a share of 0.5; 99 %
#: of the documents that pass it, labelled good or bad, stay below 0.13.
LONG_WORDS, MAX_LONG_SHARE, MAX_LONGEST = 8, 0.25, 100

FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_long_repeat_words", T.LongType()), T.StructField("longest_repeat", T.LongType()), T.StructField("kept", T.BooleanType()),
]


def repeat_lengths(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the words of the longest repeat that starts there and occurs again in its document."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n + 1, dtype=np.int64)  # by position; the end ranks below all
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    levels, width, ends = [rank.copy()], 1, np.r_[doc[1:] != doc[:-1], True]
    last = np.flatnonzero(ends)[np.searchsorted(np.flatnonzero(ends), np.arange(n))]  # last word of the document
    tied = ~(new & np.r_[new[1:], True])
    active = np.flatnonzero(tied)  # places in the order whose group has more than one suffix
    while len(active):
        at = order[active]
        nxt = np.where(at + width <= last[at], rank[np.minimum(at + width, n)], -1)
        by = np.lexsort((nxt, rank[at]))
        at, nxt = at[by], nxt[by]
        order[active] = at
        own = rank[at]
        new = np.r_[True, (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])]
        rank[at] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        levels.append(rank.copy())
        width *= 2
        active = active[~(new & np.r_[new[1:], True])]
    # equal ranks at a level mean equal prefixes of its width; read off from the widest level down
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, dtype=np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live], b[live]
    got = np.zeros(len(live), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (np.maximum(a, b) < n) & (a <= last[order[live]]) & (b <= last[order[live + 1]])
        same = inside & (levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)])
        step = np.where(same, 1 << k, 0)
        a, b, got = a + step, b + step, got + step
    lcp[live] = got
    out = np.zeros(n, dtype=np.int64)
    deepest = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    out[order] = deepest
    return out


def covered(lengths: np.ndarray, doc: np.ndarray, least: int, n_docs: int) -> np.ndarray:
    """Words of each document inside the union of repeats of at least ``least`` words."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= least)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + lengths[at], -1)
    return np.bincount(doc[np.cumsum(edge[:n]) > 0], minlength=n_docs)


def measure(texts: list[bytes]) -> list[np.ndarray]:
    n_docs = len(texts)
    split = [t.split() for t in texts]
    n_words = np.array([len(s) for s in split], dtype=np.int64)
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for s in split for w in s], dtype=np.int64)
    doc = np.repeat(np.arange(n_docs), n_words)
    lengths = repeat_lengths(words, doc)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    of = np.repeat(np.arange(n_docs), [len(t) for t in texts])
    kind = np.zeros(256, dtype=np.uint8)
    kind[np.r_[0:0x80, 0xC0:0x100]] = 1  # a code point starts here
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    starts = kind[raw].astype(bool)
    kind[:] = 0
    kind[list(SYMBOLS)] = 1
    word_chars = np.bincount(of[starts], minlength=n_docs)
    n_symbols = np.bincount(of[kind[raw].astype(bool)], minlength=n_docs)
    n_dup = np.zeros(n_docs, dtype=np.int64)
    for i, t in enumerate(texts):
        if t.count(b"\n"):
            lines = [x for x in t.split(b"\n") if x.strip()]
            n_dup[i] = len(lines) - len(set(lines))
    longest = np.zeros(n_docs, dtype=np.int64)
    np.maximum.at(longest, doc, lengths)
    return [n_words, word_chars, n_symbols, n_dup, covered(lengths, doc, WINDOW, n_docs), covered(lengths, doc, LONG_WORDS, n_docs), longest]


def quality(docs: DataFrame, *, keep: list[str] | None = None, max_long_share: float = MAX_LONG_SHARE, max_longest: int = MAX_LONGEST, prefix: str = "") -> DataFrame:
    """``docs`` with FIELDS appended."""

    def factory():
        def fn(batch):
            n, chars, symbols, dup, rep, long, longest = measure(texts_of(batch.column("text")))
            failed = (n < MIN_WORDS) | (rep > MAX_BASE_SHARE * n)
            kept = ~failed & (long <= max_long_share * n) & (longest <= max_longest)
            return [pa.array(x) for x in (n, chars, symbols, dup, rep)] + [pa.array(failed), pa.array(long), pa.array(longest), pa.array(kept)]

        return fn

    return with_text_columns(docs, [T.StructField(prefix + f.name, f.dataType) for f in FIELDS], factory, keep, size=SLICE_BYTES // 4)  # ranks of every doubling are held


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality(table(spark, sf_dir, "documents"), keep=["doc_id"])


def passing(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    return quality(docs, prefix="_quality_").where("_quality_kept").select(docs.columns)
