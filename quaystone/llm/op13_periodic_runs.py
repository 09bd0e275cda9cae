"""Periodic run detection by an online, sparse dynamic program over diagonals.

Word i lies on diagonal q (the lag) with word i - q.  A document's openings are taken from left to right; every active
lag keeps its match, words equal to those a lag before them make it longer, and a diagonal that ends with a long enough
match emits its run at once.  A run of period q and length n is a match of n - q words,
and n >= max(min_length, 2 * q).

What keeps the active lags sparse, without losing a run:

* A diagonal opens only when its match reaches the width that its lag needs anyway: (min_length + 1) // 2 words below
  min_length, and the largest such width times a power of two not above the lag beyond it.  Openings are therefore
  earlier occurrences of a window of words at less than twice the window's width, found by naming windows of doubled
  width; only windows that occur again go on to the next width.
* It opens once, where the words before both windows differ.
* A lag that is a multiple of an active lag with the same start would end with it and has no smallest period: not opened.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.

Defined cases: null or empty text has no words and no runs, its collapsed text is empty; a null doc_id and repeated
rows are rows like others; a text of any length is used whole; an empty table gives an empty result; other columns are
carried on request, those with a result's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of, with_text_columns

MIN_LENGTH = 12
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


def named(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def again(pos: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose name occurs more than once."""
    many = np.bincount(name, minlength=1)[name] > 1 if len(name) else np.zeros(0, dtype=bool)
    return pos[many], name[many]


def repeated_windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(last word, name) of the windows that occur again in their document; ``first`` is each word's document start."""
    at = np.flatnonzero(np.arange(len(words)) - first >= width - 1)
    if not len(at):
        return at, at
    rng = np.random.default_rng(11)
    value = rng.integers(0, 2**63, int(words.max()) + 1, dtype=np.uint64)[words]
    hashed = first[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k, odd in enumerate(rng.integers(0, 2**62, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
        hashed += value[at - k] * odd
    order = np.argsort(hashed)
    same = hashed[order][1:] == hashed[order][:-1]
    at = np.sort(at[order[np.r_[False, same] | np.r_[same, False]]])  # equal windows have equal hashes; names decide
    name, base = named(first[at]), int(words.max()) + 1
    for k in range(width):
        name = named(name * base + words[at - k])
    return again(at, name)


def doubled(pos: np.ndarray, name: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of twice the width, from two halves that both occur again."""
    half = np.searchsorted(pos, pos - width)
    half = np.minimum(half, max(0, len(pos) - 1))
    both = pos[half] == pos - width
    return again(pos[both], named(name[both] * (int(name.max(initial=0)) + 1) + name[half[both]]))


def openings(pos: np.ndarray, name: np.ndarray, before: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(last word, lag) of equal windows at ``least <= lag < most`` whose words before differ; ``before`` -1 at a document's start.

    Occurrences of a window with the same word before lie in stretches, which are stepped over whole.
    """
    order = np.lexsort((pos, name))
    pos, name, before = pos[order], name[order], before[order]
    n = len(pos)
    place = np.arange(n)
    new = np.r_[True, name[1:] != name[:-1]][:n]
    group = np.maximum.accumulate(np.where(new, place, 0))
    head = np.maximum.accumulate(np.where(new | np.r_[True, before[1:] != before[:-1]][:n], place, 0))
    x, y, found = place, head - 1, []
    while len(x):
        near = (y >= group[x]) & (pos[x] - pos[y] < most)
        x, y = x[near], y[near]
        apart = before[x] != before[y]
        found.append((x[apart], y[apart]))
        y = np.where(apart, y - 1, head[y] - 1)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    lag = pos[x] - pos[y]
    keep = lag >= least
    return pos[x][keep], lag[keep]


def all_openings(words: np.ndarray, first: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last word, lag, match length there), in reading order."""
    width = (min_length + 1) // 2
    pos, name = repeated_windows(words, first, width)
    at, lags, have, least = [], [], [], 1
    while len(pos):
        prior = pos - width
        before = np.where(prior >= first[pos], words[np.maximum(prior, 0)], -1)
        i, lag = openings(pos, name, before, least, 2 * width)
        at.append(i)
        lags.append(lag)
        have.append(np.full(len(i), width))
        pos, name = doubled(pos, name, width)
        width *= 2
        least = width
    if not at:
        return (np.zeros(0, dtype=np.int64),) * 3
    at, lags, have = (np.concatenate(c) for c in (at, lags, have))
    order = np.lexsort((lags, at))
    return at[order], lags[order], have[order]


def first_difference(words: np.ndarray, lag: int, i: int, stop: int) -> int:
    """The first word from ``i`` on that differs from the word ``lag`` before it; ``stop`` where none does."""
    step = 16
    while i < stop:
        end = min(stop, i + step)
        differ = words[i:end] != words[i - lag : end - lag]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, step = end, min(2 * step, 1 << 16)
    return stop


def scan(words: np.ndarray, end: int, opened: list[tuple[int, int, int]], min_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of one document's runs, from its openings in reading order; ``end`` is behind its last word.

    A diagonal's match grows in blocks of words until it ends; its run is emitted then.
    """
    active: dict[int, list[tuple[int, int]]] = {}  # start -> lags that match from there, and where each match ends
    runs = []
    for i, lag, have in opened:
        start = i + 1 - have - lag
        own = active.setdefault(start, [])
        if any(behind > i and lag % p == 0 for p, behind in own):
            continue
        behind = first_difference(words, lag, i + 1, end)
        own.append((lag, behind))
        if behind - start >= max(min_length, 2 * lag):
            runs.append((start, behind - start, lag))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(sizes: np.ndarray, words: np.ndarray, min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs of documents of ``sizes`` words that lie one after another in ``words``; starts count from each document's first."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = np.repeat(starts, sizes)
    at, lag, have = all_openings(words, first, min_length) if len(words) else (np.zeros(0, dtype=np.int64),) * 3
    cut = np.searchsorted(at, starts), np.searchsorted(at, ends)
    out = []
    for k, (a, b) in enumerate(zip(*cut, strict=True)):
        opened = list(zip(at[a:b].tolist(), lag[a:b].tolist(), have[a:b].tolist(), strict=True))
        s = int(starts[k])
        out.append([(i - s, n, q) for i, n, q in scan(words, int(ends[k]), opened, min_length)] if opened else [])
    return out


def periodic_runs(docs: DataFrame, *, min_length: int = MIN_LENGTH, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``runs`` (by start, then period) and ``collapsed``: the words outside every run's repeats, joined by one space."""

    def factory():
        def fn(batch):
            split = [t.split() for t in texts_of(batch.column("text"))]
            sizes = np.array([len(s) for s in split], dtype=np.int64)
            number: dict[bytes, int] = {}
            words = np.array([number.setdefault(w, len(number)) for s in split for w in s], dtype=np.int64)
            runs = runs_of(sizes, words, min_length)
            collapsed = []
            for s, found in zip(split, runs, strict=True):
                if found:
                    edge = np.zeros(len(s) + 1, dtype=np.int64)
                    for start, length, period in found:
                        edge[start + period] += 1
                        edge[start + length] -= 1
                    s = [s[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(s))
            rows = [[{"start": i, "length": n, "period": q} for i, n, q in found] for found in runs]
            return [rows, pa.array(collapsed, pa.binary()).cast(pa.string())]

        return fn

    return with_text_columns(docs, FIELDS, factory, keep)


def cycled(text: Column, doc_id: Column) -> Column:
    """The text of ``doc_id``, or for one id in ten a text whose words repeat from a point on, as the query's contract sets it."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", cycled(F.col("text"), F.col("doc_id")).alias("text"))
    out = periodic_runs(docs, keep=["doc_id"])
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return out.withColumn("_top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.s")).alias("start"), F.col("_top.n").alias("length"), (-F.col("_top.p")).alias("period"),
        F.expr("1000 * _top.n div -_top.p").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: CRC-32 of a text of ASCII digits, by its bits.
CRC_OF_ID = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""

SQL = f"""
WITH split AS (
  SELECT doc_id, {CRC_OF_ID} AS h,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS l FROM documents
), sized AS (
  SELECT *, len(l) AS n, h // 10 AS g FROM split
), placed AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized
), cycle AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), words AS (
  SELECT doc_id, i, l[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS w FROM (SELECT *, unnest(range(n)) AS i FROM cycle)
), grams AS (
  SELECT *, w || ' ' || lag(w, 1) OVER o || ' ' || lag(w, 2) OVER o || ' ' || lag(w, 3) OVER o || ' ' || lag(w, 4) OVER o || ' ' || lag(w, 5) OVER o AS gram
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), pairs AS (
  SELECT x.doc_id, x.i, x.i - y.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i > y.i
), islands AS (
  SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k, i FROM pairs
), matches AS (
  SELECT doc_id, q, min(i) - 5 - q AS start, count(*) + 5 + q AS length FROM islands GROUP BY doc_id, q, k
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM matches WHERE length >= 2 * q AND length >= 12 GROUP BY doc_id, start, length
), per_doc AS (
  SELECT doc_id, count(*) AS n_runs, arg_max({{'start': start, 'length': length, 'period': period}}, [length, -start, -period]) AS top,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS line
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS collapsed FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(r.n_runs, 0)::BIGINT AS n_runs, r.top.start::BIGINT AS start, r.top.length::BIGINT AS length, r.top.period::BIGINT AS period,
       (1000 * r.top.length // r.top.period)::BIGINT AS exponent_milli, sha256(coalesce(r.line, '')) AS runs_sha256, sha256(coalesce(k.collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per_doc r ON d.doc_id = r.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
