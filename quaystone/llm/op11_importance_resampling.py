"""Target-distribution importance resampling: array-scored weights, ranks by parallel sorting by regular sampling.

Weights.  Runs of one to ``max_run`` words are hashed into ``n_buckets`` buckets (CRC-32 of the words joined by one
space).  Counts of the source and of the target give every bucket a gain, an array of ``n_buckets`` integers that every
task holds; a document's weight is the sum of its features' gains.  CRCs of longer runs are put together from those of
their words in whole arrays.  Weight plus Gumbel noise of the id's hash is the score: the highest scores are a sample
without replacement by weight.

Ranks.  Scores are written as locally sorted runs.  Each run gives regular samples; the samples' own quantiles are the
splitters.  Runs count their rows between splitters, prefix sums of the counts are the exact ranks at which segments
begin, so segments wholly below the draw are never exchanged.  The others are exchanged by segment, merged where they
arrive, and a row's rank is its segment's first rank plus its place there.  Rows with equal scores go by doc_id, then by
their place when written, so that any number of ties is parted.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined cases: null or empty text has no features and weight 0; a null doc_id has no score and is never drawn; repeated
rows are counted, scored and ranked like others; without eligible rows nothing is drawn; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import Remembered, slices, stored, texts_of, with_text_columns

N_BUCKETS, MAX_RUN, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Splitters of the parallel sort at most, and samples over all runs at most (16 bytes each on the driver).
SPLITTERS, SAMPLES = 4096, 200_000
#: Distinct words whose CRC a task remembers in each of two generations, and the bytes of a word beyond which it does not.
CACHE, LONG_WORD = 200_000, 64

IS_WORD = bytes(c for c in range(256) if chr(c).isalnum() or c >= 0x80)
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if c in IS_WORD else 32 for c in range(256))


def byte_table() -> np.ndarray:
    """CRC-32 (reflected polynomial 0xEDB88320) of one byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


class Shift:
    """CRCs moved past n more bytes: crc(a + b) = moved(crc(a), len(b)) ^ crc(b)."""

    def __init__(self, longest: int = 64):
        one = byte_table()
        self.step = lambda c: (c >> np.uint32(8)) ^ one[c & np.uint32(0xFF)]
        lanes = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
        tables = [lanes]
        for _ in range(longest):
            tables.append(self.step(tables[-1]))
        self.tables, self.longest = np.stack(tables), longest  # (bytes, lane, value)

    def moved(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = n.copy()
        while True:
            k = np.minimum(n, self.longest)
            t = self.tables
            crc = t[k, 0, crc & 0xFF] ^ t[k, 1, crc >> 8 & 0xFF] ^ t[k, 2, crc >> 16 & 0xFF] ^ t[k, 3, crc >> 24]
            n -= k
            if not n.any():
                return crc


class Hasher:
    """CRCs of all runs of words in a slice of texts."""

    def __init__(self):
        self.shift, self.known = Shift(), Remembered(CACHE)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, CRC and bytes of every word)."""
        split = [t.translate(LOWERED).split() for t in texts]
        sizes = np.array([len(s) for s in split], dtype=np.int64)
        known = self.known
        new = {w for s in split for w in s}
        new -= known.young.keys()
        known.promote(new)
        known.young.update((w, (zlib.crc32(w), len(w))) for w in new)
        flat = np.array([known.young[w] for s in split for w in s], dtype=np.int64).reshape(-1, 2)
        for w in new:
            if len(w) > LONG_WORD:
                del known.young[w]
        known.turn()
        return sizes, flat[:, 0].astype(np.uint32), flat[:, 1]

    def runs(self, texts: list[bytes], max_run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per run length: the CRC of the run that ends at each word, and the texts of those words."""
        sizes, crc, n_bytes = self.words(texts)
        text = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        spaced = self.shift.moved(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), n_bytes) ^ crc  # " " + word
        run = crc
        yield run, text
        for k in range(1, max_run):
            at = np.flatnonzero(place >= k)
            longer = np.zeros_like(run)
            longer[at] = self.shift.moved(run[at - 1], n_bytes[at] + 1) ^ spaced[at]
            run = longer
            yield run[at], text[at]


def bucket_counts(docs: DataFrame, n_buckets: int = N_BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """(bucket, n): features of all texts in each bucket; every task counts its own in an array first."""

    def run(batches):
        hasher, total = Hasher(), np.zeros(n_buckets, dtype=np.int64)
        for whole in batches:
            for part in slices(whole, "text"):
                for crc, _ in hasher.runs(texts_of(part.column("text")), max_run):
                    total += np.bincount(crc % np.uint32(n_buckets), minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the source."""
    s = bucket_counts(docs, n_buckets, max_run).withColumnRenamed("n", "s")
    t = bucket_counts(target, n_buckets, max_run).withColumnRenamed("n", "t")
    counts = np.zeros((2, n_buckets), dtype=np.int64)
    for r in s.join(t, "bucket", "full").collect():  # one row a bucket
        counts[:, r["bucket"]] = r["s"] or 0, r["t"] or 0
    s, t = counts.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, *, max_run: int = MAX_RUN, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_features and weight."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one integer a bucket
    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]

    def factory():
        hasher, gain = Hasher(), shared.value

        def fn(batch):
            texts = texts_of(batch.column("text"))
            words, features, weight = None, np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            for crc, text in hasher.runs(texts, max_run):
                n = np.bincount(text, minlength=len(texts))
                words = n if words is None else words
                features += n
                total = np.r_[0, np.cumsum(gain[crc % np.uint32(len(gain))])]  # rows of a text lie together
                ends = np.cumsum(n)
                weight += total[ends] - total[ends - n]
            return [pa.array(x.astype(np.int64)) for x in (words, features, weight)]

        return fn

    return with_text_columns(docs, fields, factory, keep)


def scored(docs: DataFrame, gain: np.ndarray, *, seed: int = SEED, max_run: int = MAX_RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return weighed(docs, gain, max_run=max_run, keep=["doc_id"]).withColumn("score", F.col("weight") + noise)


KEY = ["down", "doc_id", "seq"]


def sort_key(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """The key columns of a whole run, in rising order of (-score, doc_id, seq)."""
    held = [[b.column(k).to_numpy() for k in KEY] for b in batches]
    cols = [np.concatenate([h[k] for h in held]) if held else np.zeros(0, dtype=np.int64) for k in range(3)]
    order = np.lexsort(cols[::-1])
    return tuple(c[order] for c in cols)


def samples_of_runs(runs: DataFrame, each: int) -> DataFrame:
    """At most ``each`` keys at regular places of every run, with the rows that each stands for."""

    def pick(batches):
        key = sort_key(batches)
        n = len(key[0])
        k = min(n, each)
        at = (np.arange(1, k + 1) * n // (k + 1)) if k else np.zeros(0, dtype=np.int64)
        weight = np.full(k, n / max(1, k))
        yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in key), pa.array(weight)], names=[*KEY, "rows"])

    return runs.select(*KEY).mapInArrow(pick, "down long, doc_id long, seq long, rows double")


def splitters(runs: DataFrame, n_segments: int, n_runs: int) -> np.ndarray:
    """At most ``n_segments`` - 1 keys that part the rows about evenly; SAMPLES keys at most reach the driver."""
    found = samples_of_runs(runs, max(1, min(n_segments, SAMPLES // max(1, n_runs)))).toPandas().sort_values(KEY)
    if not len(found):
        return np.zeros((0, 3), dtype=np.int64)
    share = np.cumsum(found["rows"].to_numpy())
    at = np.searchsorted(share, np.arange(1, n_segments) * share[-1] / n_segments)
    return np.unique(found[KEY].to_numpy(dtype=np.int64)[np.minimum(at, len(found) - 1)], axis=0)


def segment_of(key: tuple[np.ndarray, ...], cuts: np.ndarray) -> np.ndarray:
    """How many splitters are at or below each key, by one merge of the two."""
    n, m = len(key[0]), len(cuts)
    both = [np.r_[cuts[:, k], key[k]] for k in range(3)]
    order = np.lexsort([np.arange(n + m), *both[::-1]])  # splitters before equal keys
    below = np.cumsum(order < m)
    out = np.empty(n + m, dtype=np.int64)
    out[order] = below
    return out[m:]


def in_segments(runs: DataFrame, cuts: np.ndarray) -> DataFrame:
    """``runs`` with their segment."""
    shared = runs.sparkSession.sparkContext.broadcast(cuts)  # at most SPLITTERS keys
    schema = T.StructType([*runs.schema, T.StructField("segment", T.LongType())])

    def mark(batches):
        for b in batches:
            seg = segment_of(tuple(b.column(k).to_numpy() for k in KEY), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seg)], names=[*b.schema.names, "segment"])

    return runs.mapInArrow(mark, schema)


def ranked(rows: DataFrame, drawn: int, *, n_segments: int | None = None) -> DataFrame:
    """``rows`` (doc_id, score and others) with ``rank`` 1 to ``drawn`` by falling score, then rising doc_id; null beyond.

    ``rows`` must have no null score; it is written once, as locally sorted runs.
    """
    spark = rows.sparkSession
    runs = rows.withColumn("down", -F.col("score")).withColumn("seq", F.monotonically_increasing_id()).sortWithinPartitions(*KEY)
    runs = stored(runs, "sorted-runs")
    n_segments = n_segments or min(SPLITTERS, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = splitters(runs, n_segments, runs.rdd.getNumPartitions())
    marked = in_segments(runs, cuts)
    counts = {r["segment"]: r["count"] for r in marked.groupBy("segment").count().collect()}  # one row a segment
    order = sorted(counts)
    first = dict(zip(order, np.r_[0, np.cumsum([counts[k] for k in order])].tolist(), strict=False))
    last = max((k for k in order if first[k] < drawn), default=-1)
    places = spark.createDataFrame([(k, first[k]) for k in order if k <= last], "segment long, first long")
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*KEY))
    near = marked.where(F.col("segment") <= last).withColumn("place", place).join(F.broadcast(places), "segment")
    rank = F.col("first") + F.col("place")
    near = near.select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))
    far = marked.where(F.col("segment") > last).select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return near.union(far)


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, n_segments: int | None = None) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank; rank null where it is not drawn."""
    out = ["doc_id", "n_features", "weight", "score"]
    rows = stored(scored(docs, gains(docs, target), seed=seed), "scored")
    able = F.coalesce((F.col("n_words") >= min_words) & F.col("score").isNotNull(), F.lit(False))
    n = rows.where(able).count()
    rest = rows.where(~able).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked(rows.where(able).select(*out), percent * n // 100, n_segments=n_segments).union(rest)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def crc_sql(bytes_list: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes_list}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"


SQL = f"""
WITH crc AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS c FROM range(256) r(n))
), texts AS (
  SELECT 'd' AS of, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark
), split AS (
  SELECT of, row, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS l FROM texts
), words AS (
  SELECT of, row, i, l[i] AS w1, l[i + 1] AS w2, l[i + 2] AS w3 FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM split)
), features AS (
  SELECT of, row, w1 AS f FROM words UNION ALL SELECT of, row, w1 || ' ' || w2 FROM words WHERE w2 IS NOT NULL
  UNION ALL SELECT of, row, w1 || ' ' || w2 || ' ' || w3 FROM words WHERE w3 IS NOT NULL
), counted AS (
  SELECT of, row, f, count(*) AS n FROM features GROUP BY of, row, f
), hashed AS (
  SELECT f, {crc_sql("list_transform(range(octet_length(encode(f))), lambda i: ('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2])::BIGINT)")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc
), bucketed AS (
  SELECT of, row, bucket, sum(n)::DOUBLE AS n FROM counted JOIN hashed USING (f) GROUP BY of, row, bucket
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE of = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE of = 'b'), 0) AS t FROM bucketed GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM totals
), weights AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM bucketed JOIN gain USING (bucket) WHERE of = 'd' GROUP BY row
), scores AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(p.l) >= 20 AS able,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) d JOIN split p ON p.of = 'd' AND p.row = d.row LEFT JOIN weights w ON w.row = d.row
), places AS (
  SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE able) OVER () AS n FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM places
"""
