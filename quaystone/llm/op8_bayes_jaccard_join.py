"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of five-word shingles (words: runs of letters, digits and _, lower-cased).  Equal sets are
one node with a count, so copies are never expanded.  MinHash bands propose buckets; inside a bucket pairs
compare MinHash values in steps, and a pair is dropped as soon as the posterior probability of reaching the
threshold (uniform prior, binomial likelihood) falls below the tolerance.  What is left joins nodes into
families; inside a family all pairs go through the same pruning and the rest is verified exactly on the
shingle sets.  Buckets and families larger than a block are dealt as pairs of blocks; blocks give sums and
a spanning forest, never all pairs.

Bands of 4 of 128 values miss a pair at similarity 0.8 with probability 5e-8; the tolerance adds about 1e-9.

Defined cases: a text of one to four words is one shingle; a null, empty or wordless text has no shingles
and links with nothing; rows with one doc_id and equal texts are copies, with different texts they share
class and links; a null doc_id links with nothing, has a null class and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, group_starts, slices, stored, texts_of, tidy, whole_groups

THRESHOLD, WORDS, HASHES, BAND, TOLERANCE, BLOCK = 0.8, 5, 128, 4, 1e-9, 1024
STEP = 16  # MinHash values compared at a time
_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
WORD = re.compile(r"\w+")


@functools.lru_cache(1)
def word_hashes() -> dict[str, int]:
    return {}


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of every text, sorted within a text, and how many each has."""
    known = word_hashes()
    if len(known) > 200_000:
        known.clear()
    flat, sizes = [], []
    for t in texts:
        words = WORD.findall(t.decode().lower())
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        flat.extend(map(known.__getitem__, words))
        sizes.append(len(words))
    h, n = np.array(flat, dtype=np.uint64), np.array(sizes, dtype=np.int64)
    starts = np.cumsum(n) - n
    count = np.where(n == 0, 0, np.maximum(n - WORDS + 1, 1))
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.repeat(starts, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        out = np.zeros(len(doc), dtype=np.uint64)
        for k in range(WORDS):
            inside = k < np.repeat(n, count)
            word = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else out
            out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, word, np.uint64(k + 1))
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    by = np.lexsort((out, doc))
    out, doc = out[by], doc[by]
    first = np.r_[True, (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])] if len(out) else np.zeros(0, bool)
    out, doc = out[first], doc[first]
    return out, np.bincount(doc, minlength=len(texts))


def signatures(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (32 bits) of each non-empty set."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), HASHES), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat((shingles * MULTIPLY[k] + ADD[k]) >> np.uint64(32), starts)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, signature): node is a 128-bit digest of the shingle set; null for a set without shingles."""

    def run(batches):
        from quaystone.llm import op8_bayes_jaccard_join as own  # the worker's own word memo

        for whole in batches:
            for part in slices(whole, "text"):
                sh, n = own.shingle_hashes(texts_of(part.column("text")))
                ids = np.array(part.column("doc_id").to_pylist(), dtype=object)
                at = np.cumsum(n) - n
                sig = iter(own.signatures(sh, n)) if n.any() else iter(())
                nodes, sigs = [None] * len(n), [None] * len(n)
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    if n[i]:
                        s = next(sig)
                        if doc is not None:
                            nodes[i], sigs[i] = xxhash.xxh3_128_hexdigest(sh[at[i] : at[i] + n[i]].tobytes()), s.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes, pa.string()), pa.array(sigs, pa.binary())], names=["doc_id", "node", "signature"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, node string, signature binary")


def bands(nodes: DataFrame) -> DataFrame:
    """(bucket, band, rep): a row for each node and band."""

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), dtype="<u4").reshape(-1, HASHES)
            keys = band_keys(sig)
            n, m = keys.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(np.repeat(np.asarray(b.column("rep")), m))],
                names=["bucket", "band", "rep"],
            )

    return nodes.select("rep", "signature").mapInArrow(run, "bucket long, band int, rep long")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """64-bit keys, one for each band."""
    x = sig.reshape(len(sig), -1, BAND).astype(np.uint64)
    out = np.zeros(x.shape[:2], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BAND):
            out = (out ^ x[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


@functools.lru_cache(8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After each STEP values, the fewest matches with which the posterior P(similarity >= threshold) is at least the tolerance.

    With m of n values equal and a uniform prior, the posterior is Beta(m + 1, n - m + 1), whose upper tail
    at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (x[i], y[j]) of signatures pass every step."""
    left, same = np.arange(len(i)), np.zeros(len(i), dtype=np.int32)
    for k, least in enumerate(least_matches(THRESHOLD, TOLERANCE)):
        part = slice(k * STEP, (k + 1) * STEP)
        same = same + (x[i[left], part] == y[j[left], part]).sum(axis=1)
        ok = same >= least
        left, same = left[ok], same[ok]
    return left


def pair_ranges(n_q: int, n_t: int, same_block: bool):
    """Pairs of a block in parts: all of q x t, or each unordered pair once."""
    most = max(1, 200_000 // max(1, n_t))
    a, rows = 0, 1  # a first row alone often connects all
    while a < n_q:
        i, j = np.meshgrid(np.arange(a, min(n_q, a + rows)), np.arange(n_t), indexing="ij")
        a, rows = a + rows, most
        i, j = i.ravel(), j.ravel()
        if same_block:
            i, j = i[i < j], j[i < j]
        yield i, j


BUCKET = ["bucket", "band", "qb", "tb"]
FAMILY = ["family", "qb", "tb"]
#: Buckets up to this size are compared together, all their pairs in one array.
SMALL = 32


def read_signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, HASHES)


def sides(t: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of both sides of a block pair; the same rows where a block meets itself."""
    rows = np.arange(a, b)
    if t.column("qb")[a] == t.column("tb")[a]:
        return rows, rows, True
    role = t.column("role").to_numpy()[a:b]
    return rows[role == 0], rows[role == 1], False


def propose(batches):
    """Spanning forests of the pairs that survive the pruning in each bucket's block pair."""
    for t in whole_groups(batches, BUCKET):
        sig, rep = read_signatures(t.column("signature")), t.column("rep").to_numpy()
        forest, a, b = Forest(t.num_rows), [], []

        def link(i: np.ndarray, j: np.ndarray) -> None:
            new = forest.apart(i, j)
            i, j = i[new], j[new]
            left = surviving(sig, sig, i, j)
            i, j = i[left], j[left]
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if forest.join(x, y):
                    a.append(rep[x])
                    b.append(rep[y])

        starts = group_starts(t, BUCKET)
        ends = np.r_[starts[1:], t.num_rows]
        size = np.repeat(ends - starts, ends - starts)
        small = np.flatnonzero(size <= SMALL)  # never several blocks
        after = np.repeat(ends, ends - starts)[small] - small - 1
        for part in np.array_split(np.arange(len(small)), max(1, int(after.sum()) // 200_000)):
            n = after[part]
            i = np.repeat(small[part], n)
            link(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s > SMALL:
                q, o, same = sides(t, s, e)
                for i, j in pair_ranges(len(q), len(o), same):
                    link(q[i], o[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verify(batches):
    """Each node's links in its family (weighted by copies), and spanning forests of the links."""
    for t in whole_groups(batches, FAMILY):
        sig, rep, mult = read_signatures(t.column("signature")), t.column("rep").to_numpy(), t.column("mult").to_numpy()
        sets = [np.frombuffer(x, dtype="<u8") for x in t.column("shingles").to_pylist()]
        starts = group_starts(t, FAMILY)
        nodes, others, links = [], [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
            q, o, same = sides(t, s, e)
            size = np.array([len(x) for x in sets[s:e]])
            # shingles of one node alone can't be shared: the others are numbered
            _, number, times = np.unique(np.concatenate(sets[s:e]), return_inverse=True, return_counts=True)
            keep = times[number] > 1
            numbers = number[keep]
            cuts = np.searchsorted(np.repeat(np.arange(e - s), size)[keep], np.arange(e - s + 1))
            total, forest, mark = np.zeros(e - s, dtype=np.int64), Forest(e - s), np.zeros(len(times), dtype=bool)
            for i, j in pair_ranges(len(q), len(o), same):
                i, j = q[i], o[j]
                left = surviving(sig, sig, i, j)
                i, j = i[left] - s, j[left] - s
                for u in np.unique(i):  # each set, marked, against all it is paired with
                    js = j[i == u]
                    own = numbers[cuts[u] : cuts[u + 1]]
                    mark[own] = True
                    n = cuts[js + 1] - cuts[js]
                    take = np.repeat(cuts[js] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    shared = np.bincount(np.repeat(np.arange(len(js)), n), weights=mark[numbers[take]], minlength=len(js))
                    mark[own] = False
                    # in whole numbers: shared / union >= threshold
                    hit = js[1000 * shared >= round(1000 * THRESHOLD) * (size[u] + size[js] - shared)]
                    total[u] += mult[s + hit].sum()
                    total[hit] += mult[s + u]
                    for v in hit[forest.apart(np.full(len(hit), u), hit)]:
                        if forest.join(int(u), int(v)):
                            nodes.append(rep[s + u])
                            others.append(rep[s + v])
                            links.append(0)
            some = np.flatnonzero(total)
            nodes += rep[s + some].tolist()
            others += [None] * len(some)
            links += total[some].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(links, pa.int64())], names=["rep", "other", "links"])


def block_pairs(rows: DataFrame, group: list[str], counts: DataFrame, block: int) -> DataFrame:
    """Deal the rows of each group into pairs of blocks: each unordered pair of rows meets in one (qb, tb), qb <= tb."""
    n = F.ceil(F.col("_n") / block).cast("int")
    dealt = rows.join(counts, group).withColumn("_b", F.pmod(F.xxhash64("rep"), n).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda o: F.struct(F.least(o, F.col("_b")).alias("qb"), F.greatest(o, F.col("_b")).alias("tb"), (o < F.col("_b")).cast("int").alias("role")),
    )
    return dealt.withColumn("_p", F.explode(pairs)).select(*rows.columns, "_p.qb", "_p.tb", "_p.role")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id reachable by links), n_links, kept."""
    return classes(docs).drop("wordless")


def classes(docs: DataFrame) -> DataFrame:
    """The same with ``wordless``: the text has no shingles."""
    found = stored(sketches(docs), "sketches")
    nodes = stored(found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.first("signature").alias("signature")), "jaccard-nodes")
    banded = stored(bands(nodes), "bands")
    buckets = banded.groupBy("bucket", "band").agg(F.count("*").alias("_n")).where("_n > 1")
    members = banded.join(buckets.select("bucket", "band"), ["bucket", "band"], "left_semi").join(nodes.select("rep", "signature"), "rep")
    dealt = block_pairs(members, ["bucket", "band"], buckets, BLOCK).repartition(*BUCKET).sortWithinPartitions(*BUCKET, "rep")
    proposed = dealt.mapInArrow(tidy(propose), "a long, b long")
    families = stored(components(proposed, "families").withColumnRenamed("node", "rep").withColumnRenamed("component", "family"), "families")
    sizes = families.groupBy("family").agg(F.count("*").alias("_n"))

    def sets(batches):
        from quaystone.llm import op8_bayes_jaccard_join as own

        for whole in batches:
            for part in slices(whole, "text"):
                sh, n = own.shingle_hashes(texts_of(part.column("text")))
                at = np.cumsum(n) - n
                data = [sh[a : a + k].tobytes() for a, k in zip(at, n, strict=True)]
                made = [part.column("rep"), part.column("family"), pa.array([xxhash.xxh3_128_hexdigest(d) for d in data]), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["rep", "family", "node", "shingles"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(families, "rep").select("rep", "family", "text")
    rows = texts.mapInArrow(tidy(sets), "rep long, family long, node string, shingles binary")
    rows = rows.dropDuplicates(["rep", "node"]).join(nodes.select("rep", "node", "mult", "signature"), ["rep", "node"])
    rows = rows.select("family", "rep", "mult", "signature", "shingles")
    dealt = block_pairs(rows, ["family"], sizes, BLOCK).repartition(*FAMILY).sortWithinPartitions(*FAMILY, "rep")
    made = stored(dealt.mapInArrow(tidy(verify), "rep long, other long, links long"), "links")
    links = made.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(made.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), "classes")
    per_node = (
        nodes.select("node", "rep", "mult").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("node", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    )
    out = found.select("doc_id", "node").join(per_node, "node", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("node").isNull().alias("wordless"))
    return out.withColumn("kept", F.col("class_id").eqNullSafe(F.col("doc_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose class has a smaller doc_id.

    Equal texts without words are copies too: the smallest doc_id stays.  Of rows that repeat doc_id and text one
    stays; a null doc_id is kept.
    """
    marks = classes(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max(~F.col("kept")).alias("__gone"), F.max("wordless").alias("__bare"), F.count("*").alias("__rows"))
    marks = stored(marks.where("__gone or __bare or __rows > 1"), "marks").withColumnRenamed("doc_id", "__id")
    left = docs.join(marks, F.col("doc_id") == F.col("__id"), "left").where("__gone is null or not __gone")
    twin = F.col("__id").isNotNull()
    bare = F.col("__bare") & (F.col("__rows") == 1)
    text = F.coalesce("text", F.lit(""))
    once = left.where(twin).groupBy(F.when(~bare, F.col("doc_id")).alias("__own"), F.sha2(text, 256).alias("__text")).agg(F.min_by(F.struct(*docs.columns), "doc_id").alias("__row"))
    return left.where(~twin).select(docs.columns).unionByName(once.select("__row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return jaccard_classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_\p{M}]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), pairs AS (
  SELECT h.a, h.b FROM shared h JOIN sizes x ON x.doc_id = h.a JOIN sizes y ON y.doc_id = h.b
  WHERE 10 * h.c >= 8 * (x.n + y.n - h.c)
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.b, d.doc_id)) AS class_id, coalesce(l.n, 0)::BIGINT AS n_links,
       d.doc_id = least(d.doc_id, coalesce(c.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN links l ON l.a = d.doc_id LEFT JOIN comp c ON c.a = d.doc_id
"""
