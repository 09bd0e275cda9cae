"""Embedding near-duplicates: an exact metric range join on unit vectors.

cosine >= t is a distance of at most r = sqrt(2 - 2 t) between unit vectors.  Equal vectors of a label are
one node with a count.  Pivots partition the nodes: each has its home at the nearest pivot and visits any
other cell that the triangle inequality leaves open (distance to that pivot <= distance home + 2 r, and
<= that cell's radius + r).  Cells join independently, home rows against home rows and visitors, in blocks
of bounded size, and give sums and a spanning forest instead of pairs.

The pivots come from a bounded, documented sample (PIVOT_SAMPLE nodes); they steer cost, never results.

Defined cases: a row whose label or vector is null, or whose vector is empty, zero or holds null or
non-finite components, links with nothing; vectors of different lengths link with nothing; rows that repeat
a vec_id count as vectors of their own; a null vec_id links with nothing and has a null component; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, stored

THRESHOLD = 0.93
CELL_ROWS, MAX_PIVOTS, PIVOT_SAMPLE, BLOCK = 2000, 1024, 4096, 2000
#: Rows placed at a time, and the distance from the threshold within which a cosine is summed exactly.
PLACE_ROWS, NEAR = 1000, 1e-12


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, node, vector): usable rows; node is a 128-bit digest of the components."""

    def run(batches):
        for b in batches:
            ids, labels, digests, data = [], [], [], []
            for i, l, v in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                if i is None or l is None or not v or None in v:
                    continue
                x = np.array(v, dtype="<f8") + 0.0  # -0.0 becomes 0.0
                if not np.isfinite(x).all() or not np.any(x):
                    continue
                ids.append(i)
                labels.append(str(l))
                data.append(x.tobytes())
                digests.append(xxhash.xxh3_128_hexdigest(data[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(digests, pa.string()), pa.array(data, pa.binary())], names=["vec_id", "label", "node", "vector"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, label string, node string, vector binary")


def unit(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), dtype="<f8").reshape(len(data), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(nodes: DataFrame, per_label: int) -> dict[int, np.ndarray]:
    """Pivots by vector length, farthest first from a sample of at most PIVOT_SAMPLE nodes."""
    rows = nodes.select("vector").orderBy(F.xxhash64("node"), "node").limit(PIVOT_SAMPLE).collect()
    out = {}
    for size in {len(r[0]) for r in rows}:
        x = unit([bytes(r[0]) for r in rows if len(r[0]) == size])
        chosen, d = [0], np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < min(per_label, len(x)) and d.max() > 0:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, np.linalg.norm(x - x[chosen[-1]], axis=1))
        out[size] = x[chosen]
    return out


def cosine(a: bytes, b: bytes) -> float:
    """Cosine with sums rounded once; powers of two keep huge and tiny components finite."""
    x, y = (np.frombuffer(v, dtype="<f8") for v in (a, b))
    x, y = (np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in (x, y))
    total = lambda u, v: math.fsum((u * v).tolist())
    return total(x, y) / math.sqrt(total(x, x) * total(y, y))


def join_block(threshold: float):
    def run(batch: pa.Table) -> pa.Table:
        p = batch.to_pandas()
        q, t = p[p.role == "q"].reset_index(drop=True), p[p.role == "t"].reset_index(drop=True)
        node, other, links = [], [], []
        if len(q) and len(t):
            x, y = unit(q["vector"].tolist()), unit(t["vector"].tolist())
            code, reps = pd.factorize(np.r_[q["rep"], t["rep"]])
            qc, tc = code[: len(q)], code[len(q) :]
            mult = t["mult"].to_numpy()
            forest, total = Forest(len(reps)), np.zeros(len(q), dtype=np.int64)
            for a in range(0, len(q), 500):
                c = x[a : a + 500] @ y.T
                hit = c >= threshold
                for i, j in zip(*np.nonzero(np.abs(c - threshold) < NEAR), strict=True):  # the product's rounding must not decide
                    hit[i, j] = cosine(q["vector"][a + i], t["vector"][j]) >= threshold
                hit &= qc[a : a + 500, None] != tc[None, :]
                total[a : a + 500] = hit @ mult
                i, j = np.nonzero(hit)
                u, v = qc[a + i], tc[j]
                while len(k := forest.apart(u, v)):
                    u, v = u[k], v[k]
                    for m in np.unique(forest.p[u], return_index=True)[1].tolist():  # one pair a tree
                        if forest.join(int(u[m]), int(v[m])):
                            node.append(reps[u[m]])
                            other.append(reps[v[m]])
            links += [0] * len(node)
            some = np.flatnonzero(total)
            node += q["rep"].to_numpy()[some].tolist()
            other += [None] * len(some)
            links += total[some].tolist()
        return pa.table([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(links, pa.int64())], names=["rep", "other", "links"])

    return run


def range_join(vectors: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    r = float(np.sqrt(2 - 2 * threshold)) + 1e-6  # distances by the cosine are within 1e-7
    found = stored(nodes_of(vectors), "vectors")
    nodes = stored(found.groupBy("label", "node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("vector").alias("vector")), "vector-nodes")
    most = nodes.groupBy("label").count().agg(F.max("count")).head()[0] or 0
    pivots = spark.sparkContext.broadcast(choose_pivots(nodes, max(1, min(MAX_PIVOTS, -(-most // CELL_ROWS)))))  # bounded by MAX_PIVOTS

    def cells_of(data: list[bytes], size: int) -> tuple[np.ndarray, ...]:
        """Row, cell, whether it is home, distance, for each cell a row belongs to or may have links in."""
        p = pivots.value.get(size)  # a length outside the sample: one cell
        d = np.zeros((len(data), 1)) if p is None else np.sqrt(np.maximum(0, 2 - 2 * unit(data) @ p.T))
        i, k = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * r)
        return i, k, k == d.argmin(axis=1)[i], d[i, k]

    def place(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, PLACE_ROWS):
                b = whole.slice(start, PLACE_ROWS)
                data = b.column("vector").to_pylist()
                sizes = np.array([len(v) for v in data])
                for size in np.unique(sizes).tolist():
                    of = np.flatnonzero(sizes == size)
                    i, *flat = cells_of([data[k] for k in of], size)
                    taken = b.take(pa.array(of[i]))
                    made = [pa.array(x, k) for x, k in zip(flat, (pa.int32(), pa.bool_(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("label", "rep", "mult", "vector")), pa.array(np.full(len(i), size)), *made], names=["label", "rep", "mult", "vector", "size", "cell", "home", "d"])

    placed = stored(nodes.mapInArrow(place, "label string, rep long, mult long, vector binary, size long, cell int, home boolean, d double"), "vector-cells")
    cell = ["label", "size", "cell"]
    extent = placed.groupBy(*cell).agg(F.max(F.when(F.col("home"), F.col("d"))).alias("radius"), F.count_if("home").alias("n_home"), F.count("*").alias("n_all"))
    rows = placed.join(extent, cell).where(F.col("home") | (F.col("d") <= F.col("radius") + r))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    salt = lambda n: F.pmod(F.xxhash64("rep"), blocks(n)).cast("int")
    cols = [*cell, "rep", "mult", "vector"]
    asked = rows.where("home").select(*cols, F.lit("q").alias("role"), salt("n_home").alias("qb"), F.explode(F.sequence(F.lit(0), blocks("n_all") - 1)).alias("tb"))
    held = rows.where("n_home > 0").select(*cols, F.lit("t").alias("role"), F.explode(F.sequence(F.lit(0), blocks("n_home") - 1)).alias("qb"), salt("n_all").alias("tb"))
    made = stored(asked.unionByName(held).groupBy(*cell, "qb", "tb").applyInArrow(join_block(threshold), "rep long, other long, links long"), "vector-links")
    links = made.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(made.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), "vector-components")
    per_node = nodes.select("label", "node", "rep", "mult").join(links, "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = found.select("vec_id", "label", "node").join(per_node, ["label", "node"]).select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # a vec_id that is there more than once has a row for each usable row; the rest link with nothing
    counts = known.groupBy("vec_id").agg(F.count("*").alias("have"))
    spare = vectors.groupBy("vec_id").agg(F.count("*").alias("all")).join(counts, "vec_id", "left").select("vec_id", (F.col("all") - F.coalesce("have", F.lit(0))).alias("n"))
    lone = spare.where("n > 0").select("vec_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(lone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return range_join(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN links l ON l.a = e.vec_id LEFT JOIN comp c ON c.a = e.vec_id
"""
