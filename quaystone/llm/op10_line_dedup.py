"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of rising doc_id.  Each batch's line hashes are anti-joined with the live
runs; what is new becomes a run of its own (hash -> first owner), sorted by hash.  ``fanout`` runs of a
level are merged into one of the next.  A line goes when an owner with a smaller doc_id holds its key.

Key: the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys under ``min_chars`` code
points never count.  Keys are compared by 128-bit hashes.

Defined cases: null or empty text is one empty line and stays; a null doc_id owns nothing and loses
nothing; rows that repeat a doc_id share its ownership, so copies inside one doc_id stay; an empty table
gives an empty result; other columns are carried, and n_lines / n_dropped / text are replaced.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, shared_dir, slices, stored, texts_of, tidy

SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(SPACE)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())  # bytes.lower: A-Z only


def line_hashes(docs: DataFrame, bounds: list[int], min_chars: int) -> DataFrame:
    """(batch, doc_id, k1, k2): the distinct keys of each row."""
    schema = "batch int, doc_id long, k1 long, k2 long"

    def run(batches):
        import numpy as np

        for whole in batches:
            for part in slices(whole, "text"):
                ids, keys = [], []
                for i, text in zip(part.column("doc_id").to_pylist(), texts_of(part.column("text")), strict=True):
                    if i is None or len(text) < min_chars:
                        continue
                    own = {line_key(x, min_chars) for x in text.split(b"\n")}
                    own.discard(None)
                    keys.extend(own)
                    ids.extend([i] * len(own))
                k = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
                ids = np.array(ids, dtype="i8")
                at = np.searchsorted(bounds, ids, side="left").astype("i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(ids), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())],
                    names=["batch", "doc_id", "k1", "k2"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def repeated_keys(hashes: DataFrame, n_batches: int, fanout: int) -> DataFrame:
    """(k1, k2, owner) of every key that a second document holds; runs live in the shared folder."""
    spark = hashes.sparkSession
    levels: list[list[DataFrame]] = [[]]
    repeated = []
    for b in range(n_batches):
        mine = (
            hashes.where(F.col("batch") == b).groupBy("k1", "k2").agg(F.min("doc_id").alias("own"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        )
        live = [r for level in levels for r in level]
        if live:
            old = live[0]
            for r in live[1:]:
                old = old.union(r)
            met = mine.join(old, ["k1", "k2"], "left")
        else:
            met = mine.withColumn("owner", F.lit(None).cast("long"))
        met = met.select("k1", "k2", F.coalesce("owner", "own").alias("owner"), F.col("owner").isNull().alias("is_new"), (F.col("hi") > F.col("lo")).alias("twice"))
        met = stored(met.sortWithinPartitions("k1", "k2"), "line-run")
        repeated.append(met.where("twice or not is_new").select("k1", "k2", "owner"))
        levels[0].append(met.where("is_new").select("k1", "k2", "owner"))
        for at in range(len(levels)):
            if len(levels[at]) >= fanout and b + 1 < n_batches:  # compaction; keys of runs are disjoint
                merged = levels[at][0]
                for r in levels[at][1:]:
                    merged = merged.union(r)
                merged = stored(merged.repartition("k1", "k2").sortWithinPartitions("k1", "k2"), f"line-level{at + 1}")
                levels[at] = []
                if at + 1 == len(levels):
                    levels.append([])
                levels[at + 1].append(merged)
    out = repeated[0]
    for r in repeated[1:]:
        out = out.union(r)
    return out.groupBy("k1", "k2").agg(F.min("owner").alias("owner"))


def drop_repeated_lines(docs: DataFrame, *, min_chars: int = 10, n_batches: int = 4, fanout: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with text stripped of repeated lines, plus n_lines and n_dropped (long)."""
    spark = docs.sparkSession
    shared_dir(spark)
    ids = docs.select(F.col("doc_id").cast("double").alias("d")).where("d is not null")
    cuts = ids.approxQuantile("d", [i / n_batches for i in range(1, n_batches)], 0.01) if n_batches > 1 else []
    bounds = sorted({int(x) for x in cuts})
    path = new_path(spark, "line-hashes")
    line_hashes(docs, bounds, min_chars).write.partitionBy("batch").parquet(path)
    hashes = spark.read.schema("doc_id long, k1 long, k2 long, batch int").parquet(path)
    # written, so that both sides of the next join are plain exchanges and a common line's rows can be split
    repeated = stored(repeated_keys(hashes, len(bounds) + 1, fanout), "repeated-lines")
    gone = (
        hashes.join(repeated, ["k1", "k2"])
        .where("owner < doc_id")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("k1", "k2")).alias("_gone"))
    )
    mark = "_gone" + "_" * max(map(len, docs.columns))  # no column of docs has this name
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_lines", "n_dropped", "text")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches):
        import numpy as np

        for whole in batches:
            for part in slices(whole, "text"):
                texts, n_lines, n_dropped = [], [], []
                for text, gone in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column(mark).to_pylist(), strict=True):
                    n_lines.append(1 + (text or b"").count(b"\n"))
                    n_dropped.append(0)
                    if gone:
                        out = {np.array([g["k1"], g["k2"]], dtype="<i8").tobytes() for g in gone}
                        lines = text.split(b"\n")
                        left = [x for x in lines if line_key(x, min_chars) not in out]
                        n_dropped[-1] = len(lines) - len(left)
                        text = b"\n".join(left)
                    texts.append(text)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                    names=[*keep, "text", "n_lines", "n_dropped"],
                )

    need = list(dict.fromkeys([*keep, "doc_id", "text"]))
    joined = docs.select(*need).join(gone.select("doc_id", F.col("_gone").alias(mark)), "doc_id", "left")
    return joined.select(*need, mark).mapInArrow(tidy(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = drop_repeated_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM split
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT d.doc_id, d.pos, d.line, coalesce(o.owner < d.doc_id, false) AS gone
  FROM keyed d LEFT JOIN owners o ON d.k = o.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
