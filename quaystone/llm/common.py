"""Shared helpers: tables kept in the cluster's shared folder, Arrow passes over texts, hot-safe components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one Python step holds at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = "file://" + tempfile.mkdtemp(prefix="quaystone-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quaystone/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow; what its task held goes back to the system, as the worker process lives on and serves later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of at most about ``size`` bytes in ``column``, one row at least."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    parts = np.cumsum(sizes) // size
    cuts = np.flatnonzero(np.diff(parts)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null becomes empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def with_text_columns(
    df: DataFrame, fields: list[T.StructField], factory: Callable, keep: list[str] | None = None, text: str = "text", size: int = SLICE_BYTES
) -> DataFrame:
    """Append columns computed from ``text``; one Arrow pass, no shuffle.

    ``factory()`` runs once a task and gives ``fn(batch) -> list`` of column values, one per field.
    ``keep`` names the input columns to carry (all by default).  A carried column with the name of a
    result is replaced by it.
    """
    names = {f.name for f in fields}
    carried = [c for c in (df.columns if keep is None else keep) if c not in names]
    read = [*carried, *([] if text in carried else [text])]
    schema = T.StructType([df.schema[c] for c in carried] + fields)
    kinds = [arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = factory()
        for batch in batches:
            for part in slices(batch, text, size):
                made = fn(part)
                cols = [part.column(c) for c in carried]
                cols += [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=[*carried, *(f.name for f in fields)])

    return df.select(*read).mapInArrow(tidy(run), schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in t.fields])
    return {
        "long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[t.typeName()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of one or more whole groups, from batches sorted by ``keys``."""

    def same(x: pa.RecordBatch, i: int, y: pa.RecordBatch, j: int) -> bool:
        return all(x.column(k)[i] == y.column(k)[j] for k in keys)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(max(0, b.num_rows - 1), dtype=bool)
        for k in keys:
            x = np.asarray(b.column(k))
            new |= x[1:] != x[:-1]
        cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if held and not same(held[-1], held[-1].num_rows - 1, b, 0):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(t.num_rows, dtype=bool)
    if t.num_rows:
        new[1:] = False
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class Remembered:
    """A bounded memo: two generations, the older is dropped when the younger is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def promote(self, keys: set) -> None:
        """Move what the older generation knows of ``keys`` to the younger; the rest stays in ``keys``."""
        known = keys & self.old.keys()
        self.young.update((k, self.old[k]) for k in known)
        keys -= known

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young


def fingerprint(edges: DataFrame) -> tuple:
    """Count and hash sums of an edge set; equal sets have equal fingerprints."""
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h), F.sum("b")).head())


def components(edges: DataFrame, label: str = "components", rounds: int = 40) -> DataFrame:
    """Connected components by alternating star contraction; ``edges`` (a long, b long) -> (node, component).

    Component = the smallest node id.  Only edges travel, each round is written to the shared folder and
    ends when no edge changes.  A hub's edges shrink to one a node by aggregation with a map-side part.
    """
    cur = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    state = fingerprint(cur)
    for _ in range(rounds):
        # large star: every larger neighbour of a node goes to the smallest node of its neighbourhood
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b"), label)
        # small star: every smaller neighbour, and the node itself, goes to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        cur = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), label)
        before, state = state, fingerprint(cur)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


class Forest:
    """Union-find over 0..n-1 for one block; ``apart`` filters pairs before any Python loop."""

    def __init__(self, n: int):
        self.p = np.arange(n)

    def find(self, x: int) -> int:
        p = self.p
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.p[y] = x
        return True

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Indices of the pairs not connected yet."""
        p = self.p
        while not np.array_equal(q := p[p], p):
            p = q
        self.p = p
        return np.flatnonzero(p[x] != p[y])
