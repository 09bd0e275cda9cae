"""Sharding by a k-d tree over document metadata.

A point is a group of equal texts (weight: its bytes; coordinates: source, language, log size).
From the root on, each node is cut along its widest dimension at the weighted quantile that splits its
leaves, found with four distributed histograms, each of STEP further bits; a text hash only parts ties.
Leaves are shards of nearly equal bytes (law `bytes`).  Equal texts stay together: a group above GROUP_SHARE
of a shard is placed whole, largest first, and the cuts balance around it; only a group above a shard is dealt
out by doc_id, as one shard could not hold it.  Only histograms (bounded by shards x dimensions x 1024) and the
groups placed whole (at most shards / GROUP_SHARE, and texts longer than a shard) reach the driver.

Defined cases: null text counts as empty (16 bytes); null source, lang or doc_id are values of their own;
rows that repeat a doc_id each get a slot; fewer groups than shards leave shards empty; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

N_SHARDS, GROUP_SHARE, TOLERANCE, BITS, STEP, BLOCK_ROWS = 40, 0.1, 0.005, 20, 10, 1000
#: Metadata dimensions: BITS bits of the metadata, then BITS bits of a text hash that only part ties.
DIMS = ("x_source", "x_lang", "x_size")


def scaled(hashed: Column) -> Column:
    """A hash as an integer of BITS bits."""
    return F.shiftrightunsigned(hashed, 64 - BITS).cast("int")


def document_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second"), text).alias("k2"),
        F.coalesce("source", F.lit("")).alias("source") if "source" in docs.columns else F.lit("").alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang") if "lang" in docs.columns else F.lit("").alias("lang"),
    )


def with_parts(rows: DataFrame, target: float) -> DataFrame:
    """Rows with source and lang of their group and a part number: 0, or dealt by doc_id in a group above a shard.

    Groups above GROUP_SHARE of a shard, of which there are at most shards / GROUP_SHARE, are broadcast; their rows
    get a key of their own each in the join with all other groups, so a hot text's rows stay spread.
    """
    keys, own = ["k1", "k2"], ["source", "lang", "parts"]
    groups = rows.groupBy(*keys).agg(F.sum("size").alias("w"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    fine = F.ceil(F.col("w") / F.lit(max(1.0, GROUP_SHARE * target))).cast("int")
    groups = stored(groups.withColumn("parts", F.when(F.col("w") > max(1.0, target), fine).otherwise(1)), "shard-groups")
    hot, cold = F.col("w") > GROUP_SHARE * target, F.col("w") <= GROUP_SHARE * target
    bare = rows.drop("source", "lang").join(F.broadcast(groups.where(hot).select(*keys, F.struct(*own).alias("_hot"))), keys, "left")
    bare = bare.withColumn("_k", F.when(F.col("_hot").isNull(), F.col("k2")).otherwise(F.xxhash64("doc_id", "k2")))
    light = groups.where(cold).select("k1", F.col("k2").alias("_k"), F.struct(*own).alias("_cold"))
    joined = bare.join(light, ["k1", "_k"], "left").withColumn("_g", F.coalesce("_hot", "_cold"))
    part = F.pmod(F.xxhash64("doc_id"), "_g.parts").cast("int")
    return joined.select("doc_id", "size", "text_crc32", *keys, "_g.source", "_g.lang", part.alias("part"), (F.col("_g.parts") > 1).alias("split"))


def coordinates() -> list[Column]:
    """The place of a row of a group, the same for all of them as their texts are equal."""
    size = F.least(F.lit(1.0), F.log2(F.col("size").cast("double")) / 40) * ((1 << BITS) - 1)
    order = {"x_source": scaled(F.xxhash64("source")), "x_lang": scaled(F.xxhash64("lang")), "x_size": size}
    tie = lambda d: scaled(F.xxhash64("k1", "k2", "part", F.lit(d)))
    return [(F.shiftleft(order[d].cast("long"), BITS) + tie(d)).alias(d) for d in DIMS]


def points_of(parted: DataFrame) -> DataFrame:
    """(k1, k2, part, split, w, coordinates): one row for each group of equal texts, or each part of a heavy one."""
    of_group = [F.first(c).alias(c) for c in ("source", "lang", "split")]
    points = parted.groupBy("k1", "k2", "part").agg(F.sum("size").cast("double").alias("w"), F.max("size").alias("size"), *of_group)
    return points.select("k1", "k2", "part", "split", "w", *coordinates())


class Node:
    def __init__(self, first: int, leaves: int):
        self.first, self.leaves, self.cut = first, leaves, None

    def expression(self) -> Column:
        """Leaf's first shard as nested CASE over the coordinates."""
        if not self.cut:
            return F.lit(self.first)
        dim, value, left, right = self.cut
        return F.when(F.col(dim) <= value, left.expression()).otherwise(right.expression())

    def open(self) -> list[Node]:
        if self.cut:
            return self.cut[2].open() + self.cut[3].open()
        return [self] if self.leaves > 1 else []


def grow(points: DataFrame, room: list[float]) -> Node:
    """Split level by level until every leaf is one shard; weights go to leaves in proportion to their room."""
    root = Node(0, len(room))
    stuck: set[int] = set()
    while nodes := {n.first: n for n in root.open() if n.first not in stuck}:
        at = points.select(root.expression().alias("node"), "w", *DIMS).where(F.col("node").isin(list(nodes)))
        extent = {r["node"]: r for r in at.groupBy("node").agg(F.sum("w").alias("w"), *(F.min(d).alias(f"lo_{d}") for d in DIMS), *(F.max(d).alias(f"hi_{d}") for d in DIMS)).collect()}
        stuck |= {k for k in nodes if k not in extent or all(extent[k][f"lo_{d}"] == extent[k][f"hi_{d}"] for d in DIMS)}
        long = at.select("node", "w", F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(d).alias("x")) for i, d in enumerate(DIMS)))).alias("c")).select("node", "w", "c.dim", "c.x")
        goal, options, prefix, below = {}, {}, {}, {}
        for k in set(nodes) & set(extent):
            own = room[k : k + nodes[k].leaves]
            share = sum(own[: len(own) // 2]) / sum(own) if sum(own) else (len(own) // 2) / len(own)
            for d in range(len(DIMS)):
                goal[k, d], options[k, d], prefix[k, d], below[k, d] = extent[k]["w"] * share, [], 0, 0.0
        for low in range(2 * BITS - STEP, -1, -STEP):  # STEP bits more of the weighted quantile each time
            wanted = F.create_map(*(x for (k, d), v in prefix.items() for x in (F.lit(k * len(DIMS) + d), F.lit(v).cast("long")))) if prefix else F.create_map().cast("map<int,bigint>")
            inside = long.where(F.try_element_at(wanted, F.col("node") * len(DIMS) + F.col("dim")) == F.shiftright("x", low + STEP))
            bins: dict = {}
            for r in inside.groupBy("node", "dim", F.shiftright("x", low).alias("bin")).agg(F.sum("w").alias("w")).collect():
                bins.setdefault((r["node"], r["dim"]), {})[r["bin"]] = r["w"]
            for kd, found in bins.items():
                for x in sorted(found):
                    options[kd].append((((x << low) - 1), below[kd]))
                    if below[kd] + found[x] >= goal[kd] or x == max(found):
                        prefix[kd] = x
                        options[kd].append((((x + 1) << low) - 1, below[kd] + found[x]))
                        break
                    below[kd] += found[x]
        for k, node in nodes.items():
            if k in stuck:
                continue
            widest = sorted(range(len(DIMS)), key=lambda d: (extent[k][f"lo_{DIMS[d]}"] >> BITS) - (extent[k][f"hi_{DIMS[d]}"] >> BITS))
            best = None
            for d in widest:
                fit = [(abs(w - goal[k, d]), d, x) for x, w in options[k, d] if extent[k][f"lo_{DIMS[d]}"] <= x < extent[k][f"hi_{DIMS[d]}"]]
                if fit and (best is None or min(fit)[0] < best[0]):
                    best = min(fit)
                if best and best[0] <= TOLERANCE * extent[k]["w"] / node.leaves:
                    break
            if best is None:
                stuck.add(k)
                continue
            half = node.leaves // 2
            node.cut = (DIMS[best[1]], best[2], Node(k, half), Node(k + half, node.leaves - half))
    return root


def largest_first(groups: list, target: float, n_shards: int) -> tuple[dict, list[float]]:
    """Each whole group, largest first, to the shard with the most room; the shards' room left for the rest."""
    load, placed = [(0.0, i) for i in range(n_shards)], {}
    for g in sorted(groups, key=lambda g: (-g["w"], g["k1"], g["k2"])):
        w, i = heapq.heappop(load)
        placed[g["k1"], g["k2"]] = i
        heapq.heappush(load, (w + g["w"], i))
    return placed, [max(0.0, target - w) for w, _ in sorted(load, key=lambda x: x[1])]


def shard(docs: DataFrame, *, n_shards: int = N_SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = stored(document_rows(docs), "shard-rows")
    total, n = rows.agg(F.sum("size"), F.count("*")).head()
    target = (total or 0) / n_shards
    parted = stored(with_parts(rows, target), "shard-parts")
    points = stored(points_of(parted), "shard-points")
    heavy = (F.col("w") > GROUP_SHARE * target) & ~F.col("split")
    whole, room = largest_first(points.where(heavy).select("k1", "k2", "w").collect(), target, n_shards)  # at most n_shards / GROUP_SHARE groups
    at = F.broadcast(points.sparkSession.createDataFrame([(*k, i) for k, i in whole.items()], "k1 long, k2 long, _at int"))
    tree = grow(stored(points.join(at, ["k1", "k2"], "left_anti"), "shard-rest"), room).expression()
    placed = parted.select("*", *coordinates()).join(at, ["k1", "k2"], "left")
    dealt = stored(placed.select("doc_id", "size", "text_crc32", F.coalesce("_at", tree).cast("int").alias("shard")), "shard-dealt")
    blocked = dealt.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n // (n_shards * BLOCK_ROWS) + 1)))
    counts = blocked.groupBy("shard", "_b").agg(F.count("*").alias("_n"))  # one row for about BLOCK_ROWS rows
    starts = counts.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_from"))
    own = Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size")
    numbered = blocked.withColumn("_r", F.row_number().over(own) - 1).join(starts, ["shard", "_b"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_from") + F.col("_r")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return shard(table(spark, sf_dir, "documents"))
