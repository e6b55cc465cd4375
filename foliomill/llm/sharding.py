"""Sharding by vector bin packing.

Groups of equal texts are placed so that bytes, tokens and rows are balanced jointly. Groups that hold
over 1 / ``HEAVY`` of any total stand alone (at most 3 * HEAVY of them); all others are hashed into
``CELLS`` cells, whose sums Spark computes. The driver thus packs a bounded number of vectors: largest
first, each to the shard where its dot product (bytes weighing more, as their balance is promised) with
the residual capacity is highest. Groups stay whole unless one holds over half a shard's share of a total:
it is placed in pieces of about a 1 / ``PIECES`` share, since one group can be larger than a shard. Pieces are
drawn by a hash of doc_id, or dealt row by row where they would have under ``ROWS_A_PIECE`` rows: so are
groups of few long copies. Groups of under 2 * ``ROWS_A_PIECE`` rows that are large in nothing but rows stay whole.

Slots are numbered without gathering a shard in one task: rows are counted by (shard, part of the
doc_id hash), offsets are running sums of those counts, and rows are numbered inside each part.

Defined cases: null text has size 1 and is grouped with empty text; equal ids and equal rows each get
a slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

SHARDS = 8
HEAVY = 1024
CELLS = 4096
PIECES = 64
ROWS_A_PIECE = 16
WEIGHTS = (8, 1, 1)
ROWS_A_PART = 20_000


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of non-negative measures), by dot product with residual capacity."""
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1)
    left = np.full((shards, items.shape[1]), 1 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        out[i] = np.argmax(left @ (share[i] * WEIGHTS))
        left[out[i]] -= share[i]
    return out


def assign_shards(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    ws = Workspace(spark, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        (F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1).cast("long").alias("tokens"),
    )
    rows = ws.write(rows, "rows")
    measures = ("size", "tokens", "n")
    groups = ws.write(rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "groups")
    total = groups.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]).first()
    heavy = F.greatest(*[F.col(m) * HEAVY / max(total[m], 1) for m in measures]) > 1
    cell = F.pmod(F.col("group"), F.lit(CELLS))
    alone = groups.filter(heavy).select("group", *measures).collect()  # at most 3 * HEAVY
    cells = groups.filter(~heavy).groupBy(cell.alias("cell")).agg(*[F.sum(m).alias(m) for m in measures]).collect()  # at most CELLS
    parts, few = {}, set()
    for g in alone:
        shares = [g[m] / max(total[m], 1) for m in measures]
        pieces = int(np.ceil(max(shares) * PIECES)) if max(shares) > 0.5 / shards else 1
        long = max(shares[:2]) > 0.5 / shards
        parts[g["group"]] = max(1, min(g["n"] if long else g["n"] // ROWS_A_PIECE, pieces))
        if parts[g["group"]] > 1 and g["n"] < ROWS_A_PIECE * parts[g["group"]]:
            few.add(g["group"])  # under ROWS_A_PIECE * PIECES rows
    names = [(g["group"], -1, 0, 1) for g in alone if parts[g["group"]] == 1]
    items = [[g[m] for m in measures] for g in alone if parts[g["group"]] == 1]
    cut = spark.createDataFrame([(g, n, g in few) for g, n in parts.items()], "group long, pieces int, few boolean")
    met = rows.join(F.broadcast(cut), "group", "left")
    pieced = met.withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.coalesce("pieces", F.lit(1))).cast("int"))
    if few:
        own = F.row_number().over(Window.partitionBy("group").orderBy("doc_id"))
        pieced = pieced.filter(~F.coalesce("few", F.lit(False))).unionByName(met.filter("few").withColumn("piece", F.pmod(own, "pieces").cast("int")))
    split = pieced.filter("pieces > 1")
    for r in split.groupBy("group", "pieces", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect():  # at most 6 * shards groups of PIECES
        names.append((r["group"], -1, r["piece"], r["pieces"]))
        items.append([r[m] for m in measures])
    names += [(0, c["cell"], 0, 1) for c in cells]
    items += [[c[m] for m in measures] for c in cells]
    where = pack(np.array(items, float).reshape(-1, len(measures)), shards)
    big = spark.createDataFrame([(g, p, n, int(s)) for (g, c, p, n), s in zip(names, where, strict=True) if c < 0], "group long, piece int, pieces int, big_shard int")
    small = spark.createDataFrame([(c, int(s)) for (_, c, _, _), s in zip(names, where, strict=True) if c >= 0], "cell long, cell_shard int")
    placed = (
        pieced.withColumn("cell", cell)
        .join(F.broadcast(big.drop("pieces")), ["group", "piece"], "left")
        .join(F.broadcast(small), "cell", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("big_shard", "cell_shard").alias("shard"))
    )
    return number_slots(ws.write(placed, "placed"), ws, max(1, -(-total["n"] // ROWS_A_PART)))


def number_slots(placed: DataFrame, ws: Workspace, parts: int) -> DataFrame:
    """Add slot: gapless from 0 in each shard."""
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts)))
    counts = ws.write(placed.groupBy("shard", "part").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("own", own).join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("own") - 1).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(spark, docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
