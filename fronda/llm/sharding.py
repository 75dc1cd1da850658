"""K-d tree sharding (operator 9), DataFrame functions only.

Points are groups of equal texts, weighted by their bytes (UTF-8 length plus 8
a row); a group heavier than `1 / hot` of a shard is cut into pieces by doc_id
hash.  A node is split along its widest metadata dimension (weighted standard
deviation of log size, source and language, each scaled to [0, 1)) at the
weighted median, or the weighted quantile for an uneven number of leaves.  The
quantile is found exactly to 33 bits by three histogram passes of 2,048 bins for
all nodes of a level at once; the first pass also brings the moments of all
dimensions.  Only histograms reach the driver (2,048 rows a node, three times
that in the first pass, and a tree has fewer than 2 * shards nodes), and no node
is ever gathered into one task.  Low bits of a coordinate are a hash of the text,
which breaks ties between equal metadata.

Law kept: `bytes`.  Equal texts share a shard unless their group was cut.

Edge cases: a null or empty text weighs 8 bytes; null source or language is a
value of its own; null doc_ids hash alike; repeated rows each get their own
slot; ties of a dimension's spread go to the first dimension; extra columns are
ignored; an empty table gives no rows; with fewer points than shards some shards
stay empty; of a very long text only its length and hashes are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fronda.llm.common import Scratch

SHARDS = 24
HOT = 8
BITS = 33
RADIX = 11
SUB_ROWS = 50_000  # rows of a shard whose slots are numbered by one task, about
DIMS = ("by_size", "by_source", "by_lang")


def _coordinate(value: Column, tie: Column) -> Column:
    """20 bits of a value in [0, 1), then 13 bits of the tie-break hash."""
    return (F.floor(value * (1 << 20)).cast("long") * (1 << 13)) + F.pmod(tie, F.lit(1 << 13))


def _unit(name: str) -> Column:
    """A place in [0, 1) for a value that has no order of its own; equal values share it."""
    return F.pmod(F.xxhash64(F.col(name).isNull(), F.coalesce(F.col(name), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)


def _at(values: dict[int, int | float | None], level: int, node: Column, kind: str) -> Column:
    """The value of each row's node, all of one level, from a constant array; null for nodes without one."""
    size = 1 << level
    table = F.array(*[F.lit(values.get(size + i)).cast(kind) for i in range(size)])
    return F.get(table, node - size)


def _key(dim: Column) -> Column:
    return F.when(dim == 0, F.col(DIMS[0])).when(dim == 1, F.col(DIMS[1])).otherwise(F.col(DIMS[2]))


def _split(points: DataFrame, rules: dict[int, tuple[int, int]], level: int) -> DataFrame:
    """`points` with every node of a level that has a rule (dimension, last key to go left) split in two."""
    deep = F.col("node") >= 1 << level  # others are leaves of a level above
    ruled = points.withColumn("dim", F.when(deep, _at({k: r[0] for k, r in rules.items()}, level, F.col("node"), "int"))).withColumn("last", F.when(deep, _at({k: r[1] for k, r in rules.items()}, level, F.col("node"), "long")))
    return ruled.withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).otherwise(2 * F.col("node") + (_key(F.col("dim")) > F.col("last")).cast("long"))).drop("dim", "last")


def _quantile(bins: list[tuple[int, float]], gone: float, want: float, last: bool) -> tuple[int | None, float]:
    """The bin that holds the quantile, or in the last pass the first item that belongs to the right, and the weight before it; None if none does."""
    for b, w in sorted(bins):
        if gone + (w / 2 if last else w) > want:
            return b, gone
        gone += w
    return None, gone


def kd_tree(points: DataFrame, shards: int, scratch: Scratch) -> tuple[DataFrame, dict[int, int], int]:
    """`points` (size, *DIMS, ...) with the leaf `node` of each, the shard of each leaf, and the number of levels.

    The nodes of a level are written with the points, so a plan holds one level only.
    """
    leaves, n, first = {1: shards}, 0, {1: 0}
    whole = points.withColumn("node", F.lit(1).cast("long"))
    while any(m > 1 for m in leaves.values()):
        todo = [k for k, m in leaves.items() if m > 1]
        at = whole.select("node", F.col("size").alias("weight"), *DIMS).filter(F.col("node").isin(todo))
        x = F.col("d.key") / float(1 << BITS)
        each = at.select("node", "weight", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(d).alias("key")) for i, d in enumerate(DIMS)])).alias("d"))
        top = each.groupBy("node", F.col("d.dim").alias("dim"), F.shiftright("d.key", BITS - RADIX).alias("bin"))
        bins: dict[tuple[int, int], list] = {}
        for r in top.agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * x).alias("m1"), F.sum(F.col("weight") * x * x).alias("m2")).collect():
            bins.setdefault((r["node"], r["dim"]), []).append(r)
        dim, want, low, gone = {}, {}, dict.fromkeys(todo, 0), dict.fromkeys(todo, 0.0)
        for k in todo:
            spread = []
            for i in range(len(DIMS)):
                own = bins.get((k, i), [])
                w, m1, m2 = (sum(r[c] for r in sorted(own, key=lambda r: r["bin"])) for c in ("w", "m1", "m2"))
                spread.append(max(0.0, m2 / w - (m1 / w) ** 2) if w else 0.0)
                want[k] = w * (leaves[k] // 2) / leaves[k]
            dim[k] = max(range(len(DIMS)), key=lambda i: (spread[i], -i))
        found = {k: [(r["bin"], r["w"]) for r in bins.get((k, dim[k]), [])] for k in todo}
        for shift in range(BITS - RADIX, -1, -RADIX):
            if shift < BITS - RADIX:
                node = F.col("node")
                keyed = at.withColumn("key", _key(_at(dim, n, node, "int"))).filter(F.shiftright("key", shift + RADIX) == F.shiftright(_at(low, n, node, "long"), shift + RADIX))
                found = {k: [] for k in todo}
                for r in keyed.groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("weight").alias("w")).collect():
                    found[r["node"]].append((r["bin"], r["w"]))
            for k in todo:
                b, gone[k] = _quantile(found[k], gone[k], want[k], shift == 0)
                if b is None:
                    b = max((i for i, _ in found[k]), default=-1) + 1
                low[k] = (b << shift) - (shift == 0)
        whole = scratch.save(_split(whole, {k: (dim[k], low[k]) for k in todo}, n), f"level{n}")
        scratch.drop(f"level{n - 1}")
        n += 1
        for k in todo:
            m = leaves.pop(k)
            leaves |= {2 * k: m // 2, 2 * k + 1: m - m // 2}
            first |= {2 * k: first[k], 2 * k + 1: first[k] + m // 2}
    return whole, {k: first[k] for k in leaves}, n


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Every row's size, text checksum, shard and gapless slot; shards: a number, or as many as `target_bytes` asks for."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"),
        ),
        "rows",
    )
    group = ["text_hash", "text_crc32", "size"]
    groups = rows.groupBy(*group).agg(F.sum("size").alias("bytes"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    shards = shards or max(1, -(-total // (target_bytes or total or 1)))
    most = max(1, total // (shards * HOT))
    groups = groups.withColumn("pieces", F.when(F.col("bytes") > F.lit(2) * F.col("size") - 1, F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(most)))).otherwise(F.lit(1)).cast("long"))
    # written first, so that both sides of the join are plain exchanges and a hot group's rows can be split
    groups = scratch.save(groups.drop("bytes"), "groups")
    joined = rows.select("doc_id", *group).join(groups, group)
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.col("pieces"))).otherwise(F.lit(0))
    tie = F.xxhash64("text_hash", "piece")
    placed = scratch.save(
        joined.withColumn("piece", piece).select(
            "doc_id",
            "size",
            "text_crc32",
            _coordinate(F.least(F.log2(F.col("size").cast("double")) / 40, F.lit(0.999999)), tie).alias("by_size"),
            _coordinate(_unit("source"), tie).alias("by_source"),
            _coordinate(_unit("lang"), tie).alias("by_lang"),
        ),
        "placed",
    )
    whole, shard_of, n_levels = kd_tree(placed, shards, scratch)
    scratch.drop("rows", "groups", *(["placed"] if n_levels else []))
    subs = max(1, -(-n_rows // (shards * SUB_ROWS)))
    sub = F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32"), F.lit(subs)).alias("sub")
    top = 1 << n_levels
    # a leaf's number by its place on the last level; leaves above it stand for all places below them
    table = {}
    for k, number in shard_of.items():
        deep = n_levels + 1 - k.bit_length()
        table |= dict.fromkeys(range(k << deep, (k + 1) << deep), number)
    leaf = F.col("node")
    for n in range(n_levels):
        leaf = F.when((F.col("node") >= 1 << n) & (F.col("node") < 2 << n), F.shiftleft("node", n_levels - n)).otherwise(leaf)
    numbered = whole.withColumn("leaf", leaf)
    out = numbered.select("doc_id", "size", "text_crc32", F.get(F.array(*[F.lit(table[top + i]) for i in range(top)]), F.col("leaf") - top).cast("int").alias("shard"), sub)
    # slots: a small table of first slots (a row a sub-bucket), then a rank within each sub-bucket
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    firsts = out.groupBy("shard", "sub").count().select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size"))
    return out.withColumn("rank", rank).join(F.broadcast(firsts), ["shard", "sub"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return kd_shards(docs, SHARDS).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
