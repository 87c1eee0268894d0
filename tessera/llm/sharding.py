"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

Points are groups of equal texts, weighted by bytes. A node is split at the weighted median along its widest dimension, until
a leaf holds the target bytes. All nodes of a level are split at once:

1. A row a node: range of each dimension, bytes, the widest dimension.
2. A histogram of BINS bins along it, and running sums over the bins of a node, give the bin of the median. Points that hold
   more than 1 / LARGE of their node are placed one by one, in their order; the others fill what is missing on either side,
   so that a large group stays whole and the sides still come out even.
3. Points in the bin of the median are told apart by HASHES bins of their hash (a hot source is one such tie).

Tables with a row a node and bins a node are written and joined back; the driver sees one row of totals. A window holds the
bins and the large points of one node: at most BINS + LARGE rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, shuffle_partitions

BINS, HASHES, LARGE = 1024, 4096, 200
#: Pieces a shard into which a group that is larger than a shard is dealt.
PIECES = 50
#: Rows that share a counter while slots are numbered.
SLOT_ROWS = 50_000

NODE = ["first", "n"]


def _ordinal(c: Column, prefix: int) -> Column:
    """A number that orders strings by the six bytes after a prefix that all share."""
    six = F.substring(F.encode(F.coalesce(c.cast("string"), F.lit("")), "utf-8"), prefix + 1, 6)
    return F.coalesce(F.conv(F.rpad(F.hex(six), 12, "0"), 16, 10).cast("double"), F.lit(0.0))


def _common_prefix(low: str | None, high: str | None) -> int:
    """Bytes that the smallest and the largest string, and so all between, begin with."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _level(points: DataFrame, dims: list[str], scratch: Scratch) -> DataFrame:
    """Points with their nodes split once; nodes of one leaf stay."""
    ranges = points.where("n > 1").groupBy(*NODE).agg(
        F.sum("weight").alias("w"), *[f(d).alias(f"{k}{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]
    )
    widths = F.array(*[F.col(f"hi{d}") - F.col(f"lo{d}") for d in dims])
    k = (F.array_position(widths, F.array_max(widths)) - 1).cast("int")
    goal = F.floor(F.col("w").cast("double") * F.expr("n div 2") / F.col("n"))
    plan = scratch.save(
        ranges.withColumn("k", k).select(
            *NODE,
            "w",
            "k",
            goal.alias("goal"),
            F.array(*[F.col(f"lo{d}") for d in dims])[F.col("k")].alias("lo"),
            widths[F.col("k")].alias("width"),
        ),
        "plan",
    )

    x = F.array(*map(F.col, dims))[F.col("k")]
    at = F.when(F.col("width") > 0, F.least(F.lit(BINS - 1), F.floor((x - F.col("lo")) / F.col("width") * BINS).cast("int"))).otherwise(0)
    binned = points.join(plan, NODE, "left").withColumn("at", at).withColumn("large", F.col("weight") * LARGE > F.col("w"))

    # The median's bin, and the large points left of it.
    own = F.col("large")
    events = binned.where("n > 1").groupBy(
        *NODE, "goal", "w", "at", F.when(own, F.col("hash")).alias("hash"), F.when(own, F.col("id")).alias("id")
    ).agg(F.sum("weight").alias("v"))
    ordered = Window.partitionBy(*NODE).orderBy(
        "at", F.col("hash").asc_nulls_first(), F.col("id").asc_nulls_first()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*NODE)
    one, few = F.when(F.col("id").isNotNull(), F.col("v")).otherwise(0), F.when(F.col("id").isNull(), F.col("v")).otherwise(0)
    sums = events.withColumns(
        {
            "sum": F.sum("v").over(ordered),
            "ones": F.sum(one).over(ordered),
            "fews": F.sum(few).over(ordered),
            "all_ones": F.sum(one).over(whole),
        }
    )
    # Left of the median by its middle, or because the right side can't hold it; as long as the left side can.
    needed = (2 * F.col("sum") - F.col("v") <= 2 * F.col("goal")) | (
        F.col("all_ones") - F.col("ones") + F.col("v") > F.col("w") - F.col("goal")
    )
    left = F.col("id").isNotNull() & needed & (F.col("ones") <= F.col("goal"))
    sides = sums.withColumn("left", left).withColumn(
        "rest", F.greatest(F.lit(0), F.col("goal") - F.sum(F.when(F.col("left"), F.col("v")).otherwise(0)).over(whole))
    )
    beyond = F.when(
        F.col("id").isNull() & (F.col("fews") > F.col("rest")), F.struct("at", (F.col("rest") - F.col("fews") + F.col("v")).alias("open"))
    )
    cuts = sides.groupBy(*NODE).agg(F.min(beyond).alias("cut"), F.collect_list(F.when(F.col("left"), F.col("id"))).alias("lefts"))
    cuts = scratch.save(cuts.select(*NODE, F.col("cut.at").alias("cut"), F.col("cut.open").alias("open"), "lefts"), "cuts")

    # Inside that bin, by hash.
    cells = binned.where("n > 1 and not large").join(cuts, NODE).where("at = cut").groupBy(*NODE, "open", "hash").agg(
        F.sum("weight").alias("v")
    )
    running = F.sum("v").over(Window.partitionBy(*NODE).orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = cells.withColumn("sum", running).where(
        2 * F.col("sum") - F.col("v") <= 2 * F.col("open")
    ).groupBy(*NODE).agg(F.max("hash").alias("last"))
    cuts = scratch.save(cuts.join(inside, NODE, "left"), "cuts")

    small = (F.col("at") > F.col("cut")) | ((F.col("at") == F.col("cut")) & (F.col("hash") > F.coalesce("last", F.lit(-1))))
    right = F.coalesce(F.when(F.col("large"), ~F.array_contains("lefts", F.col("id"))).otherwise(small), F.lit(False))
    half = F.expr("n div 2")
    moved = binned.join(cuts, NODE, "left").withColumn("right", right).select(
        *[c for c in points.columns if c not in NODE],
        F.when((F.col("n") > 1) & F.col("right"), F.col("first") + half).otherwise(F.col("first")).cast("int").alias("first"),
        F.when(F.col("n") == 1, F.lit(1)).when(F.col("right"), F.col("n") - half).otherwise(half).cast("int").alias("n"),
    )
    return scratch.save(moved, "points")


def kd_split(points: DataFrame, leaves: int, dims: list[str], scratch: Scratch) -> DataFrame:
    """Adds ``shard`` (0 .. leaves - 1): points need id and weight (long), the dimensions, and hash (0 .. HASHES - 1)."""
    ends = points.agg(*[f(d).cast("double").alias(f"{k}{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]).first()
    # Dimensions count in parts of their range over all points.
    unit = {
        d: F.lit(0.0)
        if ends[f"lo{d}"] in (None, ends[f"hi{d}"]) else (F.col(d) - F.lit(ends[f"lo{d}"])) / F.lit(ends[f"hi{d}"] - ends[f"lo{d}"])
        for d in dims
    }
    now = points.withColumns(unit | {"first": F.lit(0), "n": F.lit(leaves)})
    for _ in range((leaves - 1).bit_length()):
        now = _level(now, dims, scratch)
    return now.drop("n").withColumnRenamed("first", "shard")


def text_points(rows: DataFrame, leaves: int, total: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows with piece, points): a point is all rows of one text, or a piece of a text whose rows outweigh a shard."""
    # At most as many texts as shards; written, so that its size is known when the join is planned.
    share = max(1.0, total / leaves)
    large = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > share).select(
        "key", F.ceil(F.col("bytes") * PIECES / share).alias("pieces")
    )
    dealt = rows.join(scratch.save(large, "large"), "key", "left")
    dealt = dealt.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    points = dealt.groupBy("key", "piece").agg(
        F.sum("size").alias("weight"), F.min("d0").alias("x0"), F.min("d1").alias("x1"), F.max("d2").alias("x2")
    )
    points = points.withColumn("id", F.xxhash64("key", "piece")).withColumn("hash", F.pmod("id", F.lit(HASHES)).cast("int"))
    return dealt, scratch.save(points, "points")


def kd_shards(
    docs: DataFrame,
    *,
    shards: int | None = None,
    target_bytes: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    categories: tuple[str, str] = ("source", "lang"),
) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``shards`` leaves of near equal bytes, or as many as ``target_bytes`` needs. Dimensions: both categories and the
    logarithm of the size. A size is the UTF-8 bytes of the text plus 1, so a null text weighs 1 (its crc32 is that of no
    bytes, 0). Equal texts share a shard, unless all together they outweigh a shard of mean size: then they are dealt in
    pieces of a PIECES-th of a shard. Shards differ by what no cut can even out: large groups that don't add up.
    Slots number the rows of a shard from 0 without gaps, by doc_id inside runs of hashed rows. Null doc_ids and repeated
    rows get slots of their own; null categories sort first. An empty table gives an empty table. Other columns of the
    input play no part.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    body, names = F.coalesce(F.col(text), F.lit("")), [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categories]
    ends = docs.agg(*[f(c) for c in names for f in (F.min, F.max)]).first()
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.xxhash64(body)).alias("key"),
        *[_ordinal(c, _common_prefix(*ends[2 * i : 2 * i + 2])).alias(f"d{i}") for i, c in enumerate(names)],
        F.log2(F.octet_length(body) + 1.0).alias("d2"),
    )
    rows = scratch.save(rows, "rows")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    leaves = shards or max(1, -(-total // target_bytes))
    dealt, points = text_points(rows, leaves, total, scratch)
    leaf = kd_split(points, leaves, ["x0", "x1", "x2"], scratch).select("key", "piece", "shard")
    dealt = scratch.save(dealt.join(leaf, ["key", "piece"]).select("doc_id", "size", "text_crc32", "shard"), "sharded")

    runs = max(1, shuffle_partitions(spark), -(-n // SLOT_ROWS))
    in_run = dealt.select("*", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).alias("run"))
    counts = in_run.groupBy("shard", "run").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    firsts = scratch.save(counts.select("shard", "run", F.coalesce(before, F.lit(0)).alias("start")), "firsts")
    rank = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size"))
    out = in_run.withColumn("rank", rank).join(firsts, ["shard", "run"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
