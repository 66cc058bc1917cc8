"""Sharding by sampled splitters (DataFrame functions only).

Records are ordered by (hash of the text, hash of the id). A size-weighted sample of these keys gives quantile boundaries;
the boundaries cut all records into many small ranges, ranges that turn out overfull are subdivided, and the
shards are runs of ranges with equal numbers of bytes. A record weighs its bytes and as many again as a record has on
average, so that a great many tiny texts make ranges of their own too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillgraph.runtime import Scratch

#: The least and greatest long.
LOW, HIGH = -(2**63), 2**63 - 1


def _draw(base: DataFrame, load: Column, wanted: int) -> list[tuple[int, int, int]]:
    """About ``wanted`` keys, each drawn in proportion to its part ``load`` of the whole; the hash of the key is the die."""
    share = load * F.lit(float(wanted))
    die = F.shiftrightunsigned(F.xxhash64("s", "h", F.lit(7)), 11) / F.lit(float(2**53))
    copies = F.floor(share) + F.when(die < share - F.floor(share), 1).otherwise(0)
    return [tuple(r) for r in base.select("h", "s", copies.alias("n")).where("n > 0").collect()]


def splitters(sample: list[tuple[int, int, int]], ranges: int) -> list[tuple[int, int]]:
    """Quantile boundaries of a weighted sample. A key met once starts its range; one met again is cut by its second part."""
    sample, found, seen, k = sorted(sample), [], 0, 1
    weight = sum(n for _, _, n in sample)
    for h, s, n in sample:
        seen += n
        while k < ranges and seen * ranges > k * weight:
            cut = (h, s) if found and found[-1][0] == h else (h, LOW)
            if not found or cut > found[-1]:
                found.append(cut)
            k += 1
    return found


def _range_of(cuts: list[tuple[int, int]]) -> Column:
    """How many cuts are at or below (h, s): a binary search in two constant arrays."""
    if not cuts:
        return F.lit(0)
    steps = [2**i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    hs, ss = (F.array(*map(F.lit, x)) for x in zip(*cuts))

    def step(at: Column, by: Column) -> Column:
        h, s = F.get(hs, at + by - 1), F.get(ss, at + by - 1)
        ahead = (at + by <= F.lit(len(cuts))) & ((h < F.col("h")) | ((h == F.col("h")) & (s <= F.col("s"))))
        return F.when(ahead, at + by).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def shard_by_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, per_range: int = 100_000, max_ranges: int = 16_384) -> DataFrame:
    """One row per row of ``df``: doc_id, size, text_crc32, shard, slot.

    Shards hold equal numbers of bytes to within one unit: a unit is a group of equal texts as long as it is no larger
    than a range (1/256 of all bytes and rows, or less for large tables), else a row. So copies stay together unless their group
    is itself a noticeable part of a shard. ``per_range`` rows make a range, at least 16 ranges a shard and at most
    ``max_ranges`` in all; 16 keys a range are sampled, so the driver sees 16 * max_ranges keys at most, roughly.

    Null text: no bytes, checksum 0, size 1. Null ids are ordinary values. Repeated rows are each placed. An
    empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    text, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col)
    base = scratch.keep(df.select(
        key.alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64(key, F.lit(1)).alias("s"),
    ))
    total, rows = base.agg(F.sum("size"), F.count("*")).first()
    total = total or 1
    ranges = max(16 * shards, min(max_ranges, rows // per_range))
    load = F.col("size") / F.lit(2.0 * total) + F.lit(0.5 / max(rows, 1))
    cuts = splitters(_draw(base, load, 16 * ranges), ranges)
    target = total / ranges

    # Subdivide overfull ranges: the keys are hashes, so equal steps between a range's ends even them out.
    at = base.withColumn("r", _range_of(cuts))
    full = at.groupBy("r").agg(F.sum(load).alias("load"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    full = full.select("r", "h0", "h1", "s0", "s1", F.when(F.col("load") > 2 / ranges, F.ceil(F.col("load") * ranges)).otherwise(1).alias("parts"))
    one = F.col("h0") == F.col("h1")
    x, lo, hi = (F.when(one, F.col(a)).otherwise(F.col(b)).cast("double") for a, b in (("s", "h"), ("s0", "h0"), ("s1", "h1")))
    part = F.when((F.col("parts") == 1) | (hi <= lo), 0).otherwise(F.least(F.col("parts") - 1, F.floor((x - lo) / (hi - lo) * F.col("parts"))))
    at = at.join(F.broadcast(full), "r").select("doc_id", "size", "text_crc32", "h", "s", "r", part.cast("long").alias("part"))

    order = Window.orderBy("r", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = at.groupBy("r", "part").agg(F.sum("size").alias("bytes"))
    before = before.select("r", "part", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("before"))
    here = Window.partitionBy("r", "part")
    line, copies = here.orderBy("h", "s", "doc_id", "size"), Window.partitionBy("r", "part", "h")
    at = at.withColumn("run", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(line).cast("long"))
    at = at.withColumn("group", F.sum("size").over(copies)).withColumn("start", F.min(F.col("run") - F.col("size")).over(copies))
    middle = F.when(F.col("group") <= target, F.col("start") + F.col("group") / 2).otherwise(F.col("run") - F.col("size") / 2)
    shard = F.least(F.lit(shards - 1), F.floor((F.col("before") + middle) * F.lit(float(shards)) / F.lit(float(total)))).cast("int")
    placed = scratch.keep(at.join(F.broadcast(before), ["r", "part"]).select("doc_id", "size", "text_crc32", "r", "part", "n", shard.alias("shard")))

    runs = placed.groupBy("r", "part", "shard").agg(F.min("n").alias("first"), F.count("*").alias("rows"))
    slots = Window.partitionBy("shard").orderBy("r", "part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("r", "part", "shard", "first", F.coalesce(F.sum("rows").over(slots), F.lit(0)).alias("slots"))
    return placed.join(F.broadcast(runs), ["r", "part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slots") + F.col("n") - F.col("first")).alias("slot"))
