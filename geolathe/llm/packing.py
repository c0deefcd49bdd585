"""Packing items into containers of fixed capacity with little waste, items split only if they exceed the capacity.

Planning works on the histogram of lengths, not on the items: lengths from long to short go, best fit first, into
groups of equally filled containers. The plan says which ranks within a length go to which containers; items then
take their slots by joining on their rank within their length. The histogram has at most ``capacity`` lines and the
plan a few times as many, whatever the number of items, so both may pass through the driver and be broadcast.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolathe.session import written

#: Items of one length that are ranked in one task, about.
RANKED = 500_000


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first container, items per container) for best fit, longest first.

    Items of one length are alike, so best fit fills all containers with the least sufficient room before any with
    more: a group of n containers with room r takes floor(r / length) items each. Per length at most two groups are
    split, which bounds the plan by the number of distinct lengths.
    """
    rooms: list[int] = []  # sorted rooms that some group has
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first container, number)]
    slots, opened = [], 0

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            if not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((first, number))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                number = -(-left // (capacity // length))
                room, first = capacity, opened
                opened += number
            else:
                room = rooms[at]
                first, number = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            each = room // length
            full = min(number, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            rest = number - full
            if rest and left and left < each:
                slots.append((length, rank, rank + left, first + full, each))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, rest - 1)
                rank, left = rank + left, 0
            else:
                put(room, first + full, rest)
    return slots


def pieces(items: DataFrame, id_col: str, size: Column, capacity: int) -> DataFrame:
    """Items as pieces (id, piece_no, start, length): one, or full containers and a rest where the item exceeds one.

    Items of no size (or of null size) have no piece.
    """
    df = items.select(F.col(id_col).alias("id"), size.cast("long").alias("size")).where(F.col("size") > 0)
    count = F.ceil(F.col("size") / F.lit(capacity)).cast("int")
    df = df.withColumn("piece_no", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("piece_no").cast("long") * capacity
    return df.select("id", "piece_no", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - start).cast("int").alias("length"))


def ranked(piece: DataFrame, total: int) -> DataFrame:
    """``piece`` with ``rank`` (from 0) within its length, by id; a length held by many items is ranked in buckets."""
    buckets = max(1, -(-total // RANKED))
    df = piece.withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.lit(buckets)))
    inner = Window.partitionBy("length", "bucket").orderBy("id", "piece_no")
    df = df.withColumn("nth", F.row_number().over(inner) - 1)
    if buckets == 1:
        return df.withColumn("rank", F.col("nth").cast("long")).drop("bucket", "nth")
    sizes = piece.groupBy("length", F.pmod(F.xxhash64("id", "piece_no"), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    return df.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("offset") + F.col("nth")).drop("bucket", "nth", "offset")


def packed(items: DataFrame, id_col: str, size: str, capacity: int) -> DataFrame:
    """(id, piece_no, start, n_tokens, bin) for every piece of every item with a size.

    Items of equal size are interchangeable; ids order them, so the result is the same on every run. Ids must be
    unique. An empty table packs into no containers; ``capacity`` must be positive.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    piece = pieces(items, id_col, F.col(size), capacity)
    histogram = {r["length"]: r["n"] for r in piece.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan(histogram, capacity)
    spark = items.sparkSession
    layout = spark.createDataFrame([tuple(map(int, s)) for s in slots], "length int, low bigint, high bigint, first bigint, each int")
    placed = ranked(piece, sum(histogram.values())).join(F.broadcast(layout), "length").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    container = F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))
    return placed.select(F.col("id").alias(id_col), "piece_no", F.col("start").alias("start_token"), F.col("length").alias("n_tokens"), container.cast("long").alias("bin"))


def packed_texts(docs: DataFrame, id_col: str, text: str, capacity: int, tokenizer: str) -> DataFrame:
    """``packed`` for documents, sized in tokens; texts are tokenized once."""
    from geolathe.llm.tokens import counted

    return packed(written(counted(docs, [id_col], text, tokenizer), "tokens"), id_col, "n_tokens", capacity)


def fill_report(packing: DataFrame, capacity: int) -> DataFrame:
    """One row: containers used, the least possible number, tokens, and the share of room left unused."""
    bins = packing.groupBy("bin").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    total = F.coalesce(F.sum("used"), F.lit(0))
    return bins.agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.ceil(total / capacity).cast("long").alias("least_bins"),
        total.alias("n_tokens"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("n_pieces"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
        (F.lit(1.0) - total / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )
