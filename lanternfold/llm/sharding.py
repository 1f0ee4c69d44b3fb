"""Shards along a Hilbert curve over quantised metadata, in DataFrame operations only.

Each metadata dimension is quantised to ``2**BITS`` levels; a row's cell has a place on a Hilbert curve through the
grid. Rows sorted by that place are cut in runs, so a shard covers few levels of every dimension and a reader can skip
files by the shards' ranges. The curve is a table of ``2**(BITS * dimensions)`` cells, a size fixed by parameters.

Law ``rows``: row counts of shards differ by one at most. The exact place of a row is (rows in earlier cells) + (rows in
earlier sub-cells of its cell) + (its rank in the sub-cell). A sub-cell is a hash of the id, so that a cell with a third
of all rows is ranked by many tasks; the prefix sums run over counts, whose number is bounded by the grid.

Defined results: a null text has no bytes; null metadata is a level like any other; rows that repeat an id get slots of
their own; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfold.llm.common import materialise, quoted, whole_text

BITS = 5
SUBCELLS = 256


def hilbert_curve(spark: SparkSession, dims: int, bits: int = BITS) -> DataFrame:
    """All cells of a grid with their place on the Hilbert curve: d0, d1, ..., place.

    The axes-to-transpose form of the curve: undo excess work from the highest bit down, Gray-encode, interleave.
    """
    cells = spark.range(1 << (bits * dims), numPartitions=1)
    cells = cells.select(*[((F.shiftright("id", bits * k)) % (1 << bits)).cast("int").alias(f"d{k}") for k in range(dims)])
    cells = cells.select("*", *[F.col(f"d{k}").alias(f"x{k}") for k in range(dims)])
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(dims):
            x0, xk, on = F.col("x0"), F.col(f"x{k}"), (F.col(f"x{k}").bitwiseAND(1 << bit)) != 0
            swap = x0.bitwiseXOR(xk).bitwiseAND(low)
            new = {"x0": F.when(on, x0.bitwiseXOR(F.lit(low))).otherwise(x0.bitwiseXOR(swap))}
            if k:
                new[f"x{k}"] = F.when(on, xk).otherwise(xk.bitwiseXOR(swap))
            cells = cells.withColumns(new)
    for k in range(1, dims):
        cells = cells.withColumn(f"x{k}", F.col(f"x{k}").bitwiseXOR(F.col(f"x{k - 1}")))
    turn: Column = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        turn = F.when((F.col(f"x{dims - 1}").bitwiseAND(1 << bit)) != 0, turn.bitwiseXOR(F.lit((1 << bit) - 1))).otherwise(turn)
        cells = cells.withColumn(f"t{bit}", turn)
        turn = F.col(f"t{bit}")
    place: Column = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for k in range(dims):
            digit = F.shiftright(F.col(f"x{k}").bitwiseXOR(turn), bit).bitwiseAND(1).cast("long")
            place = place + F.shiftleft(digit, bit * dims + (dims - 1 - k))
    return cells.select(*[f"d{k}" for k in range(dims)], place.alias("place"))


def quantised_label(label: Column, bits: int = BITS) -> Column:
    """A label's level: a stable hash of it."""
    return F.pmod(F.crc32(F.coalesce(label.cast("string"), F.lit("\0"))), F.lit(1 << bits)).cast("int")


def quantised_size(size: Column, bits: int = BITS) -> Column:
    """A size's level: half-octaves from 16 up; the last level has all larger ones."""
    return F.least(F.greatest(F.floor(2 * (F.log2(size.cast("double")) - 4)), F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_places(rows: DataFrame, dims: list[Column], key: Column) -> DataFrame:
    """``rows`` with pos, their exact place from 0 in the order (curve place, sub-cell, ``key``), and total, the row count."""
    spark = rows.sparkSession
    names = [f"d{k}" for k in range(len(dims))]
    curve = F.broadcast(hilbert_curve(spark, len(dims)))
    placed = rows.withColumns(dict(zip(names, dims, strict=True))).join(curve, names)
    placed = placed.withColumns({"sub": F.pmod(F.xxhash64(key), F.lit(SUBCELLS)).cast("int"), "key": key}).drop(*names)
    placed = materialise(placed, "shard-rows")
    counts = placed.groupBy("place", "sub").agg(F.count("*").alias("n"))
    cell = counts.groupBy("place").agg(F.sum("n").alias("n"))
    # at most 2**(BITS * dims) cells whatever the input
    ordered = Window.orderBy("place")
    cell = cell.select("place", (F.sum("n").over(ordered) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("place").orderBy("sub")
    starts = counts.withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(cell), "place")
    starts = starts.select("place", "sub", (F.col("before") + F.col("inside")).alias("start"), "total")
    rank = F.row_number().over(Window.partitionBy("place", "sub").orderBy("key")) - 1
    return placed.withColumn("rank", rank).join(starts, ["place", "sub"]).withColumn("pos", F.col("start") + F.col("rank"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", labels: tuple[str, str] = ("source", "lang")) -> DataFrame:
    """One row per document: id, size, text_crc32, place, shard, slot; shards cut the curve by the law ``rows``."""
    text = whole_text(quoted(text_col))
    rows = docs.select(quoted(id_col).alias("id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), *[quoted(x).alias(f"label{k}") for k, x in enumerate(labels)])
    dims = [quantised_size(F.col("size")), *[quantised_label(F.col(f"label{k}")) for k in range(len(labels))]]
    key = F.struct(F.col("id"), F.col("text_crc32"), F.col("size"))
    placed = hilbert_places(rows, dims, key)
    shard = F.expr(f"pos * {shards} div total")
    return placed.withColumn("shard", shard).select(
        "id", "size", "text_crc32", "place", *[F.col(f"label{k}").alias(x) for k, x in enumerate(labels)], F.col("shard").cast("int").alias("shard"), F.expr(f"pos - (shard * total + {shards - 1}) div {shards}").alias("slot")
    )


def shard_ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard the least and greatest value of each column: what a reader needs for skipping files."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
