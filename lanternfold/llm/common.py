"""Helpers that the corpus operators share: tables, the shared folder, bounded broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many narrow rows may be broadcast; beyond it every caller shuffles.
BROADCAST_ROWS = 200_000
#: Rows and bytes of an Arrow batch, and rows whose results a Python worker holds at once: bounds of memory, not of results.
BATCH_ROWS, BATCH_BYTES, PIECE_ROWS = 1_000, 2 << 20, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, opened by Spark's reader alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    A session without that setting gets a folder of its own under the warehouse, which is shared as well.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lanternfold"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lanternfold/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: this cuts the lineage, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a materialised narrow table, with a broadcast hint where its counted size allows one, else left to a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def quoted(name: str) -> Column:
    """The column of that name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names with underscores, as many as keep them apart from the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def batches_bounded(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, as a batch of whole texts can be as large as its longest."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def with_results(docs: DataFrame, text: Column, dropped: Iterable[str], results: list[tuple[str, str]], worker: Callable[[], Callable[[list[str]], list[pa.Array]]]) -> DataFrame:
    """``docs`` without ``dropped`` and columns of the results' names, and with the results that a worker makes of each text.

    ``results``: names and types; ``worker`` is called once for each task. Other columns pass through untouched; inside they
    go by their place, so their names can be anything.
    """
    gone = {x.lower() for x in (*dropped, *(name for name, _ in results))}
    kept = [c for c in docs.columns if c.lower() not in gone]
    inner = [f"c{i}" for i in range(len(kept))]
    names = [*inner, *(f"r{i}" for i in range(len(results)))]
    schema = ", ".join([f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(inner, kept, strict=True)] + [f"r{i} {kind}" for i, (_, kind) in enumerate(results)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = worker()
        for batch in batches:
            for i in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(i, PIECE_ROWS)
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], *make(piece.column(len(kept)).to_pylist())], names)

    batches_bounded(docs.sparkSession)
    made = docs.select(*[quoted(c).alias(n) for n, c in zip(inner, kept, strict=True)], text.alias("t")).mapInArrow(run, schema)
    return made.toDF(*kept, *(name for name, _ in results))


def whole_text(text: Column) -> Column:
    """A null text is an empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def utf8_sha256(text: Column) -> Column:
    """SHA-256 of a string's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def drop_ids(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the ids in ``dropped`` (materialised, distinct). Ids that are null stay."""
    (name,) = fresh(docs, "gone")
    gone = small_or_shuffled(dropped.select(quoted(id_col).alias(name)))
    return docs.join(gone, quoted(id_col) == F.col(name), "left_anti")
