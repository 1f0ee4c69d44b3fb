"""Exact duplicates by progressive refinement.

Rows are grouped by the length of their normalised text and a hash of its first characters; both come from one
narrow scan and one pre-aggregated shuffle. Only rows whose (length, prefix hash) some other row shares get their
full content hashed, and only those meet in groups of equal full hashes. A caller that reports the hash of every row
gets it from the first scan; the refinement then decides which hashes meet.

Defined results: a null text is an empty one; empty texts equal each other; of rows that repeat the same id and text
one is kept; null ids sort last; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfold.llm.common import fresh, materialise, quoted, small_or_shuffled, utf8_sha256, whole_text

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """Each run of white space (space, \\t to \\r) becomes one space. A run that is one space already is not matched."""
    return F.regexp_replace(whole_text(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, keep_unique: bool = True) -> DataFrame:
    """One materialised row per document: rid, id, sha (full hash, null where the length or prefix is unique; without
    ``keep_unique`` such rows are left out) and, if ``digest_all``, digest (the hash of every row, for callers that report it)."""
    norm = docs.select(quoted(id_col).alias("id"), normalised(quoted(text_col)).alias("norm"))
    full = utf8_sha256(F.col("norm"))
    levels = norm.select(F.monotonically_increasing_id().alias("rid"), "id", "norm", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"))
    if digest_all:
        levels = materialise(levels.select("rid", "id", "len", "prefix", full.alias("digest")), "dedup-levels")
        full = F.col("digest")
    shared = materialise(levels.groupBy("len", "prefix").count().where("count > 1").select("len", "prefix", F.lit(True).alias("shared")), "dedup-shared")
    # beyond a broadcast, full contents are read by a join of the rows themselves
    found = levels.join(small_or_shuffled(shared), ["len", "prefix"], "left" if keep_unique else "inner")
    sha = F.when(F.col("shared"), full).alias("sha")
    return materialise(found.select("rid", "id", sha, *(["digest"] if digest_all else [])), "dedup-rows")


def groups(rows: DataFrame) -> DataFrame:
    """Per full hash that two or more rows share: the row that stays and the size."""
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))
    first = rows.where("sha is not null").groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1")
    return first.select("sha", F.col("first.id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept (and digest)."""
    rows = refine(docs, id_col, text_col, digest_all)
    extra = ["digest"] if digest_all else []
    alone = rows.where("sha is null").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *extra)
    one = F.col("size").isNull()
    met = rows.where("sha is not null").join(groups(rows), "sha", "left").select(
        "id", F.when(one, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(True)).alias("kept"), *extra,
    )
    return alone.unionByName(met)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are. Only rows with the id of a dropped row are hashed again."""
    rows = refine(docs, id_col, text_col, keep_unique=False)
    met = rows.join(groups(rows), "sha").where("rid <> keep_rid")
    gone = materialise(met.select("id", "sha", F.col("id").eqNullSafe(F.col("keep_id")).alias("again")).distinct(), "dedup-gone")
    if gone.isEmpty():
        return docs
    hit, sha, gid, gsha = fresh(docs, "hit", "sha", "gid", "gsha")
    ids = gone.select(F.col("id").alias(gid)).distinct().withColumn(hit, F.lit(True))
    keyed = docs.join(small_or_shuffled(materialise(ids, "dedup-ids")), quoted(id_col).eqNullSafe(F.col(gid)), "left")
    keyed = keyed.withColumn(sha, F.when(F.col(hit), utf8_sha256(normalised(quoted(text_col))))).drop(gid, hit)

    def side(rows: DataFrame) -> tuple[DataFrame, Column]:
        on = quoted(id_col).eqNullSafe(F.col(gid)) & (F.col(sha) == F.col(gsha))
        return small_or_shuffled(rows.select(F.col("id").alias(gid), F.col("sha").alias(gsha))), on

    kept = keyed.join(*side(gone.where("not again")), "left_anti")
    again = gone.where("again")
    if not again.isEmpty():  # rows that repeat id and text: one stays
        table, on = side(again)
        kept = kept.join(table, on, "left_anti").unionByName(kept.join(table, on, "left_semi").dropDuplicates([id_col, sha]))
    return kept.drop(sha)
