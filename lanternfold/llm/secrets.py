"""Secret scanning with an incremental blob ledger, in DataFrame operations only.

Every version of a text is a blob, addressed by its SHA-256 and kept once. Rules come in packs, each with a version. The
ledger knows which (blob, rule version) pairs have been scanned; a scan takes only pairs not seen before, whether the blob
or the rule version is the new one, and findings join back to all paths (ids), old and new. Blobs are kept before they
are scanned and paths are registered last, so a failure between leaves pairs that the next scan takes up.

Defined results: a null text is the blob of the empty text; an empty text has no findings; rows that repeat an id and
text give a row each; an empty table gives an empty result; a pair that was not scanned has null findings, never empty
ones; other columns are never looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold.llm.common import materialise, quoted, utf8_sha256, whole_text
from lanternfold.llm.spans import located, span_string, tagged

#: Kind and pattern of each rule, in order; hex and access state their least length in the pattern, which
#: for maximal runs is the same as dropping short ones.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}
#: Public formats of keys and tokens that the base rules do not name.
FORMAT_RULES = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}+",
    "prefixed": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)",
    "url": r"(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s/@]{1,128}@",
}
#: Rule versions: a pack whose rules change gets another name.
PACKS = {"base-1": BASE_RULES, "formats-1": FORMAT_RULES}
ASSIGN_VALUE_CHARS = 6


def secret_spans(text: Column, version: str = "base-1") -> Column:
    """All findings of a rule version in a text by start, then kind: array<struct<start, rank, end, kind, value>>."""
    by_kind = {kind: located(text, pattern) for kind, pattern in PACKS[version].items()}
    if "assign" in by_kind:
        by_kind["assign"] = F.filter(by_kind["assign"], lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= ASSIGN_VALUE_CHARS)
    return F.array_sort(F.concat(*[tagged(spans, kind, rank) for rank, (kind, spans) in enumerate(by_kind.items())]))


class BlobLedger:
    """Tables under ``path``, in a store that all executors share: blobs (blob, text), paths (run, id, blob), findings (blob, spans) by rule version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        """A table of the ledger, None before its first rows."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}") if there else None

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Keep the blobs of a batch of versions that the ledger does not have; returns the batch's paths (id, blob), not yet registered."""
        keyed = docs.select(quoted(id_col).alias("id"), whole_text(quoted(text_col)).alias("text")).withColumn("blob", utf8_sha256(F.col("text")))
        paths = materialise(keyed.select("id", "blob"), "ledger-batch")
        new = paths.groupBy("blob").agg(F.min("id").alias("rep"))
        if (kept := self._read("blobs")) is not None:
            new = new.join(kept.select("blob"), "blob", "left_anti")
        # one row of each new blob brings its text; the id in the key spreads a blob that a third of the rows share
        new = new.select(F.col("blob").alias("new_blob"), "rep")
        rows = keyed.join(new.hint("merge"), (F.col("blob") == F.col("new_blob")) & F.col("id").eqNullSafe(F.col("rep")), "left_semi")
        rows.select("blob", "text").write.mode("append").parquet(f"{self.path}/blobs")
        return paths

    def unscanned(self, version: str) -> DataFrame | None:
        """The blobs that a rule version has not seen: blob, text."""
        blobs, seen = self._read("blobs"), self._read(f"findings/{version}")
        return blobs if blobs is None or seen is None else blobs.join(seen.select("blob"), "blob", "left_anti")

    def scan_blobs(self, version: str) -> None:
        """Scan all (blob, rule version) pairs that were not, whatever run brought the blob."""
        if (todo := self.unscanned(version)) is not None:
            todo.select("blob", secret_spans(F.col("text"), version).alias("spans")).write.mode("append").parquet(f"{self.path}/findings/{version}")

    def scan(self, docs: DataFrame, version: str = "base-1", id_col: str = "doc_id", text_col: str = "text") -> int:
        """Take in a batch of versions: keep new blobs, scan unseen pairs, register the paths. Returns the run's number."""
        batch = self.add(docs, id_col, text_col)
        self.scan_blobs(version)
        known = self._read("paths")
        run = 0 if known is None else 1 + known.agg(F.max("run")).first()[0]
        batch.write.parquet(f"{self.path}/paths/run={run}")
        return run

    def findings(self, version: str) -> DataFrame:
        """What a rule version has found: blob, spans (empty for a clean blob)."""
        if (found := self._read(f"findings/{version}")) is None:
            raise ValueError(f"{version} has scanned nothing yet")
        return found

    def by_path(self, version: str = "base-1", run: int | None = None) -> DataFrame:
        """Findings of a rule version joined back to every registered path: run, id, blob, spans (null where the pair was not scanned)."""
        paths = self._read("paths")
        if paths is None:
            raise ValueError("the ledger has no paths yet")
        paths = paths if run is None else paths.where(F.col("run") == run)
        kind = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
        if (found := self._read(f"findings/{version}")) is None:
            return paths.withColumn("spans", F.lit(None).cast(kind))
        # rows that repeated id and text, and pairs of a run that was done again, are one
        found = found.groupBy("blob").agg(F.first("spans").alias("spans"))
        if self.unscanned(version).isEmpty():  # then only blobs with findings need to meet their paths
            hit = found.where(F.size("spans") > 0)
            return paths.join(hit, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(kind)))
        return paths.join(found, "blob", "left")


def secret_digest(base: DataFrame, *more: DataFrame) -> DataFrame:
    """The findings of each path as counts, a digest and a span string; ``more``: findings of other rule versions (blob, spans), whose spans follow."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    line = span_string(F.col("spans"))
    rows = base.select("id", "blob", *[count(k).alias(f"n_{k}") for k in BASE_RULES], F.sha2(line.cast("binary"), 256).alias("base_sha256"), line.alias("line"))
    lines = [F.col("line")]
    for k, other in enumerate(more):
        hit = other.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
        rows = rows.join(hit.select("blob", span_string(F.col("spans")).alias(f"line{k}")), "blob", "left")
        lines.append(F.col(f"line{k}"))
    given = reduce(lambda a, b: F.concat(a, b), [F.array(F.when(x != "", x)) for x in lines])
    return rows.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in BASE_RULES], "base_sha256", F.array_join(given, ",").alias("spans"))
