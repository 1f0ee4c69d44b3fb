"""Stores: hashed vector rows, JSON records, extraction files, rank caches, corpora, audits, reports.

Stores are tables; every change is a new table (the old one without the changed keys, and the new rows), so that a write
never overwrites what it reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfold.functions.text import hash_id
from lanternfold.operators.ranking import first_of_each, ranked

RANKINGS = "struct<role_rankings_by_query: map<string, map<string, struct<doc_indices: array<long>, doc_scores: array<double>>>>>"
RANK_ROWS = "struct<rankings: array<struct<query_index: string, role_id: string, doc_indices: array<long>, doc_scores: array<double>>>>"
BARE_RANKINGS = "map<string, map<string, struct<doc_indices: array<long>, doc_scores: array<double>>>>"
COMPATIBILITY = "struct<scores_by_query: map<string, map<string, map<string, double>>>>"


def hashed(texts: DataFrame, namespace: str, text: str = "content") -> DataFrame:
    """hash_id and content of distinct texts."""
    return texts.select(hash_id(namespace, F.col(text)).alias("hash_id"), F.col(text).alias("content")).dropDuplicates(["hash_id"])


def missing(store: DataFrame, rows: DataFrame, key: str = "hash_id") -> DataFrame:
    """The rows whose key the store lacks."""
    return rows.join(store.select(key), key, "left_anti")


def inserted(store: DataFrame, rows: DataFrame, key: str = "hash_id") -> DataFrame:
    """The store with the rows that it lacks."""
    return store.unionByName(missing(store, rows.dropDuplicates([key]), key), allowMissingColumns=True)


def deleted(store: DataFrame, keys: DataFrame, key: str = "hash_id") -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")


def fetched(store: DataFrame, wanted: DataFrame, key: str = "hash_id") -> DataFrame:
    """The store's rows in the order asked for: wanted has the key and pos."""
    return wanted.join(store, key)


def upserted(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Last writer wins: the rows, and the store's other rows."""
    return rows.unionByName(store.join(rows.select(key), key, "left_anti"))


def replaced(df: DataFrame, folder: str) -> str:
    """Write a new version of a store beside the old ones and return its path."""
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return path


def record_rows(rows: DataFrame, key: str) -> DataFrame:
    """Records as the key and one JSON text."""
    return rows.select(key, F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns) if c != key])).alias("payload_json"))


def records(store: DataFrame, key: str, schema: str) -> DataFrame:
    """Typed columns of JSON records."""
    return store.select(key, F.from_json("payload_json", schema).alias("x")).select(key, "x.*")


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """An extraction file as rows: passage, entities, triples (struct s, r, o); triples that are no three atoms are left out."""
    schema = "docs array<struct<idx: string, passage: string, extracted_entities: array<string>, extracted_triples: array<array<string>>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("docs").alias("d"))
    return extraction_rows(docs.select("d.passage", F.col("d.extracted_entities").alias("entities"), F.col("d.extracted_triples").alias("triples")))


def extraction_rows(docs: DataFrame) -> DataFrame:
    """passage, entities, triples (array of arrays) with triples as structs."""
    full = F.filter("triples", lambda x: (F.size(x) == 3) & F.forall(x, lambda a: F.trim(a) != ""))
    return docs.select("passage", "entities", F.transform(full, lambda x: F.struct(x[0].alias("s"), x[1].alias("r"), x[2].alias("o"))).alias("triples"))


def extraction_statistics(docs: DataFrame) -> DataFrame:
    """Mean characters and words of the extracted entities, to four places. docs: entities (array)."""
    entities = docs.select(F.explode("entities").alias("e"))
    return entities.agg(F.round(F.avg(F.length("e")), 4).alias("avg_ent_chars"), F.round(F.avg(F.size(F.split("e", " "))), 4).alias("avg_ent_words"))


def rank_cache(texts: DataFrame, column: str = "value") -> DataFrame:
    """Role rankings from JSON texts of any of three shapes: q, role, rank, doc, score. Keys that are no numbers are left out.

    The shapes: maps under ``role_rankings_by_query``, rows under ``rankings``, bare maps.
    """
    x = F.col(column)
    rows = texts.select(F.from_json(x, RANK_ROWS)["rankings"].alias("rows"), F.coalesce(F.from_json(x, RANKINGS)["role_rankings_by_query"], F.when(~x.contains('"rankings"') & ~x.contains('"role_rankings_by_query"'), F.from_json(x, BARE_RANKINGS))).alias("maps"))
    listed = rows.select(F.explode("rows").alias("r")).select(F.col("r.query_index").alias("q"), F.col("r.role_id").alias("role"), F.col("r.doc_indices").alias("docs"), F.col("r.doc_scores").alias("scores"))
    mapped = rows.select(F.explode("maps").alias("q", "roles")).select("q", F.explode("roles").alias("role", "v")).select("q", "role", F.col("v.doc_indices").alias("docs"), F.col("v.doc_scores").alias("scores"))
    every = listed.unionByName(mapped).select(F.expr("try_cast(q as bigint)").alias("q"), "role", "docs", "scores").where("q is not null")
    return every.select("q", "role", "scores", F.posexplode("docs").alias("at", "doc")).select("q", "role", (F.col("at") + 1).cast("long").alias("rank"), "doc", F.try_element_at("scores", F.col("at") + 1).alias("score"))


def compatibility_cache(texts: DataFrame, column: str = "value") -> DataFrame:
    """Compatibility scores from JSON texts: q, role, doc, score."""
    rows = texts.select(F.explode(F.from_json(column, COMPATIBILITY)["scores_by_query"]).alias("q", "roles")).select("q", F.explode("roles").alias("role", "docs")).select("q", "role", F.explode("docs").alias("doc", "score"))
    return rows.select(F.expr("try_cast(q as bigint)").alias("q"), "role", F.expr("try_cast(doc as bigint)").alias("doc"), "score").where("q is not null and doc is not null")


def title_index(corpus: DataFrame) -> DataFrame:
    """Each normalised title's first document: title, doc. corpus: doc, title."""
    norm = F.trim(F.regexp_replace(F.lower("title"), r"\s+", " "))
    return first_of_each(corpus.select("doc", norm.alias("title")).where("title <> ''"), [], ["title"], ["doc"])


def text_index(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each text's document, and the texts that several documents share: (text, doc), (text, n)."""
    n = corpus.groupBy("text").agg(F.count("*").alias("n"), F.min("doc").alias("doc"))
    return n.where("n = 1").select("text", "doc"), n.where("n > 1").select("text", "n")


def fingerprint(config: dict) -> str:
    """sha256 of a configuration's canonical JSON."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def resumable(chunks: DataFrame, config: dict, wanted: DataFrame) -> DataFrame:
    """Finished questions of chunks with this configuration: q. chunks: q, fingerprint; wanted: q."""
    return chunks.where(F.col("fingerprint") == fingerprint(config)).join(wanted, "q", "left_semi").select("q").distinct()


def cache_key(*parts: Column) -> Column:
    """sha256 of the JSON of the parts."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their cached answers, and those still to be asked. requests: key, ...; cache: key, answer."""
    return requests.join(cache, "key"), requests.join(cache.select("key"), "key", "left_anti")


def audit(passages: DataFrame, hyperedges: DataFrame, entities: DataFrame) -> DataFrame:
    """References that point nowhere: kind, owner, missing.

    passages: passage, entity_ids, proposition_ids; hyperedges: h, participant_ids, source_ids; entities: id.
    """
    def dangling(rows: DataFrame, owner: str, refs: str, known: DataFrame, key: str, kind: str) -> DataFrame:
        each = rows.select(F.col(owner).alias("owner"), F.explode(refs).alias("missing"))
        return each.join(known.select(F.col(key).alias("missing")), "missing", "left_anti").select(F.lit(kind).alias("kind"), "owner", "missing")

    return (
        dangling(passages, "passage", "proposition_ids", hyperedges, "h", "passage_hyperedge")
        .unionByName(dangling(passages, "passage", "entity_ids", entities, "id", "passage_entity"))
        .unionByName(dangling(hyperedges, "h", "participant_ids", entities, "id", "hyperedge_entity"))
        .unionByName(dangling(hyperedges, "h", "source_ids", passages, "passage", "hyperedge_passage"))
    )


def markdown(summary: DataFrame, order: list[str]) -> str:
    """A small summary table as Markdown."""
    rows = summary.orderBy(*order).collect()
    head = summary.columns
    return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows)])


def positions(df: DataFrame, order: list) -> DataFrame:
    """Rows with their place over the whole table; for small tables of requests."""
    return ranked(df.withColumn("__all", F.lit(0)), ["__all"], order, "pos").drop("__all")
