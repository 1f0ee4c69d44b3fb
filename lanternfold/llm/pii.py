"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame operations only.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. They are the protected entities. The
corpus then says which other terms give an entity away: for a term t (any word) in the texts that mention entity e, the
pointwise mutual information PMI(e; t) = log(n_et * N / (n_e * n_t)) is compared with the information content
IC(e) = log(N / n_e) of the entity. PMI / IC is 1 if t never occurs without e. Terms with a ratio of ``alpha`` or more,
seen with e in at least ``min_support`` different texts, disclose e: they become spans of kind ``term`` wherever they
occur, and the sanitised text generalises each span to its kind. Counts cover all documents; n_et and n_e count
different texts, so copies are no evidence.

Defined results: a null text is an empty one; empty texts have no spans; rows that repeat an id and text give a row
each; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfold.llm.common import materialise, quoted, small_or_shuffled, whole_text
from lanternfold.llm.spans import located, span_string, tagged

#: Kinds in order, and their patterns. Possessive runs and the guard on what stands before a match do not
#: change the leftmost matches; they keep the search linear in long runs of one class.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: A term: a word of letters.
TERM = r"(?<![\p{L}\p{N}])(\p{L}++)(?!\p{N})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(value)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(value, i, F.lit(1)).cast("int")
        twice = F.when(digit >= 5, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(digit)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def _ip_parts_fit(value: Column) -> Column:
    # leading zeros do not change a part's value
    return F.forall(F.split(value, r"\."), lambda x: F.regexp_extract(x, "^0*([0-9]*)$", 1).rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def personal_spans(text: Column) -> Column:
    """All base spans of a text by kind, then start: array<struct<start, rank, end, kind, value>>."""
    cheap = {"email": text.contains("@"), "ip": F.lit(True), "card": F.lit(True), "phone": text.contains("+")}
    keep = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: _ip_parts_fit(x["value"]),
        "card": lambda x: _luhn(_digits(x["value"])),
        "phone": lambda x: F.length(_digits(x["value"])).between(9, 15),
    }
    spans = []
    for rank, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)):
        found = F.filter(located(text, pattern), keep[kind])
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        spans.append(tagged(F.when(cheap[kind], found).otherwise(none), kind, rank))
    return F.concat(*spans)


def _terms(text: Column) -> Column:
    """The different words of a text, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1)))


def candidate_pairs(mentions: DataFrame, texts: DataFrame, alpha: float = 0.9, min_support: int = 3) -> DataFrame:
    """Entity and term pairs that may disclose: entity, term, n_et, n_e, least_t, total (materialised).

    ``mentions``: blob (hash of the text), entities (array), terms (array), one row per text; ``texts``: blob, all rows.
    """
    held = mentions.dropDuplicates(["blob"])
    entities = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    # an entity of fewer texts has no term of min_support texts
    entities = materialise(entities.where(F.col("n_e") >= min_support), "pii-entities")
    named = held.select("blob", "terms", F.explode("entities").alias("entity")).join(small_or_shuffled(entities.select("entity")), "entity", "left_semi")
    pairs = named.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= min_support)
    # n_t is at least the number of different texts with any entity in which t stands: this alone clears common words
    least = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("least_t"))
    total = texts.select("blob").distinct().agg(F.count("*").alias("total"))
    pairs = pairs.join(entities, "entity").join(least, "term").join(F.broadcast(total)).where("n_e < total")
    return materialise(pairs.where(_ratio(F.col("least_t")) >= alpha), "pii-pairs")


def _ratio(n_t: Column) -> Column:
    """PMI(e; t) / IC(e)."""
    return F.log(F.col("n_et") * F.col("total") / (F.col("n_e") * n_t)) / F.log(F.col("total") / F.col("n_e"))


def disclosing_terms(pairs: DataFrame, hits: DataFrame, alpha: float = 0.9) -> DataFrame:
    """Terms that give an entity away: term, ratio (the highest PMI / IC). ``hits``: blob, term, where terms occur."""
    n_t = hits.select("blob", "term").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    scored = pairs.join(n_t, "term").select("term", _ratio(F.greatest("n_t", "least_t")).alias("ratio"))
    return scored.groupBy("term").agg(F.max("ratio").alias("ratio")).where(F.col("ratio") >= alpha)


def term_hits(docs: DataFrame, terms: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each document and each of ``terms`` that its text holds: the ``keep`` columns and term."""
    return docs.select(*keep, F.explode(_terms(whole_text(F.col("text")))).alias("term")).join(small_or_shuffled(terms.select("term")), "term", "left_semi")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.9, min_support: int = 3) -> DataFrame:
    """One row per document: id, blob (hash of the text), base (base spans), spans (base spans, then disclosing terms)."""
    rows = docs.select(quoted(id_col).alias("id"), whole_text(quoted(text_col)).alias("text"))
    spans = rows.withColumn("base", personal_spans(F.col("text")))
    entity = lambda x: F.concat_ws(":", x["kind"], F.regexp_replace(F.lower(x["value"]), r"[\x20()]", ""))
    based = materialise(spans.select("id", F.xxhash64("text").alias("blob"), "base"), "pii-base")
    # the words of the whole text, but those inside base spans; all counts are by different texts
    some = spans.where(F.size("base") > 0).select(F.xxhash64("text").alias("blob"), F.array_distinct(F.transform("base", entity)).alias("entities"), _terms(sanitised(F.col("text"), F.col("base"), False)).alias("terms"))
    mentions = materialise(some, "pii-mentions")
    pairs = candidate_pairs(mentions, based, alpha, min_support)
    terms = materialise(pairs.select("term").distinct(), "pii-terms")
    if terms.isEmpty():
        return based.select("id", "blob", "base", F.col("base").alias("spans"))
    hits = materialise(term_hits(rows.select("id", F.xxhash64("text").alias("blob"), "text"), terms, ["id", "blob"]).distinct(), "pii-hits")
    disclosing = materialise(disclosing_terms(pairs, hits, alpha), "pii-disclosing")
    hits = materialise(hits.join(small_or_shuffled(disclosing.select("term")), "term", "left_semi"), "pii-found")
    # one search for all terms of a text
    some = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.sort_array(F.collect_set("term")), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    wanted = materialise(hits.groupBy(F.col("id").alias("hid"), F.col("blob").alias("hblob")).agg(some.alias("exact")), "pii-wanted")
    text = rows.withColumn("blob", F.xxhash64("text")).join(small_or_shuffled(wanted), F.col("id").eqNullSafe(F.col("hid")) & (F.col("blob") == F.col("hblob")))
    extra = text.select("id", "blob", _term_spans(F.col("text"), F.col("exact")).alias("found")).groupBy("id", "blob").agg(F.first("found").alias("found"))
    extra = materialise(extra.select(F.col("id").alias("xid"), F.col("blob").alias("xblob"), F.array_sort("found").alias("found")), "pii-extra")
    joined = based.join(small_or_shuffled(extra), F.col("id").eqNullSafe(F.col("xid")) & (F.col("blob") == F.col("xblob")), "left")
    # a term inside a base span is covered already
    free = F.filter("found", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return joined.select("id", "blob", "base", F.concat("base", F.coalesce(free, F.array().cast(based.schema["base"].dataType))).alias("spans"))


def _term_spans(text: Column, pattern: Column) -> Column:
    """Spans of kind ``term`` for a pattern that differs from row to row."""
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("rank"), end.alias("end"), F.lit("term").alias("kind"), x["hit"].alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    def walk(both: Column) -> Column:
        pairs = F.zip_with(F.slice(both["gaps"], F.lit(1), F.size(both["hits"])), both["hits"], lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>").alias("out"))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    return F.transform(F.array(F.struct(gaps.alias("gaps"), hits.alias("hits"))), walk)[0]


def sanitised(text: Column, spans: Column, named: bool = True) -> Column:
    """The text with every span generalised to its kind, as in ``<EMAIL>`` (``<>`` if not ``named``); of overlapping spans the first by start counts."""

    def step(acc: Column, x: Column) -> Column:
        covered = x["start"] < acc["pos"]
        piece = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]), F.lit("<"), F.upper(x["kind"]) if named else F.lit(""), F.lit(">"))
        return F.struct(F.when(covered, F.greatest(acc["pos"], x["end"])).otherwise(x["end"]).alias("pos"), F.when(covered, acc["out"]).otherwise(piece).alias("out"))

    def close(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text)))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, close)


def sanitised_documents(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sanitised texts of the documents with spans, others are as they were: id, blob, sanitised. ``found``: of ``personal_data``, materialised."""
    some = found.where(F.size("spans") > 0).select(F.col("id").alias("sid"), F.col("blob").alias("sblob"), "spans").dropDuplicates(["sid", "sblob"])
    rows = docs.select(quoted(id_col).alias("id"), whole_text(quoted(text_col)).alias("text")).withColumn("blob", F.xxhash64("text"))
    joined = rows.join(small_or_shuffled(materialise(some, "pii-some")), F.col("id").eqNullSafe(F.col("sid")) & (F.col("blob") == F.col("sblob")))
    return joined.select("id", "blob", sanitised(F.col("text"), F.col("spans")).alias("sanitised"))


def personal_digest(found: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """The spans of each document as counts, a digest of the base spans and a span string; with ``changed`` (``sanitised_documents``) sanitised_sha256, null where nothing was sanitised."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    more = []
    if changed is not None:
        digests = changed.select(F.col("id").alias("cid"), F.col("blob").alias("cblob"), F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256")).distinct()
        found = found.join(small_or_shuffled(materialise(digests, "pii-digests")), F.col("id").eqNullSafe(F.col("cid")) & (F.col("blob") == F.col("cblob")), "left")
        more = ["sanitised_sha256"]
    return found.select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_string(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"), *more,
    )
