"""Queries of the scalar text functions over documents, benchmark items, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.functions import text as T
from lanternfold.registry import Registry, Tables

R = Registry()


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
PROC = "trim(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'))"
STOP = quoted(T.STOPWORDS)


def joined(c) -> F.Column:
    return F.array_join(c, ",")


@R.add("f1_text_processing", f"SELECT doc_id, md5({PROC.format('text')}) AS processed FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.processed(F.col("text")).cast("binary")).alias("processed"))


@R.add("f2_normalize_graph_text", f"SELECT doc_id, md5(regexp_replace({PROC.format('text')}, ' +', ' ', 'g')) AS normalised FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.graph_text(F.col("text")).cast("binary")).alias("normalised"))


@R.add("f3_normalize_text", f"SELECT doc_id, md5({NORM.format('text')}) AS normalised FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.normalised(F.col("text")).cast("binary")).alias("normalised"))


@R.add("f4_content_tokens", f"SELECT doc_id, len(list_distinct(list_filter(string_split({NORM.format('text')}, ' '), lambda x: length(x) >= 3 AND x NOT IN ({STOP})))) AS n_tokens, md5(array_to_string(list_sort(list_distinct(list_filter(string_split({NORM.format('text')}, ' '), lambda x: length(x) >= 3 AND x NOT IN ({STOP})))), ' ')) AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    tokens = T.content_tokens(F.col("text"))
    return t.documents.select("doc_id", tokens.alias("x")).select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("x"), " ").cast("binary")).alias("tokens"))


@R.add("f5_informative_endpoint", f"""
    WITH n AS (SELECT item_id, unnest(string_split(text, '.')) AS piece FROM benchmark), e AS (SELECT item_id, {NORM.format('piece')} AS x FROM n)
    SELECT item_id, CASE WHEN x IN ({quoted(T.WEAK_ENDPOINTS)}) OR (length(x) < 3 AND NOT regexp_matches(x, '^[0-9]+$')) THEN '' ELSE x END AS endpoint FROM e
""")
def _(t: Tables) -> DataFrame:
    pieces = t.benchmark.select("item_id", F.explode(F.split("text", "[.]")).alias("piece"))
    return pieces.select("item_id", T.informative_endpoint(F.col("piece")).alias("endpoint"))


@R.add("f6_title_body", """
    SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title,
           md5(CASE WHEN instr(text, chr(10)) > 0 THEN regexp_replace(substr(text, instr(text, chr(10)) + 1), '^[ \t\n\r:-]+|[ \t\n\r:-]+$', '', 'g') ELSE '' END) AS body FROM documents
""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.title_of(F.col("text")).alias("title"), F.md5(T.body_of(F.col("text")).cast("binary")).alias("body"))


@R.add("f8_token_stem", "WITH w AS (SELECT DISTINCT unnest(string_split(" + NORM.format("text") + ", ' ')) AS token FROM benchmark) SELECT token, CASE "
    + " ".join(f"WHEN token = '{a}' THEN '{b}'" for a, b in T.ORDINALS.items()) + " "
    + " ".join(f"WHEN length(token) > {len(s) + 3} AND suffix(token, '{s}') THEN left(token, length(token) - {len(s)})" + (" || 'y'" if s == "ied" else "") for s in T.SUFFIXES)
    + " ELSE token END AS stem FROM w WHERE token <> ''")
def _(t: Tables) -> DataFrame:
    tokens = t.benchmark.select(F.explode(F.split(T.normalised(F.col("text")), " ")).alias("token")).distinct().where("token <> ''")
    return tokens.select("token", T.stem(F.col("token")).alias("stem"))


@R.add("f9_query_focus_terms", f"""
    WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark),
    u AS (SELECT item_id, unnest(ws) AS raw, generate_subscripts(ws, 1) AS pos FROM w),
    k AS (SELECT * FROM u WHERE length(raw) >= 4 AND raw NOT IN ({STOP})),
    f AS (SELECT item_id, pos, 0 AS form, raw AS term FROM k
      UNION ALL SELECT item_id, pos, 1, left(raw, length(raw) - 3) || 'y' FROM k WHERE suffix(raw, 'ies') AND length(raw) > 5
      UNION ALL SELECT item_id, pos, 2, left(raw, length(raw) - 3) FROM k WHERE suffix(raw, 'ing') AND length(raw) > 6
      UNION ALL SELECT item_id, pos, 3, left(raw, length(raw) - 2) FROM k WHERE suffix(raw, 'ed') AND length(raw) > 5
      UNION ALL SELECT item_id, pos, 4, left(raw, length(raw) - 1) FROM k WHERE suffix(raw, 's') AND length(raw) > 4),
    d AS (SELECT item_id, term, min(pos * 10 + form) AS o FROM f WHERE length(term) >= 4 AND term NOT IN ({STOP}) GROUP BY ALL)
    SELECT item_id, string_agg(term, ',' ORDER BY o) AS terms FROM d GROUP BY item_id
""")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", joined(T.focus_terms(F.col("text"))).alias("terms")).where("terms <> ''")


@R.add("f10_symbol_phrases", f"""
    WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ({STOP})) AS ws FROM benchmark),
    p AS (SELECT item_id, unnest(list_concat(
        list_transform(range(1, greatest(len(ws) - 3, 0) + 1), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')),
        list_transform(range(1, greatest(len(ws) - 2, 0) + 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' ')),
        list_transform(range(1, greatest(len(ws) - 1, 0) + 1), lambda i: array_to_string(list_slice(ws, i, i + 1), ' ')))) AS phrase FROM w)
    SELECT item_id, count(DISTINCT phrase) AS phrases, min(phrase) AS first_phrase, max(length(phrase)) AS longest FROM p WHERE length(phrase) >= 9 GROUP BY item_id
""")
def _(t: Tables) -> DataFrame:
    raw = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) >= 4) & ~x.isin(*T.STOPWORDS))
    kept = t.benchmark.select("item_id", raw.alias("ws"))
    grams = lambda n: F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    each = kept.select("item_id", F.explode(F.concat(grams(4), grams(3), grams(2))).alias("phrase")).where("length(phrase) >= 9")
    return each.groupBy("item_id").agg(F.countDistinct("phrase").alias("phrases"), F.min("phrase").alias("first_phrase"), F.max(F.length("phrase")).cast("long").alias("longest"))


@R.add("f12_truncate_text", "SELECT conv_id, turn, CASE WHEN length(text) <= 60 THEN text ELSE rtrim(left(text, 56)) || ' ...' END AS short FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.truncated(F.col("text"), 60).alias("short"))


@R.add("f13_normalize_answer", r"""
    SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!"#$%&''()*+,./:;<=>?@\[\\\]^_`{|}~-]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS answer FROM conversations
""")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.answer_text(F.col("text")).alias("answer"))


def _family_sql(x: str) -> str:
    rows = []
    for family, cues in T.RELATION_FAMILIES.items():
        hit = " OR ".join(f"contains({x}, '{c}')" for c in cues)
        rows.append(f"WHEN {hit}" + (f" OR {x} IN ({quoted(T.LOCATION_WORDS)})" if family == "location" else "") + f" THEN '{family}'")
    rest = f"array_to_string(list_slice(list_filter(string_split(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' '), lambda y: y <> ''), 1, 3), '_')"
    return f"CASE WHEN {x} = '' THEN '' {' '.join(rows)} WHEN {rest} <> '' THEN 'other:' || {rest} ELSE '' END"


@R.add("f14_relation_family", f"""
    WITH r AS (SELECT DISTINCT relation FROM (SELECT p_type AS relation FROM part UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT event_type FROM events
      UNION ALL SELECT trim(split_part(text, '.', 1)) FROM benchmark UNION ALL SELECT unnest(['in nation', 'written by', 'was born in', 'is in', 'founded', 'part_of', 'number-of episodes', '']))),
    x AS (SELECT relation, trim(regexp_replace(replace(replace(lower(relation), '_', ' '), '-', ' '), '\\s+', ' ', 'g')) AS t FROM r)
    SELECT relation, {_family_sql('t')} AS family FROM x
""")
def _(t: Tables) -> DataFrame:
    more = ["in nation", "written by", "was born in", "is in", "founded", "part_of", "number-of episodes", ""]
    fixed = t.spark.createDataFrame([(x,) for x in more], "relation string")
    rows = t.part.select(F.col("p_type").alias("relation")).union(t.orders.select("o_orderpriority")).union(t.events.select("event_type"))
    rows = rows.union(t.benchmark.select(F.trim(F.substring_index("text", ".", 1)))).union(fixed).distinct()
    return rows.select("relation", T.relation_family(F.col("relation")).alias("family"))


def _slots_sql(x: str, phrases) -> str:
    hits = ", ".join(f"CASE WHEN contains({x}, ' {p} ') THEN '{v}' END" for p, v in phrases)
    return f"[{hits}]"


@R.add("f15_support_slots", f"""
    WITH p AS (SELECT doc_id, ' ' || regexp_replace({PROC.format('text')}, ' +', ' ', 'g') || ' ' AS x FROM documents),
    h AS (SELECT doc_id, unnest({_slots_sql('x', T.COMPARISON_PHRASES + T.ROLE_PHRASES + T.TIME_PHRASES + T.GEO_PHRASES + T.AXIS_PHRASES)}) AS slot FROM p)
    SELECT d.doc_id, count(DISTINCT slot) AS slots, coalesce(string_agg(DISTINCT slot, ',' ORDER BY slot), '') AS values FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id
""")
def _(t: Tables) -> DataFrame:
    found = T.phrase_slots(F.col("text"), T.COMPARISON_PHRASES + T.ROLE_PHRASES + T.TIME_PHRASES + T.GEO_PHRASES + T.AXIS_PHRASES)
    return t.documents.select("doc_id", found.alias("x")).select("doc_id", F.size("x").cast("long").alias("slots"), joined(F.array_sort("x")).alias("values"))


@R.add("f16_named_surfaces", r"""
    WITH s AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS surface FROM benchmark)
    SELECT item_id, string_agg(DISTINCT surface, '|' ORDER BY surface) AS surfaces FROM s GROUP BY item_id
""")
def _(t: Tables) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0))
    return t.benchmark.select("item_id", F.array_join(F.array_sort(F.array_distinct(found)), "|").alias("surfaces")).where("surfaces <> ''")


@R.add("f17_capitalised_tokens", f"""
    WITH s AS (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Z][A-Za-z0-9]*'))) AS x FROM benchmark)
    SELECT b.item_id, coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '') AS tokens FROM benchmark b LEFT JOIN (SELECT * FROM s WHERE length(x) >= 3 AND x NOT IN ({STOP})) s USING (item_id) GROUP BY b.item_id
""")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", joined(T.capitalised_tokens(F.col("text"))).alias("tokens"))


@R.add("f18_role_query_text", """
    SELECT b.item_id, r.role_id, 'Question: ' || b.text || chr(10) || 'Evidence role: ' || coalesce(nullif(trim(r.description), ''), nullif(trim(r.other), ''), '') AS query
    FROM benchmark b CROSS JOIN (VALUES ('r0', 'identify the writer', ''), ('r1', '  ', ' find the place '), ('r2', '', '')) r(role_id, description, other)
""")
def _(t: Tables) -> DataFrame:
    roles = t.spark.createDataFrame([("r0", "identify the writer", ""), ("r1", "  ", " find the place "), ("r2", "", "")], "role_id string, description string, other string")
    return t.benchmark.crossJoin(F.broadcast(roles)).select("item_id", "role_id", T.role_query(F.col("text"), T.first_filled(F.col("description"), F.col("other"))).alias("query"))


@R.add("f19_valid_roles", """
    WITH r AS (SELECT conv_id AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN turn % 3 = 2 THEN '' ELSE role END AS role_id, trim(text) AS description FROM conversations),
    n AS (SELECT q, pos, CASE WHEN role_id = '' THEN 'r' || pos ELSE role_id END AS role_id FROM r WHERE description <> ''),
    f AS (SELECT *, row_number() OVER (PARTITION BY q, role_id ORDER BY pos) AS k FROM n)
    SELECT q, pos, role_id FROM f WHERE k = 1
""")
def _(t: Tables) -> DataFrame:
    from lanternfold.operators.roles import valid_roles

    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    named = F.when(F.col("turn") % 3 == 2, "").otherwise(F.col("role"))
    rows = t.conversations.select(F.col("conv_id").alias("q"), pos.cast("long").alias("pos"), named.alias("role_id"), F.col("text").alias("description"))
    return valid_roles(rows).select("q", "pos", "role_id")


@R.add("f21_selector_output_parse", """
    WITH s AS (SELECT user_id AS q, event_id AS n, CASE WHEN event_id % 4 = 0 THEN 'no ids' WHEN event_id % 4 = 1 THEN 'ok {"selected_ids": [' || (event_id % 7) || ',' || (event_id % 30) || ',' || (event_id % 7) || ']} done'
      ELSE '{"selected_ids": [' || (event_id % 11) || ',' || (event_id % 24) || ']}' END AS answer FROM events),
    l AS (SELECT q, n, CASE WHEN contains(answer, '{') THEN list_transform(string_split(regexp_extract(answer, '\\[([0-9,]*)\\]', 1), ','), lambda x: CAST(x AS INT)) ELSE [] END AS ids FROM s),
    u AS (SELECT q, n, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM l), k AS (SELECT q, n, id, min(pos) AS pos FROM u WHERE id BETWEEN 0 AND 23 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY q, n ORDER BY pos) AS k FROM k)
    SELECT s.q, s.n, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY k), '') AS ids FROM s LEFT JOIN (SELECT * FROM r WHERE k <= 5) r USING (q, n) GROUP BY s.q, s.n
""")
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    s = lambda n: (e % n).cast("string")
    answer = F.when(e % 4 == 0, "no ids").when(e % 4 == 1, F.concat(F.lit('ok {"selected_ids": ['), s(7), F.lit(","), s(30), F.lit(","), s(7), F.lit("]} done")))
    answer = answer.otherwise(F.concat(F.lit('{"selected_ids": ['), s(11), F.lit(","), s(24), F.lit("]}")))
    return t.events.select(F.col("user_id").alias("q"), e.alias("n"), joined(T.selected_ids(answer, 24, 5).cast("array<string>")).alias("ids"))


@R.add("f24_hash_ids", "SELECT doc_id, 'chunk-' || md5(text) AS hash_id, sha256(text) AS cache_key FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.hash_id("chunk", F.col("text")).alias("hash_id"), F.sha2("text", 256).alias("cache_key"))


@R.add("f26_freshness", """
    WITH s AS (SELECT user_id, date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE) AS step FROM events), l AS (SELECT user_id, max(step) AS last_seen FROM s GROUP BY 1)
    SELECT user_id, last_seen, round(exp(-greatest((SELECT max(step) FROM s) - last_seen, 0) / 5.0), 6) AS freshness FROM l
""")
def _(t: Tables) -> DataFrame:
    first = t.events.agg(F.min("ts").alias("first"))
    steps = t.events.crossJoin(F.broadcast(first)).select("user_id", F.datediff("ts", "first").cast("long").alias("step"))
    now = steps.agg(F.max("step").alias("now"))
    last = steps.groupBy("user_id").agg(F.max("step").alias("last_seen")).crossJoin(F.broadcast(now))
    return last.select("user_id", "last_seen", F.round(T.freshness(F.col("last_seen"), F.col("now")), 6).alias("freshness"))


@R.add("f30_lexical_compatibility", f"""
    WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split({NORM.format('text')}, ' '), lambda x: length(x) >= 3 AND x NOT IN ({STOP}))) AS ws FROM documents),
    r AS (SELECT item_id, list_distinct(list_filter(string_split({NORM.format('text')}, ' '), lambda x: length(x) >= 3 AND x NOT IN ({STOP}))) AS rs FROM benchmark),
    rt AS (SELECT item_id, unnest(rs) AS w, len(rs) AS n FROM r), dt AS (SELECT doc_id, unnest(ws) AS w FROM d)
    SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS compatibility FROM rt JOIN dt USING (w) GROUP BY ALL HAVING count(*) >= 0.5 * any_value(n)
""")
def _(t: Tables) -> DataFrame:
    from lanternfold.operators.lexical import lexical_compatibility

    found = lexical_compatibility(t.documents.select(F.col("doc_id").alias("doc"), "text"), t.benchmark.select(F.col("item_id").alias("q"), "text"))
    return found.where("shared >= 0.5 * n").select(F.col("q").alias("item_id"), F.col("doc").alias("doc_id"), F.round(F.col("shared") / F.col("n"), 6).alias("compatibility"))


@R.add("f31_role_masking", f"""
    WITH q AS (SELECT conv_id, turn, list_filter(string_split({NORM.format('text')}, ' '), lambda x: x <> '') AS ws FROM conversations),
    p AS (SELECT a.conv_id, a.turn, list_filter(a.ws, lambda x: NOT list_contains(b.ws, x)) AS kept FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)
    SELECT conv_id, turn, array_to_string(kept, ' ') AS masked FROM p
""")
def _(t: Tables) -> DataFrame:
    ws = F.filter(F.split(T.normalised(F.col("text")), " "), lambda x: x != "")
    a = t.conversations.select("conv_id", "turn", ws.alias("ws"))
    b = a.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("ws").alias("before"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(F.filter("ws", lambda x: ~F.array_contains(F.col("before"), x)), " ").alias("masked"))


@R.add("f32_parse_answer", """
    WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Thought: x' || chr(10) || 'Answer: ' || text ELSE text END AS response FROM conversations)
    SELECT conv_id, turn, CASE WHEN instr(response, 'Answer:') > 0 THEN trim(substr(response, instr(response, 'Answer:') + 7)) ELSE trim(response) END AS answer, contains(response, '<think>') AS leaks FROM s
""")
def _(t: Tables) -> DataFrame:
    response = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Thought: x\nAnswer: "), F.col("text"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", T.parsed_answer(response).alias("answer"), response.contains("<think>").alias("leaks"))


@R.add("f33_merge_same_first_line", """
    WITH s AS (SELECT source, doc_id, split_part(text, chr(10), 1) AS head, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents)
    SELECT head, count(*) AS n, md5(string_agg(body, chr(10) ORDER BY doc_id)) AS bodies FROM s GROUP BY head
""")
def _(t: Tables) -> DataFrame:
    head = F.substring_index("text", "\n", 1)
    rows = t.documents.select("doc_id", head.alias("head"), F.substring(F.col("text"), F.length(head) + 2, F.length("text")).alias("body"))
    merged = rows.groupBy("head").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("doc_id", "body"))).alias("x"))
    return merged.select("head", "n", F.md5(F.array_join(F.transform("x", lambda x: x["body"]), "\n").cast("binary")).alias("bodies"))


@R.add("f34_gold_answer_merge", """
    WITH g AS (SELECT conv_id, turn, trim(text) AS answer, lower(trim(text)) AS k FROM conversations WHERE role = 'user'),
    f AS (SELECT conv_id, answer, turn, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS r FROM g)
    SELECT conv_id, string_agg(answer, '|' ORDER BY turn) AS answers FROM f WHERE r = 1 GROUP BY conv_id
""")
def _(t: Tables) -> DataFrame:
    from lanternfold.operators.ranking import first_of_each

    gold = t.conversations.where("role = 'user'").select("conv_id", "turn", F.trim("text").alias("answer"), F.lower(F.trim("text")).alias("k"))
    kept = first_of_each(gold, ["conv_id"], ["k"], ["turn"])
    return kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "answer"))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda x: x["answer"]), "|").alias("answers"))
