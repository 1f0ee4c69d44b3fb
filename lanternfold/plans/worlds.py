"""How the driver's tables stand in for the engine's model, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.operators.shared import small_or_shuffled
from lanternfold.registry import Tables

CHANNELS = ("click", "error", "purchase", "signup", "view")

#: channels: each user is a question, each event type a channel, ranked by value
CH = """ch AS (SELECT user_id AS q, event_type AS channel, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS cpos,
 event_id % 97 AS doc, value AS score, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events)"""


def channels(t: Tables) -> DataFrame:
    cpos = F.lit(4)
    for i, name in enumerate(CHANNELS[:4]):
        cpos = F.when(F.col("event_type") == name, i).otherwise(cpos)
    rank = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")).cast("long")
    return t.events.select(F.col("user_id").alias("q"), F.col("event_type").alias("channel"), cpos.alias("cpos"), (F.col("event_id") % 97).alias("doc"), F.col("value").alias("score"), rank.alias("rank"))


def pool_sql(name: str, depth: int = 12, most: int = 24) -> str:
    return (f"{name}_f AS (SELECT q, doc, rank, cpos, row_number() OVER (PARTITION BY q, doc ORDER BY rank, cpos) AS k FROM ch WHERE rank <= {min(depth, 16)}), "
            f"{name}_o AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY rank, cpos) AS pos FROM {name}_f WHERE k = 1), {name} AS (SELECT * FROM {name}_o WHERE pos <= {most})")  # fmt: skip


#: what a selector chose: five of the pool by a fixed mixing of ids
SEL = "sel_o AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY (doc * 7 + q) % 31, doc) AS spos FROM pool), sel AS (SELECT * FROM sel_o WHERE spos <= 5)"


def selection(pool: DataFrame) -> DataFrame:
    order = Window.partitionBy("q").orderBy((F.col("doc") * 7 + F.col("q")) % 31, "doc")
    return pool.select("q", "doc", F.row_number().over(order).cast("long").alias("spos")).where("spos <= 5")


#: gold: the documents of a question's best three signups
GOLD = "gold AS (SELECT DISTINCT q, doc FROM ch WHERE channel = 'signup' AND rank <= 3)"


def gold(ch: DataFrame) -> DataFrame:
    return ch.where("channel = 'signup' and rank <= 3").select("q", "doc").distinct()


#: normalised scores of the channels
NORMED = """nm AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w)
 ELSE 1 - (rank - 1) / greatest(count(*) OVER w - 1, 1) END AS norm FROM ch WINDOW w AS (PARTITION BY q, channel))"""

#: answers: what the assistant says after each user turn
QA = """qa AS (SELECT u.conv_id * 1000 + u.turn AS q, u.turn AS gold_id, u.text AS gold, a.text AS prediction FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
 WHERE u.role = 'user' AND a.role = 'assistant')"""


def answers(t: Tables) -> DataFrame:
    u = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold"))
    a = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), F.col("turn").alias("gold_id"), "gold", "prediction")


ANS = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!"#$%&''()*+,./:;<=>?@\[\\\]^_`{{|}}~-]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"""

#: vectors: every row whose id is divisible by 100 asks, all rows answer
VEC_Q = "vec_id % 100 = 0"
DOT = "list_dot_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"

#: the star schema as triples: subject, relation, object and the passage (table row) that states it
TRIPLES = """tr AS (
 SELECT 'c' || c_custkey AS passage, lower(c_name) AS s, 'in nation' AS r, lower(n_name) AS o FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 's' || s_suppkey, lower(s_name), 'in nation', lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'n' || n_nationkey, lower(n_name), 'in region', lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'p' || ps.l_partkey, lower(p_name) || ' ' || p_partkey, 'supplied by', lower(s_name) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ps JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def triples(t: Tables) -> DataFrame:
    nation = t.nation
    named = lambda df, key, prefix, name, fk: df.join(F.broadcast(nation), F.col(fk) == F.col("n_nationkey")).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("passage"), F.lower(name).alias("s"), F.lit("in nation").alias("r"), F.lower("n_name").alias("o"))
    region = nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("passage"), F.lower("n_name").alias("s"), F.lit("in region").alias("r"), F.lower("r_name").alias("o"))
    # one shuffle makes the pairs distinct and brings them to their parts
    pairs = t.lineitem.select("l_partkey", "l_suppkey").repartition("l_partkey").distinct()
    supplied = pairs.join(t.part.select("p_partkey", "p_name").hint("merge"), F.col("l_partkey") == F.col("p_partkey")).join(small_or_shuffled(t.supplier.select("s_suppkey", "s_name")), F.col("l_suppkey") == F.col("s_suppkey"))
    supplied = supplied.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("passage"), F.concat(F.lower("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("s"), F.lit("supplied by").alias("r"), F.lower("s_name").alias("o"))
    return named(t.customer, "c_custkey", "c", "c_name", "c_nationkey").unionByName(named(t.supplier, "s_suppkey", "s", "s_name", "s_nationkey")).unionByName(region).unionByName(supplied)
