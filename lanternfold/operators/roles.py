"""Evidence roles of a question: validity, fallback, the sinks of the role graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.operators.ranking import first_of_each

#: The role that stands in where a question has none.
FALLBACK_ROLE = {"role_id": "r0", "role_type": "answer_evidence"}


def valid_roles(roles: DataFrame) -> DataFrame:
    """Roles with a description; a missing id becomes ``r`` and the role's place; of equal ids the first stays.

    roles: q, pos (from 0), role_id, description.
    """
    named = roles.where(F.trim("description") != "")
    named = named.withColumn("role_id", F.when(F.trim("role_id") == "", F.concat(F.lit("r"), F.col("pos").cast("string"))).otherwise(F.col("role_id")))
    return first_of_each(named, ["q"], ["role_id"], ["pos"])


def terminal_roles(roles: DataFrame, links: DataFrame) -> DataFrame:
    """The roles of each question from which no link goes out; all having one, the last role. Columns: q, role_id.

    roles: q, pos, role_id; links: q, role_id, to_id.
    """
    sinks = roles.join(links.select("q", "role_id").distinct(), ["q", "role_id"], "left_anti").select("q", "role_id")
    last = roles.groupBy("q").agg(F.max_by("role_id", "pos").alias("role_id"))
    return sinks.unionByName(last.join(sinks.select("q").distinct(), "q", "left_anti"))
