"""The rule-based query router: kind of question, seed mix and damping, corrected by how concentrated scores are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfold.functions.text import words

#: Cues of each kind of question, tried as plain substrings.
EXPLANATORY = ("why", "how", "cause", "reason", "effect", "impact", "mechanism")
MULTI_HOP = ("which county", "part of", "related to", "connected to", "before", "after", "whose", "where was")
#: Start of the edge gates and node priors of each kind, and what each correction adds to them.
GATES = ("entity_hyperedge", "hyperedge_hyperedge", "hyperedge_passage", "entity_entity", "entity_passage")
GATE = {"factoid": (0.32, 0.10, 0.28, 0.10, 0.20), "explanatory": (0.18, 0.32, 0.30, 0.07, 0.13), "multi_hop": (0.27, 0.33, 0.20, 0.12, 0.08)}
PRIOR = {"factoid": (0.28, 0.24, 0.48), "explanatory": (0.18, 0.47, 0.35), "multi_hop": (0.24, 0.46, 0.30)}
GATE_STEPS = {"dense": (0, -0.04, 0, 0, 0.04), "linked": (0.03, 0.05, 0, 0, -0.04), "named": (0.04, -0.03, 0, 0, 0)}
PRIOR_STEPS = {"dense": (0, -0.06, 0.06), "linked": (0, 0, 0), "named": (0.05, 0, -0.05)}
#: Seed mix (entity, hyperedge, passage) and damping of each kind.
MIX = {"factoid": (0.45, 0.20, 0.35, 0.45), "explanatory": (0.20, 0.48, 0.32, 0.70), "multi_hop": (0.28, 0.45, 0.27, 0.65)}


def _any(text: Column, cues: tuple[str, ...]) -> Column:
    return text.rlike("|".join(cues))


def query_type(text: Column, entity_conc: Column, hyperedge_conc: Column) -> Column:
    low = F.lower(text)
    n = F.size(words(F.regexp_replace(text, r"\s+", " ")))
    return F.when(_any(low, EXPLANATORY), "explanatory").when(_any(low, MULTI_HOP) | ((n > 12) & (hyperedge_conc >= entity_conc)), "multi_hop").otherwise("factoid")


def routed(rows: DataFrame) -> DataFrame:
    """rows (q, text, entity_conc, hyperedge_conc, passage_conc) with query_type, entity, hyperedge, passage (seed mix), gate_* (edge gates), prior_* (node priors), each sums to 1, and damping."""
    e, h, p = F.col("entity_conc"), F.col("hyperedge_conc"), F.col("passage_conc")
    typed = rows.withColumns({"query_type": query_type(F.col("text"), e, h), "__n": F.size(words(F.regexp_replace("text", r"\s+", " ")))})
    start = lambda k: F.when(F.col("query_type") == "factoid", MIX["factoid"][k]).when(F.col("query_type") == "explanatory", MIX["explanatory"][k]).otherwise(MIX["multi_hop"][k])
    by = lambda cond, x: F.when(cond, x).otherwise(0.0)
    dense, linked, named = p > F.greatest(e, h) * 1.25, h > e * 1.10, (e > p * 1.15) & (F.col("__n") <= 10)
    mix = {
        "entity": start(0) - by(linked, 0.04) + by(named, 0.08),
        "hyperedge": start(1) - by(dense, 0.05) + by(linked, 0.08),
        "passage": start(2) + by(dense, 0.10) - by(linked, 0.04) - by(named, 0.05),
    }
    damping = F.when(dense, F.greatest(F.lit(0.40), start(3) - 0.08)).otherwise(start(3))
    damping = F.when(linked, F.least(F.lit(0.80), damping + 0.05)).otherwise(damping)
    when = {"dense": dense, "linked": linked, "named": named}

    def corrected(prefix: str, names: tuple[str, ...], table: dict, steps: dict) -> dict[str, Column]:
        start = {n: F.when(F.col("query_type") == "factoid", table["factoid"][k]).when(F.col("query_type") == "explanatory", table["explanatory"][k]).otherwise(table["multi_hop"][k]) for k, n in enumerate(names)}
        return {f"{prefix}_{n}": start[n] + sum((by(when[c], float(x[k])) for c, x in steps.items() if x[k]), F.lit(0.0)) for k, n in enumerate(names)}

    def shares(values: dict[str, Column]) -> dict[str, Column]:
        positive = {k: F.greatest(x, F.lit(0.0)) for k, x in values.items()}
        total = sum(positive.values(), F.lit(0.0))
        return {k: x / total for k, x in positive.items()}

    gates, priors = corrected("gate", GATES, GATE, GATE_STEPS), corrected("prior", ("entity", "hyperedge", "passage"), PRIOR, PRIOR_STEPS)
    return typed.withColumns({**shares(mix), **shares(gates), **shares(priors), "damping": F.least(F.greatest(damping, F.lit(0.35)), F.lit(0.85))}).drop("__n")
