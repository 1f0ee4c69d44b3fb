"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become sequences of tokens in which numbers, units after numbers, and names are typed placeholders. Every window
of ``WINDOW`` template tokens of the benchmark is joined by hash with every window of every document. Runs of matches on
one diagonal (document place - item place) are chained in order with runs on diagonals at most ``SHIFT`` away, so words
put in or left out do not split a copy. A chain is a candidate if it has ``COVERAGE`` of an item's windows or covers as
much of its tokens, or if one run has ``LONG_RUN`` windows. The slots decide: where tokens under placeholders differ,
each value of the item must become one value throughout the chain. A passage that passes is a copy (all slots equal) or a
re-parameterised question (slots replaced consistently). Neighbouring placeholders that are equal, and a unit after its
number, are one slot, so a value may change its number of words.

Template windows with fewer than half literal tokens say nothing about an item and are left out on both sides. Beside the
templates, windows of the lower-cased words themselves (runs of letters and digits) are matched and chained the same way: they
find copies of items that are all names and numbers, and copies in other case. Items of fewer than ``WINDOW`` tokens are
matched by windows of their own length.

Defined results: null and empty texts match nothing; rows that repeat an id give one row for the id and item; items
that repeat match each; an empty table on either side gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.llm.common import drop_ids, materialise, quoted, small_or_shuffled, whole_text

WINDOW, COVERAGE = 8, 0.5
#: How far the diagonals of two runs of one chain may be apart, and the windows of a run that is enough by itself.
SHIFT, LONG_RUN = 16, 24
#: Placeholders. No literal is one of them, as every word of digits without letters is a number.
NUMBER, UNIT, NAME = "0", "1", "2"
#: Units that are placeholders after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons oz lb lbs pound pounds ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents kmh mph kph degrees celsius "
    "hz khz mhz ghz kb mb gb tb bytes bits"
).split()


def _spaced(text: Column) -> Column:
    """The text with a space between a number and a unit that is joined to it."""
    return F.regexp_replace(whole_text(text), rf"(?i)([0-9])({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", "$1 $2")


def raw_tokens(text: Column) -> Column:
    """The words of a text: runs without white space."""
    return F.filter(F.split(_spaced(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def _template(text: Column) -> Column:
    """The same words as literals (lower case, without punctuation at the ends) and placeholders, one for one, as a text."""
    # a run that is one space already is not matched
    t = F.concat(F.lit(" "), F.regexp_replace(_spaced(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "), F.lit(" "))
    # each pattern starts with a character that has to match, and looks at what stands before it only then
    # digits and signs without letters are a number
    t = F.regexp_replace(t, r"\x20[^\x20\p{L}0-9]*+[0-9][^\x20\p{L}]*+(?=\x20)", f" {NUMBER}")
    # a capitalised word inside a sentence is a name; what stands after the end of a sentence or line is not looked at
    t = F.regexp_replace(t, r"\p{Lu}(?<=[\p{Ll}\p{Lu},;]\x20.)[\p{L}'’-]*+(?=[^\x20\p{L}]*\x20)", NAME)
    t = F.lower(t)
    t = F.regexp_replace(t, r"[\"'(\[{«“](?<=\x20.)[\"'(\[{«“]*+(?=[^\x20])|[.,;:!?\"')\]}»”](?<=[^\x20].)[.,;:!?\"')\]}»”]*+(?=\x20)", "")
    return F.regexp_replace(t, rf"\x20{NUMBER}\x20(?:{'|'.join(UNITS)})(?=\x20)", f" {NUMBER} {UNIT}")


def _split(t: Column) -> Column:
    return F.filter(F.split(t, " "), lambda x: x != "")


def template_tokens(text: Column) -> Column:
    """The tokens of a text's template, one for each slot or literal: equal placeholders in a row are one, a unit belongs to its number."""
    t = F.regexp_replace(_template(text), rf"(\x20[{NUMBER}{NAME}])(?:\1(?=\x20))++", "$1")
    return _split(F.regexp_replace(t, rf"(\x20{NUMBER})\x20{UNIT}(?=\x20)", "$1"))


def exact_tokens(text: Column) -> Column:
    """The words of a text in lower case: runs of letters and digits. What is empty at the ends is left out."""
    words = F.split(F.lower(whole_text(text)), r"[^\p{L}\p{N}]++")
    first = F.when(words[0] == "", F.lit(1)).otherwise(F.lit(0))
    last = F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), F.lit(1)).otherwise(F.lit(0))
    return F.slice(words, first + 1, F.size(words) - first - last)


def slot_words(raw: Column, template: Column) -> Column:
    """The words of each of ``template_tokens``, from a text's words and its template's words."""

    def starts(t: Column) -> Column:
        before = lambda i: F.get(t, i - 1)
        joins = lambda i: (F.get(t, i).isin(NUMBER, NAME) & (F.get(t, i) == before(i))) | ((F.get(t, i) == UNIT) & (before(i) == NUMBER))
        return F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | ~joins(i))

    def words(x: Column) -> Column:
        return F.transform(x["starts"], lambda a, k: F.slice(x["raw"], a + 1, F.coalesce(F.get(x["starts"], k + 1), F.size(x["raw"])) - a))

    # the one-element transforms bind what they are given once
    bound = F.transform(F.array(F.struct(raw.alias("raw"), template.alias("t"))), lambda x: F.struct(x["raw"].alias("raw"), starts(x["t"]).alias("starts")))
    return F.transform(bound, words)[0]


def _windows(tokens: Column, n: int) -> Column:
    """The hashes of all windows of n tokens, by place.

    A window of 2k tokens is the hash of two of k; one of any other length, of two that overlap. So each place costs a few
    hashes of two numbers, where slices would copy n tokens for each.
    """

    def joined(shift: int) -> Callable[[Column], Column]:
        left = lambda h: F.greatest(F.size(h) - shift, F.lit(0))
        return lambda h: F.zip_with(F.slice(h, 1, left(h)), F.slice(h, shift + 1, left(h)), lambda a, b: F.xxhash64(a, b))

    # the one-element arrays bind each step's hashes once
    h, k = F.array(F.transform(tokens, lambda x: F.xxhash64(x))), 1
    while 2 * k <= n:
        h, k = F.transform(h, joined(k)), 2 * k
    return (F.transform(h, joined(n - k)) if n > k else h)[0]


def _literal(tokens: Column) -> Column:
    """Whether half the tokens or more are literals."""
    return 2 * F.size(F.filter(tokens, lambda x: ~x.isin(NUMBER, UNIT, NAME))) >= F.size(tokens)


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", tokenise: Callable[[Column], Column] = template_tokens) -> DataFrame:
    """The windows of all items: item, length, tokens (count), hash, item_pos; of templates those that say something."""
    items = benchmark.select(quoted(id_col).alias("item"), tokenise(quoted(text_col)).alias("tokens")).where(F.size("tokens") > 0)
    items = items.withColumn("length", F.least(F.size("tokens"), F.lit(WINDOW)))
    of_length = F.coalesce(*[F.when(F.col("length") == n, _windows(F.col("tokens"), n)) for n in range(1, WINDOW + 1)])
    each = items.select("item", "length", F.col("tokens").alias("words"), F.size("tokens").alias("tokens"), F.posexplode(of_length).alias("item_pos", "hash"))
    if tokenise is template_tokens:
        each = each.where(_literal(F.slice("words", F.col("item_pos") + 1, F.col("length"))))
    return each.select("item", "length", "tokens", "hash", "item_pos")


def _candidates(texts: DataFrame, items: DataFrame, tokenise: Callable[[Column], Column]) -> DataFrame | None:
    """``chained`` for all texts (id, text) and ``items`` (windows); None if there is no window."""
    sizes = materialise(items.groupBy("item", "tokens", "length").agg(F.count("*").alias("windows")), "bench-sizes")
    tokens = texts.select("id", tokenise(F.col("text")).alias("tokens"))
    found = None
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # WINDOW values at most
    for n in lengths:
        each = tokens.select("id", F.posexplode(_windows(F.col("tokens"), n)).alias("pos", "hash"))
        hits = each.join(small_or_shuffled(items.where(F.col("length") == n).select("item", "hash", "item_pos")), "hash").select("id", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos")
        found = hits if found is None else found.unionByName(hits)
    return None if found is None else materialise(chained(found, sizes), "bench-chains")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item found in it: id, item, matched and windows (counts, of the better route), copied (all slots equal)."""
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    exact = _candidates(texts, materialise(item_windows(benchmark, item_id_col, item_text_col, exact_tokens), "bench-exact"), exact_tokens)
    if exact is None:
        empty = texts.limit(0).crossJoin(benchmark.limit(0).select(quoted(item_id_col).alias("item")))
        return empty.select("id", "item", F.lit(0).cast("long").alias("matched"), F.lit(0).cast("long").alias("windows"), F.lit(True).alias("copied"))
    found = exact.select("id", "item", "matched", "windows", F.lit(True).alias("copied"))
    items = materialise(item_windows(benchmark, item_id_col, item_text_col), "bench-windows")
    chains = _candidates(texts, items, template_tokens)
    if chains is not None:
        found = found.unionByName(_consistent(texts, benchmark.select(quoted(item_id_col).alias("item"), quoted(item_text_col).alias("item_text")), chains))
    best = F.max(F.struct("matched", "windows"))
    return found.groupBy("id", "item").agg(best.alias("best"), F.max("copied").alias("copied")).select("id", "item", "best.matched", "best.windows", "copied")


def _consistent(texts: DataFrame, items: DataFrame, chains: DataFrame) -> DataFrame:
    """The ``chains`` of templates whose slots are replaced consistently: id, item, matched, windows, copied. ``items``: item, item_text."""
    # the slots of candidates, from the texts of candidate documents and items alone
    wanted = materialise(chains.select("id").distinct(), "bench-docs")
    words = lambda c: slot_words(raw_tokens(F.col(c)), _split(_template(F.col(c))))
    text = texts.join(small_or_shuffled(wanted), "id", "left_semi").select("id", words("text").alias("words"))
    item_text = items.join(small_or_shuffled(chains.select("item").distinct()), "item", "left_semi").select("item", words("item_text").alias("item_words"), template_tokens(F.col("item_text")).alias("item_tokens"))
    both = chains.join(text, "id").join(item_text, "item")
    bare = lambda x: F.regexp_replace(x, r"^[\"'(\[{«“]+(?=.)|(?<=.)[.,;:!?\"')\]}»”]+$", "")
    pair = lambda i, d: F.struct(bare(i).alias("i"), bare(d).alias("d"))

    def values(x: Column) -> Column:
        """The values of one slot: word by word, or as a whole if their numbers of words differ."""
        return F.when(F.size(x["i"]) == F.size(x["d"]), F.zip_with(x["i"], x["d"], pair)).otherwise(F.array(pair(F.array_join(x["i"], " "), F.array_join(x["d"], " "))))

    def slots(run: Column) -> Column:
        start, n = run["first"] + 1, run["last"] - run["first"] + F.col("length")
        sides = F.zip_with(F.slice("item_words", start, n), F.slice("words", start + run["diagonal"], n), lambda i, d: F.struct(i.alias("i"), d.alias("d")))
        held = F.filter(F.zip_with(F.slice("item_tokens", start, n), sides, lambda t, p: F.struct(t.alias("t"), p.alias("p"))), lambda x: x["t"].isin(NUMBER, UNIT, NAME))
        return F.flatten(F.transform(held, lambda x: values(x["p"])))

    judged = both.withColumn("slots", F.array_distinct(F.flatten(F.transform("chain", slots))))
    one_each = F.size(F.array_distinct(F.transform("slots", lambda x: x["i"]))) == F.size("slots")
    kept = judged.where(one_each).withColumn("copied", ~F.exists("slots", lambda x: x["i"] != x["d"]))
    return kept.select("id", "item", "matched", "windows", "copied")


def chained(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """The candidates: id, item, length, chain (runs in order: first, last, diagonal), matched, windows.

    ``found``: id, item, diagonal, item_pos, one row per match; ``sizes``: item, windows, tokens, length. Each run is the
    end of its best chain; each chain is also judged without its first runs, as they may be chance matches.
    """
    order = Window.partitionBy("id", "item", "diagonal").orderBy("item_pos")
    runs = found.distinct().withColumn("island", F.col("item_pos") - F.row_number().over(order))
    runs = runs.groupBy("id", "item", "diagonal", "island").agg(F.min("item_pos").cast("long").alias("first"), F.max("item_pos").cast("long").alias("last"))
    runs = runs.join(small_or_shuffled(sizes), "item").withColumns({"windows_n": F.col("last") - F.col("first") + 1, "tokens_n": F.col("last") - F.col("first") + F.col("length")})
    run = F.struct((F.col("first") + F.col("diagonal")).alias("pos"), "first", "last", F.col("diagonal").cast("long").alias("diagonal"), F.col("windows_n").cast("long").alias("won"), F.col("tokens_n").cast("long").alias("gain"))
    groups = runs.groupBy("id", "item", "windows", "tokens", "length").agg(F.sum("windows_n").alias("n"), F.sum("tokens_n").alias("t"), F.max("windows_n").alias("longest"), F.sort_array(F.collect_list(run)).alias("runs"))
    enough = lambda n, t, longest: (n >= COVERAGE * F.col("windows")) | (t >= COVERAGE * F.col("tokens")) | (longest >= LONG_RUN)
    groups = materialise(groups.where(enough(F.col("n"), F.col("t"), F.col("longest"))).select("id", "item", "windows", "tokens", "length", "runs"), "bench-runs")
    one = "struct<pos:bigint,first:bigint,last:bigint,diagonal:bigint,won:bigint,gain:bigint>"
    chain = f"struct<total:bigint,chain:array<{one}>>"
    last = lambda c: F.element_at(c["chain"], -1)

    def added(c: Column, x: Column) -> Column:
        """A chain with one more run, which counts what the chain does not have."""
        a = last(c)
        gain, won = x["last"] - F.greatest(x["first"], a["last"] + F.col("length")) + F.col("length"), x["last"] - F.greatest(x["first"], a["last"] + 1) + 1
        more = F.struct(x["pos"].alias("pos"), x["first"].alias("first"), x["last"].alias("last"), x["diagonal"].alias("diagonal"), F.greatest(won, F.lit(0)).cast("long").alias("won"), F.greatest(gain, F.lit(0)).cast("long").alias("gain"))
        return F.struct((c["total"] + more["gain"]).cast("long").alias("total"), F.concat(c["chain"], F.array(more)).alias("chain"))

    def step(acc: Column, x: Column) -> Column:
        fits = lambda c: (last(c)["pos"] < x["pos"]) & (last(c)["first"] < x["first"]) & (last(c)["last"] < x["last"]) & (last(c)["last"] + last(c)["diagonal"] < x["last"] + x["diagonal"]) & (F.abs(x["diagonal"] - last(c)["diagonal"]) <= SHIFT)
        alone = F.struct(x["gain"].alias("total"), F.array(x).alias("chain"))
        # a run that starts further back than an item reaches is followed by none
        near = F.filter(acc["open"], lambda c: last(c)["pos"] >= x["pos"] - F.col("tokens") - SHIFT)
        best = F.array_max(F.concat(F.array(alone), F.transform(F.filter(near, fits), lambda c: added(c, x)))).cast(chain)
        return F.transform(F.array(F.struct(near.alias("near"), best.alias("best"))), lambda b: F.struct(F.concat(b["near"], F.array(b["best"])).alias("open"), F.concat(acc["all"], F.array(b["best"])).alias("all")))[0]

    empty = F.array().cast(f"array<{chain}>")
    ends = F.aggregate("runs", F.struct(empty.alias("open"), empty.alias("all")), step, lambda acc: acc["all"])
    each = groups.withColumn("end", F.explode(ends)).withColumn("full", F.col("end.chain"))
    each = each.select("id", "item", "windows", "tokens", "length", "full", F.explode(F.sequence(F.lit(1), F.size("full"))).alias("k"))
    each = each.withColumn("chain", F.slice("full", F.col("k"), F.size("full")))
    head = F.col("chain")[0]
    total = lambda name: F.aggregate(F.slice("chain", 2, F.size("chain")), F.lit(0).cast("long"), lambda n, x: n + x[name])
    each = each.withColumns({"matched": head["last"] - head["first"] + 1 + total("won"), "covered": head["last"] - head["first"] + F.col("length") + total("gain"), "longest": F.array_max(F.transform("chain", lambda x: x["last"] - x["first"] + 1))})
    return each.where(enough(F.col("matched"), F.col("covered"), F.col("longest"))).select("id", "item", "length", "chain", "matched", "windows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item."""
    found = contaminated(docs, benchmark, id_col, text_col)
    return drop_ids(docs, materialise(found.select(F.col("id").alias(id_col)).distinct(), "bench-gone"), id_col)
