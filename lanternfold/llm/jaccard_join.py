"""Word n-gram Jaccard self-join by parity sketches.

A document is the set of its distinct word 5-shingles. In a size band the shingles are dealt by hash to p parts, and
each part keeps the XOR of its shingles' hashes: a sketch in which every shingle that two sets do not share changes one
part, so the number of differing parts is a lower bound of the symmetric difference. A link at ``PERCENT`` allows a
lower set of ``a`` shingles a symmetric difference of ``a / 4`` at most (at 80 %); with more non-empty parts than that,
one at least is equal in both (pigeonhole). Equal parts are found by their 64-bit keys. Sketches of 1,024 parity bits
then reject pairs by their Hamming distance, and the sets themselves decide.

Completeness without pairs inside large groups: each key has a pivot, the set that shares most keys with most sets, and
the first rounds verify each document with the pivot that it meets most often. Connected documents then count as one; the
last round looks at keys that still hold two components. Of r such keys of which T must be equal, the r - T + 1 rarest
hold one at least that the other set has among its own rarest (prefix filter on both sides), and only these are joined.
A key of few prefix rows pairs them. A key of many compares its sets by what they differ in from a pivot P, one for all keys
whose most popular sets are connected, so that a set has few pivots however many such keys it has: for
D(x) = x XOR P the difference of a and b is that of D(a) and D(b), so two linked sets that are not both linked with P
share half of the smaller D and more. What edits put in is rare, what they take out is less so, and what is P's own is
common; in this order a prefix and position filter on D meets few pairs in a large family. P itself is paired with each set
of another component. No key, bucket or partner is capped.

Skew: a task emits the parts of equal sets once, and pairs documents that share a key inside a batch with a local pivot
at once, so that a key reaches its task with a few rows for each batch, whatever its group's size.

Defined results: null, empty and blank texts have no shingle and link with nothing; texts of 1 to 4 words are one
shingle; equal sets are linked; rows that repeat give a row each; an empty table gives an empty result; other columns
are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfold.llm.common import batches_bounded, drop_ids, materialise, quoted, small_or_shuffled, whole_text

SHINGLE, PERCENT = 5, 80
#: Size bands grow by this ratio; below TOKEN_BAND shingles each shingle is a part of its own.
RATIO, TOKEN_BAND = 1.5625, 200
SKETCH_BITS = 1024
#: Keys that one reducing task takes; the number of tasks follows the input.
KEYS_A_TASK, LEAST_TASKS = 800_000, 64
#: Rows that a worker holds at once, and keys that it gathers before it sends them: bounds of memory, not of results.
ROWS_AT_ONCE, KEYS_AT_ONCE = 500, 300_000
#: From so many rows of one key in a batch on, the batch pairs them itself.
LOCAL_RUN = 8
#: Rounds with pivots; what they leave open, the last round decides exactly.
MOST_PIVOT_ROUNDS = 2
#: A key pairs its prefix rows where that gives at most so many pairs for each of them; else it goes by differences from its pivot.
PAIRS_A_ROW = 4
#: A difference from a pivot that a greater share of its sets have counts as common and comes last in their prefixes.
COMMON = 0.02

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x2545F4914F6CDD1D
_POWERS: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    bases = (_BASE, pow(_BASE, -1, 1 << 64))
    if n > len(_POWERS.get(_BASE, ())):
        for base in bases:
            full = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
            full[0] = 1
            _POWERS[base] = np.multiply.accumulate(full)
    return _POWERS[bases[0]], _POWERS[bases[1]]


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    b = np.frombuffer(text.lower(), np.uint8)  # bytes.lower() changes A-Z alone
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(b) + 1)
    total = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)]
    words = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _M3)
    n = min(SHINGLE, len(words))
    last = len(words) - n + 1
    h = np.full(last, n, np.uint64) * _M2
    for k in range(n):
        h = (h ^ words[k : k + last]) * _M1 + (h >> np.uint64(29))
    return np.unique(_mix(h))


def signature(s: np.ndarray) -> int:
    """One number for a set, as a signed 64-bit integer whose last bit is 0."""
    x = int(np.add.reduce(_mix(s ^ _M2), dtype=np.uint64)) ^ (len(s) * int(_M3))
    x &= (1 << 64) - 2
    return x - (1 << 64) if x >> 63 else x


def band(n: int) -> int:
    return int(math.log(n) / math.log(RATIO) + 1e-9)


def band_start(i: int) -> int:
    return math.ceil(RATIO**i - 1e-9)


def token_limit() -> int:
    """The size from which sets emit hashed parts in their own band."""
    i = 0
    while band_start(i) < TOKEN_BAND:
        i += 1
    return band_start(i)


def parts(s: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The part of each shingle in a group (None for parts of their own)."""
    p = band_start(group) // 2 + 16
    seed = np.uint64((group * 0x9E3779B97F4A7C15 + 0x51ED27) & ((1 << 64) - 1))
    h = _mix(s ^ seed)
    return h, (None if band_start(group) < TOKEN_BAND else ((h >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32))


def part_keys(s: np.ndarray, group: int) -> np.ndarray:
    """A key for every non-empty part: its number and its parity word."""
    h, part = parts(s, group)
    salt = np.uint64((group * 0xD6E8FEB86659FD93 + 0x7F4A7C15) & ((1 << 64) - 1))
    if part is None:
        return _mix(h ^ salt)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return _mix(np.bitwise_xor.reduceat(_mix(h[order]), first) ^ (part[first] * _M1) ^ salt)


def needs(s: np.ndarray) -> tuple[int, int, int]:
    """How many keys a link needs to be equal: in the set's own band as the lower set, and as the upper one; as the upper one in the band before (0 if it emits none there).

    A hashed part is spoilt by a shingle that either set has alone: (a + b) * (100 - PERCENT) / (100 + PERCENT) at most. A
    part of one shingle is spoilt only by shingles that this set has alone.
    """
    n, out = len(s), []
    for k, group in enumerate(groups_of(n)):
        _, part = parts(s, group)
        if part is None:
            held, spoilt = n, (n * (100 - PERCENT) // (100 + PERCENT), n * (100 - PERCENT) // 100)
        else:
            held = int(np.count_nonzero(np.bincount(part.astype(np.int64))))
            spoilt = tuple((n + other) * (100 - PERCENT) // (100 + PERCENT) for other in (n * 100 // PERCENT, n))
        out += [held - x for x in (spoilt if k == 0 else spoilt[1:])]
    return (*out, 0)[:3]


def groups_of(n: int) -> list[int]:
    """The groups in which a set of n shingles emits its parts: its own band, and the band before if a linked set may lie there."""
    i = band(n)
    return [i, i - 1] if i and -(-n * PERCENT // 100) < band_start(i) else [i]


def parity_bits(s: np.ndarray) -> bytes:
    """The sketch of SKETCH_BITS parity bits."""
    n = np.bincount((_mix(s ^ _M3) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((n & 1).astype(np.uint8)).tobytes()


def _bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    batches_bounded(docs.sparkSession)
    return docs.select(quoted(id_col).alias("id"), whole_text(quoted(text_col)).cast("binary").alias("text"))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), sig (of the set), low, up, before (its ``needs``)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out = []
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                out.append((len(s), signature(s), *needs(s)) if len(s) else (0,) * 5)
            a = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(a[:, k]) for k in range(5))], ["id", "n", "sig", "low", "up", "before"])

    return _bytes(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, n long, sig long, low long, up long, before long")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys in a sorted array."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return first, np.diff(np.r_[first, len(keys)])


def _met(keys: np.ndarray, sigs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row's key has ``least`` rows or more and two sets or more; whether the row is of the key's least set."""
    first, length = _runs(keys)
    node = sigs & ~np.int64(1)
    low = np.minimum.reduceat(node, first) if len(first) else node
    high = np.maximum.reduceat(node, first) if len(first) else node
    return np.repeat((length >= least) & (low != high), length), node == np.repeat(low, length)


def shared_parts(docs: DataFrame, id_col: str, text_col: str, tasks: int) -> DataFrame:
    """Parts that two or more different sets share: sig, own (in the set's own band), key; rows may repeat."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        keys, sigs, held = [], [], 0
        for batch in _pieces(batches):
            for text in batch.column("text"):
                x = shingles(text.as_py())
                if not len(x) or (sig := signature(x)) in done:
                    continue
                done.add(sig)
                for k, group in enumerate(groups_of(len(x))):
                    keys.append(part_keys(x, group).view(np.int64))
                    sigs.append(np.full(len(keys[-1]), sig | (k == 0), np.int64))
                    held += len(keys[-1])
                if held >= KEYS_AT_ONCE:
                    yield packed(np.concatenate(keys), np.concatenate(sigs))
                    keys, sigs, held = [], [], 0
        if held:
            yield packed(np.concatenate(keys), np.concatenate(sigs))

    def packed(keys: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        """The rows for each reducing task; keys that many of them share are known here already, and one row of them goes on."""
        order = np.argsort(keys)
        keys, sigs = keys[order], sigs[order]
        shared, least = _met(keys, sigs, LOCAL_RUN)
        met = np.stack([sigs[shared], keys[shared]], 1)
        keep = ~shared | least
        keys, sigs = keys[keep], sigs[keep]
        # keys are sorted, so each task's are a slice
        cuts = np.r_[0, np.searchsorted(keys, np.linspace(-(2.0**63), 2.0**63, tasks + 1)[1:-1]), len(keys)]
        pids = np.flatnonzero(np.diff(cuts))
        blobs = [np.stack([keys[cuts[p] : cuts[p + 1]], sigs[cuts[p] : cuts[p + 1]]], 1).tobytes() for p in pids]
        met_cuts = np.searchsorted(np.arange(len(met)) * tasks // max(1, len(met)), np.arange(tasks + 1))
        met_pids = np.flatnonzero(np.diff(met_cuts))
        met_blobs = [met[met_cuts[p] : met_cuts[p + 1]].tobytes() for p in met_pids]
        arrays = [pa.array(np.r_[pids, met_pids].astype(np.int32)), pa.array(blobs + [b""] * len(met_pids), pa.binary()), pa.array([b""] * len(pids) + met_blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["pid", "keys", "met"])

    def meet(group: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.int64).reshape(-1, 2)
        met = np.frombuffer(b"".join(group.column("met").to_pylist()), np.int64).reshape(-1, 2)
        order = np.argsort(rows[:, 0], kind="stable")
        keys, sigs = rows[order, 0], rows[order, 1]
        at, _ = _met(keys, sigs, 2)
        sigs, keys = np.r_[sigs[at], met[:, 0]], np.r_[keys[at], met[:, 1]]
        return pa.table({"sig": sigs & ~np.int64(1), "own": (sigs & 1).astype(bool), "key": keys})

    emitted = _bytes(docs, id_col, text_col).select("text").mapInArrow(emit, "pid int, keys binary, met binary")
    return emitted.groupBy("pid").applyInArrow(meet, "sig long, own boolean, key long")


def sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sets of ``nodes`` (sig, rep: the id of a row that has the set): sig, n, sketch, hashes.

    Rows that repeat an id and text give a set twice; the pairs made from them are made distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found = [shingles(t.as_py()) for t in batch.column("text")]
            arrays = [pa.array([signature(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([parity_bits(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["sig", "n", "sketch", "hashes"])

    rows = _bytes(docs, id_col, text_col).join(small_or_shuffled(nodes.select(F.col("rep").alias("id"))), "id", "left_semi")
    return rows.select("text").mapInArrow(run, "sig long, n long, sketch binary, hashes binary")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches do not rule a link out."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8) for c in ("sketch_a", "sketch_b"))
        na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        differing = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        keep = pa.array(differing <= (na + nb) * (100 - PERCENT) // (100 + PERCENT))
        yield batch.select(["a", "b"]).filter(keep)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        keep = []
        for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of ``pairs`` (a, b: sigs), by sketch, then by the sets."""
    side = lambda x, *cols: sets.select(F.col("sig").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    near = materialise(pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").mapInArrow(_near, "a long, b long").distinct(), "near-pairs")
    return materialise(near.join(side("a", "hashes"), "a").join(side("b", "hashes"), "b").mapInArrow(_linked, "a long, b long").distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """The connected component of every node in ``links`` (a, b): node, label (its least node).

    Each round takes the least label of the neighbours and then the label's own label; rounds end when none changes.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), "label")
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = materialise(least.join(jump, "new").select("node", F.least("new", "far").alias("label"), (F.least("new", "far") != F.col("label")).alias("changed")), "cc-labels")
        labels = after.select("node", "label")
        if after.where("changed").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n (shingles), component (the smallest id reachable by links)."""
    rows = materialise(measured(docs, id_col, text_col), "near-rows")
    nodes = materialise(rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "low", "up", "before")]), "near-classes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    links = _links(docs, nodes, total, id_col, text_col) if total else None
    if links is not None:
        labels = components(links)
        keyed = rows.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("id", "n", F.coalesce("label", "sig").alias("label"))
    else:
        keyed = rows.select("id", "n", F.col("sig").alias("label"))
    least = keyed.where("n > 0").groupBy("label").agg(F.min("id").alias("component"))
    # rows without a shingle stay alone and take no part in the join
    alone = keyed.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return keyed.where("n > 0").join(least, "label").select("id", "n", "component").unionByName(alone)


def _links(docs: DataFrame, nodes: DataFrame, total: int, id_col: str, text_col: str) -> DataFrame | None:
    shared = materialise(shared_parts(docs, id_col, text_col, max(LEAST_TASKS, math.ceil(total * 0.6 / KEYS_A_TASK))), "near-shared").distinct()
    # a set can be in a link only if enough of its parts in a band are shared at all
    size = nodes.select("sig", "n", "low", "up", "before")
    held = shared.groupBy("sig", "own").agg(F.count("*").alias("held")).join(size, "sig").where(F.col("held") >= F.when(F.col("own"), F.least("low", "up")).otherwise(F.col("before")))
    held = materialise(held, "near-held")
    lower = held.where("own and held >= low").select("sig", "own")
    if lower.isEmpty():
        return None
    low_keys = shared.join(lower, ["sig", "own"], "left_semi").select("key").distinct()
    rows = shared.join(low_keys, "key", "left_semi").join(held.drop("held"), ["sig", "own"])
    placed = materialise(rows, "near-placed")
    sets = materialise(sets_of(docs, placed.select("sig").distinct().join(nodes.select("sig", "rep"), "sig"), id_col, text_col), "near-sets")
    # a set that shares many keys with many sets is the middle of its family: it is the pivot of its keys
    counts = placed.groupBy("key").agg(F.count("*").alias("df"))
    popular = placed.join(counts, "key").groupBy("sig").agg(F.sum("df").alias("pop"))
    placed = materialise(placed.join(popular, "sig"), "near-placed")
    labelled = placed.withColumn("label", F.col("sig"))
    links = None
    for round_ in range(MOST_PIVOT_ROUNDS):
        found = verified(materialise(_pivot_pairs(labelled, round_), "near-best"), sets)
        if found.isEmpty():
            break
        links = found if links is None else materialise(links.union(found), "near-links")
        label = components(links).withColumnRenamed("node", "sig")
        labelled = materialise(placed.join(label, "sig", "left").withColumn("label", F.coalesce("label", "sig")), "near-labelled")
    prefix = materialise(_prefix_rows(labelled), "near-prefix")
    more = verified(materialise(_prefix_pairs(prefix, sets), "near-rest"), sets)
    if more.isEmpty():
        return links
    return more if links is None else links.union(more)


def _prefix_rows(labelled: DataFrame) -> DataFrame:
    """The rows that may be the first that two linked sets of different components share: sig, n, pop, label, key, lower and upper (their roles)."""
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("key", "df")
    by_set = Window.partitionBy("sig", "own")
    rows = labelled.join(open_keys, "key").withColumns({"held": F.count("*").over(by_set), "rank": F.row_number().over(by_set.orderBy("df", "key"))})
    as_upper = F.when(F.col("own"), F.col("up")).otherwise(F.col("before"))
    cut = lambda need: (F.col("held") >= need) & (F.col("rank") <= F.col("held") - need + 1)
    rows = rows.select("sig", "n", "pop", "label", "key", (F.col("own") & cut(F.col("low"))).alias("lower"), cut(as_upper).alias("upper"))
    return rows.where("lower or upper")


#: What two sets of a pair must be to each other, whatever their keys; equal sizes count once.
_FIT = f"label_a <> label_b and (n_a < n_b or n_a = n_b and a < b) and n_a * 100 >= n_b * {PERCENT}"


def _prefix_pairs(prefix: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of sets (a, b) that ``prefix`` does not rule out."""
    side = lambda x, rows, *cols: rows.select(F.col("sig").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "label")], *cols)
    count = lambda c: F.count(F.when(F.col(c), 1))
    pivot = F.max_by(F.struct("sig", "label", "pop"), F.struct("pop", "sig"))
    keys = prefix.groupBy("key").agg(count("lower").alias("lowers"), count("upper").alias("uppers"), F.min("label").alias("lo"), F.max("label").alias("hi"), pivot.alias("pivot"))
    keys = keys.where("lowers > 0 and uppers > 0 and lo <> hi").withColumn("many", F.col("lowers") * F.col("uppers") > PAIRS_A_ROW * (F.col("lowers") + F.col("uppers")))
    keys = materialise(keys.select("key", "many", F.col("pivot.sig").alias("sig_p"), F.col("pivot.label").alias("label_p"), F.col("pivot.pop").alias("pop_p")), "near-keys")
    # any set can be the pivot, so the keys whose pivots are connected have one, the most popular of them: else a set would have a pivot for each of its keys
    one = keys.where("many").groupBy("label_p").agg(F.max_by("sig_p", F.struct("pop_p", "sig_p")).alias("pivot"))
    keyed = materialise(prefix.join(keys.join(one, "label_p", "left").select("key", "pivot", "label_p", "many"), "key"), "near-keyed")
    few, many = keyed.where("not many"), keyed.where("many")
    pairs = side("a", few.where("lower"), "key").join(side("b", few.where("upper"), "key"), "key").where(_FIT).select("a", "b")
    families = materialise(many.where("sig <> pivot").select("sig", "label", "pivot", "label_p").distinct(), "near-families")
    # the rounds with pivots took others, so the pivot of a key here need not have met its sets
    with_pivot = families.where("label <> label_p").select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b"))
    apart = materialise(_apart(families, sets), "near-apart")
    part = lambda x, role: apart.where(role).select(F.col("sig").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "label", "d", "left", "linked")], "at")
    # of two sets the one whose difference from the pivot is less is the small one, so the other is not linked with the pivot
    near = f"s <> l and label_s <> label_l and least(n_s, n_l) * 100 >= greatest(n_s, n_l) * {PERCENT} and (linked_s or d_s < d_l or d_s = d_l and s < l)"
    # what is left from here on must suffice, should this be the first that the two share
    suffices = f"2 * {100 + PERCENT} * least(left_s, left_l) >= {100 + PERCENT} * (d_s + d_l) - {100 - PERCENT} * (n_s + n_l)"
    met = part("s", "small").join(part("l", "large"), "at").where(f"{near} and {suffices}").select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(with_pivot).union(met).distinct()


def _differences(families: DataFrame, sets: DataFrame) -> DataFrame:
    """What sets differ in from their pivots, as hashes of pivot and shingle: sig, label, pivot, n, m (the pivot's size), added, lost (which the pivot lacks or has alone)."""
    names = ["sig", "label", "pivot", "n", "m", "added", "lost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out = []
            for pivot, *both in zip(*(batch.column(c) for c in ("pivot", "hashes", "hashes_p")), strict=True):
                x, p = (np.frombuffer(c.as_py(), np.uint64) for c in both)
                seed = np.uint64(pivot.as_py() & ((1 << 64) - 1))
                added, lost = (_mix(np.setdiff1d(*y, assume_unique=True) ^ seed).tobytes() for y in ((x, p), (p, x)))
                out.append((len(x), len(p), added, lost))
            n, m, added, lost = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(added, pa.binary()), pa.array(lost, pa.binary())], names)

    both = families.join(sets.select("sig", "hashes"), "sig").join(sets.select(F.col("sig").alias("pivot"), F.col("hashes").alias("hashes_p")), "pivot")
    return both.select("sig", "label", "pivot", "hashes", "hashes_p").mapInArrow(run, "sig long, label long, pivot long, n long, m long, added binary, lost binary")


def _common(differences: DataFrame) -> DataFrame:
    """Per pivot the differences that more than COMMON of its sets have, the rarest first: pivot, common (their number is at most 1 / COMMON times the mean number of differences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            both = [np.frombuffer(x.as_py() + y.as_py(), np.int64) for x, y in zip(batch.column("added"), batch.column("lost"), strict=True)]
            pivot = np.repeat(batch.column("pivot").to_numpy(), [len(x) for x in both])
            yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(np.concatenate(both))], ["pivot", "at"])

    counts = differences.select("pivot", "added", "lost").mapInArrow(run, "pivot long, at long").groupBy("pivot", "at").agg(F.count("*").alias("times"))
    size = differences.groupBy("pivot").agg(F.count("*").alias("size"))
    often = counts.where("times > 2").join(size, "pivot").where(F.col("times") > COMMON * F.col("size"))
    return often.groupBy("pivot").agg(F.sort_array(F.collect_list(F.struct("times", "at"))).alias("common")).select("pivot", F.col("common.at").alias("common"))


def _apart(families: DataFrame, sets: DataFrame) -> DataFrame:
    """The prefixes of what sets differ in from their pivots: sig, n, label, d (how many differ), linked (with the pivot), small, large (roles of the row), left (how many follow, itself included), at.

    For sets x and y that are not both linked with the pivot P, say y is not: d(y) > (|y| + |P|) * w with w = (100 - PERCENT) /
    (100 + PERCENT), and a link of x and y allows them to differ in (|x| + |y|) * w, so they share (d(x) + d(y) - (|x| + |y|) * w) / 2
    of what they differ in from P at least, and that is more than (d(x) + (|P| - |x|) * w) / 2.
    """
    num, den = 100 - PERCENT, 100 + PERCENT
    names = ["sig", "n", "label", "d", "linked", "small", "large", "left", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, ROWS_AT_ONCE // 10):
            out = []
            for sig, label, n, m, added, lost, common in zip(*(batch.column(c).to_pylist() for c in ("sig", "label", "n", "m", "added", "lost", "common")), strict=True):
                added, lost = np.frombuffer(added, np.int64), np.frombuffer(lost, np.int64)
                d = len(added) + len(lost)
                linked = d * den <= (n + m) * num
                most = n * 100 // PERCENT  # the largest partner
                share = (d * den + (m - n) * num) // (2 * den) + 1
                if not linked:  # a small one that is not linked has a partner that differs from P in as many
                    share = max(share, -(-(2 * d * den - (n + most) * num) // (2 * den)))
                small = max(0, d - share + 1)
                large = 0 if linked else d - max(1, d - (n + most) * num // den) + 1
                # one order for all sets of a pivot: shingles that the pivot lacks, those that it has alone, then the common ones
                at = np.r_[np.sort(added), np.sort(lost)]
                common = np.array(common or [], np.int64)
                late = np.isin(at, common)
                at = np.r_[at[~late], common[np.isin(common, at)]][: max(small, large)]
                k = np.arange(len(at))
                fixed = [np.full(len(at), v) for v in (sig, n, label, d)]
                out.append((*fixed, np.full(len(at), linked), k < small, k < large, d - k, at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    differences = materialise(_differences(families, sets), "near-differences")
    common = materialise(_common(differences), "near-common")
    return differences.join(common, "pivot", "left").drop("pivot").mapInArrow(run, "sig long, n long, label long, d long, linked boolean, small boolean, large boolean, left long, at long")


def _pivot_pairs(labelled: DataFrame, round_: int) -> DataFrame:
    """For each set its best pivot of another component: a, b. labelled: sig, key, n, pop, label.

    A key's pivots are its most popular set and the most popular one outside that set's component; the best pivot is the
    one that a set meets in most keys. From the second round on a set's second and later choices come up by hash.
    """
    best = lambda: F.max_by(F.struct("sig", "label", "n"), F.struct("pop", "sig"))
    first = labelled.groupBy("key").agg(best().alias("p"))
    second = labelled.join(first.select("key", F.col("p.label").alias("plabel")), "key").where("label <> plabel").groupBy("key").agg(best().alias("p"))
    pivots = first.join(second.select("key", F.col("p").alias("p2")), "key").select("key", F.explode(F.array("p", "p2")).alias("p"))
    pivots = pivots.select("key", F.col("p.sig").alias("b"), F.col("p.label").alias("label_b"), F.col("p.n").alias("n_b"))
    met = labelled.join(pivots, "key").where(f"label <> label_b and least(n, n_b) * 100 >= greatest(n, n_b) * {PERCENT}")
    times = met.groupBy(F.col("sig").alias("a"), "b").agg(F.count("*").alias("times"))
    order = F.struct("times", "b") if round_ == 0 else F.struct(F.col("times") + F.pmod(F.xxhash64("a", "b", F.lit(round_)), F.lit(1 << round_)), "b")
    return times.groupBy("a").agg(F.max(order).alias("o")).select("a", F.col("o.b").alias("b"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that with the smallest id, of each component."""
    found = materialise(near_duplicates(docs, id_col, text_col), "near-result")
    return drop_ids(docs, materialise(found.where("id <> component").select(F.col("id").alias(id_col)).distinct(), "near-gone"), id_col)
