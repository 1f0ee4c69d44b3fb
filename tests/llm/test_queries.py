"""The registered queries on whole small tables, against plain Python, the library or SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from test_odd_cases import brute_components

from lanternfold.llm import decontam, exact_dedup, html_text, jaccard_join, langid, queries, sentencepiece_codec, toxicity
from lanternfold.llm.common import with_results

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def run(spark):
    return lambda name, folder=SF: queries.queries()[name](spark, folder).collect()


@pytest.fixture(scope="module")
def docs():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1_base_findings(run, docs):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", assign, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    got = {r["doc_id"]: r for r in run("op1_blob_ledger")}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        spans = sorted((m.start(), rank, kind, m.end()) for rank, (kind, pattern, fits) in enumerate(kinds) for m in pattern.finditer(text) if fits(m))
        line = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert got[i]["base_sha256"] == sha(line) and got[i]["spans"].startswith(line)
        assert [got[i][f"n_{k}"] for k, _, _ in kinds] == [sum(s[2] == k for s in spans) for k, _, _ in kinds]


def luhn(digits):
    twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def test_op6_base_findings(run, docs):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: max(map(int, m[0].split("."))) <= 255),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    got = {r["doc_id"]: r for r in run("op6_information_sanitisation")}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        spans = [(k, m.start(), m.end()) for k, pattern, fits in kinds for m in re.finditer(pattern, text) if fits(m)]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == sha(line) and got[i]["spans"].startswith(line)
        assert (got[i]["sanitised_sha256"] is None) == (got[i]["spans"] == "")


def test_op2_reads_every_page(run):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in run("op2_line_blocks")}
    assert len(got) == len(rows)
    for page, url, html in rows:
        assert got[page]["url"] == url and got[page]["text"] == html_text.main_text(html) and got[page]["n_chars"] == len(got[page]["text"])
    odd = "<main><h1>T</h1><p class='alert'>Alert text.</p><aside><p>x y z</p></aside><p>Body body body.</p></main>"
    assert html_text.main_text(odd) == "T\nBody body body."
    assert "court" in html_text.main_text('<article><p class="legal-analysis">' + "The court said so. " * 9 + "</p></article>")


def test_op3_on_held_out_documents(run):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{LARGER}/documents.parquet' WHERE lang IS NOT NULL AND regexp_matches(text, '[a-zA-Z]')").fetchall())
    got = run("op3_ftrl_ngrams", LARGER)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op4_law(run, docs):
    got = run("op4_hilbert_shards")
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs.items()}
    slots = [sorted(r["slot"] for r in got if r["shard"] == k) for k in range(40)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_op5_against_all_pairs(run, docs):
    rows = list(docs.items())
    expected = {rows[k][0]: (n, c if n else rows[k][0]) for k, (n, c) in brute_components(rows).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run("op5_parity_sketches")} == expected


def test_near_duplicates_in_a_family_around_the_threshold(spark, monkeypatch):
    """Many copies of one text with few to many edits: keys of many rows go by differences from their pivot."""
    rng = random.Random(11)
    base, rows = [f"w{k}" for k in range(150)], []
    for _ in range(130):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[f"e{rng.randrange(9)}"], [], [words[k], f"i{rng.randrange(9)}"]])
        rows.append((len(rows), " ".join(words)))
    compared = []
    apart = jaccard_join._apart
    monkeypatch.setattr(jaccard_join, "_apart", lambda families, sets: compared.append(families.count()) or apart(families, sets))
    got = {r["id"]: (r["n"], r["component"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[k][0]: v for k, v in brute_components(rows).items()}
    assert compared and compared[0] > 0


def test_op7_contract(run):
    got = run("op7_compression_distance", LARGER)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{LARGER}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    ordinary = [r["predicted"] for r in got if r["held_out"] and toxic.get(r["doc_id"]) == 0]
    assert sum(ordinary) <= 0.02 * len(ordinary)


def test_op8_is_the_library(run, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    for r in run("op8_distinct_chunks"):
        ids = [sp.bos_id(), *sp.encode(docs[r["doc_id"]]), sp.eos_id()]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(b"".join(k.to_bytes(4, "little") for k in ids)), sha(sp.decode(ids)))


def test_op9_is_its_sql(run):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()['op9_progressive_refinement']}) ORDER BY doc_id").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in run("op9_progressive_refinement")) == expected


def test_op10_finds_every_item_that_a_document_holds(run, docs):
    bare = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    got = {(r["doc_id"], r["item_id"]): r for r in run("op10_template_windows")}
    held = {(i, k) for i, t in docs.items() for k, x in items.items() if bare(x) in bare(t)}
    assert held and held <= got.keys() and all(got[p]["copied"] for p in held)
    grams = lambda t: {tuple(w[k : k + 8]) for w in (bare(t).split(),) for k in range(len(w) - 7)}
    assert all(not r["copied"] or grams(docs[i]) & grams(items[k]) for (i, k), r in got.items())


def test_columns_of_any_name_pass(spark):
    rows = [(1, "a text of some words and the rest of it " * 3, 1.5, "x", "y"), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` double, `__text` string, `__html` string")
    rest = ["doc_id", "a.b", "__text", "__html"]
    model = langid.fit([("en", *langid.counted("the words of it")), ("de", *langid.counted("die und der"))], langid.np.ones(1 << langid.HASH_BITS, int), 2)
    assert langid.identify(df, model).columns == [*rest, "lang_pred", "score"] and langid.identify(df, model).count() == 2
    assert html_text.extract(df.withColumnRenamed("text", "html")).columns == [*rest, "text", "n_chars"]
    assert sentencepiece_codec.encode_documents(df, queries.piece_model()).where("`a.b` = 1.5").count() == 1
    assert toxicity.score_documents(df, None, keep_text=True).columns == [*df.columns, "score"]
    bench = spark.createDataFrame([(1, "a text of some words and the rest of it")], "item_id long, text string")
    for left, n in ((exact_dedup.drop_exact_duplicates(df.unionByName(df)), 2), (jaccard_join.keep_one_of_each(df.unionByName(df.withColumn("doc_id", df["doc_id"] + 5))), 3), (decontam.drop_contaminated(df, bench), 1)):
        assert left.columns == df.columns and left.count() == n
    empty = with_results(df.limit(0), df["text"], ["text"], [("n", "long")], lambda: lambda texts: [])
    assert empty.columns == [*rest, "n"] and empty.count() == 0
