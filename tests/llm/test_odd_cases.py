"""Each operator on odd rows and on an empty table, against plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from lanternfold.llm import decontam, exact_dedup, html_text, jaccard_join, langid, pii, secrets, sentencepiece_codec, sharding, toxicity
from lanternfold.llm.common import scratch
from lanternfold.llm.queries import piece_model

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(odd, none, odd_rows):
    got = exact_dedup.exact_duplicates(odd, digest_all=True).collect()
    assert len(got) == len(odd_rows)
    sizes = {}
    for r in odd_rows:
        sizes.setdefault(norm(r[1]), []).append(r[0])
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(sizes)
    by_digest = {hashlib.sha256(k.encode()).digest(): v for k, v in sizes.items()}
    for r in got:
        ids = by_digest[bytes(r["digest"])]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns
    assert left.count() == len(sizes)
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def test_secrets_ledger_scans_each_blob_once(spark, odd, none):
    ledger = secrets.BlobLedger(spark, scratch(spark, "t"))
    assert ledger.scan(odd) == 0
    first = ledger.findings("base-1").count()
    assert ledger.scan(odd) == 1
    assert ledger.findings("base-1").count() == first and ledger.unscanned("base-1").isEmpty()
    got = {r["doc_id"]: r for r in secrets.secret_digest(ledger.by_path(run=0)).collect()}
    text = 'mail a.b@mail1.example.com or c_d@e.f, token = "abcdef0123456789abcdef0123456789"'
    a, h = ASSIGN.search(text), re.search("[0-9a-f]{24,}", text)
    line = f"assign:{a.start()}:{a.end()},hex:{h.start()}:{h.end()}"
    assert got[11]["spans"] == line and got[11]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
    assert got[1]["spans"] == "" and got[1]["n_hex"] == 0
    empty = secrets.BlobLedger(spark, scratch(spark, "t"))
    empty.scan(none)
    assert empty.by_path().count() == 0


def test_a_new_rule_version_scans_old_blobs_and_unscanned_pairs_show(spark):
    ledger = secrets.BlobLedger(spark, scratch(spark, "t"))
    key = "-----BEGIN RSA PRIVATE KEY-----"
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    ledger.scan(docs((1, f"see {key} here"), (2, "token: abcdefgh")))
    assert [r["spans"] for r in ledger.by_path("formats-1").collect()] == [None, None]
    assert ledger.unscanned("formats-1").count() == 2
    ledger.scan_blobs("formats-1")
    spans = lambda version: {r["id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in ledger.by_path(version).collect()}
    assert spans("formats-1") == {1: [("pem", 4, 4 + len(key))], 2: []}
    # a later batch scans its new blobs alone, and a batch of known blobs none
    ledger.add(docs((3, f"{key} again")))
    assert [r["text"] for r in ledger.unscanned("formats-1").collect()] == [f"{key} again"]
    ledger.scan(docs((4, f"{key} again"), (5, f"see {key} here")), "formats-1")
    assert {k: len(v) for k, v in spans("formats-1").items()} == {1: 1, 2: 0, 4: 1, 5: 1}
    assert {r["id"]: r["spans"] is None for r in ledger.by_path("base-1").collect()} == {1: False, 2: False, 4: True, 5: False}
    digest = {r["doc_id"]: r["spans"] for r in secrets.secret_digest(ledger.by_path("base-1", run=0), ledger.findings("formats-1")).collect()}
    assert digest == {1: f"pem:4:{4 + len(key)}", 2: "assign:0:15"}


def test_personal_data(spark, odd, none):
    got = {r["doc_id"]: r for r in pii.personal_digest(pii.personal_data(odd)).collect()}
    assert got[11]["n_email"] == 2 and got[11]["spans"].startswith("email:5:")
    assert got[1]["spans"] == "" and got[10]["n_card"] == 0
    assert pii.personal_data(none).count() == 0


def test_disclosing_terms_become_spans(spark):
    rows = [(i, f"text number{chr(97 + i)} Zorblatt writes from z@zorb.example.com about things {chr(98 + i) * 5}") for i in range(4)]
    rows += [(10 + i, f"about things and other words {chr(97 + i) * 6}") for i in range(20)] + [(50, "Later zorblatt was seen alone.")]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"] for r in pii.personal_digest(found).collect()}
    assert got[50] == "" or got[50].startswith("term:6:")
    assert all("term:" in got[i] for i in range(4))
    assert "things" not in "".join(got[10 + i] for i in range(20))
    text = spark.createDataFrame(rows, "id long, text string").join(found, "id").select(pii.sanitised(F.col("text"), F.col("spans")).alias("x"), "id")
    assert "z@zorb" not in {r["id"]: r["x"] for r in text.collect()}[0]


def test_shards(odd, none, odd_rows):
    rows = sharding.shard_documents(odd, shards=4).collect()
    assert len(rows) == len(odd_rows)
    per = {}
    for r in rows:
        per.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert sharding.shard_documents(none).count() == 0


def test_hilbert_curve_steps_to_neighbours(spark):
    for dims in (2, 3):
        rows = sorted((r["place"], *[r[f"d{k}"] for k in range(dims)]) for r in sharding.hilbert_curve(spark, dims, 3).collect())
        assert [r[0] for r in rows] == list(range(8**dims))
        assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:], strict=True)) == 1 for x, y in zip(rows, rows[1:], strict=False))


def brute_components(rows):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    out = {}
    for k, (i, _) in enumerate(sets):
        out.setdefault(root(k), []).append(i)
    return {k: (len(sets[k][1]), min((i for i in out[root(k)] if i is not None), default=None)) for k in range(len(sets))}


def test_near_duplicates(spark, odd, none, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = sorted(((r["id"], r["n"], r["component"]) for r in jaccard_join.near_duplicates(odd).collect()), key=repr)
    expected = sorted(((rows[k][0], n, c if n else rows[k][0]) for k, (n, c) in brute_components(rows).items()), key=repr)
    assert got == expected
    assert jaccard_join.near_duplicates(none).count() == 0


def test_near_duplicates_on_random_edits(spark):
    import random

    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(25):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([6, 20, 90, 400]))]
        for _ in range(rng.randint(1, 8)):
            text = [x if rng.random() > rng.choice([0, 0.01, 0.03]) else f"e{rng.randint(0, 99)}" for x in base][: len(base) - rng.randint(0, len(base) // 12)]
            rows.append((n, " ".join(text)))
            n += 1
    got = {r["id"]: (r["n"], r["component"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[k][0]: v for k, v in brute_components(rows).items()}


def test_codec_is_the_library(odd, none, odd_rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    codec = sentencepiece_codec.ChunkCodec(piece_model())
    assert codec.chunked
    texts = [r[1] or "" for r in odd_rows] + [" ", "  a", "a ", "\n", " \n ", "a\n\nb", "▁", "▁▁x▁ y", "\t x\r\n", "<s> </s> <0x0A>"]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == sp.encode(text, add_bos=True, add_eos=True), text[:40]
        assert codec.decode(ids) == sp.decode(ids)
    got = sentencepiece_codec.encode_documents(odd, piece_model(), keep_ids=True)
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()}[1] == 2
    assert sentencepiece_codec.encode_documents(none, piece_model()).count() == 0


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "Bob has 12 apples and gives 5 apples to Ann before lunch, so how many apples are left with Bob now?"), (2, None), (3, "short one"), (4, "")], "item_id long, text string")
    ask = "has {} apples and gives {} apples to {} before lunch, so how many apples are left with {} now?"
    docs = spark.createDataFrame(
        [(1, "words first. Bob " + ask.format(12, 5, "Ann", "Bob") + " words after"), (2, "words first. Sam " + ask.format(33, 7, "Eve", "Sam") + " more"), (3, "words first. Sam " + ask.format(33, 7, "Eve", "Tom") + " more"), (4, "apples and lunch and nothing else"), (5, None), (6, "this short one here")],
        "doc_id long, text string",
    )
    got = {(r["id"], r["item"]): r["copied"] for r in decontam.contaminated(docs, items).collect()}
    assert got[1, 1] and got[2, 1] is False
    assert (4, 1) not in got and (5, 1) not in got and (6, 3) in got
    left = decontam.drop_contaminated(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} <= {3, 4, 5}
    assert decontam.contaminated(none, items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.contaminated(odd, items).count() == 0


def test_decontamination_of_edited_copies(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten eleven twelve some more words".split()
    short, ask = item[:15], "has {} apples and gives 5 km of rope to {} before lunch so that {} is left with {} when it is all over now"
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short[::-1])), (3, "then Bob " + ask.format(12, "Ann", "Bob", "rope"))], "item_id long, text string")
    put = lambda words, k: " ".join(["before", "it", *words[:k], "inserted", *words[k:], "after", "it"])
    rows = [(100 + k, put(item, k)) for k in range(1, 39)] + [(200 + k, put(short[::-1], k)) for k in range(1, 15)] + [(300, "x " + " ".join(item[:19] + item[20:]))]
    again = ask.replace("5 km", "7")
    rows += [(400, "then Sam " + again.format(33, "Mary Ann", "Sam", "rope")), (401, "then Sam " + again.format(33, "Mary Ann", "Tom", "rope")), (500, " ".join(item[:3] + ["other"] + item[30:34]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["id"], r["item"]): r["copied"] for r in decontam.contaminated(docs, items).collect()}
    assert all(got.get((100 + k, 1)) for k in range(1, 39)) and got[300, 1]
    assert all(got.get((200 + k, 2)) for k in range(1, 15))
    assert got[400, 3] is False and (401, 3) not in got and not [k for k in got if k[0] == 500]


def test_decontamination_of_names_numbers_and_other_case(spark):
    texts = ["see Anna Berg, Carl Dorn, Emil Falk, Gerd Hahn, Ida Jung", "5 km 7 kg 9 m 12 s 14 h 3 t", "The old Mill of Ulm stands by the River Aar and the Town of Bern keeps its Key", "Paris Rome Oslo"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(10 * k + n, f"the text says: {change(x)}. And so on") for k, x in enumerate(texts) for n, change in enumerate((str, str.lower, str.upper))]
    docs = spark.createDataFrame([*rows, (90, "the old town keeps 5 km and Rome")], "doc_id long, text string")
    got = {(r["id"], r["item"]) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(i, i // 10) for i, _ in rows}


def test_decontamination_of_a_long_part(spark):
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    docs = spark.createDataFrame([(1, "some text " + " ".join(words[100:140]) + " other text"), (2, " ".join(words[100:112]))], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert [(r["id"], r["matched"], r["windows"]) for r in got] == [(1, 33, 393)]


def test_language_model(spark, odd, none):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are in the house with the man", "en"), ("der hund und die katze sind in dem haus mit dem mann", "de"), ("le chien et le chat sont dans la maison avec un homme", "fr")] * 12)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("the dog is with the cat")[0] == "en" and model.predict("die katze und der hund")[0] == "de"
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert got[1]["lang_pred"] == "und" and got[3]["lang_pred"] == "und" and 0 < got[6]["score"] <= 1
    assert langid.identify(none, model).count() == 0
    blank = langid.train(none)
    assert blank.predict("the dog") == ("und", 0.0)


def test_toxicity(spark, odd, none):
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdeinorstu") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    plain = lambda: [rng.choice(vocabulary) for _ in range(60)]
    rows, labels = [], []
    for i in range(240):
        w = plain()
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["blockhead", "numbskull", "dunderpate"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id < 180"), marks.where("doc_id < 180"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs.where("doc_id >= 180"), model).collect()}
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in got)
    assert right >= 0.9 * len(got)
    odd_scores = toxicity.score_documents(odd, model)
    assert odd_scores.columns.count("score") == 1 and all(0 <= r["score"] <= 1 for r in odd_scores.collect())
    assert toxicity.score_documents(none, model).count() == 0
    assert toxicity.train(none, marks) is None and toxicity.score_documents(docs, None).where("score <> 0").count() == 0


PAGE = """<html><head><title>T</title><script>if (a < b) { x("<p>no</p>") }</script></head><body><header><p>Site name and a long line about the site</p></header>
<nav class="menu"><a href="/a">One</a> <a href="/b">Two</a></nav><div id="wrap"><div class="post"><h1>A title</h1><p>Short.</p>
<p>The first long paragraph has a <a href="x">link</a>, an &amp;, and enough words to be the main text.</p><p>The second long paragraph goes on with enough words to be the main text.</p><p>End.</p></div>
<div class="sidebar"><p>A sidebar with a long line that is not part of the main text at all.</p></div><div class="comments"><p>A reader says a long thing about the text that nobody asked for here.</p></div></div>
<form><p>Subscribe to our long letter with many words here</p></form><footer><p>Copyright and other long words at the end of the page</p></footer></body></html>"""


def test_main_text(spark):
    expected = "A title\nShort.\nThe first long paragraph has a link, an &, and enough words to be the main text.\nThe second long paragraph goes on with enough words to be the main text.\nEnd."
    assert html_text.main_text(PAGE) == expected
    assert html_text.main_text(PAGE.replace('<div class="post">', "<article>").replace("<p>End.</p></div>", "<p>End.</p></article>")) == expected
    for page in (None, "", "<html></html>", "<", "<a", "<!--", "<script>x", "&#0;&#x110000;&bogus;"):
        html_text.main_text(page)
    assert html_text.main_text("<article><p>a&nbsp;b<br>c</p>tail</article>") == "a b c\ntail"
    rows = spark.createDataFrame([(1, None, "u"), (2, PAGE, "u")], "page_id long, html string, text string")
    assert {r["page_id"]: r["n_chars"] for r in html_text.extract(rows).collect()} == {1: 0, 2: len(expected)}


def test_holders_do_not_replace_line_blocks():
    para = "<p>This paragraph number {} has more than enough words to be a part of the main text of the page.</p>"
    text = lambda k: re.sub("<.*?>", "", para.format(k))
    body = "".join(para.format(k) for k in range(12))
    # the body is in a div, and a small article is a teaser
    page = f"<html><body><div class='x'>{body}</div><article><p>Read this too.</p></article></body></html>"
    assert [text(k) for k in range(12)] == html_text.main_text(page).split("\n")[:12]
    # several articles are one page, whatever their lengths
    parts = [range(0, 6), range(6, 8), range(8, 12)]
    page = "<html><body><main>" + "".join("<article>" + "".join(para.format(k) for k in p) + "</article>" for p in parts) + "</main></body></html>"
    assert html_text.main_text(page).split("\n") == [text(k) for k in range(12)]
    # an article with most of the text keeps what is outside it out
    page = f"<html><body><p>Some words that stand before the article and are longer than the surge.</p><article>{body}</article></body></html>"
    assert html_text.main_text(page).split("\n") == [text(k) for k in range(12)]


def test_letters_above_the_basic_plane():
    assert langid.counted("\U0001f600 \U0001f680\U0001f600 12")[0].size == 0
    plain, marked = langid.counted("the dog"), langid.counted("the \U0001f600 dog")
    assert plain[0].tolist() == marked[0].tolist() and plain[1].tolist() == marked[1].tolist()
    assert langid.counted("\U00010400\U00010401")[0].size > 0 and langid.counted("\uffff")[0].size == 0


def test_terms_far_from_the_entity_and_short_ones_disclose(spark):
    filler = " ".join(f"word{chr(97 + k % 26)}" for k in range(40))
    rows = [(i, f"kim {filler} mails z@zorb.example.com {filler} number{chr(97 + i)} zorblatt") for i in range(4)]
    rows += [(10 + i, f"{filler} mails other words {chr(97 + i) * 6}") for i in range(40)] + [(60, "so zorblatt9 and kim9 are other words")]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.personal_digest(found).collect()}
    text = dict(rows)
    for i in range(4):
        assert {text[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in got[i]) if k == "term"} == {"kim", "zorblatt"}
    assert all(got[i] == [""] for i, _ in rows[4:])


def test_the_last_round_alone_decides_pairs_with_a_keys_pivot(spark, monkeypatch):
    import random

    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):  # few of them are linked with the base, and of the others none with one another
        text = list(base)
        for k in range(1 + 2 * (i > 3)):
            text[rng.randrange(20 * k, 20 * k + 20)] = f"e{i}x{k}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(jaccard_join, "MOST_PIVOT_ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "PAIRS_A_ROW", 0)  # every key goes by differences
    got = {r["id"]: (r["n"], r["component"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) > 30 and sum(c == 0 for _, c in got.values()) > 2


def test_keys_of_connected_pivots_have_one(spark, monkeypatch):
    import numpy as np

    part = lambda a, b: list(range(a, b))
    sets = {1: part(0, 100), 2: part(1, 101)} | {10 + i: part(0, 98) + [1000 + i, 2000 + i] for i in range(12)}
    rows = [(sig, 100, 1000 if sig < 3 else 1, 1 if sig < 3 else sig, key, True, True) for sig in sets for key in (7, 8) if sig != (2, 1)[key - 7]]
    prefix = spark.createDataFrame(rows, "sig long, n long, pop long, label long, key long, lower boolean, upper boolean")
    held = spark.createDataFrame([(sig, bytearray(np.array(s, np.uint64).tobytes())) for sig, s in sets.items()], "sig long, hashes binary")
    families, apart = [], jaccard_join._apart
    monkeypatch.setattr(jaccard_join, "_apart", lambda f, s: families.append(f) or apart(f, s))
    pairs = {tuple(r) for r in jaccard_join._prefix_pairs(prefix, held).collect()}
    assert families[0].where("sig >= 10").count() == 12  # not one for each of the two keys
    assert {(2, 10 + i) for i in range(12)} <= pairs


def test_one_of_each_family_stays_by_the_last_round_alone(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"e{i}" if i and k == 4 * i else w for k, w in enumerate(base))) for i in range(14)]
    monkeypatch.setattr(jaccard_join, "MOST_PIVOT_ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "PAIRS_A_ROW", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in jaccard_join.keep_one_of_each(docs).collect()] == [0]
