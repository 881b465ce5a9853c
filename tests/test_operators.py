"""DataFrame operators on small fixtures."""

import json
import math
import urllib.request
import zipfile
from threading import Thread

import pytest
from pyspark.sql import functions as F

from clausemill import api
from clausemill.functions import kernels as K
from clausemill.functions import text as T
from clausemill.kernels import annotate, clean
from clausemill.operators import corpus, evaluate, extract, search, subwords, tagging
from clausemill.plans.pipelines import PIPELINES
from clausemill.sources import pages, readers
from clausemill.streaming import ingest

DOCS = [(1, "a b a c"), (2, "b a"), (3, "c c c"), (4, None), (5, "")]


def split(text):
    return text.split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def postings(docs):
    return search.build_index(corpus.tokens(docs, T.whitespace_tokens)).cache()


def hits(postings, docs, query):
    return [r["doc_id"] for r in search.search(postings, docs.select("doc_id"), query, split).orderBy("rank").collect()]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("a", {1, 2}), ("a b", {1}), ("b a", {1, 2}), ("a b a c", {1}), ("c c", {3}), ("c c c", {3}), ("c c c c", set()), ("a c b", set()), ("a AND c", {1}), ("a OR c", {1, 2, 3}), ("NOT a", {3, 4, 5}), ("NOT NOT a", {1, 2}),
        ("c NOT a", {3}), ("a NOT OR c", {1, 2, 4, 5}), ("zzz", set()), ("NOT zzz", {1, 2, 3, 4, 5}), ("", set()), ('""', set()), ('NOT ""', {1, 2, 3, 4, 5}), ('"a" "c"', {1}),
    ],
)
def test_search(docs, postings, query, want):
    got = hits(postings, docs, query)
    assert set(got) == want and len(got) == len(want)


def test_rank(docs, postings):
    a, c = math.log(5 / 2), math.log(5 / 2)
    rows = {r["doc_id"]: r["score"] for r in search.search(postings, docs.select("doc_id"), "a OR c NOT b", split).collect()}
    assert set(rows) == {1, 2, 3} and rows[3] == pytest.approx((1 + math.log(3)) * c)
    assert rows[1] == pytest.approx((1 + math.log(2)) * a + c + math.log(5 / 2)) and rows[2] == pytest.approx(a + math.log(5 / 2))  # negated terms count, too
    assert hits(postings, docs, "NOT a") == [3, 4, 5]  # equal scores in order of id


def test_batch_is_each(docs, postings):
    queries = {"x": "a", "y": "NOT b", "z": "c OR a b"}
    both = search.search_all(postings, docs.select("doc_id"), queries, split)
    for name, q in queries.items():
        assert [r["doc_id"] for r in both.where(F.col("query_id") == name).orderBy("rank").collect()] == hits(postings, docs, q)


def test_index_forms(spark, postings, tmp_path):
    rows = {r["term"]: json.loads(r["json"]) for r in search.index_json(postings).collect()}
    assert rows["a"] == {"df": 2, "postings": {"1": [0, 2], "2": [1]}} and list(rows) == sorted(rows)
    assert {r["doc_id"]: r["terms"] for r in search.token_stream(postings).collect()} == {1: ["a", "b", "a", "c"], 2: ["b", "a"], 3: ["c"] * 3}
    cut = [json.loads(r["json"]) for r in search.index_json(postings, 3).where("term = 'b'").collect()]
    assert all(c["df"] == 2 for c in cut) and {d: p for c in cut for d, p in c["postings"].items()} == rows["b"]["postings"]
    search.write_index_json(postings, str(tmp_path / "j"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert {x.pop("term"): x for x in lines} == rows
    search.write_index(postings, str(tmp_path / "i"))
    plan = spark.read.parquet(str(tmp_path / "i")).where("term in ('a', 'b')")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan


def test_lines(spark):
    text = "HDR\n this line is as wide as the others here \ngoes on\nHDR\nEnd.\nHDR\nNext Pvt.\nand more"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert [(r["line"], r["n"]) for r in corpus.repeated_lines(df).collect()] == [("HDR", 3)]
    left = {r["doc_id"]: r["text"] for r in corpus.drop_repeated_lines(df).collect()}
    want = clean.drop_headers([x.strip() for x in text.split("\n")])
    assert left == {1: "\n".join(want), 2: ""}
    joined = corpus.rejoin_lines(corpus.lines(corpus.drop_repeated_lines(df))).where("doc_id = 1").orderBy("paragraph_no").collect()
    assert [r["paragraph"] for r in joined] == clean.rejoin(want)


def test_native_cleaning_is_the_kernels(spark):
    texts = ["Page 1 of 2\n12\n1. one\na) two\n(b) three\nv) four", "x\n 1)\n\nnext\n2.\n\n\nmore", "a\r\n3) b\n\u2003 page\u00a07 \n\t12\u2009\nc\u20284. d", "\n\n page 1\n\n 5 \n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["t"] for r in df.select(T.drop_labels(T.drop_number_lines(T.drop_page_lines(F.col("text")))).alias("t")).collect()]
    assert got == [clean.drop_layout(t) for t in texts]
    assert df.select(T.normalise_numbers(F.lit("6 (six) months")).alias("n")).first()["n"] == "6 months"


def test_ngrams(spark):
    s = spark.createDataFrame([(1, 0, ["a", "b", "a", "b"]), (1, 1, ["b"]), (2, 0, [])], "doc_id long, sent_id int, words array<string>")
    grams = corpus.ngram_counts(s)
    assert {(r["n"], tuple(r["gram"])): r["frequency"] for r in grams.where("n <= 2").collect()} == {(1, ("a",)): 2, (1, ("b",)): 3, (2, ("a", "b")): 2, (2, ("b", "a")): 1}
    totals = {r["n"]: r["total"] for r in corpus.ngram_summary(grams).collect()}
    assert totals == {1: 5, 2: 3, 3: 2, 4: 1}
    assert [r["ngram"] for r in corpus.top_ngrams(grams, s, 1).orderBy("n").collect()] == ["b", "a b", "a b a", "a b a b"]


def test_statistics(docs):
    rows = {r["doc_id"]: tuple(r)[1:] for r in corpus.document_statistics(docs).collect()}
    assert rows[None] == (3, 9, 15, 3) and rows[1] == (1, 4, 7, 3) and rows[4] == (0, 0, 0, 0)


def test_evaluation(spark):
    q = spark.createDataFrame([(x,) for x in "abcde"], "query_id string")
    ranked = spark.createDataFrame([("a", d, d) for d in range(1, 8)] + [("b", 9, 1), ("d", 1, 1)], "query_id string, doc_id long, rank int")
    relevant = spark.createDataFrame([("a", 1), ("a", 7), ("a", 99), ("b", 1), ("c", 1), ("a", 1)], "query_id string, doc_id long")
    got = {r["query_id"]: tuple(r)[1:] for r in evaluate.precision_recall(ranked, relevant, q).collect()}
    assert got["a"] == (3, 7, pytest.approx(2 / 7), pytest.approx(2 / 3), pytest.approx(0.4), pytest.approx(0.2), pytest.approx(1 / 3))
    assert got["b"] == (1, 1, 0, 0, 0, 0, 0) and got["c"] == (1, 0, 0, 0, 0, 0, 0) and got["d"] == (0, 1, 0, None, None, 0, None) and got["e"] == (0, 0, 1, None, None, 1, None)
    avg = evaluate.averages(spark.createDataFrame([("t", 1.0), ("t", float("nan")), ("t", None)], "type string, precision double"), "type", ("precision",))
    assert avg.first()["precision"] == 1.0


def test_selection_and_judgements(spark):
    m = spark.createDataFrame([("A", 0, 0.9, 10, 2, 5), ("B", 1, 0.9, 12, 1, 1), ("C", 2, 0.5, 14, 3, 9)], "pipeline string, ord int, f1 double, domain_terms int, negations int, meaningful_ngrams int")
    assert [(r["pipeline"], r["tied"]) for r in evaluate.select_pipeline(m).orderBy("place").collect()] == [("B", True), ("A", True), ("C", False)]
    manual = spark.createDataFrame([("q1", 1)], "query_id string, doc_id long")
    other = spark.createDataFrame([("q1", 2), ("q2", 3)], "query_id string, doc_id long")
    assert {tuple(r) for r in evaluate.with_judgements(manual, other, None).collect()} == {("q1", 1, "manual"), ("q2", 3, "PROVISIONAL")}
    table = evaluate.pivoted(m, ("f1", "negations"), "pipeline", ["A", "B", "C"])
    assert {r["measure"]: (r["A"], r["C"]) for r in table.collect()} == {"f1": (0.9, 0.5), "negations": (2.0, 3.0)}
    one = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("p", 1, 1)], "query_id string, doc_id long, rank int")
    two = spark.createDataFrame([("q", 2, 1), ("q", 1, 2), ("p", 1, 1)], "query_id string, doc_id long, rank int")
    assert [r["query_id"] for r in evaluate.changed_results(one, two).collect()] == ["q"]


def test_entities(spark):
    text = "Pay Rs. 5,000 to the Senior Software Engineer on 01/04/2026 under Section 27 for 6 months."
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = [(r["label"], r["text"]) for r in extract.entities(df).orderBy("start").collect()]
    assert got == [("MONEY", "Rs. 5,000"), ("DESIGNATION", "Senior Software Engineer"), ("DATE", "01/04/2026"), ("LAW", "Section 27"), ("DURATION", "6 months")]
    model = spark.createDataFrame([(1, 0, 5, "ORG"), (1, 200, 210, "GPE"), (2, 0, 9, "ORG")], "doc_id long, start int, end int, label string")
    merged = extract.merge_entities(model, extract.entities(df))
    assert {(r["doc_id"], r["label"]) for r in merged.collect()} >= {(1, "GPE"), (2, "ORG")} and merged.where("label = 'ORG' and doc_id = 1").count() == 0
    numbers = {r["doc_id"]: tuple(r)[1:] for r in extract.numeric_profile(df).collect()}
    assert numbers == {1: (1, 1, 1, 1), 2: (0, 0, 0, 0)}
    gold = spark.createDataFrame([(1, "Rs. 5,000", "MONEY"), (1, "x", "ORG")], "sent_id long, text string, label string")
    predicted = extract.entities(df).select(F.col("doc_id").alias("sent_id"), "text", "label", F.col("start").alias("ord"))
    s = evaluate.entity_scores(predicted, gold).first()
    assert (s["gold"], s["correct"], s["spurious"], s["missed"], s["precision"], s["recall"]) == (2, 1, 4, 1, 0.2, 0.5)
    assert {r["text"]: (r["model"], r["model_correct"]) for r in evaluate.entity_table(gold, {"model": predicted}).collect()} == {"Rs. 5,000": ("MONEY", True), "x": ("(missed)", False)}
    inventory = extract.entity_inventory(predicted, spark.createDataFrame([("Section 27", "B", 2), ("Section 27", "A", 1)], "text string, label string, ord int"))
    assert {r["text"]: r["default_label"] for r in inventory.collect()}["Section 27"] == "A"


def test_obligations(spark):
    text = "The Employee shall not disclose the confidential data. The Company may terminate the agreement. Nobody must."
    found = extract.obligations(extract.annotations(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("sent_id").collect()
    assert [(r["subject"], r["modal"], r["verb"], r["object"], r["type"]) for r in found] == [
        ("The Employee", "shall", "disclose", "the confidential data", "PROHIBITION"), ("The Company", "may", "terminate", "the agreement", "RIGHT"),
    ]


def test_morphology(spark, docs):
    rows = {r["stemmer"]: r for r in extract.stemming_tests(spark).collect()}
    assert set(rows) == {"porter", "snowball", "lancaster"} and extract.best_stemmer(extract.stemming_tests(spark)).count() == 1
    order = {r["order"]: r for r in extract.stop_word_order(spark.createDataFrame([("this",), ("was",), ("data",)], "term string")).collect()}
    assert order["stop words, then stems"]["tokens"] == 1 and order["stems, then stop words"]["surviving"] > 0
    kept = extract.stop_word_meaning(spark, ["He shall not go"]).first()
    assert "not" not in kept["general"].split() and {"shall", "not"} <= set(kept["custom"].split())
    pairs = spark.createDataFrame([("p", "s", "x", 3), ("p", "s", "y", 1), ("p", "s", "y", 5), ("p", "s", "x", 2), ("p", "t", "z", 9)], "pipeline string, surface string, lemma string, ord int")
    assert {r["surface"]: r["lemma"] for r in corpus.lemma_map(pairs).collect()} == {"s": "y", "t": "z"}
    assert extract.lemma_table(spark, ["employees", "paid"]).count() == 2


def test_pipeline_invariants(spark):
    texts = spark.createDataFrame([(1, "The Employee shall not go. He may stay on 6 (six) days notice."), (2, None), (3, "Salary of ₹5,000 is paid.")], "doc_id long, text string")
    words = extract.pipeline_tokens(texts).cache()
    table = {r["pipeline"]: r for r in extract.pipeline_table(words).collect()}
    flat = extract.flat_tokens(words).cache()
    for name in PIPELINES:
        own = flat.where(F.col("pipeline") == name)
        assert own.count() == table[name]["token_count"] and own.select("term").distinct().count() == table[name]["vocabulary"]
        totals = {r["n"]: r["total"] for r in corpus.ngram_summary(corpus.ngram_counts(words.where(F.col("pipeline") == name))).collect()}
        assert totals[1] - totals.get(2, 0) == words.where(F.col("pipeline") == name).count()
        assert all(totals[n] >= totals[n + 1] for n in totals if n + 1 in totals)
    lemmas = corpus.lemma_map(extract.surface_lemmas(texts, "Final Pipeline"))
    assert {r["surface"]: r["lemma"] for r in lemmas.collect()}["paid"] == "pay"


def test_subwords(spark, docs):
    pieces = spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], "piece string, n long")
    merges = subwords.learn_merges(pieces, vocabulary=30)
    assert merges[:3] == [("e", "s"), ("es", "t"), ("l", "o")]
    rank = {p: i for i, p in enumerate(merges)}
    assert subwords.split_word("lowest", rank) == ["low", "est"]
    table = subwords.subword_table(spark.createDataFrame([("low",)], "word string"), spark.createDataFrame([("zq",)], "word string"), merges)
    rows = table.orderBy("number").collect()
    assert rows[0]["category"] == "common" and rows[0]["n_subwords"] == 1 and rows[1]["n_subwords"] == 2 and len(rows) == 14
    assert subwords.mean_subwords(table).count() == 3


def test_subwords_of_all_pieces(spark, docs):
    pieces = subwords.pre_tokens(docs).limit(400).cache()
    rare = pieces.unionByName(spark.createDataFrame([(f"{a}zqzq{b}", 1) for a in "bcdfg" for b in "hjklm"], "piece string, n long"))
    whole = subwords.learn_merges(rare, vocabulary=150)
    assert ("z", "q") in whole and whole == subwords.learn_merges(rare, vocabulary=150, most_pieces=5)


def test_next_merges():
    assert subwords.next_merges([(("a", "b"), 9), (("c", "d"), 8), (("b", "e"), 7), (("x", "y"), 6)], set("abcdexy"), 99) == [("a", "b"), ("c", "d")]
    assert subwords.next_merges([(("a", "b"), 9), (("c", "d"), 8), (("e", "f"), 8), (("f", "c"), 8)], set("abcdef"), 99) == [("a", "b")]
    assert subwords.next_merges([(("a", "b"), 9), (("c", "d"), 8), (("e", "f"), 5)], set("abcdef"), 7) == [("a", "b")]


def test_subword_table_is_the_reference_size(spark, small, monkeypatch):
    from clausemill.plans import registry

    asked, learn = [], subwords.learn_merges
    monkeypatch.setattr(subwords, "learn_merges", lambda pieces, **k: asked.append(k) or learn(pieces, vocabulary=60))
    registry.subword_table(spark, small)
    assert asked == [{"vocabulary": 2000}]


def test_tagger(spark):
    sentences = ["the employee shall sign the agreement", "the company may claim the bond", "he shall not release the notice", "the worker must pay the company"]
    rows = [(n, i, w, t, 1.0) for n, s in enumerate(sentences) for i, (w, t) in enumerate(zip(s.split(), annotate.tag_domain(s.split())))]
    rows += [(0, 99, "*", "-NONE-", 1.0)]
    tagged = spark.createDataFrame(rows, "sent_id int, pos int, word string, tag string, weight double")
    model = tagging.train_tagger(tagged, weight="weight", hashed=1 << 10, iterations=60)
    got = tagging.apply_tagger(model, tagging.without_traces(tagged).select("sent_id", "pos", "word"))
    both = got.join(tagged.select("sent_id", "pos", F.col("tag").alias("gold")), ["sent_id", "pos"]).select(F.lit("ml").alias("tagger"), "gold", "predicted", tagging.is_domain(F.col("word")).alias("is_domain"))
    score = evaluate.tagging_accuracy(both).first()
    assert score["accuracy"] > 0.9 and score["domain_accuracy"] > 0.9


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo \xff".encode("latin-1") + b" ok")
    (tmp_path / "b.HTML").write_text("<p>One</p><script>no</script><b>Two &amp; 3</b>")
    (tmp_path / "c.json").write_text(json.dumps({"k": ["x", 1, {"y": "z", "b": True}]}))
    (tmp_path / "d.csv").write_text("h1,h2\na,\nb,c\n")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.exe").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "g.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Pa</w:t></w:r><w:r><w:t>ra</w:t></w:r></w:p><w:p/></w:body></w:document>')
    rows = {r["file"]: r for r in readers.read_documents(readers.scan_folder(spark, str(tmp_path))).collect()}
    assert "f.exe" not in rows and [rows[f]["doc_id"] for f in sorted(rows)] == [f"D{i:02d}" for i in range(1, 7)]
    assert {f: r["text"] for f, r in rows.items()} == {"a.txt": "hllo  ok", "b.HTML": "One\nTwo & 3", "c.json": "x\nz", "d.csv": "a \nb c", "e.pdf": None, "g.docx": "Para\n"}
    assert "NotImplementedError" in rows["e.pdf"]["error"] and rows["a.txt"]["is_short"]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none/x.exe").write_bytes(b"")
        readers.scan_folder(spark, str(tmp_path / "none"))


def test_pages(spark):
    def open_pages(kind, data):
        if data == b"bad":
            raise ValueError("no such file")
        return [pages.Page("a text layer that is long enough to be read", "img1"), pages.Page(" short ", "img2"), pages.Page("short, no image"), pages.Page("", "broken")]

    def load():
        def run(image):
            if image == "broken":
                raise RuntimeError("unreadable")
            return [(10.0, 0.0, 8.0, "Pay", 0.9), (10.0, 50.0, 8.0, "5,00,000/-", 0.7)]

        return run

    def cannot():
        raise ImportError("no engine")

    files = spark.createDataFrame([("D01", "pdf", b"x"), ("D02", "pdf", b"bad")], "doc_id string, format string, content binary")
    got = [tuple(r)[1:] for r in pages.read_pages(files, open_pages, load).orderBy("page_no").collect()]
    assert got == [
        (1, "a text layer that is long enough to be read", False, False, None, 0, 0), (2, "Pay ₹5,00,000/-", True, False, pytest.approx(80), 1, 0),
        (3, "short, no image", False, False, None, 0, 0), (4, "", True, False, 0.0, 0, 0),
    ]
    for none in (None, cannot):
        assert [r["unread"] for r in pages.read_pages(files, open_pages, none).orderBy("page_no").collect()] == [False, True, False, True]
    m = readers.document_map(pages.read_pages(files, open_pages, load)).first()
    assert (m["pages"], m["ocr_pages"], m["unread_scanned_pages"], m["ocr_mean_conf"], m["ocr_repairs"]) == (4, 2, 0, pytest.approx(40), 1)
    assert readers.ocr_report(readers.document_map(pages.read_pages(files, open_pages, load))).first()["low_confidence"]
    assert pages.enlargement(1000, 500) == 2.3 and pages.enlargement(4000, 100) == 1.0
    engine = pages.Engine(cannot)
    assert (engine.state, engine.boxes("x"), engine.state, pages.Engine(None).state) == ("waiting", None, "failed", "off")


def test_sinks(spark, tmp_path):
    q = spark.createDataFrame([("q1", "a")], "query_id string, query string")
    path = str(tmp_path / "rel")
    assert readers.judgements(readers.relevance_template(q, path)).count() == 0
    readers.write_csv(spark.createDataFrame([("q1", "a", "D01 D02")], "query_id string, query string, relevant_docs string"), path)
    assert [r["doc_id"] for r in readers.judgements(readers.relevance_template(q, path)).collect()] == ["D01", "D02"]
    assert readers.few_documents(q)


def test_page_boxes(spark):
    box = "array<struct<y:double,x:double,height:double,text:string,score:double>>"
    df = spark.createDataFrame([([(10.0, 5.0, 8.0, "b", 0.5), (11.0, 0.0, 8.0, "a", 1.0)],), ([],)], f"boxes {box}")
    assert [tuple(r["r"]) for r in df.select(T.reading_order(F.col("boxes")).alias("r")).collect()] == [("a b", 75.0), ("", 0.0)]
    df = spark.createDataFrame([([(10.0, 50.0, 8.0, "b", 0.9), (30.0, 0.0, 8.0, "c", 0.8), (11.0, 0.0, 8.0, "a", 0.7), (13.0, 90.0, 2.0, "d", 0.8)],), ([(0.0, 0.0, 1.0, "x", 1.0), (1.0, 0.0, 1.0, "y", 1.0), (1.5, 9.0, 1.0, "z", 1.0)],)], f"boxes {box}")
    got = [tuple(r["r"]) for r in df.select(T.reading_order(F.col("boxes")).alias("r")).collect()]
    assert got[0] == ("a b d\nc", pytest.approx(80)) and got[1][0] == "x\ny z"


def test_stream(spark, tmp_path, docs):
    docs.where("doc_id <= 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    go = lambda: ingest.index_stream(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "index"), str(tmp_path / "c"), T.whitespace_tokens).awaitTermination()
    go()
    docs.where("doc_id > 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    index = ingest.read_index(spark, str(tmp_path / "index"))
    assert hits(index, docs, "c NOT b") == [3] and index.count() == 6


def test_api(spark, docs, postings):
    engine = api.Engine({"Pipeline B": postings}, docs.select("doc_id"))
    server = api.serve(engine, ingest=lambda data: {"bytes": len(data)}, port=0)
    Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}/api"
    ask = lambda path, data=None: json.load(urllib.request.urlopen(f"{at}/{path}", data=data))
    assert ask("search?q=a+AND+c&pipeline=Pipeline+B")["results"] == [1]
    got = ask("analyze", json.dumps({"text": "He paid ₹5,000"}).encode())
    assert {"text": "₹5,000", "type": "MONEY"} in got["tokens"] and len(got["final"]) == len(got["tags"])
    assert ask("upload", b"1234") == {"bytes": 4}
    with pytest.raises(urllib.error.HTTPError):
        ask("search?q=a&pipeline=none")
    server.shutdown()
