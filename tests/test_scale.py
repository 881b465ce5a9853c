"""What keeps memory, shuffles and time of large tables in bounds."""

from pyspark.sql import functions as F

from clausemill.functions import kernels as K
from clausemill.operators import corpus


def live(n: int):
    """A kernel whose result says how many results were alive at most by then."""

    class Held(list):
        alive = most = 0

        def __init__(self, text):
            Held.alive += 1
            Held.most = max(Held.most, Held.alive)
            super().__init__([str(Held.most)])

        def __del__(self):
            Held.alive -= 1

    return Held


def one_batch(spark, n: int):
    return spark.range(n, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))


def test_kernels_hold_few_results(spark):
    """of a batch's results, only those of a few texts are Python objects at a time."""
    most = one_batch(spark, 1000).select(F.max(K.each(live(0), "array<string>")(F.col("text"))[0].cast("int"))).first()[0]
    assert most <= 2 * K.ROWS


def test_type_counts(spark):
    """counts, not tokens, leave Python."""
    docs = spark.createDataFrame([(1, "Rs. 5 on 01/02/2026, 7"), (2, None), (3, "a b")], "doc_id int, text string")
    counts = {r["doc_id"]: r["k"] for r in docs.select("doc_id", K.typed_counts(F.col("text")).alias("k")).collect()}
    assert counts == {1: {"MONEY": 1, "WORD": 1, "DATE": 1, "PUNCT": 1, "NUMBER": 1}, 2: {}, 3: {"WORD": 2}}


def test_kernels_tokens_are_counted_in_python(spark):
    """no tokens, but counts of distinct ones leave Python."""
    docs = one_batch(spark, 1000)
    every = {"word": corpus.T.word_tokens, "rules": K.tokenize("rules"), "hybrid": K.tokenize("hybrid")}
    counted = corpus.token_counts(docs, every)
    assert {(r["tokenizer"], r["token"]): r["n"] for r in counted.collect()} == {(name, t): 1000 for name in every for t in "abc"}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_chunks():
    import pyarrow as pa

    texts = pa.array(["x" * K.CHARACTERS, None, *["y"] * (2 * K.ROWS)])
    found = list(K.chunks(texts))
    assert [t for _, some in found for t in some] == [t or "" for t in texts.to_pylist()]
    assert [start for start, _ in found] == [0, 1, 1 + K.ROWS, 1 + 2 * K.ROWS] and max(len(some) for _, some in found) <= K.ROWS


def by_hand(texts, sizes):
    found = {}
    for doc_id, words in texts:
        for n in sizes:
            for i in range(len(words) - n + 1):
                count, first = found.get(tuple(words[i : i + n]), (0, None))
                found[tuple(words[i : i + n])] = count + 1, doc_id if first is None else min(first, doc_id)
    return found


def test_longer_grams_are_dealt_once(spark, monkeypatch):
    """one row a place is shuffled, and groups that span runs of rows, keys and odd words come out whole."""
    import random

    from clausemill.kernels import grams

    monkeypatch.setattr(corpus, "_shares", lambda rows: 3)
    draw = random.Random(5)
    texts = [(f"d{k}", [draw.choice(["a", "the", "b", "a\tb", "\x0b", "\n", "", "é"]) for _ in range(draw.randrange(9))]) for k in range(150)]
    s = spark.createDataFrame([(d, 0, w, d[-1] if d[-1] < "5" else None) for d, w in texts], "doc_id string, sent_id int, words array<string>, p string")
    counts = corpus.ngram_counts(s)
    assert {tuple(r["gram"]): (r["frequency"], r["first_doc"]) for r in counts.collect()} == by_hand(texts, range(1, 6))
    assert {tuple(r["gram"]): r["frequency"] for r in corpus.ngram_counts(s, (2, 4), 2, True).collect()} == {
        g: n for g, (n, _) in by_hand(texts, (2, 4)).items() if n >= 2 and not {g[0], g[-1]} & set(corpus.MEANINGLESS)
    }
    assert sorted(corpus.ngram_sizes(s).collect()) == sorted(corpus.ngram_summary(counts).collect())
    whole = {(r["p"], r["n"]): r["unique_grams"] for r in corpus.ngram_sizes(s, by="p").collect()}
    for p in (*"01234", None):
        own = by_hand([(d, w) for d, w in texts if (d[-1] if d[-1] < "5" else None) == p], range(1, 6))
        assert {n: whole.get((p, n), 0) for n in range(1, 6)} == {n: sum(len(g) == n for g in own) for n in range(1, 6)}
    plan = corpus._windows(s, (2, 3, 4, 5), F.lit("")).mapInArrow(lambda parts: parts, "key string, w string")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1

    import pyarrow as pa

    rows = sorted((grams.BETWEEN.join(w[i : i + 3]), d) for d, w in ((d, [x for x in w if x in ("a", "b", "é")]) for d, w in texts) for i in range(len(w) - 1))
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([""] * len(some)), pa.array([x for x, _ in some]), pa.array([d for _, d in some])], names=["key", "w", "d"])
    for together in (1, 2, 7, 1000):
        monkeypatch.setattr(grams, "TOGETHER", together)
        out = {}
        for g in grams.counted(iter([batch(rows[k : k + together]) for k in range(0, len(rows), together)]), (2, 3), []):
            for gram, n, first in zip(g.grams().to_pylist(), g.frequency.tolist(), g.first.to_pylist(), strict=True):
                assert tuple(gram) not in out
                out[tuple(gram)] = n, first
        assert out == by_hand([(d, [x for x in w if x in ("a", "b", "é")]) for d, w in texts], (2, 3))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_of_documents_needs_no_shuffle(spark, monkeypatch):
    """Postings come from a document's row; only repeated ids are grouped."""
    from clausemill.kernels import postings
    from clausemill.operators import search

    monkeypatch.setattr(postings, "TOGETHER", 4)
    texts = [(1, "b a b"), (2, None), (3, "c"), (4, "a b c d e f g a")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    index = search.index_documents(docs)
    assert "Exchange" not in plan_of(index)
    same = lambda df: sorted((r["term"], str(r["doc_id"]), r["positions"]) for r in df.collect())
    assert same(index) == same(search.build_index(corpus.tokens(docs)))
    twice = spark.createDataFrame([*texts, (4, "z a"), (None, "b"), (None, "b c")], "doc_id int, text string")
    assert same(search.index_documents(twice)) == same(search.build_index(corpus.tokens(twice)))


def test_search_brings_postings_together_once(spark, tmp_path):
    """Positions are not exploded; scores that agree to nine digits are ranked by id, as in SQL."""
    from clausemill.operators import search

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(("a b", "b a", "a b a b c", "x", "c a b"))], "doc_id int, text string")
    search.write_segments(docs, str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    queries = {"x": "a b", "y": '"b a" OR c', "z": "NOT a"}
    found = search.search_all(index, docs, queries, str.split)
    assert "Generate explode(positions" not in plan_of(found)
    assert {(r["query_id"], r["doc_id"]) for r in found.collect()} == {("x", 0), ("x", 2), ("x", 4), ("y", 1), ("y", 2), ("y", 4), ("z", 3)}
    one = sorted(map(tuple, search.search_all(index, docs, queries, str.split, at_once=1).collect()))
    assert one == sorted(map(tuple, found.collect()))


def test_merges_of_many_pieces(spark):
    """more than 200,000 pieces need no Spark job a round, and the rules are those of merging pair by pair."""
    import random

    from clausemill.operators import subwords

    draw = random.Random(3)
    rows = {"".join(draw.choice("aabéc") for _ in range(draw.randrange(1, 10))): draw.randrange(1, 6) for _ in range(60)}
    pieces = spark.createDataFrame(list(rows.items()), "piece string, n long")
    merges, words, known = [], {p: list(p) for p in rows}, {subwords.UNKNOWN, *"".join(rows)}
    while len(known) < 60:
        pairs = {}
        for p, w in words.items():
            for pair in zip(w, w[1:]):
                pairs[pair] = pairs.get(pair, 0) + rows[p]
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < 2:
            break
        merges.append(best)
        known.add("".join(best))
        words = {p: subwords.apply_merge(w, best) for p, w in words.items()}
    assert subwords.learn_merges(pieces, vocabulary=60) == merges
    many = spark.range(200_001).select(F.concat(F.lit("ab"), F.col("id").cast("string")).alias("piece"), F.lit(1).cast("long").alias("n"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert subwords.learn_merges(many, vocabulary=60)[0] == ("a", "b")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 10


def test_annotation_in_small_batches(spark):
    """Python hands over rows of a few texts, and sentences are judged without joins or shuffles of tokens."""
    from clausemill.operators import extract

    docs = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("The Employee shall not disclose confidential information. No modal here.").alias("text"))
    nested = extract.annotated_sentences(docs, extract.has_modal)
    assert nested.count() == 300
    found = extract.obligations(nested)
    assert "Exchange" not in plan_of(found) and "Join" not in plan_of(found)
    assert sorted(found.collect()) == sorted(extract.obligations(extract.annotations(docs)).collect()) and found.first()["type"] == "PROHIBITION"
    whole = [tuple(r) for r in extract.noun_phrases(extract.annotated_sentences(docs)).collect()]
    assert whole == [tuple(r) for r in extract.noun_phrases(extract.annotations(docs)).collect()] and ("confidential information", 300) in whole
    for df in (nested, extract.pipeline_tokens(docs)):
        assert "MapInArrow" in plan_of(df) and "ArrowEvalPython" not in plan_of(df)
