"""A small inline corpus of invented contracts, with judgements and gold annotations, and the queries over it.

The generated tables hold no contract language, so the operators of that domain run here. Their SQL takes the kernels' tokens
as values and does all that is done with them (search, rank, evaluate, compare) on its own; where kernels themselves are
shown, the expected rows are worked out by hand.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from ..kernels import annotate, ocr, stem, tokens
from ..kernels.clean import clean
from ..kernels.query import build_query, operands, parse, query_type
from ..kernels.words import CUSTOM_STOP_WORDS, DOMAIN_PROBES, FUNCTION_WORDS, NEGATION_PROBES, NEGATIONS, STOP_WORDS
from ..operators import corpus, evaluate, extract, search, tagging
from ..operators import subwords as sub
from ..sources import pages, readers
from .pipelines import PIPELINES, flat, query_terms, surfaces
from .registry import ORACLES, QUERIES, query

NAMES = list(PIPELINES)
FINAL = "Final Pipeline"

TEXTS = [
    "OFFER OF EMPLOYMENT\n1. The Employee shall not disclose confidential information.\n2. The Company shall pay a CTC of ₹12,00,000 per annum.\nThe notice period is 30 (thirty) days.",
    "INTERNSHIP LETTER\nThe Intern will receive a stipend of ₹15,000 per month w.e.f. 01/04/2026. The Intern shall not solicit any client. Training lasts 6 (six) months.",
    "The Consultant may terminate this Agreement by written notice. Intellectual property of the Company stays with the Company. Governing law is the law of India.",
    "NON-COMPETE\nThe Employee shall not join a competitor for 12 months. A non-compete clause applies under Section 27 of the Indian Contract Act, 1872.",
    "Probation is 3 months. On termination during probation no gratuity is payable. The Employer may extend the probation.",
    "TRAINING BOND\nThe Employee shall serve the bond for 24 months. If the Employee leaves early, training costs of Rs. 2,00,000/- are payable. Work from home is not allowed.",
    "The Freelancer can work from home. Remuneration is INR 3.5 lakhs. Proprietary data of the client must be returned within 15 days.",
    "Confidential and proprietary information includes trade data. The Worker must not copy confidential files. The Worker shall return all files.",
    "The Senior Software Engineer reports to the Chief Data Officer. Gratuity is paid after 5 years of service. The notice period is 60 days.",
    "Page 1 of 2\nSERVICE AGREEMENT\nThe Contractor shall bond the materials.\nThe Contractor will notice any breach within 10 days.\nPage 2 of 2",
    "The Company may amend the policy. Employees should read the policy. No employee shall disclose salary data. Salary of 45,000 is paid monthly.",
    "Stipend and remuneration are confidential. The Trainee shall not solicit employees. Either party may terminate without notice during training.",
    "Terms: the Vendor must pay a penalty of ₹50,000 for any breach of Clause 4.2(a). The governing law is that of India; courts at Mumbai decide.",
    "The Employee shall disclose all conflicts. The Employee shall not disclose client lists. Confidentiality survives termination.",
    "A part-time worker may work from home on Fridays. Remuneration accrues daily. The notice period is 7 days.",
    "",
]
QUERIES_15 = {
    "Q01": "stipend", "Q02": "non-compete", "Q03": "gratuity", "Q04": "notice period", "Q05": "confidential information", "Q06": "intellectual property", "Q07": "governing law", "Q08": "shall not disclose",
    "Q09": "shall not solicit", "Q10": "work from home", "Q11": "probation AND termination", "Q12": "bond AND training", "Q13": "stipend OR remuneration", "Q14": "confidential OR proprietary", "Q15": "confidential AND NOT non-compete",
}
#: Judgements by hand of some queries: ids, space separated; the others are blank.
JUDGED = {"Q04": "1 9 15", "Q08": "1 11 14", "Q10": "6 7 15", "Q12": "6", "Q15": "1 8 12"}

CLEAN = {n: clean(t) for n, t in enumerate(TEXTS, 1)}


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of literal rows."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def select(columns: str, rows: list[tuple]) -> str:
    return f"WITH {values('v', columns, rows)} SELECT * FROM v"


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id long, text string")


def cleaned(spark: SparkSession) -> DataFrame:
    """The texts cleaned once; pipelines clean them again."""
    return documents(spark).select("doc_id", K.clean_text(F.col("text")).alias("text"))


# ---- pipelines, index and search ---------------------------------------------------------------------------------

SENTENCES = [(p, d, n, s) for d, t in CLEAN.items() for p in NAMES for n, s in enumerate(PIPELINES[p](clean(t)))]


def _lemma_map(name: str) -> dict[str, str]:
    counts: dict[str, Counter] = {}
    for t in CLEAN.values():
        for surface, lemma in surfaces(name, t):
            counts.setdefault(surface, Counter())[lemma] += 1
    return {s: c.most_common(1)[0][0] for s, c in counts.items()}


LEMMAS = {name: _lemma_map(name) for name in NAMES[1:]}
CONSISTENT = {name: (lambda text, name=name: query_terms(name, text, LEMMAS.get(name))) for name in NAMES}
NAIVE = {name: (lambda text, name=name: flat(name, text)) for name in NAMES}

SENT_SQL = values("sent", "pipeline, doc_id, sent_id, words", SENTENCES)
PIPE_SQL = values("p", "pipeline, ord", [(n, i) for i, n in enumerate(NAMES)])
DOC_SQL = values("d", "doc_id, text", list(CLEAN.items()))


def _operand_rows(terms_of: dict) -> list[tuple]:
    return [(p, q, g, o, x.negated, "|" + "|".join(t) + "|" if (t := f(x.text)) else "") for p, f in terms_of.items() for q, text in QUERIES_15.items() for g, c in enumerate(parse(text)) for o, x in enumerate(c)]


def _search_sql(terms_of: dict, tag: str = "") -> str:
    """CTEs up to ranked(pipeline, query_id, doc_id, score, rank): phrases are looked up in each document's joined tokens."""
    terms = [(p, q, k, t) for p, f in terms_of.items() for q, text in QUERIES_15.items() for k, t in enumerate(t for x in operands(text) for t in f(x))]
    return ", ".join([
        values(f"op{tag}", "pipeline, query_id, g, o, negated, phrase", _operand_rows(terms_of)), values(f"qt{tag}", "pipeline, query_id, k, term", terms),
        f"tok{tag} AS (SELECT pipeline, doc_id, sent_id, unnest(words) AS term, generate_subscripts(words, 1) AS i FROM sent)",
        f"str{tag} AS (SELECT p.pipeline, d.doc_id, '|' || coalesce(s, '') || '|' AS s FROM p CROSS JOIN d LEFT JOIN (SELECT pipeline, doc_id, string_agg(term, '|' ORDER BY sent_id, i) AS s FROM tok{tag} GROUP BY ALL) t ON t.pipeline = p.pipeline AND t.doc_id = d.doc_id)",
        f"hit{tag} AS (SELECT DISTINCT pipeline, query_id, doc_id FROM (SELECT pipeline, query_id, g, doc_id FROM op{tag} JOIN str{tag} USING (pipeline) GROUP BY ALL HAVING bool_and((phrase <> '' AND contains(s, phrase)) <> negated)))",
        f"tf{tag} AS (SELECT pipeline, term, doc_id, count(*) AS tf FROM tok{tag} GROUP BY ALL)",
        f"w{tag} AS (SELECT *, (1 + ln(tf)) * ln((SELECT count(*) FROM d) / count(*) OVER (PARTITION BY pipeline, term)) AS w FROM tf{tag})",
        f"sc{tag} AS (SELECT h.pipeline, h.query_id, h.doc_id, coalesce(sum(w ORDER BY k), 0.0) AS score FROM hit{tag} h LEFT JOIN (qt{tag} JOIN w{tag} USING (pipeline, term)) x ON x.pipeline = h.pipeline AND x.query_id = h.query_id AND x.doc_id = h.doc_id GROUP BY ALL)",
        f"ranked{tag} AS (SELECT *, CAST(row_number() OVER (PARTITION BY pipeline, query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM sc{tag})",
    ])


BASE_SQL = f"WITH {SENT_SQL}, {PIPE_SQL}, {DOC_SQL}, {_search_sql(CONSISTENT)}"
RAW_OPERANDS = [(q, g, o, x.negated, x.text.lower()) for q, text in QUERIES_15.items() for g, c in enumerate(parse(text)) for o, x in enumerate(c)]
RELEVANT_SQL = ", ".join([
    values("manual", "query_id, doc_id", [(q, int(d)) for q, ids in JUDGED.items() for d in ids.split()]), values("raw", "query_id, g, o, negated, t", RAW_OPERANDS),
    "prov AS (SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, g, doc_id FROM raw CROSS JOIN (SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS s FROM d) GROUP BY ALL HAVING bool_and(contains(s, t) <> negated)))",
    "rel AS (SELECT query_id, doc_id FROM manual UNION ALL SELECT query_id, doc_id FROM prov WHERE query_id NOT IN (SELECT query_id FROM manual))",
    values("q", "query_id, query, type, n", [(k, t, query_type(t), n) for n, (k, t) in enumerate(QUERIES_15.items())]),
])


def _metrics_sql(ranked: str, tag: str = "") -> str:
    return (
        f"b{tag} AS (SELECT p.pipeline, q.query_id, x.doc_id, r.rank, rel.doc_id IS NOT NULL AS good FROM p CROSS JOIN q LEFT JOIN (SELECT pipeline, query_id, doc_id FROM {ranked} UNION SELECT pipeline, query_id, doc_id FROM rel CROSS JOIN p) x ON x.pipeline = p.pipeline AND x.query_id = q.query_id "
        f"LEFT JOIN {ranked} r ON r.pipeline = p.pipeline AND r.query_id = q.query_id AND r.doc_id = x.doc_id LEFT JOIN rel ON rel.query_id = q.query_id AND rel.doc_id = x.doc_id), "
        f"k{tag} AS (SELECT pipeline, query_id, count(*) FILTER (good) AS relevant, count(rank) AS retrieved, count(rank) FILTER (good) AS hits, count(*) FILTER (rank <= 5) AS f, count(*) FILTER (rank <= 5 AND good) AS fh FROM b{tag} GROUP BY ALL), "
        f"m{tag} AS (SELECT *, CASE WHEN retrieved > 0 THEN hits / retrieved WHEN relevant = 0 THEN 1.0 ELSE 0.0 END AS precision, CASE WHEN relevant > 0 THEN hits / relevant END AS recall, CASE WHEN f > 0 THEN fh / f WHEN relevant = 0 THEN 1.0 ELSE 0.0 END AS p_at_k, CASE WHEN relevant > 0 THEN fh / relevant END AS r_at_k FROM k{tag}), "
        f"e{tag} AS (SELECT *, CASE WHEN recall IS NULL THEN NULL WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m{tag})"
    )


METRICS_SQL = f"{BASE_SQL}, {RELEVANT_SQL}, {_metrics_sql('ranked')}"


def postings(spark: SparkSession) -> DataFrame:
    """(pipeline, term, doc_id, positions) of all pipelines."""
    return search.build_index(extract.flat_tokens(extract.pipeline_tokens(cleaned(spark))), ("pipeline",))


def retrieved(spark: SparkSession, terms_of: dict | None = None) -> DataFrame:
    """(pipeline, query_id, doc_id, score, rank): all queries by each pipeline's own index and terms."""
    index, ids = postings(spark), documents(spark).select("doc_id")
    each = [search.search_all(index.where(F.col("pipeline") == n).drop("pipeline"), ids, QUERIES_15, f).select(F.lit(n).alias("pipeline"), "*") for n, f in (terms_of or CONSISTENT).items()]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def relevance(spark: SparkSession) -> DataFrame:
    """(query_id, doc_id, source): judgements by hand where there are any, else literal ones."""
    template = spark.createDataFrame([(k, q, JUDGED.get(k, "")) for k, q in QUERIES_15.items()], "query_id string, query string, relevant_docs string")
    manual = readers.judgements(template).select("query_id", F.col("doc_id").cast("long").alias("doc_id"))
    return evaluate.with_judgements(manual, search.substring_relevance(cleaned(spark), QUERIES_15), search.query_table(spark, QUERIES_15))


def evaluated(spark: SparkSession, found: DataFrame | None = None) -> DataFrame:
    """(pipeline, query_id, type, relevant, retrieved, precision, recall, f1, p_at_k, r_at_k), unrounded, for all pairs."""
    queries, rows, judged = search.query_table(spark, QUERIES_15), found if found is not None else retrieved(spark), relevance(spark)
    pair = lambda df: df.withColumn("query_id", F.concat_ws("|", "pipeline", "query_id"))
    every = spark.createDataFrame([(n,) for n in NAMES], "pipeline string")
    each = pair(queries.crossJoin(F.broadcast(every)))  # 15 queries by 3 pipelines
    out = evaluate.precision_recall(pair(rows), pair(judged.crossJoin(F.broadcast(every))), each)
    keys = F.split("query_id", r"\|")
    out = out.withColumns({"pipeline": keys[0], "query_id": keys[1]})
    return out.join(queries.select("query_id", "type"), "query_id")


@query(f"{BASE_SQL} SELECT * FROM ranked")
def contract_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark)


@query(f"{METRICS_SQL} SELECT query_id, type, pipeline, relevant, retrieved, round_even(precision, 3) AS precision, round_even(recall, 3) AS recall, round_even(f1, 3) AS f1, round_even(p_at_k, 3) AS p_at_5, round_even(r_at_k, 3) AS r_at_5, CASE WHEN query_id IN (SELECT query_id FROM manual) THEN 'manual' ELSE 'PROVISIONAL' END AS source FROM e JOIN q USING (query_id)")
def contract_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 45 rows of queries by pipelines."""
    source = F.when(F.col("query_id").isin(list(JUDGED)), "manual").otherwise("PROVISIONAL")
    rows = evaluate.rounded(evaluated(spark), 3, "precision", "recall", "f1", "p_at_k", "r_at_k")
    return rows.select("query_id", "type", "pipeline", "relevant", "retrieved", "precision", "recall", "f1", F.col("p_at_k").alias("p_at_5"), F.col("r_at_k").alias("r_at_5"), source.alias("source"))


@query(f"{METRICS_SQL} SELECT type, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(p_at_k) AS p_at_k, avg(r_at_k) AS r_at_k FROM e JOIN q USING (query_id) WHERE pipeline = '{FINAL}' GROUP BY type")
def contract_evaluation_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.averages(evaluated(spark).where(F.col("pipeline") == FINAL), "type")


ABLATION_SQL = f"{METRICS_SQL}, {_search_sql(NAIVE, '2')}, {_metrics_sql('ranked2', '2')}"


@query(f"{ABLATION_SQL} SELECT 'consistent' AS queries, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM e WHERE pipeline = '{FINAL}' UNION ALL SELECT 'naive', avg(precision), avg(recall), avg(f1) FROM e2 WHERE pipeline = '{FINAL}'")
def contract_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries processed on their own, and with the corpus's lemmas."""
    means = lambda rows, name: rows.where(F.col("pipeline") == FINAL).agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "f1")]).select(F.lit(name).alias("queries"), "*")
    return means(evaluated(spark), "consistent").unionByName(means(evaluated(spark, retrieved(spark, NAIVE)), "naive"))


@query(f"{ABLATION_SQL}, x AS (SELECT query_id, list(doc_id ORDER BY rank) AS a FROM ranked WHERE pipeline = '{FINAL}' GROUP BY ALL), y AS (SELECT query_id, list(doc_id ORDER BY rank) AS b FROM ranked2 WHERE pipeline = '{FINAL}' GROUP BY ALL) SELECT query_id FROM x FULL JOIN y USING (query_id) WHERE a IS DISTINCT FROM b")
def contract_changed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = lambda rows: rows.where(F.col("pipeline") == FINAL)
    return evaluate.changed_results(mine(retrieved(spark)), mine(retrieved(spark, NAIVE)))


PROBES = [(n, p, "|".join(flat(n, p))) for n in NAMES for p in DOMAIN_PROBES]
STOP_SQL = literal(sorted(FUNCTION_WORDS))
STRUCTURE_SQL = ", ".join([
    values("pr", "pipeline, probe, out", PROBES), values("ng", "pipeline, i, words", [(n, i, flat(n, t)) for n in NAMES for i, t in enumerate(NEGATION_PROBES)]),
    "gr AS (SELECT pipeline, n, words[i : i + n - 1] AS g, count(*) AS c FROM (SELECT pipeline, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM sent, range(1, 4) r(n) WHERE len(words) >= n) GROUP BY ALL)",
    f"st AS (SELECT pipeline, CAST(sum(c) FILTER (n = 1) AS BIGINT) AS token_count, count(*) FILTER (n = 1) AS vocabulary, count(*) FILTER (n > 1 AND c >= 2 AND NOT list_contains({STOP_SQL}, g[1]) AND NOT list_contains({STOP_SQL}, g[-1])) AS meaningful_ngrams FROM gr GROUP BY ALL)",
    "dt AS (SELECT pipeline, CAST(count(*) AS INTEGER) AS domain_terms FROM (SELECT *, count(*) OVER (PARTITION BY pipeline, out) AS same FROM pr) WHERE out <> '' AND same = 1 GROUP BY ALL)",
    f"ne AS (SELECT pipeline, CAST(count(*) FILTER (list_has_any(words, {literal(list(NEGATIONS))})) AS INTEGER) AS negations FROM ng GROUP BY ALL)",
    "structure AS (SELECT pipeline, CAST(ord AS INTEGER) AS ord, token_count, vocabulary, meaningful_ngrams, domain_terms, negations FROM p JOIN st USING (pipeline) JOIN dt USING (pipeline) JOIN ne USING (pipeline))",
])


def structure(spark: SparkSession) -> DataFrame:
    return extract.pipeline_table(extract.pipeline_tokens(cleaned(spark))).select("pipeline", "ord", "token_count", "vocabulary", "meaningful_ngrams", "domain_terms", "negations")


@query(f"WITH {SENT_SQL}, {PIPE_SQL}, {STRUCTURE_SQL} SELECT * FROM structure")
def contract_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure(spark)


MEASURES = ("token_count", "vocabulary", "meaningful_ngrams", "domain_terms", "negations", "precision", "recall", "f1")


def means(spark: SparkSession) -> DataFrame:
    return evaluate.averages(evaluated(spark), "pipeline", ("precision", "recall", "f1"))


@query(f"{METRICS_SQL}, {STRUCTURE_SQL}, a AS (SELECT pipeline, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM e GROUP BY ALL), j AS (SELECT * FROM structure JOIN a USING (pipeline)), l AS ("
       + " UNION ALL ".join(f"SELECT pipeline, '{m}' AS measure, CAST({m} AS DOUBLE) AS v FROM j" for m in MEASURES)
       + ") SELECT measure, " + ", ".join(f"max(v) FILTER (pipeline = '{n}') AS \"{n}\"" for n in NAMES) + " FROM l GROUP BY measure")
def contract_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures down, pipelines across."""
    return evaluate.pivoted(structure(spark).join(means(spark), "pipeline"), MEASURES, "pipeline", NAMES)


@query(f"{BASE_SQL}, {values('q', 'query_id, query, type, n', [(k, t, query_type(t), n) for n, (k, t) in enumerate(QUERIES_15.items())])}, r AS (SELECT query_id, count(*) AS results, string_agg(doc_id, ' ' ORDER BY rank) AS docs FROM ranked WHERE pipeline = '{FINAL}' GROUP BY ALL) SELECT query, type, coalesce(docs, '') AS documents, coalesce(results, 0) AS results FROM q LEFT JOIN r USING (query_id) QUALIFY row_number() OVER (PARTITION BY type ORDER BY query_id) = 1")
def contract_first_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query of each type with its results."""
    final = retrieved(spark).where(F.col("pipeline") == FINAL)
    rows = final.groupBy("query_id").agg(F.count("*").alias("results"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]), " ").alias("documents"))
    every = search.query_table(spark, QUERIES_15).join(rows, "query_id", "left")
    return evaluate.first_of_type(every).select("query", "type", F.coalesce("documents", F.lit("")).alias("documents"), F.coalesce("results", F.lit(0)).alias("results"))


@query(f"{METRICS_SQL} SELECT CAST(ord AS INTEGER) AS ord, pipeline, round_even(avg(precision), 3) AS precision, round_even(avg(recall), 3) AS recall, round_even(avg(f1), 3) AS f1 FROM p JOIN e USING (pipeline) GROUP BY ALL")
def contract_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics in the pipelines' own order."""
    return evaluate.rounded(evaluate.in_order(means(spark), "pipeline", NAMES), 3, "precision", "recall", "f1").select("ord", "pipeline", "precision", "recall", "f1")


@query(f"{METRICS_SQL}, {STRUCTURE_SQL}, a AS (SELECT pipeline, round_even(avg(f1), 3) AS f1 FROM e GROUP BY ALL) SELECT pipeline, f1, f1 = max(f1) OVER () AS tied, CAST(row_number() OVER (ORDER BY f1 DESC, domain_terms DESC, negations DESC, meaningful_ngrams DESC, ord) AS INTEGER) AS place FROM structure JOIN a USING (pipeline)")
def contract_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure(spark).join(evaluate.rounded(means(spark), 3, "f1").select("pipeline", "f1"), "pipeline")
    return evaluate.select_pipeline(rows).select("pipeline", "f1", "tied", "place")


@query(f"WITH {values('q', 'query_id', [(k,) for k in QUERIES_15])}, {values('m', 'query_id', [(k,) for k in JUDGED])} SELECT count(*) AS queries, count(*) FILTER (query_id NOT IN (SELECT query_id FROM m)) AS provisional, count(*) FILTER (query_id NOT IN (SELECT query_id FROM m)) = 0 AS report FROM q")
def contract_provisional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the numbers may be reported."""
    judged = relevance(spark).groupBy("query_id").agg(F.min("source").alias("source"))
    return evaluate.provisional(search.query_table(spark, QUERIES_15).join(judged, "query_id", "left").select("query_id", F.coalesce("source", F.lit("PROVISIONAL")).alias("source")))


@query(f"WITH {SENT_SQL} SELECT pipeline, count(DISTINCT term) AS terms FROM (SELECT pipeline, unnest(words) AS term FROM sent) GROUP BY pipeline")
def contract_index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_summary(postings(spark))


SAMPLES = ["employee", "non-compete", "confidential", "notice", "not"]


@query(f"WITH {SENT_SQL} SELECT term, list_sort(list(DISTINCT doc_id))::BIGINT[] AS doc_ids FROM (SELECT doc_id, unnest(words) AS term FROM sent WHERE pipeline = '{FINAL}') WHERE term IN ({', '.join(map(literal, SAMPLES))}) GROUP BY term")
def contract_sample_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sample_postings(postings(spark).where(F.col("pipeline") == FINAL), SAMPLES)


@query(f"WITH {SENT_SQL}, t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, i) - 1 AS pos, term FROM (SELECT doc_id, sent_id, unnest(words) AS term, generate_subscripts(words, 1) AS i FROM sent WHERE pipeline = '{FINAL}')), e AS (SELECT term, doc_id, list(pos ORDER BY pos) AS ps FROM t GROUP BY ALL) SELECT term, '{{\"df\":' || count(*) || ',\"postings\":{{' || string_agg('\"' || doc_id || '\":[' || array_to_string(ps, ',') || ']', ',' ORDER BY doc_id) || '}}}}' AS json FROM e GROUP BY term")
def contract_index_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final pipeline's index as JSON."""
    return search.index_json(postings(spark).where(F.col("pipeline") == FINAL).drop("pipeline"))


@query("WITH " + values("s", "pipeline, surface, lemma, n", [(name, a, b, n) for name in LEMMAS for n, (a, b) in enumerate(x for t in CLEAN.values() for x in surfaces(name, t))]) + ", c AS (SELECT pipeline, surface, lemma, count(*) AS c, min(n) AS f FROM s GROUP BY ALL) SELECT pipeline, surface, lemma FROM c QUALIFY row_number() OVER (PARTITION BY pipeline, surface ORDER BY c DESC, f) = 1")
def contract_lemma_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cleaned(spark)
    a, b = (extract.surface_lemmas(docs, name) for name in LEMMAS)
    return corpus.lemma_map(a.unionByName(b))


# ---- tokenizers, taggers, entities -------------------------------------------------------------------------------

#: Sentences with the tokens that the domain wants.
TOKEN_GOLD = [
    ("A CTC of ₹9,50,000 is fixed.", ["A", "CTC", "of", "₹9,50,000", "is", "fixed", "."]),
    ("Pay Rs. 75,000/- now.", ["Pay", "Rs. 75,000/-", "now", "."]),
    ("No non-solicitation here.", ["No", "non-solicitation", "here", "."]),
    ("See Section 14A and Clause 3.1(b).", ["See", "Section 14A", "and", "Clause 3.1(b)", "."]),
    ("The Payment of Gratuity Act, 1972 applies.", ["The", "Payment", "of", "Gratuity Act, 1972", "applies", "."]),
    ("Orbit Pvt. Ltd. pays w.e.f. 05/06/2026.", ["Orbit", "Pvt.", "Ltd.", "pays", "w.e.f.", "05/06/2026", "."]),
    ("Meet at 10:30 a.m. today.", ["Meet", "at", "10:30 a.m.", "today", "."]),
    ("A full-time engineer can't leave.", ["A", "full-time", "engineer", "can't", "leave", "."]),
]
SCORED = ["treebank", "rules", "custom", "hybrid"]
PREDICTED = [(t, n, tokens.TOKENIZERS[t](s), g) for t in SCORED for n, (s, g) in enumerate(TOKEN_GOLD)]


@query(f"WITH {values('x', 'tokenizer, n, predicted, gold', PREDICTED)}, u AS (SELECT tokenizer, n, unnest(list_distinct(predicted)) AS t, predicted, gold FROM x), o AS (SELECT tokenizer, n, sum(least(len(list_filter(predicted, lambda v: v = t)), len(list_filter(gold, lambda v: v = t)))) AS b FROM u GROUP BY ALL), f AS (SELECT x.tokenizer, predicted = gold AS exact, CASE WHEN coalesce(b, 0) = 0 THEN 0.0 ELSE 2 * (b / len(predicted)) * (b / len(gold)) / (b / len(predicted) + b / len(gold)) END AS f1 FROM x LEFT JOIN o USING (tokenizer, n)) SELECT tokenizer, round_even(100.0 * avg(CASE WHEN exact THEN 1 ELSE 0 END), 1) AS exact_pct, round_even(avg(f1), 3) AS f1 FROM f GROUP BY tokenizer")
def tokenizer_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches in percent and mean F1 over the gold sentences, for each scored tokenizer."""
    gold = spark.createDataFrame([(n, s, g) for n, (s, g) in enumerate(TOKEN_GOLD)], "n int, sentence string, gold array<string>")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), K.tokenize(t)(F.col("sentence")).alias("predicted")) for t in SCORED])).alias("p")
    pairs = gold.select("n", "gold", each).select(F.struct("p.tokenizer", "n").alias("id"), "p.predicted", "gold")
    scored = evaluate.token_f1(pairs).groupBy(F.col("id.tokenizer").alias("tokenizer")).agg((100 * F.avg(F.col("exact").cast("double"))).alias("exact_pct"), F.avg("f1").alias("f1"))
    return evaluate.rounded(evaluate.rounded(scored, 1, "exact_pct"), 3, "f1")


#: Words with their Penn tags: for tests, and to learn from (the domain's own count more).
TAG_GOLD = [
    "The/DT Employee/NN shall/MD bond/VB the/DT goods/NNS ./.", "A/DT CTC/NN of/IN ₹7,00,000/CD is/VBZ payable/JJ ./.", "The/DT Company/NN may/MD not/RB claim/VB the/DT stipend/NN ./.", "His/PRP$ notice/NN lasts/VBZ 2/CD months/NNS w.e.f./IN today/NN ./.",
    "The/DT worker/NN must/MD sign/VB a/DT release/NN ./.", "The/DT candidate/NN will/MD receive/VB the/DT agreement/NN quickly/RB ./.", "Any/DT breach/NN ends/VBZ the/DT service/NN ./.", "The/DT consultant/NN agreed/VBD to/TO notice/VB the/DT claim/NN ./.",
]
TAG_TRAIN = [
    "The/DT manager/NN reads/VBZ the/DT letter/NN ./.", "A/DT lawyer/NN will/MD write/VB a/DT long/JJ letter/NN ./.", "She/PRP must/MD not/RB leave/VB the/DT office/NN ./.", "They/PRP paid/VBD 20/CD dollars/NNS quickly/RB ./.",
    "The/DT new/JJ office/NN opens/VBZ on/IN Monday/NNP ./.", "He/PRP agreed/VBD to/TO read/VB the/DT book/NN ./.", "Any/DT delay/NN ends/VBZ the/DT work/NN ./.", "His/PRP$ work/NN lasts/VBZ 2/CD days/NNS ./.",
]
TAG_DOMAIN = ["The/DT Intern/NN shall/MD sign/VB the/DT bond/NN ./.", "A/DT stipend/NN of/IN ₹4,000/CD is/VBZ payable/JJ w.e.f./IN today/NN ./.", "The/DT Employer/NN may/MD notice/VB a/DT breach/NN ./.", "The/DT worker/NN must/MD not/RB claim/VB the/DT service/NN ./."]


def tagged(lines: list[str], first: int = 0, weight: float = 1.0) -> list[tuple]:
    return [(first + n, i, *w.rsplit("/", 1), weight) for n, line in enumerate(lines) for i, w in enumerate(line.split())]


TAGGED = "sent_id int, pos int, word string, tag string, weight double"


def tagged_rows(spark: SparkSession) -> DataFrame:
    """(sent_id, pos, word, gold, tagger, predicted, is_domain) of the taggers that are rules."""
    words = spark.createDataFrame(tagged(TAG_GOLD), TAGGED)
    each = words.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "tag"))).alias("s"))
    out = None
    for name, f in tagging.TAGGERS.items():
        by = F.pandas_udf(lambda sentences, f=f: sentences.map(lambda s: f(list(s))), "array<string>")
        rows = each.select("sent_id", F.lit(name).alias("tagger"), F.explode(F.arrays_zip("s", by(F.col("s.word")).alias("predicted"))).alias("x"))
        rows = rows.select("sent_id", "x.s.pos", "x.s.word", F.col("x.s.tag").alias("gold"), "tagger", "x.predicted", tagging.is_domain(F.col("x.s.word")).alias("is_domain"))
        out = rows if out is None else out.unionByName(rows)
    return out


def learned_rows(spark: SparkSession) -> DataFrame:
    """The same of two learned taggers: from general sentences, and from those and the domain's at twenty times the weight."""
    gold, general = spark.createDataFrame(tagged(TAG_GOLD), TAGGED), tagged(TAG_TRAIN)
    out = None
    for name, rows in (("learned", general), ("learned with domain", general + tagged(TAG_DOMAIN, 100, 20.0))):
        model = tagging.train_tagger(spark.createDataFrame(rows, TAGGED), weight="weight", hashed=1 << 12, iterations=300)
        got = tagging.apply_tagger(model, gold.select("sent_id", "pos", "word")).join(gold.select("sent_id", "pos", F.col("tag").alias("gold")), ["sent_id", "pos"])
        got = got.select("sent_id", "pos", "word", "gold", F.lit(name).alias("tagger"), "predicted", tagging.is_domain(F.col("word")).alias("is_domain"))
        out = got if out is None else out.unionByName(got)
    return out


def _is_domain(word: str) -> bool:
    from ..kernels.words import DOMAIN_TAGS, NOUN_OR_VERB

    return word.lower() in {*DOMAIN_TAGS, *NOUN_OR_VERB, "shall"} or bool(annotate.MONEY_TOKEN.match(word))


TAG_ROWS = [(n, i, w, g, name, p, _is_domain(w)) for n, line in enumerate(TAG_GOLD) for name, f in tagging.TAGGERS.items() for i, ((w, g), p) in enumerate(zip((x.rsplit("/", 1) for x in line.split()), f([x.rsplit("/", 1)[0] for x in line.split()])))]
TAG_SQL = values("t", "sent_id, pos, word, gold, tagger, predicted, is_domain", TAG_ROWS)


@query(f"WITH {TAG_SQL} SELECT tagger, avg(CASE WHEN gold = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN gold = predicted THEN 1.0 ELSE 0.0 END) FILTER (is_domain) AS domain_accuracy FROM t GROUP BY tagger")
def tagging_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.tagging_accuracy(tagged_rows(spark))


@query(f"WITH {TAG_SQL} SELECT sent_id, pos, word, gold, " + ", ".join(f"max(predicted) FILTER (tagger = '{n}') AS {n}, max(predicted) FILTER (tagger = '{n}') = gold AS {n}_correct" for n in tagging.TAGGERS) + " FROM t WHERE is_domain GROUP BY sent_id, pos, word, gold")
def tagging_of_domain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.domain_tokens(tagged_rows(spark), list(tagging.TAGGERS))


@query()
def tagging_scores_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.tagging_accuracy(learned_rows(spark))


#: Sentences with their entities; a recogniser of names stands in for a model.
ENTITY_GOLD = [
    ("Zen Labs Pvt. Ltd. hired Asha Rao on 02/03/2026.", [("Zen Labs Pvt. Ltd.", "ORG"), ("Asha Rao", "PERSON"), ("02/03/2026", "DATE")]),
    ("A CTC of ₹8,00,000 is due in 30 days.", [("₹8,00,000", "MONEY"), ("30 days", "DURATION")]),
    ("She is a Senior Data Analyst under Section 10.", [("Senior Data Analyst", "DESIGNATION"), ("Section 10", "LAW")]),
    ("Ravi Kumar shall pay Rs. 1,000 to Moon Works Limited.", [("Ravi Kumar", "PERSON"), ("Rs. 1,000", "MONEY"), ("Moon Works Limited", "ORG")]),
]
NAME = r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+(?: (?:Pvt\. )?Ltd\.| Limited)?"


def names(text: str) -> list[tuple[int, int, str]]:
    """Runs of capitalised words: organisations by their ending, else persons."""
    import re

    return [(m.start(), m.end(), "ORG" if m[0].endswith(("Ltd.", "Limited")) else "PERSON") for m in re.finditer(NAME, text)]


def _spans(by: str, text: str) -> list[tuple[int, int, str]]:
    rules = extract.rule_entities(text)
    if by == "names":
        return names(text)
    return sorted(rules + [s for s in names(text) if not any(s[0] < r[1] and r[0] < s[1] for r in rules)])


def found_entities(spark: SparkSession, texts: list[str]) -> dict[str, DataFrame]:
    """(doc_id, start, end, label, text) by names alone, and by rules with the names that overlap none."""
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    span = "array<struct<start:int,end:int,label:string>>"
    model = docs.select("doc_id", F.explode(K.each(lambda t: [{"start": a, "end": b, "label": x} for a, b, x in names(t)], span)(F.col("text"))).alias("e")).select("doc_id", "e.*")
    both = extract.merge_entities(model, extract.entities(docs))
    named = lambda df: df.join(docs, "doc_id").select("doc_id", "start", "end", "label", F.expr("substring(text, start + 1, end - start)").alias("text"))
    return {"names": named(model), "custom": named(both)}


def _entity_rows(texts: list[str]) -> list[tuple]:
    return [(by, n, a, b, label, t[a:b]) for by in ("names", "custom") for n, t in enumerate(texts, 1) for a, b, label in _spans(by, t)]


GOLD_SQL = values("g", "sent_id, text, label", [(n, t, x) for n, (_, es) in enumerate(ENTITY_GOLD, 1) for t, x in es])
GOLD_FOUND_SQL = values("f", "model, sent_id, start, \"end\", label, text", _entity_rows([s for s, _ in ENTITY_GOLD]))
CORPUS_FOUND_SQL = values("f", "model, doc_id, start, \"end\", label, text", _entity_rows(list(CLEAN.values())))


def _gold(spark: SparkSession) -> tuple[DataFrame, dict[str, DataFrame]]:
    gold = spark.createDataFrame([(n, t, x) for n, (_, es) in enumerate(ENTITY_GOLD, 1) for t, x in es], "sent_id long, text string, label string")
    found = {k: v.withColumnRenamed("doc_id", "sent_id").withColumn("ord", F.col("start")) for k, v in found_entities(spark, [s for s, _ in ENTITY_GOLD]).items()}
    return gold, found


@query(f"WITH {GOLD_SQL}, {GOLD_FOUND_SQL}, n AS (SELECT DISTINCT model FROM f), c AS (SELECT model, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM (SELECT sent_id, text, label FROM f WHERE f.model = n.model INTERSECT SELECT * FROM g)) AS correct, (SELECT count(*) FROM (SELECT sent_id, text, label FROM f WHERE f.model = n.model EXCEPT SELECT * FROM g)) AS spurious, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT sent_id, text, label FROM f WHERE f.model = n.model)) AS missed FROM n) SELECT *, correct / (correct + spurious) AS precision, correct / gold AS recall, 2 * correct / (2 * correct + spurious + missed) AS f1 FROM c")
def entity_scores_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, found = _gold(spark)
    a, b = (evaluate.entity_scores(df, gold).select(F.lit(k).alias("model"), "*") for k, df in found.items())
    return a.unionByName(b)


@query(f"WITH {GOLD_SQL}, {GOLD_FOUND_SQL} SELECT g.sent_id, g.text, g.label, coalesce(n.label, '(missed)') AS names, coalesce(n.label, '(missed)') = g.label AS names_correct, coalesce(c.label, '(missed)') AS custom, coalesce(c.label, '(missed)') = g.label AS custom_correct FROM g LEFT JOIN f n ON n.model = 'names' AND n.sent_id = g.sent_id AND n.text = g.text LEFT JOIN f c ON c.model = 'custom' AND c.sent_id = g.sent_id AND c.text = g.text")
def entity_table_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, found = _gold(spark)
    return evaluate.entity_table(gold, found)


@query(f"WITH {CORPUS_FOUND_SQL} SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", label, text FROM f WHERE model = 'custom'")
def contract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_entities(spark, list(CLEAN.values()))["custom"]


@query(f"WITH {CORPUS_FOUND_SQL} SELECT label, count(*) AS frequency FROM f WHERE model = 'custom' GROUP BY label")
def contract_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.entity_counts(found_entities(spark, list(CLEAN.values()))["custom"])


@query(f"WITH {CORPUS_FOUND_SQL}, d AS (SELECT text, arg_min(label, (doc_id, start)) AS label FROM f WHERE model = 'names' GROUP BY text) SELECT c.text, c.label, coalesce(d.label, '(missed)') AS default_label, count(*) AS frequency, '' AS correct FROM f c LEFT JOIN d ON d.text = c.text WHERE c.model = 'custom' GROUP BY ALL")
def contract_entity_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_entities(spark, list(CLEAN.values()))
    return extract.entity_inventory(found["custom"], found["names"].withColumn("ord", F.struct("doc_id", "start")))


ANNOTATED = [(d, x.sent, x.pos, x.text, x.lemma, x.tag, x.dep, x.head) for d, t in CLEAN.items() for s in map(annotate.shallow_dependencies, annotate.annotate(clean(t))) for x in s]
ANNOTATED_SQL = values("a", "doc_id, sent_id, pos, text, lemma, tag, dep, head", ANNOTATED)
PHRASE_SQL = "(SELECT coalesce(string_agg(w.text, ' ' ORDER BY w.pos), '') FROM a w WHERE w.doc_id = m.doc_id AND w.sent_id = m.sent_id AND (w.pos = {0} OR w.head = {0}))"


@query(f"WITH {ANNOTATED_SQL}, m AS (SELECT x.doc_id, x.sent_id, x.text AS modal, x.head AS v, y.lemma AS verb, (SELECT min(pos) FROM a c WHERE c.doc_id = x.doc_id AND c.sent_id = x.sent_id AND c.head = x.head AND starts_with(c.dep, 'nsubj')) AS s, (SELECT min(pos) FROM a c WHERE c.doc_id = x.doc_id AND c.sent_id = x.sent_id AND c.head = x.head AND c.dep IN ('dobj', 'attr', 'oprd')) AS o, EXISTS (SELECT 1 FROM a c WHERE c.doc_id = x.doc_id AND c.sent_id = x.sent_id AND c.head = x.head AND c.dep = 'neg') AS negated FROM a x JOIN a y ON y.doc_id = x.doc_id AND y.sent_id = x.sent_id AND y.pos = x.head WHERE lower(x.text) IN ('shall', 'may', 'must', 'will', 'should', 'can') AND x.head >= 0 AND regexp_matches(y.tag, '^(VB|MD)')) SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CASE WHEN s IS NULL THEN '' ELSE {PHRASE_SQL.format('s')} END AS subject, modal, negated, verb, CASE WHEN o IS NULL THEN '' ELSE {PHRASE_SQL.format('o')} END AS object, CASE WHEN lower(modal) IN ('shall', 'must') THEN CASE WHEN negated THEN 'PROHIBITION' ELSE 'OBLIGATION' END ELSE CASE WHEN negated THEN 'RESTRICTED RIGHT' ELSE 'RIGHT' END END AS type FROM m")
def contract_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.obligations(extract.annotations(cleaned(spark)))


@query(f"WITH {ANNOTATED_SQL}, r AS (SELECT *, regexp_matches(tag, '^(NN|JJ)') AND lower(text) NOT IN ({', '.join(map(literal, sorted(STOP_WORDS)))}) AS part FROM a), n AS (SELECT *, sum(CASE WHEN part THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS run FROM r), p AS (SELECT string_agg(lower(lemma), ' ' ORDER BY pos) AS noun_phrase FROM n WHERE part GROUP BY doc_id, sent_id, run HAVING count(*) >= 2) SELECT noun_phrase, count(*) AS frequency FROM p GROUP BY noun_phrase ORDER BY frequency DESC, noun_phrase LIMIT 15")
def contract_noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.noun_phrases(extract.annotations(cleaned(spark)))


@query(select("doc_id, money, dates, durations, other_numbers", [(1, 1, 0, 1, 1), (2, 1, 1, 1, 1), (3, 0, 0, 0, 0), (4, 0, 0, 1, 1), (5, 0, 0, 1, 1), (6, 1, 0, 1, 1), (7, 1, 0, 1, 1), (8, 0, 0, 0, 0), (9, 0, 0, 2, 2), (10, 0, 0, 1, 1), (11, 0, 0, 0, 1), (12, 0, 0, 0, 0), (13, 1, 0, 0, 0), (14, 0, 0, 0, 0), (15, 0, 0, 1, 1), (16, 0, 0, 0, 0)]))
def contract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted by hand in the texts above; list labels go with the cleaning."""
    return extract.numeric_profile(cleaned(spark))


@query(f"WITH {DOC_SQL}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM d) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE regexp_matches(line, {literal(ocr.AMOUNT_LINE.pattern)}) ORDER BY doc_id, line_no LIMIT 12")
def contract_amount_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.amount_lines(cleaned(spark))


# ---- kernels on examples, expected rows by hand ------------------------------------------------------------------

CLEANING = [
    (1, "“Fair” pay is the Company’s ﬁrst duty", "\"Fair\" pay is the Company's first duty"), (2, "termi-\nnation of a non-\ncompete", "termination of a non-compete"), (3, "Page 2 of 9\nkept\n12\nalso kept", "kept\nalso kept"),
    (4, "1. One.\n1.2) Two.\na) Three.\niv) Four.\n(a) Five", "One.\nTwo.\nThree.\nFour.\n(a) Five"), (5, "HEAD\nA.\nHEAD\nB.\nHEAD\nC.", "A.\nB.\nC."), (6, "HEAD.\nA.\nHEAD.\nB.", "HEAD.\nA.\nHEAD.\nB."),
    (7, "this line is rather long and goes\non here.\n\nNew Pvt.\nend", "this line is rather long and goes on here.\nNew Pvt. end"), (8, "a \t b\n\n\n\nC", "a b\nC"), (9, None, ""),
]


@query(select("id, text", [(i, out) for i, _, out in CLEANING]))
def cleaning_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t, _ in CLEANING], "id int, t string").select("id", K.clean_text(F.col("t")).alias("text"))


TYPED = [
    ("Rs. 5,000/- w.e.f. 01/04/2026", "Rs. 5,000/-:MONEY w.e.f.:ABBR 01/04/2026:DATE"), ("Section 27(2), Clause 4.2(a); non-compete", "Section 27(2):STATUTE ,:PUNCT Clause 4.2(a):CLAUSE ;:PUNCT non-compete:HYPHEN"),
    ("3rd naïve 1,000.50 at 9 a.m.", "rd:WORD na:WORD ve:WORD 1,000.50:NUMBER at:WORD 9 a.m.:TIME"), ("Indian Contract Act, 1872", "Indian Contract Act, 1872:STATUTE"), ("employee's ₹3.5 lakhs", "employee's:WORD ₹3.5 lakhs:MONEY"),
]


@query(select("id, typed", [(n, out) for n, (_, out) in enumerate(TYPED)]))
def typed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(TYPED)], "id int, t string")
    return rows.select("id", F.array_join(F.transform(K.typed_tokens(F.col("t")), lambda x: F.concat_ws(":", x["text"], x["type"])), " ").alias("typed"))


REPAIRS = [
    ("off", "¥500", "¥500", 0, 0), ("safe", "¥500 and 5,00,000/-", "₹500 and ₹5,00,000/-", 2, 0), ("safe", "12,00,000 shares at Rs. 1,00,000", "12,00,000 shares at Rs. 1,00,000", 0, 0), ("safe", "a sum of 12,34,567 is due", "a sum of ₹12,34,567 is due", 1, 0),
    ("safe", "salary 15,000 now", "salary 15,000 now", 0, 1), ("context", "salary 15,000 now", "salary ₹15,000 now", 1, 0), ("context", "15,000 words; $15,000", "15,000 words; $15,000", 0, 0),
]


@query(select("id, text, fixed, unresolved", [(n, out, a, b) for n, (_, _, out, a, b) in enumerate(REPAIRS)]))
def amount_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n, m, t) for n, (m, t, *_) in enumerate(REPAIRS)], "id int, mode string, t string")
    by = F.lit(None).cast("struct<text:string,fixed:int,unresolved:int>")
    for mode in ("off", "safe", "context"):
        by = F.when(F.col("mode") == mode, K.repair(mode)(F.col("t"))).otherwise(by)
    return rows.select("id", by.alias("r")).select("id", "r.*")


#: Content, and the text that its reader gives.
FILES = [
    ("a.txt", b"h\xc3\xa9llo \xff ok", "héllo  ok"), ("b.HTML", b"<p>One</p><script>no</script><b>Two &amp; 3</b>", "One\nTwo & 3"), ("c.json", b'{"k": ["x", 1, {"y": "z", "b": true}]}', "x\nz"),
    ("d.csv", b"h1,h2\na,\nb,c\n", "a \nb c"), ("e.pdf", b"%PDF", None), ("f.exe", b"", None), ("g.json", b"{bad", None),
]


@query(select("doc_id, file, text, failed, is_short", [(f"D{n:02d}", f, t, t is None, t is None or len(t.strip()) < 200) for n, (f, _, t) in enumerate((x for x in FILES if not x[0].endswith(".exe")), 1)]))
def read_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered in order of path, failed files included; those of other extensions are no documents."""
    files = spark.createDataFrame([(f"/in/{f}", bytearray(data)) for f, data, _ in FILES], "path string, content binary")
    found = readers.read_documents(readers.numbered(files))
    return found.select("doc_id", "file", "text", F.col("error").isNotNull().alias("failed"), F.coalesce("is_short", F.lit(True)).alias("is_short"))


SCANS = [
    ("D01", [("a layer of text that is long enough", None), ("", [(10.0, 60.0, 8.0, "5,00,000/-", 0.8), (11.0, 0.0, 8.0, "Pay", 0.9), (30.0, 0.0, 8.0, "now", 1.0)])]),
    ("D02", [("tiny", [(5.0, 0.0, 4.0, "salary 15,000", 0.5)]), ("tiny, no image", None)]),
    ("D03", [("only a layer, but it is a long one", [(0.0, 0.0, 1.0, "unused", 0.1)])]),
]


def _open(kind: str, data: bytes) -> list[pages.Page]:
    return [pages.Page(text, boxes) for text, boxes in json.loads(data)]


def scanned(spark: SparkSession) -> DataFrame:
    rows = [(d, "pdf", bytearray(json.dumps(ps).encode())) for d, ps in SCANS] + [("D04", "pdf", bytearray(b"broken"))]
    return pages.read_pages(spark.createDataFrame(rows, "doc_id string, format string, content binary"), _open, lambda: lambda boxes: [tuple(b) for b in boxes])


@query(select("doc_id, page_no, text, is_ocr, confidence, repairs, unresolved", [
    ("D01", 1, "a layer of text that is long enough", False, None, 0, 0), ("D01", 2, "Pay ₹5,00,000/-\nnow", True, 90.0, 1, 0), ("D02", 1, "salary 15,000", True, 50.0, 0, 1), ("D02", 2, "tiny, no image", False, None, 0, 0), ("D03", 1, "only a layer, but it is a long one", False, None, 0, 0),
]))
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rounded(scanned(spark).drop("unread"), 9, "confidence")


@query(select("doc_id, pages, ocr_pages, ocr_mean_conf, ocr_repairs, ocr_unresolved_amounts, low_confidence", [("D01", 2, 1, 90.0, 1, 0, False), ("D02", 2, 1, 50.0, 0, 1, True)]))
def ocr_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.ocr_report(readers.document_map(scanned(spark))).drop("text", "unread_scanned_pages")
    return evaluate.rounded(rows, 9, "ocr_mean_conf")


PIPELINE_EXAMPLES = [
    ("The Employee shall not disclose 6 (six) months of non-compete data.", "employe shall disclos 6 six month non-compet data", "the employee shall not disclose 6 six month of non compete data", "employee shall not disclose 6 month non-compete data"),
    ("Salaries of ₹12,00,000 were paid hereby.", "salari 12,00,000 paid herebi", "salary of ₹ 12,00,000 be pay hereby", "salary ₹12,00,000 pay"),
]


@query(select("id, pipeline, tokens", [(i, n, t) for i, (_, *outs) in enumerate(PIPELINE_EXAMPLES) for n, t in zip(NAMES, outs)]))
def pipeline_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(i, x[0]) for i, x in enumerate(PIPELINE_EXAMPLES)], "doc_id int, text string")
    found = extract.flat_tokens(extract.pipeline_tokens(docs)).groupBy("pipeline", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("x"))
    return found.select(F.col("doc_id").alias("id"), "pipeline", F.array_join(F.col("x.term"), " ").alias("tokens"))


#: word, stems by Porter, Snowball and Lancaster, lemma as a noun.
STEMS = [
    ("caresses", "caress", "caress", "caress", "caress"), ("ponies", "poni", "poni", "pony", "pony"), ("relational", "relat", "relat", "rel", "relational"), ("generalization", "gener", "general", "gen", "generalization"),
    ("happy", "happi", "happi", "happy", "happy"), ("skies", "ski", "sky", "ski", "sky"),
]


@query(select("word, porter, snowball, lancaster, lemma", STEMS))
def stemming_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.lemma_table(spark, [w for w, *_ in STEMS]).select("word", *stem.STEMMERS, "lemma")


MEANING = ["The Employee shall not leave before May.", "No bonus is payable unless hereby agreed."]


@query(f"WITH {values('s', 'sentence, w', [(s, [w for w in tokens.treebank(s.lower()) if w.isalpha()]) for s in MEANING])} SELECT sentence, " + ", ".join(f"array_to_string(list_filter(w, lambda x: NOT list_contains({literal(sorted(words))}, x)), ' ') AS {name}" for name, words in (("general", STOP_WORDS), ("custom", CUSTOM_STOP_WORDS))) + " FROM s")
def stop_word_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.stop_word_meaning(spark, MEANING, {"general": STOP_WORDS, "custom": CUSTOM_STOP_WORDS})


@query(select("kind, text, query, type", [("boolean", "bond training", "bond AND training", "Boolean AND"), ("phrase", " notice period ", '"notice period"', "Bigram"), ("free", " stipend ", "stipend", "Unigram")]))
def built_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, t, build_query(k, t)) for k, t in (("boolean", "bond training"), ("phrase", " notice period "), ("free", " stipend "))]
    return spark.createDataFrame(rows, "kind string, text string, query string").withColumn("type", T.query_type(F.col("query")))


@query(select("ngram, frequency", [("notice period", 12), ("shall not (disclose)", 3)]))
def parsed_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-grams of a report's cell."""
    return spark.createDataFrame([("notice period (12), shall not (disclose) (3)",)], "cell string").select(F.explode(T.parsed_ngrams(F.col("cell"))).alias("x")).select("x.*")


@query()
def subwords_by_two_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subwords of the domain's words by the corpus's own rules, and by a public vocabulary where there is one (else null)."""
    docs = cleaned(spark)
    merges = sub.learn_merges(sub.pre_tokens(docs), vocabulary=300)
    f = corpus.word_frequencies(docs)
    return sub.with_public(sub.subword_table(corpus.common_words(f, docs), corpus.rare_words(f), merges))


#: Literals are 32-bit integers in SQL; these columns are 64-bit ones.
LONG = {
    "contract_search": "doc_id", "entity_table_of_models": "sent_id", "contract_entities": "doc_id", "contract_obligations": "doc_id", "contract_amount_lines": "doc_id",
    "contract_numbers": "doc_id money dates durations other_numbers", "ocr_report": "pages ocr_pages ocr_repairs ocr_unresolved_amounts", "parsed_ngrams": "frequency",
}
for _name, _columns in LONG.items():
    ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _columns.split())}) FROM ({ORACLES[_name]})"

__all__ = ["ORACLES", "QUERIES"]
