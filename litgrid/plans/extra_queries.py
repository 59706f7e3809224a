"""More queries: fielded retrieval, aliases, greedy selection, second round, query text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.operators import index, rank
from litgrid.operators import phrases as P
from litgrid.sources import tables as S
from litgrid.sources.tables import held, small
from litgrid.streaming import streams

from .fixtures import BENCHMARK_QUERIES, CHUNKS, PAPERS, benchmark_queries, chunks, papers, table, title_sql, tokens_sql
from .registry import query
from .intent_queries import _KEPT, _WPHRASES, _WTERMS, phrases, terms
from .search_queries import _CHUNK_POST, _POST, _SCORES, _TITLE_POST, _bodies, _terms, _titles

c = F.col
_SCORES_CHUNKS = _SCORES(_CHUNK_POST).replace(f"WITH {PAPERS}, ", f"WITH {CHUNKS}, ").replace("FROM papers)", "FROM chunks)")


@query("i01_jsonl_scan", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def i01(spark, d):
    path = S.fresh_path(spark, "jsonl")
    S.write_jsonl(table(spark, d, "events").select("event_id", "event_type", "value"), path)
    return S.read_jsonl(spark, path, "event_id long, event_type string, value double").withColumn("value", F.round("value", 6))


@query("r06_title_baseline", f"""WITH {PAPERS}, {BENCHMARK_QUERIES}, {_TITLE_POST}, qt AS (SELECT qid, token, count(*) AS qf FROM (SELECT qid, unnest({tokens_sql('query_text')}) AS token FROM bq) GROUP BY ALL), n AS (SELECT count(*) AS n FROM papers), df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
    s AS (SELECT qid, doc_id, sum(tf * qf * ln(1 + n / (1 + df))) AS score FROM qt JOIN df USING (token) JOIN post USING (token), n GROUP BY ALL), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) WHERE r <= 5000),
    qn AS (SELECT qid, sqrt(sum(qf * qf)) AS q FROM qt GROUP BY qid), dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS d FROM post GROUP BY doc_id), dot AS (SELECT qid, doc_id, sum(qf * tf) AS x FROM qt JOIN post USING (token) GROUP BY ALL)
    SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT h.qid, h.doc_id, round(x / (q * d) + 0.01 * score, 6) AS score FROM h JOIN dot USING (qid, doc_id) JOIN qn USING (qid) JOIN dn USING (doc_id))) WHERE rank <= 30""")
def r06(spark, d):
    # first by summed weights, 5000 a query; these again by cosine and a hundredth of the sum
    titles = index.token_rows(papers(spark, d), "paper_id", c("title"))
    asked = benchmark_queries(spark, d).select("qid", F.explode(T.tokens(c("query_text"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("qf"))
    # a title is short: its tokens are counted within the row
    norm = F.sqrt(F.aggregate(F.transform(F.array_distinct("tokens"), lambda t: F.pow(F.size(F.filter("tokens", lambda x: x == t)), F.lit(2))), F.lit(0.0), lambda a, x: a + x))
    post = held(index.matched_postings(titles, asked))
    w = asked.join(post.groupBy("token").agg(F.count("*").alias("df")), "token").withColumn("w", c("qf") * index.tfidf_idf(papers(spark, d).count(), c("df")))
    s = post.join(small(w), "token").groupBy("qid", "doc_id").agg(F.sum(c("tf") * c("w")).alias("score"), F.sum(c("tf") * c("qf")).alias("dot"))
    head = rank.top_k(s, ["qid"], [F.desc(F.round("score", 9)), F.asc("doc_id")], 5000)
    norms = asked.groupBy("qid").agg(F.sqrt(F.sum(c("qf") * c("qf"))).alias("q"))
    again = head.join(titles.select("doc_id", norm.alias("d")), "doc_id").join(small(norms), "qid").select("qid", "doc_id", F.round(c("dot") / (c("q") * c("d")) + 0.01 * c("score"), 6).alias("score"))
    return rank.top_k(again, ["qid"], [F.desc("score"), F.asc("doc_id")], 30).select("qid", "doc_id", "score", c("rank").cast("long"))


@query("r07_best_fields", f"""WITH body AS ({_SCORES(_POST)}), title AS ({_SCORES(_TITLE_POST)}), nt AS (SELECT 'q' || item_id AS qid, len(list_distinct({tokens_sql('text')})) AS n FROM benchmark), u AS (SELECT qid, doc_id, score, matched FROM body UNION ALL SELECT qid, doc_id, 3 * score, matched FROM title),
    s AS (SELECT qid, doc_id, round(max(score), 6) AS score FROM u JOIN nt USING (qid) WHERE matched >= CASE WHEN n <= 2 THEN n ELSE greatest(1, floor(n * 0.25)) END GROUP BY ALL) SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20""")
def r07(spark, d):
    # a quarter of the query's tokens here, as the invented prose shares few words; the usual share is .55
    found = index.best_fields(_terms(spark, d), [(_bodies(spark, d), 1.0), (_titles(spark, d), 3.0)], share=0.25)
    best = found.withColumn("score", F.round("score", 6))
    return rank.top_k(best, ["qid"], [F.desc("score"), F.asc("doc_id")], 20).withColumn("rank", c("rank").cast("long"))


def _clause_sql(clauses: str) -> str:
    """CTEs from cl (qid, field, phrase, slop, boost) to sc (qid, doc_id, field, phrase, slop, frequency, score), over fields of papers."""
    return f"""fr AS (SELECT paper_id AS doc_id, 'title' AS field, {_words_sql('title')} AS ws FROM papers UNION ALL SELECT paper_id, 'body', {_words_sql('abstract')} FROM papers),
    sz AS (SELECT field, count(*) AS texts, avg(len(ws)) AS mean FROM fr GROUP BY field), pos AS (SELECT doc_id, field, len(ws) AS length, unnest(ws) AS token, generate_subscripts(ws, 1) AS p FROM fr), {clauses}, asked AS (SELECT DISTINCT field, slop, phrase FROM cl),
    df AS (SELECT field, token, count(DISTINCT doc_id) AS df FROM pos GROUP BY ALL), wd AS (SELECT field, slop, phrase, unnest(phrase) AS token FROM asked),
    idf AS (SELECT field, slop, phrase, sum(ln(1 + (texts - df + 0.5) / (df + 0.5))) AS idf FROM wd JOIN df USING (field, token) JOIN sz USING (field) GROUP BY ALL HAVING count(*) = len(phrase)),
    m AS (SELECT a.field, slop, phrase, doc_id, length, 1 AS i, p, 0::BIGINT AS g FROM asked a JOIN pos ON pos.field = a.field AND token = phrase[1] UNION SELECT m.field, slop, phrase, m.doc_id, m.length, i + 1, pos.p, g + pos.p - m.p - 1 FROM m JOIN pos ON pos.field = m.field AND pos.doc_id = m.doc_id AND token = phrase[i + 1] AND pos.p > m.p AND pos.p <= m.p + 1 + slop - g WHERE i < len(phrase)),
    fq AS (SELECT field, slop, phrase, doc_id, length, sum(1.0::DOUBLE / (1 + g)) AS f FROM m WHERE i = len(phrase) GROUP BY ALL),
    sc AS (SELECT qid, doc_id, field, phrase, slop, f AS frequency, boost * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * length / mean)) AS score FROM cl JOIN fq USING (field, slop, phrase) JOIN idf USING (field, slop, phrase) JOIN sz USING (field))"""


def _words_sql(x: str) -> str:
    return f"list_filter(string_split({title_sql(x)}, ' '), lambda w: w <> '')"


#: By field: boost and words allowed between. Fixed values of phrase clauses, and of weighted terms and weighted phrases.
PHRASE_BOOSTS = {"title": (1.4, 0), "body": (0.6, 1)}
TERM_BOOSTS = {"title": (3.4, 0), "body": (1.1, 0)}
WEIGHTED_PHRASE_BOOSTS = {"title": (3.4, 0), "body": (1.1 * 0.7, 1)}
#: Clauses of a query: phrases by themselves, weighted terms, weighted phrases.
PHRASES, WEIGHTED_TERMS, WEIGHTED_PHRASES = 6, 10, 6
_SENTENCES = f"st AS (SELECT qid, list_filter(list_transform(regexp_split_to_array(query_text, '[.!?\\n]+'), lambda s: {_words_sql('s')}), lambda l: len(l) >= 2) AS ls FROM bq), ph AS (SELECT qid, unnest(list_filter(ls, lambda v, i: list_position(ls, v) = i)[1:{PHRASES}]) AS phrase FROM st)"
_boosted = lambda source, weight, boosts: " UNION ALL ".join(f"SELECT qid, '{f}' AS field, phrase, {slop} AS slop, round({b}::DOUBLE * {weight}, 4) AS boost FROM {source}" for f, (b, slop) in boosts.items())


def _fields(spark, d):
    return P.field_rows(papers(spark, d), "paper_id", {"title": c("title"), "body": c("abstract")})


@query("r09_phrase_match", f"WITH RECURSIVE {PAPERS}, {BENCHMARK_QUERIES}, {_SENTENCES}, {_clause_sql(f'cl AS ({_boosted("ph", "1.0::DOUBLE", PHRASE_BOOSTS)})')} SELECT qid, doc_id AS paper_id, array_to_string(phrase, ' ') AS phrase, field, frequency, round(score, 6) AS score FROM sc")
def r09(spark, d):
    """Whole phrases: a query's sentences of two words at least, in place in titles, with up to one word between in bodies."""
    sentences = F.filter(F.transform(F.split("query_text", r"[.!?\n]+"), P.words), lambda w: F.size(w) >= 2)
    phrases_ = benchmark_queries(spark, d).select("qid", F.explode(F.slice(F.array_distinct(sentences), 1, PHRASES)).alias("phrase"), F.lit(1.0).alias("weight"))
    found = P.clause_scores(P.phrase_clauses(phrases_, PHRASE_BOOSTS), _fields(spark, d))
    return found.select("qid", c("doc_id").alias("paper_id"), F.array_join("phrase", " ").alias("phrase"), "field", "frequency", F.round("score", 6).alias("score"))


_CLAUSES = f"""WITH RECURSIVE {PAPERS}, {BENCHMARK_QUERIES}, {_KEPT}, {_WTERMS}, {_WPHRASES}, ct AS (SELECT qid, [term] AS phrase, weight FROM wt WHERE place <= {WEIGHTED_TERMS}), cp AS (SELECT qid, string_split(phrase, ' ') AS phrase, weight FROM wp WHERE place <= {WEIGHTED_PHRASES}),
    {_clause_sql(f'cl AS ({_boosted("ct", "weight", TERM_BOOSTS)} UNION ALL {_boosted("cp", "weight", WEIGHTED_PHRASE_BOOSTS)})')} SELECT qid, doc_id AS paper_id, round(sum(score), 6) AS score, count(*) AS clauses FROM sc GROUP BY ALL"""


@query("r10_weighted_clauses", _CLAUSES)
def r10(spark, d):
    """The ten heaviest terms and six heaviest phrases of a query in each field, summed up; phrases may have a word between in bodies."""
    t = terms(spark, d).where(c("place") <= WEIGHTED_TERMS).select("qid", P.words(c("term")).alias("phrase"), "weight")
    p = phrases(spark, d).where(c("place") <= WEIGHTED_PHRASES).select("qid", P.words(c("phrase")).alias("phrase"), "weight")
    clauses = P.phrase_clauses(t, TERM_BOOSTS).unionByName(P.phrase_clauses(p, WEIGHTED_PHRASE_BOOSTS))
    found = P.clause_scores(clauses, _fields(spark, d))
    return found.groupBy("qid", c("doc_id").alias("paper_id")).agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("clauses"))


@query("r13_chunk_type_boost", f"WITH s AS ({_SCORES_CHUNKS}) SELECT qid, chunk_id, score, rank FROM (SELECT qid, doc_id AS chunk_id, round(s.score + CASE WHEN chunk_type = 'title_abstract' THEN 0.35 ELSE 0 END, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s.score + CASE WHEN chunk_type = 'title_abstract' THEN 0.35 ELSE 0 END, 6) DESC, doc_id) AS rank FROM s JOIN (SELECT 'doc:' || doc_id || '#chunk:' || (i - 1) AS doc_id, CASE WHEN i = 1 THEN 'title_abstract' ELSE 'section' END AS chunk_type FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) k USING (doc_id)) WHERE rank <= 20")
def r13(spark, d):
    """Chunk scores with a constant for titles and abstracts, ranked with it."""
    plus = F.when(c("chunk_type") == "title_abstract", 0.35).otherwise(0.0)
    rows = chunks(spark, d).select(c("chunk_id").alias("doc_id"), T.tokens(c("text")).alias("tokens"), plus.alias("plus")).withColumn("length", F.size("tokens"))
    found = index.bm25(_terms(spark, d), rows, 20, digits=6)
    return found.select("qid", c("doc_id").alias("chunk_id"), F.round("score", 6).alias("score"), c("rank").cast("long"))


@query("r21_concept_ids", "SELECT p_partkey, ty AS type, 'concept:' || substr(sha1(ty || chr(31) || lower(p_name)), 1, 20) AS concept_id FROM part, (SELECT unnest(['method', 'dataset']) AS ty)")
def r21(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.array(F.lit("method"), F.lit("dataset"))).alias("type"), "p_name").select("p_partkey", "type", T.stable_hash("concept", c("type"), F.lower("p_name")).alias("concept_id"))


@query("s3_stream_deduplication", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def s3(spark, d):
    out = streams.run_once(spark, f"{d}/events.parquet", lambda df: streams.deduplicated(df, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "append")
    return out.groupBy("event_type").agg(F.count("*").alias("users"))


@query("q32_rewrite_merge", f"SELECT conv_id, array_to_string(list_filter(ws, lambda v, i: list_position(ws, v) = i)[1:12], '|') AS merged FROM (SELECT a.conv_id, list_concat({tokens_sql('b.text')}[1:6], {tokens_sql('a.text')}[1:10]) AS ws FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 1 WHERE a.turn = 0)")
def q32(spark, d):
    x = table(spark, d, "conversations")
    first, rewrite = x.where("turn = 0").select("conv_id", T.tokens(c("text")).alias("own")), x.where("turn = 1").select("conv_id", T.tokens(c("text")).alias("new"))
    merged = F.array_distinct(F.concat(F.slice("new", 1, 6), F.slice("own", 1, 10)))
    return first.join(rewrite, "conv_id").select("conv_id", F.array_join(F.slice(merged, 1, 12), "|").alias("merged"))


@query("s4_scoring_hook", "SELECT doc_id, round(length(text) / (length(text) + 1000.0), 6) AS score FROM documents")
def s4(spark, d):
    return streams.scored(table(spark, d, "documents").select("doc_id", "text"), "text", lambda texts: [len(t) / (len(t) + 1000.0) for t in texts]).select("doc_id", F.round("score", 6).alias("score"))
