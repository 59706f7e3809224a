"""Queries of the column functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litgrid.functions import text as T

from .fixtures import PAPERS, fold_sql, papers, space_sql, table, title_sql, tokens_sql
from .registry import query

c = F.col


def on(name: str, source: str, key: str, column, sql: str) -> None:
    """A query of one expression over a whole table; long texts are compared by their MD5."""
    query(name, f"SELECT {key}, {sql} AS value FROM {source}")(lambda spark, d: table(spark, d, source).select(key, column().alias("value")))


on("f01_normalize_space", "documents", "doc_id", lambda: F.md5(T.normalize_space(c("text"))), f"md5({space_sql('text')})")
on("f02_normalize_title", "documents", "doc_id", lambda: F.md5(T.normalize_title(c("text"))), f"md5({title_sql('text')})")
on("f03_graph_title", "documents", "doc_id", lambda: F.md5(T.normalize_graph_title(c("text"))), "md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\\pL\\pN_]+', ' ', 'g')))")
on("f04_concept_term", "part", "p_partkey", lambda: T.normalize_concept(F.concat("p_type", F.lit("-"), "p_name")), "trim(regexp_replace(replace(lower(p_type || '-' || p_name), '-', ' '), '[^a-z0-9]+', ' ', 'g'))")
on("f05_tokenize", "documents", "doc_id", lambda: F.md5(F.array_join(T.tokens(c("text")), " ")), f"md5(array_to_string({tokens_sql('text')}, ' '))")
on("f10_arxiv_id", "pages", "page_id", lambda: T.arxiv_id(F.concat(F.lit(" https://arxiv.org/pdf/24"), F.lpad((c("page_id") % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad("page_id", 5, "0"), F.when(c("page_id") % 2 == 0, "v2").otherwise(""), F.lit(".pdf"))), "'24' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(page_id AS VARCHAR), 5, '0')")
on("f11_title_hash", "documents", "doc_id", lambda: T.title_hash(c("text")), f"'title:' || substr(sha1(lower({space_sql('text')})), 1, 16)")
on("f11_title_id", "documents", "doc_id", lambda: T.title_id(c("text")), f"'title:' || substr(sha1({title_sql('text')}), 1, 16)")
on("f12_stable_hash", "documents", "doc_id", lambda: T.stable_hash("section", c("source"), c("doc_id"), c("lang")), "'section:' || substr(sha1(coalesce(source, '') || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(lang, '')), 1, 20)")
on("f13_slug", "documents", "doc_id", lambda: F.md5(T.slug(c("text"))), f"md5(regexp_replace(lower({fold_sql('text')}), '[^a-z]', '', 'g'))")
on("f14_token_estimate", "documents", "doc_id", lambda: T.token_estimate(c("text")), "CAST(greatest(1, length(coalesce(text, '')) // 4) AS BIGINT)")
on("f15_year_from_arxiv", "pages", "page_id", lambda: T.year_from_arxiv(F.concat(F.lpad((c("page_id") % 100).cast("string"), 2, "0"), F.lit("01.00001v3"))), "CAST(CASE WHEN page_id % 100 < 90 THEN 2000 + page_id % 100 ELSE 1900 + page_id % 100 END AS INTEGER)")
on("f16_published_date", "orders", "o_orderkey", lambda: T.published_date(F.when(c("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))), "CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END")
_ID = lambda: F.concat(F.element_at(F.array(*map(F.lit, ("https://doi.org/10.1/", "arXiv:2401.", "CorpusID:", "paperId:", "pmid:", "isbn:"))), (c("doc_id") % 6 + 1).cast("int")), c("doc_id"), F.when(c("doc_id") % 6 == 1, "v3").otherwise(""))
on("f17_stable_id", "documents", "doc_id", lambda: T.stable_id(_ID()), "['doi:10.1/' || doc_id, 'arxiv:2401.' || doc_id, 's2-corpus:' || doc_id, 's2:' || doc_id, 'pmid:' || doc_id, ''][doc_id % 6 + 1]")
on("f18_external_aliases", "documents", "doc_id", lambda: F.array_join(T.external_aliases(F.create_map(F.lit("ArXiv"), F.col("doc_id").cast("string"), F.lit("DOI"), F.upper("source"), F.lit("CorpusId"), F.when(c("doc_id") % 2 == 0, c("doc_id").cast("string")), F.lit("MAG"), F.lit(""))), ","), "'arxiv:' || doc_id || ',doi:' || lower(source) || CASE WHEN doc_id % 2 = 0 THEN ',s2-corpus:' || doc_id ELSE '' END")
_SECTION = lambda: F.element_at(F.array(*map(F.lit, ("1. Introduction", "Related Work", "Our Approach", "Results & Analysis", "Discussion", "Appendix"))), (c("doc_id") % 6 + 1).cast("int"))
on("f19_section_role", "documents", "doc_id", lambda: F.concat_ws(":", T.section_role(_SECTION()), F.format_string("%.2f", T.role_weight(T.section_role(_SECTION())))), "['introduction:1.05', 'related_work:1.10', 'method:1.00', 'experiment:0.85', 'conclusion:0.70', 'other:0.80'][doc_id % 6 + 1]")
_NAME = lambda: F.element_at(F.array(*map(F.lit, ("Question Benchmark", "F1 score", "a GPT variant", "dense retrieval", "knowledge graph", "thing"))), (c("p_partkey") % 6 + 1).cast("int"))
on("f20_concept_type", "part", "p_partkey", lambda: T.concept_type(_NAME()), "['dataset', 'metric', 'model', 'method', 'domain', 'other'][p_partkey % 6 + 1]")
on("f21_safe_int", "events", "event_id", lambda: T.safe_int(F.when(c("event_id") % 3 == 0, c("event_type")).otherwise((c("event_id") % 1000).cast("string"))), "CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(event_id % 1000 AS INTEGER) END")
on("f22_truncate", "documents", "doc_id", lambda: T.truncated(c("text"), 120), "CASE WHEN length(text) > 120 THEN rtrim(substr(text, 1, 117)) || '...' ELSE text END")


@query("f06_term_counts", f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY ALL")
def f06(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.tokens(c("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(
    "f07_compact_terms",
    f"""SELECT doc_id, token, n, rank FROM (SELECT doc_id, token, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM
    (SELECT doc_id, token, count(*) AS n, min(i) AS pos FROM (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, {tokens_sql('text')} AS ts FROM documents)) GROUP BY ALL)) WHERE rank <= 10""",
)
def f07(spark, d):
    from litgrid.operators.rank import top_k

    terms = table(spark, d, "documents").select("doc_id", F.posexplode(T.tokens(c("text"))).alias("pos", "token"))
    counts = terms.groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return top_k(counts, ["doc_id"], [F.desc("n"), F.asc("pos")], 10).select("doc_id", "token", "n", F.col("rank").cast("long"))


@query("f08_sparse_cosine", f"""WITH t AS (SELECT conv_id, turn, unnest({tokens_sql('text')}) AS token FROM conversations), n AS (SELECT conv_id, turn, token, count(*) AS n FROM t GROUP BY ALL),
    s AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS norm FROM n GROUP BY ALL)
    SELECT a.conv_id, a.turn, round(sum(a.n * b.n) / (any_value(s.norm) * any_value(r.norm)), 6) AS cosine FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.token = b.token
    JOIN s ON s.conv_id = a.conv_id AND s.turn = a.turn JOIN s r ON r.conv_id = b.conv_id AND r.turn = b.turn GROUP BY a.conv_id, a.turn""")
def f08(spark, d):
    from litgrid.operators.index import sparse_cosine

    n = table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.tokens(c("text"))).alias("token")).groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"))
    return sparse_cosine(n, n.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"], "token", "n").withColumn("cosine", F.round("cosine", 6))


@query("f09_best_snippet", f"""WITH {PAPERS}, s AS (SELECT paper_id, i, trim(part) AS sentence FROM (SELECT paper_id, unnest(ss) AS part, generate_subscripts(ss, 1) AS i FROM (SELECT paper_id, regexp_extract_all({space_sql('abstract')}, '[^.!?]+[.!?]*') AS ss FROM papers)) WHERE trim(part) <> ''),
    k AS (SELECT s.paper_id, sentence, row_number() OVER (PARTITION BY s.paper_id ORDER BY len(list_intersect(list_distinct({tokens_sql('sentence')}), {tokens_sql('title')})) DESC, i) AS rn FROM s JOIN papers p ON p.paper_id = s.paper_id)
    SELECT p.paper_id, CASE WHEN length(coalesce(sentence, '')) > 260 THEN rtrim(substr(sentence, 1, 257)) || '...' ELSE coalesce(sentence, {space_sql('abstract')}) END AS snippet FROM papers p LEFT JOIN (SELECT * FROM k WHERE rn = 1) k ON k.paper_id = p.paper_id""")
def f09(spark, d):
    return papers(spark, d).select("paper_id", T.best_snippet(c("abstract"), T.tokens(c("title"))).alias("snippet"))


@query("f23_distinct_ignoring_case", "SELECT conv_id, turn, array_to_string(list_filter(ws, lambda v, i: list_position(list_transform(ws, lambda y: lower(y)), lower(v)) = i), '|') AS value FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ' '), lambda v: trim(v)), lambda v: v <> '') AS ws FROM conversations)")
def f23(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.distinct_ignoring_case(F.split("text", " ")), "|").alias("value"))


@query("f24_year_venue_filter", f"WITH {PAPERS} SELECT paper_id, year, venue FROM papers WHERE year BETWEEN 2013 AND 2019 AND upper(venue) IN ('SRC1', 'SRC2')")
def f24(spark, d):
    return papers(spark, d).where(T.in_year_range(c("year"), F.lit("2013-2019")) & F.upper("venue").isin("SRC1", "SRC2")).select("paper_id", "year", "venue")


on("f25_open_hyphens", "part", "p_partkey", lambda: T.open_hyphens(F.concat("p_brand", F.lit(" state-of-the-art  - "), "p_type")), "trim(regexp_replace(p_brand || ' state of the art - ' || p_type, '[\\s]+', ' ', 'g'))")


@query("f26_hash_slot")
def f26(spark, d):
    return table(spark, d, "part").select("p_partkey", T.hash_slot(c("p_name"), 1 << 18).alias("slot"))


@query("f27_dense_text", f"WITH {PAPERS} SELECT paper_id, md5(array_to_string(list_filter([CASE WHEN title <> '' THEN 'title: ' || title END, CASE WHEN venue <> '' THEN 'metadata: ' || venue END, CASE WHEN abstract <> '' THEN 'abstract: ' || substr(abstract, 1, 2200) END], lambda x: x IS NOT NULL), chr(10))) AS value FROM papers")
def f27(spark, d):
    return papers(spark, d).select("paper_id", F.md5(T.dense_text(c("title"), c("venue"), c("abstract"))).alias("value"))


@query("f28_sparse_text", f"WITH {PAPERS} SELECT paper_id, md5(title || chr(10) || title || chr(10) || substr(abstract, 1, 2200)) AS value FROM papers")
def f28(spark, d):
    return papers(spark, d).select("paper_id", F.md5(T.sparse_text(c("title"), c("abstract"))).alias("value"))


@query("f29_evidence_text", f"WITH {PAPERS} SELECT paper_id, md5(substr(CASE WHEN title = abstract OR title = '' THEN abstract WHEN abstract = '' THEN title ELSE abstract || chr(10) || title END, 1, 6000)) AS value FROM papers")
def f29(spark, d):
    return papers(spark, d).select("paper_id", F.md5(T.evidence_text(c("abstract"), F.array("title"))).alias("value"))


@query("f30_json_object", "SELECT event_id, props AS value FROM events")
def f30(spark, d):
    answer = F.concat(F.lit("<think>a {b}\n</think>\n```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", T.json_object(answer).alias("value"))


@query("f31_clean_rewrites", f"""SELECT doc_id, array_to_string(list_filter(ws, lambda v, i: list_position(list_transform(ws, lambda y: lower(y)), lower(v)) = i)[1:8], '|') AS value FROM (SELECT doc_id, list_filter(list_transform(list_transform(string_split(text, '.'), lambda v: substr({space_sql('v')}, 1, 180)), lambda v: trim(v)), lambda v: v <> '' AND NOT regexp_matches(v, '(?i)arxiv:|doi:') AND NOT regexp_matches(substr(v, 1, 12), '[0-9]')) AS ws FROM documents)""")
def f31(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.clean_rewrites(F.split("text", r"\.")), "|").alias("value"))
