"""Queries of sources and tables (I), graph (G), training sets (T) and streams (S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.operators import graph, index, training
from litgrid.sources import paging
from litgrid.sources import tables as S

from .fixtures import BENCHMARK_QUERIES, CHUNKS, PAPERS, benchmark_queries, chunks, papers, space_sql, table, title_sql, tokens_sql
from .registry import query

c = F.col


@query("i03_last_row_wins", "SELECT c_nationkey, max(c_custkey) AS c_custkey, arg_max(c_name, c_custkey) AS c_name FROM customer WHERE c_name <> '' GROUP BY c_nationkey")
def i03(spark, d):
    return S.latest(table(spark, d, "customer").where("c_name <> ''"), ["c_nationkey"], [F.desc("c_custkey")]).select("c_nationkey", "c_custkey", "c_name")


_I04 = f"WITH {CHUNKS} SELECT paper_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY chunk_index)) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index) AS i FROM chunks) WHERE i <= 4 GROUP BY paper_id"


@query("i04_chunks_by_paper", _I04)
def i04(spark, d):
    return _chunks_by_paper(spark, d, papers(spark, d))


def _chunks_by_paper(spark, d, papers):
    known = papers.select("paper_id")
    kept = S.first_n(chunks(spark, d).join(known, "paper_id", "left_semi"), ["paper_id"], [F.asc("chunk_index")], 4)
    return kept.groupBy("paper_id").agg(F.count("*").alias("n"), F.md5(F.array_join(S.ordered_list("text", "chunk_index"), "\n")).alias("texts"))


@query("i05_section_titles", f"WITH {CHUNKS}, f AS (SELECT paper_id, chunk_index, split_part(text, ' ', 1) AS w, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index) AS i FROM chunks), g AS (SELECT paper_id, w, min(chunk_index) AS pos FROM f WHERE i <= 6 GROUP BY ALL) SELECT paper_id, string_agg(w, '|' ORDER BY pos) AS titles FROM g WHERE w <> '' GROUP BY paper_id")
def i05(spark, d):
    head = S.first_n(chunks(spark, d), ["paper_id"], [F.asc("chunk_index")], 6).withColumn("w", F.split("text", " ")[0])
    return head.where("w <> ''").groupBy("paper_id").agg(F.array_join(F.array_distinct(S.ordered_list("w", "chunk_index")), "|").alias("titles"))


@query("i06_queries_scan", f"WITH {BENCHMARK_QUERIES} SELECT qid, query_text FROM bq WHERE query_text LIKE '%the%' ORDER BY qid LIMIT 25")
def i06(spark, d):
    return benchmark_queries(spark, d).where("query_text like '%the%'").orderBy("qid").limit(25)


@query("i08_paper_conversion", f"WITH {PAPERS}, w AS (SELECT regexp_replace(lower(split_part(text, '.', 1)), '[^a-z]', '', 'g') AS slug, min(doc_id) AS full_id FROM documents WHERE lang = 'en' GROUP BY 1) SELECT paper_id, coalesce(full_id, -1) AS full_id FROM papers LEFT JOIN w ON slug = regexp_replace(lower(strip_accents(title)), '[^a-z]', '', 'g') AND slug <> ''")
def i08(spark, d):
    full = table(spark, d, "documents").where("lang = 'en'").groupBy(F.regexp_replace(F.lower(F.split("text", r"\.")[0]), "[^a-z]", "").alias("slug")).agg(F.min("doc_id").alias("full_id")).where("slug <> ''")
    return papers(spark, d).withColumn("slug", T.slug(c("title"))).join(full, "slug", "left").select("paper_id", F.coalesce("full_id", F.lit(-1)).alias("full_id"))


@query("i11_sharded_scan", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey > 100 AND ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 4 = 1")
def i11(spark, d):
    """A shard of the orders above a bound in five pages; the scan stops after two, and another goes on at its cursor."""
    shard = F.conv(F.substring(F.md5(c("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long") % 4 == 1
    path = S.fresh_path(spark, "paged-scan")
    scan = lambda: paging.PagedScan(spark, table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", path, 5, lower=100, shard=shard)
    scan().run(2)
    rest = scan()
    rest.run()
    return rest.result().select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("i12_upsert", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0")
def i12(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return S.upsert(old, old.where("c_custkey % 3 = 0").withColumn("c_acctbal", c("c_acctbal") + 1), ["c_custkey"])


@query("i14_key_lookup", "SELECT DISTINCT l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 49")
def i14(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity >= 49").select("l_partkey").distinct()
    return keys.join(table(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")


@query("i17_preview_rows", f"WITH {CHUNKS} SELECT chunk_id, substr(text, 1, 80) AS preview, length(text) AS text_length, CAST(chunk_index AS INTEGER) AS chunk_index FROM chunks")
def i17(spark, d):
    return chunks(spark, d).select("chunk_id", F.substring("text", 1, 80).alias("preview"), F.length("text").cast("long").alias("text_length"), c("chunk_index").cast("int"))


@query("i19_store_counts", f"WITH {CHUNKS} SELECT 'documents' AS store, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'labels', count(*) FROM labels")
def i19(spark, d):
    return S.counts({"documents": table(spark, d, "documents"), "chunks": chunks(spark, d), "labels": table(spark, d, "labels")})


@query("i20_orphans", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) GROUP BY l_suppkey")
def i20(spark, d):
    return S.orphans(table(spark, d, "lineitem"), "l_suppkey", table(spark, d, "supplier").where("s_nationkey < 12"), "s_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("i20_duplicate_keys", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def i20d(spark, d):
    return S.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("i23_unit_vectors", "SELECT vec_id, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first, round(embedding[64] / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS last FROM embeddings")
def i23(spark, d):
    v = index.unit(c("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.element_at(v, 1), 5).alias("first"), F.round(F.element_at(v, 64), 5).alias("last"))


@query("i24_title_map", f"WITH {PAPERS} SELECT norm, min(doc_id) AS doc_id FROM (SELECT {title_sql('title')} AS norm, doc_id FROM papers) WHERE norm <> '' GROUP BY norm")
def i24(spark, d):
    return papers(spark, d).select(T.normalize_title(c("title")).alias("norm"), "doc_id").where("norm <> ''").groupBy("norm").agg(F.min("doc_id").alias("doc_id"))


@query("i27_multi_source_text", f"SELECT 'b' AS origin, item_id AS id, md5({space_sql('text')}) AS value FROM benchmark UNION ALL SELECT 'c', conv_id * 1000 + turn, md5({space_sql('text')}) FROM conversations WHERE {space_sql('text')} <> ''")
def i27(spark, d):
    text = T.normalize_space(c("text"))
    a = table(spark, d, "benchmark").where(text != "").select(F.lit("b").alias("origin"), c("item_id").alias("id"), F.md5(text).alias("value"))
    return a.unionByName(table(spark, d, "conversations").where(text != "").select(F.lit("c").alias("origin"), (c("conv_id") * 1000 + c("turn")).alias("id"), F.md5(text).alias("value")))


# ---- graph: suppliers as papers, parts as concepts

_MENTIONS = "mentions AS (SELECT l_suppkey AS paper_id, l_partkey AS concept, max(1 - l_discount) AS confidence FROM lineitem GROUP BY ALL)"
_CITES = "cites AS (SELECT DISTINCT l_suppkey AS source, l_partkey % (SELECT count(*) FROM supplier) + 1 AS target FROM lineitem WHERE l_quantity >= 45)"


def mentions(spark, d):
    return table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("paper_id"), c("l_partkey").alias("concept")).agg(F.max(1 - c("l_discount")).alias("confidence"))


def cites(spark, d):
    n = table(spark, d, "supplier").count()
    return table(spark, d, "lineitem").where("l_quantity >= 45").select(c("l_suppkey").alias("source"), (c("l_partkey") % n + 1).alias("target")).distinct()


@query("r18_concept_search", f"WITH {_MENTIONS}, asked AS (SELECT o_custkey % 40 AS qid, o_orderkey % 2000 + 1 AS concept FROM orders GROUP BY ALL), s AS (SELECT qid, paper_id, count(DISTINCT m.concept) AS support, round(1.2 * count(DISTINCT m.concept) + sum(confidence), 6) AS score FROM mentions m JOIN asked a ON a.concept = m.concept WHERE confidence >= 0.95 GROUP BY ALL) SELECT qid, paper_id, support, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, paper_id DESC) AS rank FROM s) WHERE rank <= 10")
def r18(spark, d):
    asked = table(spark, d, "orders").select((c("o_custkey") % 40).alias("qid"), (c("o_orderkey") % 2000 + 1).alias("concept")).distinct()
    found = graph.concept_search(asked, mentions(spark, d), 0.95, 10)
    return found.select("qid", "paper_id", "support", F.round("score", 6).alias("score"), c("rank").cast("long"))


def _near(edges: str, n: int, weight: float, name: str) -> str:
    return f"SELECT qid, paper_id, '{name}' AS relation, {weight} * greatest(1, support) AS score FROM (SELECT s.qid, e.target AS paper_id, count(*) AS support, row_number() OVER (PARTITION BY s.qid ORDER BY count(*) DESC, e.target) AS i FROM seeds s JOIN ({edges}) e ON e.source = s.paper_id WHERE NOT EXISTS (SELECT 1 FROM seeds t WHERE t.qid = s.qid AND t.paper_id = e.target) GROUP BY s.qid, e.target) WHERE i <= {n}"


@query("r28_seed_limit", "SELECT qid, paper_id FROM (SELECT o_custkey AS qid, o_orderkey AS paper_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i <= 3")
def r28(spark, d):
    return S.first_n(table(spark, d, "orders").select(c("o_custkey").alias("qid"), c("o_orderkey").alias("paper_id")).distinct(), ["qid"], [F.asc("paper_id")], 3)


_WORDS = f"ws AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)"
_HINTS = f"hints AS (SELECT token AS word FROM (SELECT DISTINCT doc_id, unnest(w) AS token FROM ws) GROUP BY token HAVING count(*) BETWEEN 20 AND 60)"


@query("g01_concepts", f"""WITH {_WORDS}, {_HINTS}, tk AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM ws), ph AS (SELECT doc_id, phrase FROM (SELECT doc_id, t || ' ' || lead(t) OVER x AS phrase FROM tk WINDOW x AS (PARTITION BY doc_id ORDER BY i) UNION ALL SELECT doc_id, t || ' ' || lead(t) OVER x || ' ' || lead(t, 2) OVER x FROM tk WINDOW x AS (PARTITION BY doc_id ORDER BY i)) WHERE phrase IS NOT NULL),
    n AS (SELECT doc_id, phrase, count(*) AS n FROM ph GROUP BY ALL), h AS (SELECT DISTINCT phrase FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS word FROM (SELECT DISTINCT phrase FROM n)) SEMI JOIN hints USING (word))
    SELECT doc_id, phrase, n, round(least(1.0, 0.55 + 0.08 * n), 6)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(phrase) DESC, phrase) AS i FROM n SEMI JOIN h USING (phrase)) WHERE i <= 12""")
def g01(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.tokens(c("text")).alias("w"))
    hints = docs.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("df")).where("df between 20 and 60")
    return graph.concepts(docs, "doc_id", c("w"), hints).withColumn("confidence", F.round("confidence", 6))


@query("g04_reference_resolution", f"WITH {PAPERS}, r AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS title FROM pages), m AS (SELECT {title_sql('title')} AS norm, min(paper_id) AS target FROM papers GROUP BY 1) SELECT page_id, title, target AS target_paper_id, CASE WHEN target IS NULL THEN 0.0 ELSE 0.95 END::DOUBLE AS score, count(*) AS n FROM r LEFT JOIN m ON norm = {title_sql('r.title')} AND norm <> '' GROUP BY ALL")
def g04(spark, d):
    refs = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("title"))
    return graph.resolve(refs, "title", papers(spark, d).select("paper_id", "title")).groupBy("page_id", "title", "target_paper_id", "score").agg(F.count("*").alias("n"))


@query("g08_latest_edges", "SELECT l_suppkey, l_partkey, arg_max(l_quantity, struct_pack(a := l_orderkey, b := l_linenumber)) AS quantity FROM lineitem GROUP BY ALL")
def g08(spark, d):
    return S.latest(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"], [F.desc("l_orderkey"), F.desc("l_linenumber")]).select("l_suppkey", "l_partkey", c("l_quantity").alias("quantity"))


_REFS = f"refs AS (SELECT r.page_id, target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS title FROM pages) r LEFT JOIN (SELECT {title_sql('title')} AS norm, min(paper_id) AS target FROM papers GROUP BY 1) m ON norm = {title_sql('r.title')} AND norm <> '')"


@query("g09_graph_statistics", f"""WITH {_MENTIONS}, {_CITES}, {PAPERS}, {_REFS}, s AS (SELECT 'edge' AS kind, 'mentions' AS name, count(*)::DOUBLE AS n FROM mentions UNION ALL SELECT 'edge', 'cites', count(*) FROM cites UNION ALL SELECT 'edge', 'references', count(*) FROM refs UNION ALL SELECT 'edge', 'resolves_to', count(target) FROM refs
    UNION ALL SELECT 'node', 'concept', count(DISTINCT concept) FROM mentions UNION ALL SELECT 'node', 'paper', count(*) FROM papers UNION ALL SELECT 'node', 'page', count(*) FROM pages UNION ALL SELECT 'share', 'resolved', coalesce(count(target) / nullif(count(*), 0), 0) FROM refs) SELECT kind, name, round(n, 6) AS n FROM s""")
def g09(spark, d):
    """Counts of each kind of node and edge, and the share of references that lead to a paper."""
    refs = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("title"))
    resolved = graph.resolve(refs, "title", papers(spark, d).select("paper_id", "title")).agg(F.count("*").alias("references"), F.count("target_paper_id").alias("resolves_to"))
    known = mentions(spark, d).agg(F.count("*").alias("mentions"), F.count_distinct("concept").alias("concept"))
    rows = lambda df, **kinds: df.select(F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.col(name).cast("double").alias("n")) for name, kind in kinds.items()))).alias("x")).select("x.*")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = rows(known, mentions="edge", concept="node").unionByName(rows(one(cites(spark, d), "cites"), cites="edge"))
    out = out.unionByName(rows(one(table(spark, d, "documents"), "paper"), paper="node")).unionByName(rows(one(table(spark, d, "pages"), "page"), page="node"))
    share = F.coalesce(c("resolves_to") / F.nullif(c("references"), F.lit(0)), F.lit(0.0))
    return out.unionByName(rows(resolved.withColumn("resolved", share), references="edge", resolves_to="edge", resolved="share")).select("kind", "name", F.round("n", 6).alias("n"))


# ---- training sets

@query("t01_chat_pairs", "SELECT u.conv_id, u.turn, md5(u.text) AS query, md5(a.text) AS document FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND u.text <> '' AND a.text <> ''")
def t01(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, d, "conversations").withColumn("next", F.lead(F.struct("turn", "role", "text")).over(w))
    x = x.where((c("role") == "user") & (c("next.role") == "assistant") & (c("next.turn") == c("turn") + 1) & (c("text") != "") & (c("next.text") != ""))
    return x.select("conv_id", "turn", F.md5("text").alias("query"), F.md5("next.text").alias("document"))


@query("t01_selection_chats", f"""WITH {PAPERS}, x AS (SELECT p.doc_id, trim(title) AS title, {space_sql('abstract')} AS abstract, venue AS query, l.quality AS label FROM papers p JOIN labels l USING (doc_id)) SELECT doc_id, query, md5(title) AS title, md5('Title: ' || title || CASE WHEN abstract = '' THEN '' WHEN length(abstract) <= 300 THEN chr(10) || 'Abstract: ' || abstract ELSE chr(10) || 'Abstract: ' || rtrim(substr(abstract, 1, 297)) || '...' END) AS document, CAST(label AS INTEGER) AS label FROM x WHERE title <> '' AND label IS NOT NULL""")
def t01_chats(spark, d):
    """Saved selection chats, one of each paper, parsed back into query, document and label; undecided ones go."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    user = F.concat(F.lit("Judge this paper.\nTitle: "), "title", F.lit("\nAbstract: "), "abstract", F.lit("\n\nUser Query: "), "venue", F.lit("\n\nOutput format: True or False"))
    answer = F.when(c("quality") == 1, "Decision: True\nIt fits.").when(c("quality") == 0, " false, it does not").otherwise("It depends.")
    chats = papers(spark, d).join(labels, "doc_id", "left").select("doc_id", user.alias("user"), answer.alias("assistant"))
    return training.parsed_chats(chats, 300).select("doc_id", "query", F.md5("title").alias("title"), F.md5("document").alias("document"), "label")


def _hash_order(seed: str, *keys: str):
    return [F.sha1(F.concat(*(c(k).cast("string") for k in keys), F.lit(seed))), *keys]


@query("t04_train_eval_split", "SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY sha1(conv_id || '-42'), conv_id) <= 50 THEN 'eval' ELSE 'train' END AS split FROM (SELECT DISTINCT conv_id FROM conversations)")
def t04(spark, d):
    keys = table(spark, d, "conversations").select("conv_id").distinct()
    held = keys.orderBy(*_hash_order("-42", "conv_id")).limit(50).withColumn("held", F.lit(True))
    return keys.join(F.broadcast(held), "conv_id", "left").select("conv_id", F.when(c("held"), "eval").otherwise("train").alias("split"))


@query("t06_split_by_source", "SELECT source, doc_id, CASE WHEN source LIKE '%9' THEN 'test' WHEN i <= 0.85 * n THEN 'train' WHEN i <= 0.925 * n THEN 'dev' ELSE 'test' END AS split FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1(doc_id || '-1'), doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def t06(spark, d):
    x = table(spark, d, "documents").select("source", "doc_id")
    i, n = F.row_number().over(Window.partitionBy("source").orderBy(*_hash_order("-1", "doc_id"))), F.count("*").over(Window.partitionBy("source"))
    return x.select("source", "doc_id", F.when(c("source").like("%9"), "test").when(i <= 0.85 * n, "train").when(i <= 0.925 * n, "dev").otherwise("test").alias("split"))


@query("t07_trim_actions", "SELECT conv_id, turn, split_part(text, '.', 1) || CASE WHEN contains(text, '.') THEN '.' ELSE '' END AS action FROM conversations")
def t07(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract("text", r"(?s)^([^.]*\.?)", 1).alias("action"))


@query("t08_two_stage_predictions", "SELECT d.doc_id, coalesce(l.quality, 1) AS gate, CASE WHEN coalesce(l.quality, 1) = 1 THEN d.lang END AS intent FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def t08(spark, d):
    gate = F.coalesce("quality", F.lit(1))
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", gate.alias("gate"), F.when(gate == 1, c("lang")).alias("intent"))


@query("t09_relevant_pairs", "SELECT l_orderkey, l_linenumber, l_discount >= 0.05 AS relevant, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS rank FROM lineitem")
def t09(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_discount") >= 0.05).alias("relevant"), F.row_number().over(w).cast("long").alias("rank"))


@query("t10_document_text", f"WITH {PAPERS} SELECT paper_id, md5(CASE WHEN title = '' THEN abstract ELSE title || chr(10) || abstract END) AS text FROM papers")
def t10(spark, d):
    return papers(spark, d).select("paper_id", F.md5(F.concat_ws("\n", F.nullif("title", F.lit("")), "abstract")).alias("text"))


@query("t11_prompt_and_answer", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (turn < last)) AS prompt, md5(max(text) FILTER (turn = last)) AS answer FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, arg_max(role, turn) OVER (PARTITION BY conv_id) AS last_role FROM conversations) WHERE last_role = 'assistant' AND last > 0 GROUP BY conv_id")
def t11(spark, d):
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    x = x.withColumn("end", F.element_at("t", -1)).where((c("end.role") == "assistant") & (c("end.turn") > 0))
    return x.select("conv_id", F.md5(F.array_join(F.transform(F.slice("t", 1, F.size("t") - 1), lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")).alias("prompt"), F.md5("end.text").alias("answer"))


@query("t12_typed_pairs", "SELECT CAST(l_orderkey AS VARCHAR) AS query, CAST(l_partkey AS VARCHAR) AS document, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem WHERE l_linenumber = 1")
def t12(spark, d):
    return table(spark, d, "lineitem").where("l_linenumber = 1").select(c("l_orderkey").cast("string").alias("query"), c("l_partkey").cast("string").alias("document"), (c("l_returnflag") == "R").cast("int").alias("label"))


# ---- streams, run to the end of the table

@query("s2_event_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s2(spark, d):
    from litgrid.streaming import streams

    out = streams.run_once(spark, f"{d}/events.parquet", lambda df: streams.event_windows(df, "1 hour"), "append", flush=True)
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
