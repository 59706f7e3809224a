"""Queries of conversion, chunking, sinks, archives, payloads, index rows, rebuilds and upserts (I, S1), with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.operators import index
from litgrid.sources import archives
from litgrid.sources import tables as S
from litgrid.sources.points import PointTable
from litgrid.streaming import streams

from .fixtures import CHUNKS, PAPERS, chunks, cited_papers, papers, space_sql, table, title_sql, tokens_sql
from .graph_queries import _ALIASES, _EDGES, _SECTIONS, aliases, edges, references, sections
from .registry import query

c = F.col
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def scratch(spark, name: str) -> str:
    return S.fresh_path(spark, name)


@query("i02_jsonl_sink", "SELECT event_id, event_type, round(value, 6) AS value, 'event_id,event_type,value' AS keys FROM events")
def i02(spark, d):
    """Written with sorted keys, and read back with the order in which the keys stand in each line."""
    path = scratch(spark, "jsonl-sink")
    S.write_jsonl(table(spark, d, "events").select("value", "event_type", "event_id"), path, sorted_keys=True)
    lines = spark.read.text(path)
    keys = F.array_join(F.regexp_extract_all("value", F.lit('"([a-z_]+)":'), F.lit(1)), ",")
    row = F.from_json("value", "event_id long, event_type string, value double").alias("r")
    return lines.select(row, keys.alias("keys")).select("r.event_id", "r.event_type", F.round("r.value", 6).alias("value"), "keys")


@query("i21_metric_sink", "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS chars FROM documents GROUP BY source")
def i21(spark, d):
    path = scratch(spark, "metrics")
    S.write_jsonl(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("chars")), path, sorted_keys=True)
    return S.read_jsonl(spark, path, "source string, n long, chars double")


_RAW = f"raw AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS place, CASE WHEN conv_id % 3 = 0 THEN 'c' || conv_id || 't' || turn END AS qid, {space_sql('text')} AS question, string_split({space_sql('text')}, '. ') AS parts, conv_id % 2 AS many FROM conversations WHERE role = 'assistant')"
_CONV = f"{_RAW}, cv AS (SELECT coalesce(qid, 'talk_dev_' || place) AS qid, question, list_filter(CASE WHEN many = 1 THEN parts ELSE [parts[1]] END, lambda a: coalesce(trim(a), '') <> '') AS al FROM raw WHERE place <= 200)"


def _converted(spark, d):
    from pyspark.sql import Window

    # the first rows in order, which Spark finds in each task, are numbered; all others are never brought together
    rows = table(spark, d, "conversations").where("role = 'assistant'").orderBy("conv_id", "turn").limit(200).withColumn("question", T.normalize_space(c("text"))).withColumn("parts", F.split("question", r"\. "))
    rows = rows.select(F.row_number().over(Window.orderBy("conv_id", "turn")).alias("place"), F.when(c("conv_id") % 3 == 0, F.concat(F.lit("c"), "conv_id", F.lit("t"), "turn")).alias("qid"), "question", c("parts")[0].alias("answer"), F.when(c("conv_id") % 2 == 1, c("parts")).alias("answers"))
    return S.conversion(rows, "talk", "dev", 200)


@query("i07_query_conversion", f"WITH {_CONV} SELECT qid, i - 1 AS label_rank, al[i] AS answer FROM (SELECT *, unnest(range(1, len(al) + 1)) AS i FROM cv)")
def i07(spark, d):
    return _converted(spark, d)[1].withColumn("label_rank", c("label_rank").cast("long"))


@query("i07_query_rows", f"WITH {_CONV} SELECT 'talk' AS dataset_name, 'dev' AS split_name, qid, md5(question) AS query, len(al) AS answer_count, array_to_string(al, '|') AS gold FROM cv")
def i07_rows(spark, d):
    queries, _, sets = _converted(spark, d)
    gold = sets.select("qid", F.array_join("gold_paper_ids", "|").alias("gold"))
    return queries.join(gold, "qid").select("dataset_name", "split_name", "qid", F.md5("query_text").alias("query"), c("answer_count").cast("long"), "gold")


_PARTS = f"WITH {CHUNKS}, {PAPERS}, {_SECTIONS}, pr AS (SELECT paper_id, chunk_index, title, list_filter(string_split(text, '. '), lambda x: x <> '') AS refs FROM sec), k AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index) AS i FROM pr WHERE len(refs) > 0)"


@query("i09_chunking", f"{_PARTS} SELECT paper_id || '#chunk:0' AS chunk_id, 0 AS chunk_index, 'title_abstract' AS chunk_type, md5(title || chr(10) || abstract) AS text FROM papers UNION ALL SELECT paper_id || '#chunk:' || i, i, 'section', md5(title || ': ' || array_to_string(refs[1:80], '; ')) FROM k")
def i09(spark, d):
    parts = sections(spark, d).select("paper_id", c("chunk_index").alias("place"), "title", F.filter(F.split("text", r"\. "), lambda x: x != "").alias("references"))
    return S.chunked(papers(spark, d), parts).withColumn("text", F.md5("text"))


@query("i10_archive_scan", "SELECT doc_id, lang, md5(text) AS text FROM documents")
def i10(spark, d):
    """Documents as JSON members of zip files in a folder, scanned in ranges of members and parsed."""
    path = scratch(spark, "archives")
    rows = table(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "text")).alias("json"))
    archives.write_archives(rows, "doc_id", "json", path, 500).count()
    row = F.from_json("content", "doc_id long, lang string, text string").alias("r")
    found = archives.members(spark, path, 1 << 20).where(c("member").endswith(".json") & c("error").isNull())
    return found.select(row).select("r.doc_id", "r.lang", F.md5("r.text").alias("text"))


@query("i13_bulk_load", f"WITH {CHUNKS}, l AS (SELECT paper_id AS id, arg_max(text, chunk_index) AS body FROM chunks GROUP BY 1) SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({tokens_sql('body')}) AS token FROM l) GROUP BY ALL")
def i13(spark, d):
    """Postings of rows loaded by id: a paper's chunks come as its rows, and the last replaces the earlier ones before it is indexed."""
    last = S.latest(chunks(spark, d), ["paper_id"], [F.desc("chunk_index")])
    return index.postings(last, "paper_id", c("text")).select(c("doc_id").alias("id"), "token", "tf")


_GRAPH = f"WITH {CHUNKS}, {PAPERS}, {_SECTIONS}, {_EDGES}, {_ALIASES}"
_ROWS = {
    "CONTAINS": "SELECT count(*) FROM papers", "HAS_SECTION": "SELECT count(*) FROM sec", "MENTIONS_REFERENCE": "SELECT count(*) FROM ref", "RESOLVES_TO": "SELECT count(*) FROM hit WHERE target IS NOT NULL", "CITES": "SELECT count(*) FROM (SELECT DISTINCT source, target FROM ed)",
    "MENTIONS_CONCEPT": "SELECT count(*) FROM co", "ALIAS_OF": "SELECT count(*) FROM al", "HAS_CHUNK": "SELECT count(*) FROM chunks",
}


def _graph_tables(spark, d):
    """One table for each edge type, all from the papers; each is independent of the others."""
    from litgrid.operators import graph

    from .graph_queries import hints

    refs = references(spark, d)
    concepts = graph.concepts(papers(spark, d).select("paper_id", T.tokens(F.concat_ws(". ", "title", "abstract")).alias("w")), "paper_id", c("w"), hints(spark))
    return {
        "CONTAINS": papers(spark, d).select("paper_id"), "HAS_SECTION": sections(spark, d), "MENTIONS_REFERENCE": refs, "RESOLVES_TO": refs.where("target is not null"), "CITES": edges(spark, d).select("source", "target").distinct(),
        "MENTIONS_CONCEPT": concepts, "ALIAS_OF": aliases(spark, d), "HAS_CHUNK": chunks(spark, d),
    }


@query("i15_graph_tables", f"{_GRAPH} " + " UNION ALL ".join(f"SELECT '{k}' AS edge, ({q}) AS n" for k, q in _ROWS.items()))
def i15(spark, d):
    """All edge tables are written, and counted as read back."""
    path = scratch(spark, "graph")
    for name, df in _graph_tables(spark, d).items():
        df.write.parquet(f"{path}/{name}")
    return S.counts({name: spark.read.parquet(f"{path}/{name}") for name in _ROWS}).withColumnRenamed("store", "edge")


@query("i16_alias_rebuild", f"{_GRAPH} SELECT paper_id, norm AS alias, concept_id FROM al")
def i16(spark, d):
    """The alias table alone, built anew in place of an older one."""
    rows = aliases(spark, d).select("paper_id", "alias", T.stable_hash("concept", c("alias_type"), c("alias")).alias("concept_id"))
    path = scratch(spark, "aliases")
    rows.limit(1).write.parquet(path)
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("i16_chunk_rebuild", f"WITH {CHUNKS} SELECT chunk_id, paper_id, chunk_index FROM chunks")
def i16_chunks(spark, d):
    path = scratch(spark, "chunks")
    chunks(spark, d).select("chunk_id", "paper_id", "chunk_index").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("i18_scoped_delete", "SELECT source, count(*) AS kept FROM documents WHERE lang <> 'de' GROUP BY source UNION ALL SELECT 'before', count(*) FROM documents UNION ALL SELECT 'deleted', count(*) FILTER (lang = 'de') FROM documents UNION ALL SELECT 'after', count(*) FILTER (lang <> 'de') FROM documents")
def i18(spark, d):
    """All rows of one graph, here a language, are deleted: the table is written without them, with counts before and after."""
    kept, counts = S.scoped_delete(table(spark, d, "documents"), c("lang") == "de")
    path = scratch(spark, "deleted")
    kept.write.parquet(path)
    after = spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("kept"))
    told = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("source"), c(n).alias("kept")) for n in ("before", "deleted", "after")))).alias("x")).select("x.*")
    return after.unionByName(told)


PAYLOAD = "paperId string, corpusId long, title string, abstract string, year string, citationCount string, externalIds map<string,string>, authors array<struct<name:string>>, fieldsOfStudy array<string>, s2FieldsOfStudy array<struct<category:string>>"


@query("i22_payload_flattening", f"""WITH {PAPERS} SELECT CASE WHEN doc_id % 3 = 0 THEN 's2-corpus:' || doc_id ELSE 's2:' || lower('AB' || doc_id) END AS paper_id, md5(title) AS title, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE year END AS year, citation_count, CASE WHEN doc_id % 5 = 0 THEN 'doi:10.1/' || doc_id ELSE '' END AS aliases, CASE WHEN doc_id % 2 = 0 THEN venue || ', b' ELSE venue END AS authors,
    CASE WHEN doc_id % 2 = 0 THEN 'Art|Law' ELSE 'Law' END AS fields FROM papers""")
def i22(spark, d):
    """Saved answers of a literature API (JSON, rows in `data`) as typed rows."""
    p, k = cited_papers(spark, d), c("doc_id")
    names = F.when(k % 2 == 0, F.array(F.struct(c("venue").alias("name")), F.struct(F.lit("b").alias("name")))).otherwise(F.array(F.struct(c("venue").alias("name"))))
    row = F.struct(
        F.when(k % 3 != 0, F.concat(F.lit("AB"), "doc_id")).alias("paperId"), k.alias("corpusId"), "title", F.when(k % 4 == 0, "unknown").otherwise(c("year").cast("string")).alias("year"), c("citation_count").cast("string").alias("citationCount"),
        F.when(k % 5 == 0, F.create_map(F.lit("DOI"), F.concat(F.lit("10.1/"), "doc_id"))).alias("externalIds"), names.alias("authors"), F.when(k % 2 == 0, F.array(F.lit("Art"))).alias("fieldsOfStudy"), F.array(F.struct(F.lit("Law").alias("category"))).alias("s2FieldsOfStudy"),
    )
    saved = p.groupBy((k % 40).alias("page")).agg(F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("payload"))
    rows = saved.select(F.explode(F.from_json("payload", f"data array<struct<{', '.join(x.replace(' ', ':', 1) for x in PAYLOAD.split(', '))}>>")["data"]).alias("r")).select("r.*")
    named = F.when(c("paperId").isNotNull(), F.concat(F.lit("s2:"), F.lower("paperId"))).otherwise(F.concat(F.lit("s2-corpus:"), "corpusId"))
    fields = F.array_sort(F.array_distinct(F.concat(F.coalesce("fieldsOfStudy", F.array().cast("array<string>")), F.transform("s2FieldsOfStudy", lambda x: x["category"]))))
    aliases_ = F.coalesce(T.external_aliases(c("externalIds")), F.array().cast("array<string>"))
    return rows.select(named.alias("paper_id"), F.md5("title").alias("title"), T.safe_int(c("year")).alias("year"), T.safe_int(c("citationCount")).alias("citation_count"), F.array_join(aliases_, "|").alias("aliases"), F.array_join(F.transform("authors", lambda a: a["name"]), ", ").alias("authors"), F.array_join(fields, "|").alias("fields"))


_UUID = f"substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("i25_index_rows", f"WITH {CHUNKS}, u AS (SELECT *, sha1(unhex('{NAMESPACE.replace('-', '')}') || encode(chunk_id)) AS h FROM chunks) SELECT {_UUID} AS point_id, chunk_id, paper_id, chunk_type, greatest(1, length(text) // 4) AS token_estimate, md5(text) AS payload FROM u")
def i25(spark, d):
    """A point for each chunk: an id from its key, and its payload; its vector follows from i25_vectors by the same key."""
    x = chunks(spark, d)
    return x.select(S.uuid5(NAMESPACE, c("chunk_id")).alias("point_id"), "chunk_id", "paper_id", "chunk_type", T.token_estimate(c("text")).alias("token_estimate"), F.md5("text").alias("payload"))


@query("i25_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, len(embedding) AS dimensions, 'l' || label AS payload FROM embeddings")
def i25_vectors(spark, d):
    e = table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"), F.size("embedding").cast("long").alias("dimensions"), F.concat(F.lit("l"), "label").alias("payload"))


_POINTS = f"""SELECT {_UUID} AS point_id, paper_id, CASE WHEN lang = 'de' THEN upper(venue) ELSE venue END AS venue, year, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, len(embedding) AS dimensions FROM (SELECT p.*, d.lang, e.embedding, sha1(unhex('{NAMESPACE.replace('-', '')}') || encode(p.paper_id)) AS h FROM papers p JOIN documents d USING (doc_id) JOIN embeddings e ON e.vec_id = p.doc_id)"""


@query("i25_points", f"WITH {PAPERS} {_POINTS}")
def i25_points(spark, d):
    """Papers with their vectors and payload as rows of a bucketed table, of which one language's are indexed anew."""
    e = table(spark, d, "embeddings").select(c("vec_id").alias("doc_id"), c("embedding").alias("vector"))
    lang = table(spark, d, "documents").select("doc_id", "lang")
    rows = papers(spark, d).join(e, "doc_id").join(lang, "doc_id").select(S.uuid5(NAMESPACE, c("paper_id")).alias("point_id"), "vector", "paper_id", "venue", "year", "lang")
    points = PointTable(spark, scratch(spark, "points"), 32)
    points.write(rows)
    points.upsert(rows.where("lang = 'de'").withColumn("venue", F.upper("venue"))).collect()
    v = F.transform("vector", lambda x: x.cast("double"))
    return points.read().select("point_id", "paper_id", "venue", "year", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"), F.size("vector").cast("long").alias("dimensions"))


@query("i26_benchmark_files", "SELECT split, doc_id, md5(text) AS text FROM (SELECT lang AS split, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) WHERE i <= 7")
def i26(spark, d):
    """Query files by split, written as JSON in folders and read with the split from the folder's name, seven of each."""
    path = scratch(spark, "splits")
    table(spark, d, "documents").select("doc_id", "text", c("lang").alias("split")).write.partitionBy("split").json(path)
    rows = spark.read.schema("doc_id long, text string, split string").json(path)
    return S.first_n(rows, ["split"], [F.asc("doc_id")], 7).select("split", "doc_id", F.md5("text").alias("text"))


@query("i26_id_dictionary", f"WITH {PAPERS} SELECT paper_id AS id, min({title_sql('title')}) AS title FROM papers GROUP BY paper_id")
def i26_ids(spark, d):
    """A saved JSON dictionary from id to title, exploded."""
    pages = papers(spark, d).groupBy((c("doc_id") % 16).alias("page")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("paper_id", T.normalize_title(c("title")).alias("title"))))).alias("j"))
    return pages.select(F.explode(F.from_json("j", "map<string,string>")).alias("id", "title"))


#: The events as they come: by day, in five batches out of order, of which a batch's rows may be older than three days before.
_BATCH, _LATE = "(day(ts) * 7 + 3) % 31 // 7", 3
_CLOCK = f"ev AS (SELECT *, {_BATCH} AS b FROM events), ck AS (SELECT b, max(m) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM (SELECT b, max(ts) AS m FROM ev GROUP BY b)), k AS (SELECT ev.*, clock IS NOT NULL AND ts < clock - INTERVAL {_LATE} DAY AS late FROM ev JOIN ck USING (b))"


@query("s3_late_rows", f"WITH {_CLOCK} SELECT 'kept' AS part, user_id, event_type, max(event_id) AS event_id FROM k WHERE NOT late GROUP BY ALL UNION ALL SELECT 'late', user_id, event_type, event_id FROM k WHERE late")
def s3_late(spark, d):
    """Batches out of order: the last row of each user and type among those in time, with compaction meanwhile, and the rest."""
    at = scratch(spark, "late-rows")
    rows = table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp")).withColumn("b", F.floor((F.day("ts") * 7 + 3) % 31 / 7).cast("int"))
    keeper = streams.LastRows(spark, f"{at}/table", ["user_id", "event_type"], "event_id", "ts", f"{_LATE} days", compact=2)
    given = rows.drop("b").schema
    for b in range(5):  # the batches, as a source would leave them one after the other
        rows.where(c("b") == b).drop("b").write.mode("append").parquet(f"{at}/incoming")
        keeper.run(spark.readStream.schema(given).parquet(f"{at}/incoming"), f"{at}/state")
    kept = keeper.rows().select(F.lit("kept").alias("part"), "user_id", "event_type", "event_id")
    return kept.unionByName(keeper.late().select(F.lit("late").alias("part"), "user_id", "event_type", "event_id"))


@query("s1_stream_upserts", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(round(value, 6), event_id) AS value FROM events GROUP BY ALL")
def s1(spark, d):
    """The events as a stream, of which the last row of each user and type is kept by appended changes."""
    at = scratch(spark, "upserts")
    source = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]")
    streams.upserts(stream, f"{at}/log", ["user_id", "event_type"], "event_id", f"{at}/state").awaitTermination()
    found = streams.upserted(spark, f"{at}/log", ["user_id", "event_type"], "event_id")
    return found.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
