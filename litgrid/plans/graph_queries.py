"""Queries that build the concept, alias and citation graph from documents, and search it (G, R19 to R23, R27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.operators import dictionary, graph, rank, understand
from litgrid.sources.tables import held, small, stored

from .fixtures import CHUNKS, PAPERS, chunks, papers, table, title_sql, tokens_sql
from .registry import query
from .search_queries import _ALL, NAMES, ranked
from .table_queries import _CITES, _MENTIONS, _near, cites, mentions
from .understanding_queries import INTENTS, LEXICON, SEARCH_TERMS, intents

c = F.col
#: Headings put before the lines of a document, as its section titles, by place.
HEADINGS = ("Introduction", "Related work", "Our method", "Experiments", "Conclusion", "Notes")
#: Words that make a phrase a concept here.
HINTS = ("tion", "ment", "than", "der", "heti", "ndst", "eral", "elle", "ein")
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _role_sql(x: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{t}')" for t in terms) + f" THEN '{name}'" for name, terms in T.ROLES) + " ELSE 'other' END"


_weight_sql = lambda x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in T.ROLE_WEIGHTS.items()) + " END"
_hash_sql = lambda prefix, *xs: f"'{prefix}:' || substr(sha1({' || chr(31) || '.join(xs)}), 1, 20)"
_SECTIONS = f"""sec AS (SELECT paper_id, chunk_index, text, {_list(HEADINGS)}[chunk_index % {len(HEADINGS)} + 1] || ' ' || split_part(text, ' ', 1) AS title FROM chunks),
  ref AS (SELECT paper_id, chunk_index, i - 1 AS pos, {title_sql('part')} AS norm FROM (SELECT paper_id, chunk_index, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM (SELECT paper_id, chunk_index, string_split(text, '. ')[1:80] AS ps FROM sec))),
  tm AS (SELECT {title_sql('title')} AS norm, min(paper_id) AS target FROM papers GROUP BY 1), hit AS (SELECT ref.*, target FROM ref LEFT JOIN tm ON tm.norm = ref.norm AND ref.norm <> '' AND target <> paper_id)"""


def sections(spark, d):
    """paper_id, chunk_index, title, text: a section for each line of a document."""
    head = F.element_at(F.array(*map(F.lit, HEADINGS)), (c("chunk_index") % len(HEADINGS) + 1).cast("int"))
    return chunks(spark, d).select("paper_id", "chunk_index", "text", F.concat_ws(" ", head, F.split("text", " ")[0]).alias("title"))


def references(spark, d):
    """Sentences of sections as mentions (the first 80), with the other paper whose title they are, if there is one."""
    parts = sections(spark, d).select("paper_id", "chunk_index", F.posexplode(F.slice(F.split("text", r"\. "), 1, 80)).alias("at", "part")).withColumn("norm", T.normalize_title(c("part")))
    titles = papers(spark, d).groupBy(T.normalize_title(c("title")).alias("norm")).agg(F.min("paper_id").alias("target")).where("norm <> ''")
    found = parts.join(titles, "norm", "left")
    return found.select("paper_id", "chunk_index", "at", "norm", F.when(c("target") != c("paper_id"), c("target")).alias("target"))


@query("g03_sections", f"WITH {CHUNKS}, {PAPERS}, {_SECTIONS}, n AS (SELECT paper_id, chunk_index, count(*) AS n_references, count(target) AS resolved FROM hit GROUP BY ALL) SELECT {_hash_sql('section', 'paper_id', 'chunk_index')} AS section_id, paper_id, chunk_index, {_role_sql(title_sql('title'))} AS role, n_references, resolved FROM sec JOIN n USING (paper_id, chunk_index)")
def g03(spark, d):
    n = references(spark, d).groupBy("paper_id", "chunk_index").agg(F.count("*").alias("n_references"), F.count("target").alias("resolved"))
    return sections(spark, d).join(n, ["paper_id", "chunk_index"]).select(T.stable_hash("section", c("paper_id"), c("chunk_index")).alias("section_id"), "paper_id", "chunk_index", T.section_role(c("title")).alias("role"), "n_references", "resolved")


_EDGES = f"ed AS (SELECT {_hash_sql('mention', 'hit.paper_id', 'hit.chunk_index', 'pos')} AS mention_id, hit.paper_id AS source, target, {_role_sql(title_sql('title'))} AS role FROM hit JOIN sec USING (paper_id, chunk_index) WHERE target IS NOT NULL)"


def edges(spark, d):
    """Resolved mentions as CITES edges, once for each mention."""
    found = references(spark, d).where("target is not null").join(sections(spark, d).drop("text"), ["paper_id", "chunk_index"])
    rows = found.select(T.stable_hash("mention", c("paper_id"), c("chunk_index"), c("at")).alias("mention_id"), c("paper_id").alias("source"), "target", T.section_role(c("title")).alias("role"))
    return rows.dropDuplicates(["mention_id"]).withColumn("weight", F.round(T.role_weight(c("role")) * 0.95, 6))


@query("g05_citation_edges", f"WITH {CHUNKS}, {PAPERS}, {_SECTIONS}, {_EDGES} SELECT mention_id, source, target, role, round({_weight_sql('role')} * 0.95, 6) AS weight FROM ed")
def g05(spark, d):
    return edges(spark, d)


@query("g05_stub_papers", f"WITH {CHUNKS}, {PAPERS}, {_SECTIONS}, {_EDGES} SELECT DISTINCT target AS paper_id, true AS stub FROM ed ANTI JOIN (SELECT 'doc:' || doc_id AS target FROM documents WHERE lang = 'en') k USING (target)")
def g05_stubs(spark, d):
    # papers that are cited but are not among those loaded, here the English ones
    known = table(spark, d, "documents").where("lang = 'en'").select(F.concat(F.lit("doc:"), "doc_id").alias("target"))
    return edges(spark, d).select("target").distinct().join(known, "target", "left_anti").select(c("target").alias("paper_id"), F.lit(True).alias("stub"))


def _grams_sql(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"


_hint = lambda g: f"len(list_filter(string_split({g}, ' '), lambda t: t IN ({', '.join(repr(h) for h in HINTS)}))) > 0"


def _concepts_sql(source: str, key: str, limit: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, length(phrase) DESC, phrase) AS i FROM (SELECT {key}, phrase, count(*) AS n FROM (SELECT {key}, unnest({_grams_sql('w', 2)} || {_grams_sql('w', 3)}) AS phrase FROM {source}) WHERE {_hint('phrase')} GROUP BY ALL)) WHERE i <= {limit}"


def hints(spark):
    return spark.createDataFrame([(h,) for h in HINTS], "word string")


@query("g02_section_concepts", f"WITH {CHUNKS}, sw AS (SELECT chunk_id, {tokens_sql('text')} AS w FROM chunks) SELECT chunk_id, phrase, n, round(least(0.95, 0.85 * least(1.0, 0.55 + 0.08 * n)), 6)::DOUBLE AS confidence FROM ({_concepts_sql('sw', 'chunk_id', 5)})")
def g02(spark, d):
    found = graph.concepts(chunks(spark, d).select("chunk_id", T.tokens(c("text")).alias("w")), "chunk_id", c("w"), hints(spark), 5)
    return found.select("chunk_id", "phrase", "n", F.round(F.least(F.lit(0.95), 0.85 * c("confidence")), 6).alias("confidence"))


_type_sql = lambda x: "CASE " + " ".join("WHEN " + " OR ".join(f"contains({title_sql(x)}, '{t}')" for t in terms) + f" THEN '{name}'" for name, terms in T.CONCEPT_TYPES) + " ELSE 'other' END"
_ALIASES = f"""aw AS (SELECT paper_id, {tokens_sql("title || '. ' || abstract")} AS w, list_filter({tokens_sql("title || '. ' || substr(abstract, 1, 800)")}, lambda t: length(t) > 2) AS v FROM papers), co AS ({_concepts_sql('aw', 'paper_id', 12)}),
  al0 AS (SELECT paper_id, phrase, 0 AS size, i AS pos FROM co UNION ALL SELECT paper_id, g[i], n, i FROM (SELECT paper_id, n, g, unnest(range(1, len(g) + 1)) AS i FROM (
    {' UNION ALL '.join(f"SELECT paper_id, {n} AS n, {_grams_sql('v', n)} AS g FROM aw" for n in (5, 4, 3, 2))})) WHERE {_hint('g[i]')}),
  al1 AS (SELECT *, {title_sql('phrase')} AS norm FROM al0), al2 AS (SELECT *, row_number() OVER (PARTITION BY paper_id, norm ORDER BY size = 0 DESC, size DESC, pos) AS k FROM al1 WHERE norm <> ''),
  al AS (SELECT *, {_type_sql('norm')} AS alias_type, CASE WHEN size = 0 THEN 0.86::DOUBLE WHEN size <= 3 THEN 0.72 ELSE 0.78 END AS confidence, {_hash_sql('concept', _type_sql('norm'), 'norm')} AS concept_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY size = 0 DESC, size DESC, pos) AS place FROM al2 WHERE k = 1) WHERE place <= 16)"""


def aliases(spark, d, named=None):
    rows = papers(spark, d).select("paper_id", T.tokens(F.concat_ws(". ", "title", "abstract")).alias("w"), F.filter(T.tokens(F.concat(c("title"), F.lit(". "), F.substring("abstract", 1, 800))), lambda t: F.length(t) > 2).alias("v"))
    return graph.aliases(rows, "paper_id", c("w"), c("v"), hints(spark), named=named)


@query("g06_aliases", f"WITH {PAPERS}, {_ALIASES} SELECT paper_id, norm AS alias, alias_type, confidence, place FROM al")
def g06(spark, d):
    return aliases(spark, d).select("paper_id", "alias", "alias_type", "confidence", c("place").cast("long"))


@query("g07_alias_concepts", f"WITH {PAPERS}, {_ALIASES} SELECT al.paper_id, concept_id, norm AS name, alias_type AS concept_type, CASE WHEN size = 0 THEN 'alias_concept_phrase' ELSE 'alias_title_abstract_phrase' END AS evidence_field, md5(substr(title || '. ' || substr(abstract, 1, 220), 1, 320)) AS evidence, least(0.95, confidence) AS confidence FROM al JOIN papers USING (paper_id)")
def g07(spark, d):
    # each alias' concept, and the edge by which its paper mentions it
    text = papers(spark, d).select("paper_id", F.md5(F.substring(F.concat(c("title"), F.lit(". "), F.substring("abstract", 1, 220)), 1, 320)).alias("evidence"))
    x = aliases(spark, d).join(text, "paper_id")
    field = F.when(c("size") == 0, "alias_concept_phrase").otherwise("alias_title_abstract_phrase")
    return x.select("paper_id", T.stable_hash("concept", c("alias_type"), c("alias")).alias("concept_id"), c("alias").alias("name"), c("alias_type").alias("concept_type"), field.alias("evidence_field"), "evidence", F.least(F.lit(0.95), "confidence").alias("confidence"))


# ---- alias search: queries' terms, aliases of papers, and parts as typed relations

_TERMS2 = f"WITH {PAPERS}, {_ALIASES}, {INTENTS}, {SEARCH_TERMS}, qa AS (SELECT DISTINCT qid, unnest(alias_terms) AS term FROM terms2)"
#: Relations of a concept with their weights: fixed values. Here a paper's relation follows from how it got the alias.
RELATIONS = {"PROPOSES": 3.0, "USES_DATASET": 2.6, "EVALUATES_ON": 2.2, "ADDRESSES": 2.0, "MENTIONS": 1.3}
_REL = "CASE WHEN size = 5 THEN 'PROPOSES' WHEN size = 4 THEN 'USES_DATASET' WHEN size = 3 THEN 'EVALUATES_ON' WHEN size = 2 THEN 'ADDRESSES' ELSE 'MENTIONS' END"
_BRANCHES = f"""br AS (SELECT qid, paper_id, norm, CASE {_REL} {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in RELATIONS.items())} END * confidence AS score, {_REL} AS relation FROM al JOIN qa ON norm = term
  UNION ALL SELECT qid, b.paper_id, a.norm, 0.5::DOUBLE * b.confidence, 'alias_to_concept_mentions' FROM (SELECT DISTINCT qid, norm, concept_id, paper_id FROM al JOIN qa ON norm = term) a JOIN al b ON b.concept_id = a.concept_id AND b.paper_id <> a.paper_id
  UNION ALL SELECT qid, co.paper_id, phrase, 0.25::DOUBLE * least(1.0, 0.55 + 0.08 * n), 'concept' FROM co JOIN qa ON phrase = term)"""


_R19 = f"{_TERMS2}, {_BRANCHES} SELECT qid, paper_id, score, support, relations, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, paper_id) AS rank FROM (SELECT qid, paper_id, round(sum(score), 6) AS score, count(DISTINCT norm) AS support, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM br GROUP BY ALL)) WHERE rank <= 50"


@query("r19_alias_search", _R19)
def r19(spark, d):
    return alias_hits(spark, d).select("qid", "paper_id", F.round("score", 6).alias("score"), "support", F.array_join("relations", ",").alias("relations"), c("rank").cast("long"))


def _asked_terms(spark, d):
    return intents(spark, d).select("qid", F.explode(understand.search_terms(c("clean"), c("phrases"), LEXICON, alias=True)).alias("term")).distinct()


def alias_hits(spark, d):
    size = c("size")
    relation = F.when(size == 5, "PROPOSES").when(size == 4, "USES_DATASET").when(size == 3, "EVALUATES_ON").when(size == 2, "ADDRESSES").otherwise("MENTIONS")
    concepts = stored(graph.concepts(papers(spark, d).select("paper_id", T.tokens(F.concat_ws(". ", "title", "abstract")).alias("w")), "paper_id", c("w"), hints(spark)))
    known = stored(aliases(spark, d, concepts).select("paper_id", "alias", relation.alias("relation"), T.stable_hash("concept", c("alias_type"), c("alias")).alias("concept_id"), "confidence"))
    return graph.alias_search(_asked_terms(spark, d), known, concepts, RELATIONS, 50)


@query("r20_graph_expansion", f"WITH {_CITES}, {_MENTIONS}, seeds AS (SELECT DISTINCT s_suppkey % 30 AS qid, s_suppkey AS paper_id FROM supplier), shared AS (SELECT a.paper_id AS source, b.paper_id AS target, a.concept FROM mentions a JOIN mentions b ON a.concept = b.concept AND a.paper_id <> b.paper_id WHERE a.confidence >= 0.97 AND b.confidence >= 0.97), u AS ({_near('SELECT source, target FROM cites', 12, 1.0, 'cites')} UNION ALL {_near('SELECT target AS source, source AS target FROM cites', 12, 1.1, 'cited_by')} UNION ALL {_near('SELECT source, target FROM shared', 12, 0.8, 'shared_concept')}), t AS (SELECT qid, paper_id, round(sum(score), 6)::DOUBLE AS score, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM u GROUP BY ALL) SELECT qid, paper_id, score, relations FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, paper_id DESC) AS i FROM t) WHERE i <= 15")
def r20(spark, d):
    seeds = table(spark, d, "supplier").select((c("s_suppkey") % 30).alias("qid"), c("s_suppkey").alias("paper_id")).distinct()
    e = cites(spark, d)
    sure = mentions(spark, d).where("confidence >= 0.97").select("paper_id", "concept")
    # the seeds' concepts lead to the papers that share them; pairs of all papers are never made
    shared = graph.sharing(seeds, sure)
    found = graph.expand(seeds, [("cites", e, 1.0), ("cited_by", e.select(c("target").alias("source"), c("source").alias("target")), 1.1), ("shared_concept", shared, 0.8)], 12, 15)
    return found.select("qid", "paper_id", F.round("score", 6).alias("score"), "relations")


@query("r22_matched_aliases", f"{_TERMS2}, m AS (SELECT DISTINCT qid, term FROM qa JOIN (SELECT DISTINCT norm FROM al) ON contains(norm, replace(term, '-', ' '))) SELECT qid, term FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY term) AS i FROM m) WHERE i <= 12")
def r22(spark, d):
    """Terms that are an alias or stand inside one: one automaton of all terms goes over the aliases."""
    names = aliases(spark, d).select("alias").distinct()
    terms = _asked_terms(spark, d).withColumn("norm", F.replace("term", F.lit("-"), F.lit(" ")))
    inside = dictionary.occurrences(names, "alias", "alias", terms, "norm", whole_words=False).select(c("phrase").alias("norm")).distinct()
    return rank.top_k(terms.join(small(inside), "norm").select("qid", "term").distinct(), ["qid"], [F.asc("term")], 12).select("qid", "term")


#: Tag and score factor of each retriever's candidates: fixed values of this projection.
_PROJECT = {n: (f"{n}_hit", 1.0 if n in ("title_bm25", "chunk_bm25", "tfidf") else 0.9) for n in NAMES}


@query("r23_candidate_projection", _ALL + " " + " UNION ALL ".join(f"SELECT qid, 'part:' || paper_id AS paper_id, '{tag}' AS tag, round({'ln(1 + greatest(0, score))' if n == 'sparse' else f'{w} / rank' if n == 'api' else f'score * {w}'}, 6)::DOUBLE AS score, {'p_type' if n == 'chunk_bm25' else 'NULL'} AS section, {'p_name' if n in ('chunk_bm25', 'api') else 'NULL'} AS snippet FROM ranked JOIN part ON p_partkey = paper_id WHERE source = '{n}' AND rank <= 40" for n, (tag, w) in _PROJECT.items()))
def r23(spark, d):
    """One projection for each retriever, then their union: scores compressed for sparse hits and by rank for the API."""
    x = ranked(spark, d).where("rank <= 40").join(table(spark, d, "part").select(c("p_partkey").alias("paper_id"), "p_name", "p_type"), "paper_id")
    out = None
    for n, (tag, w) in _PROJECT.items():
        score = F.log1p(F.greatest(F.lit(0.0), "score")) if n == "sparse" else w / c("rank") if n == "api" else c("score") * w
        one = x.where(c("source") == n).select("qid", F.concat(F.lit("part:"), "paper_id").alias("paper_id"), F.lit(tag).alias("tag"), F.round(score, 6).alias("score"), *([c("p_type").alias("section")] if n == "chunk_bm25" else []), *([c("p_name").alias("snippet")] if n in ("chunk_bm25", "api") else []))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.select("qid", "paper_id", "tag", "score", c("section").cast("string"), c("snippet").cast("string"))


@query("r27_enriched_hits", f"{_TERMS2}, {_BRANCHES}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, paper_id) AS rank FROM (SELECT qid, paper_id, round(sum(score), 6) AS score, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations, string_agg(DISTINCT norm, '|' ORDER BY norm) AS evidence FROM br GROUP BY ALL)) WHERE rank <= 50) SELECT qid, paper_id, rank, relations, evidence, year, venue FROM h JOIN papers USING (paper_id) WHERE year > 2010")
def r27(spark, d):
    """Alias hits with their evidence and their papers' attributes; hits without a paper row are dropped."""
    known = papers(spark, d).where("year > 2010").select("paper_id", "year", "venue")
    return alias_hits(spark, d).join(known, "paper_id").select("qid", "paper_id", c("rank").cast("long"), F.array_join("relations", ",").alias("relations"), F.array_join("terms", "|").alias("evidence"), "year", "venue")
