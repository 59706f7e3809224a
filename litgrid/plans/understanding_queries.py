"""Queries of intents, profiles, budgets, actions and search terms (Q01 to Q05, Q10, Q11, Q18 to Q30), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.operators import intent, understand
from litgrid.operators.dictionary import Dictionary
from litgrid.operators.understand import Lexicon
from litgrid.sources.tables import first_n, held

from .fixtures import space_sql, table, tokens_sql
from .registry import query

c = F.col

#: A small lexicon of our own that fits the invented prose of the fixtures.
LEXICON = Lexicon(
    synonyms={"in the": ("within the", "inside-of", "deep in the old text body"), "the with": ("together with", "with the given words"), "de la": ("of the house", "from-the", "out of the whole"), "better than larger": ("beats bigger ones",), "que": ("which",)},
    bridges={"it and": ("both of them",), "ment": ("ending", "suffix"), "in the": ("inner part",), "than": ("comparison word",), "en": ("inside",)},
    patterns=(r"\bth[a-z]+ (?:of|in)\b", r"\b[a-z]+tion [a-z]+ing\b"),
    fields={"ment": "suffix studies", "der": "german articles", "la": "romance articles", "than": "comparatives", "que": "relatives"},
    noise=("th", "nt", "thes", "paper"),
    relaxed=(("such as", ("tion", "elle")), ("versus", ("than", "la"))),
    extras=((("better", "improve"), ("higher quality", "side by side")), (("small", "short"), ("few words",))),
    anchors=("ment", "it and"),
    hints=("tion", "ment", "than", "der", "heti"),
    singles=("elle", "ein"),
    generic=("the", "of", "and", "which", "paper"),
    locators=(r"which paper", r"known as [a-z]+", r"since \d{4}"),
    phrase_hints=("in the", "de la", "to the"),
    constraint_markers=("versus", "analysis", "than", "which"),
)
TOPIC, REWRITE = r"\b(tion|ment|der|language)\b", ("known as", "versus", "first proposed")
#: What is put behind the items' texts, so that every rule is met: by id modulo the number of these.
TAILS = (
    " first versus", " better than larger, since 2015", " show that 2012 and 2019 in the dataset", " analysis before 1999, not about cats", "", ' which paper known as cot-prompting at ACL or sigir', " a survey such as tion elle; small method",
    ' email me a story about "the in the well-known long-term plan"', " research of the foundational origin, short",
)
TEXT = "text || [" + ", ".join("'" + t.replace("'", "''") + "'" for t in TAILS) + f"][item_id % {len(TAILS)} + 1]"


def asked(spark, d):
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (c("item_id") % len(TAILS) + 1).cast("int"))
    return table(spark, d, "benchmark").select(c("item_id").alias("qid"), F.concat("text", tail).alias("query_text"))


# ---- the same rules in SQL

_q = lambda x: "'" + x.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_q, xs)) + "]::VARCHAR[]"
_in = lambda xs: "(" + ", ".join(map(_q, xs)) + ")" if xs else "('')"
_has = lambda text, xs: "(" + " OR ".join(f"contains({text}, {_q(x)})" for x in xs) + ")"


def _map(items: str, table_: dict, most: int | None = None) -> str:
    cases = " ".join(f"WHEN {_q(k)} THEN {_list(v[:most])}" for k, v in table_.items())
    return f"flatten(list_transform({items}, lambda x: CASE x {cases} ELSE []::VARCHAR[] END))"


def _uniq(x: str) -> str:
    return f"list_filter({x}, lambda v, i: v <> '' AND list_position(list_transform({x}, lambda w: lower(w)), lower(v)) = i)"


def _first_of(text: str, rules, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(text, terms)} THEN {_q(name)}" for name, terms in rules) + f" ELSE {_q(other)} END"


_near = lambda ps: f"list_filter({_list(ps)}, lambda p: regexp_matches(low, '(^|[^a-z0-9])' || p || '($|[^a-z0-9])'))"
_j = lambda x: f"array_to_string({x}, ' ')"
_some = lambda test, x: f"CASE WHEN {test} THEN {x} END"


def intents_sql(source: str, L: Lexicon) -> str:
    """CTEs up to `intents`, from a CTE body that gives qid and clean."""
    _known = [*L.synonyms, *(k for k in L.bridges if k not in L.synonyms)]
    _cue = "list_filter([" + ", ".join("CASE WHEN " + " AND ".join(_has("low", g) for g in groups) + f" THEN {_q(name)} END" for name, groups in intent.CUES) + "], lambda v: v IS NOT NULL)[1:4]"
    _useful = lambda t: f"({t} NOT IN {_in(T.STOP_WORDS)} AND lower({t}) NOT IN {_in(L.noise)} AND {t} <> 'empirical finding' AND NOT (length({t}) <= 2 AND NOT regexp_matches({t}, '[0-9]')))"
    _fields = {p: (*((p,) if p in L.synonyms else ()), *L.bridges.get(p, ())) for p in {**L.synonyms, **L.bridges}}
    _extras = " || ".join(f"CASE WHEN {_has('low', m)} THEN {_list(v)} ELSE []::VARCHAR[] END" for m, v in L.extras)
    _relaxed = " || ".join(f"CASE WHEN contains(low, {_q(m)}) THEN {_list(v)} ELSE []::VARCHAR[] END" for m, v in L.relaxed)
    _syn, _bri = L.synonyms, L.bridges
    return f"""a0 AS ({source}), a1 AS (SELECT *, lower(clean) AS low, {tokens_sql('clean')} AS ts FROM a0),
  a2 AS (SELECT *, list_transform(list_sort(list_transform(list_filter(ts, lambda v, i: list_position(ts, v) = i), lambda t, i: {{'n': -len(list_filter(ts, lambda x: x = t)), 'i': i, 't': t}}))[1:16], lambda s: s.t) AS top FROM a1),
  a3 AS (SELECT *, CASE WHEN len(list_filter(top, lambda t: t NOT IN {_in(L.noise)})) > 0 THEN list_filter(top, lambda t: t NOT IN {_in(L.noise)}) ELSE top END AS key, {_near(_known)} || {' || '.join(f"regexp_extract_all(low, {_q(p)})" for p in L.patterns)} || regexp_extract_all(low, '\\b(?:known as|called|method known as)\\s+([a-z][a-z0-9-]{{1,30}})\\b', 1) AS ph0, {_cue} AS cues FROM a2),
  a4 AS (SELECT *, {_uniq('ph0')} AS ph FROM a3), a5 AS (SELECT *, {_map('ph', _fields)} || {_map('ts', {k: (v,) for k, v in L.fields.items()})} AS fi0, {_relaxed} AS rel, flatten(list_transform(ph, lambda p: {tokens_sql('p')})) AS inside FROM a4),
  a6 AS (SELECT *, CASE WHEN len({_uniq('fi0')}) > 0 THEN {_uniq('fi0')}[1:5] ELSE [{_q(understand.GENERAL_FIELD)}] END AS fields, list_filter(ph, lambda p: {_useful('p')} AND NOT list_contains(rel, lower(p))) || list_filter(key, lambda t: {_useful('t')} AND NOT list_contains(inside, t) AND NOT list_contains(rel, lower(t))) || list_filter(cues, lambda x: {_useful('x')}) AS mu0,
    cues || {_map('ph', _syn)} || {_extras} || {_map('ph', _bri)} || {_map('key', _bri)} AS so0 FROM a5),
  a7 AS (SELECT *, list_filter(mu0, lambda v, i: list_position(mu0, v) = i)[1:8] AS must, so0 || list_filter(key, lambda t: NOT list_contains(so0, t))[1:greatest(0, 14 - len(so0))] AS so1 FROM a6), a8 AS (SELECT *, {_uniq('so1')}[1:14] AS soft FROM a7),
  a9 AS (SELECT *, {_map(f"list_filter(ph || key, lambda x: x IN {_in(L.anchors)})", _bri)} || {_map('ph[1:4] || key[1:6] || soft[1:6]', _bri)} || list_filter(ph[1:2], lambda p: p IN {_in(tuple(_bri))}) AS br0, {_map('ph[1:5]', _syn, 6)} AS rich, list_filter({_map('ph', _syn)}, lambda x: len({tokens_sql('x')}) >= 4 OR contains(x, '-'))[1:4] AS al FROM a8),
  b0 AS (SELECT *, ph[1:3] || rich AS ri0, ph[1:2] || soft[1:4] || key[1:3] AS ps0 FROM a9),
  b1 AS (SELECT *, list_filter(al || [{_j(_uniq('br0') + '[1:8]')}, {_some('len(ph) > 0', _j('ph[1:5] || key[1:5]'))}, {_j('key[1:8]')}, {_j('key[1:12]')}, {_j(f"(ph || {_map('ph', _syn, 2)})[1:8]")}, {_some('len(ph) > 0 AND len(rich) > 0', _j(_uniq('ri0') + '[1:12]'))}] || list_transform(ph[1:2], lambda p: {_j(f"[p] || {_map('[p]', _syn, 3)} || key[1:3]")})
    || [{_some('len(ph) > 0 AND len(cues) > 0', _j('cues[1:2] || ph[1:3] || key[1:3]'))}, {_some('len(soft) > 0', _j('(key[1:5] || soft[1:5])[1:10]'))}, {_some('len(ph) > 0 AND len(soft) > 0', _j(_uniq('ps0') + '[1:10]'))}], lambda v: v IS NOT NULL) AS sq0 FROM b0),
  b2 AS (SELECT *, CASE WHEN len({_uniq('sq0')}) > 0 THEN {_uniq('sq0')}[1:8] ELSE [clean] END AS subs, CASE WHEN len(must) > 0 THEN 'find scholarly papers about ' || array_to_string(must[1:4], ', ') ELSE 'find scholarly papers relevant to: ' || clean END AS main FROM b1),
  b3 AS (SELECT *, lower({_j('[main] || fields || must || soft || subs[1:2]')}) AS it2, lower({_j('[main] || fields || must || soft || subs[1:3]')}) AS it3 FROM b2), intents AS (SELECT *, {_first_of('it2', understand.PROFILES, 'real_multi_answer')} AS profile FROM b3)"""


INTENTS = intents_sql(f"SELECT item_id AS qid, {space_sql(TEXT)} AS clean FROM benchmark", LEXICON)
_bar = lambda x: f"array_to_string({x}, '|')"


def intents(spark, d):
    return understand.intents(asked(spark, d), LEXICON)


def _text(name: str) -> object:
    return F.array_join(name, "|").alias(name)


@query("q01_intents", f"WITH {INTENTS} SELECT qid, {_j('ts')} AS query_tokens, {_bar('key')} AS key_terms, {_bar('ph')} AS phrases, {_bar('cues')} AS cues, {_bar('fields')} AS fields, {_bar('must')} AS must_have, {_bar('soft')} AS soft, {_bar('subs')} AS sub_queries, main AS main_intent, profile FROM intents")
def q01(spark, d):
    return intents(spark, d).select("qid", F.array_join("query_tokens", " ").alias("query_tokens"), *map(_text, ("key_terms", "phrases", "cues", "fields", "must_have", "soft", "sub_queries")), "main_intent", "profile")


@query("q02_phrase_spotting", f"WITH {INTENTS} SELECT qid, {_bar('ph')} AS phrases FROM intents")
def q02(spark, d):
    return asked(spark, d).select("qid", F.array_join(understand.important_phrases(T.normalize_space(c("query_text")), LEXICON, Dictionary(spark, understand.known_phrases(LEXICON))), "|").alias("phrases"))


@query("q03_research_fields", f"WITH {INTENTS} SELECT qid, {_bar('fields')} AS fields FROM intents")
def q03(spark, d):
    return intents(spark, d).select("qid", _text("fields"))


@query("q04_must_have", f"WITH {INTENTS} SELECT qid, i - 1 AS place, must[i] AS must_have FROM (SELECT *, unnest(range(1, len(must) + 1)) AS i FROM intents)")
def q04(spark, d):
    return intents(spark, d).select("qid", F.posexplode("must_have").alias("place", "must_have")).withColumn("place", c("place").cast("long"))


@query("q05_soft_constraints", f"WITH {INTENTS} SELECT qid, i - 1 AS place, soft[i] AS soft FROM (SELECT *, unnest(range(1, len(soft) + 1)) AS i FROM intents)")
def q05(spark, d):
    return intents(spark, d).select("qid", F.posexplode("soft").alias("place", "soft")).withColumn("place", c("place").cast("long"))


@query("q06_relation_cues", f"WITH {INTENTS} SELECT qid, {_bar('cues')} AS cues FROM intents")
def q06(spark, d):
    return asked(spark, d).select("qid", F.array_join(intent.relation_cues(c("query_text")), "|").alias("cues"))


@query("q07_excluded_meanings", f"WITH {INTENTS} SELECT qid, array_to_string(list_transform(regexp_extract_all(low, '(?:not about|excluding|exclude|except) ([a-z0-9 -]+)', 1), lambda x: trim(x)), '|') AS excluded FROM intents")
def q07(spark, d):
    return asked(spark, d).select("qid", F.array_join(intent.excluded(c("query_text")), "|").alias("excluded"))


@query("q08_time_range", f"""WITH {INTENTS}, y AS (SELECT qid, low, list_transform(regexp_extract_all(low, '\\b((?:19|20)[0-9]{{2}})\\b', 1), lambda x: CAST(x AS INTEGER)) AS ys, {_has('low', ('after', 'since'))} AS aft, {_has('low', ('before', 'until'))} AS bef FROM intents)
    SELECT qid, CASE WHEN len(ys) > 0 AND NOT (bef AND NOT aft) THEN list_min(ys) END AS first_year, CASE WHEN len(ys) > 0 AND NOT aft THEN list_max(ys) END AS last_year FROM y""")
def q08(spark, d):
    x = asked(spark, d).select("qid", intent.time_range(c("query_text")).alias("r"))
    return x.select("qid", c("r.start").alias("first_year"), c("r.end").alias("last_year"))


@query("q09_venues", f"WITH {INTENTS} SELECT qid, array_to_string(list_filter({_list(tuple(v.upper() for v in intent.VENUES))}, lambda v: contains(' ' || regexp_replace(low, '[^a-z]+', ' ', 'g') || ' ', ' ' || lower(v) || ' ')), '|') AS venues FROM intents")
def q09(spark, d):
    return asked(spark, d).select("qid", F.array_join(intent.venues(c("query_text"), whole_words=True), "|").alias("venues"))


@query("q10_sub_queries", f"WITH {INTENTS} SELECT qid, i - 1 AS index, subs[i] AS sub_query FROM (SELECT *, unnest(range(1, len(subs) + 1)) AS i FROM intents)")
def q10(spark, d):
    return intents(spark, d).select("qid", F.posexplode("sub_queries").alias("index", "sub_query")).withColumn("index", c("index").cast("long"))


@query("q11_main_intent", f"WITH {INTENTS} SELECT qid, main AS main_intent FROM intents")
def q11(spark, d):
    return intents(spark, d).select("qid", "main_intent")


@query("q20_query_profile", f"WITH {INTENTS} SELECT qid, profile FROM intents")
def q20(spark, d):
    return intents(spark, d).select("qid", "profile")


_BUDGETS = "bud AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in understand.budget_rows()) + f") v(profile, {', '.join(understand.BUDGET)}))"


@query("q21_profile_budget", f"WITH {INTENTS}, {_BUDGETS} SELECT qid, bud.* FROM intents JOIN bud USING (profile)")
def q21(spark, d):
    return intents(spark, d).select("qid", "profile").join(F.broadcast(understand.budgets(spark)), "profile").select("qid", "profile", *understand.BUDGET)


_CONCEPT0 = "must[1:6] || fields || soft[1:10] || flatten(list_transform(subs[1:2], lambda q: string_split(q, ' ')[1:12]))"
_graph = lambda x, n: f"array_to_string(list_filter({_uniq(x)}, lambda t: length(t) >= 4 AND lower(t) NOT IN {_in(understand.EMPTY_TERMS)})[1:{n}], ' | ')"
_GRAPH = f"gq0 AS (SELECT *, {_CONCEPT0} AS g1, must || soft[1:10] || subs[1:3] AS g2 FROM intents), gq AS (SELECT *, {_graph('g1', 20)} AS concept_query, {_graph('g2', 18)} AS alias_query FROM gq0)"
_TOPK = "CASE WHEN index <= 3 THEN lexical_top_k ELSE greatest(30, floor(lexical_top_k * 0.8)) END"
_LOC, _MANY, _DATA = "profile IN ('auto_locator', 'foundational_or_origin', 'method_or_dataset')", "profile IN ('real_multi_answer', 'survey_or_list')", "profile = 'dataset_or_benchmark'"
_pl = lambda t, v: f"CASE WHEN {t} THEN {v} ELSE 0 END"
_DENSE = f"(1.04::DOUBLE + {_pl(_LOC, 0.16)} + {_pl(_DATA, 0.12)})"
_W = {
    "title_bm25": f"CASE WHEN index = 0 THEN 1.25::DOUBLE ELSE 1.12 END + {_pl(_LOC, 0.08)} + {_pl(_DATA, 0.05)}", "chunk_bm25": f"CASE WHEN marked THEN 1.05::DOUBLE ELSE 1.0 END + {_pl(_MANY, 0.08)}",
    "tfidf": f"CASE WHEN index <= 2 OR marked THEN 1.08::DOUBLE ELSE 0.92 END + {_pl(_MANY, 0.04)} + {_pl(_DATA, 0.06)}", "dense": _DENSE, "sparse": f"{_DENSE} * 0.72",
}
_K = {"title_bm25": _TOPK, "chunk_bm25": _TOPK, "tfidf": f"CASE WHEN index <= 3 THEN {_TOPK} ELSE greatest(30, floor({_TOPK} * 0.9)) END", "dense": "dense_top_k", "sparse": "sparse_top_k"}
ACTIONS = f"""{_GRAPH}, {_BUDGETS}, sb AS (SELECT *, {_has('lower(query)', LEXICON.constraint_markers)} AS marked FROM (SELECT qid, bud.*, CAST(i - 1 AS INTEGER) AS index, subs[i] AS query FROM (SELECT *, unnest(range(1, len(subs) + 1)) AS i FROM gq) JOIN bud USING (profile))), actions AS (
  {' UNION ALL '.join(f"SELECT qid, index, '{s}' AS source, query, CAST({_K[s]} AS INTEGER) AS top_k, round({_W[s]}, 6) AS weight FROM sb WHERE index < {understand.LEXICAL[s]}" for s in understand.LEXICAL)}
  UNION ALL SELECT qid, index, 'api', query, CAST(least({understand.API_TOP_K}, greatest(1, {_TOPK})) AS INTEGER), CASE WHEN index = 0 THEN 0.82::DOUBLE ELSE 0.72 END FROM sb WHERE index < {understand.API_QUERIES}
  UNION ALL SELECT qid, index, 'api_snippet', query, {understand.SNIPPET_TOP_K}, CASE WHEN index = 0 THEN 0.74::DOUBLE ELSE 0.64 END FROM sb WHERE index < {understand.API_QUERIES}
  UNION ALL SELECT qid, -1, 'concept', concept_query, concept_top_k, 0.72 FROM gq JOIN bud USING (profile) WHERE concept_query <> ''
  UNION ALL SELECT qid, -1, 'alias', CASE WHEN alias_query <> '' THEN alias_query ELSE concept_query END, alias_top_k, CASE WHEN profile IN ('auto_locator', 'method_or_dataset', 'dataset_or_benchmark') THEN 0.92 ELSE 0.86 END FROM gq JOIN bud USING (profile) WHERE alias_enabled = 1 AND (alias_query <> '' OR concept_query <> ''))"""
AVAILABLE = ["title_bm25", "chunk_bm25", "tfidf", "dense", "sparse", "api", "concept", "alias"]


def actions(spark, d):
    return understand.actions(intents(spark, d), spark, LEXICON, AVAILABLE)


_ACT = f"WITH {INTENTS}, {ACTIONS}, act AS (SELECT * FROM actions WHERE source IN {_in(tuple(AVAILABLE))})"


@query("q22_actions", f"{_ACT} SELECT qid, index, source, query, top_k, weight::DOUBLE AS weight FROM act")
def q22(spark, d):
    return actions(spark, d)


@query("q23_constraint_queries", f"WITH {INTENTS} SELECT qid, i - 1 AS index, {_has('lower(subs[i])', LEXICON.constraint_markers)} AS marked FROM (SELECT *, unnest(range(1, len(subs) + 1)) AS i FROM intents)")
def q23(spark, d):
    return q10(spark, d).select("qid", "index", understand.marked(c("sub_query"), LEXICON).alias("marked"))


@query("q24_concept_query", f"WITH {INTENTS}, {_GRAPH} SELECT qid, concept_query, alias_query FROM gq")
def q24(spark, d):
    return intents(spark, d).select("qid", understand.concept_query().alias("concept_query"), understand.alias_query().alias("alias_query"))


@query("q34_sub_query_top_k", f"WITH {INTENTS} SELECT qid, i - 1 AS index, CAST(CASE WHEN i <= 4 THEN 35 ELSE 30 END AS INTEGER) AS top_k FROM (SELECT *, unnest(range(1, len(subs) + 1)) AS i FROM intents)")
def q34(spark, d):
    return q10(spark, d).select("qid", "index", intent.sub_query_top_k(c("index"), 35).alias("top_k"))


@query("r25_action_routing", f"{_ACT} SELECT source, count(*) AS n, CAST(sum(top_k) AS BIGINT) AS wanted FROM act GROUP BY source")
def r25(spark, d):
    a = held(actions(spark, d))  # read once for each branch
    parts = [a.where(c("source") == s).groupBy("source").agg(F.count("*").alias("n"), F.sum("top_k").alias("wanted")) for s in AVAILABLE]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("r26_action_budget", f"WITH {INTENTS}, {ACTIONS} SELECT qid, index, source FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY index, source) AS i FROM actions WHERE source IN ('api', 'api_snippet')) WHERE i <= 3")
def r26(spark, d):
    outside = understand.actions(intents(spark, d), spark, LEXICON).where(c("source").isin("api", "api_snippet"))
    return first_n(outside, ["qid"], [F.asc("index"), F.asc("source")], 3).select("qid", "index", "source")


def clean_terms_sql(low: str) -> str:
    """SQL of understand.clean_terms with the fixtures' lexicon."""
    for p in LEXICON.locators:
        low = f"regexp_replace({low}, {_q(p)}, ' ', 'g')"
    return f"list_filter(regexp_extract_all({low}, '[a-z0-9]+(?:-[a-z0-9]+)?'), lambda t: t NOT IN {_in(LEXICON.generic)})[1:14]"


@query("q26_clean_query", f"WITH {INTENTS} SELECT qid, array_to_string({clean_terms_sql('low')}, ' ') AS clean, len(regexp_extract_all(low, '[a-z0-9]+(?:-[a-z0-9]+)?')) AS n FROM intents")
def q26(spark, d):
    words = F.regexp_extract_all(F.lower("query_text"), F.lit("[a-z0-9]+(?:-[a-z0-9]+)?"), F.lit(0))
    return asked(spark, d).select("qid", understand.clean_for_recall(c("query_text"), LEXICON).alias("clean"), F.size(words).cast("long").alias("n"))


_KEYPH = f"list_transform(regexp_extract_all(clean, '\"([^\"]{{3,120}})\"', 1), lambda x: lower({space_sql('x')})) || list_filter({_list(LEXICON.phrase_hints)}, lambda p: regexp_matches(low, '(^|[^a-z0-9])' || p || '($|[^a-z0-9])')) || list_transform(regexp_extract_all(low, '\\b[a-z][a-z0-9]+(?:-[a-z0-9]+)+(?:\\s+[a-z][a-z0-9]+){{0,2}}\\b'), lambda x: {space_sql('x')})"


@query("q27_key_phrases", f"WITH {INTENTS}, kp AS (SELECT qid, {_KEYPH} AS ks FROM intents) SELECT qid, array_to_string(list_filter(ks, lambda v, i: v <> '' AND list_position(ks, v) = i), '|') AS phrases FROM kp")
def q27(spark, d):
    return asked(spark, d).select("qid", F.array_join(understand.key_phrases(T.normalize_space(c("query_text")), Dictionary(spark, list(LEXICON.phrase_hints))), "|").alias("phrases"))


@query("q28_locator_queries", f"WITH {INTENTS} SELECT qid, {' OR '.join(f'regexp_matches(low, {_q(p)})' for p in LEXICON.locators)} AS locator FROM intents")
def q28(spark, d):
    return asked(spark, d).select("qid", understand.locator(c("query_text"), LEXICON).alias("locator"))


@query("q29_rewrite_need", f"WITH {INTENTS} SELECT qid, {_has('low', REWRITE)} OR {_has('it3', REWRITE)} OR (len(must) >= 4 AND len(ts) >= 10) AS needed, NOT regexp_matches(low, {_q(understand.NO_SEARCH[0])}) AND NOT regexp_matches(low, {_q(understand.NO_SEARCH[1])}) AND len(must) > 0 AND (regexp_matches(low, {_q(understand.SEARCH)}) OR regexp_matches(low, {_q(TOPIC)})) AS scholarly FROM intents")
def q29(spark, d):
    return intents(spark, d).select("qid", understand.rewrite_needed(REWRITE).alias("needed"), understand.scholarly(TOPIC).alias("scholarly"))


#: Weak intent labels by patterns, in order; the texts' own words stand for the usual cue words.
WEAK = (
    ("comparison_search", r"\b(versus|better than|compare\w*)\b"), ("dataset_search", r"\b(dataset|benchmark|corpus)\b"), ("survey_search", r"\b(survey|review|overview)\b"), ("mechanism_search", r"\b(show that|why|mechanism)\b"),
    ("origin_search", r"\b(first|origin|foundational)\b"), ("locator_search", r"\b(which paper|known as)\b"), ("recent_search", r"\bsince (19|20)\d\d\b"),
)


@query("q30_weak_intent", f"WITH {INTENTS} SELECT qid, CASE {' '.join(f'WHEN regexp_matches(low, {_q(p)}) THEN {_q(n)}' for n, p in WEAK)} ELSE 'method_search' END AS label FROM intents")
def q30(spark, d):
    low, label = F.lower("query_text"), F.lit("method_search")
    for name, pattern in reversed(WEAK):
        label = F.when(F.rlike(low, T.ascii_words(pattern)), name).otherwise(label)
    return asked(spark, d).select("qid", label.alias("label"))


@query("q31_intent_adjustment", f"WITH {INTENTS}, pr AS (SELECT item_id AS qid, CASE WHEN item_id % 7 = 3 THEN 'blocked' WHEN item_id % 7 < 2 THEN NULL ELSE 'hint ' || item_id % 4 END AS predicted, item_id % 5 / 5.0 AS sure FROM benchmark) SELECT qid, CASE WHEN predicted = 'blocked' THEN NULL WHEN predicted IS NULL OR sure < 0.4 THEN clean ELSE predicted || ': ' || clean END AS query FROM intents LEFT JOIN pr USING (qid)")
def q31(spark, d):
    i = c("item_id")
    predictions = table(spark, d, "benchmark").select(i.alias("qid"), F.when(i % 7 == 3, "blocked").when(i % 7 >= 2, F.concat(F.lit("hint "), (i % 4).cast("string"))).alias("predicted"), ((i % 5) / 5.0).alias("sure"))
    x = asked(spark, d).select("qid", T.normalize_space(c("query_text")).alias("clean")).join(predictions, "qid", "left")
    return x.select("qid", F.when(c("predicted") == "blocked", F.lit(None)).when(c("predicted").isNull() | (c("sure") < 0.4), c("clean")).otherwise(F.concat("predicted", F.lit(": "), "clean")).alias("query"))


# ---- graph search terms

_HINTS = (*LEXICON.hints, *LEXICON.singles)
_stop = f"t NOT IN {_in(T.STOP_WORDS)}"
_PARTS = f"""pt0 AS (SELECT qid, ph, generate_subscripts(ps, 1) AS part, unnest(ps) AS p FROM (SELECT qid, ph, regexp_split_to_array(low, '[|;,/]') AS ps FROM intents)),
  pt1 AS (SELECT *, list_filter(flatten(list_transform(list_filter(regexp_extract_all(p, '[a-z0-9][a-z0-9-]*'), lambda t: {_stop} AND (length(t) > 2 OR t IN {_in(LEXICON.singles)})), lambda t: string_split(t, '-'))), lambda t: t <> '' AND {_stop}) AS w FROM pt0)"""
_hit = f"len(list_filter(string_split(g, ' '), lambda t: t IN {_in(_HINTS)})) > 0"
_runs = lambda n: f"list_filter(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')), lambda g: {_hit})"
_CTERMS = f"(CASE WHEN len(w) BETWEEN 2 AND 5 AND len(list_filter(w, lambda t: t IN {_in(_HINTS)})) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END || {_runs(4)} || {_runs(3)} || {_runs(2)} || list_filter(w, lambda t: t IN {_in(LEXICON.singles)}))"
_dist = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
SEARCH_TERMS = f"""{_PARTS}, pt2 AS (SELECT qid, any_value(ph) AS ph, flatten(list({_CTERMS} ORDER BY part)) AS ct, flatten(list({_runs(5)} || {_runs(4)} || {_runs(3)} || {_runs(2)} ORDER BY part)) AS runs5 FROM pt1 GROUP BY qid),
  pt3 AS (SELECT *, ph || ct AS c0 FROM pt2), pt4 AS (SELECT *, {_dist('c0')}[1:40] AS concept_terms FROM pt3), pt5 AS (SELECT *, concept_terms || ph || runs5 AS a0 FROM pt4), terms2 AS (SELECT qid, concept_terms, {_dist('a0')}[1:60] AS alias_terms FROM pt5)"""


@query("q25_search_terms", f"WITH {INTENTS}, {SEARCH_TERMS} SELECT qid, {_bar('concept_terms')} AS concept_terms, {_bar('alias_terms')} AS alias_terms FROM terms2")
def q25(spark, d):
    x = intents(spark, d)
    both = [F.array_join(understand.search_terms(c("clean"), c("phrases"), LEXICON, alias), "|") for alias in (False, True)]
    return x.select("qid", both[0].alias("concept_terms"), both[1].alias("alias_terms"))
