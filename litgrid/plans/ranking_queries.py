"""Queries of candidate features, scores, lanes and selection (K), with their SQL.

Queries are suppliers: their text names the parts that head their title hits. Papers are parts: name, type and brand.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.operators import features, intent, rank, rounds, select, understand
from litgrid.operators.understand import Lexicon
from litgrid.sources.tables import held, small, stored

from .fixtures import PAPERS, papers, table, title_sql, tokens_sql
from .registry import query
from .search_queries import _ACA, _ALL, _BONUS, _RANK_SIGNAL, _SYN, _WIDE, ranked
from .understanding_queries import _has, intents_sql

c = F.col
#: A small lexicon of our own on the parts' names.
LEXICON = Lexicon(
    synonyms={"small ring": ("tiny ring", "small ring economy brand"), "red widget": ("red widget promo",), "hot plate": ("hot-plate", "hot plate large"), "blue gear": ("cold gear",), "old rod": ("old rod standard brand wear",), "large bolt": ("large bolt medium",)},
    bridges={"hot ring": ("warm ring",), "widget": ("gizmo",), "anvil": ("heavy anvil large",), "cold gear": ("blue gear",)},
    patterns=(r"\bnew [a-z]+\b",), fields={"gear": "transmission", "rod": "bars", "plate": "sheets"}, noise=("brand",), relaxed=(("survey", ("old", "rod")),), extras=((("better",), ("hot plate standard",)),), anchors=("widget",),
    hints=("gear", "rod"), singles=("anvil",), generic=("paper",), locators=("which paper",), phrase_hints=("hot plate",), constraint_markers=("than",),
)
#: Queries up to which their intents, of some kilobytes each, are broadcast.
FEW_QUERIES = 5_000
TAILS = (", better than larger", ", which paper", ", a survey", "", ", a dataset")
_KQ = f"kq AS (SELECT qid, string_agg(p_name, ', ' ORDER BY rank) || [{', '.join(repr(t) for t in TAILS)}][qid % {len(TAILS)} + 1] AS clean FROM ranked JOIN part ON p_partkey = paper_id WHERE source = 'title_bm25' AND rank <= 3 GROUP BY qid)"
_LANES = ", ".join(features.LANES)
_within = lambda s, k: f"coalesce(r_{s} <= {k}, false)"
_if = lambda test, v: f"CASE WHEN {test} THEN {v} ELSE 0 END"
_total = lambda xs, f: f"coalesce(list_sum(list_transform({xs}, lambda m: {f})), 0)"
_w = "CASE WHEN len(m.words) > 1 OR contains(m.text, '-') THEN 1.6::DOUBLE WHEN length(m.words[1]) <= 3 THEN 0.7 ELSE 1.0 END"
_in = "(len(m.words) > 1 AND contains(whole, m.phrase))"
_info = lambda x: f"list_transform({x}, lambda t: {{'text': t, 'words': {tokens_sql('t')}, 'phrase': {title_sql('t')}}})"
_hit = f"({_in} OR len(list_filter(m.words, lambda w: list_contains(have, w))) >= least(2, len(m.words)))"
_single = "(len(m.words) = 1 AND length(m.words[1]) >= 5 AND list_contains(have, m.words[1]))"
_strong = "((len(m.words) >= 3 OR contains(m.text, '-')) AND m.phrase <> '' AND contains(whole, m.phrase))"
_body = "p_name || ' ' || p_type || ' ' || p_brand"
_many, _one = "profile IN ('real_multi_answer', 'survey_or_list')", "profile IN ('auto_locator', 'foundational_or_origin')"
_FEATURES = f"""{_ALL[5:]}, {_WIDE}, rs AS {_RANK_SIGNAL}, {_KQ}, {intents_sql('SELECT qid, clean FROM kq', LEXICON)},
  f0 AS (SELECT w.*, rank_signal, rrf, list_filter({_info('must')}, lambda m: len(m.words) > 0) AS mi, {_info('soft')} AS si, list_filter(ts, lambda v, i: list_position(ts, v) = i) AS asked, must, soft, fields, subs, profile, ts, low, p_name, p_size, list_distinct({tokens_sql(_body)}) AS have, {title_sql(_body)} AS whole FROM wide w JOIN rs USING (qid, paper_id) JOIN fused USING (qid, paper_id) JOIN intents USING (qid) JOIN part ON p_partkey = paper_id),
  f1 AS (SELECT *, list_filter(mi, lambda m: {_hit}) AS hit, list_filter(mi, lambda m: NOT {_hit}) AS mis FROM f0),
  f2 AS (SELECT *, list_transform(hit, lambda m: m.text) AS matched, list_transform(mis, lambda m: m.text) AS missing, CASE WHEN {_total('mi', _w)} > 0 THEN {_total('hit', _w)} / {_total('mi', _w)} ELSE 0 END AS coverage, {_total('mis', _w)} AS missing_weight, CASE WHEN len(asked) > 0 THEN len(list_filter(asked, lambda a: list_contains(have, a))) / len(asked) ELSE 0 END AS keyword_match,
    CASE WHEN len(list_filter(hit, lambda m: len(m.words) > 1)) > 0 THEN len(list_filter(hit, lambda m: {_in})) / len(list_filter(hit, lambda m: len(m.words) > 1)) ELSE 0 END AS phrase_bonus, least(1.0, {_total('si', f'CASE WHEN {_in} THEN least(0.5::DOUBLE, 0.12 * len(m.words)) WHEN {_single} THEN 0.5 ELSE 0 END')}) AS soft_alias,
    least(1.25, {_total('si', f"CASE WHEN NOT {_strong} THEN 0::DOUBLE WHEN len(m.words) >= 5 THEN 0.6 WHEN len(m.words) >= 4 THEN 0.45 WHEN contains(m.text, '-') THEN 0.35 ELSE 0.25 END")}) AS strong_alias,
    CASE WHEN r_alias IS NULL THEN 0 ELSE least(1.0, 0.18::DOUBLE + least(0.4, 0.08 * (p_size % 7)) + least(0.36, 0.12 * (p_size % 5)) + {_if('p_size % 3 = 0', 0.12)} + {_if('p_size % 4 = 0', 0.24)}) END AS graph_alias FROM f1),
  f3 AS (SELECT *, round(0.28 * coverage + 0.05 * best_score / (best_score + 5.0) + 0.48 * rank_signal + 0.3 * least(1.0, rrf / 0.055) + 0.22 * ({_SYN}) + 0.18 * ({_ACA}) + 0.1 * keyword_match + 0.12 * soft_alias + 0.42 * strong_alias + 0.18 * graph_alias + 0.05 * least(1.0, n_sources / 3.0) + 0.04 * least(1.0, ln(1 + p_size) / 8)
    + 0.05 * (0.75 * least(1.0, ln(1 + p_size % 9) / 5) + 0.25 * least(1.0, ln(1 + p_size % 40) / 8)) + 0.03 * CASE WHEN 2010 + p_size % 15 >= 2023 THEN 1.0 WHEN 2010 + p_size % 15 >= 2019 THEN 0.8 WHEN 2010 + p_size % 15 >= 2015 THEN 0.6 ELSE 0.4 END + 0.03 * phrase_bonus
    - greatest(0, least(0.45, 0.07 * missing_weight) - 0.15 * soft_alias - 0.25 * strong_alias - 0.18 * graph_alias), 6) AS score, CASE WHEN coverage >= 0.6 THEN 'highly_relevant' WHEN coverage >= 0.3 OR n_sources >= 2 THEN 'partially_relevant' ELSE 'weakly_relevant' END AS label, {' + '.join(_if(_within(s, 120), 1) for s in features.SUPPORT)} AS support FROM f2),
  f4 AS (SELECT *, greatest(soft_alias, strong_alias, graph_alias) >= 0.35 AS alias_signal, row_number() OVER (PARTITION BY qid ORDER BY score DESC, paper_id) AS rank FROM f3),
  f5 AS (SELECT *, len(matched) > 0 AND label <> 'weakly_relevant' AS constraint_coverage, support >= 2 AS multi_source_support, {_within('title_bm25', 80)} AS title_anchor, r_dense IS NOT NULL AND (support >= 2 OR len(matched) > 0 OR alias_signal) AS dense_lexical_bridge, r_sparse IS NOT NULL AND (support >= 2 OR {_within('title_bm25', 80)} OR len(matched) > 0) AS sparse_lexical_bridge,
    {_within('api', 80)} AND ({_within('api_snippet', 120)} OR len(matched) > 0 OR label <> 'weakly_relevant') AS academic_evidence, alias_signal OR r_concept IS NOT NULL AS alias_or_graph, r_dense IS NOT NULL AND support <= 1 AND len(matched) = 0 AND NOT alias_signal AS dense_only_weak, label = 'highly_relevant' OR support >= 3 OR alias_signal AS sure FROM f4),
  feat AS (SELECT *, round(score + 0.16 / (1.0 + rank / 45.0) + 0.09 * least(4, support) + 0.08 * least(3, len(matched)) + 0.05 * least(2, n_sources) + {_BONUS} + 0.18 * soft_alias + 0.32 * strong_alias + 0.2 * graph_alias + {_if(f'{_many} AND support >= 2', 0.1)} + {_if(f"{_one} AND ({_within('title_bm25', 50)} OR alias_or_graph)", 0.12)} - {_if('dense_only_weak', 0.16)} - {_if("label = 'weakly_relevant' AND support <= 1", 0.08)}, 6) AS preselect FROM f5)"""


def intents(spark, d):
    names = table(spark, d, "part").select(c("p_partkey").alias("paper_id"), "p_name")
    heads = ranked(spark, d).where("source = 'title_bm25' AND rank <= 3").join(names, "paper_id").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p_name"))), lambda x: x["p_name"]), ", ").alias("names"))
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (c("qid") % len(TAILS) + 1).cast("int"))
    return understand.intents(heads.select("qid", F.concat("names", tail).alias("query_text")), LEXICON)


def candidates(spark, d):
    """All features of all candidates."""
    # an intent is a wide row: only few are broadcast, others meet their candidates by query, as the windows do later
    asked = small(held(features.prepared(intents(spark, d))), FEW_QUERIES)
    p = table(spark, d, "part").select(c("p_partkey").alias("paper_id"), "p_name", "p_size", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("body"))
    found = small(held(features.worded(p, c("body")).join(table(spark, d, "lineitem").select((c("l_partkey") % 500).alias("paper_id")).distinct(), "paper_id", "left_semi")))
    rows = rank.candidates(ranked(spark, d), ["qid", "paper_id"]).join(found, "paper_id").join(asked, "qid")
    rows = features.with_text(rows).withColumns({"citations": c("p_size"), "influential": c("p_size") % 9, "references": c("p_size") % 40, "year": 2010 + c("p_size") % 15})
    size = c("p_size")
    return features.decided(features.scored(rows, features.graph_alias(c("r_alias").isNotNull(), size % 7, size % 5, size % 3 == 0, size % 4 == 0)))


def placed(spark, d):
    """Candidates in the order of the final score, with their preselection score."""
    rows = candidates(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "paper_id")))
    return rows.withColumn("preselect", features.preselect_score(c("rank")))


_K = f"WITH {_FEATURES} SELECT"


@query("k01_constraint_coverage", f"{_K} qid, paper_id, array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing FROM feat")
def k01(spark, d):
    return candidates(spark, d).select("qid", "paper_id", F.array_join("matched", "|").alias("matched"), F.array_join("missing", "|").alias("missing"))


@query("k02_coverage_ratio", f"{_K} qid, paper_id, round(coverage, 6)::DOUBLE AS coverage, round(missing_weight, 6)::DOUBLE AS missing_weight FROM feat")
def k02(spark, d):
    return candidates(spark, d).select("qid", "paper_id", F.round("coverage", 6).alias("coverage"), F.round("missing_weight", 6).alias("missing_weight"))


@query("k03_relevance_label", f"{_K} qid, paper_id, label FROM feat")
def k03(spark, d):
    return candidates(spark, d).select("qid", "paper_id", "label")


@query("k04_final_score", f"{_K} qid, paper_id, score::DOUBLE AS score FROM feat")
def k04(spark, d):
    return candidates(spark, d).select("qid", "paper_id", "score")


@query("k05_signals", f"{_K} qid, paper_id, round(keyword_match, 6)::DOUBLE AS keyword_match, round(best_score / (best_score + 5.0), 6) AS retrieval_signal, round(least(1.0, rrf / 0.055), 6) AS rrf_signal FROM feat")
def k05(spark, d):
    return candidates(spark, d).select("qid", "paper_id", F.round("keyword_match", 6).alias("keyword_match"), F.round(rank.retrieval_signal(c("best_score")), 6).alias("retrieval_signal"), F.round(rank.rrf_signal(c("rrf")), 6).alias("rrf_signal"))


@query("k07_synergies", f"{_K} qid, paper_id, round({_SYN}, 6) AS sparse_synergy, round({_ACA}, 6) AS academic_synergy, round(0.75 * least(1.0, ln(1 + p_size % 9) / 5) + 0.25 * least(1.0, ln(1 + p_size % 40) / 8), 6) AS graph_authority FROM feat")
def k07(spark, d):
    return candidates(spark, d).select("qid", "paper_id", F.round(rank.sparse_synergy(), 6).alias("sparse_synergy"), F.round(rank.academic_synergy(), 6).alias("academic_synergy"), F.round(rank.graph_authority(c("influential"), c("references")), 6).alias("graph_authority"))


@query("k08_bonuses", f"{_K} qid, paper_id, " + ", ".join(f"round({x}, 6)::DOUBLE AS {x}" for x in ("phrase_bonus", "soft_alias", "strong_alias", "graph_alias")) + " FROM feat")
def k08(spark, d):
    return candidates(spark, d).select("qid", "paper_id", *(F.round(x, 6).alias(x) for x in ("phrase_bonus", "soft_alias", "strong_alias", "graph_alias")))


@query("k09_rank", f"{_K} qid, paper_id, score::DOUBLE AS score, rank FROM feat WHERE rank <= 20")
def k09(spark, d):
    return rank.top_k(candidates(spark, d).select("qid", "paper_id", "score"), ["qid"], [F.desc("score"), F.asc("paper_id")], 20).withColumn("rank", c("rank").cast("long"))


@query("k10_preselect_score", f"{_K} qid, paper_id, preselect::DOUBLE AS preselect FROM feat")
def k10(spark, d):
    return placed(spark, d).select("qid", "paper_id", "preselect")


@query("k11_lane_preselection")
def k11(spark, d):
    return select.lanes(_for_lanes(spark, d))


def _for_lanes(spark, d, target: int = 120):
    return lane_columns(placed(spark, d))


def lane_columns(rows, *more):
    return rows.select("qid", "paper_id", "profile", "rank", "preselect", "sure", *features.LANES, T.tokens(c("p_name")).alias("words"), *more)


@query("k12_lanes", f"{_K} qid, paper_id, support, {_LANES}, dense_only_weak, sure FROM feat")
def k12(spark, d):
    return candidates(spark, d).select("qid", "paper_id", c("support").cast("int"), *features.LANES, "dense_only_weak", "sure")


@query("k13_rerank_fusion", f"{_K} qid, paper_id, round((1 - w) * model + w * score + 1e-9, 6)::DOUBLE AS score FROM (SELECT *, least(0.75::DOUBLE, 0.25 + 0.35 * least(1.0, strong_alias) + 0.35 * least(1.0, n_sources / 4.0)) AS w, ((paper_id * 7919) % 1000) / 1000.0 AS model FROM feat WHERE rank <= 120 AND paper_id % 9 <> 0) UNION ALL SELECT qid, paper_id, score FROM feat WHERE rank > 120 OR paper_id % 9 = 0")
def k13(spark, d):
    # model scores come from a table that lacks some papers; what has none keeps its own score
    scores = table(spark, d, "part").where("p_partkey % 9 <> 0").select(c("p_partkey").alias("paper_id"), ((c("p_partkey") * 7919) % 1000 / 1000.0).alias("model"))
    x = placed(spark, d).join(scores, "paper_id", "left")
    fused = F.round(rank.rerank_fusion(c("model"), c("score"), F.least(F.lit(1.0), "strong_alias"), F.least(F.lit(1.0), c("n_sources") / 4.0)) + 1e-9, 6)
    return x.select("qid", "paper_id", F.when((c("rank") <= 120) & c("model").isNotNull(), fused).otherwise(c("score")).alias("score"))


@query("k14_promote_aliases", f"{_K} qid, paper_id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 30 THEN 0 WHEN greatest(strong_alias, graph_alias) >= 0.9 THEN 1 ELSE 2 END, rank) AS place FROM feat WHERE rank <= 120")
def k14(spark, d):
    head = placed(spark, d).where("rank <= 120")
    strong = F.greatest("strong_alias", "graph_alias") >= 0.9
    return head.select("qid", "paper_id", F.row_number().over(Window.partitionBy("qid").orderBy(rank.promoted(c("rank"), strong))).cast("long").alias("place"))


@query("k16_diversification")
def k16(spark, d):
    return select.diversified(_for_diversity(spark, d))


def _for_diversity(spark, d):
    many = c("profile").isin(*features.MANY)
    soften = F.when(c("label") == "highly_relevant", 0.55).otherwise(1.0) * F.when(F.greatest("soft_alias", "strong_alias") >= 0.8, 0.25).otherwise(1.0)
    protected = F.broadcast(understand.budgets(spark).select("profile", c("diversity_protected").alias("protected")))
    return placed(spark, d).join(protected, "profile").select("qid", "paper_id", "rank", "score", "protected", F.when(many, 0.02).otherwise(0.1).alias("penalty"), soften.alias("soften"), "matched", T.tokens(c("p_name")).alias("words"))


_SUP100 = " + ".join(_if(_within(s, 100), 1) for s in ("title_bm25", "chunk_bm25", "sparse", "tfidf", "concept", "api", "api_snippet"))
_LEX = f"({_within('title_bm25', 100)} OR {_within('chunk_bm25', 100)} OR {_within('tfidf', 100)})"
_BACKFILL = f"""bb0 AS (SELECT *, {_SUP100} AS sup, greatest(soft_alias, strong_alias, graph_alias) >= 0.45 OR len(matched) > 0 AS sem FROM feat),
  bb1 AS (SELECT *, {_if(_within('title_bm25', 100), f"0.2 / (1.0 + r_title_bm25 / 28.0) + {_if(f'{_many} AND r_title_bm25 <= 35 AND sem', '0.08 / (1.0 + r_title_bm25 / 35.0)')}")} + {_if(f"{_within('chunk_bm25', 100)} AND (sup >= 2 OR score >= 0.9 OR r_chunk_bm25 <= 12)", '0.14 / (1.0 + r_chunk_bm25 / 26.0)')}
    + CASE WHEN {_within('sparse', 90)} AND {_LEX} THEN 0.16 / (1.0 + r_sparse / 34.0) + {_if(f'{_many} AND sem AND r_sparse <= 70', '0.06 / (1.0 + r_sparse / 40.0)')} WHEN {_within('sparse', 12)} AND NOT {_LEX} THEN 0.04 / (1.0 + r_sparse / 20.0) + {_if(f"sem AND ({_many} OR profile = 'dataset_or_benchmark')", '0.1 / (1.0 + r_sparse / 12.0)')} ELSE 0 END
    + {_if(f"{_within('tfidf', 60)} AND sup >= 2", '0.06 / (1.0 + r_tfidf / 24.0)')} + {_if(f"{_within('concept', 45)} AND sup >= 2", '0.05 / (1.0 + r_concept / 20.0)')} + {_if(_within('api', 100), f"0.18 / (1.0 + r_api / 30.0) + {_if(_within('api_snippet', 120), '0.16 / (1.0 + r_api_snippet / 36.0)')}")}
    + CASE WHEN sup >= 3 THEN 0.08 WHEN sup >= 2 THEN 0.04 ELSE 0 END + {_if(f'sem AND sup >= 2 AND {_many}', 0.06)} AS b0, greatest(CASE WHEN sem AND {_within('title_bm25', 40)} THEN 0.24 WHEN {_within('title_bm25', 15)} THEN 0.16 ELSE 0.12 END, {_if(f"sem AND {_within('sparse', 8)}", 0.22)}) AS cap1 FROM bb0),
  bb AS (SELECT *, least(CASE WHEN {_many} AND sem THEN 0.5 ELSE 0.36 END, CASE WHEN sup <= 1 THEN least(b0, cap1) ELSE b0 END * CASE WHEN label = 'weakly_relevant' THEN 0.55 ELSE 1 END * CASE WHEN {_many} AND sup <= 1 AND NOT sem THEN 0.7 ELSE 1 END) AS bonus FROM bb1),
  bc AS (SELECT *, least(50, count(*) OVER (PARTITION BY qid)) AS target, count(*) OVER (PARTITION BY qid) AS total FROM bb),
  bd AS (SELECT *, CASE WHEN {_many} THEN least(6, greatest(3, floor(target / 8))) WHEN {_one} THEN least(8, greatest(4, floor(target / 7))) ELSE least(7, greatest(4, floor(target / 7))) END AS stay, greatest(target, CASE WHEN {_many} THEN 500 WHEN {_one} THEN 180 ELSE 220 END) AS front FROM bc),
  be AS (SELECT *, coalesce(r_api <= 50 AND r_api_snippet <= 80, false) AND rank > stay AS aca FROM bd), bf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY aca DESC, r_api NULLS FIRST, r_api_snippet NULLS FIRST, rank) AS turn FROM be),
  bg AS (SELECT *, CASE WHEN rank <= stay OR total <= 12 THEN 0 WHEN aca AND turn <= least(3, greatest(1, floor(target / 12))) THEN 1 WHEN rank <= front THEN 2 ELSE 3 END AS block, round(score + bonus, 9) AS adj FROM bf)"""


@query("k17_backfill", f"WITH {_FEATURES}, {_BACKFILL} SELECT * FROM (SELECT qid, paper_id, row_number() OVER (PARTITION BY qid ORDER BY block, CASE WHEN block = 1 THEN turn ELSE 0 END, CASE WHEN block = 2 THEN -adj ELSE 0 END, CASE WHEN block = 2 THEN -score ELSE 0 END, rank) AS place FROM bg) WHERE place <= 50")
def k17(spark, d):
    return select.backfilled(placed(spark, d), features.backfill_bonus()).withColumn("place", c("place").cast("long"))


_SEED_REASON = "CASE WHEN label = 'highly_relevant' THEN 'high relevance' ELSE 'partial constraint match' END"


@query("k18_citation_seeds", f"{_K} qid, paper_id, reason, place FROM (SELECT qid, paper_id, {_SEED_REASON} AS reason, row_number() OVER (PARTITION BY qid ORDER BY round(score + {_if(chr(108) + 'abel = ' + repr('highly_relevant'), 0.3)} + {_if('len(list_filter(must, lambda m: NOT list_contains(matched, m))) = 0', 0.2)}, 6) DESC, rank) AS place FROM feat WHERE label <> 'weakly_relevant' AND (len(matched) > 0 OR label = 'highly_relevant')) WHERE place <= 5")
def k18(spark, d):
    # what is left out: weak candidates, and such without a matched constraint
    high = c("label") == "highly_relevant"
    fit = placed(spark, d).where((c("label") != "weakly_relevant") & ((F.size("matched") > 0) | high))
    priority = F.round(c("score") + F.when(high, 0.3).otherwise(0.0) + F.when(F.size(F.array_except("must_have", "matched")) == 0, 0.2).otherwise(0.0), 6)
    found = rank.top_k(fit.withColumn("p", priority), ["qid"], [F.desc("p"), F.asc("rank")], 5, "place")
    return found.select("qid", "paper_id", F.when(high, "high relevance").otherwise("partial constraint match").alias("reason"), c("place").cast("long"))


_COVER = f"""{_FEATURES}, mc AS (SELECT qid, m, count(*) AS n FROM (SELECT qid, unnest(matched) AS m FROM feat WHERE rank <= 10) GROUP BY ALL), hi AS (SELECT qid, count(*) FILTER (label = 'highly_relevant') AS high FROM feat GROUP BY qid),
  cs AS (SELECT qid, i, m, coalesce(n, 0) AS n FROM (SELECT qid, unnest(range(1, len(must) + 1)) AS i, unnest(must) AS m FROM intents) LEFT JOIN mc USING (qid, m)), cv AS (SELECT qid, list(m ORDER BY i) FILTER (n = 0) AS missing FROM cs GROUP BY qid),
  nq0 AS (SELECT *, coalesce(cv.missing, []) AS mis, fields[1:2] || soft[1:3] AS anc FROM intents LEFT JOIN cv USING (qid) JOIN hi USING (qid)),
  nq1 AS (SELECT *, list_transform(mis[1:4], lambda x: [x] || anc) || list_transform(range(1, least(3, len(mis) - 1) + 1), lambda i: [mis[i], mis[i + 1]] || soft[1:2]) || CASE WHEN len(subs) > 0 THEN [mis[1:3] || subs[1:1]] ELSE [] END AS qs FROM nq0),
  nq2 AS (SELECT *, CASE WHEN len(mis) = 0 THEN []::VARCHAR[] ELSE list_transform(qs, lambda q: array_to_string(list_filter(q, lambda v, i: list_position(q, v) = i), ' ')) END AS nx0 FROM nq1),
  cover AS (SELECT *, list_filter(nx0, lambda v, i: list_position(list_transform(nx0, lambda w: lower(w)), lower(v)) = i)[1:6] AS nexts FROM nq2)"""


def coverage(spark, d):
    """Per query: its constraints with the number of the first ten candidates that match each, the missing ones, how many
    candidates are highly relevant, and the next queries."""
    return rounds.coverage(held(placed(spark, d).select("qid", "rank", "matched", "label")), held(intents(spark, d)))


@query("k22_coverage_status", f"WITH {_COVER} SELECT qid, m AS must, CASE WHEN n >= 2 THEN 'covered' WHEN n = 1 THEN 'weak' ELSE 'missing' END AS status, len(mis) > 0 AND high < 5 AND len(nexts) > 0 AS go_on, CASE WHEN len(mis) > 0 AND high < 5 AND len(nexts) > 0 THEN 'constraints missing' WHEN high >= 5 THEN 'enough found' ELSE 'no next query' END AS reason FROM cs JOIN cover USING (qid)")
def k22(spark, d):
    x = coverage(spark, d)
    go = rounds.goes_on()
    rows = x.select("qid", go.alias("go_on"), F.when(go, "constraints missing").when(c("high") >= 5, "enough found").otherwise("no next query").alias("reason"), F.explode("counts").alias("m"))
    return rows.select("qid", c("m.must").alias("must"), F.when(c("m.n") >= 2, "covered").when(c("m.n") == 1, "weak").otherwise("missing").alias("status"), "go_on", "reason")


@query("k23_next_queries", f"WITH {_COVER} SELECT qid, i - 1 AS place, nexts[i] AS next_query FROM (SELECT qid, nexts, unnest(range(1, len(nexts) + 1)) AS i FROM cover)")
def k23(spark, d):
    return coverage(spark, d).select("qid", F.posexplode("next_queries").alias("place", "next_query")).withColumn("place", c("place").cast("long"))


_TOPIC = r"\b(gear|rod|plate|ring)\b"
_LOCQ = r"\b(known as|called)\b"


@query("k20_expansion_gate", f"""WITH {_COVER}, t6 AS (SELECT qid, count(*) FILTER (label = 'highly_relevant') AS hr, max(strong_alias) FILTER (rank <= 3) AS sa FROM feat WHERE rank <= 6 GROUP BY qid)
    SELECT qid, CASE WHEN profile IN ('survey_or_list', 'foundational_or_origin') THEN 50 WHEN profile = 'real_multi_answer' THEN 45 ELSE 30 END AS neighbors, CASE WHEN profile IN ('foundational_or_origin', 'survey_or_list', 'real_multi_answer') THEN 0.6::DOUBLE WHEN profile = 'dataset_or_benchmark' THEN 0.62 ELSE 0.65 END AS least_confidence
    FROM cover JOIN t6 USING (qid) WHERE NOT regexp_matches(low, '{_LOCQ}') AND NOT {_has("lower(main || ' ' || array_to_string(soft || must, ' '))", ('first proposed', 'introduced', 'known as', 'called'))} AND len(ts) >= 5 AND len(subs) >= 2 AND len(fields) > 0 AND len(mis) > 0 AND len(nexts) > 0 AND high < 5 AND len(must) > 0 AND (regexp_matches(low, '{_TOPIC}') OR regexp_matches(low, '{understand.SEARCH}')) AND hr < 3 AND coalesce(sa, 0) < 0.8""")
def k20(spark, d):
    """Queries whose graph may be expanded, with their profile's bounds."""
    x = coverage(spark, d)
    top = placed(spark, d).where("rank <= 6").groupBy("qid").agg(F.count_if(c("label") == "highly_relevant").alias("hr"), F.max(F.when(c("rank") <= 3, c("strong_alias"))).alias("sa"))
    said = F.lower(F.array_join(F.concat(F.array("main_intent"), "soft", "must_have"), " "))
    locating = F.rlike("low", T.ascii_words(_LOCQ)) | intent._any(said, ("first proposed", "introduced", "known as", "called"))
    fit = ~locating & (F.size("query_tokens") >= 5) & (F.size("sub_queries") >= 2) & (F.size("fields") > 0) & (F.size("missing") > 0) & (F.size("next_queries") > 0) & (c("high") < 5) & understand.scholarly(_TOPIC) & (c("hr") < 3) & (F.coalesce("sa", F.lit(0.0)) < 0.8)
    p = c("profile")
    least = F.when(p.isin("foundational_or_origin", "survey_or_list", "real_multi_answer"), 0.6).when(p == "dataset_or_benchmark", 0.62).otherwise(0.65)
    return x.join(top, "qid").where(fit).join(F.broadcast(understand.budgets(spark).select("profile", "graph_neighbors")), "profile").select("qid", c("graph_neighbors").alias("neighbors"), least.alias("least_confidence"))


@query("k19_graph_seeds", f"{_K} qid, paper_id FROM (SELECT qid, paper_id, ok, row_number() OVER (PARTITION BY qid ORDER BY ok DESC, rank) AS i, max(ok) OVER (PARTITION BY qid) AS any_ok FROM (SELECT *, CASE WHEN label <> 'weakly_relevant' THEN 1 ELSE 0 END AS ok FROM feat)) WHERE (ok = 1 AND i <= 3) OR (any_ok = 0 AND i = 1)")
def k19(spark, d):
    # a candidate that is not weak has matched something or stands in two lists
    x = placed(spark, d).withColumn("ok", (c("label") != "weakly_relevant").cast("int"))
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("ok"), "rank"))).withColumn("any_ok", F.max("ok").over(Window.partitionBy("qid")))
    return x.where("(ok = 1 AND i <= 3) OR (any_ok = 0 AND i = 1)").select("qid", "paper_id")


_FUSED_HEAD = "qid, paper_id, round((1 - w) * model + w * score + 1e-9, 6)::DOUBLE AS score FROM (SELECT *, least(0.75::DOUBLE, 0.25 + 0.35 * least(1.0, strong_alias) + 0.35 * least(1.0, n_sources / 4.0)) AS w, ((paper_id * 7919) % 1000) / 1000.0 AS model FROM feat WHERE rank <= 120 AND paper_id % 9 <> 0)"


@query("k15_merge_head", f"WITH {_FEATURES}, rr AS (SELECT * FROM (SELECT qid, paper_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, paper_id) AS rerank FROM (SELECT {_FUSED_HEAD})) WHERE rerank <= 40), u AS (SELECT coalesce(p.qid, rr.qid) AS qid, coalesce(p.paper_id, rr.paper_id) AS paper_id, rank, rerank FROM (SELECT * FROM feat WHERE rank <= 60) p FULL JOIN rr ON rr.qid = p.qid AND rr.paper_id = p.paper_id) SELECT qid, paper_id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 5 THEN 0 WHEN rerank IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN rank <= 5 OR rerank IS NULL THEN rank ELSE rerank END) AS place FROM u")
def k15(spark, d):
    """The pool's first five, then the forty best that a model scored, by fused score, then the pool."""
    scores = table(spark, d, "part").where("p_partkey % 9 <> 0").select(c("p_partkey").alias("paper_id"), ((c("p_partkey") * 7919) % 1000 / 1000.0).alias("model"))
    x = stored(placed(spark, d).where("rank <= 120").select("qid", "paper_id", "rank", "score", "strong_alias", "n_sources"))
    fused = F.round(rank.rerank_fusion(c("model"), c("score"), F.least(F.lit(1.0), "strong_alias"), F.least(F.lit(1.0), c("n_sources") / 4.0)) + 1e-9, 6)
    head = rank.top_k(x.join(scores, "paper_id").select("qid", "paper_id", fused.alias("fused")), ["qid"], [F.desc("fused"), F.asc("paper_id")], 40, "rerank")
    return rank.merge_head(x.where("rank <= 60"), head, 5).withColumn("place", c("place").cast("long"))


@query("k26_candidate_limits", f"{_K} qid, count(*) FILTER (rank <= 500) AS pool, count(*) FILTER (rank <= 120) AS reranked, count(*) FILTER (rank <= least(20, any_q)) AS protected, count(*) FILTER (rank <= greatest(20, least(any_n, 120))) AS kept FROM (SELECT *, CASE WHEN {_one} THEN 12 ELSE 8 END AS any_q, count(*) OVER (PARTITION BY qid) AS any_n FROM feat) GROUP BY qid")
def k26(spark, d):
    x = placed(spark, d).withColumn("head", F.when(c("profile").isin(*features.ONE), 12).otherwise(8)).withColumn("n", F.count("*").over(Window.partitionBy("qid")))
    return x.groupBy("qid").agg(F.count_if(c("rank") <= 500).alias("pool"), F.count_if(c("rank") <= 120).alias("reranked"), F.count_if(c("rank") <= F.least(F.lit(20), "head")).alias("protected"), F.count_if(c("rank") <= F.greatest(F.lit(20), F.least("n", F.lit(120)))).alias("kept"))


@query("k08_recency", f"WITH {PAPERS} SELECT paper_id, CASE WHEN year >= 2023 THEN 1.0 WHEN year >= 2019 THEN 0.8 WHEN year >= 2015 THEN 0.6 ELSE 0.4 END::DOUBLE AS recency FROM papers")
def k08_recency(spark, d):
    return papers(spark, d).select("paper_id", rank.recency(c("year")).alias("recency"))


@query("k10_preselect_bonus", f"{_ALL}, {_WIDE} SELECT qid, paper_id, round({_BONUS}, 6) AS bonus FROM wide")
def k10_bonus(spark, d):
    return rank.source_ranks(ranked(spark, d), ["qid", "paper_id"]).select("qid", "paper_id", F.round(rank.rank_bonus(), 6).alias("bonus"))
