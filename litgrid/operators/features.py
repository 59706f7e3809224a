"""Text features of candidates against their queries' intents, scores and labels from them, and what decides selection.

Candidates have a row per query and paper with ranks by retriever (rank.candidates), the intent's columns and the paper's
text; all features are expressions over that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.functions import text as T

from . import rank

c = F.col
#: Profiles of many answers and of one: fixed values.
MANY, ONE = ("real_multi_answer", "survey_or_list"), ("auto_locator", "foundational_or_origin")
#: Retrievers whose good ranks count as support: fixed values.
SUPPORT = ("title_bm25", "chunk_bm25", "tfidf", "dense", "sparse", "concept", "api", "api_snippet")


def prepared(intents: DataFrame) -> DataFrame:
    """Intents with each constraint's tokens and normal form, computed once per query."""
    info = lambda x: F.transform(x, lambda t: F.struct(t.alias("text"), T.tokens(t).alias("words"), T.normalize_title(t).alias("phrase")))
    return intents.withColumn("must_info", F.filter(info(c("must_have")), lambda m: F.size(m["words"]) > 0)).withColumn("soft_info", info(c("soft"))).withColumn("asked", F.array_distinct("query_tokens"))


def _weight(m: Column) -> Column:
    return F.when((F.size(m["words"]) > 1) | F.contains(m["text"], F.lit("-")), 1.6).when(F.length(m["words"][0]) <= 3, 0.7).otherwise(1.0)


def _sum(items: Column, value) -> Column:
    return F.aggregate(F.transform(items, value), F.lit(0.0), lambda a, x: a + x)


def _inside(m: Column) -> Column:
    return (F.size(m["words"]) > 1) & F.contains(c("whole"), m["phrase"])


def worded(papers: DataFrame, text: Column) -> DataFrame:
    """Papers with the tokens and the normal form of their text, computed once per paper and not once per candidate."""
    return papers.withColumn("have", F.array_distinct(T.tokens(text))).withColumn("whole", T.normalize_title(text))


def with_text(rows: DataFrame) -> DataFrame:
    """Adds matched and missing constraints, coverage and the text bonuses. rows: columns of prepared() and worded()."""
    hit = lambda m: _inside(m) | (F.size(F.filter(m["words"], lambda w: F.array_contains(c("have"), w))) >= F.least(F.lit(2), F.size(m["words"])))
    rows = rows.withColumn("matched_info", F.filter("must_info", hit)).withColumn("missing_info", F.filter("must_info", lambda m: ~hit(m)))
    total, phrases = _sum(c("must_info"), _weight), F.filter("matched_info", lambda m: F.size(m["words"]) > 1)
    single = lambda m: (F.size(m["words"]) == 1) & (F.length(m["words"][0]) >= 5) & F.array_contains(c("have"), m["words"][0])
    soft = _sum(c("soft_info"), lambda m: F.when(_inside(m), F.least(F.lit(0.5), 0.12 * F.size(m["words"]))).when(single(m), 0.5).otherwise(0.0))
    strong = F.filter("soft_info", lambda m: ((F.size(m["words"]) >= 3) | F.contains(m["text"], F.lit("-"))) & (m["phrase"] != "") & F.contains(c("whole"), m["phrase"]))
    step = lambda m: F.when(F.size(m["words"]) >= 5, 0.6).when(F.size(m["words"]) >= 4, 0.45).when(F.contains(m["text"], F.lit("-")), 0.35).otherwise(0.25)
    return rows.withColumns({
        "matched": F.transform("matched_info", lambda m: m["text"]), "missing": F.transform("missing_info", lambda m: m["text"]),
        "coverage": F.when(total > 0, _sum(c("matched_info"), _weight) / total).otherwise(0.0), "missing_weight": _sum(c("missing_info"), _weight),
        "keyword_match": F.when(F.size("asked") > 0, F.size(F.array_intersect("have", "asked")) / F.size("asked")).otherwise(0.0),
        "phrase_bonus": F.when(F.size(phrases) > 0, F.size(F.filter(phrases, lambda m: F.contains(c("whole"), m["phrase"]))) / F.size(phrases)).otherwise(0.0),
        "soft_alias": F.least(F.lit(1.0), soft), "strong_alias": F.least(F.lit(1.25), _sum(strong, step)),
    }).drop("have", "whole", "matched_info", "missing_info")


def graph_alias(found: Column, support: Column, terms: Column, to_concept: Column, typed: Column) -> Column:
    """Bonus of candidates that an alias led to: by support, number of matched terms and kinds of relations."""
    total = 0.18 + F.least(F.lit(0.4), 0.08 * F.greatest(F.lit(0), support)) + F.least(F.lit(0.36), 0.12 * terms) + F.when(to_concept, 0.12).otherwise(0.0) + F.when(typed, 0.24).otherwise(0.0)
    return F.when(found, F.least(F.lit(1.0), total)).otherwise(0.0)


def scored(rows: DataFrame, graph: Column) -> DataFrame:
    """Adds graph_alias, score (all fifteen features and the penalty) and the relevance label. rows: with_text's columns, ranks,
    citations, influential, references and year."""
    rows = rows.withColumn("graph_alias", graph)
    features = {
        "coverage": c("coverage"), "retrieval_signal": rank.retrieval_signal(c("best_score")), "rank_signal": c("rank_signal"), "rrf_signal": rank.rrf_signal(c("rrf")), "sparse_synergy": rank.sparse_synergy(), "academic_synergy": rank.academic_synergy(),
        "keyword_match": c("keyword_match"), "soft_alias": c("soft_alias"), "strong_alias": c("strong_alias"), "graph_alias": c("graph_alias"), "source_confidence": F.least(F.lit(1.0), c("n_sources") / 3.0), "citation_authority": F.least(F.lit(1.0), F.log1p(c("citations")) / 8),
        "graph_authority": rank.graph_authority(c("influential"), c("references")), "recency": rank.recency(c("year")), "phrase_bonus": c("phrase_bonus"),
    }
    return rows.withColumn("score", F.round(rank.final_score(features, 0.07 * c("missing_weight")), 6)).withColumn("label", rank.label(c("coverage"), c("best_score").isNotNull(), c("n_sources")))


def within(source: str, most: int) -> Column:
    return F.coalesce(c(f"r_{source}") <= most, F.lit(False))


def decided(rows: DataFrame) -> DataFrame:
    """Adds support, the alias signal, the seven lanes, and what the redundancy test and the preselection score need."""
    has, there = F.size("matched") > 0, lambda s: c(f"r_{s}").isNotNull()
    rows = rows.withColumn("support", sum((F.when(within(s, 120), 1).otherwise(0) for s in SUPPORT), F.lit(0))).withColumn("alias_signal", F.greatest("soft_alias", "strong_alias", "graph_alias") >= 0.35)
    title, weak = within("title_bm25", 80), c("label") == "weakly_relevant"
    return rows.withColumns({
        "constraint_coverage": has & ~weak, "multi_source_support": c("support") >= 2, "title_anchor": title, "dense_lexical_bridge": there("dense") & ((c("support") >= 2) | has | c("alias_signal")),
        "sparse_lexical_bridge": there("sparse") & ((c("support") >= 2) | title | has), "academic_evidence": within("api", 80) & (within("api_snippet", 120) | has | ~weak), "alias_or_graph": c("alias_signal") | there("concept"),
        "dense_only_weak": there("dense") & (c("support") <= 1) & ~has & ~c("alias_signal"), "sure": (c("label") == "highly_relevant") | (c("support") >= 3) | c("alias_signal"),
    })


#: Lanes in their order, with the name of their quota: fixed values.
LANES = {"constraint_coverage": "constraint", "multi_source_support": "multi_source", "title_anchor": "title", "dense_lexical_bridge": "dense", "sparse_lexical_bridge": "sparse", "academic_evidence": "academic", "alias_or_graph": "alias"}


def preselect_score(place: Column) -> Column:
    """The score by which lanes are filled: the final score, the place in the pool, support, constraints, ranks and bonuses."""
    many, one = c("profile").isin(*MANY), c("profile").isin(*ONE)
    plus = lambda test, v: F.when(test, v).otherwise(0.0)
    total = c("score") + 0.16 / (1.0 + place / 45.0) + 0.09 * F.least(F.lit(4), c("support")) + 0.08 * F.least(F.lit(3), F.size("matched")) + 0.05 * F.least(F.lit(2), c("n_sources")) + rank.rank_bonus()
    total = total + 0.18 * c("soft_alias") + 0.32 * c("strong_alias") + 0.2 * c("graph_alias") + plus(many & (c("support") >= 2), 0.1) + plus(one & (within("title_bm25", 50) | c("alias_or_graph")), 0.12)
    return F.round(total - plus(c("dense_only_weak"), 0.16) - plus((c("label") == "weakly_relevant") & (c("support") <= 1), 0.08), 6)


def quotas(profile: str, target: int) -> dict[str, int]:
    """Rows of each lane, and under `head` the protected rows, by profile and target."""
    q = {"constraint": max(4, target // 5), "multi_source": max(6, target // 4), "title": max(5, target // 5), "dense": max(5, target // 5), "sparse": max(4, target // 6), "academic": max(4, target // 6), "alias": max(2, target // 10), "head": max(7, target // 5)}
    if profile in MANY:
        q |= {"multi_source": q["multi_source"] + 3, "dense": q["dense"] + 2, "alias": max(1, target // 14), "head": max(6, target // 5)}
    elif profile in ONE:
        q |= {"title": q["title"] + 3, "alias": q["alias"] + 2, "head": max(8, target // 4)}
    elif profile == "dataset_or_benchmark":
        q |= {"dense": q["dense"] + 2, "sparse": q["sparse"] + 2}
    return {k: min(target, v) for k, v in q.items()}


def backfill_bonus() -> Column:
    """What good source ranks add to the score when the list is filled up, by profile, support and semantic evidence."""
    r = lambda s: c(f"r_{s}")
    ranks = ("title_bm25", "chunk_bm25", "sparse", "tfidf", "concept", "api", "api_snippet")
    support = sum((F.when(within(s, 100), 1).otherwise(0) for s in ranks), F.lit(0))
    lexical = within("title_bm25", 100) | within("chunk_bm25", 100) | within("tfidf", 100)
    semantic, many = (F.greatest("soft_alias", "strong_alias", "graph_alias") >= 0.45) | (F.size("matched") > 0), c("profile").isin(*MANY)
    plus = lambda test, v: F.when(test, v).otherwise(0.0)
    bonus = plus(within("title_bm25", 100), 0.2 / (1.0 + r("title_bm25") / 28.0) + plus(many & within("title_bm25", 35) & semantic, 0.08 / (1.0 + r("title_bm25") / 35.0)))
    bonus = bonus + plus(within("chunk_bm25", 100) & ((support >= 2) | (c("score") >= 0.9) | within("chunk_bm25", 12)), 0.14 / (1.0 + r("chunk_bm25") / 26.0))
    with_words = 0.16 / (1.0 + r("sparse") / 34.0) + plus(many & semantic & within("sparse", 70), 0.06 / (1.0 + r("sparse") / 40.0))
    alone = 0.04 / (1.0 + r("sparse") / 20.0) + plus(semantic & (many | (c("profile") == "dataset_or_benchmark")), 0.1 / (1.0 + r("sparse") / 12.0))
    bonus = bonus + F.when(within("sparse", 90) & lexical, with_words).when(within("sparse", 12) & ~lexical, alone).otherwise(0.0)
    bonus = bonus + plus(within("tfidf", 60) & (support >= 2), 0.06 / (1.0 + r("tfidf") / 24.0)) + plus(within("concept", 45) & (support >= 2), 0.05 / (1.0 + r("concept") / 20.0))
    bonus = bonus + plus(within("api", 100), 0.18 / (1.0 + r("api") / 30.0) + plus(within("api_snippet", 120), 0.16 / (1.0 + r("api_snippet") / 36.0)))
    bonus = bonus + F.when(support >= 3, 0.08).when(support >= 2, 0.04).otherwise(0.0) + plus(semantic & (support >= 2) & many, 0.06)
    cap = F.when(semantic & within("title_bm25", 40), 0.24).when(within("title_bm25", 15), 0.16).otherwise(0.12)
    cap = F.greatest(cap, F.when(semantic & within("sparse", 8), 0.22).otherwise(0.0))
    bonus = F.when(support <= 1, F.least(bonus, cap)).otherwise(bonus) * F.when(c("label") == "weakly_relevant", 0.55).otherwise(1.0) * F.when(many & (support <= 1) & ~semantic, 0.7).otherwise(1.0)
    return F.least(F.when(many & semantic, 0.5).otherwise(0.36), bonus)
