"""Concept, alias and citation graph: construction, search and expansion by one- and two-hop joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.sources.tables import held, small

from .components import spread_join
from .rank import top_k


#: Hint words that are broadcast; more are joined by a shuffle.
FEW = 200_000


def _hinted_runs(docs: DataFrame, key: str, words: Column, hints: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """key, phrase, size, at: each run of so many successive words with a hint word, once for the place where it starts.

    Words meet the hints one by one, and runs are put together only around those that do: a run at the first of its hint
    words.
    """
    hints = held(hints.select(F.col("word").alias("hint")).distinct())
    few, most, at = hints.count() <= FEW, max(sizes), F.col("_at")
    # explode would have the optimizer ask for filled arrays first, and make the words twice for that; explode_outer does not
    rows = docs.select(key, words.alias("_w")).select(key, "_w", F.posexplode_outer("_w").alias("_at", "_word"))
    start = F.greatest(F.lit(0), at - (most - 1))
    near = lambda df: df.select(key, "_at", "_word", F.size("_w").alias("_size"), start.alias("_start"), F.slice("_w", start + 1, 2 * most - 1).alias("_near"))
    if few:
        hints = F.broadcast(hints)
        rows = near(rows.join(hints, F.col("_word") == F.col("hint")))
    else:  # a word that is shuffled takes those around it along, and not its whole document
        rows = near(rows).join(hints, F.col("_word") == F.col("hint"))
    clear = F.lit(most - 1)
    for k in range(most - 1, 0, -1):
        before = F.get("_near", at - F.col("_start") - k)
        rows = rows.join(hints.withColumnRenamed("hint", f"_h{k}"), before == F.col(f"_h{k}"), "left")
        clear = F.when(F.col(f"_h{k}").isNotNull(), k - 1).otherwise(clear)
    rows = rows.withColumn("_clear", clear)  # so many words right before hold no hint

    def runs(n: int) -> Column:
        low, high = F.greatest(F.col("_start"), at - F.least(F.col("_clear"), F.lit(n - 1))), F.least(at, F.col("_size") - n)
        run = lambda i: F.struct(F.concat_ws(" ", F.slice("_near", i - F.col("_start") + 1, n)).alias("phrase"), F.lit(n).alias("size"), (i + 1).alias("at"))
        return F.when(low <= high, F.transform(F.sequence(low, high), run))

    none = F.array().cast("array<struct<phrase:string,size:int,at:int>>")
    found = rows.select(key, F.explode_outer(F.concat(*(F.coalesce(runs(n), none) for n in sizes))).alias("g"))
    return found.select(key, "g.*").where("phrase is not null")


def concepts(docs: DataFrame, key: str, words: Column, hints: DataFrame, limit: int = 12) -> DataFrame:
    """key, phrase, n, confidence: the most frequent two- and three-word phrases with a hint word; confidence grows with
    the count. hints has a row per word; phrases never leave the given word list."""
    # a document's phrases stay together, so that counting and ranking share one shuffle
    rows = _hinted_runs(docs, key, words, hints, (2, 3)).select(key, "phrase")
    kept = rows.repartition(key).groupBy(key, "phrase").agg(F.count("*").alias("n"))
    best = top_k(kept, [key], [F.desc("n"), F.desc(F.length("phrase")), F.asc("phrase")], limit)
    return best.select(key, "phrase", "n", F.least(F.lit(1.0), 0.55 + 0.08 * F.col("n")).alias("confidence"))


def _by_concept(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """rows joined with all of asked that have their key. What is asked of a key becomes one row, so that a key that very
    many rows share meets it by broadcast (spread_join), and its rows are opened where they are."""
    others = [c for c in asked.columns if c != key]
    each = asked.groupBy(key).agg(F.collect_list(F.struct(*others)).alias("_asked"))
    return spread_join(rows, held(each), key).withColumn("_one", F.explode("_asked")).select("*", *(F.col(f"_one.{c}").alias(c) for c in others)).drop("_asked", "_one")


def concept_search(asked: DataFrame, mentions: DataFrame, least: float, k: int) -> DataFrame:
    """qid, paper_id, support, score, rank. asked: qid, concept; score is 1.2 times the different concepts plus confidences."""
    found = _by_concept(mentions.where(F.col("confidence") >= least), asked.select("concept", "qid"), "concept").groupBy("qid", "paper_id").agg(F.count_distinct("concept").alias("support"), F.sum("confidence").alias("total"))
    scored = found.withColumn("score", 1.2 * F.col("support") + F.col("total"))
    return top_k(scored.drop("total"), ["qid"], [F.desc(F.round("score", 6)), F.desc("paper_id")], k)


def expand(seeds: DataFrame, relations: list[tuple[str, DataFrame, float]], n: int, k: int) -> DataFrame:
    """qid, paper_id, score, relations, rank: neighbours of the seeds (qid, paper_id), seeds themselves left out.

    Each relation is a name, edges (source, target) or neighbours (qid, target, support), and a weight. Of each relation the
    n neighbours with most support are kept before the relations are added up; each task keeps its own n before any
    row leaves it.
    """
    found = None
    for name, edges, weight in relations:
        near = edges if "qid" in edges.columns else seeds.join(edges.select(F.col("source").alias("paper_id"), "target"), "paper_id").groupBy("qid", "target").agg(F.count("*").alias("support"))
        near = near.join(seeds.withColumnRenamed("paper_id", "target"), ["qid", "target"], "left_anti")
        near = top_k(near, ["qid"], [F.desc("support"), F.asc("target")], n).select("qid", F.col("target").alias("paper_id"), "support", F.lit(name).alias("relation"), (weight * F.greatest(F.lit(1), F.col("support"))).alias("score"))
        found = near if found is None else found.unionByName(near)
    total = found.groupBy("qid", "paper_id").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))
    return top_k(total, ["qid"], [F.desc(F.round("score", 6)), F.desc("paper_id")], k)


def resolve(references: DataFrame, title: str, papers: DataFrame) -> DataFrame:
    """References with target_paper_id (null where no paper has that normalised title) and score .95 or 0."""
    first = papers.select(T.normalize_title(F.col("title")).alias("norm"), "paper_id").where("norm <> ''").groupBy("norm").agg(F.min("paper_id").alias("target_paper_id"))
    found = references.withColumn("norm", T.normalize_title(F.col(title))).join(first, "norm", "left").drop("norm")
    return found.withColumn("score", F.when(F.col("target_paper_id").isNotNull(), 0.95).otherwise(0.0))


def aliases(papers: DataFrame, key: str, words: Column, head: Column, hints: DataFrame, limit: int = 16, named: DataFrame | None = None) -> DataFrame:
    """key, alias, alias_type, size, confidence, place: the names of a paper's concepts, then runs of five to two words of its
    head with a hint word, each once, in that order, up to the limit. named: the papers' concepts, where they are known."""
    named = concepts(papers, key, words, hints) if named is None else named
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), F.desc(F.length("phrase")), F.asc("phrase")))
    first = named.select(key, "phrase", F.lit(0).alias("size"), order.alias("at"))
    hinted = _hinted_runs(papers, key, head, hints, (5, 4, 3, 2)).select(key, "phrase", "size", "at")
    # a paper's phrases stay together, so that both rankings share one shuffle
    every = first.unionByName(hinted).repartition(key).withColumn("alias", T.normalize_title(F.col("phrase")))
    sequence = [F.desc(F.col("size") == 0), F.desc("size"), F.asc("at")]
    once = every.withColumn("_k", F.row_number().over(Window.partitionBy(key, "alias").orderBy(*sequence))).where("_k = 1")
    # blank names come last and go at the end; a condition before the ranking would have every name made twice
    best = top_k(once, [key], [F.asc(F.col("alias") == ""), *sequence], limit, "place").where("alias <> ''")
    sure = F.when(F.col("size") == 0, 0.86).when(F.col("size") <= 3, 0.72).otherwise(0.78)
    return best.select(key, "alias", T.concept_type(F.col("alias")).alias("alias_type"), "size", sure.alias("confidence"), "place")


def alias_search(asked: DataFrame, known: DataFrame, named: DataFrame, relations: dict[str, float], k: int) -> DataFrame:
    """qid, paper_id, score, support, relations, terms, rank by three ways that add up: aliases by their relation's weight,
    other papers that mention an alias' concept, and concepts of that name. asked: qid, term; known: paper_id, alias,
    concept_id, relation, confidence; named: paper_id, phrase, confidence.

    Papers of a concept add up for every other paper that has its alias. These are counted by query, concept and term, so a
    paper meets a number and not the other papers, whose pairs would grow with the square of them.
    """
    weight = F.lit(1.0)
    for name, w in relations.items():
        weight = F.when(F.col("relation") == name, w).otherwise(weight)
    asked = small(asked)
    direct = known.join(asked, known["alias"] == asked["term"]).select("qid", "paper_id", "concept_id", F.col("alias").alias("term"), (weight * F.col("confidence")).alias("score"), "relation")
    met = held(direct.groupBy("concept_id", "qid", "term").agg(F.count_distinct("paper_id").alias("papers")))
    asked_for = known.join(small(met.select("concept_id").distinct()), "concept_id", "left_semi")
    each = held(asked_for.groupBy("paper_id", "concept_id").agg(F.sum("confidence").alias("confidence"), F.collect_set("alias").alias("own")))
    others = _by_concept(each, met, "concept_id").withColumn("n", F.col("papers") - F.array_contains("own", F.col("term")).cast("int")).where("n > 0")
    others = others.select("qid", "paper_id", "term", (0.5 * F.col("confidence") * F.col("n")).alias("score"), F.lit("alias_to_concept_mentions").alias("relation"))
    plain = named.join(asked, named["phrase"] == asked["term"]).select("qid", "paper_id", "term", (0.25 * F.col("confidence")).alias("score"), F.lit("concept").alias("relation"))
    every = direct.drop("concept_id").unionByName(others).unionByName(plain)
    total = every.groupBy("qid", "paper_id").agg(F.sum("score").alias("score"), F.count_distinct("term").alias("support"), F.array_sort(F.collect_set("relation")).alias("relations"), F.array_sort(F.collect_set("term")).alias("terms"))
    return top_k(total, ["qid"], [F.desc(F.round("score", 6)), F.asc("paper_id")], k)


def sharing(seeds: DataFrame, mentions: DataFrame) -> DataFrame:
    """qid, target, support: papers by how many concepts they share with seeds (qid, paper_id), a concept counting for each.

    A query's seeds are counted by concept before papers are met, so a concept that very many papers mention leads to each
    of them once a query, and not once a seed; its papers stay where they are (see _by_concept). Seeds are among the
    targets, without their own mentions being told apart; expand leaves seeds out.
    """
    own = seeds.select("qid", "paper_id").distinct().join(mentions, "paper_id").groupBy("concept", "qid").agg(F.count("*").alias("n"))
    met = _by_concept(mentions.select(F.col("paper_id").alias("target"), "concept"), own, "concept")
    return met.groupBy("qid", "target").agg(F.sum("n").alias("support"))
