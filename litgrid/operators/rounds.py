"""Search in rounds: what a round's candidates leave uncovered is asked for in the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.sources.tables import held, small, stored

from . import features, fuse, rank, understand

c = F.col
#: Candidates among which a constraint must be matched, and highly relevant ones that are enough: fixed values.
HEAD, ENOUGH = 10, 5


def coverage(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The intents with counts (each constraint with the number of the first candidates that match it), missing constraints,
    how many candidates are highly relevant, and next_queries. rows: qid, rank, matched, label; asked: intents."""
    n = rows.where(c("rank") <= HEAD).select("qid", F.explode("matched").alias("must")).groupBy("qid", "must").agg(F.count("*").alias("n"))
    each = asked.select("qid", F.posexplode("must_have").alias("i", "must")).join(n, ["qid", "must"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = each.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "must", "n"))), lambda x: F.struct(x["must"].alias("must"), x["n"].alias("n"))).alias("counts"))
    high = rows.groupBy("qid").agg(F.count_if(c("label") == "highly_relevant").alias("high"))
    empty = F.array().cast("array<struct<must:string,n:bigint>>")
    x = asked.join(found, "qid", "left").join(high, "qid").withColumn("counts", F.coalesce("counts", empty)).withColumn("missing", F.transform(F.filter("counts", lambda m: m["n"] == 0), lambda m: m["must"]))
    return x.withColumn("next_queries", understand.next_queries(c("missing")))


def words(asked: DataFrame) -> DataFrame:
    """token: all words that search may ask for in any round."""
    return asked.select(F.explode(T.tokens(F.concat_ws(" ", "clean", "must_have", "fields", "soft", "sub_queries"))).alias("token")).distinct()


def goes_on() -> Column:
    """Whether a query of coverage() is asked again."""
    return (F.size("missing") > 0) & (c("high") < ENOUGH) & (F.size("next_queries") > 0)


def judged(hits: DataFrame, asked: DataFrame, papers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Candidates of the hits with features, label, score and rank. papers: (paper_id) -> paper_id, body, year, citations of
    these papers, so that only the words of papers that were hit are made and shuffled."""
    papers = papers(small(hits.select("paper_id").distinct()))
    rows = rank.candidates(hits, ["qid", "paper_id"]).join(small(held(features.prepared(asked))), "qid").join(features.worded(papers, c("body")), "paper_id")
    rows = features.with_text(rows).withColumns({"influential": F.lit(0), "references": F.lit(0)})
    no = F.lit(0)
    scored = features.decided(features.scored(rows, features.graph_alias(F.lit(False), no, no, F.lit(False), F.lit(False))))
    return rank.top_k(scored, ["qid"], [F.desc("score"), F.asc("paper_id")], 1 << 30)


def search(asked: DataFrame, retrieve: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], entities: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The last candidates, the hits of all rounds (qid, round, action, source, paper_id, score, rank, rrf), and the state of
    each query after each round (qid, round, hits, missing, high, go_on).

    asked: intents with clean; the first round asks each clean query. retrieve: (qid, action, query) -> qid, action, source,
    paper_id, score. judge: hits -> candidates with rank, matched and label. entities: paper_id, entity; papers of one
    entity are one candidate. A query goes on while constraints are missing, too few candidates are highly relevant and
    there is something else to ask; at most `most` rounds. What is retrieved and each round's hits are written once, before they
    are read.
    """
    queries, state, hits = asked.select("qid", F.lit(0).alias("action"), c("clean").alias("query")), None, None
    for n in range(1, most + 1):
        found = stored(retrieve(queries))  # read three times
        own = entities.join(small(found.select("paper_id").distinct()), "paper_id", "left_semi")
        found = found.join(small(held(own)), "paper_id", "left").withColumn("paper_id", F.coalesce("entity", "paper_id"))
        best = found.groupBy("qid", "action", "source", "paper_id").agg(F.max("score").alias("score"))
        new = stored(fuse.annotated(best, ["qid", "action", "source"], [F.desc(F.round("score", 9)), F.asc("paper_id")]).withColumn("round", F.lit(n)))
        hits = new if hits is None else hits.unionByName(new)
        rows = stored(judge(hits))
        cover = stored(coverage(rows, asked).select("qid", "missing", "high", "next_queries").withColumn("go_on", goes_on()))
        met = new.groupBy("qid").agg(F.count("*").alias("hits"))
        now = cover.join(met, "qid", "left" if n == 1 else "inner").select("qid", F.lit(n).alias("round"), F.coalesce("hits", F.lit(0)).alias("hits"), F.array_join("missing", "|").alias("missing"), "high", "go_on")
        state = now if state is None else state.unionByName(now)
        queries = stored(cover.where("go_on").select("qid", F.posexplode("next_queries").alias("action", "query")).withColumn("action", c("action") + 100 * n))
        if queries.isEmpty():
            break
    return rows, hits, state
