"""Searches in rounds: what they read is made once, and what tasks keep of very many documents."""

import pytest
from pyspark.sql import functions as F

from litgrid.operators import index, rounds
from litgrid.plans import fixtures


@pytest.mark.parametrize("in_memory", [None, 0])
def test_tokens_made_once_for_titles_lines_and_texts(spark, sf_dir, in_memory):
    """Searches by some words find what they find in token_rows of each view, whatever else the texts hold."""
    odd = [(-1, None), (-2, ""), (-3, "\n\n"), (-4, "\nde la. The well-known\r\n\nen tion"), (-5, "Él niño. de\nEN en -tion- en"), (-6, ".en"), (-7, "en\nde la\nde")]
    docs = fixtures.papers(spark, sf_dir, "text")
    title = F.regexp_extract("text", r"^([^.\n]*)", 1)
    odd = spark.createDataFrame(odd, "doc_id long, text string").select(F.concat(F.lit("doc:"), "doc_id").alias("paper_id"), title.alias("title"), F.substring("text", F.length(title) + 2, F.length("text")).alias("abstract"), "text")
    docs = docs.select("paper_id", "title", "abstract", "text").unionByName(odd)
    terms = spark.createDataFrame([("p", "en"), ("p", "tion"), ("q", "de"), ("q", "nino"), ("q", "la"), ("r", "well-known"), ("r", "nowhere")], "qid string, token string").withColumn("weight", F.lit(1.0))
    titles, pieces, wholes = index.text_views(docs, "paper_id", F.col("title"), F.col("text"), terms.select("token"), in_memory)
    lines = docs.select("paper_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    rows = lambda x: sorted((r["qid"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in x.collect())
    for made, plain in [(titles, index.token_rows(docs, "paper_id", F.col("title"))), (pieces, index.token_rows(lines, "paper_id", F.col("line")))]:
        assert rows(index.bm25(terms, made, 30)) == rows(index.bm25(terms, plain, 30))
        assert made[1:] == index.counted(plain)[1:]
    plain = index.token_rows(docs, "paper_id", F.concat_ws(" ", "title", "abstract"))
    found = rows(index.tfidf_top_k(terms, wholes, 30))
    assert found == rows(index.tfidf_top_k(terms, plain, 30)) and {q for q, *_ in found} == {"p", "q", "r"}
    assert wholes[0].where("exists(tokens, t -> t is null)").isEmpty()


def test_many_equal_scores_in_tasks(spark):
    """Documents of several batches of a task, most with scores of others: the first of equals by their ids."""
    words = ["a1 b1", "a1", "a1 a1 c1", "b1 c1 d1", "d1 d1 b1"]
    docs = index.token_rows(spark.createDataFrame([(f"d{i * 7919 % 9000}", words[i % 5] if i % 3 else "c1") for i in range(9000)], "id string, text string").repartition(2), "id", F.col("text"))
    terms = spark.createDataFrame([("p", "a1", 1.0), ("q", "b1", 1.0), ("q", "d1", 2.0), ("r", "c1", 1.0)], "qid string, token string, weight double")
    plain = {}
    for r in index.bm25_scores(terms, docs).collect():
        plain.setdefault(r["qid"], []).append((-round(r["score"], 9), r["doc_id"]))
    found = {}
    for r in index.bm25(terms, docs, 5).orderBy("rank").collect():
        found.setdefault(r["qid"], []).append((-round(r["score"], 9), r["doc_id"]))
    assert found == {q: sorted(x)[:5] for q, x in plain.items()}


def test_a_round_is_retrieved_once_and_only_its_papers_are_read(spark):
    made, asked_for = spark.sparkContext.accumulator(0), []
    intents = spark.createDataFrame([(1, "deep nets", ["deep", "graphs"], ["field"], ["soft"], ["sub"])], "qid long, clean string, must_have array<string>, fields array<string>, soft array<string>, sub_queries array<string>")
    intents = intents.withColumn("query_tokens", F.array(F.lit("deep"), F.lit("nets"))).withColumn("profile", F.lit("real_multi_answer"))

    def retrieve(queries):
        def found(batches):
            for x in batches:
                made.add(len(x))
                yield x.assign(source="tfidf", paper_id="p1", score=1.0)[["qid", "action", "source", "paper_id", "score"]]

        return queries.coalesce(1).mapInPandas(found, "qid long, action int, source string, paper_id string, score double")

    def papers(some):
        asked_for.append([r["paper_id"] for r in some.collect()])
        return spark.createDataFrame([("p1", "deep words", 2020, 1), ("p2", "others", 2021, 2)], "paper_id string, body string, year int, citations int")

    rows, _, state = rounds.search(intents, retrieve, lambda hits: rounds.judged(hits, intents, papers), spark.createDataFrame([("p1", "p1")], "paper_id string, entity string"))
    assert [r["paper_id"] for r in rows.collect()] == ["p1"] and asked_for == [["p1"], ["p1"]]
    second = ["graphs field soft", "graphs sub"]
    assert made.value == 1 + len(second) and state.count() == 2
    words = {r["token"] for r in rounds.words(intents).collect()}
    assert words >= {w for q in ["deep nets", *second] for w in q.split(" ")}
