import zlib

import duckdb
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.operators import evaluate, fuse, rank
from litgrid.plans import catalogue, fixtures
from litgrid.sources import tables
from litgrid.streaming import streams


def test_whole_queries(spark, sf_dir):
    run = lambda name: catalogue.QUERIES[name](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert fixtures.chunks(spark, sf_dir).select("paper_id").distinct().count() == run("i04_chunks_by_paper").count()
    assert run("r10_weighted_clauses").select("paper_id").distinct().count() > docs.count() / 2


def test_relation_edges_ranked(spark, tmp_path):
    spark.createDataFrame([(i, f"Title {w}.about {w} " + "pad " * i, "s") for i, w in enumerate(["graph", "graph", "mining"] + ["block"] * 100)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "mining graph"), (2, "block")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [tuple(r) for r in catalogue.QUERIES["p02_relation_edges_ranked"](spark, str(tmp_path)).collect()]
    assert [r[1:3] for r in rows if r[0] == "q1"] == [("ing", "doc:2")]
    assert sorted((r[1], r[3]) for r in rows if r[0] == "q2") == [(None, k) for k in range(1, 6)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, T.normalize_title(F.lit("  Émile's  Re-use: naïve ß "))) == "emile s re use naive"
    assert one(spark, T.tokens(F.lit("The state-of-the-art -x- Graph a"))) == ["state-of-the-art", "graph"]
    assert one(spark, T.arxiv_id(F.lit("https://arxiv.org/abs/2401.00001v2"))) == "2401.00001"
    assert one(spark, T.year_from_arxiv(F.lit("9901.00001"))) == 1999
    assert one(spark, T.hash_slot(F.lit("graph"), 1000)) == zlib.crc32(b"graph") % 1000
    assert one(spark, T.json_object(F.lit('<think>{"a": 1}</think>```json\n{"b": {"c": 2}}\n```'))) == '{"b": {"c": 2}}'
    assert one(spark, T.distinct_ignoring_case(F.array(*map(F.lit, ("A", "b", "a", " B", ""))))) == ["A", "b"]


def test_metrics_divide_by_k(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qid string, paper_id string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "z")], "qid string, paper_id string")
    r = evaluate.metrics(ranked, gold, spark.createDataFrame([("q",), ("none",)], "qid string"), [5]).orderBy("qid").collect()
    assert (r[0]["precision"], r[0]["recall"], r[0]["mrr"]) == (0.0, 0.0, 0.0)
    assert (r[1]["precision"], r[1]["recall"], r[1]["mrr"]) == (0.2, 0.5, 0.5)


def test_rrf_is_a_sum_of_maxima(spark):
    hits = spark.createDataFrame([("q", "p", "dense", 0.5, 0.010), ("q", "p", "dense", 0.4, 0.020), ("q", "p", "tfidf", 0.1, 0.001)], "qid string, paper_id string, source string, score double, rrf double")
    assert abs(fuse.fused(hits).first()["rrf"] - 0.021) < 1e-12


def test_entities_close_over_chains(spark):
    keys = spark.createDataFrame([(i, k) for i in range(40) for k in (f"k{i}", f"k{i + 1}")] + [(100, "other")], "node long, key string")
    found = {r["node"]: r["entity"] for r in fuse.entities(keys).collect()}
    assert {found[i] for i in range(40)} == {0} and found[100] == 100


def test_shards_cover_and_are_disjoint(spark):
    rows = spark.range(1000).withColumn("s", evaluate.shard(["id"], 7))
    assert rows.count() == 1000 and {r["s"] for r in rows.select("s").distinct().collect()} == set(range(7))


def test_top_k_grows_with_k(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("g"), "id")
    small, large = ({tuple(r) for r in rank.top_k(df, ["g"], ["id"], k).select("g", "id").collect()} for k in (2, 5))
    assert small < large


def test_upsert_and_orphans(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert sorted(map(tuple, tables.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert tables.orphans(old, "id", spark.createDataFrame([(1,)], "k long"), "k").count() == 1


def test_streamed_windows_are_the_tables(spark, sf_dir):
    out = streams.run_once(spark, f"{sf_dir}/events.parquet", lambda df: streams.event_windows(df, "1 hour"), "append", flush=True)
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_constraints(spark):
    from litgrid.operators import intent

    cons = spark.createDataFrame([("q", "graph search"), ("q", "dense-vector"), ("q", "abc")], "qid string, constraint string")
    cand = spark.createDataFrame([("q", "p1", "Search in a graph, graph search"), ("q", "p2", "abc only graph")], "qid string, paper_id string, body string")
    m = {(r["paper_id"], r["constraint"]): r["matched"] for r in intent.constraint_matches(cons, cand, "body").collect()}
    assert m == {("p1", "graph search"): True, ("p1", "dense-vector"): False, ("p1", "abc"): False, ("p2", "graph search"): False, ("p2", "dense-vector"): False, ("p2", "abc"): True}
    r = spark.range(1).select(intent.time_range(F.lit("papers since 2015")).alias("a"), intent.time_range(F.lit("2012 to 2019")).alias("b"), intent.time_range(F.lit("none")).alias("c")).first()
    assert (tuple(r["a"]), tuple(r["b"]), r["c"]) == ((2015, None), (2012, 2019), None)


def _cells(rows, *names):
    return [tuple(r[n] for n in names) for r in rows]


def test_lanes_against_a_plain_version(spark):
    import random

    from litgrid.operators import features, select

    rng, rows = random.Random(4), []
    for qid, profile in enumerate(("real_multi_answer", "auto_locator", "dataset_or_benchmark", "method_or_dataset")):
        for k in range(90 if qid < 3 else 15):
            words = rng.sample(["a", "b", "c", "d", "e"], rng.randint(0, 3))
            rows.append((qid, k, profile, k + 1, round(rng.random(), 3), words, rng.random() < 0.2, *(rng.random() < 0.3 for _ in features.LANES)))
    names = ["qid", "paper_id", "profile", "rank", "preselect", "words", "sure", *features.LANES]
    kinds = "qid long, paper_id long, profile string, rank int, preselect double, words array<string>, sure boolean, " + ", ".join(f"{x} boolean" for x in features.LANES)
    found = select.lanes(spark.createDataFrame(rows, kinds), target=40).collect()
    for qid in range(4):
        pool = [dict(zip(names, r, strict=True)) for r in rows if r[0] == qid]
        got = _cells(sorted((r for r in found if r["qid"] == qid), key=lambda r: r["place"]), "paper_id", "reason")
        n = min(40, len(pool))
        if len(pool) <= n:
            assert got == [(r["paper_id"], "pool<=target") for r in pool]
            continue
        quota, chosen = features.quotas(pool[0]["profile"], n), []
        have = lambda r: any(r is x for x, _ in chosen)  # noqa: B023, E731
        chosen += [(r, "protected_rule_head") for r in pool[: quota["head"]]]
        best = sorted(pool, key=lambda r: (-r["preselect"], r["rank"]))
        for lane, name in features.LANES.items():
            added = 0
            for r in best:
                if len(chosen) < n and added < quota[name] and r[lane] and not have(r):
                    chosen.append((r, lane))
                    added += 1
        deferred = []
        for r in best:
            if len(chosen) < n and not have(r):
                like = max((len(set(r["words"]) & set(y["words"])) / len(set(r["words"]) | set(y["words"])) for y, _ in chosen[:30] if r["words"] and y["words"]), default=0)
                if like >= 0.92 and not r["sure"]:
                    deferred.append(r)
                else:
                    chosen.append((r, "score_fill"))
        chosen += [(r, "redundant_score_fill") for r in deferred[: n - len(chosen)]]
        assert got == [(r["paper_id"], why) for r, why in chosen]


def test_diversification_against_a_plain_version(spark):
    import random

    from litgrid.operators import select

    rng, rows = random.Random(7), []
    for qid, size in ((1, 60), (2, 12), (3, 13)):
        for k in range(size):
            rows.append((qid, k, k + 1, round(1 - k / 100 + rng.random() / 50, 4), 3, 0.1 if qid == 1 else 0.02, rng.choice([1.0, 0.55]), [x for x in "xyz" if rng.random() < 0.3], rng.sample("abcdef", rng.randint(0, 4))))
    df = spark.createDataFrame(rows, "qid long, paper_id long, rank int, score double, protected int, penalty double, soften double, matched array<string>, words array<string>")
    found = select.diversified(df, top_k=20).collect()
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    for qid in (1, 2, 3):
        pool = [r for r in rows if r[0] == qid]
        want = pool if len(pool) <= 12 else pool[:3]
        rest = [r for r in pool if r not in want]
        while rest and len(want) < 20:
            value = lambda r: round(r[3] + 0.025 * len(set(r[7]) - {m for w in want for m in w[7]}) - r[5] * r[6] * max((like(r[8], w[8]) for w in want), default=0), 9)  # noqa: B023, E731
            best = max(rest, key=lambda r: (value(r), -r[2]))
            want.append(best)
            rest.remove(best)
        assert [r["paper_id"] for r in sorted((r for r in found if r["qid"] == qid), key=lambda r: r["place"])] == [r[1] for r in want + rest]
    assert [r["paper_id"] for r in select.diversified(df.where("qid = 1"), top_k=10).orderBy("place").collect()] == list(range(60))


def test_quotas_and_hash_sample(spark):
    from pyspark.sql import functions as F

    from litgrid.operators import evaluate

    sizes = spark.createDataFrame([("a", 1000), ("b", 3), ("c", 2), ("d", 1)], "g string, n long")
    for total in (4, 10, 500, 5000):
        quota = {r["g"]: r["quota"] for r in evaluate.proportional_quotas(sizes, ["g"], total).collect()}
        assert sum(quota.values()) == min(total, 1006) and min(quota.values()) >= 1
    rows = spark.range(3000).withColumn("h", F.sha1(F.col("id").cast("string")))
    want = {r["id"] for r in rows.orderBy("h").limit(777).collect()}
    assert {r["id"] for r in evaluate.hash_sample(rows, F.col("h"), [F.asc("id")], 777).collect()} == want
    assert evaluate.hash_sample(rows, F.col("h"), [F.asc("id")], 9000).count() == 3000


def test_crc_slots_and_shards(spark, sf_dir):
    import zlib

    from litgrid.plans import catalogue

    for r in catalogue.QUERIES["a15_shards"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey").collect():
        assert r["shard"] == zlib.crc32(f"{r['o_orderstatus']}/{r['o_orderpriority']}/{r['o_orderkey']}".encode()) % 8


def test_stream_upserts_survive_a_repeated_batch(spark, tmp_path):
    from litgrid.streaming import streams

    path = f"file://{tmp_path}/log"
    schema = "k long, at long, v string"
    spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 1, "c")], schema).write.parquet(f"{path}/batch=0")
    for _ in range(2):
        spark.createDataFrame([(1, 2, "old"), (3, 1, "d")], schema).write.mode("overwrite").parquet(f"{path}/batch=1")
    found = streams.upserted(spark, path, ["k"], "at")
    assert sorted(map(tuple, found.select("k", "v").collect())) == [(1, "b"), (2, "c"), (3, "d")]
    streams.compacted(spark, path, ["k"], "at", f"file://{tmp_path}/new")
    assert streams.upserted(spark, f"file://{tmp_path}/new", ["k"], "at").count() == 3


def test_dense_blocks(spark):
    import numpy as np

    from litgrid.operators import index

    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(120, [0.0] * 8), (121, None)], "doc_id long, vector array<double>")
    queries = docs.where("doc_id < 10").withColumnRenamed("doc_id", "qid")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (3, 100):
        found = {(r["qid"], r["rank"]): r["doc_id"] for r in index.dense_top_k(queries, docs, 5, block).collect()}
        for q in range(10):
            assert [found[q, k] for k in range(1, 6)] == np.argsort(-unit @ unit[q])[:5].tolist()


def test_words_end_at_accents_as_in_sql(spark):
    """Java takes é for part of a word, DuckDB does not; nor does a dot of the SQL stop at other separators of lines."""
    topic = r"\b(tion|ment|der|language)\b"
    texts = ["élément", "moments", "fix code", "fix\ncode", "wordé"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    word = rows.select(*(F.rlike("t", T.ascii_words(p)) for p in (topic, r"\b(fix)\b.+\b(code)\b", r"\bword\b"))).collect()
    con = duckdb.connect()
    assert [tuple(r) for r in word] == [con.execute("SELECT regexp_matches(?, ?), regexp_matches(?, ?), regexp_matches(?, ?)", [t, topic, t, r"\b(fix)\b.+\b(code)\b", t, r"\bword\b"]).fetchone() for t in texts]
    assert word[0][0] and word[2][1] and word[4][2]


def test_merged_head_keeps_narrow_rows(spark, sf_dir, monkeypatch):
    """What k15 writes are six columns of 120 rows a query, and intents of many queries are not broadcast."""
    from litgrid.plans import ranking_queries

    kept = []
    monkeypatch.setattr(ranking_queries, "stored", lambda df: kept.append(df) or df)
    few = ranking_queries.k15(spark, sf_dir).collect()
    assert kept[0].columns == ["qid", "paper_id", "rank", "score", "strong_alias", "n_sources"]
    monkeypatch.setattr(ranking_queries, "FEW_QUERIES", 0)
    assert sorted(few) == sorted(ranking_queries.k15(spark, sf_dir).collect())
    assert "must_info" not in "".join(x for x in kept[1]._jdf.queryExecution().optimizedPlan().toString().split("\n") if "broadcast" in x)


def test_alias_search_counts_papers_of_a_concept(spark, monkeypatch):
    """Papers of a concept are met as a number: a row for each query and term, and not one for each paper."""
    from litgrid.operators import graph

    known = [(f"p{i}", "a", "k", "MENTIONS", 0.5) for i in range(30)] + [("p0", "b", "k", "MENTIONS", 0.25), ("x", "b", "k", "MENTIONS", 0.75)]
    met, join = [], graph._by_concept
    monkeypatch.setattr(graph, "_by_concept", lambda rows, asked, key: met.append(asked.count()) or join(rows, asked, key))
    schema = "paper_id string, alias string, concept_id string, relation string, confidence double"
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "qid int, term string")
    found = graph.alias_search(asked, spark.createDataFrame(known, schema), spark.createDataFrame([], "paper_id string, phrase string, confidence double"), {"MENTIONS": 2.0}, 100).collect()
    total = {}
    for q, term in ((1, "a"), (2, "b")):
        own = {p for p, a, *_ in known if a == term}
        for p, a, _, _, sure in known:
            total[q, p] = total.get((q, p), 0) + (2 * sure if a == term else 0) + 0.5 * sure * len(own - {p})
    assert {(r["qid"], r["paper_id"]): round(r["score"], 6) for r in found} == {k: round(v, 6) for k, v in total.items()}
    assert met == [2]


def test_bm25_scores_in_tasks(spark, monkeypatch):
    """As the plain way by joins, in one block or several, whole or in halves; no pair of query and document is shuffled."""
    import random

    from litgrid.operators import index

    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(300)], "id int, text string")
    rows = index.token_rows(docs, "id", F.col("text"))
    terms = spark.createDataFrame([(f"q{q}", w, 1.0 + q % 3) for q in range(9) for w in r.sample([*words, "none"], 5)], "qid string, token string, weight double")
    plain = rank.top_k(index.bm25_scores(terms, rows).drop("matched"), ["qid"], [F.desc(F.round("score", 9)), F.asc("doc_id")], 7)
    expected = {(x["qid"], x["rank"]): (x["doc_id"], round(x["score"], 6)) for x in plain.collect()}
    for block, pairs in ((2048, 2_000_000), (4, 50)):
        monkeypatch.setattr(index, "PAIRS", pairs)
        found = index.bm25(terms, rows, 7, block=block)
        assert {(x["qid"], x["rank"]): (x["doc_id"], round(x["score"], 6)) for x in found.collect()} == expected
    assert "MapInPandas" in found._jdf.queryExecution().executedPlan().toString()
    assert index.bm25(terms.where("false"), rows, 7).count() == index.bm25(terms, rows.where("false"), 7).count() == 0


def test_best_chunk_of_a_paper(spark):
    """Chunks under one paper's id count by the best of them, wherever they lie; in halves the same scores come out."""
    import pandas as pd

    from litgrid.operators import index

    chunks = [(i % 7, f"w{i % 3} w{i % 5} x{i % 11}") for i in range(60)]
    rows = index.token_rows(spark.createDataFrame(chunks, "id int, text string").repartition(5), "id", F.col("text"))
    terms = spark.createDataFrame([("q", "w1", 1.0), ("q", "x3", 1.0), ("r", "w2", 1.0)], "qid string, token string, weight double")
    each = rows.withColumn("doc_id", F.concat_ws("#", "doc_id", F.monotonically_increasing_id())).localCheckpoint()
    plain = index.bm25_scores(terms, each).groupBy("qid", F.substring_index("doc_id", "#", 1).cast("int").alias("doc_id")).agg(F.max("score").alias("score"))
    found = {(x["qid"], x["doc_id"]): round(x["score"], 9) for x in index.bm25(terms, rows, 10).collect()}
    assert found == {(x["qid"], x["doc_id"]): round(x["score"], 9) for x in plain.collect()}

    import numpy as np

    docs = pd.DataFrame({"doc_id": range(50), "tokens": [["a", "b"][: i % 3] for i in range(50)], "length": [i % 3 for i in range(50)]})
    args = (2, {"a": 0, "b": 1}, (np.array([0, 1, 1]), np.array([1.0, 2.0, 3.0]), np.array([0, 2, 3])), 50, lambda x, doc, tf: tf * 1.0)
    whole = index._best(docs, *args)
    index.PAIRS, most = 10, index.PAIRS
    halves = index._best(docs, *args)
    index.PAIRS = most
    assert sorted(whole.itertuples(index=False)) == sorted(halves.itertuples(index=False))


def test_constants_are_added_before_ranking_in_tasks(spark):
    from litgrid.operators import index

    docs = spark.createDataFrame([("a", ["x", "y"], 0.0), ("b", ["x", "z"], 0.35), ("c", ["x", "x"], 0.0), ("d", ["z"], 9.0)], "doc_id string, tokens array<string>, plus double").withColumn("length", F.size("tokens"))
    terms = spark.createDataFrame([("q", "x", 1.0)], "qid string, token string, weight double")
    plain = {r["doc_id"]: r["score"] for r in index.bm25_scores(terms, docs).collect()}
    found = index.bm25(terms, docs, 2, digits=6).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == ["b", "c"] and abs(found[0]["score"] - plain["b"] - 0.35) < 1e-9


def test_cosine_in_tasks_is_that_of_postings(spark):
    from litgrid.operators import index

    texts = [(f"d{k}", [f"w{k % 3}", f"w{k % 5}", "all", f"own{k}", f"w{k % 3}"]) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id string, tokens array<string>").withColumn("length", F.size("tokens"))
    terms = spark.createDataFrame([("p", "w1", 1.0), ("p", "own7", 1.0), ("q", "w4", 1.0), ("q", "nowhere", 1.0)], "qid string, token string, weight double")
    post = docs.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    rows = lambda x: sorted((r["qid"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in x.collect())
    plain = rows(index.tfidf_cosine(terms, post, 40, 6))
    assert rows(index.tfidf_top_k(terms, docs, 6)) == plain
    assert [x[:3] for x in rows(index.tfidf_top_k(terms, docs, 6, in_memory=2))] == [x[:3] for x in plain]


def test_gold_by_lookup_is_gold_by_join(spark, sf_dir, tmp_path, monkeypatch):
    words = "one two three four five six seven eight nine ten"
    text = [(1, f"Zero. {words}"), (2, "one two three four five six seven none"), (None, words), (3, None), (4, f"{words}. {words}")]
    spark.createDataFrame(text, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, words), (6, "too short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted(map(tuple, fixtures.gold(spark, str(tmp_path)).collect()), key=repr)
    monkeypatch.setattr(fixtures, "ASKED", 0)
    assert found == sorted(map(tuple, fixtures.gold(spark, str(tmp_path)).collect()), key=repr)
    assert ("q5", None) in found and ("q5", "doc:4") in found and len(found) == 3


def test_document_features_in_tasks_are_those_by_id(spark, sf_dir, tmp_path):
    from litgrid.plans import evaluation_queries as E

    texts = [t for (t,) in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("text").limit(30).collect()]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, "In the text: model-based retrieval, model-based retrieval"])] + [(3, texts[5]), (None, texts[6]), (None, texts[7])], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = E._features_by_id(spark, docs.select("doc_id", T.normalize_title(F.col("text")).alias("norm")))
    rows = lambda x: sorted(((r["doc_id"], r["feature"], round(r["value"], 6)) for r in x.collect()), key=repr)
    assert rows(E.q18(spark, str(tmp_path))) == rows(plain)


def test_document_features_need_no_shuffle_of_phrases(spark, sf_dir):
    from litgrid.plans import evaluation_queries as E

    # before, every phrase of every document was a row to be shuffled and ranked
    plan = E.q18(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInPandas" in plan


def test_hits_are_parted_by_their_number(spark, sf_dir, monkeypatch):
    """A task's rows are bounded, whatever the input; before, the session's number of partitions decided."""
    from litgrid.plans import search_queries
    from litgrid.sources import tables

    plain = {tuple(r) for r in search_queries.ranked(spark, sf_dir).collect()}
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    found = search_queries.ranked(spark, sf_dir)
    assert found.rdd.getNumPartitions() == -(-n // 100)
    assert {tuple(r) for r in found.collect()} == plain


def test_diversified_against_plain_loops(spark):
    """Likeness is counted for all pairs at once, new constraints from an incidence; rows as one by one with Python's sets."""
    import random

    import pandas as pd

    from litgrid.operators import select

    rng = random.Random(5)
    rows = [(q, 100 + k * 7 % 41, k + 1, round(1 - k / 50 + rng.choice((0, 0.025, 0.05)), 6), 3, 0.1, rng.choice((0.25, 0.55, 1.0)), rng.sample("abcd", rng.randint(0, 2)), [rng.choice("pqrstuv") for _ in range(rng.randint(0, 6))]) for q in range(6) for k in range(41 if q else 12)]
    df = spark.createDataFrame(rows, "qid long, paper_id long, rank int, score double, protected int, penalty double, soften double, matched array<string>, words array<string>")
    expected = set()
    for q in range(6):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: r[2])
        stay = len(own) if len(own) <= 12 else 3
        chosen, rest = own[:stay], own[stay:]
        jaccard = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        while rest and len(chosen) < 30:
            seen = {t for r in chosen for t in r[7]}
            best = max(rest, key=lambda r: (round(r[3] + 0.025 * len(set(r[7]) - seen) - r[5] * r[6] * max(jaccard(set(r[8]), set(y[8])) for y in chosen), 9), -r[2]))
            rest.remove(best)
            chosen.append(best)
        expected |= {(q, r[1], k + 1) for k, r in enumerate(chosen + rest)}
    assert {tuple(r) for r in select.diversified(df, top_k=30).collect()} == expected
    like = select._likeness(select._incidence(pd.Series([["a", "b"], ["b", "b", "c"], []])))
    assert like[0, 1] == 1 / 3 and like[0, 0] == 1 and not like[2].any()
