"""Operators with an algorithm of their own, against plain versions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgrid.operators import components, dictionary, impacts, index, phrases, vectors
from litgrid.sources import paging


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('checkpoints')}")


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in list(up)}


def labels(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({n for n, _ in rows})
    return dict(rows)


def test_components_of_a_star_and_a_chain(spark):
    random.seed(1)
    star = [(7_000_000, k) for k in range(100_000)]
    chain = [(10_000_000 + (k * 791) % 3001, 10_000_000 + ((k + 1) * 791) % 3001) for k in range(3000)]
    loose = [(20_000_000 + random.randrange(3000), 20_000_000 + random.randrange(3000)) for _ in range(1800)]
    edges = star + chain + loose + star[:50]
    found = labels(components.connected(spark.createDataFrame(edges, "a long, b long")))
    assert found == {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}


def test_components_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert labels(components.connected(none)) == {}
    odd = spark.createDataFrame([(1, 1), (2, None), (4, 3), (3, 4), (4, 3), (5, 4)], "a long, b long")
    assert labels(components.connected(odd)) == {3: 3, 4: 3, 5: 3}


def test_a_busy_node_is_spread(spark):
    """No task gets the rows of a key that holds most of them."""
    rows = spark.createDataFrame([(0 if k % 10 else k, k) for k in range(40_000)], "u long, v long").repartition(8)
    other = spark.range(40_000).select(F.col("id").alias("u"), (F.col("id") * 2).alias("m"))
    joined = components.spread_join(rows, other, "u")
    sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 10_000
    assert joined.where("m <> 2 * u").isEmpty()


# ---- lexicon


def test_dictionary_of_many_phrases(spark):
    random.seed(2)
    words = [f"{random.choice('abcdefgh')}{random.choice('aeiou')}{random.choice('lmnrst')}{random.choice(['', 'x', 'ing'])}" for _ in range(400)]
    lexicon = list({" ".join(random.choice(words) for _ in range(random.randint(1, 4))) for _ in range(100_000)} | {"an", "de la", "x", ""})
    texts = [(k, " ".join(random.choice(words + ["an", "de", "la", "man", "-"]) for _ in range(random.randint(0, 30)))) for k in range(60)] + [(60, None), (61, "")]
    df, table = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in lexicon], "phrase string")
    by = {}
    for p in lexicon:
        by.setdefault(p[:1], []).append(p)
    for whole in (True, False):
        pad = " " if whole else ""
        want = {(i, p) for i, t in texts if t for p in lexicon if p and f"{pad}{p}{pad}" in (f" {t} " if whole else t)}
        found = [tuple(r) for r in dictionary.occurrences(df, "id", "text", table, whole_words=whole).collect()]
        assert set(found) == want and len(found) == len(want)
    assert any(len(p.split()) > 1 for _, p in want) and any(p == "an" for _, p in want)


def test_dictionary_in_parts_and_in_order(spark, monkeypatch):
    df = spark.createDataFrame([(1, "the cot-prompting of the art"), (2, "cots and arts"), (2, "art")], "id long, text string")
    given = ["art", "of the", "the", "cot", "cot", "", "ots"]
    table = spark.createDataFrame([(p,) for p in given], "phrase string")
    whole = {tuple(r) for r in dictionary.occurrences(df, "id", "text", table).collect()}
    assert whole == {(1, "art"), (1, "of the"), (1, "the"), (1, "cot"), (2, "art")}
    monkeypatch.setattr(dictionary, "PHRASES", 2)
    assert {tuple(r) for r in dictionary.occurrences(df, "id", "text", table).collect()} == whole
    with pytest.raises(ValueError):
        dictionary.Dictionary(spark, given)
    monkeypatch.undo()
    found = df.select("id", dictionary.Dictionary(spark, given).found(F.col("text")).alias("f")).where("id = 1").first()["f"]
    assert found == ["art", "of the", "the", "cot"]


# ---- phrases


def frequency(words, phrase, slop):
    """Ends of in-order matches with at most one word between, a match with a gap counting half."""
    states = {(i, 0) for i, w in enumerate(words) if w == phrase[0]}
    for p in phrase[1:]:
        states = {(j, g + j - i - 1) for i, g in states for j in range(i + 1, min(len(words), i + 2 + slop - g)) if words[j] == p}
    return sum(1 / (1 + g) for _, g in states)


def test_phrases_of_any_length(spark):
    random.seed(3)
    docs = [(k, " ".join(random.choice("abcd") for _ in range(random.randint(0, 25))), " ".join(random.choice("abcd") for _ in range(random.randint(0, 40)))) for k in range(150)] + [(150, None, ""), (151, "A, b! Ç", "a b")]
    asked = [["a"], ["a", "b"], ["a", "a"], ["b", "a", "b"], ["d", "c", "b", "a"], ["a", "b", "c", "d", "a", "b"], ["never", "a"], ["c"] * 4, []]
    clauses = spark.createDataFrame([(f"q{i}", f, p, s, 2.0) for i, p in enumerate(asked) for f, s in (("title", 0), ("body", 1))], "qid string, field string, phrase array<string>, slop int, boost double")
    df = spark.createDataFrame(docs, "id long, t string, x string")
    rows = phrases.field_rows(df, "id", {"title": F.col("t"), "body": F.col("x")})
    found = {(r["qid"], r["doc_id"], r["field"]): r["frequency"] for r in phrases.clause_scores(clauses, rows).collect()}
    texts = {(r["doc_id"], r["field"]): r["words"] for r in rows.collect()}
    assert texts[151, "title"] == ["a", "b", "c"] and texts[150, "body"] == texts[150, "title"] == []
    want = {(f"q{i}", d, f): n for (d, f), w in texts.items() for i, p in enumerate(asked) if p and (n := frequency(w, p, 0 if f == "title" else 1))}
    assert found == want and {n % 1 for n in want.values()} == {0, 0.5}


# ---- sparse and dense top k


def test_block_max_top_k(spark):
    """The rows of scoring everything, without joining the lists of frequent features."""
    random.seed(4)
    weight = {f: 40.0 / (f + 1) if f % 2 else 0.05 for f in range(60)}  # even features stand in most documents and weigh little
    docs = [(d, f, weight[f] * random.choice((1, 1.5, 2, 3))) for d in range(3000) for f in range(60) if random.random() < (0.7 if f % 2 == 0 else 0.02)]
    docs += [(5000 + k, 1, 120.0) for k in range(40)] + [(1, 70, -1.0), (2, 70, 0.0)]
    asked = [(q, f, random.choice((1.0, 2.0))) for q in range(12) for f in random.sample(range(60), 8)] + [(99, 1, 1.0), (98, 70, 1.0), (97, 3, -1.0)]
    vectors_, rows = {}, {}
    for d, f, v in docs:
        vectors_.setdefault(d, {})[f] = v
    for q, f, v in asked:
        rows.setdefault(q, {})[f] = v
    want = set()
    for q, own in rows.items():
        scores = {d: sum(w * x[f] for f, w in own.items() if w > 0 and x.get(f, 0) > 0) for d, x in vectors_.items()}
        want |= {(q, d, round(s, 6)) for d, s in sorted(((d, s) for d, s in scores.items() if s > 0), key=lambda x: (-round(x[1], 9), x[0]))[:10]}
    hits, report = impacts.block_max_top_k(spark.createDataFrame(asked, "qid long, feature long, value double"), spark.createDataFrame(docs, "doc_id long, feature long, value double"), 10)
    assert {(r["qid"], r["doc_id"], round(r["score"], 6)) for r in hits.collect()} == want
    total = report.agg({"postings": "sum", "read": "sum"}).first()
    assert total["sum(read)"] < 0.2 * total["sum(postings)"]


def test_inverted_lists(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    v = v.unionByName(spark.createDataFrame([(-1, None), (-2, [])], v.schema))
    queries = v.where("doc_id % 50 = 0 and doc_id >= 0").withColumnRenamed("doc_id", "qid")
    exact = {tuple(r) for r in index.dense_top_k(queries, v.where("doc_id >= 0"), 10).select("qid", "doc_id").collect()}
    center = vectors.centroids(v)
    from litgrid.sources.tables import fresh_path

    path = fresh_path(spark, "lists")
    vectors.write_index(v, center, path)
    assert spark.read.parquet(path).count() == v.where("doc_id >= 0").count()
    probes = vectors.probes_for(v, center, 10)
    assert probes < len(center)
    found = {tuple(r) for r in vectors.search(spark, path, center, queries, 10, probes).select("qid", "doc_id").collect()}
    assert len(found & exact) >= 0.9 * len(exact) and len(found) == len(exact)
    assert {tuple(r) for r in vectors.search(spark, path, center, queries, 10, len(center), block=7).select("qid", "doc_id").collect()} == exact
    one = queries.limit(1)
    near = np.argsort(-(index._units([one.first()["vector"]]) @ center.T)[0])[:probes].tolist()
    assert spark.read.parquet(path).where(F.col("list").isin(near)).count() < 0.9 * spark.read.parquet(path).count()
    assert vectors.search(spark, path, center, queries.limit(0), 10, probes).count() == 0


def test_inverted_lists_of_clustered_vectors(spark):
    """Where vectors have neighbourhoods, few lists hold nearly all neighbours."""
    rng = np.random.default_rng(5)
    means = rng.normal(size=(40, 16)) * 4
    rows = [(k, (means[k % 40] + rng.normal(size=16)).tolist()) for k in range(4000)]
    v = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    center = vectors.centroids(v)
    probes = vectors.probes_for(v, center, 10)
    assert probes < len(center) / 6
    from litgrid.sources.tables import fresh_path

    path = fresh_path(spark, "lists")
    vectors.write_index(v, center, path)
    queries = v.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "qid")
    exact, found = ({(r["qid"], r["doc_id"]) for r in df.collect()} for df in (index.dense_top_k(queries, v, 10), vectors.search(spark, path, center, queries, 10, probes)))
    assert len(found & exact) >= 0.9 * len(exact)


# ---- paged scans


def test_paged_scan_goes_on(spark):
    from litgrid.sources.tables import fresh_path

    path, rows = fresh_path(spark, "scan"), spark.createDataFrame([(None if k % 9 == 0 else (k * 37) % 1000, k) for k in range(3000)], "key long, v long")
    scan = lambda: paging.PagedScan(spark, rows, "key", path, 6, lower=10, upper=900, shard=F.col("v") % 2 == 0)
    first = scan()
    borders = first.cursor["borders"]
    assert first.pages == 6 and first.run(2) == 2 and first.result().where("page > 1").isEmpty()
    rows_before = first.result().count()
    with pytest.raises(Exception, match="broken"):  # a page breaks off; what it wrote is not read and is written again
        scan().run(each=lambda page: page.select("key", F.raise_error(F.lit("broken")).cast("long").alias("v")))
    again = scan()
    assert again.cursor == {"borders": borders, "done": 2} and again.run() == 4 and scan().run() == 0
    found = [(r["key"], r["v"]) for r in again.result().collect()]
    want = [((k * 37) % 1000, k) for k in range(3000) if k % 9 and 10 < (k * 37) % 1000 <= 900 and k % 2 == 0]
    assert sorted(found) == sorted(want) and rows_before < len(want)
    plan = again.page(3)._jdf.queryExecution().toString()
    assert str(borders[2]) in plan and str(borders[3]) in plan
    sizes = [r["count"] for r in again.result().groupBy("page").count().collect()]
    assert max(sizes) < 2 * min(sizes)


def test_paged_scan_of_nothing(spark):
    from litgrid.sources.tables import fresh_path

    scan = paging.PagedScan(spark, spark.createDataFrame([], "key long"), "key", fresh_path(spark, "scan"), 4)
    assert scan.run() == scan.pages and scan.result().count() == 0


# ---- archives


def test_archives_in_ranges(spark, tmp_path):
    import zipfile

    from litgrid.sources import archives

    texts = {f"{k:03d}.json": f'{{"k": {k}, "t": "{"é" * k}{random.random()}"}}' for k in range(60)}
    for a in range(3):
        (tmp_path / f"sub{a}").mkdir()
        with zipfile.ZipFile(tmp_path / f"sub{a}" / f"a{a}.zip", "w", zipfile.ZIP_DEFLATED if a else zipfile.ZIP_STORED) as z:
            z.mkdir("folder")
            for k, (name, text) in enumerate(texts.items()):
                if k % 3 == a:
                    z.writestr(name, text)
            z.writestr(f"note{a}.txt", "a note")
    (tmp_path / "none.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    raw = (tmp_path / "sub0" / "a0.zip").read_bytes()
    at = raw.index(texts["030.json"].encode())
    (tmp_path / "sub0" / "a0.zip").write_bytes(raw[:at] + b"XX" + raw[at + 2 :])  # one member's sum is wrong

    df = archives.members(spark, f"file://{tmp_path}", 300)
    rows = {(r["archive"], r["member"]): r for r in df.collect()}
    assert rows["none.zip", None]["error"].startswith("archive:") and rows["a0.zip", "030.json"]["content"] is None and rows["a0.zip", "030.json"]["error"].startswith("member:")
    good = {m: r["content"] for (_, m), r in rows.items() if m and m.endswith(".json") and r["error"] is None}
    assert good == {k: v for k, v in texts.items() if k != "030.json"} and sum(m is not None and m.startswith("note") for _, m in rows) == 3
    assert df.rdd.getNumPartitions() > 6
    reader = archives.ArchiveReader({"path": str(tmp_path), "range": "300"})
    left = list(reader.pushFilters([archives.StringEndsWith(("member",), ".txt"), archives.EqualTo(("archive",), "a1.zip")]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and sorted(n for p in reader.partitions() for n in p.names) == ["note0.txt", "note1.txt", "note2.txt"]
    assert sorted(r["member"] for r in df.where("member like '%.txt' and archive = 'a1.zip'").collect()) == ["note1.txt"]
    assert archives.members(spark, f"{tmp_path}/nothing").count() == 0


# ---- point tables and streams


def test_point_table_rewrites_touched_buckets(spark, tmp_path):
    import glob

    from litgrid.sources.points import PointTable

    rows = lambda ids, tag: spark.createDataFrame([(f"p{i}", [float(i)], tag, k) for k, i in enumerate(ids)], "point_id string, vector array<double>, venue string, at long")
    table = PointTable(spark, f"file://{tmp_path}/points", 16)
    table.write(rows(range(400), "old").unionByName(spark.createDataFrame([(None, None, "none", 1)], "point_id string, vector array<double>, venue string, at long")))
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/points/bucket=*/*.parquet")}
    new = rows([3, 3, 7, 9000], "new")
    counts = {r["bucket"]: (r["before"], r["after"]) for r in table.upsert(new, "at").collect()}
    found = {r["point_id"]: (r["venue"], r["at"], r["vector"]) for r in table.read().collect()}
    assert len(found) == table.read().count() == 401 and found["p3"] == ("new", 1, [3.0]) and found["p9000"][0] == "new" and found["p8"][0] == "old"
    kept = {f for f in glob.glob(f"{tmp_path}/points/bucket=*/*.parquet") if f in files}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files if f not in kept} <= set(counts) and len(counts) <= 3 and len(kept) >= 13
    assert sum(after - before for before, after in counts.values()) == 1
    assert table.upsert(new.limit(0)).count() == 0 and table.read().count() == 401


def test_late_rows_and_compaction(spark, tmp_path):
    import datetime

    from litgrid.streaming.streams import LastRows

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    batches = [[("a", 1, day(10)), ("b", 2, day(1)), ("a", 0, day(2))], [("a", 5, day(9)), ("c", 6, day(8)), ("b", 7, day(1))], [("c", 3, day(12)), ("d", 4, None)], [("d", 9, day(11)), ("a", 8, day(9))], [("e", 10, day(13))]]
    keeper = LastRows(spark, f"file://{tmp_path}/t", ["k"], "n", "ts", "2 days", compact=2)
    for b in batches:
        spark.createDataFrame(b, "k string, n long, ts timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        keeper.run(spark.readStream.schema("k string, n long, ts timestamp").parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/state")
    assert sorted((r["k"], r["n"]) for r in keeper.rows().collect()) == [("a", 5), ("b", 2), ("c", 6), ("d", 9), ("e", 10)]
    assert sorted((r["k"], r["n"], r["batch"]) for r in keeper.late().collect()) == [("a", 8, 3), ("b", 7, 1)]
    assert keeper._numbers("snapshots", "upto") == [1, 3]
    keeper._batch(spark.createDataFrame(batches[4], "k string, n long, ts timestamp"), 4)  # a repeated batch changes nothing
    assert keeper.rows().count() == 5 and keeper.late().count() == 2


# ---- graph


def test_a_concept_of_very_many_papers(spark):
    """Rows as by plain joins, and no task with most of the busy concept's papers."""
    from litgrid.operators import graph

    random.seed(9)
    mentions = [(p, "busy") for p in range(30_000)] + [(p, f"c{random.randrange(3000)}") for p in range(6000)]
    seeds = [(q, random.randrange(6000)) for q in range(6) for _ in range(3)]
    df = spark.createDataFrame(sorted(set(mentions)), "paper_id long, concept string").repartition(8)
    near = graph.sharing(spark.createDataFrame(seeds, "qid long, paper_id long"), df)
    of = {}
    for p, x in set(mentions):
        of.setdefault(p, set()).add(x)
    found = {(r["qid"], r["target"]): r["support"] for r in near.collect()}
    for q in range(6):
        own = {p for i, p in seeds if i == q}
        for target in random.sample(range(30_000), 300):
            if target not in own:
                assert found[q, target] == sum(len(of[target] & of[p]) for p in own)
    met = graph._by_concept(df, spark.createDataFrame([("busy", 1), ("busy", 2), ("c1", 1)], "concept string, qid long"), "concept")
    sizes = [r["n"] for r in met.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) >= 60_000 and max(sizes) < 15_000
    weights = df.withColumn("confidence", F.lit(0.9))
    top = graph.concept_search(spark.createDataFrame([(1, "busy"), (1, "c1"), (2, "c2")], "qid long, concept string"), weights, 0.5, 5).collect()
    assert {r["qid"] for r in top} == {1, 2} and len(top) == 10 - max(0, 5 - sum(x == "c2" for _, x in set(mentions)))


def test_saved_chats(spark):
    from litgrid.operators import training

    ask = lambda title, abstract, query: f"Judge.\nTitle: {title}\nAbstract: {abstract}\n\nUser Query: {query}\n\nOutput format: x"
    rows = [(1, ask("A title", "some  text\nin lines " * 9, "what"), "decision: TRUE\nas it fits"), (2, ask("T", "", "q"), " False."), (3, ask("T", "a", "q"), "It is true"), (4, ask("", "a", "q"), "True"), (5, ask("T", "a", ""), "True"), (6, None, "True"), (7, ask("T", "a", "q"), None), (8, ask("T", "a", "q"), "Trueish")]
    found = {r["id"]: (r["query"], r["title"], r["document"], r["label"]) for r in training.parsed_chats(spark.createDataFrame(rows, "id long, user string, assistant string"), 40).collect()}
    assert found == {1: ("what", "A title", "Title: A title\nAbstract: some text in lines some text in lines...", 1), 2: ("q", "T", "Title: T", 0)}


# ---- rounds


def test_rounds_against_a_plain_loop(spark):
    """Ten queries: what is asked, met and merged in each round, and where each query stops."""
    from litgrid.operators import rounds

    random.seed(11)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs = {f"p{k}": set(random.sample(words, random.randint(1, 2))) for k in range(30)}
    entity = {p: f"p{int(p[1:]) // 2 * 2}" for p in docs}  # two papers each are one
    texts = {f"p{k}": docs[f"p{k}"] for k in range(0, 30, 2)}
    musts = {q: random.sample(words + ["missing one", "absent"], random.randint(0, 3)) for q in range(10)}
    intents = spark.createDataFrame([(q, random.choice(words), m, ["field"], ["soft"], [f"sub {q}"]) for q, m in musts.items()], "qid long, clean string, must_have array<string>, fields array<string>, soft array<string>, sub_queries array<string>")
    clean = {r["qid"]: r["clean"] for r in intents.collect()}
    table = spark.createDataFrame([(p, sorted(w)) for p, w in docs.items()], "paper_id string, words array<string>")
    own = spark.createDataFrame([(p, sorted(w)) for p, w in texts.items()], "paper_id string, words array<string>")

    def retrieve(queries):
        score = F.size(F.array_intersect(F.split("query", " "), "words"))
        return queries.join(table, score > 0).select("qid", "action", F.lit("title_bm25").alias("source"), "paper_id", score.cast("double").alias("score"))

    def judge(hits):
        rows = hits.groupBy("qid", "paper_id").agg(F.max("score").alias("score")).join(own, "paper_id").join(intents.select("qid", "must_have"), "qid")
        rows = rows.withColumn("matched", F.array_intersect("must_have", "words")).withColumn("label", F.when(F.size("matched") > 1, "highly_relevant").otherwise("weakly_relevant"))
        from litgrid.operators.rank import top_k

        return top_k(rows, ["qid"], [F.desc("score"), F.asc("paper_id")], 1 << 20)

    rows, hits, state = rounds.search(intents, retrieve, judge, spark.createDataFrame(list(entity.items()), "paper_id string, entity string"))
    want, met = [], {}
    for q, must in musts.items():
        queries, found = [clean[q]], {}
        for n in (1, 2):
            new = [(i, entity[p]) for i, x in enumerate(queries) for p, w in docs.items() if set(x.split(" ")) & w]
            for i, x in enumerate(queries):
                for p, w in docs.items():
                    if s := len(set(x.split(" ")) & w):
                        found[entity[p]] = max(found.get(entity[p], 0), s)
            head = [p for p, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))]
            matched = [set(must) & texts[p] for p in head]
            missing = [m for m in must if not any(m in x for x in matched[:10])]
            high = sum(len(x) > 1 for x in matched)
            one = [" ".join(dict.fromkeys([m, "field", "soft"])) for m in missing[:4]]
            two = [" ".join(dict.fromkeys([a, b, "soft"])) for a, b in zip(missing[:3], missing[1:4], strict=False)]
            queries = list(dict.fromkeys([*one, *two, " ".join(dict.fromkeys([*missing[:3], f"sub {q}"]))]))[:6] if missing else []
            if n == 1 or new:
                want.append((q, n, len(set(new)), "|".join(missing), high, bool(missing and high < 5 and queries)))
            met[q] = set(found)
            if not want[-1][-1] or want[-1][1] != n:
                break
    got = sorted(tuple(r) for r in state.collect())
    assert got == sorted(want) and {n for _, n, *_ in got} == {1, 2}
    assert {(r["qid"], r["paper_id"]) for r in rows.collect()} == {(q, p) for q, ps in met.items() for p in ps}
    assert hits.where("round = 2").select("qid").distinct().count() == sum(n == 2 for _, n, *_ in got)


@pytest.mark.parametrize("in_memory", [200_000, 0])
def test_all_terms_against_plain_loops(spark, in_memory):
    import re

    from litgrid.operators import index

    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices(["ab", "cd", "ef", "gh", "rare" + str(i % 9), "x-y", "É"], k=rng.randint(0, 7))), rng.choice([None, "Ab cd.", "gh"])) for i in range(150)]
    asked = [("common", ["ab", "cd"]), ("rare", ["rare3", "ab"]), ("hyphen", ["x-y", "gh"]), ("twice", ["ab", "ab"]), ("one", ["ab"]), ("many", ["ab"] * 9), ("unknown", ["ab", "nowhere"]), ("none", None), ("blank", ["", "-"]), ("folded", ["e", "ab"])]
    docs = index.word_rows(spark.createDataFrame(texts, "id long, title string, body string").withColumn("words_", F.lit(1)), "id", "title", "body")
    found = {tuple(r) for r in index.all_terms(spark.createDataFrame(asked, "qid string, terms array<string>"), docs, in_memory=in_memory).collect()}
    split = lambda x: set(re.findall("[a-z0-9]+", x.lower().replace("é", "e")))
    words = {q: set().union(*map(split, ts)) for q, ts in asked if ts and 2 <= len(ts) <= 8}
    assert found == {(q, i) for q, ws in words.items() if ws for i, t, b in texts if ws <= split(f"{t} {b or ''}")}
    assert {q for q, _ in found} == {"common", "rare", "hyphen", "twice", "folded"}
    assert index.all_terms(spark.createDataFrame([], "qid string, terms array<string>"), docs, in_memory=in_memory).count() == 0


def test_every_reason_of_a_diagnosis(spark):
    from litgrid.operators import evaluate

    names = ["blocked", "empty", "late", "lost", "ceiling", "missing", "errors", "partial", "fine", "no gold"]
    plans = spark.createDataFrame([(q, 0 if q == "blocked" else 3, ["deep nets", "Graph"] if q == "missing" else []) for q in names], "qid string, planned long, must_have array<string>")
    hits = spark.createDataFrame([(q, f"p{k}") for q in names if q != "empty" for k in range(3)], "qid string, paper_id string")
    met = spark.createDataFrame([("blocked", 1, 0, 0), ("empty", 1, 0, 0), ("late", 1, 0, 1), ("lost", 1, 0, 0), ("ceiling", 30, 5, 9), ("missing", 2, 2, 2), ("errors", 2, 2, 2), ("partial", 5, 1, 1), ("fine", 2, 2, 2)], "qid string, gold_count long, hits long, pool_hits long")
    head = spark.createDataFrame([("missing", "All of Deep-Nets and graphs"), ("missing", None), ("fine", "")], "qid string, body string")
    gaps = evaluate.uncovered(plans, head)
    assert {r["qid"]: r["missing"] for r in gaps.collect()} == {q: int(q == "missing") for q in names}
    assert evaluate.uncovered(plans, head.limit(0)).where("qid = 'missing'").first()["missing"] == 2
    rows = evaluate.plan_outcomes(plans, hits, met, gaps, spark.createDataFrame([("errors",), ("errors",), ("blocked",)], "qid string"))
    reason = evaluate.diagnosis(*map(F.col, ("planned", "returned", "hits", "pool_hits", "gold_count")), 10, F.col("missing"), F.col("errors"))
    assert {r["qid"]: r["r"] for r in rows.select("qid", reason["reason"].alias("r")).collect()} == dict(zip(names, evaluate_reasons(), strict=False))
    assert rows.where("qid = 'errors'").first()["errors"] == 2


def evaluate_reasons():
    from litgrid.operators.evaluate import REASONS

    return [reason for reason, _ in REASONS]


def test_all_terms_makes_words_once(spark):
    """Frequencies and documents' own words come from one pass over the texts; queries of the same words are all found."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for x in batches:
            made.add(len(x))
            yield x

    docs = spark.createDataFrame([(k, ["red", "blue", f"w{k % 3}"]) for k in range(30)], "doc_id long, words array<string>").mapInPandas(count, "doc_id long, words array<string>")
    asked = spark.createDataFrame([("a", ["red", "w1"]), ("b", ["w1", "red"]), ("c", ["red", "none"]), ("d", ["blue", "red"])], "qid string, terms array<string>")
    found = {tuple(r) for r in index.all_terms(asked, docs).collect()}
    assert found == {(q, k) for q in "ab" for k in range(1, 30, 3)} | {("d", k) for k in range(30)}
    assert made.value == 30


# ---- phrases with a hint word


@pytest.mark.parametrize("few", [200_000, 0])
def test_concepts_and_aliases_against_plain_loops(spark, monkeypatch, few):
    """Runs of words around hints, made at the first hint of each, count and rank as all runs that have one; documents of
    one key count together."""
    import re

    from litgrid.operators import graph

    monkeypatch.setattr(graph, "FEW", few)
    random.seed(7)
    hints, names = {"h1", "h2", "h3"}, ["h1", "h2", "h3", "h3", "a", "bb", "c-c", "dd", "ee", "f", "-"]
    docs = [(k % 37, [random.choice(names) for _ in range(random.choice([0, 1, 2, 3, 4, 5, 9, 30]))]) for k in range(60)]
    docs += [(50, None), (51, ["h1"]), (52, ["h1", "h1"]), (53, ["h2"] * 9), (54, ["a"] * 20 + ["h3"]), (55, ["h3"] + ["a"] * 20), (56, ["a", "bb"] * 9)]
    df = spark.createDataFrame(docs, "id long, w array<string>")
    given = spark.createDataFrame([(h,) for h in sorted(hints)] + [("h1",), ("none",)], "word string")
    counts, runs = {}, {}
    for i, w in docs:
        for n in (2, 3, 4, 5):
            for at in range(len(w or []) - n + 1):
                if hints & set(w[at : at + n]):
                    phrase = " ".join(w[at : at + n])
                    runs.setdefault(i, []).append((n, at + 1, phrase))
                    if n < 4:
                        counts.setdefault(i, {}).setdefault(phrase, 0)
                        counts[i][phrase] += 1
    best = {i: sorted(x.items(), key=lambda p: (-p[1], -len(p[0]), p[0]))[:12] for i, x in counts.items()}
    found = graph.concepts(df, "id", F.col("w"), given).collect()
    assert sorted((r["id"], r["phrase"], r["n"]) for r in found) == sorted((i, p, n) for i, x in best.items() for p, n in x)
    every = graph._hinted_runs(df, "id", F.col("w"), given, (5, 4, 3, 2)).collect()
    assert sorted((r["id"], r["size"], r["at"], r["phrase"]) for r in every) == sorted((i, *r) for i, x in runs.items() for r in x)
    want = set()
    for i in runs:
        # equal places of documents of one key leave it open which comes first, so these are compared without their order
        own = [(0, at, p) for at, (p, _) in enumerate(best.get(i, []), 1)] + sorted(runs[i], key=lambda r: (-r[0], r[1]))
        seen = dict.fromkeys(y for _, _, p in own if (y := " ".join(re.findall("[a-z0-9]+", p))))
        want |= {(i, y, place) for place, y in enumerate(seen, 1) if place <= 16}
    single = {i for i, _ in docs if sum(i == j for j, _ in docs) == 1}
    found = {(r["id"], r["alias"], r["place"]) for r in graph.aliases(df, "id", F.col("w"), F.col("w"), given).collect()}
    assert {x for x in found if x[0] in single} == {x for x in want if x[0] in single} and len(found) == len(want)


def test_concepts_make_words_once(spark):
    """A filter on what is exploded would make the words of a document a second time."""
    from litgrid.functions import text as T
    from litgrid.operators import graph

    df = spark.createDataFrame([(1, "of the b-c dd")], "id long, text string")
    given = spark.createDataFrame([("dd",)], "word string")
    found = graph.aliases(df, "id", T.tokens(F.col("text")), T.tokens(F.col("text")), given)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-z0-9][a-z0-9-]*[a-z0-9]") == 2  # once for concepts, once for the head's runs
    assert {r["alias"] for r in found.collect()} == {"b c dd"}
