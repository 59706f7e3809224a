"""Divergence audit, substring removal and lexical search against brute force, their SQL, and edge cases."""

import collections
import glob
import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from litgrid.llm import divergence, lexical_search, pii, queries, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 700}" for k in range(40_000))
ODD = [(None, "a b c d e f g " * 6, "en", None, None), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, " \n\t ", "fr", "s", 4), (4, "x" * 300000, "de", "s", 30000), (5, "a b c d e f g " * 5, None, "s", 13), (5, "a b c d e f g " * 5, None, "s", 13), (5, "zz " + "a b c d e f g " * 5, "", "s", 13), (6, "é ñ 漢字 <|endoftext|>  \n\n Z É", "en", "s", 20), (7, LONG, "en", "s", 45000), (8, LONG[40:90_000], "en", "t", 45000)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    made = spark.createDataFrame(ODD, SCHEMA)
    for name in ("key", "hash", "start", "term", "terms", "rank", "score", "value", "item", "block", "n", "tf", "df", "slice", "bits", "length", "text_"):
        made = made.withColumn(name, F.lit(1))
    return made


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_substrings", "op13_lexical_search"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, cur = queries.queries()[name](spark, sf_dir), con.execute(queries.oracle_sql()[name])
    assert df.columns == [c[0] for c in cur.description]
    assert rows_of(df) == sorted(cur.fetchall(), key=repr)


def lower(text):
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")


# ---- divergence


def audited(docs, ranks, least):
    words = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[1]))) for r in docs]
    out = []
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        df = collections.Counter(t for w in own for t in set(w[2]))
        kept = {t for t in df if df[t] >= least}
        groups = {s: collections.Counter(t for w in own if w[1] == s for t in w[2] if t in kept) for s in {w[1] for w in own}}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        shares, all_of = {s: p(c) for s, c in groups.items()}, p(sum(groups.values(), collections.Counter()))
        for s in groups:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(shares[s][t] - all_of[t], t) for t in kept if groups[s][t] and shares[s][t] > all_of[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out, key=repr)


def test_divergence_by_brute_force(spark, odd, monkeypatch):
    random.seed(3)
    rows = [(k, " ".join(random.choice("ab") * random.randint(1, 6) + random.choice(["É", "x", "-y", ""]) for _ in range(random.randint(0, 60))), random.choice(["en", "fr", None]), random.choice("pqrstuvw"), 0) for k in range(400)]
    assert rows_of(divergence.audit(spark, spark.createDataFrame(rows, SCHEMA), 5, 3)) == audited(rows, 5, 3)
    assert rows_of(divergence.audit(spark, odd, 50, 1)) == audited(ODD, 50, 1)
    assert rows_of(divergence.audit(spark, odd)) == audited(ODD, 50, 30)


def test_divergence_in_tiles(spark, monkeypatch):
    """Workers read the module's own sizes, so many groups are needed to fill more than one tile."""
    random.seed(4)
    rows = [(k, " ".join(f"t{'abcdefghij'[random.randint(0, 9)] * random.randint(1, 9)}" for _ in range(30)), "en", f"s{k % 150}", 0) for k in range(600)]
    assert rows_of(divergence.audit(spark, spark.createDataFrame(rows, SCHEMA), 3, 2)) == audited(rows, 3, 2)


def test_equal_subtrees_are_one_node():
    counts = np.zeros((3, 256), np.int64)
    counts[0, :4] = counts[1, :4] = [5, 1, 0, 2]
    counts[2, 4:8] = [5, 1, 0, 2]
    forest = divergence.Forest(counts)
    assert forest.roots[0] == forest.roots[1] != forest.roots[2]
    assert [len(left) for left, _ in forest.children] == [3, 2, 3, 3, 3, 3, 3, 2]  # the empty one, and the few others of each level
    pair, a, b, times = forest.compared(np.array([0, 0]), np.array([1, 2]))
    assert sorted(zip(pair.tolist(), a.tolist(), b.tolist(), times.tolist(), strict=True)) == [(0, 1, 1, 1), (0, 2, 2, 1), (0, 5, 5, 1), (1, 0, 1, 1), (1, 0, 2, 1), (1, 0, 5, 1), (1, 1, 0, 1), (1, 2, 0, 1), (1, 5, 0, 1)]


def test_shares_of_large_counts():
    count, total = np.array([10**14, 7, 3 * 10**15 - 1]), np.array([3 * 10**15, 10**15, 3 * 10**15])
    assert divergence.scaled(count, total).tolist() == [10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "SEGMENT", 16)
    text = ("Ab-c " + "é" * 40 + " x1y " + "long" * 20).encode()
    assert [t for part in divergence.terms_of(text) for t in part] == [b"ab", b"c", "é".encode() * 40, b"x", b"y", b"long" * 20]
    monkeypatch.setattr(lexical_search, "SEGMENT", 16)
    assert lexical_search.counted(text) == {b"ab": 1, b"c": 1, "é".encode() * 40: 1, b"x1y": 1, b"long" * 20: 1}


# ---- substrings


def cut(docs, window):
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    met, out, copies = set(), [], set()
    for k in order:
        doc_id, text = docs[k][:2]
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            own = tuple(words[i : i + window])
            if own in met:
                gone.update(range(i, i + window))
            met.add(own)
        stay = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc_id, len(words), len(gone), hashlib.sha256(" ".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_by_brute_force(spark):
    random.seed(5)
    passages = [[f"w{random.randint(0, 40)}" for _ in range(random.randint(15, 60))] for _ in range(12)]
    rows = []
    for k in range(300):
        words = sum((random.choice(passages) if random.random() < 0.4 else [random.choice("ab") for _ in range(random.randint(0, 30))] for _ in range(random.randint(0, 5))), [])
        rows.append((None if k == 299 else k * 7 % 299, random.choice([" ", "\n", "\t "]).join(words), "en", "s", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    for window in (20, 3):
        assert rows_of(substrings.kept(spark, df, window).select("doc_id", "n_words", "n_removed", "kept_sha256")) == cut(rows, window)


def test_odd_texts_without_substrings(spark, odd, none):
    # texts under one id are in the order of their hashes, which is not that of the rows
    other = [r for r in ODD if r[0] != 5]
    found = rows_of(substrings.kept(spark, odd.where("doc_id <> 5 or doc_id is null")).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert found == cut(other, 20)
    of_5 = [r for r in rows_of(substrings.kept(spark, odd)) if r[0] == 5]
    assert sorted(r[1] for r in of_5) == [35, 35, 36] and sum(r[2] == r[1] for r in of_5) >= 1
    assert substrings.kept(spark, none).count() == 0


def test_windows_estimated_once_stand_once(monkeypatch):
    """Anchors of equal windows differ in place; two windows of other words have other hashes."""
    from litgrid.llm.common import words_of

    random.seed(6)
    words = [random.choice("abc") for _ in range(3000)]
    hashes, at = words_of([" ".join(words).encode()])
    starts, place, run = substrings.anchors(hashes, at, 20, 10)
    assert starts.tolist() == list(range(len(words) - 19))
    whole = substrings.windows(hashes, 20)
    by = collections.defaultdict(list)
    for i, p in zip(starts.tolist(), place.tolist(), strict=True):
        assert i <= p <= i + 10
        by[tuple(words[i : i + 20])].append((int(whole[i]), p, int(run[p])))
    assert all(len({x[0] for x in v}) == 1 and len({x[1] for x in v}) == len(v) and len({x[2] for x in v}) == 1 for v in by.values())
    assert len({v[0][0] for v in by.values()}) == len(by)


# ---- lexical search


def ranked(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    own = [(d[0], terms(d[1])) for d in docs]
    n, total = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = collections.Counter(t for _, ts in own for t in set(ts))
    asked, out = collections.defaultdict(list), []
    for item_id, text in items:
        asked[item_id] += terms(text)
    for item_id, ts in asked.items():
        found = []
        for doc_id, words in own:
            tf = collections.Counter(words)
            m = 75 + 25 * len(words) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in ts if tf[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item_id, r + 1, x[2], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def test_search_by_brute_force(spark, odd, none, monkeypatch):
    random.seed(7)
    rows = [(k, " ".join(f"{random.choice('ab')}{int(random.expovariate(0.08))}" for _ in range(random.randint(0, 80))), "en", "s", 0) for k in range(2000)]
    rows += [(3000 + k, rows[11][1], "en", "s", 0) for k in range(300)] + [(9, rows[12][1], "en", "s", 0)] * 3
    items = [(k, random.choice(rows)[1][: random.randint(0, 200)]) for k in range(25)] + [(1, "a1 a1 B2"), (None, "a3"), (77, None), (78, "never"), (79, "")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)).withColumn("item", F.lit(1)).withColumn("doc_id", F.lit(1))
    expected = ranked(rows, items, 20)
    monkeypatch.setattr(lexical_search, "BUCKET", 200)
    assert rows_of(lexical_search.best(spark, spark.createDataFrame(rows, SCHEMA), table)) == expected
    monkeypatch.setattr(lexical_search, "ITEMS", 7)  # several passes
    assert rows_of(lexical_search.best(spark, spark.createDataFrame(rows, SCHEMA), table)) == expected
    asked = [(1, "a b É w1 w2 漢字"), (2, "z")]
    table = spark.createDataFrame(asked, "item_id long, text string")
    assert rows_of(lexical_search.best(spark, odd, table)) == ranked(ODD, asked, 20)
    assert lexical_search.best(spark, none, table).count() == lexical_search.best(spark, odd, table.limit(0)).count() == 0


def test_bounds_prune_and_lose_nothing():
    random.seed(8)
    weights = np.array([random.randint(1, 9000) for _ in range(500)], np.int64)
    vectors = [{t: random.randint(1, 900_000) for t in random.sample(range(500), random.randint(1, 12))} for _ in range(3000)]
    length = np.array([math.sqrt(sum(weights[t] * x * x for t, x in v.items())) for v in vectors])
    order = np.argsort(-length)
    counts = [{t: random.randint(1, 3) for t in random.sample(range(500), 6)} for _ in range(20)]
    items = lexical_search.Items(counts, weights)
    best, passed, total = lexical_search.Best(5, np.zeros(20, np.int64)), 0, 0
    for k in range(0, 3000, 250):
        own = [sorted(vectors[i].items()) for i in order[k : k + 250]]
        flat = np.array([x for v in own for x in v], np.int64)
        p, t = lexical_search.search_bucket(items, weights, best, order[k : k + 250].astype(np.int64), length[order[k : k + 250]], np.repeat(np.arange(250), [len(v) for v in own]), flat[:, 0], flat[:, 1])
        passed, total = passed + p, total + t
    for q, own in enumerate(counts):
        scores = sorted(((-sum(int(weights[t]) * many * v.get(t, 0) for t, many in own.items()), i) for i, v in enumerate(vectors)))[:5]
        assert [(-int(s), int(i)) for s, i in zip(*best.found[q], strict=True)] == [x for x in scores if x[0] < 0]
    assert passed < total / 10


# ---- the word-identifier graph of personal data


def trusted(rows):
    """Words and kinds that the graph trusts, by plain loops over its edges."""
    edges = {}
    for word, form, kind, known in rows:
        edges[word, form, kind] = edges.get((word, form, kind), False) or known
    score = {}
    for (_, form, kind), known in edges.items():
        score[form, kind] = max(score.get((form, kind), 0.0), float(known))
    all_n, all_known, words = collections.Counter(k[2] for k in edges), collections.Counter(k[2] for k, known in edges.items() if known), {}
    for _ in range(pii.ROUNDS):
        words = {}
        for word, kind in {(w, k) for w, _, k in edges}:
            own = [(score[f, k], known) for (w, f, k), known in edges.items() if (w, k) == (word, kind)]
            n, p, seeds = len(own), sum(x for x, _ in own) / len(own), sum(x >= pii.CONFIDENCE for x, _ in own)
            z = pii.ERRORS
            low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            share = (all_known[kind] - sum(known for _, known in own) + 0.5) / (all_n[kind] - n + 1)
            if seeds >= pii.SEEDS and p >= pii.CONFIDENCE and (kind == "email" or low >= min(share, pii.SURE)):
                words[word, kind] = p
        for form, kind in score:
            wrong, known = 1.0, False
            for (w, f, k), is_known in edges.items():
                if (f, k) == (form, kind):
                    known |= is_known
                    wrong *= 1 - min(words.get((w, k), 0.0), 0.999)
            score[form, kind] = 1.0 if known else 1 - wrong
    return words


def test_pii_graph_by_brute_force(spark):
    rng, some = random.Random(12), 0
    for _ in range(4):
        rows = []
        for k, word in enumerate(["tel:", "call", "fax", "total:", "mail:", "at", "ip"]):
            kinds = ["email"] if word in ("mail:", "at") else ["ip"] if word == "ip" else ["phone"]
            rows += [(word, f"f{rng.randrange(40)}", kind, rng.random() < (0.9, 0.97, 0.6, 0.05, 0.9, 0.3, 1)[k]) for _ in range(rng.randint(8, 60)) for kind in kinds]
        found = {(r["word"], r["kind"]): r["confidence"] for r in pii.patterns(spark.createDataFrame(rows, "word string, form string, kind string, known boolean")).collect()}
        want = trusted(rows)
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
        some += len(want)
    assert some >= 8
