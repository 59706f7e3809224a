"""The training-data operators against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from litgrid.llm import common, decontamination, fingerprints, language_id, license_scan, ngram_join, packing, pii, quality, queries, token_files, url_filters

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "a b c d e f g", "en", None, None), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, " \n\t ", "fr", "s", 4), (4, "x" * 30000, "de", "s", 30000), (5, "a b c d e f g", None, "s", 13), (5, "a b c d e f g", None, "s", 13), (6, "é ñ 漢字 <|endoftext|>  \n\n z", "en", "s", 20), (7, "word " * 9000, "en", "s", 45000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("key", F.lit(1)).withColumn("label", F.lit("x")).withColumn("task", F.lit(2)).withColumn("spans", F.lit(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def encoded(text):
    from tokenizers import Tokenizer

    if not hasattr(encoded, "lib"):
        encoded.lib = Tokenizer.from_file(VOCABULARY)
        encoded.lib.encode_special_tokens = True
    return encoded.lib.encode(text or "", add_special_tokens=False).ids


def test_tokens_of_odd_white_space():
    random.seed(1)
    texts = ["".join(random.choice("ab \n\t'.é  1_sl²\x1c\x85\xa0\xad漢") for _ in range(random.randint(0, 12))) for _ in range(4000)] + [t or "" for _, t, *_ in ODD]
    texts += ["".join(chr(random.randrange(0x250 if k % 2 else 0x3000)) for _ in range(random.randint(1, 9))) for k in range(4000)] + [f" {chr(k)}a{chr(k)}1 {chr(k)}" for k in range(0x250)]
    for keep in (250_000, 100):  # with many generations of pieces too
        for text, ids in zip(texts, common.Tokens(VOCABULARY, keep).encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoded(text)


def test_tokens_of_another_vocabulary():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, texts = Tokenizer.from_file(path), ["A Word, two words.", "", "é x\n\ny"]
    lib.encode_special_tokens = True
    assert [np.frombuffer(x, "<u4").tolist() for x in common.Tokens(path).encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def check_pieces(rows, texts):
    by_doc = collections.defaultdict(list)
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert sum(2048 - sum(n for _, n in p) for p in by_sequence.values()) < 2048  # only the last is not full
    for i, text in texts.items():
        want = np.array([*encoded(text), 1], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == want.tobytes()
        assert [p["start"] for p in pieces] == np.r_[0, np.cumsum([p["length"] for p in pieces])[:-1]].tolist() and {p["doc_tokens"] for p in pieces} == {len(want)}


def test_packing(spark, docs, odd, none):
    check_pieces(packing.pack(spark, docs, VOCABULARY).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    rows = packing.pack(spark, odd, VOCABULARY).collect()
    check_pieces(rows, {i: t for i, t, *_ in ODD if i not in (None, 5)})
    assert packing.pack(spark, none, VOCABULARY).count() == 0


def test_packing_in_few_tasks(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "TASKS", 3)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    many = docs.repartition(11)
    found = packing.pack(spark, many, VOCABULARY)
    check_pieces(found.collect(), texts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # ids meet their ranks by broadcast alone
    assert "SortMergeJoin" not in plan.split("BroadcastHashJoin")[0] and "BroadcastHashJoin" in plan


def test_repeats_recover_exact_histogram():
    counts = np.zeros(64, np.int64)
    counts[[10, 54, 20, 24]] = 100, 100, 50, 0
    counts[22] = 100
    made = packing.plan(counts, 64)
    assert made["first"] >= 140  # 100 pairs and nearly 50 triples


def brute_classes(rows, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    index, parent = collections.defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        met = collections.Counter(o for x in s for o in index[x])
        for o, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                parent[find(k)] = find(o)
        for x in s:
            index[x].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


def test_ngram_join(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r[0]: (r[1], r[2]) for r in ngram_join.link_classes(spark, docs).collect()} == brute_classes(rows)


@pytest.mark.parametrize("frequent", [1000, 1])
def test_ngram_join_combinations(spark, frequent):
    random.seed(5)
    words = [f"w{i}" for i in range(40)]
    base, rows = [[random.choice(words) for _ in range(random.randint(4, 40))] for _ in range(12)], []
    for i in range(200):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
            w[random.randrange(len(w))] = random.choice(words)
        rows.append((i, " ".join(w) if i % 50 else [None, "", " \n "][i // 50 % 3]))
    found = ngram_join.link_classes(spark, spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent)
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == brute_classes(rows)


def test_ngram_join_edges(spark, odd, none):
    found = ngram_join.link_classes(spark, odd).collect()
    assert len(found) == len(ODD)
    by = collections.defaultdict(list)
    for r in found:
        by[r[0]].append((r[1], r[2]))
    assert by[None] == [(3, 5)] and by[5] == [(3, 5)] * 2 and by[1] == [(0, 1)] and by[3] == [(0, 3)] and by[4] == [(1, 4)]
    assert ngram_join.link_classes(spark, none).count() == 0


def test_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    extra = spark.createDataFrame([(-1, None), (-2, "no scheme"), (-3, "HTTP://A.EXAMPLE.ORG/es/1?x#y"), (-4, "x://example.org"), (-5, "x://org/"), (-6, "://example.org/en/1\n2")], "page_id long, url string")
    rows = url_filters.judge(spark, pages.select("page_id", "url").union(extra)).collect()
    urls |= {-1: None, -2: "no scheme", -3: "HTTP://A.EXAMPLE.ORG/es/1?x#y", -4: "x://example.org", -5: "x://org/", -6: "://example.org/en/1\n2"}
    assert len(rows) == len(urls)
    for r in rows:
        host = path = ""
        if urls[r["page_id"]] and "://" in urls[r["page_id"]]:
            rest = urls[r["page_id"]].split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(x), x, v) for v, x in url_filters.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")
    assert url_filters.judge(spark, pages.limit(0)).count() == 0


def test_url_rules_against_counts(spark):
    rng = random.Random(1)
    rows = [(sorted(rng.sample("abcdef", rng.randint(1, 4))), rng.choice(["allow", "block", "block"])) for _ in range(300)]
    rows = [(t, "allow" if {"a", "b"} <= set(t) else v) for t, v in rows]
    found = {(tuple(r["tokens"]), r["verdict"]): (r["confidence"], r["support"]) for r in url_filters.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.7).collect()}
    want = {}
    for n in range(1, 7):
        for part in itertools.combinations("abcdef", n):
            held = [v for t, v in rows if set(part) <= set(t)]
            for v in ("allow", "block"):
                k = held.count(v)
                if held and k >= 0.05 * len(rows) and k / len(held) >= 0.7:
                    want[part, v] = (k / len(held), k / len(rows))
    kept = {(p, v): x for (p, v), x in want.items() if not any(set(q) < set(p) and w == v and y[0] >= x[0] for (q, w), y in want.items())}
    assert set(found) == set(kept) and all(found[k] == pytest.approx(kept[k]) for k in kept)


def test_url_verdicts_against_all_combinations(spark):
    rng = random.Random(8)

    def url():
        top, path = rng.choice(["com"] * 5 + ["org"] + ["net"] * 2), rng.choice(["fr", "de", "it", "x"])
        # www and cdn always come together, and so do the two segments behind a shop; some open pages have one of them only
        host = rng.choice(["www.cdn.", "", "m.", *(["www."] if top == "net" else [])]) + rng.choice(["example", "site"])
        return f"http://{host}.{top}/{path}/" + rng.choice(["shop/all/", "", "blog/7/", *(["all/"] if top == "net" else [])])

    urls = [url() for _ in range(400)]
    found = url_filters.judge(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), support=0.02, confidence=0.75).collect()

    def tokens(r):
        labels, parts = r["host"].split("."), [x for x in r["path"].split("/") if x]
        return frozenset({"t:" + labels[-1]} | {"h:" + x for x in labels[:-1]} | {"p:" + re.sub("[0-9]+", "#", x) for x in parts})

    known = [(tokens(r), r["verdict"]) for r in found if r["rule"]]
    rules = {}
    for part in {frozenset(p) for t, _ in set(known) for n in range(1, len(t) + 1) for p in itertools.combinations(sorted(t), n)}:
        held = [v for t, v in known if part <= t]
        for v in ("allow", "block"):
            if held.count(v) >= 0.02 * len(known) and held.count(v) / len(held) >= 0.75:
                rules[part, v] = (held.count(v) / len(held), held.count(v) / len(known), v)
    opened = [r for r in found if not r["rule"]]
    for r in opened:
        fits = [x for (part, _), x in rules.items() if part <= tokens(r)]
        assert r["verdict"] == (max(fits)[2] if fits else "allow")
    assert {r["verdict"] for r in opened} == {"allow", "block"}
    same = url_filters.same_cover(spark.createDataFrame([(sorted(t), v) for t, v in known], "tokens array<string>, verdict string"), 0.02)
    assert {(r["first"], r["token"]) for r in same.where("first <> token").collect()} >= {("h:cdn", "h:www"), ("p:all", "p:shop")}


def test_url_tokens_that_always_come_together(spark):
    """Sixty tokens in the same rows are one: FP-growth alone would make 2 ** 60 itemsets of them."""
    long = "/".join(f"deep{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    urls = [(i, f"http://a.com/{'de' if i % 2 else 'fr'}/{long if i % 2 else ''}") for i in range(200)] + [(1000, f"http://b.net/{long}"), (1001, "http://b.net/deepab"), (1002, "http://b.net/else")]
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(spark, spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert [found[i] for i in (1000, 1001, 1002)] == [(None, "block"), (None, "block"), (None, "allow")] and found[1] == ("com/de/", "block")


def test_token_files(spark, docs, odd, none, tmp_path):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    path = common.new_path(spark, "test-files")
    token_files.write(spark, docs, path, VOCABULARY)
    found = {r["doc_id"]: r for r in token_files.read(spark, path).collect()}
    at, every = 0, []
    for i, text in rows:
        want = np.array([*encoded(text), 2], "<u4")
        assert (found[i]["start"], found[i]["n_tokens"], bytes(found[i]["ids"])) == (at, len(want), want.tobytes())
        at += len(want)
        every.append(want)
    assert (token_files.read_range(spark, path, 1000, 70000) == np.concatenate(every)[1000:71000]).all()
    for df, n in ((odd, len(ODD)), (none, 0)):
        token_files.write(spark, df, path := common.new_path(spark, "test-files"), VOCABULARY)
        assert token_files.read(spark, path).count() == n


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 27, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_files.packed(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (token_files.unpacked(data, bits, 0, 1001) == ids).all() and (token_files.unpacked(data, bits, 333, 7) == ids[333:340]).all()


def test_language_id(spark, docs, odd, none):
    found = language_id.predict(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    assert all(r["held_out"] for r in found) and {zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in found} == {0}
    rows = language_id.predict(spark, odd).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"} and all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.predict(spark, none).count() == 0


def test_code_lengths_against_a_plain_version():
    texts = {"x": [b"abracadabra" * 9, b"banana bandana " * 8], "y": [b"0110100110010110" * 9]}
    gram, n, lang = [], [], []
    for k, own in enumerate(texts.values()):
        g, c = np.unique(np.concatenate([language_id._grams(t) for t in own]), return_counts=True)
        gram, n, lang = gram + g.tolist(), n + c.tolist(), lang + [k] * len(g)
    trees = language_id.Trees(list(texts), np.array(lang), np.array(gram), np.array(n, float))
    counts = [collections.defaultdict(collections.Counter) for _ in texts]
    for k, own in enumerate(texts.values()):
        for t in own:
            raw = b"\n\n\n" + t
            for i in range(3, len(raw)):
                for order in range(4):
                    counts[k][raw[i - order : i]][raw[i]] += 1
    alphabet = {b for own in texts.values() for t in own for b in b"\n\n\n" + t}
    both = collections.Counter()
    for c in counts:
        for context, follow in c.items():
            both[context] += sum(follow.values())

    def probability(k, context, byte):
        if len(context) == 3 and both[context] < language_id.LEAST:  # not in the tree
            return probability(k, context[1:], byte)
        follow, shorter = counts[k][context], (lambda: probability(k, context[1:], byte) if context else 1 / (len(alphabet) + 1))
        if not follow:
            return shorter()
        total = sum(follow.values()) + len(follow)
        return follow[byte] / total if byte in follow else len(follow) / total * shorter()

    for text in (b"abra banana", b"0110 abba", b"zz"):
        raw = b"\n\n\n" + text
        want = [-sum(np.log2(probability(k, raw[i - 3 : i], raw[i])) for i in range(3, len(raw))) for k in range(2)]
        assert trees.code_lengths([text])[0] == pytest.approx(want, rel=1e-4)
    long = b"abracadabra banana " * 60_000  # many segments
    assert trees.code_lengths([b"x", long, b"y"])[1] == pytest.approx(trees.code_lengths([long])[0]) and trees.code_lengths([long])[0, 0] > 0


def test_code_lengths_are_probabilities():
    text = b"abracadabra" * 30
    gram, n = np.unique(language_id._grams(text), return_counts=True)
    trees = language_id.Trees(["x"], np.zeros(len(gram), np.int64), gram.astype(np.int64), n.astype(float))
    p = np.exp2(-trees.bits.reshape(-1, trees.a).astype(float))
    assert p.sum(1).max() <= 1 + 1e-5  # without exclusion a context may leave some probability unused
    assert trees.code_lengths([text])[0, 0] < 0.6 * 8 * len(text) > trees.code_lengths([b""])[0, 0]


def test_fingerprints(spark, docs, odd, none):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    found = {r["doc_id"]: r for r in fingerprints.compare(spark, docs).collect()}
    for (i, a), (j, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(a) // 4
        r = found[i]
        assert r["edited_sha256"] == hashlib.sha256((a[: len(a) - q] + b[:q]).encode()).hexdigest() and r["n_chars"] == len(a)
        assert r["near_next"] == pytest.approx(fingerprints.likeness(r["fingerprint"], found[j]["fingerprint"])) and r["near_edited"] == pytest.approx(fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"]))
    assert len({r["fingerprint"] for r in found.values()}) == len({t for _, t in rows})
    assert fingerprints.compare(spark, odd).count() == len(ODD) and fingerprints.compare(spark, none).count() == 0
    assert fingerprints.compare(spark, odd.where("doc_id = 2")).first()["near_edited"] == 1.0
    text = "One two three. Four five.\nSix seven.\n\nEight nine.\n" * 9
    edited = text[:200] + "X" + text[200:]
    spans = fingerprints.edits(*(fingerprints.written(*fingerprints.tree(t)) for t in (text, edited)))
    assert len(spans) == 1 and spans[0][0] <= 200 < spans[0][1] < 240


def test_fingerprints_without_reused_shuffles(spark):
    """Every row stays, whatever the optimizer reuses, and where one id has many rows."""
    rows = [(None if k % 7 == 0 else 50 if k % 3 == 0 else k, f"text {k % 400} and more {k % 11}") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(tuple(r) for r in fingerprints.compare(spark, df).na.fill(-1).collect())
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = sorted(tuple(r) for r in fingerprints.compare(spark, df).na.fill(-1).collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == want and sorted((r[0], r[1]) for r in got) == sorted((-1 if i is None else i, len(t)) for i, t in rows)
    order = sorted({(r[0], r[3]) for r in got}, key=lambda r: r[0])
    own = {fingerprints.written(*fingerprints.tree(t)) for _, t in rows}
    assert {p for _, p in order} == own


def test_likeness_of_a_single_sentence():
    rng = random.Random(3)
    print_of = lambda words: fingerprints.written(*fingerprints.tree(" ".join(words)))
    for n in (40, 400):  # a line of one sentence; its last quarter, or one word near its start, changed
        text, other = ([f"w{rng.randrange(10**5)}" for _ in range(n)] for _ in range(2))
        quarter, word = text[: n * 3 // 4] + other[: n // 4], [*text[:3], "another", *text[3:]]
        assert fingerprints.likeness(print_of(text), print_of(quarter)) > 0.5
        assert fingerprints.likeness(print_of(text), print_of(word)) > 0.6
    text = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(900))
    assert fingerprints.likeness(print_of([text]), print_of([text[:5] + "新" + text[5:]])) > 0.9


def test_quality(spark, sf_dir, docs, odd, none):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.predict(spark, docs, labels).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) >= 0.9 * len(found) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert quality.predict(spark, odd, labels).count() == len(ODD) and quality.predict(spark, none, labels).count() == 0
    assert {r["score"] for r in quality.predict(spark, odd, labels.limit(0)).collect()} == {0.5}


def test_quality_of_rare_positives(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    few = labels.where("quality = 1").orderBy("doc_id").limit(10)
    for sample in (30, 60_000):  # a small sample of all text seldom meets any of ten positives
        model, prior = quality.train(docs, few, F.lit(True), sample=sample)
        assert model is not None and 0 < prior < 1
    model, _ = quality.train(docs, labels, F.lit(True), trusted=5)
    assert model is not None


def test_risk_by_hand():
    rng = np.random.default_rng(2)
    p, u = rng.normal(2, 1, (400, 2)), np.r_[rng.normal(2, 1, (300, 2)), rng.normal(-2, 1, (700, 2))]
    model = quality.Model(u).fit(p, u, 0.3)
    loss = lambda z: np.logaddexp(0, -z)

    def risk(w):
        fp, fu = model.made(p) @ w, model.made(u) @ w
        return 0.3 * loss(fp).mean() + max(0.0, loss(-fu).mean() - 0.3 * loss(-fp).mean()) + 5e-5 * (w @ w)

    best = risk(model.w)
    for _ in range(200):  # no near weights have a lower risk, but for the last steps' size
        assert risk(model.w + rng.normal(0, 0.05, len(model.w))) > best - 2e-3
    scores = model.scores(u)
    assert (scores[:300] > 0.5).mean() > 0.95 and (scores[300:] < 0.5).mean() > 0.95


def test_class_prior():
    rng = np.random.default_rng(0)
    p, u = rng.beta(8, 2, 4000), np.r_[rng.beta(8, 2, 3000), rng.beta(2, 8, 1000)]
    assert abs(quality.class_prior(p, u) - 0.75) < 0.06


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, match):
    d = [int(x) for x in match if x in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], text or "", re.A) if valid(k, m[0])]


def test_pii_base(spark, docs):
    random.seed(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(10**6 + i, "".join(random.choice("0123456789.-@a +()é _%Z") for _ in range(random.randint(0, 40)))) for i in range(1500)]
    rows += [(-1, "a" * 3000 + "@"), (-2, "1 " * 30000), (-3, "1" * 3000), (-4, "a@b.c_d@e.f.@x.y"), (-5, None), (-6, "+1" + "(" * 3000), (-7, "1.2.3.4.5.6.7.8 4111 1111 1111 1111 é 4111-1111-1111-1111"), (-8, "a@" + "b." * 3000)]
    found = {r["doc_id"]: r for r in pii.digest(pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, text in rows:
        want = base_spans(text)
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(found[i]["spans"].split(","))


def test_pii_contexts_discover(spark):
    rows = [(i, f"Tel: +1 555 {i:04d} 12{i % 90 + 10}.") for i in range(60)] + [(1000 + i, f"Total: 55{i:07d} or so") for i in range(200)] + [(5000, "Tel: 5551234567 now")]
    found = {r["doc_id"]: r["s"] for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.written("spans").alias("s")).collect()}
    assert found[5000] == "phone:5:15" and found[1003] == "" and found[3].startswith("phone:5:")


def pii_spans(spark, texts):
    found = pii.find(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [r["s"] for r in found.orderBy("doc_id").select(pii.written("spans").alias("s")).collect()]


def test_pii_written_out_email(spark):
    plain = [f"Email: user{i}@host{i % 7}.org" for i in range(12)] + [f"write me{i}@there.net today" for i in range(30)]
    found = pii_spans(spark, ["Email: ann.bell (at) example (dot) org now", "see notes (at) example (dot) org", *plain])
    assert found[:2] == ["email:7:38", ""] and found[2] == "email:7:22"


def test_pii_written_out_ip(spark):
    found = pii_spans(spark, ["Host: 10[.]20[.]30[.]40 is up", "Row 10 20 30 40", *(f"Host: 10.1.{i}.7" for i in range(20)), *(f"Row {i} 20 30 {i + 1}" for i in range(40))])
    assert found[:2] == ["ip:6:23", ""]


def test_pii_any_usual_share(spark):
    found = pii_spans(spark, ["Tel: 5551234567 now", *(f"Tel: +1 555 {i:04d} 1234" for i in range(200)), *(f"ring +1 556 {i:04d} 1234" for i in range(200))])
    assert found[0] == "phone:5:15"
    found = pii_spans(spark, [*(f"the +1 555 {i:04d} 1234" for i in range(190)), *(f"the 666{i:07d}" for i in range(10)), *(f"for +1 556 {i:04d} 1234" for i in range(190)), *(f"for 667{i:07d}" for i in range(10))])
    assert not any(found[190:200] + found[390:])


def test_pii_discovered_seeds(spark):
    both = [f"555{i:07d}" for i in range(12)]
    found = pii_spans(spark, ["Fax: 7770001112", *(f"Tel: +1 444 {i:04d} 1234" for i in range(200)), *(f"Tel: {x}" for x in both), *(f"Fax: {x}" for x in both), *(f"Total: 88{i:07d}" for i in range(300))])
    assert found[0] == "phone:5:15" and found[-1] == ""


def test_pii_edges(spark, odd, none):
    assert pii.digest(pii.find(spark, odd)).count() == len(ODD) and pii.digest(pii.find(spark, none)).count() == 0
    clean = {r[0]: r for r in pii.redact(spark, spark.createDataFrame([(1, "mail a@b.co, 10.0.0.1 now", 5), (2, None, 0)], "doc_id long, text string, n_chars long")).collect()}
    assert clean[1][1:] == ("mail [EMAIL], [IP] now", 22) and clean[2][1:] == (None, 0)


def test_pii_of_a_long_text(spark):
    import time

    text = "mail a@b.co " * 3_000 + "plain words " * 40_000  # half a megabyte, thousands of spans
    began = time.time()
    r = pii.redact(spark, spark.createDataFrame([(1, text, 3, "x")], "doc_id long, text string, spans int, base string")).collect()[0]
    assert r["text"] == "mail [EMAIL] " * 3_000 + "plain words " * 40_000 and (r["spans"], r["base"]) == (3, "x") and time.time() - began < 60


def test_pii_redaction_of_overlaps(spark):
    texts = ["call +1 4111 1111 1111 1111 é now", "10.0.0.1@b.co x 1.2.3.4", "", None, "é@ a@b.c-d.e漢 a@b.c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.redact(spark, rows).collect()}
    for i, t in enumerate(texts):
        spans = sorted(((int(a), -int(b), k) for k, a, b in (s.split(":") for s in base_spans(t))), key=lambda x: x[:2])
        out, at = "", 0
        for a, b, k in spans:
            out += (t[at:a] + f"[{k.upper()}]") if a >= at else ""
            at = max(at, -b)
        assert found[i]["text"] == (out + t[at:] if spans else t)


def test_pii_many_words_are_joined(spark):
    texts = ["Tel: 5551234567 now", *(f"Tel: +1 555 {i:04d} 1234" for i in range(60)), *(f"Total: 66{i:07d}" for i in range(200)), None, "Tel: 5551234567 now"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("new", F.lit(1))
    want = {r["doc_id"]: r["spans"] for r in pii.find(spark, rows).collect()}
    joined = pii.find(spark, rows.withColumn("litgrid_base", F.lit(2)), words=0)
    assert {r["doc_id"]: r["spans"] for r in joined.collect()} == want and len(want[0]) == 1
    assert joined.columns == ["doc_id", "text", "new", "litgrid_base", "base", "spans"] and {r["new"] for r in joined.collect()} == {1}


def test_license_scan(spark, docs, odd, none):
    found = license_scan.scan(spark, docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0", "MIT": "Released under the MIT License", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0"}
    for name, line in lines.items():
        assert {i for i, t in texts.items() if line in t} <= {r["doc_id"] for r in found if r["license"] == name and r["coverage"] == 1.0}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]].split()[0].lower() in ("licensed", "released") for r in found)
    near = spark.createDataFrame([(1, "é x Permission is hereby granted, free of any charge, to a person obtaining a copy of this software and associated documents files (the Software), to deal in the Software without restriction, including the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software. y")], "doc_id long, text string")
    r = license_scan.scan(spark, near).collect()
    assert [x["license"] for x in r] == ["MIT text"] and 0.75 <= r[0]["coverage"] < 1 and r[0]["start"] == 4
    license_scan.scan(spark, odd).collect()
    assert license_scan.scan(spark, none).count() == 0


def test_license_scan_against_every_diagonal():
    rng = random.Random(9)
    names = ["MIT", "BSD text", "MPL-2.0", "ISC"]
    known = license_scan.Templates({n: license_scan.TEMPLATES[n] for n in names})
    hashes = lambda t: common.hashed_words(license_scan.plain(t))[0]
    for _ in range(40):
        words = license_scan.TEMPLATES[rng.choice(names)].split()
        for _ in range(rng.randint(0, len(words) // 6)):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 1)] = [f"z{rng.randrange(99)}"] * rng.randint(0, 2)
        text = hashes(" ".join([f"x{rng.randrange(50)}" for _ in range(rng.randint(0, 30))] + words + [f"y{rng.randrange(50)}" for _ in range(20)]))
        found = {x[0]: x[1] for x in known.scan(text)}
        for t, template in enumerate(known.words):
            best = max(license_scan.aligned(template, text, d)[0] for d in range(-len(template), len(text))) / len(template)
            run = set(license_scan.grams(text, 6).tolist()) & set(license_scan.grams(template, 6).tolist())
            if best >= license_scan.COVERAGE and run:  # six words in a row are sure to share a winnowed fingerprint
                assert found[t] == pytest.approx(best)
            if best < license_scan.COVERAGE:
                assert t not in found


def whole_alignment(template, text):
    """Matched words, first and last + 1 matched word of the best local alignment, over all cells; gaps and mismatches cost 0.5."""
    cells, best = {}, (0, 0, 0, 0)
    nothing = (0, 0, None)
    for i, x in enumerate(template):
        for j, y in enumerate(text):
            s, hits, start = cells.get((i - 1, j - 1), nothing)
            tries = [(s + 1, hits + 1, j if start is None else start)] if x == y else [(s - 0.5, hits, start)]
            tries += [(cells.get(at, nothing)[0] - 0.5, *cells.get(at, nothing)[1:]) for at in ((i - 1, j), (i, j - 1))]
            top = max(tries, key=lambda t: t[0])
            if top[0] > 0:
                cells[i, j] = top
                if top[0] > best[0]:
                    best = (top[0], top[1], top[2], j + 1)
    return best[1:]


def test_license_scan_against_whole_alignments(spark):
    rng, rows, want = random.Random(4), [], []
    for i in range(60):
        name = rng.choice(["MIT text", "BSD text", "ISC", "MPL-2.0", "Unlicense", "LGPL"])
        template = license_scan.TEMPLATES[name].split()
        words, at = list(template), len(template) - 4
        while at >= 4:  # single words changed, added or left out, at least four words apart
            words[at : at + rng.randint(0, 1)] = [f"z{rng.randrange(99)}"] * rng.randint(0, 1)
            at -= rng.randint(4, 12)
        before, after = ([f"{c}{rng.randrange(50)}" for _ in range(rng.randint(0, 25))] for c in "xy")
        rows.append((i, " ".join(before + words + after)))
        fold = lambda t: re.findall("[a-z0-9]+", t.lower())
        hits, first, last = whole_alignment(fold(" ".join(template)), fold(rows[-1][1]))
        if hits >= license_scan.COVERAGE * len(fold(" ".join(template))):
            spans = [m.span() for m in re.finditer("[a-z0-9]+", rows[-1][1].lower())]
            want.append((i, name, round(hits / len(fold(" ".join(template))), 9), spans[first][0], spans[last - 1][1]))
    # repeated rows, clashing columns
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").withColumns({x: F.lit("other") for x in ("license", "coverage", "start", "end")})
    found = sorted((r["doc_id"], r["license"], round(r["coverage"], 9), r["start"], r["end"]) for r in license_scan.scan(spark, df).collect())
    assert len(want) > 30 and found == sorted(want + [x for x in want if x[0] == 0])


def test_license_scan_of_very_long_texts(spark):
    notice = license_scan.TEMPLATES["BSD text"]
    text = " ".join(f"word{i} {notice} ." if i % 300 == 0 else f"word{i}" for i in range(60_000))
    found = license_scan.scan(spark, spark.createDataFrame([(1, text), (2, "w" * 3_000_000)], "doc_id long, text string")).collect()
    assert len(found) == 200 and all(r["doc_id"] == 1 and text[r["start"] : r["end"]] == notice for r in found)


def test_decontamination(spark, sf_dir, docs, odd, none):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(spark, docs, items).collect()}
    texts, tests = ({r[0]: r["text"] for r in df.collect()} for df in (docs, items))
    plain = lambda t: b" ".join(decontamination.plain(t).split())
    inside = {(i, k) for i, t in texts.items() for k, b in tests.items() if plain(b) in plain(t)}
    assert inside <= found
    for i, k in found - inside:  # near copies only
        words = set(plain(tests[k]).split())
        assert len(words & set(plain(texts[i]).split())) >= 0.6 * len(words)
    decontamination.matches(spark, odd, items).collect()
    assert decontamination.matches(spark, none, items).count() == 0 and decontamination.matches(spark, docs, items.limit(0)).count() == 0


def test_decontamination_of_long_items(spark):
    rng = random.Random(5)
    text = lambda n, own: " ".join(f"{own}{rng.randrange(10**6)}" for _ in range(n))
    tests = {k: f"{text(n - 9, 'q')}? {text(9, 'a')}" for k, n in enumerate((400, 230, 140, 81, 80, 12, 1300))}
    docs = {(k, before): f"{text(before, 'x')} {t} {text(50, 'y')}" for k, t in tests.items() for before in (0, 7, 40, 47, 90, 300)}
    rows = list(docs.values()) + [f"{text(200, 'x')} {' '.join(tests[0].split()[:60])} {text(900, 'y')}"]
    found = decontamination.matches(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), spark.createDataFrame(list(tests.items()), "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(i, k) for i, (k, _) in enumerate(docs)]
    assert all(r["score"] == pytest.approx(1) and r["question_overlap"] == r["answer_overlap"] == 1 for r in found)


def test_decontamination_by_several_indexes(spark, monkeypatch):
    rng = random.Random(6)
    shared = " ".join(f"s{k}" for k in range(12))
    tests = [(None if k % 3 == 0 else k % 5, f"{' '.join(f'q{k}x{rng.randrange(50)}' for _ in range(14))} {shared}? {' '.join(f'a{k}x{j}' for j in range(3))}") for k in range(14)] + [(7, None), (None, ""), (8, "one")]
    docs = [(k * 100 + n, f"{rng.randrange(99)} before {' '.join(t.split()[14 - n // 2 :])} after {k}") for k, (_, t) in enumerate(tests) if t for n in (2, 16, 28)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")
    rows = lambda: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in decontamination.matches(spark, docs, items).collect()), key=repr)
    whole = rows()
    assert {r[1] for r in whole} == {i for i, t in tests[:14]}
    monkeypatch.setattr(decontamination, "ITEMS", 3)
    assert rows() == whole and len(whole) > 14 and {r[2] for r in whole} > {1.0}


def test_block_max_wand_finds_all(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 30))) for _ in range(80)]
    monkeypatch.setattr(decontamination, "BLOCK", 4)
    index = decontamination.Index(list(range(80)), texts)
    for _ in range(60):
        terms = np.array(sorted(rng.sample(range(len(index.vocabulary)), rng.randint(1, 30))))
        scores = np.zeros(80)
        for t in terms:
            scores[index.item[index.at[t] : index.at[t + 1]]] += index.impact[index.at[t] : index.at[t + 1]]
        for threshold in (0.1, 0.4, 0.8):
            assert {i for i, _ in index.search(terms, threshold)} == set(np.flatnonzero(scores >= threshold - 1e-9).tolist())


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    classes = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    items = [b" ".join(decontamination.plain(r["text"]).split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r["doc_id"]: r["text"] for r in docs.collect() if classes[r["doc_id"]][1] == r["doc_id"]}
    kept = {i: t for i, t in kept.items() if not any(b in b" ".join(decontamination.plain(t).split()) for b in items) and any(c.isalpha() for c in t)}
    got = collections.defaultdict(int)
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert set(got) == set(kept)
    for i, t in kept.items():
        if not base_spans(t):
            assert got[i] == len(encoded(t)) + 1


def test_pipeline_stages_by_row(spark, sf_dir, none):
    import corpus_pipeline

    t, u = "one two three four five six seven", "an other text of some more words here"
    rows = [(3, t), (5, u), (5, t), (5, u), (None, t), (None, t), (9, None), (9, None), (8, ""), (None, "")]
    df = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], SCHEMA)
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, df, sf_dir).collect()), key=repr)
    assert kept == sorted([(3, t), (5, u), (9, None), (9, None), (8, ""), (None, "")], key=repr)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    df = spark.createDataFrame([(None, f"{u} {item} {u}", "en", "s", 1), (1, u, "en", "s", 1), (1, item, "en", "s", 1), (None, None, "en", "s", 0)], SCHEMA)
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminated(spark, df, sf_dir).collect()), key=repr)
    assert kept == sorted([(1, u), (None, None)], key=repr)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.withColumn("key", F.lit(1)).withColumn("spans", F.lit(2)), sf_dir).count() == 0


def test_language_stage(spark, docs):
    import corpus_pipeline

    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 34 !!", "en", "s", 0), (-3, "\u4e94\u6708\u96e8 \u53e4\u6c60\u3084 \u86d9\u98db\u8fbc\u3080", "en", "s", 9)], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.union(odd), "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"])}


def test_language_stage_ignores_labels(spark, docs):
    """What a row's own label says changes nothing, whether it is one text, repeated junk, or a tongue that was not learned."""
    rng = random.Random(9)
    junk = ["".join(rng.choice("#$%&*+/<=>@[]^_{|}~ qxzj") for _ in range(300)) for _ in range(16)]
    tongue = ["\u4e94\u6708\u96e8\u3092\u96c6\u3081\u3066\u65e9\u3057\u6700\u4e0a\u5ddd"] * 3 + ["\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440, \u043a\u0430\u043a \u0434\u0435\u043b\u0430"]
    for label in ("en", "de", None):
        odd = spark.createDataFrame([(-k - 1, t, label if k % 2 else None, "s", 1) for k, t in enumerate(junk + tongue)], SCHEMA)
        kept = {r["doc_id"] for r in language_id.keep_known(spark, docs.union(odd)).select("doc_id").collect()}
        assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"])}
    few = spark.createDataFrame([(1, "some words here", "en", "s", 1), (1, "some words here", "en", "s", 1), (2, "and other words there", None, "s", 1), (3, None, "en", "s", 1)], SCHEMA).withColumn("half", F.lit(1)).withColumn("rate", F.lit(1))
    assert sorted(r["doc_id"] for r in language_id.keep_known(spark, few).collect()) in ([1, 1, 2], [1, 1])
    assert sorted(r["doc_id"] for r in language_id.keep_known(spark, few.withColumn("lang", F.lit(None).cast("string"))).collect()) == [1, 1, 2]


def test_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))


def test_pipeline_language_learns_from_every_text(spark, monkeypatch):
    # before, about 2,000 texts of a language were drawn
    learned = []

    class Seen(language_id.Trees):
        def __init__(self, languages, language, gram, count, *more):
            learned.append(int(count.sum()))
            super().__init__(languages, language, gram, count, *more)

    monkeypatch.setattr(language_id, "Trees", Seen)
    rows = [(k, f"la casa del numero {k} es muy grande", "es") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.keep_known(spark, docs).count() == 5000
    assert sum(learned[:2]) == sum(len(t) for _, t, _ in rows)


def test_pruned_trees_are_those_of_all_counts(spark):
    texts = [(f"le chat numero {k} dort sur le grand lit bleu {k * 7919 % 1000}", "fr") for k in range(300)] + [(f"the cat number {k} sleeps on the big blue bed", "en") for k in range(300)]
    rows = spark.createDataFrame(texts, "text string, lang string").withColumn("half", language_id._half("text"))
    found = language_id._halves(language_id._counts(rows, ["en", "fr"]), ["en", "fr"])
    for h in (0, 1):
        gram, language = [], []
        for r in rows.where(F.col("half") == 1 - h).collect():
            own = language_id._grams(r["text"].encode())
            gram, language = [*gram, *own], [*language, *[["en", "fr"].index(r["lang"])] * len(own)]
        plain = language_id.Trees(["en", "fr"], np.array(language), np.array(gram, np.int64), np.ones(len(gram)))
        asked = [b"le chat dort", b"the big cat sleeps", b"numero 77"]
        assert np.allclose(found[h].code_lengths(asked), plain.code_lengths(asked))


def test_language_trees_are_not_in_closures(spark, docs, monkeypatch):
    """A worker that gets trees in its function's closure holds them as bytes and as arrays."""
    from pyspark import cloudpickle

    sizes = []
    monkeypatch.setattr(language_id, "lean", lambda f: (sizes.append(f), common.lean(f))[1])
    assert language_id.keep_known(spark, docs).count() > 0
    assert len(sizes) >= 4
    assert max(len(cloudpickle.dumps(f)) for f in sizes) < 50_000
