"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, divergence, fingerprints, language_id, lexical_search, license_scan, ngram_join, packing, pii, quality, substrings, token_files, url_filters

VOCABULARY = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spark, _documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(spark, _documents(spark, sf_dir))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-files")
    token_files.write(spark, _documents(spark, sf_dir), path, public_tokenizers.path(VOCABULARY))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(spark, _documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(spark, _documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(spark, _documents(spark, sf_dir)))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, _documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, _documents(spark, sf_dir))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept(spark, _documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.best(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DIVERGENCE = rf"""WITH t AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    w AS (SELECT lang, source, id, unnest(terms) AS term FROM t), g AS (SELECT DISTINCT lang, source FROM t), kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30), v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS tf FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL), n AS (SELECT lang, source, sum(tf) AS n FROM c GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(tf, 0) AS tf, (1000000000::HUGEINT * (coalesce(tf, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v)::HUGEINT AS p, (1000000000::HUGEINT * (k.total + 5)) // (v.n + 5 * v.v)::HUGEINT AS q FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE tf > 0 AND p > q))
    SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

SUBSTRINGS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM d WHERE len(ws) >= 20), w AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS x FROM s), later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later), g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id), u AS (SELECT d.doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
    k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN gone ON gone.doc_id = u.doc_id AND gone.i = u.i GROUP BY u.doc_id)
    SELECT d.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)"""

_ALNUM = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

LEXICAL_SEARCH = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS ts FROM documents), n AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
    q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_ALNUM}) AS term FROM benchmark) GROUP BY ALL), w AS (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d),
    p AS (SELECT doc_id, len, term, count(*) AS tf FROM w SEMI JOIN q USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), wt AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, n),
    s AS (SELECT item_id, doc_id, CAST(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * n) // l)))) AS BIGINT) AS score FROM q JOIN wt USING (term) JOIN p USING (term), n GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op11_divergence": DIVERGENCE, "op12_substrings": SUBSTRINGS, "op13_lexical_search": LEXICAL_SEARCH}
