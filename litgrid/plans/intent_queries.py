"""Queries of query analysis (Q), and of what needs constraints (K01, K02, K22, A17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.operators import intent

from .fixtures import BENCHMARK_QUERIES, benchmark_queries, table, title_sql, tokens_sql
from .registry import query

c = F.col

#: A small lexicon that fits the invented prose.
HIGH, LOW, SUFFIXES = ["tion", "ntre", "hean", "oner"], ["thth", "anan"], ("ble", "ing")
_list = lambda x: ", ".join(f"'{v}'" for v in x)
_KEEP = f"(t IN ({_list(HIGH)}) OR NOT (t IN ({_list(T.STOP_WORDS)}) OR length(t) <= 2)) AND t NOT IN ({_list(LOW)})"


def _weight_sql(t: str) -> str:
    ends = " OR ".join(f"ends_with({t}, '{s}')" for s in SUFFIXES)
    return f"round(greatest(0.1, least((1.0::DOUBLE + CASE WHEN {t} IN ({_list(HIGH)}) THEN 1.2 ELSE 0 END + CASE WHEN contains({t}, '-') THEN 0.7 ELSE 0 END + CASE WHEN regexp_full_match({t}, '[a-z]{{2,12}}(?:-[a-z0-9]{{2,12}})?') AND {t} NOT IN ({_list(T.STOP_WORDS)}) THEN 0.5 ELSE 0 END + CASE WHEN {ends} THEN 0.35 ELSE 0 END) * CASE WHEN {t} IN ({_list(LOW)}) THEN 0.45 ELSE 1 END * CASE WHEN regexp_full_match({t}, '[0-9]+') THEN 0.6 ELSE 1 END, 3.0)), 4)"


_KEPT = f"kept AS (SELECT qid, list_filter({tokens_sql(title_sql('query_text'), False)}, lambda t: {_KEEP}) AS ts FROM bq)"
_WTERMS = f"wt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, length(term) DESC, term) AS place FROM (SELECT qid, term, {_weight_sql('term')} AS weight FROM (SELECT DISTINCT qid, unnest(ts) AS term FROM kept))) WHERE place <= 24)"
_TOK = "tk AS (SELECT qid, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM kept)"
_LEADS = ["t"] + [f"lead(t, {k}) OVER x" for k in (1, 2, 3)]
_USEFUL = "len(list_filter(string_split(phrase, ' '), lambda t: t IN (" + _list(HIGH) + ") OR contains(t, '-') OR " + " OR ".join(f"ends_with(t, '{s}')" for s in SUFFIXES) + ")) > 0"
_WPHRASES = (
    f"{_TOK}, gr AS (SELECT DISTINCT qid, phrase FROM (" + " UNION ALL ".join(f"SELECT qid, {' || chr(32) || '.join(_LEADS[:n])} AS phrase FROM tk WINDOW x AS (PARTITION BY qid ORDER BY i)" for n in (4, 3, 2)) + f") WHERE phrase IS NOT NULL AND {_USEFUL}), "
    f"wp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, length(phrase) DESC, phrase) AS place FROM (SELECT qid, phrase, round(least(4.5, list_max(list_transform(string_split(phrase, ' '), lambda t: {_weight_sql('t')})) + 0.55 * (len(string_split(phrase, ' ')) - 1)), 4) AS weight FROM gr)) WHERE place <= 12)"
)
_ALL = f"WITH {BENCHMARK_QUERIES}, {_KEPT}, {_WTERMS}, {_WPHRASES}"
_MAP = "mp AS (SELECT qid, token, max(weight) AS weight FROM (SELECT qid, term AS token, weight FROM wt UNION ALL SELECT qid, unnest(string_split(phrase, ' ')), least(2.4, 0.7 * weight) FROM wp) GROUP BY ALL)"


def terms(spark, d):
    return intent.weighted_terms(benchmark_queries(spark, d), HIGH, LOW, SUFFIXES)


def phrases(spark, d):
    return intent.weighted_phrases(benchmark_queries(spark, d), HIGH, LOW, SUFFIXES)


@query("q12_weighted_terms", f"WITH {BENCHMARK_QUERIES}, {_KEPT} SELECT DISTINCT qid, term, {_weight_sql('term')} AS weight FROM (SELECT qid, unnest(ts) AS term FROM kept)")
def q12(spark, d):
    return intent.weighted_terms(benchmark_queries(spark, d), HIGH, LOW, SUFFIXES, 1 << 30).drop("place")


@query("q13_weighted_phrases", f"{_ALL} SELECT qid, phrase, weight, place FROM wp")
def q13(spark, d):
    return phrases(spark, d).withColumn("place", c("place").cast("long"))


@query("q15_deduplicated_terms", f"{_ALL} SELECT qid, string_agg(term, ' ' ORDER BY place) AS clean_query FROM wt WHERE place <= 16 GROUP BY qid")
def q15(spark, d):
    head = terms(spark, d).where("place <= 16")
    return head.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " ").alias("clean_query"))


@query("q16_token_map", f"{_ALL}, {_MAP} SELECT qid, token, round(weight, 6) AS weight FROM mp")
def q16(spark, d):
    return intent.token_map(terms(spark, d), phrases(spark, d)).withColumn("weight", F.round("weight", 6))


@query("q17_sparse_features", f"{_ALL}, {_MAP} SELECT qid, token AS feature, round(weight, 6) AS weight FROM mp UNION ALL SELECT qid, 'phrase:' || phrase, round(weight, 6) FROM wp")
def q17(spark, d):
    return intent.sparse_features(terms(spark, d), phrases(spark, d)).withColumn("weight", F.round("weight", 6))


@query("q33_noise_filter", f"SELECT item_id, array_to_string(CASE WHEN len(list_filter(ts, lambda t: t NOT IN ('with', 'from', 'tion'))) > 0 THEN list_filter(ts, lambda t: t NOT IN ('with', 'from', 'tion')) ELSE ts END, ' ') AS terms FROM (SELECT item_id, {tokens_sql('text', False)} AS ts FROM benchmark)")
def q33(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(intent.without_noise(T.tokens(c("text"), ()), ["with", "from", "tion"]), " ").alias("terms"))


@query("a17_action_metrics", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS a, l_suppkey % 3 AS b FROM lineitem)
    SELECT count(*) AS total, round(count(*) FILTER (a = b) / count(*), 6) AS exact_match, round(count(*) FILTER (l_linenumber <> 7) / count(*), 6) AS parse_rate, round(count(*) FILTER ((a = 0) = (b = 0 OR l_linenumber = 7)) / count(*), 6) AS stop_accuracy,
    round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1
    FROM (SELECT *, least(a, p) AS tp, p - least(a, p) AS fp, a - least(a, p) AS fn FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 0 ELSE b END AS p FROM x))""".replace("count(*) FILTER (a = b)", "count(*) FILTER (a = b AND l_linenumber <> 7)"))
def a17(spark, d):
    expand = lambda n: F.concat(F.when(n >= 1, "[Expand] One ").otherwise(""), F.when(n >= 2, "[Expand]Two").otherwise(""), F.lit("[StopExpand]"))
    x = table(spark, d, "lineitem").select(expand(c("l_partkey") % 3).alias("label"), F.concat(expand(c("l_suppkey") % 3), F.when(c("l_linenumber") == 7, "?").otherwise("")).alias("prediction"))
    return intent.action_metrics(x, "label", "prediction")
