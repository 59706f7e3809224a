"""URL filters: fixed host and path rules, and association rules mined by FP-growth for the other URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, settled, small

#: verdict and host with path, as fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SUPPORT, CONFIDENCE = 0.002, 0.8
BROADCAST_ROWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with its."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, start = rule.split("/", 1)
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{start}"))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: every label of the host (top-level domain apart) and every path segment; numbers as #."""
    labels = F.split(host, r"\.")
    segment = F.filter(F.split(path, "/"), lambda x: x != "")
    segment = F.transform(segment, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("t:"), F.element_at(labels, -1))), F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.concat(F.lit("h:"), x)), segment))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """rule_id, tokens, verdict, confidence, support: rules from token combinations to a verdict.

    labelled has tokens and verdict. FP-growth runs inside Spark; rules below either bound go, and so do rules of which
    a part is a rule for the same verdict with no less confidence.
    """
    rows = labelled.select(F.array_append("tokens", F.concat(F.lit("="), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    rules = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("=")))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 1 << 20).alias("verdict"), "confidence", "support")
    rules = settled(rules.withColumn("rule_id", F.xxhash64("tokens", "verdict")))
    one = rules.select("rule_id", "verdict", "confidence", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    a, b = one.alias("a"), one.alias("b")
    # b's tokens are all among a's
    parts = a.join(b, "token").where("a.verdict = b.verdict and b.size < a.size and b.confidence >= a.confidence")
    parts = parts.groupBy(F.col("a.rule_id").alias("rule_id"), F.col("b.rule_id").alias("part"), F.col("b.size").alias("size")).count().where("count = size")
    return rules.join(parts.select("rule_id").distinct(), "rule_id", "left_anti")


def same_cover(labelled: DataFrame, support: float = SUPPORT) -> DataFrame:
    """first, token: for each frequent token of labelled rows, the least token that is in exactly the same rows.

    Of two such tokens a rule never needs both: the rule without one of them is as confident, and prunes it. Left in, k
    tokens that always come together would make 2 ** k itemsets. Rows are told by sums of hashes of what they hold, which
    are added up before the shuffle. There are at most (tokens of a row on average) / support frequent tokens.
    """
    rows = labelled.select(F.explode(F.array_distinct("tokens")).alias("token"), F.xxhash64("tokens", "verdict").cast("decimal(20,0)").alias("h"))
    covers = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("h").alias("h")).where(F.col("n") >= support * labelled.count())
    same = covers.groupBy("n", "h").agg(F.array_sort(F.collect_list("token")).alias("same"))
    return settled(same.select(F.col("same")[0].alias("first"), F.explode("same").alias("token")))


def judge(spark: SparkSession, pages: DataFrame, rules: tuple = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict for every page: the longest fixed rule's, else the mined rules', else allow.

    Pages with a fixed rule are the labelled ones. Each distinct combination of tokens is matched once: its tokens meet
    the mined rules in an inverted index by token, and a rule fits if all its tokens are met; a token that is in the same
    labelled rows as one of the rule's stands for it. The most confident rule decides, then the one of most support, then block before allow. A busy host is few combinations, so no task meets
    all its pages.

    Null URLs and those without `://` have empty host and path, no rule and no tokens, and so are allowed. Repeated rows
    and ids are judged row by row. A very long URL has all its segments as tokens. An empty table gives no rows; other
    columns are not used.
    Columns: page_id, host, path, rule, verdict.
    """
    prepared(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    rows = rows.withColumn("fixed", rule_of(F.col("host"), F.col("path"), rules)).withColumn("tokens", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_sort(tokens_of(F.col("host"), F.col("path")))))
    labelled = rows.where("fixed is not null").select("tokens", F.col("fixed.verdict").alias("verdict"))
    same = same_cover(labelled, support)
    spare = [r["token"] for r in same.where("token <> first").select("token").collect()]  # as bounded as FP-growth's own list of frequent items
    found = mined(labelled.withColumn("tokens", F.filter("tokens", lambda t: ~t.isin(spare))) if spare else labelled, support, confidence)
    index = found.select("rule_id", "verdict", "confidence", "support", F.size("tokens").alias("size"), F.explode("tokens").alias("first")).join(same, "first")
    open_sets = rows.where("fixed is null").select("tokens").distinct()
    met = open_sets.select("tokens", F.explode("tokens").alias("token")).join(small(index, BROADCAST_ROWS), "token")
    met = met.groupBy("tokens", "rule_id", "verdict", "confidence", "support", "size").agg(F.size(F.collect_set("first")).alias("met")).where("met = size")
    best = met.groupBy("tokens").agg(F.max_by("verdict", F.struct("confidence", "support", "verdict")).alias("mined"))
    out = rows.join(small(settled(best), BROADCAST_ROWS), "tokens", "left")
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", F.when(F.col("fixed").isNull(), F.col("mined")), F.lit("allow")).alias("verdict"))
