"""Evaluation of ranked results against gold labels, sampling and diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.sources.tables import held, small


def metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame, cutoffs: list[int]) -> DataFrame:
    """qid, k, hits, gold_count, precision, recall, f1, mrr, hit for every query and cutoff; precision divides by k.

    ranked: qid, paper_id, rank. Hits and first ranks come from one join; a query without results has zeros.
    """
    total = gold.groupBy("qid").agg(F.count_distinct("paper_id").alias("gold_count"))
    hits = ranked.join(gold.distinct(), ["qid", "paper_id"])
    per = hits.groupBy("qid").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in cutoffs), F.min("rank").alias("first"))
    base = queries.select("qid").distinct().join(total, "qid", "left").join(per, "qid", "left")
    rows = base.select("qid", F.coalesce("gold_count", F.lit(0)).alias("gold_count"), "first", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("hits")) for k in cutoffs))).alias("x")).select("qid", "gold_count", "first", "x.*")
    p, r = F.col("hits") / F.col("k"), F.when(F.col("gold_count") > 0, F.col("hits") / F.col("gold_count")).otherwise(0.0)
    rows = rows.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.select("qid", "k", "hits", "gold_count", "precision", "recall", f1.alias("f1"), F.when(F.col("first") <= F.col("k"), 1 / F.col("first")).otherwise(0.0).alias("mrr"), (F.col("hits") > 0).cast("int").alias("hit"))


def summary(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Macro averages overall and for each group, by cutoff; the overall row has nulls for the group."""
    sets = rows.groupingSets([["k"], ["k", *groups]], "k", *groups)
    return sets.agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1", "mrr")), F.round(F.avg("hit"), 6).alias("hit_rate"), F.sum("hits").alias("hits"))


def hit_ranks(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Every gold paper with its first rank, null if it was missed."""
    best = ranked.groupBy("qid", "paper_id").agg(F.min("rank").alias("rank"))
    return gold.select("qid", "paper_id").distinct().join(best, ["qid", "paper_id"], "left")


#: Reasons in order, with their stage: fixed values.
REASONS = (
    ("query_intent_blocked_or_empty_plan", "query_intent"), ("retrieval_empty", "multi_source_retrieval"), ("gold_retrieved_but_ranked_below_cutoff", "selector_reranker_or_rule_ranker"),
    ("gold_not_found_in_diagnostic_pool", "query_understanding_and_retrieval"), ("large_gold_set_topk_ceiling", "coverage_iteration_or_evaluation_k"), ("top_results_miss_required_constraints", "query_understanding_or_coverage_iteration"),
    ("model_service_errors_present", "model_service_infra"), ("partial_recall_needs_better_ranking_or_expansion", "selector_reranker_or_retrieval_expansion"), ("acceptable_for_current_cutoff", "monitor"),
)


def diagnosis(planned: Column, returned: Column, hits: Column, pool_hits: Column, gold_count: Column, k: int, missing: Column, errors: Column) -> Column:
    """struct(reason, stage): the first condition that holds."""
    recall, ceiling = hits / gold_count, F.least(F.lit(1.0), k / gold_count)
    tests = [planned == 0, returned == 0, (hits == 0) & (pool_hits > 0), hits == 0, (recall < 0.5) & (ceiling <= 0.5), missing > 0, errors > 0, recall < 0.5, F.lit(True)]
    found = None
    for test, (reason, stage) in reversed(list(zip(tests, REASONS, strict=True))):
        row = F.struct(F.lit(reason).alias("reason"), F.lit(stage).alias("stage"))
        found = row if found is None else F.when(test, row).otherwise(found)
    return found


def uncovered(plans: DataFrame, head: DataFrame) -> DataFrame:
    """qid, missing: how many of a query's constraints none of its first papers holds as whole words. plans: qid, must_have;
    head: qid, body of those papers. A query without papers misses all; one without constraints misses none."""
    texts = head.select("qid", F.concat(F.lit(" "), T.normalize_title(F.col("body")), F.lit(" ")).alias("body"))
    # told within each paper's row: per constraint whether it is there
    there = lambda must: F.contains(F.col("body"), F.concat(F.lit(" "), T.normalize_title(must), F.lit(" ")))
    met = texts.join(small(plans.select("qid", "must_have")), "qid").select("qid", F.explode(F.filter("must_have", there)).alias("must")).groupBy("qid").agg(F.collect_set("must").alias("met"))
    rows = plans.select("qid", "must_have").join(met, "qid", "left")
    return rows.select("qid", F.size(F.array_except("must_have", F.coalesce("met", F.array().cast("array<string>")))).cast("long").alias("missing"))


def plan_outcomes(plans: DataFrame, hits: DataFrame, met: DataFrame, missing: DataFrame, failed: DataFrame) -> DataFrame:
    """What diagnosis() judges, a row for each query with gold papers. plans: qid, planned; hits: a row per returned paper;
    met: qid, gold_count, hits, pool_hits; missing: qid, missing; failed: a row per failed call of a model."""
    counted = lambda df, name: df.groupBy("qid").agg(F.count("*").alias(name))
    rows = plans.select("qid", "planned").join(met, "qid").join(counted(hits, "returned"), "qid", "left").join(missing, "qid", "left").join(counted(failed, "errors"), "qid", "left")
    return rows.select("qid", "planned", F.coalesce("returned", F.lit(0)).alias("returned"), "gold_count", "hits", "pool_hits", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("errors", F.lit(0)).alias("errors"))


def shard(keys: list[str], n: int) -> Column:
    return F.pmod(F.crc32(F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))), F.lit(n))


def balanced_sample(rows: DataFrame, groups: list[str], order: list, total: int) -> DataFrame:
    """Round-robin over the groups: all first rows, then all second rows, until `total` rows."""
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return turn.orderBy("turn", *groups, *order).limit(total)


def proportional_quotas(sizes: DataFrame, groups: list[str], total: int) -> DataFrame:
    """quota of each group (groups, n): its share rounded down, at least one where there are places for all groups; what
    then is left goes to the largest remainders as far as they have rows, and what is too much is taken, one by one, from
    the smallest remainders. Groups are few rows, so their order needs no partition."""
    every = Window.partitionBy()
    all_n = F.sum("n").over(every)
    x = sizes.withColumn("target", F.least(F.lit(total), all_n)).withColumn("exact", F.col("target") * F.col("n") / all_n).withColumn("base", F.least("n", F.floor("exact")))
    x = x.withColumn("rest", F.round(F.col("exact") - F.col("base"), 9)).withColumn("least", (F.col("target") >= F.count("*").over(every)).cast("long"))
    x = x.withColumn("base", F.greatest("base", "least")).withColumn("room", F.col("n") - F.col("base")).withColumn("left", F.col("target") - F.sum("base").over(every))
    before = Window.orderBy(F.desc("rest"), *groups).rowsBetween(Window.unboundedPreceding, -1)
    more = F.greatest(F.lit(0), F.least("room", F.col("left") - F.coalesce(F.sum("room").over(before), F.lit(0))))
    x = x.withColumn("more", more)
    # one unit from each group in a turn, smallest remainders first
    units = x.where("left < 0 and base > least").select(*groups, "rest", "left", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("base") - F.col("least"), -F.col("left")))).alias("turn"))
    taken = units.withColumn("i", F.row_number().over(Window.orderBy("turn", "rest", *groups))).where("i <= -left").groupBy(*groups).agg(F.count("*").alias("less"))
    return x.join(taken, groups, "left").select(*groups, (F.col("base") + F.col("more") - F.coalesce("less", F.lit(0))).alias("quota"))


def proportional_sample(rows: DataFrame, groups: list[str], order: list, total: int) -> DataFrame:
    """Rows of each group in proportion, as proportional_quotas says, in the given order."""
    quota = proportional_quotas(rows.groupBy(*groups).agg(F.count("*").alias("n")), groups, total)
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return turn.join(small(quota), groups).where(F.col("turn") <= F.col("quota")).drop("quota")


def hash_sample(rows: DataFrame, key: Column, tie: list, n: int) -> DataFrame:
    """The n rows of the smallest keys (hexadecimal hashes), then by `tie`. Counts by the keys' first four digits, 65,536 at
    most, tell from where on a row is out; only rows with the boundary's digits are put in order."""
    rows = rows.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, 4))
    left, edge = n, None
    for r in sorted(rows.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        if r["count"] >= left:
            edge = r["_part"]
            break
        left -= r["count"]
    if edge is None:
        return rows.drop("_key", "_part")
    tail = rows.where(F.col("_part") == edge).orderBy("_key", *tie).limit(left)
    return rows.where(F.col("_part") < edge).unionByName(tail).drop("_key", "_part")


def threshold_sweep(rows: DataFrame, score: str, label: str, slices: int = 64) -> DataFrame:
    """score, tp, fp, accuracy, f1, precision, recall with everything from this score up taken as positive: one row for each
    score. Scores are dealt into ranges; totals of the ranges before (few rows) are added to the running sums within."""
    by = held(rows.groupBy(F.col(score).alias("score")).agg(F.sum(label).cast("long").alias("p"), F.count("*").alias("n")))
    total = by.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    dealt = held(by.repartitionByRange(slices, F.desc("score")).withColumn("slice", F.spark_partition_id()))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("slice").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn")).select("slice", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("bn"))
    run = Window.partitionBy("slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = dealt.select("slice", "score", "p", F.sum("p").over(run).alias("rp"), F.sum("n").over(run).alias("rn")).join(F.broadcast(base), "slice")
    tp, seen, pos, all_n = F.col("rp") + F.col("bp"), F.col("rn") + F.col("bn"), F.lit(total["pos"]), F.lit(total["all"])
    x = x.select("score", "p", tp.alias("tp"), (seen - tp).alias("fp"))
    tp, fp = F.col("tp"), F.col("fp")
    return x.select("score", "p", "tp", "fp", ((tp + all_n - pos - fp) / all_n).alias("accuracy"), (2 * tp / (tp + fp + pos)).alias("f1"), (tp / (tp + fp)).alias("precision"), (tp / F.nullif(pos, F.lit(0))).alias("recall"))


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """One row: the best accuracy and F1 with their scores (the higher of equals), average precision, and the least and the
    mean of the two best values."""
    best = lambda x: F.max_by(F.struct(F.col(x), "score"), F.struct(F.round(x, 12), "score"))
    one = sweep.agg(best("accuracy").alias("a"), best("f1").alias("f"), (F.sum(F.col("precision") * F.col("p")) / F.sum("p")).alias("average_precision"))
    a, f = F.col("a.accuracy"), F.col("f.f1")
    return one.select(a.alias("best_accuracy"), F.col("a.score").alias("accuracy_threshold"), f.alias("best_f1"), F.col("f.score").alias("f1_threshold"), "average_precision", F.least(a, f).alias("least"), ((a + f) / 2).alias("mean"))


def macro(classes: DataFrame, right: Column) -> DataFrame:
    """Accuracy and the plain means of precision, recall and F1 over the classes (rows of classification)."""
    return classes.agg((F.sum(right) / F.sum("support")).alias("accuracy"), *(F.avg(x).alias(f"macro_{x}") for x in ("precision", "recall", "f1")))


def classification(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """label, support, precision, recall, f1 for every class, from one confusion table."""
    cells = rows.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    each = cells.select(F.explode(F.array(F.struct(F.col("l").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hits")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))).alias("x")).select("x.*")
    sums = each.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "hits")))
    p = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    return sums.select("label", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
