"""Personal data: fixed patterns, and contextual patterns bootstrapped from what they find. DataFrame functions only."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, settled

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, as fixed values, written so that Java neither recurses over long runs nor starts anew inside one:
#: a look-behind or \G lets a match begin only where a run begins or the last match ended, and quantifiers are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?[\[(](?:at|AT)[\])]\x20?", r"\x20?[\[(](?:dot|DOT|\.)[\])]\x20?"
#: A word, its mark, and what follows: an e-mail, plain or written out; four short numbers, plain or written out; number-like.
CONTEXT = (
    r"(?:\G|(?<!\p{L}))\p{L}{2,24}+[:=#]?[\x20\t]{1,2}+(?:"
    rf"[A-Za-z0-9._%+-]{{1,64}}+(?:@|{_AT})[A-Za-z0-9-]{{1,64}}+(?:(?:\.|{_DOT})[A-Za-z0-9-]{{1,64}}+)++"
    rf"|[0-9]{{1,3}}+(?:(?:[.\x20-]|{_DOT})[0-9]{{1,3}}+){{3}}+(?![.\x20-]?[0-9])"
    r"|[+(]?[0-9][0-9().\x20-]{6,28}[0-9])"
)
_LEFT = r"^\p{L}+[:=#]?[\x20\t]+"
#: A pattern is trusted from so many different known identifiers, at that confidence.
SEEDS, CONFIDENCE = 5, 0.8
#: Its confidence less so many standard errors must beat the usual share, or reach what is SURE.
ERRORS, SURE = 2.0, 0.95
ROUNDS = 3
#: Trusted words up to which they are part of the plan.
WORDS = 20_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    """number: 13 to 19 digits."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = F.transform(F.split(F.reverse(number), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    return F.aggregate(F.transform(digit, lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d)), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _fits(kind: str, x: Column) -> Column:
    """What the pattern alone does not say."""
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: p.cast("double") <= 255)
    n = F.length(_digits(x))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(x))).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def _bound(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: Elements of a part of an array that is summed up by itself: so running totals take no copy of the whole per element.
PART = 128


def _running(values: Column, start: Column, add) -> Column:
    """add(... add(add(start, values[0]), values[1]) ..., values[i]) for each i; add is associative."""
    parts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PART).cast("int"))).otherwise(F.array().cast("array<int>"))
    part = lambda k: F.slice(values, k * PART + 1, F.lit(PART))

    def totals(xs: Column, first: Column) -> Column:
        empty = F.struct(first.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, empty, lambda a, x: _bound(add(a["at"], x), lambda y: F.struct(y.alias("at"), F.array_append(a["all"], y).alias("all"))), lambda a: a["all"])

    whole = F.transform(parts, lambda k: F.aggregate(part(k), start, add))
    before = _bound(whole, lambda w: F.concat(F.array(start), totals(w, start)))
    return _bound(before, lambda w: F.flatten(F.transform(parts, lambda k: totals(part(k), F.get(w, k)))))


def _placed(text: Column, pattern: str, there: Column, keep) -> Column:
    """Spans (start, end, value) of successive matches in code points; there: a test that spares most texts the pattern;
    keep: a test of a match. Places are sums of the lengths of the matches and of the pieces that they part the text in,
    so a text of many matches takes no longer than its length."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    matches = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def spans(found: Column) -> Column:
        sizes = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.length(gap) + F.length(m))
        ends = _bound(sizes, lambda x: _running(x, F.lit(0), lambda a, y: a + y))
        placed = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
        return F.when(F.size(found) > 0, F.filter(placed, lambda s: keep(s["value"]))).otherwise(none)

    return _bound(matches, spans)


def _base(text: Column) -> dict[str, Column]:
    """For each kind, its spans, leftmost and without overlaps."""
    # what a text must hold for any match: simple scans, which spare most texts the patterns
    there = {"email": F.contains(text, F.lit("@")), "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]")), "card": F.rlike(text, F.lit(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")), "phone": F.contains(text, F.lit("+"))}
    return {k: _placed(text, PATTERNS[k], there[k], partial(_fits, k)) for k in KINDS}


def _candidates(text: Column) -> Column:
    """Spans of identifier-like strings after a word, with that word (lower case, with its mark), a normal form and, of four short numbers, the address."""
    there = F.rlike(text, F.lit(r"[0-9]{2}|[0-9]\.[0-9]|@|[\[(](?:at|AT|dot|DOT|\.)[\])]"))

    def part(s: Column) -> Column:
        value = F.regexp_replace(s["value"], _LEFT, "")
        word = F.lower(F.regexp_replace(F.regexp_extract(s["value"], _LEFT, 0), r"[\x20\t]+", ""))
        mail = F.lower(F.regexp_replace(F.regexp_replace(value, _AT, "@"), _DOT, "."))
        form = F.when(F.rlike(mail, F.lit("@")), mail).otherwise(_digits(value))
        dotted = F.regexp_replace(F.regexp_replace(value, _DOT, "."), r"[\x20-]", ".")
        ip = F.when(F.rlike(dotted, F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")), F.when(_fits("ip", dotted), dotted))
        return F.struct((s["end"] - F.length(value)).alias("start"), s["end"].alias("end"), word.alias("word"), form.alias("form"), ip.alias("ip"))

    return F.transform(_placed(text, CONTEXT, there, lambda m: F.lit(True)), part)


def _shape(form: Column) -> Column:
    """The kind that a string not known as personal data could be, besides an ip: by letters, or by the number of digits."""
    n = F.length(form)
    return F.when(F.contains(form, F.lit("@")), "email").when((n >= 13) & (n <= 19), "card").when((n >= 7) & (n <= 15), "phone")


def _kinds(c: Column, known: Column) -> Column:
    """(kind, form, known) of a candidate: its kind if it is known, else what it could be; four short numbers may be two things."""
    own = F.array(F.struct(known.alias("kind"), F.when(known == "ip", F.coalesce(c["ip"], c["form"])).otherwise(c["form"]).alias("form"), F.lit(True).alias("known")))
    could = F.array(F.struct(_shape(c["form"]).alias("kind"), c["form"].alias("form"), F.lit(False).alias("known")), F.struct(F.when(c["ip"].isNotNull(), "ip").alias("kind"), c["ip"].alias("form"), F.lit(False).alias("known")))
    return F.when(known.isNotNull(), own).otherwise(F.filter(could, lambda x: x["kind"].isNotNull()))


def patterns(candidates: DataFrame) -> DataFrame:
    """word, kind, confidence of trusted contexts. candidates: word, form, kind, known (false if only the shape says so).

    The graph has words on one side and identifiers on the other. An identifier's score starts at 1 if it is known and 0
    else; a word's confidence for a kind is its identifiers' mean score; an unknown identifier's score becomes the
    chance that any of its words is right. What reaches CONFIDENCE counts as a seed from the next round on.

    A word must beat the share of known ones after the other words of its kind, so that where most number-like strings
    are personal data anyway, plain words prove nothing; a word that is SURE needs no comparison, so that no usual share
    rules all words out. Written-out e-mails need none either: little else looks like them. Both tests are of the lower
    Wilson bound.
    """
    edges = settled(candidates.groupBy("word", "form", "kind").agg(F.max("known").alias("known")))
    all_n, all_known = F.lit(0), F.lit(0)
    for r in edges.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("known").alias("known")).collect():  # a row for each kind
        all_n, all_known = (F.when(F.col("kind") == r["kind"], F.lit(r[x])).otherwise(total) for x, total in (("n", all_n), ("known", all_known)))
    scores = edges.groupBy("form", "kind").agg(F.max(F.col("known").cast("double")).alias("score"))
    n, p, z = F.col("n"), F.col("confidence"), ERRORS
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    share = (all_known - F.col("own") + 0.5) / (all_n - n + 1)
    words = None
    for _ in range(ROUNDS):
        words = edges.join(scores, ["form", "kind"]).groupBy("word", "kind").agg(F.avg("score").alias("confidence"), F.count_if(F.col("score") >= CONFIDENCE).alias("seeds"), F.count("*").alias("n"), F.count_if("known").alias("own"))
        words = words.where((F.col("seeds") >= SEEDS) & (p >= CONFIDENCE) & ((F.col("kind") == "email") | (bound >= F.least(share, F.lit(SURE)))))
        wrong = edges.join(words, ["word", "kind"], "left").groupBy("form", "kind").agg(F.max("known").alias("known"), F.exp(F.sum(F.log1p(-F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999))))).alias("wrong"))
        scores = settled(wrong.select("form", "kind", F.when(F.col("known"), 1.0).otherwise(1 - F.col("wrong")).alias("score")))
    return words.select("word", "kind", "confidence")


def _inside(s: Column, b: Column) -> Column:
    return (s["start"] < b["end"]) & (b["start"] < s["end"])


def _open(text: Column, base: Column) -> Column:
    """What candidates outside the base spans could be: word, kind, start, end, form."""
    def could(c: Column) -> Column:
        one = lambda kind, form: F.struct(c["word"].alias("word"), kind.alias("kind"), c["start"].alias("start"), c["end"].alias("end"), form.alias("form"))
        return F.filter(F.array(one(F.when(c["ip"].isNotNull(), "ip"), c["ip"]), one(_shape(c["form"]), c["form"])), lambda x: x["kind"].isNotNull())

    return F.flatten(F.transform(F.filter(_candidates(text), lambda c: ~F.exists(base, lambda b: _inside(c, b))), could))


def find(spark: SparkSession, docs: DataFrame, text_col: str = "text", base: str = "base", spans: str = "spans", words: int = WORDS) -> DataFrame:
    """The rows with base (spans of the four fixed patterns) and spans (those and what trusted contexts discover).

    A span is a struct of kind, start, end, in code points. Both are ordered by kind as in KINDS, then start. Discovered
    spans overlap no base span; what could be an ip or something else after words that are trusted for both is an ip.
    Contexts are learned from all rows; the trusted ones (words that precede at least SEEDS different known or discovered
    identifiers, more surely than others) go to each task with the plan, or, if there are more than `words`, are joined.

    A null text is empty and has no spans. Rows are judged one by one, so repeated rows and null ids are kept as they
    are. An empty table gives no rows. All columns are kept, but for clashing ones named as base and spans say.
    """
    prepared(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda k, x: F.transform(x, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    whole = F.concat(*(named(k, x) for k, x in _base(text).items()))

    # the kind of a candidate that is a base span is told within the row, so that rows of candidates do not carry all spans
    kind = lambda c, spans: F.get(F.filter(spans, lambda s: _inside(c, s)), F.lit(0))["kind"]
    told = _bound(whole, lambda spans: F.transform(_candidates(text), lambda c: F.struct(c.alias("c"), kind(c, spans).alias("known"))))
    seen = docs.select(F.explode(told).alias("x"))
    trusted = settled(patterns(seen.select("x.c.word", F.explode(_kinds(F.col("x.c"), F.col("x.known"))).alias("k")).select("word", "k.*")).select("word", "kind"))

    out = docs.withColumn(base, whole)
    if (n := trusted.count()) == 0:
        return out.withColumn(spans, F.col(base))
    if n <= words:
        pairs = F.lit([f"{r['kind']} {r['word']}" for r in trusted.orderBy("kind", "word").collect()])
        new = F.filter(_open(text, F.col(base)), lambda c: F.array_contains(pairs, F.concat_ws(" ", c["kind"], c["word"])))
        return out.withColumn(spans, _all(F.col(base), new))
    # the same by a join: spans found are a function of the text, which its hash stands for
    key, new = "litgrid_pii_text_key", "litgrid_pii_new"
    each = docs.select(F.xxhash64(text).alias(key), text.alias("t"), whole.alias("b")).select(key, F.explode(_open(F.col("t"), F.col("b"))).alias("c"))
    each = each.select(key, "c.*").distinct().join(trusted, ["word", "kind"]).groupBy(key).agg(F.collect_list(F.struct("word", "kind", "start", "end", "form")).alias(new))
    out = out.withColumn(key, F.xxhash64(text)).join(settled(each), key, "left")
    return out.withColumn(spans, F.when(F.col(new).isNull(), F.col(base)).otherwise(_all(F.col(base), F.col(new)))).select(*docs.columns, *(x for x in (base, spans) if x not in docs.columns))


def _all(base: Column, new: Column) -> Column:
    """base and the trusted candidates, in order; of one that two kinds are trusted for, the ip."""
    def merged(found: Column) -> Column:
        ips = F.filter(found, lambda c: c["kind"] == "ip")
        rest = F.filter(found, lambda c: (c["kind"] == "ip") | ~F.exists(ips, lambda i: _inside(c, i)))
        span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
        return F.flatten(F.array(*(F.array_sort(F.concat(_of(k, base), F.transform(_of(k, rest), span)), lambda a, b: a["start"] - b["start"]) for k in KINDS)))

    return F.when(F.size(new) > 0, _bound(new, merged)).otherwise(base)


def _of(kind: str, spans: str | Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the SHA-256 of their list, and all spans as text."""
    n = [F.size(_of(k, "base")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col(id_col), *n, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become the first one's kind.

    A null text stays null. The columns are those of docs, whatever their names; n_chars, if there, is counted anew.
    Repeated rows stay; an empty table gives no rows. Placing and replacing take time in proportion to the text; candidates
    are compared with each of the same text's base spans, so a text of very many thousands of spans takes longer than that.
    """
    columns, text, base, spans = docs.columns, F.col(text_col), "litgrid_pii_base", "litgrid_pii_spans"

    def clean(ordered: Column) -> Column:
        past = _bound(F.transform(ordered, lambda s: s["end"]), lambda e: _running(e, F.lit(0), lambda a, x: F.greatest(a, x)))
        return _bound(past, lambda p: _bound(F.split(text, ""), lambda chars: joined(ordered, p, chars)))

    def joined(ordered: Column, past: Column, chars: Column) -> Column:
        # from the end of all earlier spans to the start of each
        put = lambda s, at: F.when(s["start"] >= at, F.concat(F.array_join(F.slice(chars, at + 1, s["start"] - at), ""), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        parts = F.zip_with(ordered, F.slice(F.concat(F.array(F.lit(0)), past), F.lit(1), F.size(ordered)), put)
        last = F.element_at(past, -1)
        return F.concat(F.array_join(parts, ""), F.array_join(F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0))), ""))

    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    out = find(spark, docs, text_col, base, spans).withColumn(text_col, F.when(F.size(spans) > 0, _bound(ordered, clean)).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)
