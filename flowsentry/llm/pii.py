"""Personal data: seed patterns, then identifiers found by bootstrapped contextual extraction.

The spans of the four base kinds are the seeds, whole, with their spaces and brackets. Candidates
are identifier-like tokens (a run of letters, digits and ._%+@- with a digit) and runs of groups of
digits with single spaces or brackets between them. Seeds and candidates stand in a lexical pattern:
the word before them and what separates them. Patterns and values form a graph. A pattern's
confidence in a kind is the mean score of its values, a value's score is 1 for a seed and otherwise
grows with the confidence of its patterns; a few rounds of joins settle both. Candidates in patterns
of high confidence are found as that kind although no base pattern fits them. Everything is
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.session import cut

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that a failing start is not tried again inside the same run: each
# matches what its plain form matches, in linear time and without recursion on long runs.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]*+[0-9])[A-Za-z0-9._%+@-]++"
_GROUP = r"[0-9]++(?:[.-][0-9]++)*+(?![A-Za-z0-9_%+@]|[.-][A-Za-z0-9_%+@])"
#: Two groups of digits or more, such as (017) 555-7713 or 4111 1111 1111 1111.
RUN = rf"(?<![A-Za-z0-9._%+@-])\(?+\+?+{_GROUP}(?:\)?+\x20?+\(?+{_GROUP})++"
CANDIDATES = {"token": TOKEN, "run": RUN}
#: What a text must contain for a kind to be looked for.
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "token": r"[0-9]", "run": r"[0-9][\x20()]"}

#: Characters of context kept before a match; least length and number of digits of what is newly found.
CONTEXT = 48
TOKEN_CHARS, TOKEN_DIGITS = 6, 4
#: Rounds of scoring; confidence and number of different seed values that a pattern needs; weight of doubt in its mean.
ROUNDS = 4
CONFIDENCE, SUPPORT, DOUBT = 0.9, 3, 1.0
#: How much of its patterns' confidence a value that is no seed can reach.
INHERITED = 0.9


def _matches(kind: str) -> Column:
    """array<struct<kind, i, gap, pre, match>>: the leftmost non-overlapping matches, each with the length of the text since the last one and the end of all text before it."""
    pattern = CANDIDATES.get(kind) or PATTERNS[kind]
    text = F.col("_text")
    found = F.when(text.rlike(_HINTS[kind]), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    parts = F.split(text, pattern, -1)
    # The context goes back over the match before, whose last word may stand right before this one.
    before = [F.slice(F.concat(F.array(F.lit("")), x), 1, F.size(found)) for x in (parts, found)]
    tail = lambda x: F.substring(x, -CONTEXT, CONTEXT)
    rows = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(parts, 1, F.size(found)).alias("g"), before[0].alias("pg"), before[1].alias("pm")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.char_length(x["g"]).cast("long").alias("gap"), tail(F.concat(tail(x["pg"]), tail(x["pm"]), tail(x["g"]))).alias("pre"), x["m"].alias("match")
        ),
    )
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:bigint,pre:string,match:string>>"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid() -> Column:
    """Whether a match of the pattern is of its kind."""
    match, digits = F.col("match"), _digits(F.col("match"))
    luhn = F.expr(
        "aggregate(sequence(1, length(_d)), 0, (s, k) -> s + if(k % 2 = 1, int(substring(_d, length(_d) - k + 1, 1)),"
        " int(substring('0246813579', 1 + int(substring(_d, length(_d) - k + 1, 1)), 1)))) % 10 = 0"
    )
    octets = F.forall(F.split(match, r"\."), lambda x: x.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))
    return (
        F.when(F.col("kind") == "email", F.lit(True)).when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "card", F.length("_d").between(12, 19) & F.when(F.length("_d").between(12, 19), luhn).otherwise(F.lit(False)))
        .when(F.col("kind") == "phone", F.length(digits).between(9, 15)).otherwise(F.lit(True))
    )


def find_matches(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, kind, start, end, pre, match) of all base matches of the right kind and all candidates, from (doc_id, _key, _text)."""
    found = docs.select("doc_id", "_key", F.concat(*[_matches(k) for k in (*KINDS, *CANDIDATES)]).alias("_found")).where(F.size("_found") > 0)
    single = cut(found).dropDuplicates(["doc_id", "_key"])  # repeated rows have the same matches
    rows = single.select("doc_id", "_key", F.explode("_found").alias("f")).select("doc_id", "_key", "f.*")
    # Positions are running sums over one text's matches of one kind.
    upto = Window.partitionBy("doc_id", "_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("match").cast("long")
    placed = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    return placed.withColumn("_d", _digits(F.col("match"))).where(_valid()).select("doc_id", "_key", "kind", "start", "end", "pre", "match")


def contexts(spans: DataFrame) -> DataFrame:
    """`spans` with _pattern: the lower-case word before the span, its digits as 0, and the separator; null without such a word."""
    word = F.regexp_extract("pre", r"([A-Za-z0-9_\p{L}]++)([^A-Za-z0-9_\p{L}]{0,8})$", 1)
    gap = F.regexp_extract("pre", r"([A-Za-z0-9_\p{L}]++)([^A-Za-z0-9_\p{L}]{0,8})$", 2)
    return spans.withColumn("_pattern", F.when(word != "", F.concat(F.regexp_replace(F.lower(word), "[0-9]+", "0"), F.lit("\x1f"), F.regexp_replace(gap, r"\s+", " "))))


def score_patterns(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, support) from edges (pattern, value, n) and seeds (value, kind).

    confidence = sum(n * score) / (sum(n) + DOUBT); a value's score in a kind is 1 for its seeds, else
    INHERITED * the mean confidence of its patterns by n. Support counts different seed values.
    """
    weights = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    degree = edges.groupBy("value").agg(F.sum("n").alias("all"))
    scores = seeds.select("value", "kind", F.lit(1.0).alias("score"), F.lit(1).alias("seed"))
    confident = None
    for step in range(rounds):
        totals = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("s"), F.sum("seed").alias("support"))
        confident = cut(totals.join(weights, "pattern").select("pattern", "kind", (F.col("s") / (F.col("all") + DOUBT)).alias("confidence"), "support"))
        if step + 1 < rounds:
            reached = edges.join(confident, "pattern").groupBy("value", "kind").agg(F.sum(F.col("n") * F.col("confidence")).alias("s"))
            inherited = reached.join(degree, "value").select("value", "kind", (INHERITED * F.col("s") / F.col("all")).alias("score"), F.lit(0).alias("seed"))
            scores = cut(seeds.select("value", "kind", F.lit(1.0).alias("score"), F.lit(1).alias("seed")).unionByName(inherited.join(seeds, ["value", "kind"], "left_anti")))
    return confident


def _free(spans: DataFrame, others: DataFrame) -> DataFrame:
    """`spans` that none of `others` overlaps."""
    t, b = spans.alias("t"), others.select("doc_id", "_key", "start", "end").alias("b")
    meets = F.col("t.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("t._key") == F.col("b._key")) & (F.col("b.start") < F.col("t.end")) & (F.col("t.start") < F.col("b.end"))
    return t.join(b, meets, "left_anti")


def discover(found: DataFrame) -> DataFrame:
    """(doc_id, _key, kind, start, end) of candidates that no base span overlaps, in patterns sure of one kind; a run goes before the tokens in it."""
    keys = ("doc_id", "_key", "start", "end", "match", "_pattern")
    base = found.where(F.col("kind").isin(*KINDS))
    runs = _free(found.where("kind = 'run'"), base)
    tokens = _free(found.where("kind = 'token'"), base.unionByName(runs))
    fresh = contexts(runs.unionByName(tokens)).select(*keys, F.lit(None).cast("string").alias("kind"))
    seeded = contexts(base).groupBy(*keys).agg(F.min("kind").alias("kind"))  # a span of two kinds stands there once
    marked = cut(fresh.unionByName(seeded).where("_pattern is not null"))
    edges = cut(marked.groupBy(F.col("_pattern").alias("pattern"), F.col("match").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    seeds = cut(marked.where("kind is not null").groupBy(F.col("match").alias("value")).agg(F.min("kind").alias("kind")))
    sure = score_patterns(edges, seeds).where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT))
    best = sure.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    new = marked.where(F.col("kind").isNull() & (F.length("match") >= TOKEN_CHARS) & (F.length(_digits(F.col("match"))) >= TOKEN_DIGITS)).drop("kind").join(best, F.col("_pattern") == F.col("pattern"))
    return new.select("doc_id", "_key", "kind", "start", "end")


def _joined(rows: Column) -> Column:
    """Spans (start, rank, kind, end) in order as kind:start:end, joined with commas."""
    return F.concat_ws(",", F.transform(F.array_sort(rows), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found): one row per row of `docs`.

    Counts and base_sha256 are of the base spans (the digest of kind:start:end, joined with commas);
    `spans` has the found ones too, n_found is their number. Positions are code points, end
    exclusive. Null text is empty and has no spans. Repeated rows get the same result each. An
    empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    found = cut(find_matches(rows))
    base = found.where(F.col("kind").isin(*KINDS)).select("doc_id", "_key", "kind", "start", "end", F.lit(True).alias("base"))
    spans = base.unionByName(discover(found).withColumn("base", F.lit(False)))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("rank")
    span = F.struct(F.col("start"), rank, F.col("kind"), F.col("end"))
    # One text's spans: bounded by its length.
    texts = spans.groupBy("doc_id", "_key").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.collect_list(F.when(F.col("base"), span))), 256).alias("base_sha256"), _joined(F.collect_list(span)).alias("spans"), F.count_if(~F.col("base")).alias("n_found"),
    ).alias("s")
    r = rows.select("doc_id", "_key").alias("r")
    joined = r.join(texts, F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r._key") == F.col("s._key")), "left")
    return joined.select(
        F.col("r.doc_id").alias("doc_id"), *[F.coalesce(F.col(f"s.n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.coalesce(F.col("s.base_sha256"), F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce(F.col("s.spans"), F.lit("")).alias("spans"), F.coalesce(F.col("s.n_found"), F.lit(0)).cast("long").alias("n_found"),
    )
