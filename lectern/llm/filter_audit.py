"""Filter interaction audit: what each filter of a chain removes in every order of the chain.

Every document gets a mask of the filters it fails. Per part, the masks are counted, and from
the counts the removal polynomial is formed, the multilinear extension of "documents removed by
a set of filters":

    R(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i))

kept as its coefficients by monomial. A corner (each x_i 0 or 1) gives what the filters at 1
remove together, so all orders of the chain are read from the corners and no document is looked
at twice. The Shapley share of filter i is the integral of the partial derivative of R by x_i
along the diagonal; a monomial of n variables with i among them adds coefficient / n, an exact
rational, and the sum over the 120 orders is 120 times that, an integer.

The text is read once, for the mask and a digest. Filter E (a copy of a smaller id) compares the
document's id with the smallest of its digest: the smallest ids are grouped minima, and they meet
the documents again on digest and id together, so a digest that a third of all rows share is no
hot key. All else is counts by part and mask.

Defined results: a null text is empty, a null part the empty string; words are maximal runs
outside \\x20 and \\x09-\\x0D; a text without words fails A only among A and B, an empty one never
fails C. A document without an id, or whose id is the smallest of its text (rows repeated in full
included), is no copy. Labels repeated for an id count once, by their largest value; further
columns are ignored; an empty table gives no rows. Counts are 64-bit, sums over orders included.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text, written

FILTERS = "ABCDE"
ORDERS = 120
LEAST_WORDS = 200
SUBSETS = 1 << len(FILTERS)
SPACE = r"[ \t-\r]+"


def bits(members: str) -> int:
    return sum(1 << FILTERS.index(x) for x in members)


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text fails; `words` is the array of its words."""
    n = F.size(words)
    few = n < LEAST_WORDS
    repeated = 100 * F.size(F.array_distinct(words)) < 50 * n
    loud = 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 2 * F.length(text)
    marked = text.rlike(r"[#$%&*|]")
    fails = (few, repeated, loud, marked)
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, mask): a row for each row of `docs`."""
    seen = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), whole_text().alias("_text"))
    seen = seen.withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != ""))
    seen = written(seen.select("doc_id", "part", text_mask(F.col("_text"), F.col("_words")).alias("mask"), F.unhex(F.sha2("_text", 256)).alias("digest")), "masks")
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("first")).select(F.col("digest").alias("digest2"), "first")
    same = (F.col("digest") == F.col("digest2")) & (F.col("doc_id") == F.col("first"))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return seen.join(first, same, "left").select("doc_id", "part", (F.col("mask") + F.when(copy, bits("E")).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled good or toxic."""
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    all_ = masks.join(marks, masks["doc_id"] == marks["labelled"], "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return all_.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


COUNTS = ("n", "good", "toxic")


def removal_polynomials(counts: DataFrame) -> DataFrame:
    """(part, total, n, good, toxic): for each part its documents and the coefficients of three
    removal polynomials as arrays, place T for the monomial of the filters in the bits of T."""
    subsets = F.filter(F.sequence(F.lit(1), F.lit(SUBSETS - 1)), lambda t: t.bitwiseAND(F.col("mask")) == t)
    terms = counts.where("mask > 0").select("part", F.explode(subsets).alias("t"), *COUNTS)
    sign = F.when(F.bit_count("t") % 2 == 1, 1).otherwise(-1)
    terms = terms.groupBy("part", "t").agg(*[F.sum(F.col(c) * sign).alias(c) for c in COUNTS])
    place = lambda c: F.map_from_entries(F.collect_list(F.struct("t", c)))  # noqa: E731  31 entries at most
    rows = terms.groupBy("part").agg(*[place(c).alias(c) for c in COUNTS])
    totals = counts.groupBy(F.col("part").alias("part2")).agg(F.sum("n").alias("total"))
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda t: F.coalesce(F.try_element_at(F.col(c), t), F.lit(0).cast("long"))).alias(c)
    return totals.join(rows, F.col("part") == F.col("part2"), "left").select(F.col("part2").alias("part"), "total", *[dense(c) for c in COUNTS])


def corner(poly: Column, chosen: Column) -> Column:
    """The polynomial at the corner where the filters in `chosen` are 1: the sum of the
    coefficients of monomials within it."""
    at = F.filter(F.sequence(F.lit(1), F.lit(SUBSETS - 1)), lambda t: t.bitwiseAND(chosen) == t)
    return F.aggregate(at, F.lit(0).cast("long"), lambda s, t: s + F.get(poly, t))


def shapley(poly: Column, bit: Column) -> Column:
    """120 times the integral over [0, 1] of the partial derivative along the diagonal: a monomial
    of n variables gives coefficient * t**(n - 1), hence coefficient / n; 120 / n is whole."""
    having = F.filter(F.sequence(F.lit(1), F.lit(SUBSETS - 1)), lambda t: t.bitwiseAND(bit) != 0)
    return F.aggregate(having, F.lit(0).cast("long"), lambda s, t: s + F.get(poly, t) * F.floor(F.lit(ORDERS) / F.bit_count(t)))


def audit(counts: DataFrame) -> DataFrame:
    """The audit's rows: part, order and step with their counts."""
    polys = removal_polynomials(counts)
    corners = lambda c: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: corner(F.col(c), s)).alias(f"{c}_at")
    shares = F.array(*[shapley(F.col("n"), F.lit(1 << i)) for i in range(len(FILTERS))]).alias("share")
    polys = polys.select("part", "total", *[corners(c) for c in COUNTS], shares)
    steps = [(o, k + 1, bits(o[:k]), bits(o[k])) for o in map("".join, permutations(FILTERS)) for k in range(len(FILTERS))]
    literal = "array(" + ",".join(f"named_struct('o','{o}','k',{k},'b',{b},'f',{f})" for o, k, b, f in steps) + ")"
    rows = polys.select("*", F.explode(F.expr(literal)).alias("s"))
    before, bit = F.col("s.b"), F.col("s.f")
    after = before.bitwiseOR(bit)
    gain = lambda c: F.get(F.col(f"{c}_at"), after) - F.get(F.col(f"{c}_at"), before)
    fails = F.get("n_at", bit)
    return rows.select(
        "part",
        F.col("s.o").alias("filter_order"),
        F.col("s.k").alias("step"),
        (F.col("total") - F.get("n_at", after)).alias("kept"),
        gain("n").alias("removed"),
        (fails - gain("n")).alias("redundant"),
        (F.get("n_at", F.lit(SUBSETS - 1)) - F.get("n_at", F.lit(SUBSETS - 1) - bit)).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        F.get("share", F.log2(bit).cast("int")).alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failure_masks(table(spark, sf_dir, "documents"), "source")
    return audit(mask_counts(masks, table(spark, sf_dir, "labels")))


#: Removes document by document, in every order.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), m AS (
  SELECT doc_id, part, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(first < doc_id, false)] AS f FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), x AS (
  SELECT m.part, m.f, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic FROM m LEFT JOIN l USING (doc_id)
), i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), p AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (SELECT o, i AS step FROM p, i), runs AS (
  SELECT x.part, array_to_string(list_transform(s.o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, s.step, s.o[s.step] AS own, x.f[s.o[s.step]] AS fails,
    len(list_filter(s.o[1:s.step - 1], lambda k: x.f[k])) > 0 AS gone, len(list_filter(x.f, lambda v: v)) AS n_fails, x.good, x.toxic
  FROM x, s
), a AS (
  SELECT part, filter_order, step, own,
    count(*) FILTER (WHERE NOT gone AND NOT fails) AS kept, count(*) FILTER (WHERE fails AND NOT gone) AS removed,
    count(*) FILTER (WHERE fails AND gone) AS redundant, count(*) FILTER (WHERE fails AND n_fails = 1) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM runs GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM a
"""
