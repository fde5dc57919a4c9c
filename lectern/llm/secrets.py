"""Secret scans with multipart credential linking, in DataFrame functions only.

Base patterns stand by themselves: assignments of long values to words such as `password`,
access identifiers and long hexadecimal runs. Weaker candidates say little alone. They are
joined by interval with the parts that complement them (`VOUCHED`), within `SCOPE` characters of
the same text, and are reported only where such a part stands:

* another identifier needs a secret: an assignment of any length, a hexadecimal run or a key;
* a bare base64 key or a short assignment needs an identifier or an endpoint;
* an endpoint needs an assignment or a key. A hexadecimal run is no reason to call a link
  secret, since digests stand beside links everywhere, and neither is an identifier alone.

Weak candidates that overlap a base span are part of it and are left out.

Spans are in code points, ends exclusive. Splitting a text by a pattern and extracting its
matches interleave exactly, so running sums of lengths are positions; these are taken in
blocks, so that work grows with the number of matches and not with its square. Scopes are cut
into bins, a span lies in every bin that it reaches, so the join is by text and bin and stops
at the first complement.

Defined results: null and empty texts have no spans; rows without an id are kept; equal
rows have equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text, written

SCOPE = 400
SENT_ROWS = 1 << 18
SENT_SPANS = 1 << 20
BLOCK = 256
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 12
# runs are greedy and failing ones are dropped, so the least length may stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENTIFIER = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA|AGPA|ANPA|GOOG)[A-Z0-9]{8,}"
KEY = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|s3|postgres(?:ql)?|mongodb|redis|amqp)://[^\s"'<>]+"""
VOUCHED = {"id": ("assign", "hex", "key"), "key": ("access", "id", "endpoint"), "assign": ("access", "id", "endpoint"), "endpoint": ("assign", "key")}
SPAN = "array<struct<start:int,rank:int,end:int>>"


def match_lengths(text: Column, pattern: str) -> tuple[Column, Column]:
    """Lengths of the pieces between matches and of the matches."""
    hit = text.rlike(pattern)
    none = F.array().cast("array<int>")
    pieces = F.when(hit, F.transform(F.split(text, pattern, -1), F.length)).otherwise(none)
    values = F.when(hit, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)).otherwise(none)
    return pieces, values


def let(value: Column, body) -> Column:
    """`body` of a value computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(values: Column) -> Column:
    """An array (that is not empty) cut into arrays of BLOCK elements."""

    def cut(whole: Column) -> Column:
        last = F.floor((F.size(whole) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(whole, b * BLOCK + 1, F.lit(BLOCK)))

    return let(values, cut)


def running(values: Column, join) -> Column:
    """Running results of `join` (a sum or a maximum of numbers from 0) over an array<int>
    that is not empty: within blocks first, then over the blocks' last ones."""

    def fold(array: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(state: Column, x: Column) -> Column:
            return let(join(state["at"], x), lambda now: F.struct(now.alias("at"), F.array_append(state["out"], now).alias("out")))

        return F.aggregate(array, zero, step, lambda s: s["out"])

    def joined(inner: Column) -> Column:
        def shift(tops: Column) -> Column:
            def shifted(part: Column, i: Column) -> Column:
                return let(F.coalesce(F.get(tops, i - 1), F.lit(0)), lambda before: F.transform(part, lambda x: join(before, x)))

            return F.flatten(F.transform(inner, shifted))

        return let(fold(F.transform(inner, lambda x: F.element_at(x, -1))), shift)

    return let(F.transform(blocks(values), fold), joined)


def spans(pieces: Column, values: Column, kind: str) -> Column:
    """Spans of one kind from these lengths, in order."""
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values, lambda p, v: p + v)
    ends = running(steps, lambda a, b: a + b)
    found = F.zip_with(ends, values, lambda e, v: F.struct((e - v).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), e.alias("end")))
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, weak: bool = True) -> DataFrame:
    """(doc, h, base, weak): spans of every text; h tells texts with one id apart. The weak ones
    may be left out."""
    text = whole_text(text_col)
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | ({"id": IDENTIFIER, "key": KEY, "endpoint": ENDPOINT} if weak else {})
    lengths = []
    for kind, pattern in patterns.items():
        pieces, values = match_lengths(F.col("text"), pattern)
        lengths += [pieces.alias(f"{kind}_p"), values.alias(f"{kind}_v")]
    value = F.when(F.size("assign_v") > 0, F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.length)).otherwise(F.array().cast("array<int>"))
    keep = keep or []
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text"), *keep).select("doc", F.xxhash64("text").alias("h"), "text", *keep, *lengths)
    rows = rows.select("*", value.alias("value"))
    found = {k: spans(F.col(f"{k}_p"), F.col(f"{k}_v"), k) for k in patterns}
    rows = rows.select("doc", "h", "value", *keep, *(v.alias(k) for k, v in found.items()))
    long_enough = F.filter("assign", lambda s, i: F.get(F.col("value"), i) >= LEAST_VALUE)
    short = F.filter("assign", lambda s, i: F.get(F.col("value"), i) < LEAST_VALUE)
    base = F.array_sort(F.concat(long_enough, F.col("access"), F.col("hex")))
    others = F.concat("id", "key", "endpoint", short) if weak else F.array().cast(SPAN)
    return rows.select("doc", "h", *keep, base.alias("base"), others.alias("weak"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, base, spans) of every row: base spans, and all spans with the linked ones."""
    rows = written(candidates(docs, id_col, text_col), "secrets")
    return link(rows, scope).withColumnRenamed("doc", id_col)


def link(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Adds to the base spans the weak ones that stand near a complement."""
    some = rows.where(F.size("weak") > 0).select("doc", "h", "base", "weak").distinct()
    reached = F.sequence(F.floor(F.col("s.start") / scope), F.floor(F.col("s.end") / scope))

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.h") == F.col(f"{b}.h")) & (F.col(f"{a}.bin") == F.col(f"{b}.bin"))

    strong = some.select("doc", "h", F.explode("base").alias("s"))
    weak = some.select("doc", "h", F.explode("weak").alias("s")).withColumn("bin", F.explode(reached))
    overlap = (F.col("b.s.start") < F.col("w.s.end")) & (F.col("w.s.start") < F.col("b.s.end"))
    inside = weak.alias("w").join(strong.withColumn("bin", F.explode(reached)).alias("b"), same("w", "b") & overlap, "left_semi").select("doc", "h", "s").distinct()
    alone = weak.select("doc", "h", "s").distinct().alias("w")
    alone = written(alone.join(inside.alias("i"), F.col("w.doc").eqNullSafe(F.col("i.doc")) & (F.col("w.h") == F.col("i.h")) & (F.col("w.s") == F.col("i.s")), "left_anti"), "weak")
    near_bins = F.sequence(F.floor((F.col("s.start") - scope) / scope) - 1, F.floor((F.col("s.end") + scope) / scope))
    parts = strong.unionByName(alone).withColumn("bin", F.explode(near_bins))
    near = (F.col("w.s.start") - F.col("p.s.end") <= scope) & (F.col("p.s.start") - F.col("w.s.end") <= scope)
    vouches = F.lit(False)
    for kind, others in VOUCHED.items():
        vouches = vouches | ((F.col("w.s.rank") == KINDS.index(kind)) & F.col("p.s.rank").isin([KINDS.index(k) for k in others]))
    linked = alone.withColumn("bin", F.explode(reached)).alias("w").join(parts.alias("p"), same("w", "p") & near & vouches, "left_semi")
    more = linked.groupBy(F.col("doc").alias("doc3"), F.col("h").alias("h3")).agg(F.collect_set("s").alias("more"))
    out = rows.join(more, F.col("doc").eqNullSafe(F.col("doc3")) & (F.col("h") == F.col("h3")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return out.select("doc", "h", "base", every.alias("spans"))


def listed(spans_col: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redact(text: Column, spans_col: Column, mark: str = "[SECRET]") -> Column:
    """The text with its spans replaced by a mark; touching or overlapping spans give one.
    What stays is cut out of the text block by block of spans."""

    def pieces(part: Column) -> Column:
        at, end = F.get(part, F.lit(0))["a"], F.element_at(part, -1)["b"]
        return let(F.substring(text, at + 1, end - at), lambda whole: F.transform(part, lambda g: F.substring(whole, g["a"] - at + 1, g["b"] - g["a"])))

    def kept(reached: Column) -> Column:
        gaps = F.transform(spans_col, lambda s, i: F.struct(F.coalesce(F.get(reached, i - 1), F.lit(0)).alias("a"), s["start"].alias("b"), i.alias("i")))
        gaps = F.filter(gaps, lambda g: (g["i"] == 0) | (g["b"] > g["a"]))
        parts = F.array_join(F.flatten(F.transform(blocks(gaps), pieces)), mark)
        return F.concat(parts, F.lit(mark), F.substring(text, F.element_at(reached, -1) + 1, F.lit(2**31 - 1)))

    whole = let(running(F.transform(spans_col, lambda s: s["end"]), F.greatest), kept)
    return F.when(F.size(spans_col) > 0, whole).otherwise(text)


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", scope: int = SCOPE) -> DataFrame:
    """The rows, with all their columns, secrets replaced by a mark and the character count
    renewed where there is one.

    A first pass writes the spans, without texts, of rows with weak candidates and links them;
    the second finds the base spans again and adds the linked ones, which are sent to all tasks
    if they are few and else met by a join.
    """
    names = docs.columns
    held = F.explode(F.array(F.struct("base", "weak"))).alias("f")  # evaluated once, filters stay above it
    found = candidates(docs, id_col, text_col).select("doc", "h", held).where(F.size("f.weak") > 0)
    linked = link(written(found.select("doc", "h", "f.base", "f.weak"), "secrets"), scope)
    linked = written(linked.where(F.size("spans") > F.size("base")).select(F.col("doc").alias("doc2"), F.col("h").alias("h2"), F.col("spans").alias("linked")).distinct(), "linked")
    size = linked.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("linked")), F.lit(0)).alias("spans")).first()
    sent = F.broadcast(linked) if size["rows"] <= SENT_ROWS and size["spans"] <= SENT_SPANS else linked
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    base = candidates(rows, "_id", "_text", keep=["row"], weak=False).select("doc", "h", "row", "base")
    every = base.join(sent, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("h") == F.col("h2")), "left")
    every = every.select("row", F.explode(F.array(F.coalesce("linked", "base"))).alias("spans"))
    text = F.when(F.size("spans") > 0, redact(F.col(f"row.{text_col}"), F.col("spans"))).otherwise(F.col(f"row.{text_col}"))
    out = every.select("row", "spans", text.alias("new"))

    def column(c: str) -> Column:
        if c == chars_col:
            return F.when(F.size("spans") > 0, F.length("new").cast(docs.schema[c].dataType)).otherwise(F.col(f"row.{c}")).alias(c)
        return F.col("new").alias(c) if c == text_col else F.col(f"row.{c}")

    return out.select(*map(column, names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
