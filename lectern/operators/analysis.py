"""What an analysis snapshot holds and what is made of it: samples of lines, placements and
dismissals, far pairs, discoveries, and the published state of books."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_text

from .graph import with_former
from .shared import written
from .vectors import BLOCK, _best, _ranked, _slices

PROFILE_GRAMS, TITLE_GRAMS = 1 << 20, 1 << 18  # of a block
LAST = -1e300  # stands for no similarity


def rebuild(points: int, last: int | None, same_version: bool, lines_left: int) -> bool:
    """Whether all lines are made anew: without a last full analysis, after growth by half and by
    40 points, after a change of version, or when no line is left."""
    return last is None or not same_version or lines_left == 0 or points >= max(1.5 * last, last + 40)


def line_samples(members: DataFrame, most: int = 12) -> DataFrame:
    """(line, id, pos): favourites first, then the closest, at most so many, in the line's order."""
    chosen = F.slice(F.array_sort(F.collect_list(F.struct((~F.col("favorite")).alias("k"), "place", "id"))), 1, most)
    rows = members.groupBy("line").agg(chosen.alias("s"))
    kept = F.array_sort(F.transform("s", lambda x: F.struct(x["place"].alias("place"), x["id"].alias("id"))))
    return rows.select("line", F.posexplode(kept).alias("pos", "m")).select("line", F.col("m.id").alias("id"), "pos")


def placed(members: DataFrame, assigned: DataFrame, least: int = 2) -> DataFrame:
    """(line, id): members after points were placed by hand, each in one line; lines left with
    fewer than `least` dissolve."""
    stay = members.join(assigned.select("id"), "id", "left_anti").select("line", "id")
    both = stay.unionByName(assigned.join(members.select("line").distinct(), "line", "left_semi").select("line", "id"))
    kept = both.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("line")
    return both.join(kept, "line", "left_semi")


def resembling(lines: DataFrame, dismissed: DataFrame, shared: int = 2, share: float = 0.5) -> DataFrame:
    """Lines that share so many points, and that share of theirs, with a dismissed set."""
    size = lines.groupBy("line").agg(F.count("*").alias("size"))
    met = lines.join(dismissed, "id").groupBy("line", "set").agg(F.count("*").alias("n"))
    return met.join(size, "line").where((F.col("n") >= shared) & (F.col("n") >= share * F.col("size"))).select("line").distinct()


def without_dismissed(planes: DataFrame, members: DataFrame, gone: DataFrame) -> DataFrame:
    """(plane, line, id): a snapshot without dismissed lines; planes left with one line go too."""
    left = planes.join(gone, "line", "left_anti")
    kept = left.groupBy("plane").agg(F.count("*").alias("n")).where("n >= 2").select("plane")
    return left.join(kept, "plane", "left_semi").join(members, "line").select("plane", "line", "id")


KINDS = ("isolated", "cross", "line")


def _closest_of_block(pdf):
    """For each visitor (lone not null) the closest member of another source, and for isolated ones
    the closest of their own; a pair without a similarity stands behind all others."""
    import pandas as pd

    q, m = pdf[pdf["lone"].notna()], pdf[pdf["lone"].isna()].sort_values("place", kind="stable")
    width = max((len(v) for v in pdf["v"] if v is not None), default=1)
    stacked = lambda t: np.array([np.full(width, np.nan) if v is None or len(v) != width else np.asarray(v, float) for v in t["v"]]).reshape(-1, width)
    out, members, ids, source = [], stacked(m).T, m["id"].to_numpy(), m["source"].to_numpy()
    for own in _slices(len(q), len(m)):
        part = q.iloc[own]
        sims = np.round(stacked(part) @ members, 9)
        sims[~np.isfinite(sims)] = LAST
        sims[part["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        other = part["source"].to_numpy()[:, None] != source[None, :]
        for same, fits in ((False, other), (True, ~other & part["lone"].to_numpy(bool)[:, None])):
            s = np.where(fits, sims, -np.inf)
            at = s.argmax(axis=1) if len(m) else np.zeros(0, int)  # the first place wins ties
            top = s[np.arange(len(at)), at]
            kept = np.flatnonzero(top > -np.inf)
            at, rows = at[kept], part.iloc[kept]
            out.append(pd.DataFrame({"line": rows["line"].to_numpy(), "a": rows["id"].to_numpy(), "at": rows["place"].to_numpy(), "lone": rows["lone"].to_numpy(bool), "same": same, "sim": top[kept], "place": m["place"].to_numpy()[at], "b": ids[at]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["line", "a", "at", "lone", "same", "sim", "place", "b"])


def discoveries(after: DataFrame, before: DataFrame, isolated: DataFrame, former: DataFrame, most: int = 20) -> DataFrame:
    """(kind, line, a, b): what joined since the snapshot before, at most so many.

    `after` (line, id, place, source, v) as it is, `before` (line, id) and `isolated` (id) as they
    were, `former` (id, former) the ids that points replaced; a point that only replaced one of its
    line has not joined. A new line shows its first point and the first of another source; a point
    that was isolated shows the closest of another source, or of any if there is none; another
    that joined shows the closest of another source. A pair of a line counts once, by the first of
    KINDS. What joined meets its line in blocks of BLOCK rows, as matrices."""
    old = before.select("line").distinct()
    alias = with_former(after.select("line", "id"), former, "id")
    stayed = alias.join(before.select("line", F.col("id").alias("alias")), ["line", "alias"]).select("line", "id").distinct()
    lone = alias.join(isolated.select(F.col("id").alias("alias")), "alias").select("id").distinct().withColumn("lone", F.lit(True))
    new = after.join(old, "line", "left_anti")
    first = new.groupBy("line").agg(F.min_by(F.struct("id", "source"), "place").alias("f"))
    second = new.join(first, "line").where("source <> f.source").groupBy("line").agg(F.min("f.id").alias("a"), F.min_by("id", "place").alias("b"))
    lines = second.select(F.lit("line").alias("kind"), "line", F.lit(0).cast("long").alias("place"), "a", "b")
    joined = after.join(old, "line", "left_semi").join(stayed, ["line", "id"], "left_anti").join(lone, "id", "left")
    p = joined.select("line", F.col("id").alias("a"), F.col("place").alias("at"), F.col("source").alias("own"), F.col("v").alias("w"), F.coalesce("lone", F.lit(False)).alias("lone"))
    columns = ["line", "block", "call", "id", "place", "source", "v", "lone"]
    members = after.join(p.select("line").distinct(), "line", "left_semi").select("line", "id", "place", "source", "v", F.lit(None).cast("boolean").alias("lone"))
    guests = p.select("line", F.col("a").alias("id"), F.col("at").alias("place"), F.col("own").alias("source"), F.col("w").alias("v"), "lone")
    blocks = lambda t, n: t.groupBy("line").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("int").alias(n))
    plan = blocks(members, "blocks").join(blocks(guests, "calls"), "line")
    dealt = lambda t, own, other, mine, theirs: t.join(plan, "line").withColumn(mine, F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(columns)
    met = dealt(members, "blocks", "calls", "block", "call").unionByName(dealt(guests, "calls", "blocks", "call", "block"))
    types = {f.name: f.dataType.simpleString() for f in after.schema}
    schema = f"line {types['line']}, a {types['id']}, at {types['place']}, lone boolean, same boolean, sim double, place {types['place']}, b {types['id']}"
    met = met.groupBy("line", "block", "call").applyInPandas(_closest_of_block, schema)
    near = F.struct("same", (-F.col("sim")).alias("far"), "place")
    best = met.groupBy("line", "a", "at", "lone").agg(F.min_by("b", near).alias("b"))
    points = best.select(F.when(F.col("lone"), "isolated").otherwise("cross").alias("kind"), "line", F.col("at").alias("place"), "a", "b")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    once = lines.unionByName(points).groupBy("line", F.least("a", "b"), F.greatest("a", "b")).agg(F.min(F.struct(rank.alias("rank"), "line", "place", "a", "b", "kind")).alias("d"))
    return once.orderBy("d.rank", "d.line", "d.place", "d.a").limit(most).select("d.kind", "d.line", "d.a", "d.b")


def far_reps(reps: DataFrame, isolated: DataFrame, judged: DataFrame, most: int = 600) -> DataFrame:
    """(id, pos): the lines' representatives, then isolated points, those judged least first."""
    lone = isolated.join(judged, "id", "left").select("id", F.lit(1).alias("kind"), F.coalesce("n", F.lit(0)).alias("n"))
    every = reps.select("id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")).unionByName(lone)
    top = every.orderBy("kind", "n", "id").limit(most)  # bounded, so one list can number them
    return top.agg(F.array_sort(F.collect_list(F.struct("kind", "n", "id"))).alias("t")).select(F.posexplode("t").alias("pos", "r")).select(F.col("r.id").alias("id"), "pos")


def far_pairs(reps: DataFrame) -> DataFrame:
    """(a, b, sim) of numbered representatives of different sources and planes (an isolated one's
    plane is null and differs from all): each is dealt to the places behind its own and meets what
    stands there."""
    last = reps.agg(F.max("pos").alias("last"))
    a = reps.join(F.broadcast(last), F.col("pos") < F.col("last")).withColumn("at", F.explode(F.sequence(F.col("pos") + 1, F.col("last"))))
    b = reps.select(F.col("pos").alias("at"), F.col("id").alias("b"), F.col("source").alias("source2"), F.col("plane").alias("plane2"), F.col("v").alias("v2"))
    met = a.join(b, "at").where("source <> source2 and coalesce(plane <> plane2, true)")
    sim = F.aggregate(F.zip_with("v", "v2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return met.select(F.col("id").alias("a"), "b", F.round(sim, 6).alias("sim"))


def peers(edges: DataFrame) -> DataFrame:
    """(node, kind, n): how many other nodes a node is tied to, by kind of edge."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("peer"), "kind").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("peer"), "kind"))
    return both.groupBy("node", "kind").agg(F.countDistinct("peer").alias("n"))


def _titles_of_block(most: int):
    """Of a block of profiles and titles, as (asks, key, gram, x), the titles closest to each
    profile; a slice of titles meets the profiles gram by gram."""

    def run(rows):
        import pyarrow as pa

        asks, key, x = (rows[c].to_numpy() for c in ("asks", "key", "x"))
        coded = rows["gram"].combine_chunks().dictionary_encode()
        gram = coded.indices.to_numpy()
        (keys, p), (ids, t) = (np.unique(key[side], return_inverse=True) for side in (asks, ~asks))
        by = np.argsort(gram[asks], kind="stable")
        p, px = p[by], x[asks][by]
        at = np.searchsorted(gram[asks][by], np.arange(len(coded.dictionary) + 1))  # a gram's profiles
        by = np.argsort(t, kind="stable")
        t, g, y = t[by], gram[~asks][by], x[~asks][by]
        best = tuple(np.zeros(0, c) for c in (np.int64, np.int64, float))
        for own in _slices(len(ids), len(keys)) if len(keys) else ():
            sims = np.zeros((len(keys), len(ids[own])))
            a, b = np.searchsorted(t, (own.start, own.stop))
            order = a + np.argsort(g[a:b], kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
                q = slice(at[g[same[0]]], at[g[same[0]] + 1])
                sims[np.ix_(p[q], t[same] - own.start)] += np.outer(px[q], y[same])
            sims[sims == 0] = -np.inf  # no gram in common
            best = _ranked(*map(np.concatenate, zip(best, _best(sims, ids[own], most, 6))), most)
        return pa.table({"p": keys[best[0]], "t": best[1], "sim": best[2]})

    return run


def closest_titles(profile: DataFrame, titles: DataFrame, most: int = 8) -> DataFrame:
    """(profile, id, sim): the titles whose weighted grams (id, gram, w) are closest to a
    profile's, by cosine; those that share no gram do not count. Titles of the same grams meet
    others once, with the first ids that may count. Profiles and titles meet in blocks of so many
    grams, each of which sends on the best of a profile; no side goes through the driver."""
    own = lambda t: t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("gram", "w"))).alias("g"))
    same = lambda t: t.groupBy("g").agg(F.min("id").alias("key"), F.collect_list("id").alias("ids")).where("key is not null")
    place = F.row_number().over(Window.partitionBy("g").orderBy("id"))
    grouped = written(same(own(profile)), "profiles")
    firsts = written(same(own(titles).withColumn("r", place).where(F.col("r") <= most)), "titles")
    blocks = lambda rows, size: 1 + (rows.agg(F.sum(F.size("g"))).first()[0] or 0) // size
    calls, parts = blocks(grouped, PROFILE_GRAMS), blocks(firsts, TITLE_GRAMS)

    def dealt(rows: DataFrame, asks: bool, mine: str, n: int, theirs: str, others: int) -> DataFrame:
        length = F.sqrt(F.aggregate("g", F.lit(0.0), lambda s, g: s + g["w"] ** 2))
        r = rows.select(F.col("key").cast("long").alias("key"), "g", length.alias("n"), F.pmod(F.xxhash64("key"), F.lit(n)).alias(mine))
        r = r.withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
        return r.select("block", "call", "key", "n", F.explode("g").alias("r")).select("block", "call", F.lit(asks).alias("asks"), "key", "r.gram", (F.col("r.w") / F.col("n")).alias("x"))

    met = dealt(grouped, True, "call", calls, "block", parts).unionByName(dealt(firsts, False, "block", parts, "call", calls))
    met = met.groupBy("block", "call").applyInArrow(_titles_of_block(most), "p long, t long, sim double")
    first = lambda rows, k: rows.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("sim"), k))).where(F.col("r") <= most).drop("r")
    ids = firsts.select(F.col("key").alias("t"), F.explode("ids").alias("id"))
    # a title with `most` others before its first id has as many before all its ids
    top = first(first(met, "t").join(ids.hint("merge"), "t").select("p", "id", "sim"), "id")
    return top.join(grouped.select(F.col("key").alias("p"), F.explode("ids").alias("profile")).hint("merge"), "p").select("profile", "id", "sim")


def _title_classes(left: DataFrame, right: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Titles of both sides as (id, title, author), normalised, and the pairs (author, tl, tr) of
    different titles that match, each once however many rows have them."""
    side = lambda t, n: t.select(F.col("id").alias(n), normalize_text(F.col("title")).alias("t" + n), F.col("author")).where(F.length("t" + n) >= least)
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(c, i, F.lit(least)))
    head = lambda c: F.substring(c, 1, least)
    a, b = side(left, "l"), side(right, "r")

    def met(inner: DataFrame, outer: DataFrame, i: str, o: str) -> DataFrame:
        x = inner.select("author", i).distinct().withColumn("g", head(F.col(i)))
        y = outer.select("author", o).distinct().withColumn("g", F.explode(F.array_distinct(grams(F.col(o)))))
        return x.join(y, ["author", "g"]).where(F.contains(F.col(o), F.col(i))).select("author", "tl", "tr")

    return a, b, met(a, b, "tl", "tr").unionByName(met(b, a, "tr", "tl")).distinct()


def title_matches(left: DataFrame, right: DataFrame, least: int = 4) -> DataFrame:
    """(l, r): titles of a shared author that are equal or contain one another with `least`
    characters or more. A contained title's first gram stands in its container, which the join
    goes by, so no title meets all others."""
    a, b, pairs = _title_classes(left, right, least)
    return a.join(pairs, ["author", "tl"]).join(b, ["author", "tr"]).select("l", "r").distinct()


def title_match_counts(left: DataFrame, right: DataFrame, least: int = 4) -> DataFrame:
    """(l, n): how many titles of the right match one of the left, the rows of `title_matches`
    counted without making them: rows of the same title and author count together. Ids are those
    of one title."""
    a, b, pairs = _title_classes(left, right, least)
    sizes = b.groupBy("author", "tr").agg(F.count("*").alias("n"))
    per = pairs.join(sizes, ["author", "tr"]).groupBy("author", "tl").agg(F.sum("n").alias("n"))
    return a.join(per, ["author", "tl"]).groupBy("l").agg(F.sum("n").alias("n"))


def published(books: DataFrame, **tables: DataFrame) -> DataFrame:
    """Books with what other tables know of them by asin (marks, trend, history and so on), each
    joined on the left as a struct of its name; keys are unique in each table."""
    out = books
    for name, t in tables.items():
        rest = [c for c in t.columns if c != "asin"]
        out = out.join(t.select("asin", F.struct(*rest).alias(name)), "asin", "left")
    return out


def value_runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, current, prev, since, low, low_since) of a value's runs in order: the last run, the
    value of the one before and where it began, the lowest and where that stood first."""
    w = Window.partitionBy(key).orderBy(*order)
    at = F.struct(*order)
    r = rows.where(F.col(value).isNotNull()).select(key, *order, value, F.lag(value).over(w).alias("before"))
    begins = F.col("before").isNull() | (F.col("before") != F.col(value))
    first = F.col(order[0])
    return r.groupBy(key).agg(
        F.max_by(value, at).alias("current"),
        F.max_by(F.when(begins, F.col("before")), F.when(begins, at)).alias("prev"),
        F.max_by(first, F.when(begins, at)).alias("since"),
        F.min(value).alias("low"),
        F.min_by(first, F.struct(value, *order)).alias("low_since"),
    )


def price_mark(mark: str) -> Column:
    """Whether a book with price, prev, low, ku and stop bears a price mark."""
    known = F.col("price").isNotNull() & F.col("prev").isNotNull() & F.col("stop").isNull()
    tests = {"missing": F.col("price").isNull() & ~F.col("ku"), "drop": known & (F.col("price") < F.col("prev")), "lowest": known & F.col("low").isNotNull() & (F.col("price") <= F.col("low"))}
    return F.coalesce(tests.get(mark, F.lit(True)), F.lit(False))


def rating_order(tag: Column, rating: Column) -> Column:
    """Stars of read books; read ones without any stand after all rated ones, the rest last."""
    return F.when(tag == "seen", F.coalesce(F.nullif(rating.cast("double"), F.lit(0.0)), F.lit(0.5))).otherwise(0.0)


def valid_picks(picks: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(asin, pos): picks by known number or else by exact title, each book once, at most so
    many by position."""
    by_id = picks.join(known.select("asin", F.lit(True).alias("there")), "asin", "left")
    titles = known.groupBy(normalize_text(F.col("title")).alias("key")).agg(F.min("asin").alias("by_title"))
    rows = by_id.withColumn("key", normalize_text(F.col("title"))).join(titles, "key", "left")
    asin = F.when(F.col("there"), F.col("asin")).otherwise(F.col("by_title"))
    once = rows.select(asin.alias("asin"), "pos").where("asin is not null").groupBy("asin").agg(F.min("pos").alias("pos"))
    return once.orderBy("pos", "asin").limit(most)


def with_required(picks: DataFrame, kinds: tuple[str, ...], most: int) -> DataFrame:
    """(pos, id, kind): the first `most` picks (id, kind, pos); for each required kind that is
    missing its first pick takes the place of the last one of a kind that has more than one. Only
    `most` picks and one of each required kind meet in the list that is folded."""
    top = picks.select("pos", "id", "kind").orderBy("pos", "id").limit(most)
    spare = picks.where(F.col("kind").isin(*kinds)).join(top.select("id"), "id", "left_anti").groupBy("kind").agg(F.min(F.struct("pos", "id", "kind")).alias("r"))
    rows = top.select(F.struct("pos", "id", "kind").alias("r"), F.lit(True).alias("in")).unionByName(spare.select("r", F.lit(False).alias("in")))
    lists = rows.agg(F.array_sort(F.collect_list(F.when(F.col("in"), F.col("r")))).alias("c"), F.collect_list(F.when(~F.col("in"), F.col("r"))).alias("s"))
    for kind in kinds:
        lists = lists.withColumn("new", F.get(F.filter("s", _of_kind(kind)), F.lit(0)))
        twice = F.transform("c", lambda x, i: F.when(F.size(F.filter("c", lambda y: y["kind"] == x["kind"])) > 1, i))
        lists = lists.withColumn("at", F.array_max(twice))
        needed = ~F.exists("c", _of_kind(kind)) & F.col("new").isNotNull() & F.col("at").isNotNull()
        swapped = F.transform("c", lambda x, i: F.when(i == F.col("at"), F.col("new")).otherwise(x))
        lists = lists.select(F.when(needed, swapped).otherwise(F.col("c")).alias("c"), "s")
    return lists.select(F.posexplode("c").alias("pos", "r")).select("pos", "r.id", "r.kind")


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def catalogue_hits(rows: DataFrame, sources: tuple[str, ...], year: int | None = None, window: int = 25) -> DataFrame:
    """Rows of the first source that has any fit ones per query: with a number, within `window`
    years, most held first."""
    fine = rows.where(F.col("isbn").isNotNull())
    fine = fine if year is None else fine.where(F.abs(F.col("year") - year) <= window)
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    fine = fine.withColumn("place", place).where("place > 0")
    first = fine.groupBy("query").agg(F.min("place").alias("place"))
    return fine.join(first, ["query", "place"])


def named_candidate(picks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(pick, id): the candidate whose title in corner brackets is named in the reason, else the
    one at the given index."""
    title = F.regexp_extract("reason", "『([^』]+)』", 1)
    named = picks.withColumn("key", normalize_text(title)).join(candidates.select(normalize_text(F.col("title")).alias("key"), F.col("id").alias("named")), "key", "left")
    at = candidates.select("index", F.col("id").alias("indexed"))
    return named.join(at, "index", "left").groupBy("pick").agg(F.min(F.coalesce("named", "indexed")).alias("id"))


def existence(asked: Column, answered: Column, hits: Column) -> Column:
    """Whether a recommended book exists: verified by a hit, false if all sources answered
    without one, unknown otherwise."""
    return F.when(hits > 0, "verified").when(answered == asked, "false").otherwise("unknown")


def sync_outcome(results: DataFrame) -> DataFrame:
    """(run, outcome): failed or partial by the failing sources; a run that found nothing at all
    in any source means that the source is broken."""
    n = results.groupBy("run").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    outcome = F.when(F.col("bad") == F.col("n"), "failed").when(F.col("bad") > 0, "partial").when(F.col("found") == 0, "broken").otherwise("ok")
    return n.select("run", outcome.alias("outcome"))


def wish_sync(items: DataFrame, seen: DataFrame, manga: Column) -> DataFrame:
    """(id, state) of a wish list's items: seen by title, then by number, manga, without a number,
    failed, or registered."""
    by_title = seen.select(normalize_text(F.col("title")).alias("key"), F.lit(True).alias("t")).distinct()
    by_id = seen.where("asin is not null").select("asin", F.lit(True).alias("a")).distinct()
    rows = items.withColumn("key", normalize_text(F.col("title"))).join(by_title, "key", "left").join(by_id, "asin", "left")
    state = F.when(F.col("t"), "seen-title").when(F.col("a"), "seen-asin").when(manga, "manga").when(F.col("asin").isNull(), "unresolved").when(F.col("failed"), "failed").otherwise("registered")
    return rows.select("id", state.alias("state"))
