"""Presentation operators: collapsing, budgets, nested frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .graph import held


def collapse(rows: DataFrame, group: list[str], bonus: float = 0.35) -> DataFrame:
    """(group, id, score, n): the best row speaks for its group, with a bonus that grows with the logarithm of the group and is bounded by `bonus`."""
    best = rows.groupBy(*group).agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"), F.count("*").alias("n"))
    return best.select(*group, F.col("b.id").alias("id"), F.round(-F.col("b.s") + F.least(F.lit(bonus), 0.12 * F.log(F.col("n").cast("double"))), 6).alias("score"), "n")


def excerpt(text: Column, size: Column) -> Column:
    """A text within a size: its head and its tail around a marker, at ends of sentences where there are any near the cuts."""
    marker = len(V.EXCERPT_MARKER)
    head = F.floor((size - marker) / 2).cast("int")
    tail = size - marker - head
    first, last = F.substring(text, F.lit(1), head), F.right(text, tail)
    whole = F.regexp_extract(first, r"(?s)^(.*[.!?]) ", 1)
    lead = F.regexp_extract(last, r"(?s)^(.*?[.!?] )", 1)
    first = F.when((F.length(whole) > 0) & (F.length(whole) - 1 >= F.floor(head / 2)), whole).otherwise(first)
    last = F.when((F.length(lead) > 0) & (F.length(lead) <= F.floor(tail / 2)), F.substring(last, F.length(lead) + 1, F.length(last))).otherwise(last)
    space = F.lit(" \t\n\r\x0b\f")
    cut = F.concat(F.rtrim(first, space), F.lit(V.EXCERPT_MARKER), F.ltrim(last, space))
    small = F.substring(F.lit(V.EXCERPT_TOO_SMALL), F.lit(1), F.greatest(F.lit(0), size))
    return F.when(F.length(text) <= size, text).when(size <= marker + 2, small).otherwise(cut)


def render(sections: DataFrame, tokens: int) -> DataFrame:
    """(owner, text, omitted) of sections (owner, ord, priority, cap, kind, entries): what fits a budget of tokens of four characters.

    Room goes by priority, then order, up to a section's cap (null: no cap); text comes in order. A section that does not fit is left out if it is
    `atomic`, shortened to an excerpt after its first entry if it is `excerpts`, and else keeps whole entries up to the first that does not fit. Where
    anything is missing, a notice says so. State runs over an owner's sections within a row: one array per owner, of the sections that it has.
    """
    limit = 4 * max(0, tokens)
    full = F.array_join("entries", "\n")
    own = sections.select("owner", F.struct("priority", "ord", "cap", "kind", "entries", full.alias("full")).alias("x")).filter("x.full != ''")
    per = own.groupBy("owner").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def whole_entries(entries: Column, cap: Column) -> Column:
        start = F.struct(F.lit("").alias("made"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def add(s: Column, e: Column) -> Column:
            fits = s["open"] & (F.length(s["made"]) + F.length(e) + F.when(s["n"] > 0, 1).otherwise(0) <= cap)
            made = F.when(s["n"] > 0, F.concat(s["made"], F.lit("\n"), e)).otherwise(e)
            return F.struct(F.when(fits, made).otherwise(s["made"]).alias("made"), (s["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

        return F.aggregate(entries, start, add, lambda s: s["made"])

    def step(s: Column, x: Column) -> Column:
        cap = F.least(s["left"], F.coalesce(x["cap"], s["left"]))
        head = F.get(x["entries"], F.lit(0))
        room = cap - F.length(head) - 1
        rest = F.array_join(F.slice(x["entries"], F.lit(2), F.greatest(F.lit(0), F.size(x["entries"]) - 1)), "\n")
        shortened = F.when(F.size(x["entries"]) > 1, F.when(room >= 64, F.concat(head, F.lit("\n"), excerpt(rest, room))).otherwise("")).otherwise(F.when(cap >= 64, excerpt(x["full"], cap)).otherwise(""))
        value = F.when(F.length(x["full"]) <= cap, x["full"]).when(x["kind"] == "atomic", "").when(x["kind"] == "excerpts", shortened).otherwise(whole_entries(x["entries"], cap))
        left = F.when(value != "", s["left"] - F.length(value) - 1).otherwise(s["left"])
        done = F.when(value != "", F.concat(s["done"], F.array(F.struct(x["ord"].cast("long").alias("ord"), value.alias("value"))))).otherwise(s["done"])
        return F.struct(left.cast("int").alias("left"), done.alias("done"), (s["omitted"] | (value != x["full"])).alias("omitted"))

    start = F.struct(F.lit(max(0, limit - len(V.OMISSION) - 2)).alias("left"), F.array().cast("array<struct<ord:bigint,value:string>>").alias("done"), F.lit(False).alias("omitted"))
    made = per.select("owner", F.aggregate("xs", start, step).alias("s")).select("owner", F.array_join(F.transform(F.array_sort("s.done"), lambda d: d["value"]), "\n").alias("text"), F.col("s.omitted").alias("omitted"))
    text = F.when(F.col("omitted"), F.concat("text", F.when(F.col("text") != "", "\n").otherwise(""), F.lit(V.OMISSION))).otherwise(F.col("text"))
    return made.select("owner", F.substring(text, 1, limit).alias("text"), "omitted")


def frame(owner: str, **parts: tuple[DataFrame, list[str]]) -> DataFrame:
    """One nested document per owner: for each part an array of structs in the order of its columns. Parts are aggregated before they are joined."""
    out = None
    for name, (rows, columns) in parts.items():
        own = rows.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = own if out is None else out.join(own, owner, "full")
    return out


def memory_scope(lineage: DataFrame, worlds: DataFrame, peers: DataFrame, depth: int = 64, hops: int = 8) -> DataFrame:
    """(instance, source, rank): what an instance may remember: its ancestors by depth, instances reached by continued worlds from 100000 on, peers at 200000;
    the least rank of each source. lineage (instance, parent), worlds (instance, next), peers (a, b).

    A step keeps each pair once, at its first depth, so that several ways to a source never multiply, and circles end."""

    def climb(edges: DataFrame, a: str, b: str, most: int) -> DataFrame:
        step = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).filter("_b is not null").distinct()
        found = now = step.select(F.col("_a").alias("instance"), F.col("_b").alias("source"), F.lit(1).alias("d"))
        for k in range(2, most + 1):
            now = now.join(step, now["source"] == step["_a"]).select("instance", F.col("_b").alias("source")).distinct()
            now = held(now.join(found, ["instance", "source"], "left_anti").withColumn("d", F.lit(k)))
            if now.isEmpty():
                break
            found = found.unionByName(now)
        return found

    every = lineage.select("instance").distinct()
    own = every.select("instance", F.col("instance").alias("source"), F.lit(0).alias("rank"))
    up = climb(lineage, "instance", "parent", depth).select("instance", "source", F.col("d").alias("rank"))
    on = climb(worlds, "instance", "next", hops).select("instance", "source", (F.col("d") + 100000).alias("rank"))
    side = peers.select(F.col("a").alias("instance"), F.col("b").alias("source")).unionByName(peers.select(F.col("b").alias("instance"), F.col("a").alias("source"))).withColumn("rank", F.lit(200000))
    return own.unionByName(up).unionByName(on).unionByName(side).groupBy("instance", "source").agg(F.min("rank").alias("rank"))


def same_event(pairs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(a, b, decision, event) of statement pairs (a, b) by the events that they occur in (statement, event). It is not transitive: several events on
    either side are ambiguous, two different ones a candidate to merge, one attaches the other statement, none creates one from the pair."""
    known = occurrences.groupBy("statement").agg(F.count_distinct("event").alias("n"), F.min("event").alias("event"))
    side = lambda c: known.select(F.col("statement").alias(c), F.col("n").alias(f"n{c}"), F.col("event").alias(f"e{c}"))
    j = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").na.fill(0, ["na", "nb"])
    decision = (
        F.when((F.col("na") > 1) | (F.col("nb") > 1), "ambiguous").when((F.col("na") == 1) & (F.col("nb") == 1) & (F.col("ea") != F.col("eb")), "merge_candidate")
        .when((F.col("na") == 1) & (F.col("nb") == 1), "same").when((F.col("na") == 1) | (F.col("nb") == 1), "attach").otherwise("create")
    )
    made = F.concat_ws(":", F.lit("pair"), F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"))
    j = j.withColumn("decision", decision)
    return j.select("a", "b", "decision", F.when(F.col("decision").isin("attach", "same"), F.coalesce("ea", "eb").cast("string")).when(F.col("decision") == "create", made).otherwise("").alias("event"))


def memberships(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, affinity, confidence): the best status, the largest affinity and confidence."""
    from ..functions.cognition import membership_rank

    return rows.groupBy(*keys).agg(F.max_by("status", F.struct(membership_rank(F.col("status")), "status")).alias("status"), F.max("affinity").alias("affinity"), F.max("confidence").alias("confidence"))
