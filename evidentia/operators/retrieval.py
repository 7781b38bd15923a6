"""Retrieval operators: access filters, hybrid ranking, relevance and selections under budgets."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import research_terms
from .folds import ordered


def prefixes(path: Column, separator: str = ".") -> Column:
    """The path itself and all its ancestors, so that a prefix join is an equi-join."""
    parts = F.split(path, f"[{separator}]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), separator))


def visible(docs: DataFrame, allow: DataFrame, deny: DataFrame, path_col: str = "path") -> DataFrame:
    """docs that are public or below an allowed path, and below no denied one. allow and deny have one column, path."""
    spread = docs.withColumn("_up", F.explode(prefixes(F.col(path_col))))
    denied = spread.join(deny.select(F.col("path").alias("_up")), "_up", "left_semi").select("doc_id").distinct()
    allowed = spread.join(allow.select(F.col("path").alias("_up")), "_up", "left_semi").select("doc_id").distinct().withColumn("_allowed", F.lit(True))
    return docs.join(denied, "doc_id", "left_anti").join(allowed, "doc_id", "left").filter(F.col("public") | F.coalesce("_allowed", F.lit(False))).drop("_allowed")


def term_index(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, term, tf, length): one row per term of a document."""
    found = docs.select(F.col(id_col).alias("id"), F.explode(terms).alias("term"))
    counts = found.groupBy("id", "term").agg(F.count("*").alias("tf"))
    return counts


def lexical(queries: DataFrame, index: DataFrame, most: int | None = None) -> DataFrame:
    """(q, id, hits, score, rank) of documents that have any term of a query (q, terms): log-weighted term counts, ties by id."""
    wanted = queries.select("q", F.explode("terms").alias("term"))
    found = index.join(wanted, "term").groupBy("q", "id").agg(F.count("*").alias("hits"), F.round(F.sum(F.log1p("tf")), 6).alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("hits"), F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= most) if most else ranked


def reciprocal_ranks(lists: dict[str, DataFrame], boosts: DataFrame | None = None) -> DataFrame:
    """(q, id, score, one rank per list): sum of 100 / (60 + rank), and what boosts (q, id, boost) add. Missing ranks add nothing."""
    names = list(lists)
    rows = None
    for name, df in lists.items():
        own = df.select("q", "id", F.lit(name).alias("list"), "rank")
        rows = own if rows is None else rows.unionByName(own)
    merged = rows.groupBy("q", "id").agg(*[F.min(F.when(F.col("list") == n, F.col("rank"))).alias(n) for n in names])
    score = sum((F.coalesce(100.0 / (60 + F.col(n)), F.lit(0.0)) for n in names), F.lit(0.0))
    if boosts is not None:
        merged = merged.join(boosts, ["q", "id"], "left")
        score = score + F.coalesce("boost", F.lit(0.0))
    return merged.select("q", "id", *names, F.round(score, 6).alias("score"))


def diverse(hits: DataFrame, group: str, most: int) -> DataFrame:
    """The first hit of each group, then what is left, up to `most` per query."""
    per = F.row_number().over(Window.partitionBy("q", group).orderBy(F.desc("score"), "id"))
    ranked = hits.withColumn("_n", F.when(per == 1, 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy("q").orderBy("_n", F.desc("score"), "id"))
    return ranked.withColumn("place", place).filter(F.col("place") <= most).drop("_n")


def word_overlap(a: Column, b: Column) -> Column:
    """Cosine of two word sets."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt((F.size(F.array_distinct(a)) * F.size(F.array_distinct(b))).cast("double")))


def words(text: Column) -> Column:
    """Distinct words of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_'-]+"), F.lit(0)))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def relevance(
    words: Column, focus: Column, goals: Column, age_hours: Column, rank: Column, similarity: Column, active: Column, related: Column, emotional: Column, affinity: Column, salience: Column, attention: Column,
    confidence: Column, distance: Column, visible: Column, status: Column,
) -> Column:
    """Relevance of a candidate; its parts are independent of each other. age_hours is against a given time, never the clock. related: it is a relationship
    or has trust. Unknown values are null."""
    none = lambda c: F.coalesce(c, F.lit(0.0))
    recency = F.when(age_hours.isNotNull(), 1.4 / (1 + F.log1p(F.greatest(F.lit(0.0), age_hours)))).otherwise(1.0 / (1 + F.greatest(F.lit(0), F.coalesce(rank, F.lit(0)))))
    known = F.coalesce(active, F.lit(False))
    return (
        recency + word_overlap(words, focus) + 1.3 * word_overlap(words, goals) + 1.8 * clip(none(similarity)) + F.when(known, 1.4).otherwise(0.0)
        + F.when(F.coalesce(related, F.lit(False)), F.when(known, 1.3).otherwise(0.8)).otherwise(0.0) + F.least(F.lit(1.0), F.greatest(none(emotional), F.abs(none(affinity))))
        + F.least(F.lit(1.2), F.greatest(none(salience), none(attention))) + 0.8 * clip(F.coalesce(confidence, F.lit(0.5))) + none(1.2 / (1 + F.greatest(F.lit(0), distance)))
        - F.when(F.coalesce(visible, F.lit(True)), 0.0).otherwise(100.0) - F.when(F.lower(status).isin("rejected", "superseded", "disbelieved"), 2.0).otherwise(0.0)
    )


def quality_penalty(subject: Column, predicate: Column, object_: Column, focus: Column) -> Column:
    """What vague subjects, empty complements and incidental scene details cost a memory in recall."""
    s, p, o = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (subject, predicate, object_))
    vague = s.isin(*V.LOW_INFORMATION_SUBJECTS)
    bare = F.size(F.filter(words(o), lambda w: ~w.isin("a", "an", "the", "some"))) <= 1
    incidental = F.array_intersect(words(s), F.array(*map(F.lit, V.INCIDENTAL_SUBJECTS)))
    return (
        F.when(vague, 0.8).otherwise(0.0) + F.when(p.isin("be", "identity", "have") & (vague | bare), 0.5).otherwise(0.0) + F.when(o.isin("", "_", "*"), 1.0).otherwise(0.0)
        + F.when((F.size(incidental) > 0) & ~F.arrays_overlap(incidental, focus), 0.9).otherwise(0.0)
    )


def recall_score(total: Column, salience: Column, attention: Column, emotional: Column, confidence: Column, kind: Column, depth: Column, penalty: Column) -> Column:
    """What a candidate competes with: its relevance, bonuses for salience, confidence and lasting kinds, less its distance in continuity and its penalty.

    Depths from 100000 on are ranks of a character's continuity, not steps.
    """
    none = lambda c: F.coalesce(c, F.lit(0.0))
    steps = F.greatest(F.lit(0), F.coalesce(depth, F.lit(0)))
    steps = F.when(steps >= 100000, steps - 99999).otherwise(steps)
    bonus = 0.45 * clip(F.greatest(none(salience), none(attention), none(emotional))) + 0.25 * clip(F.coalesce(confidence, F.lit(0.5)))
    return none(total) + bonus + F.when(F.upper(F.coalesce(kind, F.lit("BELIEF"))).isin(*V.FAVOURED_KINDS), 0.25).otherwise(0.0) - F.least(F.lit(0.9), 0.16 * F.log1p(steps.cast("double"))) - penalty


def speech_fragment(predicate: Column, object_: Column) -> Column:
    """Whether a memory only tells of someone's voice or tone."""
    o = F.btrim(F.lower(F.coalesce(object_, F.lit(""))), F.lit(" ."))
    return F.lower(F.coalesce(predicate, F.lit(""))).isin(*V.SPEECH_PREDICATES) & o.rlike(V.SPEECH_FRAGMENT)


def compete(candidates: DataFrame, focus: Column) -> DataFrame:
    """(owner, id, score, words, polarity, established, statement, text) for recall(), of candidates (owner, id, total, subject, predicate, object, topic, text,
    polarity, salience, attention, emotional, confidence, kind, depth, committed, statement).

    Of several retrievals of an id the one with the largest total counts; speech fragments are left out. committed: a provisional reading of a message.
    """
    c = candidates.filter(~speech_fragment(F.col("predicate"), F.col("object")))
    rest = [n for n in c.columns if n not in ("owner", "id", "total")]
    best = c.groupBy("owner", "id").agg(F.max(F.struct(F.coalesce("total", F.lit(0.0)).alias("total"), *rest)).alias("m")).select("owner", "id", "m.*")
    penalty = quality_penalty(F.col("subject"), F.col("predicate"), F.col("object"), focus)
    score = recall_score(F.col("total"), F.col("salience"), F.col("attention"), F.col("emotional"), F.col("confidence"), F.col("kind"), F.col("depth"), penalty)
    said = words(F.concat_ws(" ", "topic", "subject", "predicate", "object", "text"))
    return best.select("owner", "id", score.alias("score"), said.alias("words"), F.coalesce("polarity", F.lit(1)).alias("polarity"), (~F.coalesce("committed", F.lit(False))).alias("established"), F.coalesce("statement", F.lit(False)).alias("statement"), F.lower("text").alias("text"))


def recall(candidates: DataFrame, most: int = 12, floor: float = 1.35, established: float = 0.86, provisional: float = 0.72) -> DataFrame:
    """(owner, id, score, place): per owner, candidates (owner, id, score, words, polarity, established, and optionally statement, text) at or above the
    floor, established ones first, best first, skipping what is too like a chosen one of the same polarity; a literal statement is only like its own text.

    An owner's candidates stream by in order; only the chosen ones are held.
    """
    for name, none in (("statement", F.lit(False)), ("text", F.lit(""))):
        candidates = candidates if name in candidates.columns else candidates.withColumn(name, none)

    def step(chosen: list, r: dict):
        if len(chosen) >= most:
            return
        own, limit = set(r["words"] or ()), established if r["established"] else provisional
        for polarity, seen, statement, text in chosen:
            if polarity == r["polarity"] and own and seen and not ((statement or r["statement"]) and text != r["text"]) and len(own & seen) / (len(own) * len(seen)) ** 0.5 >= limit:
                return
        chosen.append((r["polarity"], own, r["statement"], r["text"]))
        yield r["id"], r["score"], len(chosen)

    rows = candidates.filter(F.col("score") >= floor).select("owner", "id", "score", "words", "polarity", "established", "statement", "text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered(rows, "owner", [F.desc("established"), F.desc("score"), "id"], list, step, f"owner {kinds['owner']}, id {kinds['id']}, score double, place int")


def evidence_status(demands: DataFrame, items: DataFrame) -> DataFrame:
    """(q, status, reason, supporting): whether items (q, id, subject, predicate, object, topic, text, kind) establish what demands (q, route, kind, topics,
    subject) of the route `character` ask for; up to eight ids, least first."""
    asked = demands.filter("route = 'character'").select("q", F.col("kind").alias("asked"), "topics", research_terms(F.coalesce("subject", F.lit("")), 16).alias("whom"))
    terms = lambda *cs: research_terms(F.concat_ws(" ", *cs), 128)
    j = asked.join(items, "q", "left")
    topical = (F.size("topics") == 0) | F.arrays_overlap("topics", F.array_union(terms("subject", "predicate", "object", "topic"), terms("text")))
    about = (F.size("whom") == 0) | F.arrays_overlap("whom", terms("subject"))
    prefers = about & F.arrays_overlap(terms("predicate"), F.array(*map(F.lit, V.PREFERENCE_PREDICATES)))
    lived = F.upper(F.coalesce("kind", F.lit(""))).isin("EVENT", "MEMORY")
    shown = F.when(F.col("asked") == "preference", prefers).otherwise(lived)
    j = j.withColumn("related", F.coalesce(F.col("id").isNotNull() & topical, F.lit(False))).withColumn("shown", F.coalesce(F.col("related") & shown, F.lit(False)))
    eight = lambda c: F.slice(F.sort_array(F.collect_set(F.when(c, F.col("id")))), 1, 8)
    g = j.groupBy("q").agg(F.max("shown").alias("shown"), F.max("related").alias("related"), eight(F.col("shown")).alias("a"), eight(F.col("related")).alias("b"))
    status = F.when(F.col("shown"), "established").when(F.col("related"), "partial").otherwise("unestablished")
    reason = F.when(F.col("shown"), "relation_supported").when(F.col("related"), "topic_related_relation_unestablished").otherwise("no_related_character_evidence")
    return g.select("q", status.alias("status"), reason.alias("reason"), F.when(F.col("shown"), F.col("a")).otherwise(F.col("b")).alias("supporting"))


def focus_terms(*values: Column, most: int = 12, anchors: int = 5) -> Column:
    """At most `most` distinct words of three letters or more: all, if there are no more. Else names with an underscore and the first `anchors` further words
    of each of the first two values come first, and what room is left is spread evenly over the others."""
    of = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_'-]+"), F.lit(0)), lambda w: F.length(w) >= 3))
    # each list is made once: an expression that lambdas refer to would be made again in each of them
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    none = F.array().cast("array<string>")

    def spread(plain: Column, room: Column) -> Column:
        step = F.size(plain) / room
        return F.transform(F.sequence(F.lit(0), F.greatest(room, F.lit(1)) - 1), lambda k: F.get(plain, F.least(F.floor(k * step).cast("int"), F.size(plain) - 1)))

    def chosen(every: Column, lists: list[Column]) -> Column:
        first = F.filter(every, lambda w: w.contains("_"))
        for own in lists:
            first = F.concat(first, F.slice(F.array_except(own, first), 1, anchors))

        def with_first(first: Column) -> Column:
            room = most - F.least(F.lit(most), F.size(first))
            rest = let(F.array_except(every, first), lambda plain: F.when(room <= 0, none).when(F.size(plain) <= room, plain).otherwise(spread(plain, room)))
            return F.slice(F.concat(first, rest), 1, most)

        return F.when(F.size(every) <= most, every).otherwise(let(first, with_first))

    lists = F.struct(*[of(v).alias(f"x{k}") for k, v in enumerate(values)])
    return let(lists, lambda x: let(F.array_distinct(F.concat(*[x[f"x{k}"] for k in range(len(values))])), lambda every: chosen(every, [x[f"x{k}"] for k in range(min(2, len(values)))])))


def trim(items: DataFrame, budget: int) -> DataFrame:
    """(owner, id, cost, place, excerpted) of items (owner, id, ord, text) kept in order within a budget of tokens of four characters, one at least.

    What doesn't fit is skipped, later and shorter ones may still fit. If nothing is kept yet, what doesn't fit is kept as an excerpt of the whole budget
    (see presentation.excerpt), and ends the list. Costs stream by in order of an owner's items; texts stay where they are.
    """

    def step(state: dict, r: dict):
        if state["ended"]:
            return
        fits = state["used"] + r["cost"] <= budget
        if not fits and not state["kept"]:
            state["ended"] = True
        if fits or (state["ended"] and budget > 0):
            state["used"] += r["cost"]
            state["kept"] += 1
            yield r["id"], r["cost"], state["kept"] - 1, not fits

    costs = items.select("owner", "id", "ord", F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("int").alias("cost"))
    kinds = {f.name: f.dataType.simpleString() for f in costs.schema}
    return ordered(costs, "owner", ["ord", "id"], lambda: {"used": 0, "kept": 0, "ended": False}, step, f"owner {kinds['owner']}, id {kinds['id']}, cost int, place int, excerpted boolean")


@dataclass(frozen=True)
class Access:
    """Who may see what: documents (document, public); scopes (document, path); domains (document, domain) of each document; grants (who, path, allowed) of a
    path and all below it, a denial being stronger; held (who, domain) domains of each asker."""

    documents: DataFrame
    scopes: DataFrame
    domains: DataFrame
    grants: DataFrame
    held: DataFrame

    def filter(self, rows: DataFrame) -> DataFrame:
        """rows (who, document, ...) that may be seen, with domain: whether a domain of the document is the asker's own. Only pairs in rows are judged, so
        that public documents are never multiplied by askers."""
        up = self.scopes.select("document", F.explode(prefixes(F.col("path"))).alias("path")).distinct()
        by_path = up.join(self.grants, "path").groupBy("who", "document").agg(F.max("allowed").alias("_granted"), F.max(~F.col("allowed")).alias("_denied"))
        by_domain = self.domains.join(self.held, "domain").select("who", "document").distinct().withColumn("domain", F.lit(True))
        known = rows.join(self.documents.select("document", F.col("public").alias("_public")), "document").join(by_path, ["who", "document"], "left").join(by_domain, ["who", "document"], "left")
        known = known.na.fill(False, ["_public", "_granted", "_denied", "domain"])
        return known.filter("(_public or _granted or domain) and not _denied").drop("_public", "_granted", "_denied")


def hybrid(queries: DataFrame, sections: DataFrame, lexical_hits: DataFrame, vector_hits: DataFrame, topic_hits: DataFrame, access: Access, facets: DataFrame | None = None, floor: float = 0.58, most: int = 96, limit: int = 8) -> DataFrame:
    """(q, id, document, score, lexical, semantic, topic, place): sections (id, document) found for queries (q, who, terms) by words, vectors or topics, of
    documents that the asker may see, best first.

    lexical_hits (q, id, score), vector_hits (q, id, similarity), topic_hits (q, id), facets (document, value). Access is judged before ranks are given, so
    that what is hidden moves nothing. Reciprocal ranks of words and of the `most` nearest vectors from `floor` on are added, .40 for a topic, .10 for a domain
    of the asker, .05 for a facet that a query term names. The first section of each document comes before further ones.
    """
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))
    near = vector_hits.filter(F.col("similarity") >= floor).withColumn("semantic", place).filter(F.col("semantic") <= most)
    kinds = {"words": "double", "semantic": "int", "topic": "boolean"}
    row = lambda hits, **own: hits.select("q", "id", *[own.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
    rows = row(lexical_hits, words=F.col("score")).unionByName(row(near, semantic=F.col("semantic"))).unionByName(row(topic_hits, topic=F.lit(True)))
    found = rows.groupBy("q", "id").agg(F.max("words").alias("words"), F.min("semantic").alias("semantic"), F.coalesce(F.max("topic"), F.lit(False)).alias("topic"))
    found = access.filter(found.join(sections, "id").join(queries.select("q", "who"), "q"))
    if facets is None:
        found = found.withColumn("facet", F.lit(False))
    else:
        named = facets.select("document", F.lower("value").alias("term")).join(queries.select("q", F.explode("terms").alias("term")), "term").select("q", "document").distinct()
        found = found.join(named.withColumn("facet", F.lit(True)), ["q", "document"], "left")
    rank = F.row_number().over(Window.partitionBy("q", F.col("words") > 0).orderBy(F.desc("words"), "id"))
    found = found.withColumn("lexical", F.when(F.col("words") > 0, rank))
    part = lambda c: F.coalesce(100.0 / (60 + F.col(c)), F.lit(0.0))
    flag = lambda c, w: F.when(F.coalesce(F.col(c), F.lit(False)), w).otherwise(0.0)
    scored = found.withColumn("score", F.round(part("lexical") + part("semantic") + flag("topic", 0.40) + flag("domain", 0.10) + flag("facet", 0.05), 6))
    return diverse(scored, "document", limit).select("q", "id", "document", "score", "lexical", "semantic", "topic", "place")


def densest(text: str, terms: list[str], size: int = 700, lead: int = 100) -> int:
    """Start of the window with most words that begin with a term, the earliest of equal ones; windows start `lead` characters before such a word."""
    heads = tuple(terms)
    places = [m.start() for m in re.finditer(r"[A-Za-z0-9_-]+", text) if m[0].lower().startswith(heads)]
    starts = {max(0, p - lead) for p in places} or {0}
    return max(starts, key=lambda s: (bisect_left(places, s + size) - bisect_left(places, s), -s))


def passage(text: Column, terms: Column, size: int = 700) -> Column:
    """Struct (start, passage): the window of `size` characters with most occurrences of the terms anywhere in the text, the earliest of equal ones."""

    def run(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        starts = [None if t is None else densest(t, [] if w is None else list(w), size) for t, w in zip(texts, wanted, strict=True)]
        return pd.DataFrame({"start": pd.array(starts, dtype="Int32"), "passage": [None if t is None else t[s : s + size] for t, s in zip(texts, starts, strict=True)]})

    return F.pandas_udf(run, "start int, passage string")(text, terms)


def widen(hits: DataFrame, least: int) -> DataFrame:
    """hits (q, stage, id, score) of stages up to and with the first at which a query has `least` distinct ids; an id counts at its earliest stage."""
    first = hits.groupBy("q", "id").agg(F.min(F.struct("stage", (-F.col("score")).alias("s"))).alias("m")).select("q", "id", F.col("m.stage").alias("stage"), (-F.col("m.s")).alias("score"))
    per = first.groupBy("q", "stage").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = per.withColumn("before", before).filter(F.col("before") < least).select("q", "stage")
    return first.join(open_, ["q", "stage"], "left_semi")


def world_scopes(relations: DataFrame, shut: DataFrame, depth: int = 4) -> DataFrame:
    """(world, domain, source, rank, depth): for each domain, the worlds that a world inherits from by relations (world, source, priority, domains, enabled), at
    the least rank and depth; a step adds 100000 and its priority. Nothing is inherited by, or through, a world that keeps the domain to itself (shut: world,
    domain). A way never returns to a world that it has passed; a way is held as long as it can still be continued, `depth` steps at most."""
    named = relations.filter("enabled").select("world", "source", "priority", F.explode("domains").alias("d")).select("world", "source", "priority", F.lower(F.trim("d")).alias("domain"))
    edges = named.filter(F.col("domain").rlike("^[a-z][a-z0-9_]{0,31}$")).distinct().join(shut, ["world", "domain"], "left_anti")
    now = edges.select("world", "domain", "source", (100000 + F.col("priority")).alias("rank"), F.lit(1).alias("depth"), F.array("world", "source").alias("path"))
    found = now
    step = edges.select(F.col("world").alias("source"), "domain", F.col("source").alias("_next"), F.col("priority").alias("_priority"))
    for _ in range(1, depth):
        now = now.join(step, ["source", "domain"]).filter(~F.array_contains("path", F.col("_next")))
        now = now.select("world", "domain", F.col("_next").alias("source"), (F.col("rank") + 100000 + F.col("_priority")).alias("rank"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("_next")).alias("path"))
        found = found.unionByName(now)
    return found.groupBy("world", "domain", "source").agg(F.min("rank").alias("rank"), F.min("depth").alias("depth"))


def fair_share(rows: DataFrame, limit: int, share: float = 0.75) -> DataFrame:
    """(id, band) of rows (id, at, foreground), `limit` at most: what is in the foreground, oldest first (band 0); of the room that is left the oldest others
    (1) for `share` of it, and the newest for the rest (2), none twice. Each band keeps few candidates per task; two counts reach the driver."""
    from .graph import held

    front = held(rows.filter("foreground").orderBy("at", "id").limit(limit).select("id", "at", F.lit(0).alias("band")))
    room = max(0, limit - front.count())
    old = int(room * share)
    others = rows.filter(~F.col("foreground"))
    backlog = held(others.orderBy("at", "id").limit(old).select("id", "at", F.lit(1).alias("band")))
    fresh = others.join(backlog.select("id"), "id", "left_anti").orderBy(F.desc("at"), "id").limit(room - old).select("id", "at", F.lit(2).alias("band"))
    return front.unionByName(backlog).unionByName(fresh).select("id", "band")
