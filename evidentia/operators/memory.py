"""Memory operators: whose a statement is and where it belongs, what an instance has learnt, notes, halos and links that recall draws on, and events as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import any_of


def _some(c: Column) -> Column:
    """The trimmed value, null if nothing is left."""
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def pivot(subject: Column, character: Column, speaker: Column, role: Column, recipient: Column, viewpoint: Column, ruleset: Column) -> Column:
    """Struct (subject, kind, scope, viewpoint, owner, resolved): whom a subject means.

    First person is the viewpoint: a stated one, else the character who speaks, else the speaker. Second person is the recipient. A character owns what is said
    from its own viewpoint in its own role. Reference texts (ruleset `corpus-reference-v1`) belong to their source, and no one speaks in them.
    """
    s, c, v, r = _some(subject), _some(character), _some(viewpoint), _some(recipient)
    cold = F.coalesce(ruleset == V.CORPUS_RULESET, F.lit(False))
    own = F.coalesce(role == "character", F.lit(False)) & c.isNotNull()
    seen = F.when(~cold, F.coalesce(v, F.when(own, c).otherwise(_some(speaker))))
    owner = F.when(own & (seen == c), c)
    first = any_of(F.lower(s), V.FIRST_PERSON) & seen.isNotNull()
    second = any_of(F.lower(s), V.SECOND_PERSON) & r.isNotNull() & ~cold
    kind = F.when(first, "first_person").when(second, "second_person")
    scope = F.when(owner.isNotNull(), "character").when(seen.isNotNull(), "speaker").when(second & ~F.coalesce(first, F.lit(False)), "recipient").otherwise("source")
    return F.struct(
        F.when(first, seen).when(second, r).otherwise(s).alias("subject"), kind.alias("kind"), scope.alias("scope"), seen.alias("viewpoint"), owner.alias("owner"), kind.isNotNull().alias("resolved"),
    )


def ownership(scope: Column, character: Column, world: Column, source: Column, fallback: Column) -> Column:
    """Struct (kind, key, confidence, reason): the owner that explicit facts justify; where something comes from does not make it the source's."""
    c, w, s = (_some(x) for x in (character, world, source))
    own = lambda kind, key, sure, reason: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(sure).alias("confidence"), F.lit(reason).alias("reason"))
    low = F.lower(F.coalesce(_some(scope), F.lit("")))
    observed = F.concat(F.lit("world:"), w, F.lit(":observed"))
    return (
        F.when((low == "character") & c.isNotNull(), own("character", F.concat(F.lit("char:"), c), 1.0, "explicit_character_scope"))
        .when((low == "narrative") & w.isNotNull(), own("world", observed, 1.0, "explicit_narrative_world_scope"))
        .when((low == "source") & s.isNotNull(), own("source", F.concat(F.lit("source:"), s), 1.0, "explicit_source_scope"))
        .when(low.isin("world", "observation") & w.isNotNull(), own("world", observed, 0.98, "explicit_world_scope"))
        .otherwise(own("unresolved", F.concat(F.lit("unresolved:"), fallback.cast("string")), 0.0, "insufficient_semantic_evidence"))
    )


def branch(kind: Column, family: Column, scope: Column, character: Column, instance: Column, source: Column, world: Column, fallback: Column, pivotal: Column) -> Column:
    """Struct (scope, key, branch, significance): the scope that an observation's node belongs to, and what kind of branch it starts."""
    k, f = (F.upper(F.coalesce(x, F.lit("UNKNOWN"))) for x in (kind, family))
    c, i, s, w = (_some(x) for x in (character, instance, source, world))
    at = lambda name, key: F.struct(F.lit(name).alias("scope"), key.alias("key"))
    where = (
        F.when((scope == "character") & c.isNotNull() & i.isNotNull(), at("character", F.concat(F.lit("char:"), c)))
        .when(s.isNotNull(), at("source", F.concat(F.lit("source:"), s)))
        .when(w.isNotNull(), at("world", F.concat(F.lit("world:"), w, F.lit(":observed"))))
        .otherwise(at("source", F.concat(F.lit("source:unresolved:"), fallback.cast("string"))))
    )
    turn = lambda name, weight: F.struct(F.lit(name).alias("branch"), F.lit(weight).alias("significance"))
    what = (
        F.when(f.isin("EPISTEMIC", "MEMORY") | k.isin("BELIEF", "MEMORY"), turn("epistemic_transition", 0.95))
        .when((k == "EVENT") | f.isin("ACTION", "CAUSAL", "COMMUNICATION"), turn("event", 0.90))
        .when(f == "TEMPORAL", turn("temporal_transition", 0.85))
        .when(F.coalesce(pivotal, F.lit(False)), turn("semantic_pivot", 0.75))
        .otherwise(turn("topic", 0.55))
    )
    return F.struct(where["scope"].alias("scope"), where["key"].alias("key"), what["branch"].alias("branch"), what["significance"].alias("significance"))


def acquire(events: DataFrame, retracted: DataFrame | None = None) -> DataFrame:
    """(instance, proposition, first_node, last_node, first_at, updated_at, status, confidence, mode, source, n) of acquisitions (instance, proposition, ord,
    node, at, status, confidence, mode, source): the earliest node and time stay, status and mode are the latest, and of confidence, source and last node
    the latest that is known. What is retracted (instance, proposition, ord) does not count. Aggregates: an instance's history is never sorted in one task."""
    if retracted is not None:
        events = events.join(retracted, ["instance", "proposition", "ord"], "left_anti")
    last = lambda c: F.max_by(c, "ord").alias(c)
    known = lambda c, name: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(name)
    return events.groupBy("instance", "proposition").agg(
        F.min_by("node", "ord").alias("first_node"), known("node", "last_node"), F.min_by("at", "ord").alias("first_at"), F.max_by("at", "ord").alias("updated_at"), last("status"), known("confidence", "confidence"), last("mode"),
        known("source", "source"), F.count("*").alias("n"),
    )


def judge_actions(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, allowed, rule, reason) of actions (id, world, action, actor_type, target_type, has_target) by rules (world, ord, key, kind, action, actions,
    target_types, actor_type, target_type): the first rule in order that an action breaks refuses it. '*' or null as a rule's action is any."""
    j = actions.join(rules.select("world", "ord", F.col("key").alias("rule"), "kind", F.col("action").alias("_on"), "actions", "target_types", F.col("actor_type").alias("_actor"), F.col("target_type").alias("_target")), "world")
    applies = F.coalesce(F.col("_on"), F.lit("*")).isin("*") | (F.col("_on") == F.col("action"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    fits = lambda rule, own: F.coalesce(F.col(rule), F.lit("")).isin("") | F.col(rule).eqNullSafe(F.col(own))
    reason = (
        F.when((F.col("kind") == "action_allowlist") & some("actions") & ~F.array_contains("actions", F.col("action")), "not_allowed")
        .when((F.col("kind") == "require_target") & applies & ~F.col("has_target"), "target_required")
        .when((F.col("kind") == "require_target_type") & applies & some("target_types") & ~F.coalesce(F.array_contains("target_types", F.col("target_type")), F.lit(False)), "target_type_rejected")
        .when((F.col("kind") == "deny_action") & applies & fits("_actor", "actor_type") & fits("_target", "target_type"), "denied")
    )
    broken = j.withColumn("reason", reason).filter("reason is not null").groupBy("id").agg(F.min(F.struct("ord", "rule", "reason")).alias("m"))
    return actions.select("id").join(broken, "id", "left").select("id", F.col("m").isNull().alias("allowed"), F.col("m.rule").alias("rule"), F.col("m.reason").alias("reason"))


def halo(heads: DataFrame, nodes: DataFrame, most: int = 4, characters: int = 2400) -> DataFrame:
    """(id, text, nodes) of heads (id, timeline, event) by nodes (timeline, event, node, text): the texts of the `most` latest nodes before a head, oldest
    first, and the last `characters` of them. Empty texts do not count. Rows before a head are ranked per head, with few kept before the shuffle."""
    before = heads.join(nodes.filter(F.trim("text") != "").withColumnRenamed("event", "_event"), "timeline").filter(F.col("_event") < F.col("event"))
    last = before.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_event")))).filter(F.col("_k") <= most)
    held = last.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_event", F.trim("text").alias("t"), "node"))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: r["t"]), " ")
    made = held.select("id", F.right(text, F.lit(characters)).alias("text"), F.transform("x", lambda r: r["node"]).alias("nodes"))
    return heads.select("id").join(made, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("nodes", F.array().cast(made.schema["nodes"].dataType)).alias("nodes"))


def link_topics(hits: DataFrame, topics: DataFrame, domains: DataFrame, most: int = 12, floor: float = 0.62, kept: int = 4) -> DataFrame:
    """(section, topic, similarity, place) of hits (section, document, topic, similarity): of a section's `most` nearest active topics from `floor` on, the
    first `kept` that a domain of its document has. topics (topic, domain, active); domains (document, domain). A link is a suggestion, no grant."""
    near = hits.join(topics.filter("active").select("topic", F.col("domain").alias("_domain")), "topic").filter(F.col("similarity") >= floor)
    place = lambda: F.row_number().over(Window.partitionBy("section").orderBy(F.desc("similarity"), "topic"))
    near = near.withColumn("_k", place()).filter(F.col("_k") <= most)
    near = near.join(domains.select("document", F.col("domain").alias("_domain")).distinct(), ["document", "_domain"], "left_semi")
    return near.withColumn("place", place()).filter(F.col("place") <= kept).select("section", "topic", "similarity", "place")


def notebook(lexical: DataFrame, semantic: DataFrame, limit: int = 4, characters: int = 1600) -> DataFrame:
    """(q, entry, place, excerpt, truncated): entries of a notebook for a query, by words first (q, entry, score, at, content), filled up by vectors (q, entry,
    similarity, content), each cut to what is left of a budget of characters."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("at"), "entry"))
    first = lexical.withColumn("_k", place).filter(F.col("_k") <= limit).select("q", "entry", "content", F.lit(0).alias("_list"), "_k")
    # as many of the nearest as could be asked for, were all of them known by words
    near = semantic.withColumn("_k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "entry"))).filter(F.col("_k") <= limit)
    near = near.join(first.select("q", "entry"), ["q", "entry"], "left_anti").select("q", "entry", "content", F.lit(1).alias("_list"), "_k")
    w = Window.partitionBy("q").orderBy("_list", "_k")
    rows = first.unionByName(near).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
    used = F.coalesce(F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_left", (F.lit(characters) - used).cast("int")).filter(F.col("_left") > 0)
    return rows.select("q", "entry", "place", F.substring("content", F.lit(1), F.col("_left")).alias("excerpt"), (F.length("content") > F.col("_left")).alias("truncated"))


def worker_notes(notes: DataFrame, visible: DataFrame, most: int = 2) -> DataFrame:
    """(q, run, slot, place) of notes (q, run, slot, fingerprint, node, rank, same_goal, updated, status, superseded) that match: those on the asker's ancestry
    (q, node), not refused or superseded, one of each fingerprint, the asker's own goal first, then by rank and time."""
    open_ = notes.filter("status not in ('denied', 'invalidated') and not superseded and (rank > 0 or same_goal)").join(visible, ["q", "node"], "left_semi")
    order = [F.desc("same_goal"), F.desc("rank"), F.desc("updated"), F.col("run"), F.col("slot")]
    best = open_.withColumn("_k", F.row_number().over(Window.partitionBy("q", "fingerprint").orderBy(*order))).filter("_k = 1")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("place") <= most).select("q", "run", "slot", "place")


def ancestors(heads: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(q, node): heads (q, node) and all that edges (child, parent) lead to. A step keeps each pair once, so that it ends on any graph."""
    from .graph import held

    found = now = heads.select("q", "node").distinct()
    for _ in range(most):
        now = now.join(edges.select(F.col("child").alias("node"), "parent"), "node").select("q", F.col("parent").alias("node")).distinct().join(found, ["q", "node"], "left_anti")
        now = held(now)
        if now.isEmpty():
            return found
        found = found.unionByName(now)
    raise ValueError("the ancestry is longer than `most` steps")


def queue_state(status: Column, kind: Column, eligible: Column, run_after: Column, now: Column, busy: Column) -> Column:
    """running, parked (a goal's job that may not run), delayed, waiting (behind another of its instance) or runnable."""
    goal = kind.isin(*V.GOAL_JOBS)
    return (
        F.when(status == "running", "running").when(goal & ~F.coalesce(eligible, F.lit(False)), "parked").when(run_after > now, "delayed")
        .when((kind == V.GOAL_JOBS[0]) & F.coalesce(busy, F.lit(False)), "waiting").otherwise("runnable")
    )


def queue_depths(jobs: DataFrame, now: Column) -> DataFrame:
    """(kind, lane, queued, running, parked, delayed, waiting, oldest) of jobs (kind, lane, status, instance, eligible, run_after, created): depths by state,
    and the age in seconds of the oldest that could run. Parked and delayed work never counts as lag."""
    busy = jobs.filter((F.col("status") == "running") & (F.col("kind") == V.GOAL_JOBS[0])).select("instance").distinct().withColumn("_busy", F.lit(True))
    open_ = jobs.filter(F.col("status").isin("queued", "running")).join(busy, "instance", "left")
    open_ = open_.withColumn("state", queue_state(F.col("status"), F.col("kind"), F.col("eligible"), F.col("run_after"), now, F.col("_busy")))
    count = lambda state, name: F.count_if(F.col("state") == state).alias(name)
    oldest = F.min(F.when(F.col("state") == "runnable", F.unix_timestamp("created")))
    return open_.groupBy("kind", "lane").agg(count("runnable", "queued"), *[count(s, s) for s in ("running", "parked", "delayed", "waiting")], F.coalesce(F.unix_timestamp(now) - oldest, F.lit(0)).alias("oldest"))


def rolling_rates(jobs: DataFrame, now: Column) -> DataFrame:
    """One row (arrivals_30s, done_30s, live_arrivals_30s, live_done_30s, failed_60s) of jobs (lane, status, created, updated)."""
    new, done = F.col("created") >= now - F.make_interval(secs=F.lit(30)), (F.col("status") == "done") & (F.col("updated") >= now - F.make_interval(secs=F.lit(30)))
    live = F.col("lane") == "LIVE"
    failed = (F.col("status") == "failed") & (F.col("updated") >= now - F.make_interval(secs=F.lit(60)))
    return jobs.agg(*[F.count_if(c).alias(n) for n, c in (("arrivals_30s", new), ("done_30s", done), ("live_arrivals_30s", live & new), ("live_done_30s", live & done), ("failed_60s", failed))])


def changed(marks: DataFrame, runs: DataFrame, now: Column, coalesce: int = 30) -> DataFrame:
    """(key, due) of marks (key, mark): whether a stage has to run again: there is a mark newer than that of its last finished run (key, mark, finished), which
    ended at least `coalesce` seconds ago."""
    last = runs.groupBy("key").agg(F.max_by("mark", "finished").alias("_mark"), F.max("finished").alias("_at"))
    newest = marks.groupBy("key").agg(F.max("mark").alias("mark")).join(last, "key", "left")
    again = (F.col("mark") > F.col("_mark")) & (F.unix_timestamp(now) - F.unix_timestamp("_at") >= coalesce)
    return newest.select("key", F.coalesce(F.col("mark").isNotNull() & (F.col("_mark").isNull() | again), F.lit(False)).alias("due"))


def _clean(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _informative(c: Column) -> Column:
    return ~any_of(F.lower(c), V.LOW_INFORMATION_PARTS) & (F.length(c) > 1)


def _sentence(s: Column, p: Column, o: Column) -> Column:
    return (
        F.when(~_informative(s), "").when(any_of(p, ("be", "identity")) & _informative(o), F.concat(s, F.lit(" was "), o, F.lit("."))).when(_informative(p) & _informative(o), F.concat(s, F.lit(" "), p, F.lit(" "), o, F.lit(".")))
        .when(_informative(p), F.concat(s, F.lit(" "), p, F.lit("."))).otherwise("")
    )


def event_texts(members: DataFrame) -> DataFrame:
    """(event, text, primary, n) of members (event, id, subject, predicate, object, text, total): the richest action of an event, or else its richest member, as
    a sentence, and up to two states beside it. An event's members are one array."""
    s, p, o = _clean(F.col("subject")), _clean(F.col("predicate")), _clean(F.col("object"))
    rich = _informative(s).cast("int") + _informative(o).cast("int")
    still = any_of(F.lower(p), V.STATE_VERBS)
    row = F.struct(
        (-F.coalesce("total", F.lit(0.0))).alias("a"), (-rich).alias("b"), (-F.length(_clean(F.col("text")))).alias("c"), (-F.col("id")).alias("d"), F.col("id").alias("id"), (~still & _informative(s)).alias("acts"), still.alias("still"),
        _sentence(s, p, o).alias("said"), _sentence(s, F.lower(p), o).alias("state"), _clean(F.col("text")).alias("text"),
    )
    per = members.groupBy("event").agg(F.sort_array(F.collect_list(row)).alias("x"), F.count("*").alias("n"))
    per = per.withColumn("top", F.coalesce(F.get(F.filter("x", lambda r: r["acts"]), F.lit(0)), F.get("x", F.lit(0))))
    states = F.transform(F.filter("x", lambda r: r["still"] & (r["id"] != F.col("top.id")) & (r["state"] != "") & (F.lower(r["state"]) != F.lower(F.col("top.said")))), lambda r: r["state"])
    text = F.when(F.col("top.said") != "", F.col("top.said")).otherwise(F.col("top.text"))
    two = F.slice(F.array_distinct(states), 1, 2)
    return per.select("event", F.when(text != "", F.array_join(F.concat(F.array(text), two), " ")).otherwise("").alias("text"), F.col("top.id").alias("primary"), "n")


def anchored_passage(source: Column, anchor: Column, lo: Column, hi: Column, kind: Column, budget: int = 650) -> Column:
    """Struct (start, end, method, verified): the part of a source around its anchor, with most of the context before it.

    A span that holds the anchor is taken as it is; else the anchor must occur exactly once, in either case. An anchor that cannot be found gives nothing
    rather than something likely; without an anchor the source's beginning is given, unverified. Places are code points, end exclusive.
    """
    budget = max(100, min(budget, 650))
    text, needle = F.coalesce(source, F.lit("")), F.trim(F.coalesce(anchor, F.lit("")))
    size = F.length(text)
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    spanned = F.coalesce((lo >= 0) & (lo < hi) & (hi <= size) & ((needle == "") | (F.trim(F.substring(text, lo + 1, hi - lo)) == needle)), F.lit(False))
    first = F.instr(F.lower(text), F.lower(needle)) - 1
    after = F.instr(F.substring(F.lower(text), first + 1 + F.length(needle), size), F.lower(needle)) > 0
    once = (needle != "") & (first >= 0) & ~after
    part = lambda a, b, method, verified: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(method).alias("method"), F.lit(verified).alias("verified"))

    def around(a: Column, b: Column, method: str) -> Column:
        share = F.when(F.coalesce(kind, F.lit("unresolved_reference")) == "unresolved_reference", 0.78).otherwise(0.58)
        lead = F.greatest(F.lit(0), a - F.floor((budget - (b - a)) * share).cast("int"))

        def ends(start: Column) -> Column:
            end = F.least(size, start + budget)
            start = F.when(end < b, F.greatest(F.lit(0), b - budget)).otherwise(start)
            end = F.least(size, start + budget)
            # to white space near either end, without touching the anchor
            gap = F.instr(F.substring(text, start + 1, F.least(F.lit(24), a - start)), " ")
            moved = F.when((start > 0) & (start < a) & (gap > 0), start + gap).otherwise(start)
            back = F.instr(F.reverse(F.substring(text, F.greatest(b, end - 24) + 1, end - F.greatest(b, end - 24))), " ")
            return part(moved, F.when((end < size) & (end > b) & (back > 0), end - back).otherwise(end), method, True)

        return F.when(b - a >= budget, part(a, F.least(size, a + budget), method, True)).otherwise(let(lead, ends))

    return (
        F.when(spanned, let(F.struct(lo.cast("int").alias("a"), hi.cast("int").alias("b")), lambda s: around(s["a"], s["b"], "verified_span")))
        .when(once, let(first, lambda a: around(a, a + F.length(needle), "unique_exact_text")))
        .when(needle == "", part(F.lit(0), F.least(size, F.lit(budget)), "unanchored_prefix", False))
        .when(first >= 0, part(F.lit(0), F.lit(0), "ambiguous_anchor", False))
        .otherwise(part(F.lit(0), F.lit(0), "anchor_not_found", False))
    )


def frame_places(frames: DataFrame) -> DataFrame:
    """(frame, root, place, depth) of frames (frame, parent, sentence, ord): roots of a sentence in order, and children in order below their parent, each one's
    place among its siblings. Parents that are not of the sentence make roots."""
    known = frames.select(F.col("frame").alias("parent"), "sentence", F.lit(True).alias("_known"))
    own = frames.join(known, ["parent", "sentence"], "left").withColumn("parent", F.when(F.col("_known"), F.col("parent"))).drop("_known")
    place = F.row_number().over(Window.partitionBy("sentence", "parent").orderBy("ord", "frame"))
    own = own.withColumn("place", place)
    from .graph import held

    own = held(own)
    now = own.filter("parent is null").select("frame", F.col("frame").alias("root"), "place", F.lit(0).alias("depth"))
    found = [now]
    while True:
        up = now.select(F.col("frame").alias("parent"), "root", "depth")
        now = held(own.filter("parent is not null").select("frame", "parent", "place").join(up, "parent").select("frame", "root", "place", (F.col("depth") + 1).alias("depth")))
        if now.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(now)
