"""Queries over times, memory scopes, learning, budgets and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cognition as C
from ..functions import text as T
from ..functions import values as V
from ..operators import presentation as P
from .registry import query, table


@query("""SELECT event_id, CASE WHEN s < 0 THEN '' WHEN s >= 86400 THEN 'seen ' || (s // 86400) || 'd ago' WHEN s >= 3600 THEN 'seen ' || (s // 3600) || 'h ago' WHEN s >= 60 THEN 'seen ' || (s // 60) || 'm ago' ELSE 'seen <1m ago' END AS age FROM (SELECT event_id, (epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', ts)))::BIGINT AS s FROM events)""")
def age_labels(spark, sf):
    """Ages as of a given time; what is yet to come has none."""
    s = F.unix_timestamp(F.lit("2024-01-20 00:00:00").cast("timestamp")) - F.unix_timestamp("ts")
    return table(spark, sf, "events").select("event_id", C.age_label(s, F.lit("seen")).alias("age"))


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderkey % 9 AS k, o_orderkey % 400 AS n, epoch(o_orderdate)::BIGINT AS said, epoch(date_trunc('day', o_orderdate))::BIGINT AS noon FROM orders),
d AS (SELECT id, k, said, CASE k WHEN 0 THEN said + n * 3600 WHEN 1 THEN noon + 86400 + 480 * 60 WHEN 2 THEN noon + 1080 * 60 WHEN 3 THEN said + n * 604800 WHEN 4 THEN said + 3600 WHEN 6 THEN noon + 86400 + 540 * 60 WHEN 7 THEN noon + 1020 * 60 END AS due,
 CASE k WHEN 0 THEN said + n * 3600 WHEN 1 THEN noon + 86400 + 720 * 60 WHEN 2 THEN noon + 1439 * 60 WHEN 3 THEN said + n * 604800 WHEN 4 THEN said + 3600 WHEN 6 THEN noon + 86400 + 1020 * 60 WHEN 7 THEN noon + 1260 * 60 END AS till FROM t)
SELECT id, coalesce(CASE WHEN due > said AND due <= said + 366 * 86400 THEN due END, -1) AS due, coalesce(CASE WHEN due > said AND due <= said + 366 * 86400 THEN till END, -1) AS until FROM d""")
def natural_time_windows(spark, sf):
    """What expressions of time mean, from the order's date on: durations, parts of days, a vague one with a delay, one that was not said, one out of range."""
    k, n = F.col("o_orderkey") % 9, (F.col("o_orderkey") % 400).cast("string")
    named = {0: F.concat(F.lit("In "), n, F.lit(" hours")), 1: F.lit("tomorrow  morning"), 2: F.lit("today tonight"), 3: F.concat(F.lit("in "), n, F.lit(" weeks")), 4: F.lit("later"), 5: F.lit("today"), 6: F.lit("tomorrow"), 7: F.lit("today evening")}
    phrase = F.coalesce(*[F.when(k == j, v) for j, v in named.items()], F.lit("some day"))
    said = F.when(k == 5, "call me").otherwise(F.concat(F.lit("Call me "), phrase, F.lit(", please")))
    at = F.col("o_orderdate").cast("timestamp")
    w = C.time_window(phrase, said, at, at, F.lit("UTC"), F.lit(3600))
    second = lambda c: F.coalesce(F.unix_timestamp(c), F.lit(-1)).cast("long")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), second(w["due"]).alias("due"), second(w["until"]).alias("until"))


@query("""WITH c AS (SELECT p_partkey AS id, p_size / 100.0::DOUBLE AS r, 1 + p_partkey % 5 AS k, p_partkey % 7 AS e, p_partkey % 3 AS f, (p_partkey % 11) / 10.0::DOUBLE AS c FROM part)
SELECT id, round(0.20 * least(1.0, 4 * r) + 0.10 / k + 0.15 * least(1.0, e / 3) + 0.18 * least(1.0, f / 2) + 0.12 * c + 0.12 * c + 0.06 * r + 0.05 * c + 0.02 * r, 6) AS score, round(0.20 * least(1.0, 4 * r) + 0.10 / k + 0.15 * least(1.0, e / 3) + 0.18 * least(1.0, f / 2) + 0.24 * c + 0.08 * r + 0.05 * c, 6) >= 0.72 AS eligible FROM c""")
def learning_scores(spark, sf):
    """What parts, taken as sections, have earned to be learnt."""
    p = F.col("p_partkey")
    r, c = F.col("p_size") / 100.0, p % 11 / 10.0
    s = C.learning_score(r, 1 + p % 5, p % 7, p % 3, c, c, r, c, r)
    return table(spark, sf, "part").select(p.alias("id"), F.round(s, 6).alias("score"), (F.round(s, 6) >= V.LEARNING_THRESHOLD).alias("eligible"))


@query("""SELECT c_nationkey AS k, CASE max(CASE c_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END) WHEN 4 THEN 'member' WHEN 3 THEN 'compatible' WHEN 2 THEN 'candidate' ELSE 'challenged' END AS status, max(c_acctbal) AS affinity, max(c_custkey % 10) AS confidence FROM customer GROUP BY ALL""")
def reality_membership(spark, sf):
    """Best status and largest affinity per group."""
    s = F.element_at(F.array(*map(F.lit, ("member", "compatible", "candidate", "challenged"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return P.memberships(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), s.alias("status"), F.col("c_acctbal").alias("affinity"), (F.col("c_custkey") % 10).alias("confidence")), ["k"])


@query("""WITH o AS (SELECT o_custkey AS s, o_orderkey % 300 AS e FROM orders WHERE o_orderstatus = 'P'), k AS (SELECT s, count(DISTINCT e) AS n, min(e) AS e FROM o GROUP BY s), p AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer),
j AS (SELECT a, b, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb, x.e AS ea, y.e AS eb FROM p LEFT JOIN k x ON x.s = a LEFT JOIN k y ON y.s = b),
d AS (SELECT *, CASE WHEN na > 1 OR nb > 1 THEN 'ambiguous' WHEN na = 1 AND nb = 1 AND ea <> eb THEN 'merge_candidate' WHEN na = 1 AND nb = 1 THEN 'same' WHEN na = 1 OR nb = 1 THEN 'attach' ELSE 'create' END AS decision FROM j)
SELECT a, b, decision, CASE WHEN decision IN ('attach', 'same') THEN coalesce(ea, eb)::VARCHAR WHEN decision = 'create' THEN 'pair:' || a || ':' || b ELSE '' END AS event FROM d""")
def same_event_resolution(spark, sf):
    """What to do with pairs of statements by the events that they occur in."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("statement"), (F.col("o_orderkey") % 300).alias("event"))
    return P.same_event(table(spark, sf, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b")), o)


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS i, nullif(c_custkey // 3, 0) AS p FROM customer), a AS (SELECT i, p AS s, 1 AS d FROM l WHERE p IS NOT NULL UNION ALL SELECT a.i, l.p, d + 1 FROM a JOIN l ON l.i = a.s WHERE l.p IS NOT NULL AND d < 64),
w AS (SELECT i, i + 400 AS n FROM l WHERE i % 5 = 0), b AS (SELECT i, n AS s, 1 AS d FROM w UNION ALL SELECT b.i, w.n, d + 1 FROM b JOIN w ON w.i = b.s WHERE d < 8),
u AS (SELECT i, i AS s, 0 AS r FROM l UNION ALL SELECT i, s, d FROM a UNION ALL SELECT i, s, d + 100000 FROM b UNION ALL SELECT i, i + 1, 200000 FROM l WHERE i % 100 = 0 UNION ALL SELECT i + 1, i, 200000 FROM l WHERE i % 100 = 0)
SELECT i AS instance, s AS source, min(r) AS rank FROM u GROUP BY ALL""")
def memory_scopes(spark, sf):
    """Ancestors, continued worlds and peers of each instance."""
    i = F.col("c_custkey")
    c = table(spark, sf, "customer")
    lineage = c.select(i.alias("instance"), F.expr("nullif(c_custkey div 3, 0)").alias("parent"))
    worlds = c.filter(i % 5 == 0).select(i.alias("instance"), (i + 400).alias("next"))
    return P.memory_scope(lineage, worlds, c.filter(i % 100 == 0).select(i.alias("a"), (i + 1).alias("b")))


@query("""WITH r AS (SELECT o_custkey AS owner, o_orderpriority AS kind, o_orderkey AS id, round(o_totalprice / 1000, 3) AS score FROM orders), b AS (SELECT owner, kind, arg_min(id, struct_pack(s := -score, i := id)) AS id, max(score) AS s, count(*) AS n FROM r GROUP BY ALL)
SELECT owner, kind, id, round(s + least(0.35, 0.12 * ln(n)), 6) AS score, n FROM b""")
def event_collapse(spark, sf):
    """The best of each group, with a bounded bonus for the others."""
    o = table(spark, sf, "orders")
    return P.collapse(o.select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 1000, 3).alias("score")), ["owner", "kind"])


_NOTICE = f"'{V.OMISSION}'"
_MARK = "chr(10) || '[… middle omitted …]' || chr(10)"


def _excerpt_sql(text: str, size: str) -> str:
    """The excerpt of a text longer than a size, which is at least 64."""
    h, t = f"(({size} - 22) // 2)", f"({size} - 22 - ({size} - 22) // 2)"
    first, last = f"substr({text}, 1, {h})", f"right({text}, {t})"
    whole, lead = f"regexp_extract({first}, '(?s)^(.*[.!?]) ', 1)", f"regexp_extract({last}, '(?s)^(.*?[.!?] )', 1)"
    head = f"CASE WHEN length({whole}) > 0 AND length({whole}) - 1 >= {h} // 2 THEN {whole} ELSE {first} END"
    tail = f"CASE WHEN length({lead}) > 0 AND length({lead}) <= {t} // 2 THEN substr({last}, length({lead}) + 1) ELSE {last} END"
    return f"(rtrim({head}, ' ' || chr(9) || chr(10) || chr(13)) || {_MARK} || ltrim({tail}, ' ' || chr(9) || chr(10) || chr(13)))"


@query(f"""WITH f AS (SELECT conv_id AS owner, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS a, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS u, coalesce(list(text ORDER BY turn) FILTER (role = 'user'), []) AS ul,
 coalesce(list(text ORDER BY turn) FILTER (role = 'assistant'), []) AS sl FROM conversations GROUP BY conv_id),
s AS (SELECT *, array_to_string(sl, chr(10)) AS s, 800 - {len(V.OMISSION)} - 2 AS room FROM f),
x AS (SELECT *, CASE WHEN length(a) <= least(room, 300) THEN a ELSE '' END AS va FROM s), x2 AS (SELECT *, CASE WHEN va <> '' THEN room - length(va) - 1 ELSE room END AS r1 FROM x),
y AS (SELECT *, CASE WHEN length(u) <= least(r1, 350) THEN u ELSE array_to_string(list_filter(ul, lambda e, i: length(array_to_string(ul[1:i], chr(10))) <= least(r1, 350)), chr(10)) END AS vu FROM x2), y2 AS (SELECT *, CASE WHEN vu <> '' THEN r1 - length(vu) - 1 ELSE r1 END AS r2 FROM y),
z AS (SELECT *, CASE WHEN s = '' OR length(s) <= r2 THEN s WHEN len(sl) > 1 THEN CASE WHEN r2 - length(sl[1]) - 1 >= 64 THEN sl[1] || chr(10) || CASE WHEN length(array_to_string(sl[2:], chr(10))) <= r2 - length(sl[1]) - 1 THEN array_to_string(sl[2:], chr(10)) ELSE {_excerpt_sql("array_to_string(sl[2:], chr(10))", "(r2 - length(sl[1]) - 1)")} END ELSE '' END
 WHEN r2 >= 64 THEN {_excerpt_sql("s", "r2")} ELSE '' END AS vs FROM y2),
t AS (SELECT owner, array_to_string(list_filter([vs, vu, va], lambda v: v <> ''), chr(10)) AS text, va <> a OR vu <> u OR vs <> s AS omitted FROM z WHERE a <> '' OR u <> '' OR s <> '')
SELECT owner, sha256(substr(text || CASE WHEN omitted THEN CASE WHEN text <> '' THEN chr(10) ELSE '' END || {_NOTICE} ELSE '' END, 1, 800)) AS digest, omitted FROM t""")
def section_budget(spark, sf):
    """A conversation within 200 tokens: system texts whole or not at all first, then whole user turns, then an excerpt of what the assistant said; shown in
    the opposite order."""
    c = table(spark, sf, "conversations").filter(F.col("role").isin("system", "user", "assistant"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    pick = lambda a, b, o: F.when(F.col("role") == "system", a).when(F.col("role") == "user", b).otherwise(o)
    s = c.groupBy(F.col("conv_id").alias("owner"), "role").agg(entries.alias("entries"))
    s = s.select("owner", pick(3, 2, 1).alias("ord"), pick(0, 1, 2).alias("priority"), pick(300, 350, None).alias("cap"), pick("atomic", "whole", "excerpts").alias("kind"), "entries")
    return P.render(s, 200).select("owner", F.sha2("text", 256).alias("digest"), "omitted")


@query(f"""WITH o AS (SELECT o_custkey AS k, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS orders, count(*) AS n FROM orders GROUP BY ALL),
c AS (SELECT c_custkey AS k, c_name || ' says so. ' || c_mktsegment || ' and more of it! ' || c_name || ' ' || floor(c_acctbal)::BIGINT AS t FROM customer)
SELECT c.k, coalesce(orders, '') AS orders, coalesce(n, 0) AS n, CASE WHEN length(t) <= 66 THEN t ELSE {_excerpt_sql("t", "66")} END AS name FROM c LEFT JOIN o ON o.k = c.k""")
def hud_frames(spark, sf):
    """A nested document per customer, rendered."""
    said = F.concat(F.col("c_name"), F.lit(" says so. "), F.col("c_mktsegment"), F.lit(" and more of it! "), F.col("c_name"), F.lit(" "), F.floor("c_acctbal").cast("string"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), P.excerpt(said, F.lit(66)).alias("name"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    f = c.join(P.frame("k", orders=(o, ["o_orderkey", "o_orderstatus"])), "k", "left")
    text = F.array_join(F.transform("orders", lambda x: F.concat_ws(":", x["o_orderkey"], x["o_orderstatus"])), ",")
    return f.select("k", F.coalesce(text, F.lit("")).alias("orders"), F.coalesce(F.size("orders"), F.lit(0)).cast("long").alias("n"), "name")


@query("""WITH t AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 'place' || (conv_id + turn) % 7 END AS place FROM conversations) SELECT conv_id, turn, last_value(place IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role AS changes FROM t""")
def place_resolution(spark, sf):
    """The last place that is visible at each turn, and changes of speaker."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    named = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("place"), ((F.col("conv_id") + F.col("turn")) % 7).cast("string")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.last(named, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("place"), (~F.lag("role").over(w).eqNullSafe(F.col("role"))).alias("changes"))


@query("""SELECT user_id AS owner, max(event_id) AS cursor, count(*) AS events, max(epoch(date_trunc('second', ts)))::BIGINT AS seen FROM events GROUP BY ALL""")
def source_cursors(spark, sf):
    """How far each source has been read."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("owner")).agg(F.max("event_id").alias("cursor"), F.count("*").alias("events"), F.max(F.unix_timestamp("ts")).alias("seen"))


_ASKED = {
    0: "Nice day. What do you like about {p} roads? Tell me.", 1: "Have you ever visited the {p} tower?", 2: "What do you remember of {p}?", 3: "Who is {p}?", 4: "What was your history with {p} before?", 5: "You look {p} today.", 6: "\n", 7: "So, explain {p}!",
}
_ROUTES = {
    0: ("character", "character_self_knowledge", "preference", "about,{l},roads", "unspecified"), 1: ("character", "character_self_knowledge", "experience", "{l},tower", "prior"), 2: ("character", "character_self_knowledge", "history", "{l}", "unspecified"),
    3: ("general", "external_knowledge_question", "general", "", "unspecified"), 4: ("character", "character_self_knowledge", "history", "history,{l},before", "prior"), 5: ("general", "no_high_confidence_self_signal", "general", "", "unspecified"),
    6: ("general", "empty_focus", "general", "", "unspecified"), 7: ("general", "external_knowledge_question", "general", "", "unspecified"),
}


def _asked():
    k, word = F.col("o_orderkey") % 8, F.regexp_replace("o_orderpriority", "[^A-Z]", "")
    return F.coalesce(*[F.when(k == j, F.replace(F.lit(t), F.lit("{p}"), word)) for j, t in _ASKED.items()])


def _case(n: int) -> str:
    return "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN replace('{x[n]}', '{{l}}', w)" for k, x in _ROUTES.items()) + " END"


@query(f"""SELECT o_orderkey AS id, {_case(0)} AS route, {_case(1)} AS reason, {_case(2)} AS kind, {_case(3)} AS topics, {_case(4)} AS temporal FROM (SELECT o_orderkey, lower(regexp_replace(o_orderpriority, '[^A-Z]', '', 'g')) AS w FROM orders)""")
def demand_routing(spark, sf):
    """What messages ask for: orders are put into eight of them, whose answers are known by hand."""
    d = C.demand(_asked(), F.lit("Ann"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), d.alias("d")).select("id", "d.route", "d.reason", "d.kind", F.array_join("d.topics", ",").alias("topics"), "d.temporal")


@query("""WITH n AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS need FROM benchmark), h AS (SELECT list(DISTINCT p_type) AS x FROM part), w AS (SELECT item_id, need, list_filter(need, lambda t: length(t) % 2 = 0) AS held FROM n)
SELECT item_id, round(CASE WHEN len(need) = 0 THEN 1 ELSE len(held) / len(need)::DOUBLE END, 6) AS share FROM w""")
def demand_coverage(spark, sf):
    """Share of a query's terms that are held."""
    need = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    return table(spark, sf, "benchmark").select("item_id", F.round(C.coverage(need, F.filter(need, lambda t: F.length(t) % 2 == 0)), 6).alias("share"))


@query("""WITH m AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations), r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS used FROM m) SELECT conv_id, turn, used::BIGINT AS used FROM r WHERE used <= 1500""")
def latest_turns(spark, sf):
    """Latest turns within a budget of characters."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("used")).filter("used <= 1500")


@query("""SELECT user_id AS owner, event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5""")
def recent_events(spark, sf):
    """Five latest events of each user."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf, "events").select(F.col("user_id").alias("owner"), "event_id", k.cast("long").alias("k")).filter("k <= 5")


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\n+|[.!?]\\s+'), lambda x: trim(x) <> '')) AS n FROM documents""")
def sentence_counts(spark, sf):
    """Sentences of each document."""
    return table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))

