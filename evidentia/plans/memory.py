"""Memory queries. Orders and events are dressed as what instances learn, do and note; the supplied tables have no such columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as M
from ..operators import vector as X
from .registry import query, table


def _pick(c, *v):
    return F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))


_SAYERS = """WITH c AS (SELECT o_orderkey AS id, ['I', ' me ', 'You', 'Ann', '', NULL, 'myself'][o_orderkey % 7 + 1] AS s, CASE WHEN o_orderkey % 5 > 0 THEN 'c' || o_custkey % 3 END AS c, CASE WHEN o_orderkey % 11 > 0 THEN 'voice' END AS sp, CASE WHEN o_orderkey % 2 = 0 THEN 'character' ELSE 'user' END AS role,
 CASE WHEN o_orderkey % 3 = 0 THEN 'bob' ELSE '  ' END AS r, CASE WHEN o_orderkey % 13 = 0 THEN 'c1' END AS v, o_orderkey % 17 = 0 AS cold FROM orders),
n AS (SELECT id, nullif(trim(s), '') AS s, c, r, role, cold, nullif(trim(r), '') AS rr, CASE WHEN cold THEN NULL ELSE coalesce(v, CASE WHEN role = 'character' AND c IS NOT NULL THEN c ELSE sp END) END AS seen FROM c),
o AS (SELECT *, CASE WHEN role = 'character' AND seen = c THEN c END AS owner, coalesce(lower(s) IN ('i', 'me', 'myself') AND seen IS NOT NULL, FALSE) AS one, coalesce(lower(s) IN ('you', 'yourself') AND rr IS NOT NULL AND NOT cold, FALSE) AS two FROM n)
"""


@query(_SAYERS + """SELECT id, CASE WHEN one THEN seen WHEN two THEN rr ELSE s END AS subject, CASE WHEN one THEN 'first_person' WHEN two THEN 'second_person' END AS kind, CASE WHEN owner IS NOT NULL THEN 'character' WHEN seen IS NOT NULL THEN 'speaker' WHEN two THEN 'recipient' ELSE 'source' END AS scope, seen AS viewpoint, owner, one OR two AS resolved FROM o""")
def subject_pivots(spark, sf):
    """Whom the subjects of statements mean, by who says them to whom."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = M.pivot(
        _pick(k % 7, "I", " me ", "You", "Ann", "", None, "myself"), F.when(k % 5 > 0, F.concat(F.lit("c"), (c % 3).cast("string"))), F.when(k % 11 > 0, "voice"), F.when(k % 2 == 0, "character").otherwise("user"),
        F.when(k % 3 == 0, "bob").otherwise("  "), F.when(k % 13 == 0, "c1"), F.when(k % 17 == 0, "corpus-reference-v1").otherwise("character-id-v1"),
    )
    return table(spark, sf, "orders").select(k.alias("id"), p.alias("p")).select("id", "p.*")


_OWNED = """WITH c AS (SELECT o_orderkey AS id, ['Character', 'narrative', 'source', 'world', 'observation', NULL][o_orderkey % 6 + 1] AS scope, CASE WHEN o_orderkey % 4 > 0 THEN 'c' || o_custkey % 3 END AS c, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 7 END AS w, CASE WHEN o_orderkey % 7 > 0 THEN 's' || o_custkey % 5 END AS s,
 ['EVENT', 'belief', 'STATE', NULL][o_orderkey % 4 + 1] AS k, ['ACTION', 'temporal', 'SOCIAL', 'MEMORY', NULL][o_orderkey % 5 + 1] AS f, CASE WHEN o_orderkey % 8 > 0 THEN o_custkey % 2 END AS i, o_orderkey % 9 = 0 AS pv FROM orders)
"""


def _owned(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        k.alias("id"), _pick(k % 6, "Character", "narrative", "source", "world", "observation", None).alias("scope"), F.when(k % 4 > 0, F.concat(F.lit("c"), (c % 3).cast("string"))).alias("c"), F.when(k % 5 > 0, c % 7).alias("w"),
        F.when(k % 7 > 0, F.concat(F.lit("s"), (c % 5).cast("string"))).alias("s"), _pick(k % 4, "EVENT", "belief", "STATE", None).alias("k"), _pick(k % 5, "ACTION", "temporal", "SOCIAL", "MEMORY", None).alias("f"), F.when(k % 8 > 0, c % 2).alias("i"), (k % 9 == 0).alias("pv"),
    )


@query(_OWNED + """SELECT id, CASE WHEN lower(scope) = 'character' AND c IS NOT NULL THEN 'char:' || c WHEN scope IN ('narrative', 'world', 'observation') AND w IS NOT NULL THEN 'world:' || w || ':observed' WHEN scope = 'source' AND s IS NOT NULL THEN 'source:' || s ELSE 'unresolved:' || id END AS key,
 CASE WHEN lower(scope) = 'character' AND c IS NOT NULL THEN 'explicit_character_scope' WHEN scope = 'narrative' AND w IS NOT NULL THEN 'explicit_narrative_world_scope' WHEN scope = 'source' AND s IS NOT NULL THEN 'explicit_source_scope' WHEN scope IN ('world', 'observation') AND w IS NOT NULL THEN 'explicit_world_scope' ELSE 'insufficient_semantic_evidence' END AS reason FROM c""")
def semantic_owners(spark, sf):
    """Owners of statements that explicit facts justify."""
    o = M.ownership(*map(F.col, ("scope", "c", "w", "s", "id")))
    return _owned(spark, sf).select("id", o.alias("o")).select("id", "o.key", "o.reason")


@query(_OWNED + """SELECT id, CASE WHEN lower(scope) = 'character' AND c IS NOT NULL AND i IS NOT NULL THEN 'char:' || c WHEN s IS NOT NULL THEN 'source:' || s WHEN w IS NOT NULL THEN 'world:' || w || ':observed' ELSE 'source:unresolved:' || id END AS key,
 CASE WHEN f = 'MEMORY' OR k = 'belief' THEN 'epistemic_transition' WHEN k = 'EVENT' OR f = 'ACTION' THEN 'event' WHEN f = 'temporal' THEN 'temporal_transition' WHEN pv THEN 'semantic_pivot' ELSE 'topic' END AS branch, CASE WHEN f = 'MEMORY' OR k = 'belief' THEN 0.95 WHEN k = 'EVENT' OR f = 'ACTION' THEN 0.90 WHEN f = 'temporal' THEN 0.85 WHEN pv THEN 0.75 ELSE 0.55 END::DOUBLE AS significance FROM c""")
def branch_scopes(spark, sf):
    """Scope and kind of branch of observations, with their significance."""
    b = M.branch(F.col("k"), F.col("f"), F.lower("scope"), F.col("c"), F.col("i"), F.col("s"), F.col("w"), F.col("id"), F.col("pv"))
    return _owned(spark, sf).select("id", b.alias("b")).select("id", "b.key", "b.branch", "b.significance")


@query("""WITH a AS (SELECT user_id AS i, event_type AS p, event_id AS ord, CASE WHEN event_id % 4 > 0 THEN event_id * 10 END AS node, CASE WHEN event_id % 3 > 0 THEN round(value, 2) END AS conf, CASE WHEN event_id % 5 = 0 THEN 's' || event_id % 7 END AS src FROM events WHERE event_id % 6 <> 0)
SELECT i AS instance, p AS proposition, min(ord) * 10 * CASE WHEN min(ord) % 4 > 0 THEN 1 END AS first_node, max(node) AS last_node, max(ord) AS updated, arg_max(conf, ord) FILTER (conf IS NOT NULL) AS confidence, arg_max(src, ord) FILTER (src IS NOT NULL) AS source, count(*) AS n FROM a GROUP BY ALL""")
def acquisitions(spark, sf):
    """What users have learnt of each type of event; every sixth acquisition is retracted."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    made = e.select(
        F.col("user_id").alias("instance"), F.col("event_type").alias("proposition"), k.alias("ord"), F.when(k % 4 > 0, k * 10).alias("node"), k.alias("at"), F.lit("held").alias("status"), F.when(k % 3 > 0, F.round("value", 2)).alias("confidence"), F.lit("read").alias("mode"),
        F.when(k % 5 == 0, F.concat(F.lit("s"), (k % 7).cast("string"))).alias("source"),
    )
    found = M.acquire(made, made.filter(F.col("ord") % 6 == 0).select("instance", "proposition", "ord"))
    return found.select("instance", "proposition", "first_node", "last_node", F.col("updated_at").alias("updated"), "confidence", "source", "n")


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey % 4 AS world, ['go', 'take', 'say'][o_orderkey % 3 + 1] AS action, ['person', NULL][o_orderkey % 2 + 1] AS actor, ['door', 'person', NULL][o_orderkey % 5 % 3 + 1] AS target, o_orderkey % 5 % 3 < 2 AS has FROM orders),
r(world, ord, rule, reason, w) AS (VALUES (0, 1, 'few', 'not_allowed', 0), (0, 2, 'aim', 'target_required', 0), (1, 1, 'doors', 'target_type_rejected', 0), (1, 2, 'quiet', 'denied', 0), (2, 1, 'all', 'denied', 0), (2, 2, 'open', 'not_allowed', 0)),
b AS (SELECT id, r.* FROM a JOIN r ON r.world = a.world WHERE CASE rule WHEN 'few' THEN action NOT IN ('go', 'take') WHEN 'aim' THEN action = 'take' AND NOT has WHEN 'doors' THEN action = 'take' AND target IS DISTINCT FROM 'door' WHEN 'quiet' THEN action = 'say' AND actor = 'person' AND target = 'person' WHEN 'all' THEN actor = 'person' ELSE FALSE END),
m AS (SELECT id, arg_min(rule, ord) AS rule, arg_min(reason, ord) AS reason FROM b GROUP BY id) SELECT a.id, m.rule IS NULL AS allowed, m.rule, m.reason FROM a LEFT JOIN m USING (id)""")
def action_rules(spark, sf):
    """Which actions the rules of a world refuse, and by which rule first."""
    k = F.col("o_orderkey")
    target = _pick(k % 5 % 3, "door", "person", None)
    actions = table(spark, sf, "orders").select(k.alias("id"), (F.col("o_custkey") % 4).cast("int").alias("world"), _pick(k % 3, "go", "take", "say").alias("action"), _pick(k % 2, "person", None).alias("actor_type"), target.alias("target_type"), target.isNotNull().alias("has_target"))
    rules = spark.createDataFrame(
        [
            (0, 1, "few", "action_allowlist", None, ["go", "take"], None, None, None), (0, 2, "aim", "require_target", "take", None, None, None, None), (1, 1, "doors", "require_target_type", "take", None, ["door"], None, None),
            (1, 2, "quiet", "deny_action", "say", None, None, "person", "person"), (2, 1, "all", "deny_action", "*", None, None, "person", ""), (2, 2, "open", "action_allowlist", None, [], None, None, None),
        ],
        "world int, ord int, key string, kind string, action string, actions array<string>, target_types array<string>, actor_type string, target_type string",
    )
    return M.judge_actions(actions, rules)


@query("""WITH h AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 = 2), b AS (SELECT h.conv_id, h.turn, c.turn AS k, trim(c.text) AS t FROM h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn < h.turn AND trim(c.text) <> '' AND c.turn % 7 <> 1 QUALIFY row_number() OVER (PARTITION BY h.conv_id, h.turn ORDER BY c.turn DESC) <= 4),
x AS (SELECT conv_id, turn, string_agg(t, ' ' ORDER BY k) AS t, string_agg(k, ',' ORDER BY k) AS nodes FROM b GROUP BY ALL) SELECT h.conv_id, h.turn, sha256(coalesce(right(x.t, 200), '')) AS digest, coalesce(nodes, '') AS nodes FROM h LEFT JOIN x ON x.conv_id = h.conv_id AND x.turn = h.turn""")
def dag_halo(spark, sf):
    """The four turns before each third one, within 200 characters; some turns are empty."""
    c = table(spark, sf, "conversations")
    id_ = F.struct("conv_id", "turn")
    heads = c.filter("turn % 3 = 2").select(id_.alias("id"), F.col("conv_id").alias("timeline"), F.col("turn").alias("event"))
    nodes = c.select(F.col("conv_id").alias("timeline"), F.col("turn").alias("event"), F.col("turn").alias("node"), F.when(F.col("turn") % 7 == 1, "  ").otherwise(F.col("text")).alias("text"))
    return M.halo(heads, nodes, 4, 200).select("id.conv_id", "id.turn", F.sha2("text", 256).alias("digest"), F.array_join("nodes", ",").alias("nodes"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT * FROM v WHERE vec_id % 4 = 0), s AS (SELECT * FROM v WHERE vec_id % 4 = 1),
n AS (SELECT s.vec_id AS section, t.vec_id AS topic, t.label AS domain, round(list_dot_product(s.e, t.e) + 0.5, 6) AS similarity FROM s JOIN t ON t.vec_id % 12 > 0 WHERE round(list_dot_product(s.e, t.e) + 0.5, 6) >= 0.62 QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY round(list_dot_product(s.e, t.e) + 0.5, 6) DESC, t.vec_id) <= 12)
SELECT section, topic, similarity, row_number() OVER (PARTITION BY section ORDER BY similarity DESC, topic) AS place FROM n WHERE domain % 5 IN (section % 5, (section + 2) % 5) QUALIFY place <= 4""")
def topic_links(spark, sf):
    """Topics that are near to sections and of a domain of their documents; a quarter of the vectors are topics, another sections, raised by a half."""
    e, v = table(spark, sf, "embeddings"), F.col("vec_id")
    topics = e.filter(v % 4 == 0).select(v.alias("topic"), (F.col("label") % 5).alias("domain"), (v % 12 > 0).alias("active"))
    sections = e.filter(v % 4 == 1)
    near = X.top_k(sections, e.join(topics.filter("active"), v == F.col("topic"), "left_semi"), 12, 0.12 - 1e-6)
    hits = near.select(F.col("q").alias("section"), F.col("q").alias("document"), F.col("id").alias("topic"), F.round(F.col("similarity") + 0.5, 6).alias("similarity"))
    domains = sections.select(v.alias("document"), F.explode(F.array((v % 5).cast("int"), ((v + 2) % 5).cast("int"))).alias("domain"))
    return M.link_topics(hits, topics, domains).withColumn("place", F.col("place").cast("long"))


@query("""WITH l AS (SELECT o_custkey AS q, o_orderkey AS entry, (o_orderkey % 10) / 10.0::DOUBLE AS score, o_orderkey % 50 AS said_at, repeat(o_orderpriority, 1 + o_orderkey % 9) AS content FROM orders WHERE o_orderkey % 3 = 0),
s AS (SELECT o_custkey AS q, o_orderkey AS entry, (o_orderkey % 17) / 17.0::DOUBLE AS sim, repeat(o_orderpriority, 1 + o_orderkey % 9) AS content FROM orders WHERE o_orderkey % 2 = 0),
f AS (SELECT q, entry, content, 0 AS list, row_number() OVER (PARTITION BY q ORDER BY score DESC, said_at DESC, entry) AS k FROM l QUALIFY k <= 4), n AS (SELECT q, entry, content, 1 AS list, row_number() OVER (PARTITION BY q ORDER BY sim DESC, entry) AS k FROM s QUALIFY k <= 4),
u AS (SELECT * FROM f UNION ALL SELECT * FROM n WHERE (q, entry) NOT IN (SELECT q, entry FROM f)), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY list, k) AS place FROM u QUALIFY place <= 4),
b AS (SELECT *, 120 - coalesce(sum(length(content)) OVER (PARTITION BY q ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p)
SELECT q, entry, place, substr(content, 1, room::BIGINT) AS excerpt, length(content) > room AS truncated FROM b WHERE room > 0""")
def notebook_recall(spark, sf):
    """Entries of a customer's notebook by words, filled up by vectors, within 120 characters."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    content = F.expr("repeat(o_orderpriority, cast(1 + o_orderkey % 9 as int))").alias("content")
    words = o.filter(k % 3 == 0).select(F.col("o_custkey").alias("q"), k.alias("entry"), (k % 10 / 10.0).alias("score"), (k % 50).alias("at"), content)
    near = o.filter(k % 2 == 0).select(F.col("o_custkey").alias("q"), k.alias("entry"), (k % 17 / 17.0).alias("similarity"), content)
    return M.notebook(words, near, 4, 120).withColumn("place", F.col("place").cast("long"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey // 3 > 0), a AS (SELECT c_custkey AS q, c_custkey AS node FROM customer WHERE c_custkey % 10 = 0 UNION SELECT a.q, e.parent FROM a JOIN e ON e.child = a.node),
n AS (SELECT q, o_orderkey AS run, o_orderkey % 2 AS slot, 'f' || o_orderkey % 5 AS fp, o_custkey AS node, (o_orderkey % 7) / 7.0::DOUBLE AS rank, o_orderkey % 11 = 0 AS goal, o_orderkey % 100 AS updated, CASE WHEN o_orderkey % 13 = 0 THEN 'denied' ELSE 'done' END AS status, o_orderkey % 9 = 0 AS gone FROM orders, (SELECT DISTINCT q FROM a) q WHERE (q + o_orderkey) % 10 = 0),
m AS (SELECT n.* FROM n JOIN a ON a.q = n.q AND a.node = n.node WHERE status <> 'denied' AND NOT gone AND (rank > 0 OR goal)), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY q, fp ORDER BY goal DESC, rank DESC, updated DESC, run, slot) = 1)
SELECT q, run, slot, row_number() OVER (PARTITION BY q ORDER BY goal DESC, rank DESC, updated DESC, run, slot) AS place FROM b QUALIFY place <= 2""")
def worker_memory(spark, sf):
    """Notes that workers left on a customer's ancestry, two for each of every tenth customer."""
    from ..operators.graph import held

    c, o, k = table(spark, sf, "customer"), table(spark, sf, "orders"), F.col("o_orderkey")
    edges = c.select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 3").alias("parent")).filter("parent > 0")
    seen = held(M.ancestors(c.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("q"), F.col("c_custkey").alias("node")), edges))
    notes = o.select(k.alias("run"), (k % 2).alias("slot"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("fingerprint"), F.col("o_custkey").alias("node"), (k % 7 / 7.0).alias("rank"), (k % 11 == 0).alias("same_goal"), (k % 100).alias("updated"), F.when(k % 13 == 0, "denied").otherwise("done").alias("status"), (k % 9 == 0).alias("superseded"))
    asked = notes.join(seen, "node").filter((F.col("q") + F.col("run")) % 10 == 0)
    return M.worker_notes(asked, seen).withColumn("place", F.col("place").cast("long"))


_JOBS = """WITH j AS (SELECT ['goal_plan_continuation', 'goal_planning_inference', 'index', 'embed'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_custkey % 3 = 0 THEN 'LIVE' ELSE 'BATCH' END AS lane, ['queued', 'running', 'done', 'failed', 'queued'][o_orderkey % 5 + 1] AS status, o_custkey AS inst, o_orderkey % 7 > 0 AS eligible,
 epoch(TIMESTAMP '2000-01-01') + (o_orderkey % 200 - 150) AS run_after, epoch(TIMESTAMP '2000-01-01') - o_orderkey % 90 AS created, epoch(TIMESTAMP '2000-01-01') - o_orderkey % 120 AS updated FROM orders)
"""


def _jobs(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    now = F.lit("2000-01-01 00:00:00").cast("timestamp")
    at = lambda d: F.timestamp_seconds(F.unix_timestamp(now) + d)
    jobs = table(spark, sf, "orders").select(
        _pick(k % 4, "goal_plan_continuation", "goal_planning_inference", "index", "embed").alias("kind"), F.when(c % 3 == 0, "LIVE").otherwise("BATCH").alias("lane"), _pick(k % 5, "queued", "running", "done", "failed", "queued").alias("status"), c.alias("instance"),
        (k % 7 > 0).alias("eligible"), at(k % 200 - 150).alias("run_after"), at(-(k % 90)).alias("created"), at(-(k % 120)).alias("updated"),
    )
    return jobs, now


@query(_JOBS + """, b AS (SELECT DISTINCT inst FROM j WHERE status = 'running' AND kind = 'goal_plan_continuation'),
s AS (SELECT j.*, CASE WHEN status = 'running' THEN 'running' WHEN kind LIKE 'goal%' AND NOT eligible THEN 'parked' WHEN run_after > epoch(TIMESTAMP '2000-01-01') THEN 'delayed' WHEN kind = 'goal_plan_continuation' AND b.inst IS NOT NULL THEN 'waiting' ELSE 'runnable' END AS state FROM j LEFT JOIN b ON b.inst = j.inst WHERE status IN ('queued', 'running'))
SELECT kind, lane, count(*) FILTER (state = 'runnable') AS queued, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'parked') AS parked, count(*) FILTER (state = 'delayed') AS delayed, count(*) FILTER (state = 'waiting') AS waiting,
 coalesce(epoch(TIMESTAMP '2000-01-01') - min(created) FILTER (state = 'runnable'), 0)::BIGINT AS oldest FROM s GROUP BY ALL""")
def queue_depths(spark, sf):
    """Jobs by kind and lane: depths by state, and the age of the oldest that could run."""
    return M.queue_depths(*_jobs(spark, sf))


@query(_JOBS + """SELECT count(*) FILTER (created >= n - 30) AS arrivals_30s, count(*) FILTER (status = 'done' AND updated >= n - 30) AS done_30s, count(*) FILTER (lane = 'LIVE' AND created >= n - 30) AS live_arrivals_30s, count(*) FILTER (lane = 'LIVE' AND status = 'done' AND updated >= n - 30) AS live_done_30s,
 count(*) FILTER (status = 'failed' AND updated >= n - 60) AS failed_60s FROM j, (SELECT epoch(TIMESTAMP '2000-01-01') AS n)""")
def rolling_rates(spark, sf):
    """Arrivals and ends within the last half minute, failures within the last."""
    return M.rolling_rates(*_jobs(spark, sf))


@query("""WITH m AS (SELECT user_id AS key, max(epoch(ts)::BIGINT) AS mark FROM events GROUP BY user_id), r AS (SELECT user_id AS key, max(epoch(ts)::BIGINT) AS mark, arg_max(epoch(ts)::BIGINT, event_id) AS done FROM events WHERE event_id % 3 = 0 AND user_id % 4 > 0 GROUP BY user_id)
SELECT key, r.mark IS NULL OR (m.mark > x.mark AND epoch(TIMESTAMP '2024-01-20')::BIGINT - x.finished >= 30) AS due FROM m LEFT JOIN r USING (key) LEFT JOIN (SELECT user_id AS key, arg_max(epoch(ts)::BIGINT, epoch(ts)::BIGINT + event_id % 100) AS mark, max(epoch(ts)::BIGINT + event_id % 100) AS finished FROM events WHERE event_id % 3 = 0 AND user_id % 4 > 0 GROUP BY user_id) x USING (key)""")
def change_marks(spark, sf):
    """Users whose events are newer than what a run over every third of them saw, if it ended half a minute ago or more."""
    e = table(spark, sf, "events")
    at = F.unix_timestamp("ts")
    runs = e.filter("event_id % 3 = 0 and user_id % 4 > 0").select(F.col("user_id").alias("key"), at.alias("mark"), F.timestamp_seconds(at + F.col("event_id") % 100).alias("finished"))
    return M.changed(e.select(F.col("user_id").alias("key"), at.alias("mark")), runs, F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query("""WITH m AS (SELECT o_custkey AS event, o_orderkey AS id, ['Ann', 'it', 'Bob  Lee', ''][o_orderkey % 4 + 1] AS s, ['take', 'be', 'have', 'Identity', 'see'][o_orderkey % 5 + 1] AS p, ['the key', '_', 'x', 'home'][o_orderkey % 4 * 3 % 4 + 1] AS o, o_orderpriority AS t, o_orderkey % 6 / 10.0::DOUBLE AS total FROM orders),
c AS (SELECT *, regexp_replace(s, '\\s+', ' ', 'g') AS cs, lower(s) NOT IN ('', 'it') AS si, o NOT IN ('_', 'x') AS oi, lower(p) IN ('be', 'have', 'identity') AS still FROM m),
q AS (SELECT *, CASE WHEN NOT si THEN '' WHEN p = 'be' AND oi THEN cs || ' was ' || o || '.' WHEN oi THEN cs || ' ' || p || ' ' || o || '.' ELSE cs || ' ' || p || '.' END AS said, CASE WHEN NOT si THEN '' WHEN lower(p) IN ('be', 'identity') AND oi THEN cs || ' was ' || o || '.' WHEN oi THEN cs || ' ' || lower(p) || ' ' || o || '.' ELSE cs || ' ' || lower(p) || '.' END AS state,
 row_number() OVER (PARTITION BY event ORDER BY total DESC, si::INT + oi::INT DESC, length(t) DESC, id DESC) AS k FROM c),
a AS (SELECT event, coalesce(min(k) FILTER (NOT still AND si), 1) AS top, count(*) AS n FROM q GROUP BY event), x AS (SELECT q.event, q.id, q.said, q.t, a.n FROM a JOIN q ON q.event = a.event AND q.k = a.top),
s0 AS (SELECT q.event, q.state, min(q.k) AS k FROM q JOIN x ON x.event = q.event AND q.id <> x.id WHERE q.still AND q.state <> '' AND lower(q.state) <> lower(x.said) GROUP BY ALL), st AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY k) AS r FROM s0 QUALIFY r <= 2), g AS (SELECT event, string_agg(state, ' ' ORDER BY k) AS states FROM st GROUP BY event)
SELECT x.event, CASE WHEN said <> '' THEN said ELSE t END || coalesce(' ' || states, '') AS text, x.id AS primary, n FROM x LEFT JOIN g ON g.event = x.event""".replace("\\\\", "\\"))
def event_texts(spark, sf):
    """Customers' orders, dressed as members of events, as sentences: the richest action and up to two states."""
    k = F.col("o_orderkey")
    return M.event_texts(table(spark, sf, "orders").select(
        F.col("o_custkey").alias("event"), k.alias("id"), _pick(k % 4, "Ann", "it", "Bob  Lee", "").alias("subject"), _pick(k % 5, "take", "be", "have", "Identity", "see").alias("predicate"), _pick(k % 4 * 3 % 4, "the key", "_", "x", "home").alias("object"), F.col("o_orderpriority").alias("text"), (k % 6 / 10.0).alias("total"),
    ))


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS frame, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + l_linenumber // 2 END AS parent, l_orderkey AS s, l_partkey AS ord FROM lineitem), k AS (SELECT f.frame, f.s, f.ord, p.frame AS parent FROM f LEFT JOIN f p ON p.frame = f.parent AND p.s = f.s),
r AS (SELECT *, row_number() OVER (PARTITION BY s, parent ORDER BY ord, frame) AS place FROM k), d1 AS (SELECT frame, frame AS root, place, 0 AS depth FROM r WHERE parent IS NULL), d2 AS (SELECT r.frame, d1.root, r.place, 1 AS depth FROM r JOIN d1 ON d1.frame = r.parent), d3 AS (SELECT r.frame, d2.root, r.place, 2 AS depth FROM r JOIN d2 ON d2.frame = r.parent),
d4 AS (SELECT r.frame, d3.root, r.place, 3 AS depth FROM r JOIN d3 ON d3.frame = r.parent) SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4""")
def frame_places(spark, sf):
    """Roots and children of frames in their order; lines of an order make a tree."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    f = table(spark, sf, "lineitem").select((k * 10 + n).alias("frame"), F.when(n > 1, k * 10 + F.floor(n / 2)).alias("parent"), k.alias("sentence"), F.col("l_partkey").alias("ord"))
    return M.frame_places(f).withColumn("place", F.col("place").cast("long"))


_ANCHOR = """WITH d AS (SELECT doc_id, text, length(text) AS n, doc_id % 4 AS k, substr(text, 40 + doc_id % 60, 12) AS w FROM documents), a AS (SELECT *, CASE k WHEN 0 THEN trim(w, ' ') WHEN 1 THEN 'zz no such zz' WHEN 2 THEN '' ELSE trim(translate(w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ') END AS needle FROM d),
p AS (SELECT *, instr(lower(text), lower(needle)) - 1 AS first FROM a), q AS (SELECT *, instr(substr(lower(text), first + 1 + length(needle)), lower(needle)) > 0 AS again FROM p),
l AS (SELECT *, CASE WHEN needle <> '' AND first >= 0 AND NOT again THEN first END AS lo FROM q), b AS (SELECT *, lo + length(needle) AS hi, greatest(0, lo - floor((200 - length(needle)) * CASE WHEN doc_id % 3 = 0 THEN 0.78 ELSE 0.58 END)::INT) AS s0 FROM l),
e AS (SELECT *, CASE WHEN least(n, s0 + 200) < hi THEN greatest(0, hi - 200) ELSE s0 END AS s1 FROM b), g AS (SELECT *, least(n, s1 + 200) AS e1, instr(substr(text, s1 + 1, least(24, lo - s1)), ' ') AS gap FROM e),
h AS (SELECT *, CASE WHEN s1 > 0 AND s1 < lo AND gap > 0 THEN s1 + gap ELSE s1 END AS s2, instr(reverse(substr(text, greatest(hi, e1 - 24) + 1, e1 - greatest(hi, e1 - 24))), ' ') AS back FROM g)
"""


@query(_ANCHOR + """SELECT doc_id, CASE WHEN lo IS NOT NULL THEN s2 ELSE 0 END::INT AS start, CASE WHEN lo IS NOT NULL THEN CASE WHEN e1 < n AND e1 > hi AND back > 0 THEN e1 - back ELSE e1 END WHEN needle = '' THEN least(n, 200) ELSE 0 END::INT AS "end",
 CASE WHEN lo IS NOT NULL THEN 'unique_exact_text' WHEN needle = '' THEN 'unanchored_prefix' WHEN first >= 0 THEN 'ambiguous_anchor' ELSE 'anchor_not_found' END AS method FROM h""")
def inquiry_passages(spark, sf):
    """The part of a document around an anchor, for anchors that are there once, several times, not at all, or not given."""
    k = F.col("doc_id") % 4
    w = F.substring(F.col("text"), (40 + F.col("doc_id") % 60).cast("int"), F.lit(12))
    anchor = F.when(k == 0, F.trim(w)).when(k == 1, "zz no such zz").when(k == 2, "").otherwise(F.trim(F.translate(w, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    none = F.lit(None).cast("int")
    p = M.anchored_passage(F.col("text"), anchor, none, none, F.when(F.col("doc_id") % 3 == 0, "unresolved_reference").otherwise("other"), 200)
    return table(spark, sf, "documents").select("doc_id", p.alias("p")).select("doc_id", "p.start", "p.end", "p.method")


@query("""WITH h AS (SELECT user_id, event_type, arg_max(event_id, epoch(date_trunc('second', ts))::BIGINT * 1000000 + event_id % 1000000) AS e, max(epoch(date_trunc('second', ts))::BIGINT * 1000000 + event_id % 1000000) AS o FROM events WHERE event_id % 3 > 0 GROUP BY ALL)
SELECT b.event_id, CASE WHEN h.o IS NULL THEN 'new' WHEN epoch(date_trunc('second', b.ts))::BIGINT * 1000000 + b.event_id % 1000000 = h.o THEN 'replayed' WHEN epoch(date_trunc('second', b.ts))::BIGINT * 1000000 + b.event_id % 1000000 < h.o THEN 'late' ELSE 'superseded' END AS receipt FROM events b LEFT JOIN h USING (user_id, event_type) WHERE b.event_id % 2 = 0""")
def replay_receipts(spark, sf):
    """What every second event does to the latest event of its user and type among two thirds of all."""
    from ..streaming.ingest import current, replace_superseded

    o = F.unix_timestamp("ts") * 1000000 + F.col("event_id") % 1000000
    e = table(spark, sf, "events").select("user_id", "event_type", o.alias("o"), "event_id")
    held = current(e.filter("event_id % 3 > 0"), ["user_id", "event_type"], "o").select("user_id", "event_type", "o", "event_id")
    _, receipts = replace_superseded(e.filter("event_id % 2 = 0"), held, ["user_id", "event_type"], "o")
    return receipts.join(e.select("o", "user_id", "event_type", "event_id"), ["user_id", "event_type", "o"]).select("event_id", "receipt")


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' WHEN role = 'system' THEN 'system' ELSE 'assistant' END AS role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE conv_id % 5 > 0)
SELECT 'log' || conv_id AS file, 'ann' || conv_id AS character_name, k::INT AS k, role, sha256(text) AS digest FROM m""")
def chat_log_messages(spark, sf):
    """Conversations as chat logs, read back: a header line, then a line for each turn; every fifth log has no name and is left out."""
    from ..sources.records import chat_messages

    line = F.to_json(F.struct(F.lit("n").alias("name"), (F.col("role") == "user").alias("is_user"), (F.col("role") == "system").alias("is_system"), F.col("text").alias("mes")))
    logs = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("x"))
    n = F.col("conv_id").cast("string")
    head = F.to_json(F.struct(F.lit("u").alias("user_name"), F.when(F.col("conv_id") % 5 > 0, F.concat(F.lit("ann"), n)).otherwise(" ").alias("character_name")))
    files = logs.select(F.concat(F.lit("log"), n).alias("file"), F.concat(head, F.lit("\r\n"), F.array_join(F.transform("x", lambda r: r["l"]), "\n"), F.lit("\n")).alias("value"))
    return chat_messages(files).select("file", "character_name", "k", "role", F.sha2("text", 256).alias("digest"))


@query("""WITH p AS (SELECT page_id, 'https://h.org/' || page_id % 40 AS url, repeat('A sentence of page ' || page_id % 40 || '. ', 12) AS text FROM pages), t AS (SELECT DISTINCT url, text FROM p WHERE length(trim(text)) >= 120)
SELECT url, sha256(text) AS digest, 0 AS k, sha256(trim(text)) AS paragraph FROM t""")
def crawl_paragraphs(spark, sf):
    """Crawl records as JSON lines, parsed, admitted, once per URL and text, in paragraphs."""
    from ..sources import records

    n = (F.col("page_id") % 40).cast("string")
    none = F.lit(None).cast("string")
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("https://h.org/"), n, F.lit("?utm_source=x#f")).alias("url"), none.alias("canonical_url"), F.lit("T").alias("title"), F.expr("repeat(concat('A sentence of page ', page_id % 40, '. '), 12)").alias("text"), none.alias("fetched_at"), F.lit("web").alias("source_type"),
    )
    read = records.crawl_lines(pages).select(F.from_json("value", records.CRAWL).alias("r")).select("r.*")
    return records.crawl_paragraphs(read).select("url", "digest", "k", F.sha2("paragraph", 256).alias("paragraph"))
