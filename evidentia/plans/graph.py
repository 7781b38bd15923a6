"""Vector and graph queries. The supplied vectors are close to random: floors are .20 to .25 here, and a label stands in for a topic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import regions as P
from ..operators import vector as X
from ..operators.relations import anchored, relate
from .registry import query, table

CORE, ATTACH, FLOOR = 0.25, 0.22, 0.20

_SIMS = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id AS id, round(list_dot_product(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity >= {floor}), near AS (SELECT * FROM k WHERE rank <= 12)
"""
_EDGES = _SIMS.format(floor=FLOOR) + """, g AS (SELECT least(q, id) AS a, greatest(q, id) AS b, max(similarity) AS similarity FROM near GROUP BY ALL),
edges AS (SELECT g.*, CASE WHEN x.label = y.label AND (a + b) % 97 = 0 THEN 'CONTRADICTS' WHEN x.label = y.label AND similarity >= 0.35 THEN 'EQUIVALENT' WHEN x.label = y.label AND similarity >= 0.30 THEN 'REFINES' WHEN x.label = y.label THEN 'SAME_TOPIC' ELSE 'RELATED' END AS relation
FROM g JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b)
"""


def edges(spark, sf):
    """Neighbour graph with relations by label."""
    e = table(spark, sf, "embeddings")
    g = X.neighbor_graph(e, 12, FLOOR)
    label = lambda c: e.select(F.col("vec_id").alias(c), F.col("label").alias(f"of_{c}"))
    known = g.join(label("a"), "a").join(label("b"), "b")
    return X.relation(known, F.col("of_a") == F.col("of_b"), (F.col("a") + F.col("b")) % 97 == 0, 0.35, 0.30).select("a", "b", "similarity", "relation")


@query(_SIMS.format(floor=-1) + "SELECT q, id, similarity, rank FROM k WHERE rank <= 5 AND q % 20 = 0")
def knn_topk(spark, sf):
    """Five nearest vectors of every twentieth one, against all."""
    e = table(spark, sf, "embeddings")
    return X.top_k(e.filter("vec_id % 20 = 0"), e, 5).withColumn("rank", F.col("rank").cast("long"))


@query(_EDGES + "SELECT a, b, similarity FROM g")
def neighbor_graph(spark, sf):
    """Unordered pairs of 12 nearest neighbours."""
    return edges(spark, sf).select("a", "b", "similarity")


@query(_EDGES + "SELECT a, b, relation FROM edges")
def relation_types(spark, sf):
    """Relation of each neighbour pair by the first rule that fits."""
    return edges(spark, sf).select("a", "b", "relation")


@query(_SIMS.format(floor=-1) + """, d AS (SELECT q, id, similarity * 2 AS s2, x.label = y.label AS topic, CASE WHEN x.label <> y.label OR similarity * 2 < 0.90 THEN NULL WHEN (q + id) % 3 = 0 AND (q + id) % 2 = 0 THEN 'challenges' WHEN (q + id) % 3 = 0 AND similarity * 2 >= 0.94 THEN 'reinforces' ELSE 'refines' END AS d FROM k JOIN v x ON x.vec_id = q JOIN v y ON y.vec_id = id WHERE rank <= 12)
SELECT q, coalesce(arg_min(d, struct_pack(s := -s2, i := id)) FILTER (d IS NOT NULL), 'novel') AS decision, coalesce(arg_min(id, struct_pack(s := -s2, i := id)) FILTER (d IS NOT NULL), -1) AS by FROM d GROUP BY q""")
def vector_admission(spark, sf):
    """Decision on each statement by its nearest ones; similarities are doubled to reach the thresholds."""
    e = table(spark, sf, "embeddings")
    near = X.top_k(e, e, 12)
    label = lambda c: e.select(F.col("vec_id").alias(c), F.col("label").alias(f"of_{c}"))
    n, both = near.join(label("q"), "q").join(label("id"), "id"), F.col("q") + F.col("id")
    same = F.col("of_q") == F.col("of_id")
    return X.vector_admission(n.select("q", "id", (F.col("similarity") * 2).alias("similarity"), (same & (both % 3 == 0)).alias("same_statement"), same.alias("same_topic"), (both % 2 == 0).alias("opposite"))).na.fill({"by": -1})


@query()
def cluster_cores(spark, sf):
    """Bridge-safe cores and their fringe: an ordered fold per component, tested on hand-made graphs."""
    return G.clusters(edges(spark, sf), CORE, ATTACH)


@query()
def cluster_metrics(spark, sf):
    """Density, cohesion, boundary and separation of the clusters."""
    e = G.held(edges(spark, sf))
    return G.cluster_metrics(G.held(G.clusters(e, CORE, ATTACH)), e)


@query()
def membership_metrics(spark, sf):
    """Affinity, links and strongest neighbour of each member of a cluster."""
    e = G.held(edges(spark, sf))
    return G.membership_metrics(G.held(G.clusters(e, CORE, ATTACH)), e)


@query()
def cluster_outliers(spark, sf):
    """Nodes of the neighbour graph that are in no cluster."""
    e = G.held(edges(spark, sf))
    return G.outliers(G.clusters(e, CORE, ATTACH), e)


@query("""WITH RECURSIVE v AS (SELECT vec_id AS id, label AS cluster, embedding::DOUBLE[] AS e, vec_id % 3 = 0 AND label <> 3 AS core FROM embeddings),
n AS (SELECT id, cluster, core, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v), c AS (SELECT *, NOT bool_or(core) OVER (PARTITION BY cluster) OR core AS inner FROM n),
m AS (SELECT a.cluster, a.id, round(avg(list_dot_product(a.e, b.e)), 9) AS s FROM c a JOIN c b ON a.cluster = b.cluster AND a.inner AND b.inner GROUP BY ALL), f AS (SELECT cluster, arg_min(id, struct_pack(s := -s, i := id)) AS id FROM m GROUP BY cluster),
r AS (SELECT cluster, 0 AS place, [id] AS chosen FROM f
UNION ALL SELECT r.cluster, r.place + 1, list_append(r.chosen, (SELECT arg_min(x.id, struct_pack(l := x.l, i := x.id)) FROM (SELECT a.id, max(round(list_dot_product(a.e, b.e), 9)) AS l FROM n a JOIN n b ON b.cluster = a.cluster AND list_contains(r.chosen, b.id) WHERE a.cluster = r.cluster AND NOT list_contains(r.chosen, a.id) GROUP BY a.id) x)) FROM r WHERE r.place < 3)
SELECT cluster, place, chosen[place + 1] AS id FROM r""")
def cluster_representatives(spark, sf):
    """Four representatives of each label: the core member nearest to all, and then what is least like those chosen."""
    e = table(spark, sf, "embeddings")
    points = e.select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), ((F.col("vec_id") % 3 == 0) & (F.col("label") != 3)).alias("core"))
    return G.representatives(points, 4)


_PAIR_SQL = """WITH o AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders),
s AS (SELECT o_orderkey AS id, nullif('s' || (o_custkey % 3 + o_orderkey % 2), 's0') AS subject, ['located_at', 'like', 'say', 'visit'][o_orderkey % 4 + 1] AS predicate, ['town', 'old town', 's1', 's2', NULL][o_orderkey % 5 + 1] AS object, CASE WHEN o_orderkey % 6 = 0 THEN -1 ELSE 1 END AS polarity,
 't' || (o_orderkey % 3) AS topic, CASE WHEN o_orderkey % 8 < 6 THEN 'EVENT' ELSE 'STATE' END AS kind, ['SPATIAL', 'emotional', 'COMMUNICATION', 'ACTION'][o_orderkey % 4 + 1] AS family, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 2 END AS world, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey % 2 END AS timeline,
 o_custkey % 4 AS node, [NULL, 'World', 'character'][o_orderkey % 3 + 1] AS scope, CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 2 END AS inst, (o_orderkey % 10) / 10.0::DOUBLE AS sure FROM orders),
p AS (SELECT a.id AS i, b.id AS j, 0.70 + ((a.id + b.id) % 30) / 100.0::DOUBLE AS sim, a, b FROM o JOIN s b ON b.id = o.o_orderkey JOIN s a ON a.id = o.prev),
f AS (SELECT *, coalesce(a.subject = b.subject, FALSE) AS ss, a.predicate = b.predicate AS sp, coalesce(a.object = b.object, FALSE) AS so, a.polarity = b.polarity AS pol, a.topic = b.topic AS tp, coalesce(a.world = b.world, FALSE) AS sw, coalesce(a.world = b.world, TRUE) AS wc, coalesce(a.timeline = b.timeline, TRUE) AS tc,
 a.kind = 'EVENT' AND b.kind = 'EVENT' AS ev, a.node = b.node AS nd, upper(a.family) = upper(b.family) AS fam, coalesce(a.subject = b.object AND a.object = b.subject AND a.subject <> b.subject, FALSE) AS rr, coalesce(a.object <> b.object AND (contains(a.object, b.object) OR contains(b.object, a.object)), FALSE) AS inside,
 CASE WHEN lower(a.scope) = 'world' THEN 'w' WHEN lower(a.scope) = 'character' OR a.inst IS NOT NULL THEN 'c' ELSE 'u' END AS xa, CASE WHEN lower(b.scope) = 'world' THEN 'w' WHEN lower(b.scope) = 'character' OR b.inst IS NOT NULL THEN 'c' ELSE 'u' END AS xb FROM p),
g AS (SELECT *, ss AND sp AND ((so AND NOT pol) OR (pol AND NOT so AND a.object IS NOT NULL AND b.object IS NOT NULL AND a.predicate = 'located_at')) AS sc, ss AND sp AND pol AND inside AS ref, NOT (fam AND upper(a.family) = 'COMMUNICATION') OR so AS cc,
 CASE WHEN xa = 'w' AND xb = 'w' THEN CASE WHEN sw THEN 'WORLD_SAME_WORLD' ELSE 'WORLD_CROSS_WORLD' END WHEN xa = 'c' AND xb = 'c' THEN CASE WHEN coalesce(a.inst = b.inst, FALSE) THEN 'CHAR_SAME_VIEWPOINT' ELSE 'CHAR_CROSS_VIEWPOINT' END WHEN xa || xb IN ('cw', 'wc') THEN 'CHAR_WORLD' ELSE 'UNSCOPED' END AS scope_relation FROM f),
v AS (SELECT i, j, unnest([
 struct_pack(r := 'EQUIVALENT', x := 'subject', v := CASE WHEN ss THEN 2 ELSE -2 END), struct_pack(r := 'EQUIVALENT', x := 'predicate', v := CASE WHEN sp THEN 2 ELSE -2 END), struct_pack(r := 'EQUIVALENT', x := 'object', v := CASE WHEN so THEN 2 ELSE -1 END), struct_pack(r := 'EQUIVALENT', x := 'polarity', v := CASE WHEN pol THEN 2 ELSE -3 END),
 struct_pack(r := 'EQUIVALENT', x := 'vector', v := CASE WHEN sim >= 0.90 THEN 2 WHEN sim >= 0.82 THEN 1 ELSE -1 END), struct_pack(r := 'EQUIVALENT', x := 'semantic_conflict', v := CASE WHEN sc THEN -2 ELSE 0 END),
 struct_pack(r := 'REFINES', x := 'subject', v := CASE WHEN ss THEN 2 ELSE -2 END), struct_pack(r := 'REFINES', x := 'predicate', v := CASE WHEN sp THEN 2 ELSE -1 END), struct_pack(r := 'REFINES', x := 'object', v := CASE WHEN ref THEN 2 WHEN NOT so THEN 1 ELSE 0 END), struct_pack(r := 'REFINES', x := 'polarity', v := CASE WHEN pol THEN 2 ELSE -3 END),
 struct_pack(r := 'REFINES', x := 'vector', v := CASE WHEN sim >= 0.78 THEN 1 ELSE -1 END), struct_pack(r := 'REFINES', x := 'semantic_conflict', v := CASE WHEN sc THEN -2 ELSE 0 END),
 struct_pack(r := 'SAME_EVENT', x := 'event', v := CASE WHEN ev THEN 0 ELSE -8 END), struct_pack(r := 'SAME_EVENT', x := 'timeline', v := CASE WHEN tc THEN 0 ELSE -8 END), struct_pack(r := 'SAME_EVENT', x := 'world', v := CASE WHEN wc THEN 0 ELSE -8 END), struct_pack(r := 'SAME_EVENT', x := 'occurrence', v := CASE WHEN nd THEN 4 ELSE -4 END),
 struct_pack(r := 'SAME_EVENT', x := 'subject', v := CASE WHEN ss THEN 2 ELSE -2 END), struct_pack(r := 'SAME_EVENT', x := 'predicate', v := CASE WHEN sp THEN 2 ELSE -3 END), struct_pack(r := 'SAME_EVENT', x := 'predicate_family', v := CASE WHEN fam THEN 1 ELSE -4 END), struct_pack(r := 'SAME_EVENT', x := 'object', v := CASE WHEN so THEN 2 ELSE -1 END),
 struct_pack(r := 'SAME_EVENT', x := 'communication_content', v := CASE WHEN cc THEN 0 ELSE -8 END), struct_pack(r := 'SAME_EVENT', x := 'polarity', v := CASE WHEN pol THEN 1 ELSE -4 END), struct_pack(r := 'SAME_EVENT', x := 'vector', v := CASE WHEN sim >= 0.86 THEN 1 WHEN sim >= 0.80 THEN 0 ELSE -1 END),
 struct_pack(r := 'SAME_EVENT', x := 'role_reversal', v := CASE WHEN rr THEN -8 ELSE 0 END), struct_pack(r := 'SAME_EVENT', x := 'semantic_conflict', v := CASE WHEN sc THEN -8 ELSE 0 END),
 struct_pack(r := 'SAME_TOPIC', x := 'topic', v := CASE WHEN tp THEN 3 ELSE -2 END), struct_pack(r := 'SAME_TOPIC', x := 'world', v := CASE WHEN sw THEN 1 ELSE 0 END), struct_pack(r := 'SAME_TOPIC', x := 'vector', v := CASE WHEN sim >= 0.82 THEN 2 WHEN sim >= 0.76 THEN 1 ELSE -1 END), struct_pack(r := 'SAME_TOPIC', x := 'semantic_conflict', v := CASE WHEN sc THEN -2 ELSE 0 END),
 struct_pack(r := 'CONTRADICTS', x := 'subject', v := CASE WHEN ss THEN 2 ELSE -3 END), struct_pack(r := 'CONTRADICTS', x := 'predicate', v := CASE WHEN sp THEN 2 ELSE -3 END), struct_pack(r := 'CONTRADICTS', x := 'target', v := CASE WHEN sc THEN 4 ELSE -3 END), struct_pack(r := 'CONTRADICTS', x := 'scope', v := CASE WHEN scope_relation IN ('WORLD_SAME_WORLD', 'CHAR_SAME_VIEWPOINT') THEN 1 ELSE 0 END),
 struct_pack(r := 'CONTRADICTS', x := 'legacy_conflict', v := 0),
 struct_pack(r := 'RELATED', x := 'vector', v := CASE WHEN sim >= 0.86 THEN 3 WHEN sim >= 0.76 THEN 2 ELSE 0 END), struct_pack(r := 'RELATED', x := 'topic', v := CASE WHEN tp THEN 1 ELSE 0 END), struct_pack(r := 'RELATED', x := 'subject', v := CASE WHEN ss THEN 1 ELSE 0 END), struct_pack(r := 'RELATED', x := 'world', v := CASE WHEN sw THEN 1 ELSE 0 END),
 struct_pack(r := 'RELATED', x := 'semantic_conflict', v := CASE WHEN sc THEN -2 ELSE 0 END)], recursive := TRUE) FROM g),
t AS (SELECT i, j, r, sum(v) AS s FROM v GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY s DESC, r) AS k FROM t),
top AS (SELECT x.i, x.j, x.r AS winner, x.s AS score, x.s - y.s AS margin FROM rk x JOIN rk y ON x.i = y.i AND x.j = y.j AND x.k = 1 AND y.k = 2),
ax AS (SELECT DISTINCT x FROM v), om AS (SELECT t.i, t.j, ax.x, t.r, t.s - coalesce(v.v, 0) AS s FROM t CROSS JOIN ax LEFT JOIN v ON v.i = t.i AND v.j = t.j AND v.r = t.r AND v.x = ax.x),
omw AS (SELECT i, j, x, arg_min(r, struct_pack(s := -s, r := r)) AS w FROM om GROUP BY ALL), stab AS (SELECT omw.i, omw.j, avg(CASE WHEN w = winner THEN 1.0 ELSE 0.0 END) AS stability FROM omw JOIN top USING (i, j) GROUP BY ALL),
d AS (SELECT g.i AS a, g.j AS b, scope_relation, sim, ev, winner, score, margin, stability, least(g.a.sure, g.b.sure) AS sure, CASE WHEN sc THEN 'CONTRADICTS' WHEN ss AND sp AND so AND pol THEN 'EQUIVALENT' WHEN ref THEN 'REFINES' WHEN ev AND wc AND tc AND nd AND pol AND ss AND sp AND fam AND cc AND NOT rr AND sim >= 0.80 THEN 'SAME_EVENT' WHEN tp THEN 'SAME_TOPIC' ELSE 'RELATED' END AS proposed
 FROM g JOIN top USING (i, j) JOIN stab USING (i, j)),
e AS (SELECT *, CASE WHEN winner <> proposed THEN 'challenged' WHEN score < 4 OR margin < 2 OR stability < 0.6 THEN 'fragile' ELSE 'verified' END AS status FROM d)
"""


@query(_PAIR_SQL + """SELECT a, b, CASE WHEN status = 'verified' THEN winner ELSE 'UNRESOLVED' END AS relation, scope_relation, proposed, score::BIGINT AS score, margin::BIGINT AS margin, round(stability, 6) AS stability, status,
 round(CASE WHEN status <> 'verified' THEN 0 WHEN winner = 'SAME_EVENT' AND ev THEN least(sure, 0.98, 0.55 * sim + 0.45 * greatest(0.0, least(1.0, (score + 6) / 16.0))) ELSE least(0.98, 0.55 * sim + 0.45 * greatest(0.0, least(1.0, (score + 6) / 16.0))) END, 6)::DOUBLE AS confidence,
 CASE WHEN status <> 'verified' OR winner <> 'CONTRADICTS' THEN 'consistent_or_related' ELSE CASE scope_relation WHEN 'WORLD_SAME_WORLD' THEN 'objective_world_conflict' WHEN 'WORLD_CROSS_WORLD' THEN 'cross_world_divergence' WHEN 'CHAR_SAME_VIEWPOINT' THEN 'internal_belief_conflict' WHEN 'CHAR_CROSS_VIEWPOINT' THEN 'viewpoint_disagreement'
 WHEN 'CHAR_WORLD' THEN 'belief_world_discrepancy' ELSE 'semantic_conflict_unscoped' END END AS meaning FROM e""")
def relation_verdicts(spark, sf):
    """What consecutive orders of a customer, dressed as statements, are to each other, by votes of independent features."""
    from pyspark.sql import Window

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda m, *v: F.element_at(F.array(*map(F.lit, v)), (m + 1).cast("int"))
    subject = F.concat(F.lit("s"), (c % 3 + k % 2).cast("string"))
    statement = F.struct(
        F.concat(F.lit("t"), (k % 3).cast("string")).alias("topic_key"), F.when(subject != "s0", subject).alias("subject_norm"), pick(k % 4, "located_at", "like", "say", "visit").alias("predicate_norm"),
        pick(k % 5, "town", "old town", "s1", "s2", None).alias("object_norm"), F.when(k % 6 == 0, -1).otherwise(1).alias("polarity"), F.when(k % 8 < 6, "EVENT").otherwise("STATE").alias("claim_kind"),
        pick(k % 4, "SPATIAL", "emotional", "COMMUNICATION", "ACTION").alias("predicate_family"), F.when(k % 7 > 0, k % 2).alias("world_id"), F.when(k % 9 > 0, c % 2).alias("timeline_id"), (c % 4).alias("dag_node_id"),
        pick(k % 3, None, "World", "character").alias("epistemic_scope"), F.when(k % 5 < 3, k % 2).alias("character_instance_id"), F.lit(None).cast("string").alias("character_id"), F.lit(None).cast("string").alias("viewpoint_id"), (k % 10 / 10.0).alias("semantic_confidence"),
    )
    o = table(spark, sf, "orders").select(c, k, statement.alias("b"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = o.select(F.lag("o_orderkey").over(w).alias("i"), F.col("o_orderkey").alias("j"), F.lag("b").over(w).alias("a"), "b").filter("i is not null")
    found = relate(pairs.withColumn("similarity", 0.70 + (F.col("i") + F.col("j")) % 30 / 100.0))
    long = lambda n: F.col(n).cast("long").alias(n)
    return found.select(F.col("i").alias("a"), F.col("j").alias("b"), "relation", "scope_relation", "proposed", long("score"), long("margin"), F.round("stability", 6).alias("stability"), "status", F.round("confidence", 6).alias("confidence"), "meaning")


@query(_EDGES + """, w AS (SELECT vec_id, 's' || vec_id % 5 AS s, 's' || vec_id % 7 AS o, 't' || label AS t FROM embeddings) SELECT a, b, similarity FROM g JOIN w x ON x.vec_id = a JOIN w y ON y.vec_id = b WHERE x.s = y.s OR x.o = y.o OR x.t = y.t OR (x.s = y.o AND x.o = y.s)""")
def anchored_neighbors(spark, sf):
    """Neighbour pairs that share a subject, object or topic, or have them swapped; numbers stand in for them."""
    v = F.col("vec_id")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    said = table(spark, sf, "embeddings").select("vec_id", F.struct(name("s", v % 5).alias("subject_norm"), name("s", v % 7).alias("object_norm"), name("t", F.col("label")).alias("topic_key")).alias("x"))
    g = edges(spark, sf).join(said.select(F.col("vec_id").alias("a"), F.col("x").alias("xa")), "a").join(said.select(F.col("vec_id").alias("b"), F.col("x").alias("xb")), "b")
    g = g.select(F.col("a").alias("i"), F.col("b").alias("j"), "similarity", F.col("xa").alias("a"), F.col("xb").alias("b")).filter(anchored())
    return g.select(F.col("i").alias("a"), F.col("j").alias("b"), "similarity")


@query(_EDGES + """SELECT x.label AS cluster, count(DISTINCT CASE WHEN y.label = x.label THEN least(a, b) END) AS linked,
 round(avg(similarity) FILTER (x.label = y.label), 6) AS cohesion, round(max(similarity) FILTER (x.label <> y.label), 6) AS boundary
FROM (SELECT a, b, similarity FROM edges UNION ALL SELECT b, a, similarity FROM edges) JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b GROUP BY x.label""")
def label_metrics(spark, sf):
    """Cohesion and boundary of labels taken as clusters."""
    e = table(spark, sf, "embeddings")
    g = edges(spark, sf)
    both = g.select("a", "b", "similarity").unionByName(g.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    known = both.join(e.select(F.col("vec_id").alias("a"), F.col("label").alias("cluster")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("label").alias("other")), "b")
    same = F.col("cluster") == F.col("other")
    return known.groupBy("cluster").agg(F.count_distinct(F.when(same, F.least("a", "b"))).alias("linked"), F.round(F.avg(F.when(same, F.col("similarity"))), 6).alias("cohesion"), F.round(F.max(F.when(~same, F.col("similarity"))), 6).alias("boundary"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT a, b FROM (SELECT o_custkey % 50000 AS a, (o_orderkey * 7) % 50000 AS b FROM orders) WHERE a <> b),
e AS (SELECT a, b FROM n UNION SELECT b, a FROM n),
w AS (SELECT s AS seed, s AS node, 0 AS depth FROM (VALUES (1), (2), (3), (4), (5)) AS t(s) UNION SELECT seed, b, depth + 1 FROM w JOIN e ON a = node WHERE depth < 3)
SELECT seed, node, min(depth) AS depth FROM w GROUP BY ALL""")
def bfs_walk(spark, sf):
    """Nodes within three steps of five seeds, at their nearest depth."""
    o = table(spark, sf, "orders")
    e = o.select((F.col("o_custkey") % 50000).cast("int").alias("a"), (F.col("o_orderkey") * 7 % 50000).cast("int").alias("b")).filter("a != b").distinct()
    return G.walk(spark.range(1, 6).select(F.col("id").cast("int").alias("seed")), e, 3)


_WORLDS = """WITH RECURSIVE r AS (SELECT c_custkey % 60 AS w, (c_custkey * 7 + 3) % 60 AS src, c_custkey % 5 AS prio, CASE c_custkey % 4 WHEN 0 THEN ['lore'] WHEN 1 THEN [' Lore ', 'rules', '9bad'] WHEN 2 THEN ['rules'] ELSE ['lore', 'LORE', 'people'] END AS d, c_custkey % 9 > 0 AS en FROM customer WHERE c_custkey <= 90),
e AS (SELECT DISTINCT w, src, prio, lower(trim(x)) AS domain FROM (SELECT w, src, prio, unnest(d) AS x FROM r WHERE en) WHERE regexp_matches(lower(trim(x)), '^[a-z][a-z0-9_]{0,31}$')), shut(w, domain) AS (SELECT x, 'lore' FROM (VALUES (3), (11), (24)) AS t(x) UNION ALL SELECT 6, 'rules'),
walk AS (SELECT w AS root, domain, src, 1 AS depth, 100000 + prio AS rank, [w, src] AS path FROM e WHERE (w, domain) NOT IN (SELECT w, domain FROM shut)
UNION ALL SELECT k.root, k.domain, e.src, k.depth + 1, k.rank + 100000 + e.prio, list_append(k.path, e.src) FROM walk k JOIN e ON e.w = k.src AND e.domain = k.domain WHERE k.depth < 4 AND NOT list_contains(k.path, e.src) AND (k.src, k.domain) NOT IN (SELECT w, domain FROM shut))
"""


@query(_WORLDS + "SELECT root AS world, domain, src AS source, min(rank) AS rank, min(depth) AS depth FROM walk GROUP BY ALL")
def scope_resolution(spark, sf):
    """Worlds that a world inherits from in each domain, up to four steps, not through worlds that keep a domain to themselves."""
    from ..operators.retrieval import world_scopes

    c, k = table(spark, sf, "customer").filter("c_custkey <= 90"), F.col("c_custkey")
    words = lambda *v: F.array(*map(F.lit, v))
    domains = F.when(k % 4 == 0, words("lore")).when(k % 4 == 1, words(" Lore ", "rules", "9bad")).when(k % 4 == 2, words("rules")).otherwise(words("lore", "LORE", "people"))
    relations = c.select((k % 60).alias("world"), ((k * 7 + 3) % 60).alias("source"), (k % 5).cast("int").alias("priority"), domains.alias("domains"), (k % 9 > 0).alias("enabled"))
    shut = spark.createDataFrame([(3, "lore"), (11, "lore"), (24, "lore"), (6, "rules")], "world long, domain string")
    return world_scopes(relations, shut)


@query("""WITH RECURSIVE n AS (SELECT DISTINCT o_custkey % 3000 AS a, (o_orderkey * 7) % 3000 AS b, ['SUPPORTS', 'MENTIONS', 'CAUSES'][o_orderkey % 3 + 1] AS type FROM orders WHERE o_custkey % 3000 <> (o_orderkey * 7) % 3000), e AS (SELECT a, b FROM n WHERE type <> 'MENTIONS' UNION SELECT b, a FROM n WHERE type <> 'MENTIONS'),
w AS (SELECT s AS seed, s AS node, 0 AS depth FROM (VALUES (1), (2), (3)) AS t(s) UNION SELECT seed, b, depth + 1 FROM w JOIN e ON a = node WHERE depth < 2) SELECT seed, node, min(depth) AS depth FROM w GROUP BY ALL""")
def typed_walk(spark, sf):
    """Nodes within two steps of three seeds over edges of some types, at their nearest depth."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    e = o.select((F.col("o_custkey") % 3000).cast("int").alias("a"), (k * 7 % 3000).cast("int").alias("b"), F.element_at(F.array(*map(F.lit, ("SUPPORTS", "MENTIONS", "CAUSES"))), (k % 3 + 1).cast("int")).alias("type")).filter("a != b")
    return G.walk(spark.range(1, 4).select(F.col("id").cast("int").alias("seed")), e, 2, ("SUPPORTS", "CAUSES"))


_DIMENSIONS = {
    "dominant_topics": "'t' || (vec_id % 17)", "dominant_subjects": "CASE WHEN label <> 2 THEN 's' || (vec_id * label % 5) END", "dominant_predicates": "'p' || (vec_id % (label + 2))", "source_domains": "CASE WHEN label % 3 > 0 THEN 'd' || vec_id % 2 END",
    "world_distribution": "'w' || (label % 2)", "timeline_distribution": "CASE WHEN label < 5 THEN 'l' ELSE 'm' || vec_id % 2 END", "character_instances": "CASE WHEN label % 4 = 0 THEN 'i' || label END", "origin_characters": "CASE WHEN label % 2 = 0 THEN 'o' END",
    "claim_kinds": "['EVENT', 'BELIEF', 'STATE', 'TRAIT'][CASE label % 4 WHEN 0 THEN 1 WHEN 1 THEN vec_id % 2 * 3 + 1 WHEN 2 THEN vec_id % 4 + 1 ELSE 2 + vec_id % 2 END]", "predicate_families": "CASE WHEN label % 3 = 0 THEN 'SPATIAL' WHEN vec_id % 3 = 0 THEN 'Emotional' ELSE 'ACTION' END",
}
_REGIONS = "WITH a AS (" + " UNION ALL ".join(f"SELECT label, vec_id, '{d}' AS dim, {x} AS val FROM embeddings" for d, x in _DIMENSIONS.items()) + """),
c0 AS (SELECT label, dim, val, count(DISTINCT vec_id)::DOUBLE AS n FROM a WHERE val IS NOT NULL GROUP BY ALL), c AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY label, dim ORDER BY n DESC, val) <= 12),
t AS (SELECT label, min(vec_id + label * 100) AS t0, max(vec_id + label * 100) AS t1 FROM embeddings WHERE vec_id % 10 < 2 + label % 3 AND label <> 9 AND vec_id < 200 GROUP BY label)
"""


def _regions(spark, sf):
    """Labels as regions, with attributes made of numbers."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    v, l = F.col("vec_id"), F.col("label")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    kind = F.when(l % 4 == 0, 1).when(l % 4 == 1, v % 2 * 3 + 1).when(l % 4 == 2, v % 4 + 1).otherwise(2 + v % 2).cast("int")
    attributes = {
        "dominant_topics": name("t", v % 17), "dominant_subjects": F.when(l != 2, name("s", v * l % 5)), "dominant_predicates": name("p", v % (l + 2)), "source_domains": F.when(l % 3 > 0, name("d", v % 2)),
        "world_distribution": name("w", l % 2), "timeline_distribution": F.when(l < 5, "l").otherwise(name("m", v % 2)), "character_instances": F.when(l % 4 == 0, name("i", l)), "origin_characters": F.when(l % 2 == 0, "o"),
        "claim_kinds": F.element_at(F.array(*map(F.lit, ("EVENT", "BELIEF", "STATE", "TRAIT"))), kind), "predicate_families": F.when(l % 3 == 0, "SPATIAL").when(v % 3 == 0, "Emotional").otherwise("ACTION"),
    }
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), x.alias("value")) for d, x in attributes.items()])
    values = e.select(l.alias("cluster"), v.alias("node"), F.explode(pairs).alias("x")).select("cluster", "node", "x.*")
    times = e.filter((v % 10 < 2 + l % 3) & (l != 9) & (v < 200)).select(l.alias("cluster"), (v + l * 100).alias("at"))
    return P.describe(values, times)


@query(_REGIONS + """, d AS (SELECT label, dim, string_agg(val || '=' || n::INT, ',' ORDER BY n DESC, val) AS top FROM c GROUP BY ALL) SELECT d.label, dim, top, t0, t1 FROM d LEFT JOIN t USING (label)""")
def cluster_metadata(spark, sf):
    """Twelve most frequent values of each dimension of a region, and its span of time."""
    r = _regions(spark, sf).select(F.col("cluster").alias("label"), F.explode("counts").alias("dim", "m"), F.col("time_start").alias("t0"), F.col("time_end").alias("t1"))
    top = F.array_sort(F.transform(F.map_entries("m"), lambda x: F.struct((-x["value"]).alias("s"), x["key"].alias("k"))))
    return r.select("label", "dim", F.array_join(F.transform(top, lambda x: F.concat_ws("=", x["k"], (-x["s"]).cast("int"))), ",").alias("top"), "t0", "t1")


@query(_REGIONS + """, k AS (SELECT label, sum(n) AS n, sum(n) FILTER (val = 'EVENT') AS e, sum(n) FILTER (val IN ('BELIEF', 'TRAIT')) AS b, sum(n) FILTER (val IN ('STATE', 'TRAIT')) AS s FROM c WHERE dim = 'claim_kinds' GROUP BY label),
f AS (SELECT label, coalesce(sum(n) FILTER (lower(val) IN ('spatial', 'emotional')), 0) / sum(n) AS s FROM c WHERE dim = 'predicate_families' GROUP BY label), o AS (SELECT label, max(n) / sum(n) AS s FROM c WHERE dim = 'dominant_topics' GROUP BY label),
z AS (SELECT label, unnest([struct_pack(c := coalesce(e, 0) / n, k := 0, l := 'EVENT_REGION'), struct_pack(c := coalesce(b, 0) / n, k := 2, l := 'BELIEF_REGION'), struct_pack(c := greatest(f.s, coalesce(k.s, 0) / n), k := 5, l := 'STATE_SERIES'), struct_pack(c := o.s, k := 6, l := 'TOPIC_REGION')], recursive := TRUE) FROM k JOIN f USING (label) JOIN o USING (label)),
b AS (SELECT label, arg_max(l, struct_pack(c := c, k := -k)) AS l, max(c) AS c FROM z GROUP BY label) SELECT label, CASE WHEN c < 0.55 THEN 'MIXED_REGION' ELSE l END AS region, round(CASE WHEN c < 0.55 THEN greatest(c, 0.5) ELSE c END, 6) AS confidence FROM b""")
def region_labels(spark, sf):
    """What a region is, by the largest share of its kinds, families and topics."""
    r = P.region_label(F.col("counts"))
    return _regions(spark, sf).select(F.col("cluster").alias("label"), r.alias("r")).select("label", F.col("r.label").alias("region"), F.round("r.confidence", 6).alias("confidence"))


_BOUNDARY_SQL = _REGIONS + """, p AS (SELECT a.label AS x, b.label AS y, ((a.label * 7 + b.label * 3) % 10) / 10.0::DOUBLE AS c, 0.3 + ((a.label + b.label) % 7) / 10.0::DOUBLE AS sim FROM (SELECT DISTINCT label FROM embeddings) a JOIN (SELECT DISTINCT label FROM embeddings) b ON a.label < b.label),
dims AS (SELECT DISTINCT dim FROM a), u AS (SELECT p.x, p.y, c.dim, c.val, max(CASE WHEN c.label = p.x THEN n ELSE 0 END) AS nx, max(CASE WHEN c.label = p.y THEN n ELSE 0 END) AS ny FROM p JOIN c ON c.label = p.x OR c.label = p.y GROUP BY ALL),
o AS (SELECT p.x, p.y, dims.dim, coalesce(sum(least(nx, ny)) / sum(greatest(nx, ny)), 0.5) AS v FROM p CROSS JOIN dims LEFT JOIN u ON u.x = p.x AND u.y = p.y AND u.dim = dims.dim GROUP BY ALL),
w AS (SELECT p.*, (SELECT sum(n) FILTER (lower(val) IN ('spatial', 'emotional')) / sum(n) FROM c WHERE dim = 'predicate_families' AND c.label IN (p.x, p.y)) AS st, CASE WHEN a.t0 IS NULL OR b.t0 IS NULL THEN 0 ELSE greatest(0, least(a.t1, b.t1) - greatest(a.t0, b.t0)) / greatest(1.0, greatest(a.t1, b.t1) - least(a.t0, b.t0)) END AS tov,
 CASE WHEN a.t0 IS NULL OR b.t0 IS NULL THEN 0 ELSE greatest(0, greatest(a.t0, b.t0) - least(a.t1, b.t1)) / greatest(1.0, greatest(a.t1, b.t1) - least(a.t0, b.t0)) END AS sep FROM p LEFT JOIN t a ON a.label = p.x LEFT JOIN t b ON b.label = p.y),
f AS (SELECT w.*, tp.v AS tp, sb.v AS sb, pr.v AS pr, so.v AS so, wo.v AS wo, tl.v AS tl, ci.v AS ci, oc.v AS oc FROM w JOIN o tp ON tp.x = w.x AND tp.y = w.y AND tp.dim = 'dominant_topics' JOIN o sb ON sb.x = w.x AND sb.y = w.y AND sb.dim = 'dominant_subjects' JOIN o pr ON pr.x = w.x AND pr.y = w.y AND pr.dim = 'dominant_predicates'
 JOIN o so ON so.x = w.x AND so.y = w.y AND so.dim = 'source_domains' JOIN o wo ON wo.x = w.x AND wo.y = w.y AND wo.dim = 'world_distribution' JOIN o tl ON tl.x = w.x AND tl.y = w.y AND tl.dim = 'timeline_distribution' JOIN o ci ON ci.x = w.x AND ci.y = w.y AND ci.dim = 'character_instances' JOIN o oc ON oc.x = w.x AND oc.y = w.y AND oc.dim = 'origin_characters'),
l AS (SELECT x, y, unnest([struct_pack(k := 0, label := 'SAME_REGION', s := 0.34 * sim + 0.18 * tp + 0.18 * sb + 0.12 * pr + 0.10 * wo + 0.08 * tl - 0.20 * c), struct_pack(k := 1, label := 'TOPIC_SPLIT', s := 0.35 * (1 - sim) + 0.30 * (1 - tp) + 0.20 * (1 - sb) + 0.15 * (1 - pr)),
 struct_pack(k := 2, label := 'TEMPORAL_TRANSITION', s := 0.30 * sep + 0.24 * sb + 0.20 * pr + 0.14 * tl + 0.12 * wo), struct_pack(k := 3, label := 'STATE_TRANSITION', s := 0.20 * sep + 0.18 * sb + 0.16 * pr + 0.14 * tl + 0.10 * wo + 0.22 * st),
 struct_pack(k := 4, label := 'NARRATIVE_SPLIT', s := 0.24 * tp + 0.18 * sb + 0.20 * (1 - so) + 0.16 * c + 0.12 * tov + 0.10 * (1 - sim)), struct_pack(k := 5, label := 'CONTRADICTION_CLUSTER', s := 0.30 * c + 0.18 * c / 2 + 0.14 * c / 4 + 0.14 * tov + 0.12 * wo + 0.12 * tl),
 struct_pack(k := 6, label := 'EXPERIENTIAL_BRANCH_CANDIDATE', s := 0.22 * tp + 0.18 * sb + 0.18 * wo + 0.16 * (1 - ci) + 0.12 * oc + 0.08 * c + 0.06 * tov), struct_pack(k := 7, label := 'WORLD_BRANCH_CANDIDATE', s := 0.24 * tp + 0.18 * sb + 0.18 * (1 - wo) + 0.16 * c + 0.12 * tov + 0.12 * (1 - sim))], recursive := TRUE) FROM f),
r AS (SELECT x, y, label, round(greatest(0, least(1, s)), 6) AS s, row_number() OVER (PARTITION BY x, y ORDER BY round(greatest(0, least(1, s)), 6) DESC, k) AS k FROM l)
"""


@query(_BOUNDARY_SQL + "SELECT a.x, a.y, CASE WHEN a.s < 0.48 OR round(a.s - b.s, 6) < 0.04 THEN 'UNRESOLVED' ELSE a.label END AS label, a.s AS score FROM r a JOIN r b ON a.x = b.x AND a.y = b.y AND a.k = 1 AND b.k = 2")
def boundary_labels(spark, sf):
    """Label of the boundary between each two labels' regions, by overlaps of what they are made of, their times and their conflicts."""
    held_regions = G.held(_regions(spark, sf))
    side = lambda n, c: held_regions.select(F.col("cluster").alias(c), F.struct("counts", "time_start", "time_end").alias(n))
    pairs = side("a", "x").join(side("b", "y"), F.col("x") < F.col("y"))
    c = (F.col("x") * 7 + F.col("y") * 3) % 10 / 10.0
    pairs = pairs.select("x", "y", "a", "b", (0.3 + (F.col("x") + F.col("y")) % 7 / 10.0).alias("similarity"), c.alias("conflict_density"), (c / 4).alias("exclusive_conflict_density"), (c / 2).alias("opposite_polarity_density"))
    return P.boundaries(pairs).select("x", "y", "label", "score")


@query(_SIMS.format(floor=-1) + """SELECT label, arg_min(vec_id, struct_pack(s := -m, i := vec_id)) AS medoid FROM (SELECT x.label, x.vec_id, round(avg(list_dot_product(x.e, y.e)), 6) AS m FROM v x JOIN v y ON x.label = y.label GROUP BY ALL) GROUP BY label""")
def medoids(spark, sf):
    """Member of each label with the highest mean cosine to all its members, from the label's mean vector: no pairs."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    means = e.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean"))
    scored = e.join(means, "label").withColumn("m", F.round(X.cosine(F.col("embedding"), F.col("mean")), 6))
    return scored.groupBy("label").agg(F.min(F.struct((-F.col("m")).alias("s"), "vec_id"))["vec_id"].alias("medoid"))


@query("""SELECT 'g' || (c_custkey % 3) AS graph, 'customer:' || c_custkey AS s, p, o FROM (SELECT c_custkey, 'nation' AS p, 'nation:' || c_nationkey AS o FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT o_custkey, 'ordered', 'order:' || o_orderkey FROM orders)""")
def quads(spark, sf):
    """Rows as statements (graph, s, p, o)."""
    from ..sources.quads import of

    c = of(table(spark, sf, "customer"), "customer", "c_custkey", {"nation": F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")), "segment": F.col("c_mktsegment")}, F.concat(F.lit("g"), (F.col("c_custkey") % 3).cast("string")))
    o = of(table(spark, sf, "orders"), "customer", "o_custkey", {"ordered": F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))}, F.concat(F.lit("g"), (F.col("o_custkey") % 3).cast("string")))
    return c.unionByName(o)


@query("""WITH q AS (SELECT 'customer:' || c_custkey AS s, 'nation:' || c_nationkey AS n, c_mktsegment AS seg FROM customer) SELECT n AS o, count(*) AS subjects, count(DISTINCT seg) AS segments FROM q GROUP BY n""")
def quad_pattern(spark, sf):
    """Two statement patterns that share a subject, counted per object."""
    from ..sources.quads import match, of

    q = of(table(spark, sf, "customer"), "customer", "c_custkey", {"nation": F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")), "segment": F.col("c_mktsegment")}, F.lit("g"))
    return match(q, p="nation").select("s", "o").join(match(q, p="segment").select("s", F.col("o").alias("seg")), "s").groupBy("o").agg(F.count("*").alias("subjects"), F.count_distinct("seg").alias("segments"))


@query("""SELECT id, s, version, value, decision FROM (WITH RECURSIVE w AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS s, event_type AS value, epoch_us(ts) AS t FROM events),
f AS (SELECT id, s, value, t, 1 AS version, 'ADMIT' AS decision FROM w WHERE s = 1
UNION ALL SELECT f.id, w.s, CASE WHEN d = 'ADMIT' THEN w.value ELSE f.value END, CASE WHEN d = 'ADMIT' THEN w.t ELSE f.t END, CASE WHEN d = 'ADMIT' THEN f.version + 1 ELSE f.version END, d
FROM f JOIN w ON w.id = f.id AND w.s = f.s + 1, LATERAL (SELECT CASE WHEN w.value = f.value THEN 'IDEMPOTENT' WHEN w.t = f.t THEN 'CONFLICT' WHEN w.t < f.t THEN 'UNDERDETERMINED' ELSE 'ADMIT' END AS d) x)
SELECT * FROM f)""")
def causal_scalar_fold(spark, sf):
    """A state per user that events write in order of arrival: what each write did."""
    from pyspark.sql import Window

    from ..operators.causal import fold

    e = table(spark, sf, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    w = e.select(F.col("user_id").alias("key"), seq.alias("seq"), F.col("event_id").alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("value"), F.lit("set").alias("event"), F.lit(False).alias("latent"))
    return fold(w).select(F.col("key").alias("id"), F.col("seq").alias("s"), "version", "value", "decision")

