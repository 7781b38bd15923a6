"""Retrieval queries. Benchmark texts are queries, documents the corpus, orders and events stand in for memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import retrieval as R
from ..operators import vector as X
from ..operators.graph import held
from .registry import query, table

_STOP = "(" + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + ")"
_LEX = f"""WITH tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]{{1,}}')) AS term FROM documents),
idx AS (SELECT id, term, count(*) AS tf FROM tok WHERE term NOT IN {_STOP} GROUP BY ALL),
qt AS (SELECT item_id AS q, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]{{1,}}')) AS term FROM benchmark), qu AS (SELECT DISTINCT q, term FROM qt WHERE term NOT IN {_STOP}),
h AS (SELECT q, id, count(*) AS hits, round(sum(ln(1 + tf)), 6) AS score FROM idx JOIN qu USING (term) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hits DESC, score DESC, id) AS rank FROM h) WHERE rank <= 50),
fresh AS (SELECT * FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY n_chars DESC, id) AS rank FROM lex JOIN documents ON doc_id = id) WHERE rank <= 25),
m AS (SELECT q, id, lex.rank AS lexical, fresh.rank AS size FROM lex FULL JOIN fresh USING (q, id)),
rrf AS (SELECT q, id, lexical, size, round(coalesce(100.0 / (60 + lexical), 0) + coalesce(100.0 / (60 + size), 0) + CASE WHEN lang = 'en' THEN 0.10 ELSE 0 END, 6)::DOUBLE AS score FROM m JOIN documents ON doc_id = id)
"""


def _lexical(spark, sf):
    terms = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9][a-z0-9_-]{1,}"), F.lit(0)), lambda t: ~t.isin(list(V.STOP_WORDS)))
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    queries = b.select(F.col("item_id").alias("q"), F.array_distinct(terms(F.col("text"))).alias("terms"))
    return R.lexical(queries, R.term_index(d, "doc_id", terms(F.col("text"))), 50)


def _fused(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang", "source")
    lex = held(_lexical(spark, sf))
    near = lex.join(d, "id")
    size = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n_chars"), "id"))).filter("rank <= 25")
    boosts = near.filter("lang = 'en'").select("q", "id", F.lit(0.10).alias("boost"))
    return R.reciprocal_ranks({"lexical": lex, "size": size}, boosts), d


@query(_LEX + "SELECT q, id, hits, score, rank FROM lex WHERE rank <= 20")
def lexical_search(spark, sf):
    """Best documents of each query by term hits."""
    return _lexical(spark, sf).filter("rank <= 20").withColumn("rank", F.col("rank").cast("long"))


@query(_LEX + "SELECT q, id, score FROM rrf")
def rrf_search(spark, sf):
    """Two rankings fused by reciprocal rank, with a boost."""
    return _fused(spark, sf)[0].select("q", "id", "score")


@query(_LEX + """, s AS (SELECT q, id, score, source, row_number() OVER (PARTITION BY q, source ORDER BY score DESC, id) > 1 AS later FROM rrf JOIN documents ON doc_id = id),
p AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY later, score DESC, id) AS place FROM s) SELECT q, id, place FROM p WHERE place <= 10""")
def doc_diversity(spark, sf):
    """First hit of each source, then the rest, ten per query."""
    hits, d = _fused(spark, sf)
    return R.diverse(hits.join(d, "id"), "source", 10).select("q", "id", F.col("place").cast("long").alias("place"))


@query("""WITH d AS (SELECT doc_id, lang || '.' || source AS path, doc_id % 4 = 0 AS public FROM documents) SELECT doc_id FROM d WHERE (public OR path = 'en.src1' OR path LIKE 'en.src1.%' OR path LIKE 'fr.%') AND NOT (path LIKE '%.src3' OR path = 'de.src2')""")
def acl_filter(spark, sf):
    """Documents that are public or allowed, and not denied, by path prefixes."""
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(".", "lang", "source").alias("path"), (F.col("doc_id") % 4 == 0).alias("public"))
    rows = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    return R.visible(d, rows("en.src1", "fr"), rows("en.src3", "fr.src3", "de.src3", "es.src3", "de.src2")).select("doc_id")


@query("""WITH c AS (SELECT o_orderkey AS id, date_diff('hour', o_orderdate, TIMESTAMP '2002-01-01') AS age, o_totalprice / 500000 AS conf, o_custkey % 7 AS dist, o_orderstatus AS st, o_custkey % 13 = 0 AS active, o_custkey % 17 <> 0 AS vis, (o_orderkey % 10) / 10.0::DOUBLE AS sim, (o_orderkey % 13) / 10.0::DOUBLE AS sal,
 CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 15) / 10.0 END::DOUBLE AS att, o_orderkey % 3 = 0 AS rel, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 7) / 10.0 END::DOUBLE AS emo, (o_orderkey % 19 - 9) / 8.0::DOUBLE AS aff, string_split(lower(o_orderpriority), '-') AS w FROM orders),
o AS (SELECT *, len(list_intersect(w, ['1', 'urgent', 'x'])) / sqrt(len(list_distinct(w)) * 3.0) AS f FROM c)
SELECT id, round(1.4 / (1 + ln(1 + age)) + f + 1.8 * sim + CASE WHEN active THEN 1.4 ELSE 0 END + CASE WHEN rel THEN 0.8 + CASE WHEN active THEN 0.5 ELSE 0 END ELSE 0 END + least(1.0, greatest(coalesce(emo, 0), abs(aff))) + least(1.2, greatest(sal, coalesce(att, 0)))
 + 0.8 * least(1.0, conf) + 1.2 / (1 + dist) - CASE WHEN vis THEN 0 ELSE 100 END - CASE WHEN st = 'P' THEN 2 ELSE 0 END, 6) AS score FROM o""")
def relevance_score(spark, sf):
    """Relevance of orders as memories, as of a given time, in all its twelve parts."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    age = F.floor((F.unix_timestamp(F.lit("2002-01-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.date_trunc("hour", "o_orderdate"))) / 3600)
    words = lambda *w: F.array(*map(F.lit, w))
    status = F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("held")
    s = R.relevance(
        F.split(F.lower("o_orderpriority"), "-"), words("1", "urgent", "x"), F.array().cast("array<string>"), age, F.lit(0), k % 10 / 10.0, F.col("o_custkey") % 13 == 0, k % 3 == 0, F.when(k % 5 > 0, k % 7 / 10.0), (k % 19 - 9) / 8.0, k % 13 / 10.0,
        F.when(k % 4 > 0, k % 15 / 10.0), F.col("o_totalprice") / 500000, F.col("o_custkey") % 7, F.col("o_custkey") % 17 != 0, status,
    )
    return o.select(k.alias("id"), F.round(s, 6).alias("score"))


_FOCUS = ("urgent", "voice", "plans")


def _memories(spark, sf):
    """Orders as a customer's memories, dressed with every kind of subject, object, depth and reading; each is retrieved twice."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))
    made = o.select(
        F.col("o_custkey").alias("owner"), k.alias("id"), F.round(F.col("o_totalprice") / 100000, 3).alias("total"), pick(k % 6, "it", "Ann", "her voice", "plans", "Bob Tone", "the road").alias("subject"),
        pick(k % 5, "be", "said", "like", "have", "visit").alias("predicate"), pick(k % 7, "a voice.", "", "_", "an old friend", "urgent plans of war", "town", "*").alias("object"), F.lit(None).cast("string").alias("topic"),
        F.col("o_orderpriority").alias("text"), F.when(k % 8 == 0, -1).otherwise(1).alias("polarity"), (k % 14 / 10.0).alias("salience"), F.when(k % 3 > 0, k % 9 / 10.0).alias("attention"), F.when(k % 4 > 0, k % 5 / 10.0).alias("emotional"),
        F.when(k % 10 > 0, k % 21 / 10.0).alias("confidence"), pick(k % 4, "GOAL", "belief", "rule", "EVENT").alias("kind"), F.when(k % 9 == 0, 100000 + k % 5).otherwise(k % 12).alias("depth"), (F.col("o_orderstatus") != "F").alias("committed"),
        (k % 13 == 0).alias("statement"),
    )
    return made.unionByName(made.withColumn("total", F.col("total") - 0.5))


@query("""WITH m AS (SELECT o_custkey AS owner, o_orderkey AS id, round(o_totalprice / 100000, 3) AS total, ['it', 'Ann', 'her voice', 'plans', 'Bob Tone', 'the road'][o_orderkey % 6 + 1] AS s, ['be', 'said', 'like', 'have', 'visit'][o_orderkey % 5 + 1] AS p, ['a voice.', '', '_', 'an old friend', 'urgent plans of war', 'town', '*'][o_orderkey % 7 + 1] AS o,
 (o_orderkey % 14) / 10.0::DOUBLE AS sal, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 9) / 10.0 ELSE 0 END::DOUBLE AS att, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 5) / 10.0 ELSE 0 END::DOUBLE AS emo, CASE WHEN o_orderkey % 10 > 0 THEN (o_orderkey % 21) / 10.0 ELSE 0.5 END::DOUBLE AS conf, o_orderkey % 4 AS kind,
 CASE WHEN o_orderkey % 9 = 0 THEN 1 + o_orderkey % 5 ELSE o_orderkey % 12 END AS steps, o_orderstatus = 'F' AS established FROM orders),
q AS (SELECT *, s = 'it' AS vague, len(list_filter(regexp_extract_all(lower(o), '[a-z0-9_''-]+'), lambda w: w NOT IN ('a', 'an', 'the', 'some'))) <= 1 AS bare FROM m WHERE NOT (p = 'said' AND o = 'a voice.'))
SELECT owner, id, round(total + 0.45 * least(1.0, greatest(sal, att, emo)) + 0.25 * least(1.0, conf) + CASE WHEN kind IN (0, 2) THEN 0.25 ELSE 0 END - least(0.9, 0.16 * ln(1 + steps)) - (CASE WHEN vague THEN 0.8 ELSE 0 END + CASE WHEN p IN ('be', 'have') AND (vague OR bare) THEN 0.5 ELSE 0 END
 + CASE WHEN o IN ('', '_', '*') THEN 1.0 ELSE 0 END + CASE WHEN s = 'Bob Tone' THEN 0.9 ELSE 0 END), 6) AS score, established FROM q""")
def recall_scores(spark, sf):
    """What memories compete with: the best retrieval of each, bonuses, distance in continuity and penalties of quality."""
    focus = F.array(*map(F.lit, _FOCUS))
    return R.compete(_memories(spark, sf), focus).select("owner", "id", F.round("score", 6).alias("score"), "established")


@query()
def recall_select(spark, sf):
    """Memories of a customer that compete for twelve places: an ordered fold, tested against brute force over the same rows."""
    return R.recall(R.compete(_memories(spark, sf), F.array(*map(F.lit, _FOCUS))).withColumn("score", F.round("score", 6)))


@query("""WITH RECURSIVE c AS (SELECT conv_id AS owner, turn AS id, CAST(greatest(1, ceil(length(text) / 4.0)) AS INT) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT owner, id, cost, k, cost <= 60 AS fits, cost > 60 AS ended, CASE WHEN cost <= 60 THEN cost ELSE 0 END AS used FROM c WHERE k = 1
UNION ALL SELECT c.owner, c.id, c.cost, c.k, NOT f.ended AND f.used + c.cost <= 60, f.ended, CASE WHEN NOT f.ended AND f.used + c.cost <= 60 THEN f.used + c.cost ELSE f.used END FROM f JOIN c ON c.owner = f.owner AND c.k = f.k + 1)
SELECT owner, id, cost, CAST(row_number() OVER (PARTITION BY owner ORDER BY k) - 1 AS INT) AS place, NOT fits AS excerpted FROM f WHERE fits OR (ended AND k = 1)""")
def budget_trim(spark, sf):
    """Turns of a conversation that fit 60 tokens, in order, skipping what doesn't; an excerpt of the first, if that doesn't."""
    c = table(spark, sf, "conversations")
    return R.trim(c.select(F.col("conv_id").alias("owner"), F.col("turn").alias("id"), F.col("turn").alias("ord"), "text"), 60)


_SEEN = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), qs AS (SELECT item_id AS q, item_id % 3 AS who FROM benchmark),
doc AS (SELECT doc_id AS id, doc_id // 3 AS document, doc_id % 4 = 0 AS public, lang || '.' || source AS path, lang AS domain FROM documents),
grants(who, path, allowed) AS (VALUES (0, 'en.src1', TRUE), (1, 'fr', TRUE), (1, 'fr.src3', FALSE), (2, 'de', FALSE), (2, 'es.src2', TRUE)), held(who, domain) AS (VALUES (0, 'de'), (2, 'en')),
acl AS (SELECT qs.who, d.document, bool_or(d.public) AS public, bool_or(coalesce(g.allowed, FALSE)) AS granted, bool_or(NOT coalesce(g.allowed, TRUE)) AS denied, bool_or(h.domain IS NOT NULL) AS domain
 FROM (SELECT DISTINCT who FROM qs) qs CROSS JOIN (SELECT document, path, domain, bool_or(public) AS public FROM doc GROUP BY ALL) d LEFT JOIN grants g ON g.who = qs.who AND (d.path = g.path OR starts_with(d.path, g.path || '.')) LEFT JOIN held h ON h.who = qs.who AND h.domain = d.domain GROUP BY ALL),
sims AS (SELECT q, doc_id AS id, round(list_dot_product(a.e, b.e) + 0.5, 6) AS similarity FROM qs JOIN v a ON a.vec_id = qs.q JOIN v b ON b.vec_id <> a.vec_id JOIN documents ON doc_id = b.vec_id),
near AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, id) AS semantic FROM sims WHERE similarity >= 0.58 QUALIFY semantic <= 96),
topics AS (SELECT q, doc_id AS id FROM qs JOIN documents ON doc_id % 50 = q % 50),
alls AS (SELECT q, id FROM lex UNION SELECT q, id FROM near UNION SELECT q, id FROM topics),
cand AS (SELECT alls.q, alls.id, doc.document, lex.score AS words, near.semantic, topics.id IS NOT NULL AS topic, acl.domain FROM alls JOIN qs ON qs.q = alls.q JOIN doc ON doc.id = alls.id JOIN acl ON acl.who = qs.who AND acl.document = doc.document LEFT JOIN lex ON lex.q = alls.q AND lex.id = alls.id
 LEFT JOIN near ON near.q = alls.q AND near.id = alls.id LEFT JOIN topics ON topics.q = alls.q AND topics.id = alls.id WHERE (acl.public OR acl.granted OR acl.domain) AND NOT acl.denied),
rk AS (SELECT *, CASE WHEN words > 0 THEN row_number() OVER (PARTITION BY q, words > 0 ORDER BY words DESC, id) END AS lexical FROM cand),
sc AS (SELECT *, round(coalesce(100.0 / (60 + lexical), 0) + coalesce(100.0 / (60 + semantic), 0) + CASE WHEN topic THEN 0.40 ELSE 0 END + CASE WHEN domain THEN 0.10 ELSE 0 END, 6)::DOUBLE AS score FROM rk),
dv AS (SELECT *, row_number() OVER (PARTITION BY q, document ORDER BY score DESC, id) > 1 AS later FROM sc)
"""


@query(_LEX.rstrip() + ",\n" + _SEEN + "SELECT q, id, document, score, lexical, semantic, topic, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY later, score DESC, id) AS place FROM dv) WHERE place <= 8")
def hybrid_search(spark, sf):
    """Documents, three of which are sections of one, found by words, vectors and topics, and seen by three askers with their own grants, denials and domains.
    The vector of a text's number stands for the text; similarities are raised by a half, so that some reach the floor."""
    d, b, e = table(spark, sf, "documents"), table(spark, sf, "benchmark"), table(spark, sf, "embeddings")
    queries = b.select(F.col("item_id").alias("q"), (F.col("item_id") % 3).cast("int").alias("who"))
    document = (F.col("doc_id") / 3).cast("long")
    sections = d.select(F.col("doc_id").alias("id"), document.alias("document"))
    near = X.top_k(e.join(queries, F.col("vec_id") == F.col("q"), "left_semi"), e.join(d, F.col("vec_id") == F.col("doc_id"), "left_semi"), 200, 0.08 - 1e-6)
    near = near.select("q", "id", F.round(F.col("similarity") + 0.5, 6).alias("similarity"))
    topics = queries.select("q", (F.col("q") % 50).alias("m")).join(d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("m")), "m").select("q", "id")
    access = R.Access(
        d.groupBy(document.alias("document")).agg(F.max(F.col("doc_id") % 4 == 0).alias("public")), d.select(document.alias("document"), F.concat_ws(".", "lang", "source").alias("path")), d.select(document.alias("document"), F.col("lang").alias("domain")),
        spark.createDataFrame([(0, "en.src1", True), (1, "fr", True), (1, "fr.src3", False), (2, "de", False), (2, "es.src2", True)], "who int, path string, allowed boolean"),
        spark.createDataFrame([(0, "de"), (2, "en")], "who int, domain string"),
    )
    return R.hybrid(queries, sections, _lexical(spark, sf), near, topics, access).withColumn("lexical", F.col("lexical").cast("long")).withColumn("semantic", F.col("semantic").cast("long")).withColumn("place", F.col("place").cast("long"))


@query("""WITH d AS (SELECT c_custkey AS q, ['preference', 'experience', 'history'][c_custkey % 3 + 1] AS kind, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE lower(c_mktsegment) END AS topic, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'ann' END AS who FROM customer WHERE c_custkey % 2 = 0),
i AS (SELECT o_custkey AS q, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'ann' ELSE 'bob' END AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'like' ELSE 'see' END AS p, ['building', 'machinery', 'tea'][o_orderkey % 3 + 1] AS o, CASE WHEN o_orderkey % 4 = 0 THEN 'event' ELSE 'BELIEF' END AS kind FROM orders),
j AS (SELECT d.q, i.id, i.id IS NOT NULL AND (topic IS NULL OR topic = i.o) AS related, i.id IS NOT NULL AND (topic IS NULL OR topic = i.o) AND CASE WHEN d.kind = 'preference' THEN (who IS NULL OR who = s) AND p = 'like' ELSE i.kind = 'event' END AS shown FROM d LEFT JOIN i USING (q))
SELECT q, CASE WHEN bool_or(shown) THEN 'established' WHEN bool_or(related) THEN 'partial' ELSE 'unestablished' END AS status, coalesce(array_to_string(list_sort(CASE WHEN bool_or(shown) THEN list(id) FILTER (shown) ELSE list(id) FILTER (related) END)[1:8], ','), '') AS supporting FROM j GROUP BY q""")
def evidence_sufficiency(spark, sf):
    """Whether a customer's orders, dressed as memories, establish what is asked of the customer."""
    c, o = table(spark, sf, "customer").filter("c_custkey % 2 = 0"), table(spark, sf, "orders")
    k, n = F.col("o_orderkey"), F.col("c_custkey")
    pick = lambda m, *v: F.element_at(F.array(*map(F.lit, v)), (m + 1).cast("int"))
    topics = F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("c_mktsegment")))
    demands = c.select(n.alias("q"), F.lit("character").alias("route"), pick(n % 3, "preference", "experience", "history").alias("kind"), topics.alias("topics"), F.when(n % 5 > 0, "Ann").alias("subject"))
    items = o.select(
        F.col("o_custkey").alias("q"), k.alias("id"), F.when(k % 3 == 0, "ann").otherwise("bob").alias("subject"), F.when(k % 2 == 0, "like").otherwise("see").alias("predicate"), pick(k % 3, "building", "machinery", "tea").alias("object"),
        F.lit(None).cast("string").alias("topic"), F.lit(None).cast("string").alias("text"), F.when(k % 4 == 0, "event").otherwise("BELIEF").alias("kind"),
    )
    return R.evidence_status(demands, items).select("q", "status", F.array_join("supporting", ",").alias("supporting"))


@query(r"""WITH w AS (SELECT doc_id, list_distinct([]) AS x, regexp_extract_all(lower(lang || ' ' || source || '_x'), '[a-z0-9_''-]+') AS a, regexp_extract_all(lower(text), '[a-z0-9_''-]+') AS b FROM documents),
u AS (SELECT doc_id, unnest(list_concat(a, b)) AS t, generate_subscripts(list_concat(a, b), 1) AS k FROM w), f AS (SELECT doc_id, t, min(k) AS k FROM u WHERE length(t) >= 3 GROUP BY ALL),
e AS (SELECT doc_id, list(t ORDER BY k) AS every FROM f GROUP BY doc_id), p AS (SELECT doc_id, every, list_filter(every, lambda x: contains(x, '_')) AS p0 FROM e),
r AS (SELECT p.doc_id, every, list_concat(p0, list_filter(every, lambda x: NOT contains(x, '_') AND list_contains(list_concat(p0, []), x) = FALSE AND list_position(list_filter(every, lambda y: NOT contains(y, '_')), x) <= 5)) AS first FROM p),
s AS (SELECT doc_id, every, first, list_filter(every, lambda x: NOT list_contains(first, x)) AS plain, 12 - least(12, len(first)) AS room FROM r)
SELECT doc_id, array_to_string(CASE WHEN len(every) <= 12 THEN every WHEN room <= 0 THEN first[1:12] WHEN len(plain) <= room THEN list_concat(first, plain)[1:12] ELSE list_concat(first, list_transform(range(0, room), lambda k: plain[least(floor(k * (len(plain) / room::DOUBLE))::INT, len(plain) - 1) + 1]))[1:12] END, ' ') AS terms FROM s""")
def focus_terms(spark, sf):
    """Twelve words of a document that stand for it: names, the first five words, and some spread over the rest."""
    d = table(spark, sf, "documents")
    terms = R.focus_terms(F.concat_ws(" ", "lang", F.concat("source", F.lit("_x"))), F.col("text"))
    return d.select("doc_id", F.array_join(terms, " ").alias("terms")).filter("terms != ''")


@query("""WITH h AS (SELECT user_id AS q, event_id % 40 AS id, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS stage, max(value) AS score FROM events GROUP BY ALL),
f AS (SELECT q, id, min(stage) AS stage FROM h GROUP BY ALL), n AS (SELECT q, stage, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY q ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT f.q, f.id, f.stage, h.score FROM f JOIN b USING (q, stage) JOIN h ON h.q = f.q AND h.id = f.id AND h.stage = f.stage WHERE before < 12""")
def staged_widening(spark, sf):
    """Hits of the first stages that give a user twelve."""
    e = table(spark, sf, "events")
    stage = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", 2).otherwise(3)
    hits = e.groupBy(F.col("user_id").alias("q"), (F.col("event_id") % 40).alias("id"), stage.alias("stage")).agg(F.max("value").alias("score"))
    return R.widen(hits, 12)


@query()
def query_passages(spark, sf):
    """Densest passage of each query's best document."""
    best = _lexical(spark, sf).filter("rank = 1").select("q", "id")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), T.research_terms(F.col("text")).alias("terms"))
    return best.join(d, "id").join(terms, "q").select("q", "id", R.passage(F.col("text"), F.col("terms")).alias("p")).select("q", "id", "p.start", F.sha2("p.passage", 256).alias("digest"))


@query("""WITH p AS (SELECT c_custkey AS id, c_name, c_mktsegment, count(o_orderkey) AS n, count(DISTINCT o_orderpriority) AS kinds, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS conflicts FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_name ILIKE '%7%' OR c_mktsegment ILIKE '%build%' GROUP BY ALL) SELECT id, n, kinds, conflicts FROM p""")
def epistemic_search(spark, sf):
    """Rows of which any field has a string, with counts and conflicts in one left join."""
    c = table(spark, sf, "customer").filter(F.col("c_name").ilike("%7%") | F.col("c_mktsegment").ilike("%build%")).select("c_custkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("id")).agg(F.count("o_orderkey").alias("n"), F.count_distinct("o_orderpriority").alias("kinds"), F.sum(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("conflicts"))
