"""Evidence queries. Binding: an event is a point of evidence on (user, k mod 5); errors and views are against, all else for; the weight is value / 500,
the order the time, and events of one type and day are one piece of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as T
from ..operators import evidence as O
from .registry import query, table


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").alias("user"), (k % 5).alias("slot"), F.when(F.col("event_type").isin("error", "view"), -1).otherwise(1).alias("polarity"), E.clamp(F.col("value") / 500, 0.0, 0.999999).alias("weight"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ord"), F.concat_ws(":", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("correlation_key"), "event_id", "event_type",
    )


_POINTS = """WITH points AS (
  SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS INT) % 5 AS slot, CASE WHEN event_type IN ('error', 'view') THEN -1 ELSE 1 END AS polarity,
    greatest(0.0, least(0.999999, value / 500)) AS weight, epoch_us(ts) AS ord, event_type || ':' || strftime(ts, '%Y-%m-%d') AS correlation_key, event_id, event_type FROM events),
rows AS (SELECT "user", slot, polarity, correlation_key, max(weight) AS weight, max(ord) AS ord FROM points GROUP BY ALL),
"""
_NOISY = _POINTS + """noisy AS (
  SELECT "user", slot, round(coalesce(1 - exp(sum(ln(1 - weight)) FILTER (polarity > 0)), 0), 6) AS pos, round(coalesce(1 - exp(sum(ln(1 - weight)) FILTER (polarity < 0)), 0), 6) AS neg, count(*) AS n FROM rows GROUP BY ALL),
"""
_STANCE = """SELECT "user", slot, pos, neg, n, CASE WHEN pos >= {a} AND pos - neg >= {m} THEN 'positive' WHEN neg >= {a} AND neg - pos >= {m} THEN 'negative' ELSE 'unresolved' END AS stance, round(abs(pos - neg), 6) AS confidence FROM made"""


@query(_NOISY + "made AS (SELECT * FROM noisy) " + _STANCE.format(a=0.6, m=0.15))
def belief_accumulate(spark, sf):
    """Noisy-or of independent evidence per atom."""
    return O.belief(points(spark, sf), ["user", "slot"])


@query(_POINTS + """f AS (SELECT "user", slot, arg_min(struct_pack(p := polarity, w := weight), struct_pack(o := -ord, w := -weight, c := correlation_key, p := polarity)) AS f FROM rows GROUP BY ALL),
made AS (SELECT "user", slot, round(CASE WHEN f.p > 0 THEN f.w ELSE 0 END, 6) AS pos, round(CASE WHEN f.p < 0 THEN f.w ELSE 0 END, 6) AS neg, CAST(1 AS BIGINT) AS n FROM f) """ + _STANCE.format(a=0.5, m=0.05))
def belief_latest(spark, sf):
    """The newest point decides."""
    return O.belief(points(spark, sf), ["user", "slot"], "latest", 0.5, 0.05)


@query(_POINTS + """made AS (SELECT "user", slot, round(coalesce(max(weight) FILTER (polarity > 0), 0), 6) AS pos, round(coalesce(max(weight) FILTER (polarity < 0), 0), 6) AS neg, count(*) AS n FROM rows GROUP BY ALL) """ + _STANCE.format(a=0.7, m=0.15))
def belief_max(spark, sf):
    """The strongest point of each side decides."""
    return O.belief(points(spark, sf), ["user", "slot"], "max", 0.7, 0.15)


_FAMILY = "CASE event_type WHEN 'click' THEN 'ACTION' WHEN 'error' THEN 'RULE' WHEN 'purchase' THEN 'SPATIAL' WHEN 'signup' THEN 'GOAL' ELSE NULL END"


@query(_POINTS.replace("event_id, event_type FROM events", "event_id, event_type, " + _FAMILY + " AS family FROM events").replace('"user", slot, polarity, correlation_key, max', '"user", slot, family, polarity, correlation_key, max') + """
g AS (SELECT "user", slot, family, count(*) AS c, arg_max(CASE WHEN polarity > 0 THEN weight ELSE -weight END, struct_pack(o := ord, w := weight)) AS newest, coalesce(max(weight) FILTER (polarity > 0), 0) AS u, coalesce(max(weight) FILTER (polarity < 0), 0) AS d,
 1 - coalesce(product(1 - weight) FILTER (polarity > 0), 1) AS su, 1 - coalesce(product(1 - weight) FILTER (polarity < 0), 1) AS sd FROM rows GROUP BY ALL),
m AS (SELECT *, CASE WHEN family IN ('SPATIAL', 'GOAL') THEN 'latest' WHEN family = 'RULE' THEN 'max' ELSE 'accumulate' END AS mode FROM g),
v AS (SELECT *, round(CASE mode WHEN 'latest' THEN greatest(newest, 0) WHEN 'max' THEN u ELSE su END, 6) AS pos, round(CASE mode WHEN 'latest' THEN greatest(-newest, 0) WHEN 'max' THEN d ELSE sd END, 6) AS neg,
 CASE mode WHEN 'latest' THEN 0.5 WHEN 'max' THEN 0.7 ELSE 0.6 END AS a, CASE mode WHEN 'latest' THEN 0.05 ELSE 0.15 END AS least FROM m)
SELECT "user", slot, family, mode, pos::DOUBLE AS pos, neg::DOUBLE AS neg, CASE mode WHEN 'latest' THEN 1 ELSE c END::BIGINT AS n, CASE WHEN pos >= a AND pos - neg >= least THEN 'positive' WHEN neg >= a AND neg - pos >= least THEN 'negative' ELSE 'unresolved' END AS stance, coalesce(family = 'SPATIAL', FALSE) AS exclusive FROM v""")
def belief_by_family(spark, sf):
    """Belief with the policy of each predicate family; types of events stand in for families."""
    p = points(spark, sf)
    names = {"click": "ACTION", "error": "RULE", "purchase": "SPATIAL", "signup": "GOAL"}
    family = F.lit(None).cast("string")
    for kind, name in names.items():
        family = F.when(F.col("event_type") == kind, name).otherwise(family)
    return O.belief_by_family(p.withColumn("family", family), ["user", "slot"]).select("user", "slot", "family", "mode", "pos", "neg", "n", "stance", "exclusive")


@query(_NOISY + "made AS (SELECT * FROM noisy), b AS (" + _STANCE.format(a=0.6, m=0.15) + """), t AS (SELECT "user", slot, max(ord) AS newest FROM points GROUP BY ALL),
w AS (SELECT b.*, row_number() OVER (PARTITION BY "user" ORDER BY newest DESC, slot) = 1 AS winner FROM b JOIN t USING ("user", slot))
SELECT "user", slot AS atom, CASE WHEN winner THEN pos ELSE 0.0 END AS pos, CASE WHEN winner THEN neg ELSE 0.0 END AS neg, CASE WHEN winner THEN stance ELSE 'unresolved' END AS stance, CASE WHEN winner THEN confidence ELSE 0.0 END AS confidence, winner FROM w""")
def exclusive_slot_winner(spark, sf):
    """Slots of a user exclude each other: the newest stays."""
    p = points(spark, sf)
    newest = p.groupBy("user", "slot").agg(F.max("ord").alias("newest"))
    b = O.belief(p, ["user", "slot"]).join(newest, ["user", "slot"]).withColumnRenamed("slot", "atom")
    return O.exclusive_slot(b, ["user"], F.col("newest")).select("user", "atom", "pos", "neg", "stance", "confidence", "winner")


@query(_NOISY + "made AS (SELECT * FROM noisy), b AS (" + _STANCE.format(a=0.6, m=0.15) + """)
SELECT slot, count(DISTINCT CASE WHEN stance = 'positive' AND confidence >= 0.65 THEN "user" END) AS supporters, count(DISTINCT CASE WHEN stance = 'negative' THEN "user" END) AS dissenters,
  CASE WHEN count(DISTINCT CASE WHEN stance = 'negative' THEN "user" END) > 0 THEN 'contested' WHEN count(DISTINCT CASE WHEN stance = 'positive' AND confidence >= 0.65 THEN "user" END) >= 2 THEN 'eligible' ELSE 'open' END AS status FROM b GROUP BY slot""")
def consensus_candidates(spark, sf):
    """Supporters and dissenters of each slot over all users."""
    return O.consensus(O.belief(points(spark, sf), ["user", "slot"]), "slot", "user")


@query(_POINTS + """v AS (SELECT slot AS topic, polarity AS variant, event_type AS source, count(*) AS n FROM points GROUP BY ALL)
SELECT topic, variant, source, n, round(n / sum(n) OVER (PARTITION BY topic, source), 6) AS affinity FROM v""")
def narrative_affinity(spark, sf):
    """How a topic's variants share its sources."""
    return O.narratives(points(spark, sf).select(F.col("slot").alias("topic"), F.col("polarity").alias("variant"), F.col("event_type").alias("source")))


_CLAIMS = r"""WITH raw AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN ' Cust ' || o_custkey || '. ' END AS s0, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'Located_At' WHEN o_orderstatus = 'F' THEN 'likes' ELSE 'Status' END AS p0,
 '  It ' || CASE WHEN o_orderkey % 3 = 0 THEN 'is Not ' ELSE 'is ' END || o_orderpriority || '!' AS t0, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderpriority END AS o0, o_orderdate FROM orders),
c AS (SELECT id, trim(regexp_replace(lower(s0), '\s+', ' ', 'g'), ' .,:;!?') AS s, trim(lower(p0), ' .,:;!?') AS p, trim(lower(o0), ' .,:;!?') AS o, trim(regexp_replace(lower(t0), '\s+', ' ', 'g'), ' .,:;!?') AS t, t0, o_orderdate FROM raw),
l AS (SELECT *, CASE WHEN contains(' ' || t || ' ', ' not ') THEN -1 ELSE 1 END AS polarity FROM c),
n AS (SELECT *, CASE WHEN s IS NULL AND p IS NULL AND o IS NULL THEN t ELSE CASE WHEN polarity < 0 THEN 'NOT ' ELSE '' END || coalesce(s, '_') || ' | ' || coalesce(p, '_') || ' | ' || coalesce(o, '_') END AS said FROM l),
k AS (SELECT *, sha256(coalesce(s, '') || chr(31) || coalesce(p, '') || chr(31) || coalesce(o, '') || chr(31) || polarity || chr(31) || said) AS proposition,
 sha256(CASE WHEN s IS NULL AND p IS NULL THEN said ELSE coalesce(s, '') || chr(31) || coalesce(p, '') END) AS topic, CASE WHEN s IS NULL AND p IS NULL AND o IS NULL THEN 'raw:' || t0 ELSE coalesce(s, '') || chr(31) || coalesce(p, '') || chr(31) || coalesce(o, '') END AS atom FROM n)
""".replace("\\\\", "\\")


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as claims: the customer is, by status, at, fond of or in a state of the order's priority; every third order denies it, every seventh has no
    object, every eleventh no component at all."""
    o = table(spark, sf, "orders")
    known, key = F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")
    s = T.normal(F.when(known, F.concat(F.lit(" Cust "), F.col("o_custkey").cast("string"), F.lit(". "))))
    p = T.normal(F.when(known, F.when(F.col("o_orderstatus") == "O", "Located_At").when(F.col("o_orderstatus") == "F", "likes").otherwise("Status")))
    told = F.concat(F.lit("  It "), F.when(key % 3 == 0, "is Not ").otherwise("is "), F.col("o_orderpriority"), F.lit("!"))
    c = o.select(key.alias("id"), s.alias("s"), p.alias("p"), T.normal(F.when(known & (key % 7 != 0), F.col("o_orderpriority"))).alias("o"), T.polarity(told).alias("polarity"), "o_orderdate", told.alias("told"))
    args, pol, said = [F.col(x) for x in ("s", "p", "o")], F.col("polarity"), F.col("told")
    return c.select("*", T.proposition_hash(*args, pol, said).alias("proposition"), T.topic_key(*args, pol, said).alias("topic"), T.atom_key(*args, said).alias("atom"))


@query(_CLAIMS + "SELECT id, s, p, o, polarity, proposition, topic, atom FROM k")
def proposition_normalize(spark, sf):
    """Components, polarity and identities of claims."""
    return claims(spark, sf).select("id", "s", "p", "o", "polarity", "proposition", "topic", "atom")


@query(_CLAIMS + """, g AS (SELECT topic, p, o, polarity, min(id) AS id FROM k GROUP BY ALL)
SELECT a.id AS a, b.id AS b, CASE WHEN a.polarity <> b.polarity THEN 'polarity' ELSE 'exclusive' END AS kind, CASE WHEN a.polarity <> b.polarity THEN 1.0 ELSE 0.85 END::DOUBLE AS weight
FROM g a JOIN g b ON a.topic = b.topic AND a.id < b.id WHERE a.polarity <> b.polarity OR (a.p IN ('located_at', 'status') AND a.o IS NOT NULL AND b.o IS NOT NULL AND a.o <> b.o)""")
def conflict_pairs(spark, sf):
    """Propositions of one topic that contradict each other."""
    return O.conflicts(claims(spark, sf).select("id", "topic", F.col("p").alias("predicate"), F.col("o").alias("object"), "polarity"))


@query(_CLAIMS + """, g AS (SELECT topic, p, o, polarity, min(id) AS id FROM k GROUP BY ALL),
r AS (SELECT a.id AS a, b.id AS b, 'polarity' AS kind, 1.0 AS weight FROM g a JOIN g b ON a.topic = b.topic AND a.o = b.o AND a.polarity <> b.polarity
UNION ALL SELECT a.id, b.id, 'topic', 0.5 FROM g a JOIN g b ON a.topic = b.topic AND a.id <> b.id)
SELECT least(a, b) AS lo, greatest(a, b) AS hi, arg_max(kind, weight) AS kind, max(weight)::DOUBLE AS weight FROM r GROUP BY ALL""")
def verified_conflicts(spark, sf):
    """One row per unordered pair of a topic, the strongest relation."""
    g = claims(spark, sf).groupBy("topic", "p", "o", "polarity").agg(F.min("id").alias("id"))
    a, b = g.alias("a"), g.alias("b")
    pairs = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.id") != F.col("b.id")))
    opposite = (F.col("a.o") == F.col("b.o")) & (F.col("a.polarity") != F.col("b.polarity"))
    rows = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.when(opposite, "polarity").otherwise("topic").alias("kind"), F.when(opposite, 1.0).otherwise(0.5).alias("weight"))
    return O.strongest_per_pair(rows)


@query(_CLAIMS + "SELECT id, CASE WHEN row_number() OVER (PARTITION BY proposition, s ORDER BY o_orderdate, id) = 1 THEN 'novel_exact' ELSE 'reinforces_exact' END AS decision FROM k")
def exact_admission(spark, sf):
    """The first of equal claims is novel, later ones reinforce it."""
    return O.exact_admission(claims(spark, sf), ["s"], F.col("o_orderdate"), F.col("id")).select("id", "decision")


@query(_CLAIMS + "SELECT atom, min(id) AS kept, count(*) - 1 AS quarantined FROM k GROUP BY atom")
def retention_duplicates(spark, sf):
    """The earliest claim of an atom stays, the others are quarantined."""
    return claims(spark, sf).groupBy("atom").agg(F.min("id").alias("kept"), (F.count("*") - 1).alias("quarantined"))


@query("""WITH e AS (SELECT event_id, value / 500 AS c, (CAST(json_extract_string(props, '$.k') AS INT) % 10) / 10.0::DOUBLE AS t, CASE event_type WHEN 'click' THEN 0.1 WHEN 'view' THEN -0.2 ELSE 0.0 END AS b FROM events),
w AS (SELECT event_id, c, greatest(0.05, least(1.5, greatest(0.05, least(1.5, 0.45 + 0.35 * (c * 4 - 1) + 0.20 * t)) + b)) AS attention, greatest(0.05, least(1.5, 0.35 + 0.35 * c + 0.20 * t + 0.20 * 0.5 - 0.25 * t)) AS trust,
 greatest(0.05, least(1.5, 0.75 + 0.125 - 0.15 * t)) AS compatibility, 0.4 + 0.6 * c AS retention, 0.6 + 0.25 * t + 0.075 AS salience FROM e)
SELECT event_id, round(attention, 6) AS attention, round(trust, 6) AS trust, round(greatest(0, least(1, c * pow(attention * trust * compatibility * retention * salience, 0.2))), 6) AS effective FROM w""")
def epistemic_weights(spark, sf):
    """Six weights of an acquisition from a witness's traits; some are far out, so that bounds hold before and after what the mode adds."""
    c, t = F.col("value") / 500, (F.get_json_object("props", "$.k").cast("int") % 10) / 10.0
    mode = F.when(F.col("event_type") == "click", "conversation").when(F.col("event_type") == "view", "skim_document").otherwise("other")
    w = E.epistemic_weights(mode, c, curiosity=c * 4 - 1, topic_interest=t, source=c, authority=t, expertise=F.lit(None).cast("double"), skepticism=t, retention=c, reactivity=t, novelty=F.lit(0.5))
    return table(spark, sf, "events").select("event_id", w.alias("w")).select("event_id", F.round("w.attention", 6).alias("attention"), F.round("w.trust", 6).alias("trust"), F.round("w.effective", 6).alias("effective"))


@query(r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN '' ELSE text END AS text, role, CASE turn % 6 WHEN 0 THEN 'k' || turn WHEN 5 THEN '' END AS stated, CASE WHEN turn % 6 = 1 THEN 't' || turn END AS template, CASE WHEN turn % 6 = 2 THEN turn::VARCHAR ELSE '' END AS place,
 CASE WHEN turn % 6 = 3 THEN 'e' || turn END AS event, CASE WHEN turn % 2 = 0 THEN 'log' ELSE '' END AS kind, CASE WHEN conv_id % 3 > 0 THEN 'src' ELSE '' END AS source FROM conversations),
d AS (SELECT *, md5(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) AS digest, coalesce(nullif(kind, ''), nullif(source, ''), 'unknown') AS origin FROM t)
SELECT conv_id, turn, CASE WHEN nullif(stated, '') IS NOT NULL THEN 'explicit:' || stated WHEN nullif(template, '') IS NOT NULL THEN 'template:' || origin || ':c' || conv_id || ':' || template || ':' || digest
 WHEN nullif(place, '') IS NOT NULL AND text <> '' THEN 'slot:' || origin || ':c' || conv_id || ':' || role || ':' || place || ':' || digest WHEN nullif(event, '') IS NOT NULL AND text <> '' THEN 'source-event:' || origin || ':c' || conv_id || ':' || role || ':' || event || ':' || digest
 ELSE 'occurrence:unknown:' || conv_id || '-' || turn END AS correlation_key FROM d""".replace("\\\\", "\\"))
def correlation_keys(spark, sf):
    """The first key that makes two observations one; turns are dressed to have each, and empty strings for what they lack."""
    t, c = F.col("turn"), F.col("conv_id").cast("string")
    named = lambda k, prefix, none=None: F.when(t % 6 == k, F.concat(F.lit(prefix), t.cast("string"))).otherwise(F.lit(none).cast("string"))
    text = F.when(t % 7 == 6, "").otherwise(F.col("text"))
    key = E.correlation_key(
        F.when(t % 6 == 5, "").otherwise(named(0, "k")), named(1, "t"), named(2, "", ""), text, named(3, "e"), F.when(F.col("conv_id") % 3 > 0, "src").otherwise(""), F.when(t % 2 == 0, "log").otherwise(""),
        F.concat(F.lit("c"), c), F.col("role"), F.lit(""), F.concat_ws("-", c, t.cast("string")),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", key.alias("correlation_key"))


@query("""WITH t AS (SELECT conv_id, turn, role, turn % 9 AS k, turn % 5 AS m FROM conversations),
o AS (SELECT *, CASE WHEN k = 0 THEN 'testimony' WHEN k = 1 THEN 'corpus_source' WHEN k = 2 THEN 'testimony' WHEN k = 3 THEN 'deterministic_tool' WHEN k = 4 THEN 'character_generation' WHEN role = 'user' THEN 'user_testimony' WHEN role = 'assistant' THEN 'model_generation' WHEN k = 5 THEN 'model_inference' ELSE 'unknown' END AS origin FROM t)
SELECT conv_id, turn, origin, CASE WHEN k = 8 THEN 'stated' WHEN m = 0 THEN 'hypothesis' WHEN m = 1 THEN 'question' WHEN m = 2 THEN 'memory' WHEN m = 3 THEN 'self_description' WHEN origin IN ('model_generation', 'model_inference') THEN 'inference' WHEN origin IN ('user_testimony', 'testimony') THEN 'testimony' ELSE 'observation' END AS mode,
 CASE WHEN origin = 'deterministic_tool' THEN 'canonical' WHEN origin IN ('user_testimony', 'testimony', 'corpus_source') THEN 'attested' ELSE 'candidate' END AS level,
 CASE WHEN origin = 'deterministic_tool' THEN 4 WHEN origin IN ('user_testimony', 'testimony', 'corpus_source') THEN 2 WHEN origin = 'unknown' THEN 1 ELSE 0 END AS rank,
 'belief,reflection' || CASE WHEN origin IN ('deterministic_tool', 'user_testimony', 'testimony', 'corpus_source') THEN ',planning' ELSE '' END || CASE WHEN origin = 'deterministic_tool' THEN ',action_precondition' ELSE '' END AS uses FROM o""")
def authority_classes(spark, sf):
    """Origin, mode, authority and uses of each turn, dressed as learnt in all ways there are."""
    k, m, none = F.col("turn") % 9, F.col("turn") % 5, F.lit(None).cast("string")
    pick = lambda c, found, other=none: F.coalesce(*[F.when(c == n, v) for n, v in found.items()], other)
    a = E.authority(
        pick(k, {0: "testimony"}, F.lit("")), pick(k, {1: "Read_Document", 2: "taught"}), pick(k, {3: "Sensor", 4: "sillytavern_chat"}), pick(k, {3: "user", 4: "Character"}, F.col("role")),
        pick(k, {5: "context-resolver-v9"}), pick(k, {8: "stated"}), pick(m, {0: "Conditional", 1: "a question of fact"}, F.lit("asserted")), pick(m, {2: "memory", 3: "TRAIT"}, F.lit("EVENT")),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", a.alias("a")).select("conv_id", "turn", "a.origin", "a.mode", "a.level", "a.rank", F.array_join("a.uses", ",").alias("uses"))


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN 'suppressed' WHEN toxic = 1 OR quality = 0 OR n_chars / 20000.0 < 0.0275 THEN 'unresolved' ELSE 'active' END AS admission, round(greatest(0.0, least(1.0, least(n_chars / 1000.0, 0.9))), 6)::DOUBLE AS confidence FROM documents JOIN labels USING (doc_id)""")
def evidence_admission(spark, sf):
    """Gates in order: no content, negative scope, unresolved, weak frame."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    frame = F.col("n_chars") / 20000.0 * 20
    state = E.admission(F.when(F.col("n_chars") > 0, "p"), F.col("toxic") == 1, F.col("quality") == 1, F.lit(1.0), frame)
    return d.select("doc_id", state.alias("admission"), F.round(E.admission_confidence(F.col("n_chars") / 1000.0, F.lit(0.9)), 6).alias("confidence"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'rejected' WHEN quality = 0 THEN 'contested' WHEN toxic = 1 THEN 'absorbed' WHEN n_chars > 3000 THEN 'historical' ELSE 'liminal' END AS state FROM documents JOIN labels USING (doc_id)""")
def evidence_lifecycle(spark, sf):
    """State of evidence by precedence."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    t, q = F.col("toxic") == 1, F.col("quality") == 0
    flags = {"rejected": t & q, "resolved": F.lit(False), "contested": q, "promoted": F.lit(False), "absorbed": t, "historical": F.col("n_chars") > 3000}
    return O.lifecycle(d.select("doc_id", *[c.alias(k) for k, c in flags.items()])).select("doc_id", "state")


@query(_POINTS + """v AS (SELECT slot AS key, event_type AS candidate, polarity * 2 + correlation_key[-1]::INT % 3 AS axis, round(sum(weight), 6) AS value FROM points GROUP BY ALL),
s AS (SELECT key, candidate, sum(value) AS score FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, candidate) AS rn FROM s),
w AS (SELECT a.key, a.candidate AS winner, a.score, coalesce(b.score, 0) AS second FROM r a LEFT JOIN r b ON b.key = a.key AND b.rn = 2 WHERE a.rn = 1),
x AS (SELECT DISTINCT key, axis FROM v),
l AS (SELECT x.key, x.axis, arg_min(s.candidate, struct_pack(a := coalesce(v.value, 0) - s.score, c := s.candidate)) AS c FROM x JOIN s USING (key) LEFT JOIN v ON v.key = s.key AND v.candidate = s.candidate AND v.axis = x.axis GROUP BY ALL),
st AS (SELECT l.key, round(avg(CASE WHEN l.c = w.winner THEN 1.0 ELSE 0 END), 6) AS stability FROM l JOIN w USING (key) GROUP BY ALL),
p AS (SELECT DISTINCT key FROM v UNION ALL SELECT 99)
SELECT p.key, winner, round(coalesce(score, 0), 3) AS score, round(coalesce(score - second, 0), 3) AS margin, coalesce(stability, 0) AS stability,
 CASE WHEN winner IS NULL THEN 'insufficient_evidence' WHEN p.key % 2 = 0 THEN CASE WHEN winner = 'click' THEN 'verified' ELSE 'protected_explicit' END WHEN winner <> 'click' THEN 'challenged' WHEN score < 4 OR score - second < 3 OR stability < 0.75 THEN 'fragile' ELSE 'verified' END AS status FROM p LEFT JOIN w ON w.key = p.key LEFT JOIN st ON st.key = p.key""")
def relation_matrix(spark, sf):
    """Votes of axes for event types per slot; the proposal is always click, protected for even slots, and one slot has no votes."""
    p = points(spark, sf)
    axis = F.col("polarity") * 2 + F.substring("correlation_key", -1, 1).cast("int") % 3
    votes = p.groupBy(F.col("slot").alias("key"), F.col("event_type").alias("candidate"), axis.alias("axis")).agg(F.round(F.sum("weight"), 6).alias("value"))
    keys = p.select(F.col("slot").alias("key")).distinct().unionByName(spark.range(1).select(F.lit(99).alias("key")))
    out = O.matrix_verdict(votes, "key", keys.withColumn("proposal", F.lit("click")).withColumn("protected", F.col("key") % 2 == 0))
    return out.select("key", "winner", F.round("score", 3).alias("score"), F.round("margin", 3).alias("margin"), "stability", "status")


@query("""WITH n AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) SELECT conv_id, turn, prev FROM n WHERE prev IS NOT NULL""")
def dag_edges(spark, sf):
    """Predecessor of each turn in its timeline."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("prev")).filter("prev is not null")


@query("""WITH d AS (SELECT user_id AS owner, strftime(ts, '%Y-%m-%d') AS episode, count(*) AS events FROM events GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY owner ORDER BY episode) AS ordinal FROM d""")
def episode_ordinals(spark, sf):
    """Days of a user as numbered episodes."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("owner"), F.date_format("ts", "yyyy-MM-dd").alias("episode")).agg(F.count("*").alias("events"))
    return e.withColumn("ordinal", F.row_number().over(Window.partitionBy("owner").orderBy("episode")).cast("long"))


@query(_POINTS + """m AS (SELECT "user", slot, event_type AS facet, count(*) AS members, count(DISTINCT polarity) AS sides, round(max(weight), 6) AS top FROM points GROUP BY ALL)
SELECT "user", facet, count(*) AS slots, sum(members)::BIGINT AS members, count(*) FILTER (sides > 1) AS contested, CAST(to_json(list(struct_pack(slot := slot, members := members) ORDER BY slot)) AS VARCHAR) AS nested, max(top) AS top FROM m GROUP BY ALL""")
def facet_rollup(spark, sf):
    """Members grouped into typed slots, nested as JSON and counted."""
    m = points(spark, sf).groupBy("user", "slot", F.col("event_type").alias("facet")).agg(F.count("*").alias("members"), F.count_distinct("polarity").alias("sides"), F.round(F.max("weight"), 6).alias("top"))
    nested = F.to_json(F.sort_array(F.collect_list(F.struct("slot", "members"))))
    return m.groupBy("user", "facet").agg(F.count("*").alias("slots"), F.sum("members").alias("members"), F.count_if(F.col("sides") > 1).alias("contested"), nested.alias("nested"), F.max("top").alias("top"))


@query(_NOISY + "made AS (SELECT * FROM noisy), b AS (" + _STANCE.format(a=0.6, m=0.15) + """), w AS (SELECT slot, list_distinct(list(CASE WHEN pos - neg > 0 THEN 1 ELSE -1 END)) AS sides FROM b WHERE "user" % 10 = 0 GROUP BY slot)
SELECT "user", b.slot, CASE WHEN w.sides IS NULL THEN 'unverified' WHEN list_contains(w.sides, CASE WHEN pos - neg > 0 THEN 1 ELSE -1 END) AND len(w.sides) = 1 THEN 'corroborated' ELSE 'contradicted' END AS verdict FROM b LEFT JOIN w USING (slot) WHERE "user" % 10 <> 0""")
def world_comparison(spark, sf):
    """Each witness against what a tenth of the users, taken as the world, hold."""
    b = O.belief(points(spark, sf), ["user", "slot"]).withColumn("side", F.when(F.col("pos") - F.col("neg") > 0, 1).otherwise(-1))
    world = b.filter("user % 10 = 0").groupBy("slot").agg(F.collect_set("side").alias("sides"))
    told = b.filter("user % 10 != 0").join(world, "slot", "left")
    verdict = F.when(F.col("sides").isNull(), "unverified").when(F.array_contains("sides", F.col("side")) & (F.size("sides") == 1), "corroborated").otherwise("contradicted")
    return told.select("user", "slot", verdict.alias("verdict"))
