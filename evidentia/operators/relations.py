"""Relations of neighbouring statements: which pairs are looked at, what they are to each other, and what that means in their scopes.

A pair has two structs, a and b, of a statement's attributes (see ATTRIBUTES; missing ones are null), and the similarity of their vectors. Every relation
collects votes of independent features; the proposal that the features suggest stands only if the votes confirm it. All of it stays within a row: no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.evidence import clamp

ATTRIBUTES = (
    "topic_key", "subject_norm", "predicate_norm", "object_norm", "polarity", "claim_kind", "predicate_family", "world_id", "timeline_id", "dag_node_id",
    "epistemic_scope", "character_instance_id", "character_id", "viewpoint_id", "semantic_confidence",
)


def _pair(name: str) -> tuple[Column, Column]:
    return F.col(f"a.{name}"), F.col(f"b.{name}")


def _some(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def _same(name: str) -> Column:
    """Both have it and it is equal."""
    x, y = _pair(name)
    return F.coalesce(_some(x) & (x == y), F.lit(False))


def _swapped() -> Column:
    (sa, sb), (oa, ob) = _pair("subject_norm"), _pair("object_norm")
    return F.coalesce(_some(sa) & _some(oa) & (sa == ob) & (oa == sb), F.lit(False))


def anchored() -> Column:
    """Whether a pair shares a subject, an object or a topic, or has them swapped: a cheap gate for neighbours, not a verdict."""
    return _same("subject_norm") | _same("object_norm") | _same("topic_key") | _swapped()


def _scope(side: str) -> Column:
    stated = F.lower(F.trim(F.coalesce(F.col(f"{side}.epistemic_scope"), F.lit(""))))
    owned = _some(F.col(f"{side}.character_instance_id")) | _some(F.col(f"{side}.character_id"))
    return F.when(stated.isin("character", "world"), stated).when(owned, "character").otherwise("unknown")


def scope_relation() -> Column:
    """How the memories that a pair belongs to stand to each other. A character's world alone does not make a memory the world's."""
    x, y = _scope("a"), _scope("b")
    both = lambda scope: (x == scope) & (y == scope)
    return (
        F.when(both("world"), F.when(_same("world_id"), "WORLD_SAME_WORLD").otherwise("WORLD_CROSS_WORLD"))
        .when(both("character"), F.when(_same("character_instance_id") | _same("viewpoint_id"), "CHAR_SAME_VIEWPOINT").otherwise("CHAR_CROSS_VIEWPOINT"))
        .when(((x == "character") & (y == "world")) | ((x == "world") & (y == "character")), "CHAR_WORLD")
        .otherwise("UNSCOPED")
    )


def features() -> dict[str, Column]:
    """What votes are about, by name, from the columns a and b."""
    same = {f"same_{short}": _same(name) for short, name in (("subject", "subject_norm"), ("predicate", "predicate_norm"), ("object", "object_norm"), ("topic", "topic_key"), ("timeline", "timeline_id"), ("world", "world_id"), ("dag_node", "dag_node_id"))}
    (oa, ob), (ka, kb), (fa, fb) = _pair("object_norm"), _pair("claim_kind"), _pair("predicate_family")
    known = lambda name: reduce(Column.__and__, map(_some, _pair(name)))
    sign = [F.coalesce(c, F.lit(1)) for c in _pair("polarity")]
    polarity = sign[0] == sign[1]
    base = same["same_subject"] & same["same_predicate"]
    family = F.coalesce(_some(fa) & (F.upper(fa) == F.upper(fb)), F.lit(False))
    said = family & F.coalesce(F.upper(fa) == "COMMUNICATION", F.lit(False))
    left, right = F.lower(F.trim(oa)), F.lower(F.trim(ob))
    inside = F.coalesce(_some(oa) & _some(ob) & (left != right) & (left.contains(right) | right.contains(left)), F.lit(False))
    slot = F.lower(F.trim(F.coalesce(F.col("a.predicate_norm"), F.lit("")))).isin(*V.STRICT_SINGLE_VALUE_PREDICATES)
    denied = base & same["same_object"] & ~polarity
    competing = base & polarity & _some(oa) & _some(ob) & ~same["same_object"] & slot
    return {
        **same,
        "same_polarity": polarity,
        "same_predicate_family": family,
        "other_object": ~same["same_object"],
        "object_refinement": base & polarity & inside,
        "both_events": F.coalesce((ka == "EVENT") & (kb == "EVENT"), F.lit(False)),
        "worlds_compatible": ~known("world_id") | same["same_world"],
        "timelines_compatible": ~known("timeline_id") | same["same_timeline"],
        "communication_content_compatible": ~said | same["same_object"],
        "role_reversal": _swapped() & ~same["same_subject"],
        "polarity_conflict": denied,
        "exclusive_slot_conflict": competing,
        "semantic_conflict": denied | competing,
        "same_scope": F.col("scope_relation").isin("WORLD_SAME_WORLD", "CHAR_SAME_VIEWPOINT"),
        "never": F.lit(False),
    }


def _vote(rule: tuple, axis: str) -> Column:
    if axis == "vector":
        steps, below = rule
        return reduce(lambda found, s: found.when(F.col("similarity") >= s[0], s[1]), steps, F.when(F.lit(False), 0)).otherwise(below)
    *held, otherwise = rule
    pairs = held if isinstance(held[0], tuple) else [tuple(held)]
    return reduce(lambda found, p: found.when(F.col(f"f.{p[0]}"), p[1]), pairs, F.when(F.lit(False), 0)).otherwise(otherwise)


def relate(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, similarity, ...) with relation, confidence, scope_relation, meaning, and the verdict on the proposal: proposed, winner, score, margin,
    stability and status. A relation that votes do not confirm is UNRESOLVED with confidence 0; other columns stay."""
    rest = pairs.columns
    known = pairs.withColumn("scope_relation", scope_relation())
    known = known.withColumn("f", F.struct(*[c.alias(n) for n, c in features().items()]))
    f = lambda name: F.col(f"f.{name}")
    event = f("both_events") & f("worlds_compatible") & f("timelines_compatible") & f("same_dag_node") & f("same_polarity") & f("same_subject") & f("same_predicate") & f("same_predicate_family")
    proposed = (
        F.when(f("semantic_conflict"), "CONTRADICTS")
        .when(f("same_subject") & f("same_predicate") & f("same_object") & f("same_polarity"), "EQUIVALENT")
        .when(f("object_refinement"), "REFINES")
        .when(event & f("communication_content_compatible") & ~f("role_reversal") & (F.col("similarity") >= 0.80), "SAME_EVENT")
        .when(f("same_topic"), "SAME_TOPIC")
        .otherwise("RELATED")
    )
    names = sorted(V.RELATION_VOTES)
    axes = sorted({axis for own in V.RELATION_VOTES.values() for axis in own})
    votes = F.struct(*[F.struct(*[_vote(rule, axis).alias(axis) for axis, rule in V.RELATION_VOTES[n].items()]).alias(n) for n in names])
    known = known.withColumn("proposed", proposed).withColumn("votes", votes)
    total = lambda n: reduce(Column.__add__, [F.col(f"votes.{n}.{axis}") for axis in V.RELATION_VOTES[n]])
    known = known.withColumn("totals", F.struct(*[total(n).alias(n) for n in names]))
    # largest score first, of equal ones the first name
    place = {n: len(names) - k for k, n in enumerate(names)}
    best = lambda score: F.greatest(*[F.struct(score(n).alias("score"), F.lit(place[n]).alias("place"), F.lit(n).alias("name")) for n in names])
    known = known.withColumn("top", best(lambda n: F.col(f"totals.{n}")))
    second = F.greatest(*[F.when(F.col("top.name") != n, F.col(f"totals.{n}")) for n in names])
    without = lambda axis: best(lambda n: F.col(f"totals.{n}") - (F.col(f"votes.{n}.{axis}") if axis in V.RELATION_VOTES[n] else 0))
    stable = reduce(Column.__add__, [(without(axis)["name"] == F.col("top.name")).cast("int") for axis in axes])
    least, margin, stability = V.RELATION_LEAST
    known = known.select("*", F.col("top.name").alias("winner"), F.col("top.score").alias("score"), (F.col("top.score") - second).alias("margin"), (stable / len(axes)).alias("stability"))
    weak = (F.col("score") < least) | (F.col("margin") < margin) | (F.col("stability") < stability)
    known = known.withColumn("status", F.when(F.col("winner") != F.col("proposed"), "challenged").when(weak, "fragile").otherwise("verified"))
    ratio = clamp((F.col("score") + 6) / 16)
    sure = F.least(F.lit(0.98), 0.55 * F.col("similarity") + 0.45 * ratio)
    # an identity is no surer than what made the statements events
    eligible = F.least(*[clamp(c) for c in _pair("semantic_confidence")])
    capped = F.when((F.col("winner") == "SAME_EVENT") & f("both_events") & reduce(Column.__and__, [c.isNotNull() for c in _pair("semantic_confidence")]), F.least(sure, eligible)).otherwise(sure)
    verified = F.col("status") == "verified"
    meaning = reduce(lambda found, m: found.when(F.col("scope_relation") == m[0], m[1]), V.CONTRADICTION_MEANINGS.items(), F.when(F.lit(False), "")).otherwise("semantic_conflict_unscoped")
    known = known.withColumn("relation", F.when(verified, F.col("winner")).otherwise("UNRESOLVED")).withColumn("confidence", F.when(verified, capped).otherwise(0.0))
    meaning = F.when(F.col("relation") == "CONTRADICTS", meaning).otherwise("consistent_or_related")
    return known.select(*rest, "relation", "confidence", "scope_relation", meaning.alias("meaning"), "proposed", "winner", "score", "margin", "stability", "status")
