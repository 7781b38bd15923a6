"""Column functions over evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def noisy_or(weight: Column, where: Column) -> Column:
    """1 - prod(1 - w) over rows of a group where `where` holds; 0 without such rows."""
    return F.coalesce(1 - F.exp(F.sum(F.when(where, F.log(1 - clamp(weight, 0.0, V.MOST_WEIGHT))))), F.lit(0.0))


def stance(positive: Column, negative: Column, accept: Column | float, margin: Column | float) -> Column:
    """positive or negative if its support and its lead are enough, else unresolved."""
    return F.when((positive >= accept) & (positive - negative >= margin), "positive").when((negative >= accept) & (negative - positive >= margin), "negative").otherwise("unresolved")


def policy(family: Column) -> tuple[Column, Column, Column, Column]:
    """Mode, least support, least margin and whether slots are exclusive, of a family in either case; null is like any other."""
    columns = []
    for k in range(4):
        found = F.when(F.lit(False), F.lit(V.BELIEF_DEFAULT[k]))
        for name, own in V.BELIEF_POLICIES.items():
            found = found.when(F.upper(family) == name, F.lit(own[k]))
        columns.append(found.otherwise(F.lit(V.BELIEF_DEFAULT[k])))
    return tuple(columns)


def correlation_key(explicit: Column, template: Column, index: Column, text: Column, event: Column, source: Column, kind: Column, who: Column, role: Column, fallback_source: Column, fallback_event: Column) -> Column:
    """What makes two observations one piece of evidence: the first key that there is. Empty strings are as null.

    explicit: stated by the producer. template: of generated text. index: place of a message in its log. event: of the source. Otherwise each occurrence
    is its own. The kind of a source is its own name where it has none.
    """
    some = lambda c: F.when(c.cast("string") != "", c.cast("string"))
    origin = F.coalesce(some(kind), some(source), F.lit("unknown"))
    who, role = (F.coalesce(c.cast("string"), F.lit("")) for c in (who, role))
    digest = F.md5(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " "))
    key = lambda prefix, *parts: F.concat_ws(":", F.lit(prefix), *parts)
    said = some(text).isNotNull()
    return (
        F.when(some(explicit).isNotNull(), key("explicit", explicit.cast("string")))
        .when(some(template).isNotNull(), key("template", origin, who, template.cast("string"), digest))
        .when(some(index).isNotNull() & said, key("slot", origin, who, role, index.cast("string"), digest))
        .when(some(event).isNotNull() & said, key("source-event", origin, who, role, event.cast("string"), digest))
        .otherwise(key("occurrence", F.coalesce(some(fallback_source), F.lit("unknown")), F.coalesce(some(fallback_event), F.lit("unknown"))))
    )


def epistemic_weights(mode: Column, base: Column, **inputs: Column) -> Column:
    """Struct of six weights; inputs (curiosity, topic_interest, source, authority, expertise, skepticism, retention, reactivity, novelty) are 0 to 1,
    0.5 where null. How something was learnt moves attention, which is bounded before and after. The effective weight is the base times the geometric mean
    of the other five."""
    x = {k: F.coalesce(v, F.lit(0.5)) for k, v in inputs.items()}
    bound = lambda c: clamp(c, 0.05, 1.5)
    moved = F.when(mode.isin("direct_perception", "conversation"), 0.1).when(mode.isin("skim_document", "ambient"), -0.2).otherwise(0.0)
    five = {
        "attention": bound(bound(0.45 + 0.35 * x["curiosity"] + 0.20 * x["topic_interest"]) + moved),
        "trust": bound(0.35 + 0.35 * x["source"] + 0.20 * x["authority"] + 0.20 * x["expertise"] - 0.25 * x["skepticism"]),
        "compatibility": bound(0.75 + 0.25 * x["expertise"] - 0.15 * x["skepticism"]),
        "retention": bound(0.4 + 0.6 * x["retention"]),
        "salience": bound(0.6 + 0.25 * x["reactivity"] + 0.15 * x["novelty"]),
    }
    product = F.lit(1.0)
    for c in five.values():
        product = product * c
    return F.struct(*[c.alias(k) for k, c in five.items()], clamp(F.coalesce(base, F.lit(0.5)) * F.pow(product, 0.2)).alias("effective"))


def admission_confidence(frame: Column, context: Column) -> Column:
    return clamp(F.least(frame, context))


def admission(predicate: Column, negative_scope: Column, resolved: Column, referent: Column, frame: Column) -> Column:
    """active, unresolved or suppressed; the first gate that fails decides."""
    return F.when(predicate.isNull(), "suppressed").when(negative_scope | ~resolved | (referent < 0.55) | (frame < 0.55), "unresolved").otherwise("active")


def authority(stated: Column, acquired: Column, kind: Column, speaker: Column, resolver: Column, stated_mode: Column, discourse: Column, claim: Column) -> Column:
    """Struct (origin, mode, level, rank, uses): where something comes from, how it was meant, and what it may be used for.

    stated and stated_mode come first where they are not empty. acquired: how it was learnt. kind: of the source. speaker: a role. resolver: what derived
    it. discourse: of the sentence. claim: its kind. What a model or a character generates never has authority, an unknown origin hardly any.
    """
    low = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    some = lambda c: F.when(c != "", c)
    told = (
        F.when(low(acquired).isin(*V.READING_MODES), "corpus_source")
        .when(low(acquired) == "taught", "testimony")
        .when(low(kind).isin(*V.TOOL_KINDS), "deterministic_tool")
        .when((low(kind) == V.ROLEPLAY_KIND) & (low(speaker) == "character"), "character_generation")
        .when(low(speaker) == "user", "user_testimony")
        .when(low(speaker) == "assistant", "model_generation")
        .when(F.startswith(low(resolver), F.lit("context-resolver")), "model_inference")
        .otherwise("unknown")
    )
    origin = F.coalesce(some(stated), told)
    meant = (
        F.when(low(discourse).isin("hypothetical", "counterfactual", "conditional"), "hypothesis")
        .when(low(discourse).contains("question"), "question")
        .when(low(claim) == "memory", "memory")
        .when(low(claim) == "belief", "belief")
        .when(low(claim).isin("trait", "state", "relationship"), "self_description")
        .when(origin.isin("model_generation", "model_inference"), "inference")
        .when(origin.isin("user_testimony", "testimony"), "testimony")
        .otherwise("observation")
    )
    held = [F.when(F.lit(False), F.lit(None)) for _ in range(3)]
    for name, (state, rank, uses) in V.AUTHORITY.items():
        for k, value in enumerate((F.lit(state), F.lit(rank), F.array(*map(F.lit, uses)))):
            held[k] = held[k].when(origin == name, value)
    state, rank, uses = V.AUTHORITY_UNKNOWN
    level, rank, uses = (c.otherwise(v) for c, v in zip(held, (F.lit(state), F.lit(rank), F.array(*map(F.lit, uses))), strict=True))
    return F.struct(origin.alias("origin"), F.coalesce(some(stated_mode), meant).alias("mode"), level.alias("level"), rank.alias("rank"), uses.alias("uses"))
