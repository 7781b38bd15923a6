"""Column functions for times, demands, learning and membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .evidence import clamp
from .text import any_of, matches_any, research_terms


def age_label(seconds: Column, label: Column) -> Column:
    """A label with its age in whole days, hours or minutes; empty for what is unknown or yet to come."""
    n = lambda size, unit: F.concat(label, F.lit(" "), F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago"))
    known = F.when(seconds >= 86400, n(86400, "d")).when(seconds >= 3600, n(3600, "h")).when(seconds >= 60, n(60, "m")).otherwise(F.concat(label, F.lit(" <1m ago")))
    return F.when(seconds.isNull() | (seconds < 0), "").otherwise(known)


_SPACE = " \t\n\r\x0b\f"


def _stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))


def _folded(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def time_window(expression: Column, said: Column, said_at: Column, now: Column, zone: Column, delay: Column) -> Column:
    """Struct (due, until) of an expression of time that was said at a time; null unless it can be resolved and grounded.

    The expression must occur in what was said: "in N minutes, hours, days or weeks"; today or tomorrow, with a part of the day, in a named time zone; or
    a vague one with one of the delays (seconds) that may be suggested for it. It must be due after now, within 366 days. Times are in UTC; zone is an IANA
    name or null.
    """
    phrase = _folded(expression)
    span = r"^in ([0-9]{1,4}) (minute|hour|day|week)s?$"
    unit = F.regexp_extract(phrase, span, 2)
    size = reduce(lambda found, u: found.when(unit == u, V.TIME_UNITS[u]), V.TIME_UNITS, F.when(F.lit(False), 0))
    later = lambda seconds: F.timestamp_seconds(F.unix_timestamp(said_at) + seconds)
    exact = lambda due: F.struct(due.alias("due"), due.alias("until"))
    day = r"^(today|tomorrow)(?: (morning|afternoon|evening|tonight))?$"
    midnight = F.date_trunc("day", F.from_utc_timestamp(said_at, zone)) + F.make_interval(days=F.when(F.regexp_extract(phrase, day, 1) == "tomorrow", 1).otherwise(0))
    part = F.regexp_extract(phrase, day, 2)
    at = lambda k: F.to_utc_timestamp(midnight + F.make_interval(mins=reduce(lambda found, p: found.when(part == p, V.DAY_PARTS[p][k]), V.DAY_PARTS, F.when(F.lit(False), 0))), zone)
    found = (
        F.when(phrase.rlike(span), exact(later(F.regexp_extract(phrase, span, 1).try_cast("int") * size)))
        .when(any_of(phrase, V.VAGUE_FUTURE) & delay.isin(*V.DEFERRALS), exact(later(delay)))
        .when(phrase.rlike(day) & zone.isNotNull(), F.struct(at(0).alias("due"), at(1).alias("until")))
    )
    holds = (phrase != "") & _folded(said).contains(phrase) & (found["due"] > now) & (F.unix_timestamp(found["due"]) <= F.unix_timestamp(now) + 366 * 86400) & (found["until"] >= found["due"])
    return F.when(holds, found)


def learning_score(retrieval: Column, rank: Column, exposures: Column, reinforcement: Column, curiosity: Column, retention: Column, interest: Column, expertise: Column, novelty: Column) -> Column:
    """How much a section has earned to be learnt; .72 is enough."""
    return (
        0.20 * F.least(F.lit(1.0), 4 * retrieval) + 0.10 / F.greatest(F.lit(1), rank) + 0.15 * F.least(F.lit(1.0), exposures / 3) + 0.18 * F.least(F.lit(1.0), reinforcement / 2)
        + 0.12 * curiosity + 0.12 * retention + 0.06 * interest + 0.05 * expertise + 0.02 * novelty
    )


def membership_rank(status: Column) -> Column:
    """member, compatible, candidate, challenged: 4 to 1."""
    return F.when(status == "member", 4).when(status == "compatible", 3).when(status == "candidate", 2).when(status == "challenged", 1).otherwise(0)


def coverage(needed: Column, held: Column) -> Column:
    """Share of needed terms that are held; 1 if nothing is needed."""
    return F.when(F.size(needed) == 0, 1.0).otherwise(F.size(F.array_intersect(needed, held)) / F.size(F.array_distinct(needed)))


def _clause(text: Column) -> Column:
    """The last question of a text, or else its last sentence, or else the text."""
    parts = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), _stripped), lambda x: x != "")
    asked = F.filter(parts, lambda x: F.endswith(x, F.lit("?")))
    last = lambda a: F.get(a, F.size(a) - 1)
    return F.coalesce(last(asked), last(parts), _stripped(text))


def demand(text: Column, character: Column) -> Column:
    """Struct (route, reason, kind, topics, temporal, focus): what a message asks for.

    Only what surely asks a character about itself goes to its own memory (`character`); all else is `general`.
    """
    clause = _clause(text)
    own = clause.rlike(f"(?i){V.DEMAND_SECOND_PERSON}") & matches_any(clause, V.DEMAND_SELF_PATTERNS)
    terms = F.filter(research_terms(clause, 16), lambda t: ~any_of(t, V.DEMAND_NOISE))
    has = lambda words: F.exists(terms, lambda t: any_of(t, words))
    kind = F.when(has(V.DEMAND_PREFERENCE_WORDS), "preference").when(has(V.DEMAND_MEMORY_WORDS), "memory").when(has(V.DEMAND_EXPERIENCE_WORDS), "experience").otherwise("history")
    topics = F.filter(terms, lambda t: ~any_of(t, V.DEMAND_PREFERENCE_WORDS + V.DEMAND_MEMORY_WORDS + V.DEMAND_EXPERIENCE_WORDS))
    prior = F.when(clause.rlike(f"(?i){V.DEMAND_PRIOR}"), "prior").otherwise("unspecified")
    said = _stripped(text)
    focus = F.btrim(F.concat_ws(" ", _stripped(character), F.array_join(terms, " ")))
    reason = F.when(clause == "", "empty_focus").when(own, "character_self_knowledge").when(matches_any(clause, V.DEMAND_EXTERNAL_PATTERNS), "external_knowledge_question").otherwise("no_high_confidence_self_signal")
    mine = (clause != "") & own
    return F.struct(
        F.when(mine, "character").otherwise("general").alias("route"), reason.alias("reason"), F.when(mine, kind).otherwise("general").alias("kind"),
        F.when(mine, topics).otherwise(F.array().cast("array<string>")).alias("topics"), F.when(mine, prior).otherwise("unspecified").alias("temporal"),
        F.when(mine, F.when(focus != "", focus).otherwise(clause)).otherwise(said).alias("focus"),
    )


def affinity(level: Column, weight: Column) -> Column:
    return clamp(0.5 * level + 0.5 * weight)
