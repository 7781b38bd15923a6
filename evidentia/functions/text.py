"""Column functions over text and URLs. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def any_of(column: Column, words) -> Column:
    return column.isin(list(words))


def matches_any(column: Column, patterns) -> Column:
    """Whether any pattern is found, letters in either case."""
    return reduce(Column.__or__, [column.rlike(f"(?i){p}") for p in patterns])


def stripped(x: Column) -> Column:
    """Without white space at the edges. It has one parameter, as functions for transform() must: those with a second one are given the index there."""
    return F.btrim(x, F.lit(" \t\n\r\x0b\f"))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), stripped), lambda x: x != "")


# URLs


def url_parts(url: Column) -> Column:
    """Struct of scheme, host, path and query; the fragment is dropped, empty parts are ''."""
    part = lambda k: F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", k)
    return F.struct(F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("host"), part(3).alias("path"), part(4).alias("query"))


def query_pairs(query: Column) -> Column:
    """array<struct<key, value>> of a query string, in order; a pair without '=' has the value ''."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, r"^[^=]*=?", "").alias("value")))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, '/' for an empty path, no tracking keys, no fragment."""
    p = url_parts(url)
    kept = F.filter(query_pairs(p["query"]), lambda x: ~(F.startswith(F.lower(x["key"]), F.lit("utm_")) | any_of(F.lower(x["key"]), V.TRACKING_QUERY_KEYS)))
    query = F.array_join(F.transform(kept, lambda x: F.concat(x["key"], F.lit("="), x["value"])), "&")
    path = F.when(p["path"] == "", "/").otherwise(p["path"])
    return F.concat(p["scheme"], F.lit("://"), p["host"], path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def url_admission(url: Column) -> Column:
    """Reason to reject a URL, null if it is admitted; the first reason counts."""
    p = url_parts(url)
    keys = F.transform(query_pairs(p["query"]), lambda x: F.lower(x["key"]))
    blocked = F.array(*map(F.lit, V.BLOCKED_QUERY_KEYS))
    titles = F.filter(query_pairs(p["query"]), lambda x: F.lower(x["key"]) == "title")
    title = F.coalesce(F.get(titles, F.lit(0))["value"], F.lit(""))
    in_title = title.contains(":") & any_of(F.lower(F.substring_index(title, ":", 1)), V.BLOCKED_WIKI_NAMESPACES)
    article = F.regexp_extract(p["path"], r"(?i)/wiki/([^/?#]+)", 1)
    in_path = article.contains(":") & any_of(F.lower(F.substring_index(article, ":", 1)), V.BLOCKED_WIKI_NAMESPACES)
    administrative = F.arrays_overlap(F.split(F.lower(p["path"]), "/"), F.array(*map(F.lit, V.BLOCKED_PATH_PARTS)))
    return (
        F.when(url.isNull() | ~any_of(p["scheme"], ("http", "https")) | (p["host"] == ""), "unsupported_url")
        .when(F.arrays_overlap(keys, blocked), "action_url")
        .when(in_title, "wiki_namespace")
        .when(administrative, "administrative_path")
        .when(in_path, "wiki_namespace")
    )


def page_admission(title: Column, text: Column) -> Column:
    """Reason to reject a page, null if it is admitted."""
    title = F.rtrim(F.regexp_replace(F.trim(F.lower(F.coalesce(title, F.lit("")))), r"\.+$", ""))
    text = F.trim(F.coalesce(text, F.lit("")))
    marked = reduce(Column.__or__, [F.lower(text).contains(m) for m in V.CHALLENGE_MARKERS])
    return (
        F.when(any_of(title, V.CHALLENGE_TITLES) | ((F.length(text) < 1500) & marked), "challenge_page")
        .when(text == "", "empty_content")
        .when(F.length(text) < 120, "low_content")
    )


# text


def paragraphs(text: Column, least: int = 40, most: int = 1200) -> Column:
    """Paragraphs of a text: distinct blocks between blank lines of at least `least` characters, or else lines joined until a sentence ends."""
    text = F.trim(F.regexp_replace(text, r"\r\n?", "\n"))
    blocks = F.array_distinct(F.filter(F.transform(F.split(text, r"\n\s*\n+"), stripped), lambda x: F.length(x) >= least))

    def step(s: Column, line: Column) -> Column:
        held = F.when(s["held"] == "", line).otherwise(F.concat(s["held"], F.lit(" "), line))
        ends = ((F.length(held) >= least) & held.rlike(r"[.?!]\s*$")) | (F.length(held) >= most)
        return F.struct(F.when(ends, F.concat(s["done"], F.array(F.trim(held)))).otherwise(s["done"]).alias("done"), F.when(ends, "").otherwise(held).alias("held"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    joined = F.aggregate(lines(text), start, step, lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(F.trim(s["held"])))))
    return F.when(text.contains("\n\n"), blocks).otherwise(joined)


def windows(text: Column, size: int = 1200, lone: int = 1500) -> Column:
    """Parts between blank lines; one lone part of more than `lone` characters is cut into windows of `size`."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda x: x != "")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")), lambda k: F.substring(text, k * size + 1, F.lit(size)))
    return F.when((F.size(parts) == 1) & (F.length(text) > lone), cut).otherwise(parts)


def research_terms(text: Column, most: int = 24) -> Column:
    """Search terms in order of first appearance, without stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9][A-Za-z0-9_-]{1,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(tokens, lambda t: ~any_of(t, V.STOP_WORDS))), 1, most)


def content_kind(subject: Column, predicate: Column, text: Column) -> Column:
    """What a claim's text is: pronoun-heavy, navigation, footer, reference or content; the first rule that fits."""
    s, p = (F.trim(F.lower(F.coalesce(c, F.lit("")))) for c in (subject, predicate))
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    footer = [c.rlike(V.FOOTER_PATTERN) for c in (low, s, p)]
    return (
        F.when(any_of(s, V.PRONOUNS), "pronoun-heavy")
        .when(any_of(s, V.INTERROGATIVES + V.INTERFACE_NOUNS + V.NAVIGATION_WORDS) | any_of(p, V.NAVIGATION_WORDS), "navigation")
        .when(reduce(Column.__or__, footer), "footer")
        .when(matches_any(t, V.REFERENCE_PATTERNS), "reference")
        .otherwise("content")
    )


def topic_label(value: Column) -> Column:
    """Folded label of a topic; null if it is no usable one."""
    label = F.regexp_replace(F.replace(F.trim(value), F.lit("_"), F.lit(" ")), r"\s+", " ")
    low = F.lower(label)
    bad = (
        (F.length(label) < 2) | (F.length(label) > 112) | (F.size(F.split(F.trim(label), " ")) > 10) | any_of(low, V.UNUSABLE_LABELS) | label.contains("://") | label.contains("@")
        | ~label.rlike(r"\p{L}") | label.rlike(r"[\x00-\x1f]") | low.rlike(f"^{V.OPAQUE_LABEL}$") | low.rlike(V.TRAILING_WORD)
    )
    return F.when(~bad, low)


def topic_identity(namespace: Column, kind: Column, label: Column) -> Column:
    return F.concat(F.lit("topic-v1:"), F.sha2(F.concat_ws(V.UNIT_SEPARATOR, namespace, kind, topic_label(label)), 256))


# propositions


def normal(value: Column) -> Column:
    """Lower-case, single spaces, no white space or sentence marks at the edges; null if nothing is left."""
    text = F.btrim(F.regexp_replace(F.lower(value), r"\s+", " "), F.lit(" .,:;!?"))
    return F.when(text != "", text)


def polarity(text: Column) -> Column:
    """-1 where the normal text has a word of denial, else 1."""
    padded = F.concat(F.lit(" "), F.coalesce(normal(text), F.lit("")), F.lit(" "))
    return F.when(reduce(Column.__or__, [padded.contains(m) for m in V.NEGATIVE_MARKERS]), -1).otherwise(1)


def canonical(s: Column, p: Column, o: Column, pol: Column, text: Column) -> Column:
    """A statement as text: its components, a missing one as `_`, after NOT where it is denied; the normal text where all are missing."""
    said = F.concat(F.when(pol < 0, "NOT ").otherwise(""), F.concat_ws(" | ", *[F.coalesce(c, F.lit("_")) for c in (s, p, o)]))
    return F.when(s.isNull() & p.isNull() & o.isNull(), F.coalesce(normal(text), F.trim(text))).otherwise(said)


def proposition_hash(s: Column, p: Column, o: Column, pol: Column, text: Column) -> Column:
    """Identity of a statement with its polarity."""
    parts = [F.coalesce(c, F.lit("")) for c in (s, p, o)]
    return F.sha2(F.concat_ws(V.UNIT_SEPARATOR, *parts, pol.cast("string"), canonical(s, p, o, pol, text)), 256)


def topic_key(s: Column, p: Column, o: Column, pol: Column, text: Column) -> Column:
    """Identity of what is asked: subject and predicate, or the canonical statement where both are missing."""
    return F.sha2(F.when(s.isNull() & p.isNull(), canonical(s, p, o, pol, text)).otherwise(F.concat_ws(V.UNIT_SEPARATOR, F.coalesce(s, F.lit("")), F.coalesce(p, F.lit("")))), 256)


def atom_key(s: Column, p: Column, o: Column, text: Column) -> Column:
    """Identity of a statement whatever its polarity."""
    parts = [F.coalesce(c, F.lit("")) for c in (s, p, o)]
    return F.when(s.isNull() & p.isNull() & o.isNull(), F.concat(F.lit("raw:"), text)).otherwise(F.concat_ws(V.UNIT_SEPARATOR, *parts))


def predicate_family(predicate: Column, text: Column) -> Column:
    """Family of a predicate by the first list that has it, else by words of the text, else ACTION, or UNKNOWN without predicate."""
    p, t = F.replace(F.coalesce(normal(predicate), F.lit("")), F.lit(" "), F.lit("_")), F.lower(F.coalesce(text, F.lit("")))
    found = F.when(F.lit(False), "")
    for family, words in V.PREDICATE_FAMILIES.items():
        found = found.when(any_of(p, words), family)
    for family, cue in V.FAMILY_CUES:
        found = found.when(t.rlike(cue), family)
    return found.when(p != "", "ACTION").otherwise("UNKNOWN")


def claim_kind(family: Column) -> Column:
    return (
        F.when(any_of(family, ("MEMORY", "GOAL", "RULE")), family).when(family == "EPISTEMIC", "BELIEF").when(any_of(family, ("SOCIAL", "MEMBERSHIP")), "RELATIONSHIP")
        .when(any_of(family, ("SPATIAL", "TEMPORAL", "DESCRIPTIVE", "EMOTIONAL", "POSSESSION")), "STATE").otherwise("EVENT")
    )


def message_unit(sentence: Column) -> Column:
    """Struct (kind, subject, predicate, object, confidence, rule) of one sentence of a message; null if it asserts nothing. The first rule that fits."""
    text = F.replace(sentence, F.lit("’"), F.lit("'"))
    has = lambda pattern: text.rlike(f"(?i){pattern}")
    part = lambda pattern, k: F.regexp_extract(text, f"(?i){pattern}", k)
    who = lambda pattern: F.when(has(pattern), part(pattern, 1))

    def made(kind: str, rule: str, confidence: float, s: Column, p: Column, o: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), s.alias("subject"), p.alias("predicate"), o.alias("object"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))

    refused = F.when(has(V.MESSAGE_REFUSAL) & ~has(V.MESSAGE_STAY), part(V.MESSAGE_REFUSAL, 1)).otherwise("leave")
    commits = has(V.MESSAGE_COMMITMENT) & ~has(V.MESSAGE_CONDITION) & ~part(V.MESSAGE_COMMITMENT, 1).rlike(r"(?i)^need\s")
    unit = F.when(has(V.MESSAGE_DISCOURSE_MARKER) | has(V.MESSAGE_QUESTION), F.lit(None))
    unit = unit.when(has(V.MESSAGE_REFUSAL) | has(V.MESSAGE_STAY), made("STATE", "expressed_scene_refusal", 0.89, F.lit("I"), F.lit("refuses"), F.concat(F.lit("to "), refused)))
    for kind, rule, confidence, pattern in V.MESSAGE_RULES:
        fits = has(pattern) & ~has(V.MESSAGE_CAUSED_DESIRE) if kind == "GOAL" else has(pattern)
        unit = unit.when(fits, made(kind, rule, confidence, *(part(pattern, k) for k in (1, 2, 3))))
    unit = unit.when(commits, made("GOAL", "explicit_self_commitment", 0.86, F.lit("I"), F.lit("commit"), part(V.MESSAGE_COMMITMENT, 1)))
    unit = unit.when(has(V.MESSAGE_RELATIONSHIP), made("RELATIONSHIP", "relationship_predicate", 0.82, who(V.MESSAGE_RELATIONSHIP_SUBJECT), F.lit("relates"), text))
    states = has(V.MESSAGE_STATE) & part(V.MESSAGE_STATE, 3).rlike(f"(?i){V.MESSAGE_STATE_TERMS}")
    unit = unit.when(states, made("STATE", "bounded_state_predicate", 0.86, *(part(V.MESSAGE_STATE, k) for k in (1, 2, 3))))
    return unit.when(has(V.MESSAGE_EVENT), made("EVENT", "event_predicate", 0.70, who(V.MESSAGE_EVENT_ACTOR), F.lit("event"), text))


def clause_scope(clause: Column) -> Column:
    """question, counterfactual, hypothetical, conditional or asserted, by the first pattern that fits."""
    text = F.trim(F.coalesce(clause, F.lit("")))
    found = F.when(text == "", "asserted")
    for scope, pattern in V.CLAUSE_SCOPES:
        found = found.when(text.rlike(f"(?i){pattern}"), scope)
    return found.otherwise("asserted")


def effective_scope(clause: Column, inherited: Column) -> Column:
    """A clause's own scope; one that merely asserts has the scope that it stands in."""
    own = clause_scope(clause)
    return F.when(own == "asserted", F.coalesce(inherited, F.lit("asserted"))).otherwise(own)


def sentences(text: Column) -> Column:
    """Sentences by end marks and line ends."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), stripped), lambda x: x != "")
