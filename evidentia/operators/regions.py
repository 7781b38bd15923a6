"""Regions: what clusters are about, what they are called, and what parts two of them. Counts of a region's values are maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.evidence import clamp
from .vector import boundary_scores


def describe(values: DataFrame, times: DataFrame, most: int = 12) -> DataFrame:
    """(cluster, counts, time_start, time_end) of values (cluster, node, dimension, value) and times (cluster, at): for each dimension the `most` frequent
    values with the number of nodes that have them, in a map of maps, equal numbers in order of the values; and the span of time."""
    counts = values.filter("value is not null").groupBy("cluster", "dimension", "value").agg(F.count_distinct("node").cast("double").alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("s"), "value"))), 1, most)
    per = counts.groupBy("cluster", "dimension").agg(F.map_from_entries(F.transform(top, lambda x: F.struct(x["value"], -x["s"]))).alias("m"))
    per = per.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "m"))).alias("counts"))
    span = times.groupBy("cluster").agg(F.min("at").alias("time_start"), F.max("at").alias("time_end"))
    return per.join(span, "cluster", "full")


def _total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), x))


def _held(m: Column) -> Column:
    return F.map_filter(F.coalesce(m, F.create_map().cast("map<string,double>")), lambda k, v: v > 0)


def overlap(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two maps of counts; a half where both are unknown, which is evidence for nothing."""
    a, b = _held(a), _held(b)
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    of = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    fold = lambda f: F.aggregate(keys, F.lit(0.0), lambda s, k: s + f(of(a, k), of(b, k)))
    return F.when(F.size(keys) == 0, 0.5).otherwise(fold(F.least) / fold(F.greatest))


def time_relation(a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
    """Overlap and gap of two spans of seconds, as shares of the time that both cover; 0 where any end is unknown."""
    whole = F.greatest(F.greatest(a1, b1) - F.least(a0, b0), F.lit(1.0))
    shared = F.least(a1, b1) - F.greatest(a0, b0)
    known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()
    part = lambda c: F.when(known, clamp(c / whole)).otherwise(0.0)
    return part(F.greatest(shared, F.lit(0.0))), part(F.greatest(-shared, F.lit(0.0)))


def state_share(*families: Column) -> Column:
    """Share of predicate families that tell of states, over all maps of counts."""
    own = [_held(f) for f in families]
    state = reduce(Column.__add__, [_total(F.map_filter(m, lambda k, v: F.lower(k).isin(*V.STATE_FAMILIES))) for m in own])
    whole = reduce(Column.__add__, [_total(m) for m in own])
    return F.when(whole > 0, state / whole).otherwise(0.0)


def boundaries(pairs: DataFrame) -> DataFrame:
    """pairs with label and score of the boundary between two regions, a and b (structs counts, time_start, time_end in seconds), by their similarity and their
    densities of conflicts (similarity, conflict_density, exclusive_conflict_density, opposite_polarity_density)."""
    of = lambda side, name: F.try_element_at(F.col(f"{side}.counts"), F.lit(name))
    features = {f"{short}_overlap": overlap(of("a", name), of("b", name)) for short, name in V.BOUNDARY_DIMENSIONS.items()}
    features["temporal_overlap"], features["temporal_separation"] = time_relation(*(F.col(f"{side}.{end}").cast("double") for side in "ab" for end in ("time_start", "time_end")))
    features["state_like_ratio"] = state_share(of("a", "predicate_families"), of("b", "predicate_families"))
    features["mean_similarity"] = F.col("similarity")
    known = pairs.withColumn("_f", F.struct(*[c.alias(n) for n, c in features.items()]))
    names = {n: F.col(f"_f.{n}") for n in features} | {n: F.col(n) for n in ("conflict_density", "exclusive_conflict_density", "opposite_polarity_density")}
    known = known.withColumn("_s", boundary_scores(names, V.BOUNDARY_WEIGHTS, V.BOUNDARY_CONFIDENCE, V.BOUNDARY_MARGIN))
    return known.withColumn("label", F.col("_s.label")).withColumn("score", F.col("_s.score")).drop("_f", "_s")


def region_label(counts: Column) -> Column:
    """Struct (label, confidence) of a region by the kinds, families and topics that it is made of: the largest share; mixed below .55."""
    of = lambda name: _held(F.try_element_at(counts, F.lit(name)))
    kinds, families, topics = of("claim_kinds"), of("predicate_families"), of("dominant_topics")
    whole = F.when(_total(kinds) > 0, _total(kinds)).otherwise(1.0)
    share = lambda *names: _total(F.map_filter(kinds, lambda k, v: k.isin(*names))) / whole
    state = F.greatest(_total(F.map_filter(families, lambda k, v: F.lower(k).isin(*V.STATE_FAMILIES))) / F.greatest(_total(families), F.lit(1.0)), share(*V.STATE_KINDS))
    top = F.when(_total(topics) > 0, F.array_max(F.map_values(topics)) / _total(topics)).otherwise(0.0)
    scores = {**{label: share(*names) for label, names in V.REGION_KINDS.items()}, "STATE_SERIES": state, "TOPIC_REGION": top}
    best = F.array_max(F.array(*[F.struct(c.alias("c"), F.lit(-k).alias("k"), F.lit(label).alias("label")) for k, (label, c) in enumerate(scores.items())]))
    some = (F.size(kinds) > 0) | (F.size(families) > 0)
    weak = F.struct(F.when(some, "MIXED_REGION").otherwise("UNRESOLVED").alias("label"), F.when(some, F.greatest(best["c"], F.lit(0.5))).otherwise(best["c"]).alias("confidence"))
    return F.when(best["c"] < V.REGION_CONFIDENCE, weak).otherwise(F.struct(best["label"].alias("label"), F.least(F.lit(1.0), best["c"]).alias("confidence")))
