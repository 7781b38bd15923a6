"""Evidence operators: from many repeated assertions to one stance per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import values as V
from .graph import held


def collapse(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, polarity sign and correlation key: the largest weight and the latest order. Partial maxima are taken before the shuffle.

    A point without a correlation key, null or empty, is evidence of its own.
    """
    sign = F.when(F.col("polarity") >= 0, 1).otherwise(-1)
    own = F.when(F.col("correlation_key") != "", F.col("correlation_key")).otherwise(F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string")))
    points = points.withColumn("correlation_key", own)
    return points.groupBy(*keys, sign.alias("polarity"), "correlation_key").agg(F.max(E.clamp(F.col("weight"), 0.0, V.MOST_WEIGHT)).alias("weight"), F.max("ord").alias("ord"))


def belief(points: DataFrame, keys: list[str], mode: str = "accumulate", accept: float = 0.6, margin: float = 0.15) -> DataFrame:
    """(keys, pos, neg, n, stance, confidence) of points (keys, polarity, weight, ord, correlation_key).

    accumulate: noisy-or of independent evidence per side. max: strongest of each side. latest: the newest point alone, of equal ones the heaviest, then the
    one with the smallest key.
    """
    rows = collapse(points, keys)
    up, down = F.col("polarity") > 0, F.col("polarity") < 0
    if mode == "latest":
        # an aggregate, not a window: a key's rows need no sorting
        first = F.min(F.struct((-F.col("ord")).alias("o"), (-F.col("weight")).alias("w"), "correlation_key", "polarity")).alias("f")
        made = rows.groupBy(*keys).agg(first, F.lit(1).cast("long").alias("n"))
        side = lambda s: F.when(F.col("f.polarity") == s, -F.col("f.w")).otherwise(0.0)
        made = made.select(*keys, side(1).alias("pos"), side(-1).alias("neg"), "n")
    elif mode == "max":
        side = lambda c: F.coalesce(F.max(F.when(c, F.col("weight"))), F.lit(0.0))
        made = rows.groupBy(*keys).agg(side(up).alias("pos"), side(down).alias("neg"), F.count("*").alias("n"))
    else:
        made = rows.groupBy(*keys).agg(E.noisy_or(F.col("weight"), up).alias("pos"), E.noisy_or(F.col("weight"), down).alias("neg"), F.count("*").alias("n"))
    pos, neg = F.round("pos", 6), F.round("neg", 6)
    return made.select(*keys, pos.alias("pos"), neg.alias("neg"), "n", E.stance(pos, neg, accept, margin).alias("stance"), F.round(F.abs(pos - neg), 6).alias("confidence"))


def belief_by_family(points: DataFrame, keys: list[str], family: str = "family") -> DataFrame:
    """belief() with each family's own policy: (keys, family, mode, pos, neg, n, stance, confidence, exclusive) of points that also have a family.

    One pass: sides are aggregated in all modes at once, and the family's is taken.
    """
    rows = collapse(points, [*keys, family])
    up, down = F.col("polarity") > 0, F.col("polarity") < 0
    first = F.min(F.struct((-F.col("ord")).alias("o"), (-F.col("weight")).alias("w"), "correlation_key", "polarity")).alias("f")
    most = lambda c: F.coalesce(F.max(F.when(c, F.col("weight"))), F.lit(0.0))
    made = rows.groupBy(*keys, family).agg(first, most(up).alias("max_up"), most(down).alias("max_down"), E.noisy_or(F.col("weight"), up).alias("sum_up"), E.noisy_or(F.col("weight"), down).alias("sum_down"), F.count("*").alias("n"))
    mode, accept, margin, exclusive = E.policy(F.col(family))
    made = made.select("*", mode.alias("mode"), accept.alias("_accept"), margin.alias("_margin"), exclusive.alias("exclusive"))
    latest = F.col("mode") == "latest"
    side = lambda sign, top, both: F.round(F.when(latest, F.when(F.col("f.polarity") == sign, -F.col("f.w")).otherwise(0.0)).when(F.col("mode") == "max", F.col(top)).otherwise(F.col(both)), 6)
    made = made.withColumn("pos", side(1, "max_up", "sum_up")).withColumn("neg", side(-1, "max_down", "sum_down"))
    stance = E.stance(F.col("pos"), F.col("neg"), F.col("_accept"), F.col("_margin"))
    return made.select(*keys, family, "mode", "pos", "neg", F.when(latest, 1).otherwise(F.col("n")).cast("long").alias("n"), stance.alias("stance"), F.round(F.abs(F.col("pos") - F.col("neg")), 6).alias("confidence"), "exclusive")


def exclusive_slot(beliefs: DataFrame, slot: list[str], newest: Column) -> DataFrame:
    """Of atoms that exclude each other in a slot only the newest stays; the others become unresolved without support."""
    first = F.row_number().over(Window.partitionBy(*slot).orderBy(newest.desc_nulls_last(), F.col("atom"))) == 1
    out = beliefs.withColumn("winner", first)
    for c in ("pos", "neg", "confidence"):
        out = out.withColumn(c, F.when(F.col("winner"), F.col(c)).otherwise(0.0))
    return out.withColumn("stance", F.when(F.col("winner"), F.col("stance")).otherwise("unresolved"))


def conflicts(props: DataFrame, id_col: str = "id") -> DataFrame:
    """(a, b, kind, weight) of propositions (id, topic, predicate, object, polarity) of one topic: opposite polarity 1.0, whatever the objects; of equal
    polarity, another object of an exclusive predicate .85, where both have one.

    Propositions are first reduced to distinct objects and polarities per topic, and conflicts are found between those groups through each group's smallest
    id, so that a topic with many repeats costs no pair of each.
    """
    groups = held(props.groupBy("topic", "predicate", "object", "polarity").agg(F.min(id_col).alias("id")))
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.id") < F.col("b.id")))
    opposite = F.col("a.polarity") != F.col("b.polarity")
    some = (F.col("a.object") != "") & (F.col("b.object") != "") & (F.col("a.object") != F.col("b.object"))
    exclusive = F.col("a.predicate").isin(list(V.EXCLUSIVE_PREDICATES)) & some
    found = pairs.filter(opposite | exclusive)
    return found.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.when(opposite, "polarity").otherwise("exclusive").alias("kind"), F.when(opposite, 1.0).otherwise(0.85).alias("weight"))


def strongest_per_pair(rows: DataFrame, a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """One row for each unordered pair, the strongest."""
    pair = rows.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    return pair.groupBy("lo", "hi").agg(F.max(F.struct(weight, "kind")).alias("m")).select("lo", "hi", F.col("m.kind").alias("kind"), F.col(f"m.{weight}").alias(weight))


def narratives(observations: DataFrame) -> DataFrame:
    """(topic, variant, source, n, affinity): a source's share of its topic's observations that tell this variant."""
    counts = observations.groupBy("topic", "variant", "source").agg(F.count("*").alias("n"))
    totals = counts.groupBy("topic", "source").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["topic", "source"]).select("topic", "variant", "source", "n", F.round(F.col("n") / F.col("total"), 6).alias("affinity"))


def consensus(beliefs: DataFrame, key: str, owner: str, least: int = 2, confidence: float = 0.65) -> DataFrame:
    """(key, supporters, dissenters, status): eligible with enough confident supporters and no dissent, contested with dissent, else open."""
    counted = beliefs.groupBy(key).agg(
        F.count_distinct(F.when((F.col("stance") == "positive") & (F.col("confidence") >= confidence), F.col(owner))).alias("supporters"),
        F.count_distinct(F.when(F.col("stance") == "negative", F.col(owner))).alias("dissenters"),
    )
    return counted.withColumn("status", F.when(F.col("dissenters") > 0, "contested").when(F.col("supporters") >= least, "eligible").otherwise("open"))


def lifecycle(rows: DataFrame) -> DataFrame:
    """rows with state, the first that fits: rejected, resolved, contested, promoted, absorbed, historical, liminal. Flags are booleans of that name."""
    state = F.when(F.lit(False), "")
    for name in ("rejected", "resolved", "contested", "promoted", "absorbed", "historical"):
        state = state.when(F.col(name), name)
    return rows.withColumn("state", state.otherwise("liminal"))


def first_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. Spark keeps one candidate per key and partition before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def exact_admission(claims: DataFrame, scope: list[str], *order: Column) -> DataFrame:
    """claims with decision: novel_exact for the first of a proposition in its scope, reinforces_exact for the others."""
    rank = F.row_number().over(Window.partitionBy("proposition", *scope).orderBy(*order))
    return claims.withColumn("decision", F.when(rank == 1, "novel_exact").otherwise("reinforces_exact"))


def matrix_verdict(votes: DataFrame, key: str, proposal: DataFrame, least: float = 4, margin: float = 3, stability: float = 0.75) -> DataFrame:
    """(key, winner, score, margin, stability, status) of votes (key, candidate, axis, value) and proposals (key, proposal, protected).

    Stability is the share of axes without which the winner stays the same. Order: score descending, then name. A protected proposal is verified if it
    wins, and else stays explicitly; one without votes has insufficient evidence. Both rankings are aggregates per key; a key has one row per candidate
    and axis.
    """
    sums = votes.groupBy(key, "candidate").agg(F.sum("value").alias("score"))
    ranked = sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "candidate"))).alias("r"))
    top = ranked.select(key, F.get("r", F.lit(0))["candidate"].alias("winner"), (-F.get("r", F.lit(0))["s"]).alias("score"), F.coalesce(-F.get("r", F.lit(1))["s"], F.lit(0.0)).alias("second"))
    axes = votes.select(key, "axis").distinct()
    without = axes.join(sums, key).join(votes.select(key, "candidate", "axis", "value"), [key, "candidate", "axis"], "left")
    left = without.groupBy(key, "axis").agg(F.min(F.struct((F.coalesce("value", F.lit(0.0)) - F.col("score")).alias("s"), "candidate"))["candidate"].alias("c"))
    stable = left.join(top.select(key, "winner"), key).groupBy(key).agg(F.avg(F.when(F.col("c") == F.col("winner"), 1.0).otherwise(0.0)).alias("stability"))
    out = proposal.join(top, key, "left").join(stable, key, "left").na.fill(0.0, ["score", "second", "stability"]).withColumn("margin", F.col("score") - F.col("second"))
    weak = (F.col("score") < least) | (F.col("margin") < margin) | (F.col("stability") < stability)
    agrees = F.col("winner") == F.col("proposal")
    status = (
        F.when(F.col("winner").isNull(), "insufficient_evidence").when(F.col("protected"), F.when(agrees, "verified").otherwise("protected_explicit"))
        .when(~agrees, "challenged").when(weak, "fragile").otherwise("verified")
    )
    return out.select(key, "winner", "score", "margin", F.round("stability", 6).alias("stability"), status.alias("status"))


def global_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their rank from 1 on in the order of all of them. Ranges are dealt to tasks, sorted there and counted, so that no task sees all rows; the
    driver holds a count per range. Rows of equal order must be told apart by it."""
    dealt = held(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # the upper bits are the task, the lower ones the place in it
    task = F.shiftright("_at", 33)
    sizes = sorted((r["t"], r["n"]) for r in dealt.groupBy(task.alias("t")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for t, n in sizes:
        before.append((t, total))
        total += n
    offsets = dealt.sparkSession.createDataFrame(before, "_t long, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(offsets), task == F.col("_t")).withColumn(name, F.col("_before") + place).drop("_at", "_t", "_before")
