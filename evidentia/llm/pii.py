"""Personal data: seed entities by rule, further identifiers by bootstrapped contexts.

Rules find emails, IP addresses, card and phone numbers. Each seed, and each other word that has the look of an identifier, stands in patterns: the
word before it, the two before it, the one after it, and those on both sides. Patterns and identifiers form a graph that Spark scores iteratively: a
pattern is as reliable as the share of its occurrences that are trusted identifiers, an identifier as trusted as the best reliable pattern that it
occurs in, so that discovered identifiers induce patterns of their own in the next round. Unseen identifiers in reliable patterns are reported, with
the kind that the pattern's trusted identifiers mostly have.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, tune

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; a pattern's least score and distinct trusted identifiers to be believed.
ROUNDS, RELIABLE, SEEDS = 3, 0.8, 5
#: Discovered spans that are broadcast at most; more are joined by row.
BROADCAST = 50_000
#: Trust and scores are whole millionths, so that sums do not depend on the order of rows.
WHOLE = 1_000_000
SPANS = "array<struct<kind:string,start:long,end:long>>"

_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9]){15,}")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_IDENTIFIER = re.compile(rb"(?<![^\x20\x09-\x0D(\[<\"'])(?=[^\x20\x09-\x0D]{0,32}[0-9])[A-Za-z0-9][A-Za-z0-9@._+/-]{4,30}[A-Za-z0-9](?![^\x20\x09-\x0D.,;:!?)\]>\"'])")
_DIGIT = re.compile(rb"[0-9]")
_RUN = re.compile(rb"[^\x20\x09-\x0D]+")
_MARKS = b".,;:!?()[]<>\"'"
#: Characters by which a word of a context counts: those nearest to the identifier.
NEAR = 40


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: bytes):
    """Spans of local@domain. A local part is the run before an @, from the last match on; the run cannot hold another @."""
    end = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        before = text[max(end, text.rfind(b"@", end, at) + 1) : at]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            end = m.end()
            yield at - local, end


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind and then by start."""
    found = [(0, a, b) for a, b in emails(text)] if b"@" in text else []
    if _DIGIT.search(text):
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip(b"0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].translate(None, b" -")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if b"+" in text:
            found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(m[0].translate(None, b" ().+-")) <= 15]
    return found


class _Words:
    """Words around places of a text, found once for all of them.

    A word is a run without white space, up to the place that is asked for, without marks at its edges, A-Z folded; marks alone are none. It counts by its
    NEAR characters that are nearest to the place.
    """

    def __init__(self, text: bytes):
        self.text = text
        self.spans = [m.span() for m in _RUN.finditer(text)]
        self.starts = [a for a, _ in self.spans]

    def before(self, place: int, n: int) -> list[str]:
        """The n words that end before the place, or fewer, in order."""
        found, k = [], bisect_left(self.starts, place) - 1
        while k >= 0 and len(found) < n:
            a, b = self.spans[k]
            b = min(b, place)
            if word := self.text[max(a, b - 4 * NEAR - 64) : b].strip(_MARKS).lower():
                found.append(word.decode("utf-8", "ignore")[-NEAR:])
            k -= 1
        return found[::-1]

    def after(self, place: int) -> list[str]:
        """The word that begins after the place, if any."""
        k = max(0, bisect_right(self.starts, place) - 1)
        while k < len(self.spans):
            a, b = self.spans[k]
            a = max(a, place)
            if a < b and (word := self.text[a : min(b, a + 4 * NEAR + 64)].strip(_MARKS).lower()):
                return [word.decode("utf-8", "ignore")[:NEAR]]
            k += 1
        return []


def _patterns(words: _Words, start: int, end: int) -> list[str]:
    """Patterns of the span: one and two words to the left, one to the right, one on each side."""
    left, right = words.before(start, 2), words.after(end)
    sides = [(left[-1:], []), (left if len(left) == 2 else [], []), ([], right), (left[-1:] if right else [], right if left else [])]
    return [" ".join(a) + " _ " + " ".join(b) for a, b in sides if a or b]


def _extract(batches):
    """(key, spans, contexts) of each text."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    context = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans, contexts = [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            text = text or b""
            found = base_spans(text)
            place = (lambda a: a) if text.isascii() else (lambda a, t=text: len(t[:a].decode("utf-8", "ignore")))
            rows = [(KINDS[k], a, b, place(a), place(b)) for k, a, b in found]
            other = []
            if _DIGIT.search(text):
                for m in _IDENTIFIER.finditer(text):
                    if len(_DIGIT.findall(m[0])) >= 4 and all(m.end() <= a or m.start() >= b for _, a, b in found):
                        other.append((None, *m.span(), place(m.start()), place(m.end())))
            spans.append([{"kind": k, "start": a, "end": b} for k, _, _, a, b in rows])
            words = _Words(text) if rows or other else None
            contexts.append([{"pattern": p, "instance": text[a:b].decode("utf-8", "replace"), "kind": k, "start": s, "end": e} for k, a, b, s, e in rows + other for p in _patterns(words, a, b)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span), pa.array(contexts, context)], ["key", "spans", "contexts"])


def score_patterns(graph: DataFrame, rounds: int = ROUNDS, reliable: float = RELIABLE, seeds: int = SEEDS) -> DataFrame:
    """(pattern, score, kind) of reliable patterns of the pattern-instance graph (pattern, instance, kind, n); kind is null for unseen identifiers.

    Seeds keep trust 1 and their kind. A pattern's score is the trusted share of its occurrences, with one distrusted added; it is reliable from
    `reliable` on, given `seeds` distinct trusted identifiers. Another identifier has the trust and kind of its best reliable pattern. Patterns without
    a seed stay in the graph: identifiers that a round trusts can make them reliable in the next.
    """
    graph = materialise(graph)
    edges = materialise(graph.groupBy("pattern", "instance").agg(F.sum("n").alias("n")))
    ruled = graph.filter("kind is not null").groupBy("instance", "kind").agg(F.sum("n").alias("k"))
    ruled = materialise(ruled.groupBy("instance").agg(F.max_by("kind", F.struct("k", "kind")).alias("kind")).withColumn("trust", F.lit(WHOLE).cast("long")))
    trusted = ruled
    for k in range(rounds):
        known = edges.join(trusted, "instance", "left").groupBy("pattern", "kind").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * F.col("trust")), F.lit(0)).alias("t"), F.count("trust").alias("ids"))
        kind = F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("t", "kind"))).alias("kind")
        scores = known.groupBy("pattern").agg(F.expr("sum(t) div (sum(n) + 1)").alias("score"), F.sum("ids").alias("ids"), kind)
        good = scores.filter((F.col("score") >= round(reliable * WHOLE)) & (F.col("ids") >= seeds))
        if k + 1 < rounds:
            best = edges.join(good, "pattern").groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b"))
            found = best.join(ruled, "instance", "left_anti").select("instance", "b.kind", F.col("b.score").alias("trust"))
            trusted = ruled.unionByName(found)
    return good.select("pattern", (F.col("score") / WHOLE).alias("score"), "kind")


def find_personal_data(docs: DataFrame, text_col: str = "text", reliable: float = RELIABLE, seeds: int = SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """docs with spans (by rule) and more (discovered): arrays of (kind, start, end), code points, end exclusive.

    spans are by kind and then by start. A null or empty text has none. Every row stays, repeated ones too; an empty table gives an empty result;
    columns of docs named spans or more are replaced.
    """
    tune(docs.sparkSession)
    docs = docs.drop("spans", "more")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = keyed.schema["row"].dataType.simpleString()
    found = materialise(map_batches(keyed, _extract, f"key {kind}, spans {SPANS}, contexts array<struct<pattern:string,instance:string,kind:string,start:long,end:long>>").withColumn("id", F.monotonically_increasing_id()))
    seen = found.select("id", F.explode("contexts").alias("c")).select("id", "c.*")
    graph = seen.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))
    good = score_patterns(graph, rounds, reliable, seeds).select("pattern", "score", F.col("kind").alias("of"))
    more = seen.filter("kind is null").join(good, "pattern").groupBy("id", "start", "end").agg(F.max(F.struct("score", "of"))["of"].alias("of"))
    more = more.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "of"))).alias("more")).select("id", F.expr("transform(more, m -> struct(m.of as kind, m.start as start, m.end as end))").alias("more"))
    more = materialise(more)
    few = (more.agg(F.sum(F.size("more"))).first()[0] or 0) <= BROADCAST
    out = found.select("id", "key", "spans").join(F.broadcast(more) if few else more, "id", "left")
    return out.select("key.*", "spans", F.coalesce("more", F.expr(f"cast(array() as {SPANS})")).alias("more"))


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; all other columns stay as they are, whatever their names."""
    names = docs.columns
    found = find_personal_data(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("text")), "text", **options)
    text = F.col("row")[text_col].cast("string")
    cut = F.array_sort(F.concat("spans", "more"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]).cast("int"))
    found = found.select("row", text.alias("text"), cut.alias("cut"))
    text = F.col("text")
    built = F.aggregate(
        "cut",
        F.struct(F.lit("").alias("made"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(s["made"].alias("made"), F.greatest(s["at"], x["end"]).alias("at"))).otherwise(
            F.struct(F.concat(s["made"], F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("made"), x["end"].alias("at"))
        ),
        lambda s: F.concat(s["made"], F.substring(text, s["at"].cast("int") + 1, F.length(text))),
    )
    made = F.when(F.size("cut") == 0, text).otherwise(built)
    return found.select(*[made.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])
