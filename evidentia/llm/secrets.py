"""Secret scans with an incremental blob ledger.

Every version of every path is named after the SHA-256 of its text. A ledger keeps, per blob, which rules in which versions it was scanned with and
what was found by which of them. A run scans only blobs with a rule version that the ledger lacks, each once per task, merges what it found into the
ledger, and joins findings of current rule versions back to all paths by blob. Texts are scanned where they are read; only digests and findings are
shuffled.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, tune


@dataclass(frozen=True)
class Rule:
    """kind: a name. pattern: ASCII, applied leftmost and non-overlapping. least: characters of `group`; matches with fewer are dropped.
    hints: lower-case strings of which a match has one, letters in either case; () if unknown."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    either_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        """kind and a digest of the whole definition: any change is a new version."""
        return f"{self.kind}@{hashlib.sha256(repr(self).encode()).hexdigest()[:12]}"


#: Fixed by contract, in this order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hints=("akia",)),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Further shapes of credentials.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", hints=("-----begin ",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("url", r"://[A-Za-z0-9._-]{1,64}:[^\x00-\x20@/:]{6,64}@", hints=("://",)),
)
RULES = BASE + MORE
#: In the ledger, a finding has the rule version that it is by; joined back to paths, only its kind.
FINDINGS = "array<struct<version:string,kind:string,start:long,end:long>>"
SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob string, scanned array<string>, findings {FINDINGS}"
_HEX = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = []
        for k, r in enumerate(rules):
            # runs of one class are found by their least length, which gives the same runs
            pattern = "[0-9a-f]{%d,}" % r.least if r.pattern == "[0-9a-f]+" else r.pattern
            self.rules.append((k, r, re.compile(pattern.encode(), re.IGNORECASE if r.either_case else 0), tuple(h.encode() for h in r.hints)))

    def scan(self, text: bytes) -> list[tuple[Rule, int, int]]:
        """(rule, start, end) by start, then by rule; code points, end exclusive."""
        low, found = text.lower(), []
        for k, r, pattern, hints in self.rules:
            if r.pattern == "[0-9a-f]+":
                if b"h" * r.least not in text.translate(_HEX):
                    continue
            elif hints and not any(h in low for h in hints):
                continue
            found += [(*m.span(), k) for m in pattern.finditer(text) if len(m[r.group]) >= r.least]
        if found and not text.isascii():
            found = [(len(text[:a].decode()), len(text[:b].decode()), k) for a, b, k in found]
        return [(self.rules[k][1], a, b) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _scan(rules: tuple[Rule, ...]):
    def run(batches):
        by_rules: dict[tuple[str, ...], Scanner] = {}
        versions = {r.version: r for r in rules}
        seen: set[bytes] = set()
        for batch in batches:
            blobs, scanned, found = [], [], []
            for blob, text, todo in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (key := bytes.fromhex(blob)) in seen:
                    continue
                seen.add(key)
                scanner = by_rules.get(own := tuple(todo))
                if scanner is None:
                    scanner = by_rules[own] = Scanner(tuple(r for v, r in versions.items() if v in todo))
                blobs.append(blob)
                scanned.append(todo)
                found.append([{"version": r.version, "kind": r.kind, "start": a, "end": b} for r, a, b in scanner.scan(text)])
            kind = pa.list_(pa.struct([("version", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(scanned, pa.list_(pa.string())), pa.array(found, kind)], ["blob", "scanned", "findings"])

    return run


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, scanned, findings) for what the ledger lacks; one for each blob, for the rule versions it was not scanned with."""
    tune(versions.sparkSession)
    wanted = F.array(*[F.lit(r.version) for r in rules])
    texts = versions.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(F.sha2("text", 256).alias("blob"), "text")
    if ledger is None:
        texts = texts.withColumn("todo", wanted)
    else:
        held = ledger.select("blob", F.explode("scanned").alias("s")).groupBy("blob").agg(F.collect_set("s").alias("scanned"))
        todo = texts.select("blob").distinct().join(held, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("scanned", F.expr("array()"))).alias("todo"))
        texts = texts.join(todo.filter(F.size("todo") > 0), "blob").select("blob", "text", "todo")
    found = map_batches(texts, _scan(rules), LEDGER)
    # several tasks can hold copies of a blob; their rows are equal
    return found.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.first("findings").alias("findings"))


def merge(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with rows that a run added: one row for each blob, with all rule versions that it was scanned with and all their findings.

    A blob that both sides scanned with the same version keeps its findings once, whatever was merged before.
    """
    both = ledger.select("blob", "scanned", "findings").unionByName(new.select("blob", "scanned", "findings"))
    merged = both.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("scanned")))).alias("scanned"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("findings")))).alias("findings"))
    return merged.select("blob", "scanned", "findings")


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """versions without its text, with blob and findings of the given rules in their present versions, by start and then by rule.

    Findings that the ledger has by other rules, or by former versions of these, are left out. A null text counts as empty; a text without findings has
    an empty array; repeated rows stay; an empty table gives an empty result. Columns of versions named blob or findings are replaced.
    """
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.version), F.lit(k))])
    kept = ledger.select("blob", F.explode("findings").alias("f")).filter(F.col("f.version").isin([r.version for r in rules]))
    kept = kept.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(F.col("f.start").alias("start"), order[F.col("f.version")].alias("k"), F.col("f.kind").alias("kind"), F.col("f.end").alias("end")))).alias("found"))
    texts = versions.withColumn("blob", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).drop(text_col, "findings")
    kept = kept.select("blob", F.expr("transform(found, f -> struct(f.kind as kind, f.start as start, f.end as end))").alias("findings"))
    # written, so that the join's two sides are plain shuffles and a blob of many paths can be split
    return texts.join(materialise(kept), "blob", "left").withColumn("findings", F.coalesce("findings", F.expr(f"cast(array() as {SPANS})")))
