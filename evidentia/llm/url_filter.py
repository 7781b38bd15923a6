"""URL filters: host rules first, then empirical-Bayes host reputation. Column expressions only.

Labelled page outcomes are counted per host. A beta-binomial prior shrinks them from host to registered domain to suffix: each level's prior mean is the
posterior mean of the level above, its strength is estimated by moments from how much the groups of that level differ. A host is blocked where the lower
credible bound of its rate of bad pages, a quantile of its beta posterior, passes a limit, so that few labels alone block nothing. The quantile passes the
limit just where the posterior leaves less than that probability at or below it, which a continued fraction gives to rounding at any number of pages.

Counts per host are the only shuffle of pages; hosts with many pages are counted before it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, start of path); fixed by contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Block above this rate of bad pages, by the quantile of the posterior at this probability.
LIMIT, DOUBT = 0.5, 0.05
#: Public suffixes of two labels; all other suffixes are the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "com.br", "com.cn", "co.in", "co.za")
#: Strength of a prior where groups don't tell, and its bounds.
STRENGTH, WEAKEST, STRONGEST = 10.0, 1.0, 1000.0


@dataclass(frozen=True)
class Strengths:
    """Overall mean, and the priors' strengths for suffixes, domains and hosts."""

    mean: float
    suffix: float
    domain: float
    host: float


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?` or `#`, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`; empty without `://`."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def suffix_of(site: Column, suffixes=SUFFIXES) -> Column:
    """The public suffix: two labels if they are in the list, else the last; an address in numbers is its own."""
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(r"^[0-9.]+$"), site).when(two.isin(*suffixes) if suffixes else F.lit(False), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column, suffixes=SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it, if there is one."""
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(r"^[0-9.]+$"), site).when(two.isin(*suffixes) if suffixes else F.lit(False), F.substring_index(site, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. A rule is named by its host and path."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(groups: DataFrame, by: str | None, mean: float = 0.0) -> float:
    """Strength of the beta prior over groups (n, k) by the method of moments, around the mean of each `by`, or a given one; one row reaches the driver."""
    groups = groups.join(groups.groupBy(by).agg((F.sum("k") / F.sum("n")).alias("p")), by) if by else groups.withColumn("p", F.lit(mean))
    spread = groups.agg(
        F.sum(F.pow(F.col("k") / F.col("n") - F.col("p"), 2) * F.col("n")).alias("s"),
        F.sum(F.col("p") * (1 - F.col("p"))).alias("v1"),
        F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("vn"),
    ).first()
    # E[s] = v1 + rho * (vn - v1), where rho = 1 / (strength + 1)
    s, v1, vn = (spread[x] or 0.0 for x in ("s", "v1", "vn"))
    if vn - v1 <= 0:
        return STRENGTH
    rho = (s - v1) / (vn - v1)
    return STRONGEST if rho <= 0 else min(STRONGEST, max(WEAKEST, 1 / rho - 1))


def _stirling(z: Column) -> Column:
    """log gamma(z) less (z - 1/2) log z - z + log(2 pi) / 2; small z are raised by eight first."""
    series = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    raised = (z + 7.5) * F.log(z + 8) - 8 + series(z + 8) - F.log(product) - (z - 0.5) * F.log(z)
    return F.when(z < 16, raised).otherwise(series(z))


def beta_below(x: float, a: Column, b: Column) -> Column:
    """P(rate <= x) of a beta distribution with parameters a and b; 1 where a is 0, else 0 where b is.

    The continued fraction of the incomplete beta function, on the side where it converges fast; its steps grow with the root of a + b.
    """

    def fraction(x: float, a: Column, b: Column) -> Column:
        tiny = 1e-300
        safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

        def step(s: Column, m: Column) -> Column:
            def turn(c: Column, d: Column, t: Column) -> tuple[Column, Column]:
                return safe(1 + t / c), 1 / safe(1 + t * d)

            even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
            c, d = turn(s["c"], s["d"], even)
            first = F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

            def second(v: Column) -> Column:
                c, d = turn(v["c"], v["d"], odd)
                return F.struct(c.alias("c"), d.alias("d"), (v["h"] * c * d).alias("h"))

            return F.get(F.transform(F.array(first), second), F.lit(0))

        d = 1 / safe(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), (50 + 5 * F.sqrt(a + b)).cast("int")), start, step, lambda s: s["h"])

    n = a + b
    # the density's factor, by how far x is from the mean: no large numbers cancel
    factor = F.exp(-a * F.log(a / (n * x)) - b * F.log(b / (n * (1 - x))) + 0.5 * F.log(a * b / (n * 2 * math.pi)) + _stirling(n) - _stirling(a) - _stirling(b))
    left = F.lit(x) < (a + 1) / (n + 2)
    # one of the two sides, so that a row pays for one
    one, two = F.when(left, a).otherwise(b), F.when(left, b).otherwise(a)
    side = factor * F.when(left, fraction(x, one, two)).otherwise(fraction(1 - x, one, two)) / one
    return F.when(a <= 0, 1.0).when(b <= 0, 0.0).when(left, side).otherwise(1 - side)


def estimate(counts: DataFrame, suffixes=SUFFIXES) -> Strengths:
    """Hyperparameters from counts per host (host, n, k); k of n labelled pages are bad. Without labels: mean 0."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    if not total["n"]:
        return Strengths(0.0, STRENGTH, STRENGTH, STRENGTH)
    counts = counts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    mean = float(total["k"]) / total["n"]
    level = lambda *keys: counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return Strengths(mean, _strength(level("suffix"), None, mean), _strength(level("domain", "suffix"), "suffix"), _strength(level("host", "domain"), "domain"))


def reputation(counts: DataFrame, prior: Strengths, limit: float = LIMIT, suffixes=SUFFIXES) -> DataFrame:
    """(host, n, k, rate, below): posterior mean of each host's rate of bad pages, and the probability that it is at most the limit. n may be 0."""
    counts = counts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    shrunk = lambda mean, strength: (F.sum("k") + strength * mean) / (F.sum("n") + strength)
    of_suffix = counts.groupBy("suffix").agg(shrunk(F.lit(prior.mean), prior.suffix).alias("of_suffix"))
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(of_suffix, "suffix")
    domains = domains.select("domain", ((F.col("k") + prior.domain * F.col("of_suffix")) / (F.col("n") + prior.domain)).alias("of_domain"))
    a = F.col("k") + prior.host * F.col("of_domain")
    b = F.col("n") - F.col("k") + prior.host * (1 - F.col("of_domain"))
    post = counts.join(domains, "domain").select("host", "n", "k", a.alias("a"), b.alias("b"))
    return post.select("host", "n", "k", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), beta_below(limit, F.col("a"), F.col("b")).alias("below"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url", doubt: float = DOUBT, suffixes=SUFFIXES) -> DataFrame:
    """(id_col, host, path, rule, verdict) of each page.

    outcomes: (id_col, bad) of labelled pages, bad being 0 or 1; of several for a page the worst counts. A page that no rule fits is blocked if the
    quantile of its host's rate at `doubt` passes the limit; a host's pages count together whatever the port. Null urls and such without `://` have the
    empty host, which has a reputation like any other. Repeated pages stay; without outcomes nothing but rules blocks; an empty table gives an empty
    result; other columns are ignored.
    """
    cut = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("site", site_of(F.col("host")))
    worst = outcomes.select(F.col(id_col).alias("id"), F.col("bad").cast("long").alias("bad")).filter("id is not null and bad in (0, 1)").groupBy("id").agg(F.max("bad").alias("bad"))
    counts = materialise(cut.select("id", F.col("site").alias("host")).join(worst, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")))
    known = counts.filter("n > 0")
    sites = reputation(counts, estimate(known, suffixes), limit, suffixes).select(F.col("host").alias("site"), F.when(F.col("below") < doubt, "block").otherwise("allow").alias("method"))
    # written: its size is then known, and a host of many pages can be split where it is too large to broadcast
    judged = cut.join(materialise(sites), "site").withColumn("by", rule_for(F.col("host"), F.col("path"), rules))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", "method").alias("verdict"))
