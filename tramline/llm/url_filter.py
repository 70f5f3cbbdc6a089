"""URL filtering by rules and by empirical-Bayes host reputation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


# The rules of the production query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


# Second-level labels under which countries register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
_SUFFIX = rf"(?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]+)"
_ADDRESS = r"^([0-9.]+|\[.*)$"


def site_of(host: Column) -> Column:
    """A host without user, port and closing dots: whom a reputation belongs to."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:[0-9]*)?\.*$", "")


def registered_domain(site: Column) -> Column:
    """The suffix and the label before it; a numeric address is a domain of its own."""
    named = F.regexp_extract(site, rf"(?:^|\.)((?:[^.]+\.)?{_SUFFIX})$", 1)
    return F.when(site.rlike(_ADDRESS), site).otherwise(named)


def public_suffix(site: Column) -> Column:
    """The last label, or the last two where a country registers below them; of numeric addresses '#'."""
    named = F.regexp_extract(site, rf"(?:^|\.)({_SUFFIX})$", 1)
    return F.when(site.rlike(_ADDRESS), F.lit("#")).otherwise(named)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, ties to the earlier one; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.coalesce(out, F.when(fits, found))
    return out


def host_reputation(
    outcomes: DataFrame, hosts: DataFrame | None = None, min_strength: float = 1.0, max_strength: float = 1000.0
) -> DataFrame:
    """site, rep_good, rep_bad and seen: the beta posterior of each site's pages being good.

    outcomes has host and good (0 or 1); rows with a null in either, or an
    empty host, carry no evidence. Counts shrink along suffix, registered
    domain and site: each level's mean is (good + strength * parent's mean) /
    (n + strength). The strength of a level is fitted to the data by moments,
    from how far the means of its members spread around their parents' beyond
    binomial noise. A site of hosts without outcomes (seen 0) has the prior of
    a site: the strength of that level and the shrunken mean of its domain,
    else of its suffix, else of all. Without any outcomes there are no rows.
    """
    told = outcomes.select(site_of(F.col("host")).alias("site"), F.col("good").cast("double").alias("good"))
    told = told.where((F.col("site") != "") & F.col("good").isNotNull())
    counted = told.groupBy("site").agg(F.sum("good").alias("good"), F.count("*").alias("n"))
    if hosts is not None:
        met = hosts.select(site_of(F.col("host")).alias("site")).where("site <> ''").distinct()
        counted = met.join(counted, "site", "full_outer")
    named = counted.select(
        "site",
        registered_domain(F.col("site")).alias("domain"),
        public_suffix(F.col("site")).alias("suffix"),
        F.coalesce("good", F.lit(0.0)).alias("good"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    sites = materialize(named, "host-outcomes")
    domains = sites.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    root = suffixes.agg(F.when(F.sum("n") > 0, (F.sum("good") + 1) / (F.sum("n") + 2)).alias("m")).first()["m"]
    limits = (min_strength, max_strength)
    by_suffix = _shrunk(suffixes.withColumn("parent", F.lit(root).cast("double")), *limits)
    by_domain = _shrunk(domains.join(_mean(by_suffix.where("n > 0"), "suffix"), "suffix"), *limits)
    placed = sites.join(_mean(by_domain, "domain"), "domain")
    known = placed.withColumn("strength", F.lit(_strength(placed, *limits)).cast("double"))
    mass = F.col("parent") * F.col("strength")
    return known.select(
        "site",
        (F.col("good") + mass).alias("rep_good"),
        (F.col("n") - F.col("good") + F.col("strength") - mass).alias("rep_bad"),
        F.col("n").alias("seen"),
    )


def _strength(level: DataFrame, low: float, high: float) -> float | None:
    """The fitted strength of a level (good, n, parent)."""
    level = level.where("n > 0")
    m, n = F.col("parent"), F.col("n")
    spread = F.sum(n * F.pow(F.col("good") / n - m, 2))
    noise = F.sum(m * (1 - m))
    binomial = F.sum(n * m * (1 - m))
    # E[spread] = noise + (binomial - noise) / (strength + 1)
    strength = F.when(spread > noise, (binomial - noise) / (spread - noise) - 1).otherwise(F.lit(high))
    return level.agg(F.least(F.lit(high), F.greatest(F.lit(low), strength)).alias("s")).first()["s"]


def _shrunk(level: DataFrame, low: float, high: float) -> DataFrame:
    """level (good, n, parent) with its shrunken mean."""
    strength = F.lit(_strength(level, low, high)).cast("double")
    return level.withColumn("mean", (F.col("good") + F.col("parent") * strength) / (F.col("n") + strength))


def _mean(level: DataFrame, name: str) -> DataFrame:
    return level.select(name, F.col("mean").alias("parent"))


def posterior_bound(good: Column, bad: Column, z: float) -> Column:
    """Mean plus z standard deviations of a beta distribution, to six places."""
    mean, total = good / (good + bad), good + bad
    return F.round(mean + z * F.sqrt(mean * (1 - mean) / (total + 1)), 6)


def worst_share(bounds: DataFrame, share: float) -> float | None:
    """The least bound that at least share of the rows of bounds(bound) don't exceed; null without rows.

    From counts per bound, of which there are at most a million and one.
    """
    counts = bounds.groupBy("bound").agg(F.count("*").alias("n"))
    whole = Window.orderBy("bound")
    upto = F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = counts.select("bound", upto.alias("upto"), total.alias("total"))
    return placed.where(F.col("upto") >= share * F.col("total")).agg(F.min("bound").alias("cut")).first()["cut"]


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    share: float = 0.1,
    z: float = 1.645,
) -> DataFrame:
    """Judge every page: page_id, host, path, rule, verdict, bound.

    The longest fitting rule decides. Else the reputation of the host's site
    does: bound is the upper posterior bound of its share of good pages (mean
    plus z standard deviations). A page is blocked if that lies below the
    bound which the given share of the sites with outcomes don't exceed: the
    sites that are surely worse than others, whatever the general level. Sites
    without outcomes inherit, see host_reputation(); one that nothing is
    known of has a null bound and isn't blocked. outcomes has host and good.
    A null url, or one without ://, has empty host and path and a null bound.
    Repeated rows are judged each; an empty table stays empty; other columns
    are ignored.
    """
    url = F.col(url_col)
    placed = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    bound = posterior_bound(F.col("rep_good"), F.col("rep_bad"), z)
    known = materialize(host_reputation(outcomes, placed).select("site", "seen", bound.alias("bound")), "host-bounds")
    cut = worst_share(known.where("seen > 0").select("bound"), share)
    judged = (
        placed.withColumn("site", site_of(F.col("host")))
        .join(known.select("site", "bound"), "site", "left")
        .withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    )
    own = F.when(F.col("bound") < F.lit(cut).cast("double"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("match.rule").alias("rule"),
        F.coalesce("match.verdict", own).alias("verdict"),
        "bound",
    )
