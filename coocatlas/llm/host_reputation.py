"""Host reputation by empirical Bayes over host, registered domain and public suffix.

Labelled page outcomes are counted per host, then rolled up to registered domain, suffix
and the whole table. A level's beta prior is centred on the posterior mean of the level
above it; its strength is fitted by moments to how much the groups of that level really
differ. A host with few or no labels is thus judged by its domain, an unseen domain by its
suffix. The verdict compares a lower posterior bound with a floor, and stated rules override it.

Counts are combined before any shuffle and each level is written once. A host, domain or
suffix that holds a third of all rows meets its one posterior by broadcast.

Defined results: null urls, and those without ``://``, share an empty host and an empty path; null labels are ignored; repeated pages each get a row and each
count as an outcome; with no labels at all the prior mean is ``Reputation.prior_mean``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coocatlas.llm.ordering import lookup
from coocatlas.llm.tables import staged

#: Second-level labels that, below a two-letter country code, belong to the suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class Reputation:
    """``z`` normal quantiles below the posterior mean must reach ``floor`` for a page to be allowed."""

    floor: float = 0.5
    z: float = 1.645
    prior_mean: float = 0.5
    prior_weight: float = 2.0
    weakest: float = 1.0
    strongest: float = 1000.0


def host_of(url: Column) -> Column:
    found = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.when(F.instr(url, "://") > 0, _lower(found)), F.lit(""))


def path_of(url: Column) -> Column:
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(F.instr(url, "://") > 0, found), F.lit(""))


def _after_scheme(url: Column) -> Column:
    return url.substr(F.instr(url, "://") + 3, F.length(url))


def _lower(text: Column) -> Column:
    """ASCII lower case only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def suffix_of(host: Column) -> Column:
    """Last label, or the last two under a country code such as ``co.uk``."""
    last, second = F.substring_index(host, ".", -1), F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    country = (F.length(last) == 2) & second.isin(*SECOND_LEVEL) & (F.instr(host, ".") > 0)
    return F.when(country, F.substring_index(host, ".", -2)).otherwise(last)


def domain_of(host: Column) -> Column:
    """One label more than the suffix: the registered domain."""
    longer = F.substring_index(host, ".", -3)
    return F.when(F.instr(suffix_of(host), ".") > 0, longer).otherwise(F.substring_index(host, ".", -2))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        on_host = (host == rule.host) | host.endswith(f".{rule.host}")
        fits = on_host & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def group_posteriors(outcomes: DataFrame, hosts: DataFrame, settings: Reputation = Reputation()) -> DataFrame:
    """Posterior mean and weight of every host in ``hosts``.

    ``outcomes``: host, good (0/1, null ignored). ``hosts``: host, distinct or not.
    Returns host, posterior_mean, posterior_weight, bound; one row per distinct host.
    """
    counted = outcomes.where("good IS NOT NULL").groupBy("host").agg(
        F.sum(F.col("good").cast("bigint")).alias("k"), F.count("*").alias("n"))
    every = hosts.select("host").distinct().join(counted, "host", "left").fillna(0, ["k", "n"])
    # each level's counts are written once and read by the levels below
    levels = staged(every.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "k", "n"), "host-counts")
    domains = staged(levels.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "domain-counts")
    suffixes = staged(domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "suffix-counts")
    k, n = suffixes.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).head()
    root = (k + settings.prior_mean * settings.prior_weight) / (n + settings.prior_weight)
    above = _posterior(suffixes.withColumn("mean", F.lit(float(root))), settings).select(
        "suffix", F.col("posterior_mean").alias("mean"))
    domains = staged(lookup(domains, ["suffix"], staged(above, "suffix-means")), "domain-priors")
    above = _posterior(domains, settings).select("domain", F.col("posterior_mean").alias("mean"))
    named = staged(lookup(levels, ["domain"], staged(above, "domain-means")), "host-priors")
    return _posterior(named, settings).select("host", "posterior_mean", "posterior_weight", "bound")


def _posterior(groups: DataFrame, settings: Reputation) -> DataFrame:
    """Shrink k of n in each group towards ``mean``, with one strength fitted over all groups.

    Moments: with prior strength s, the expected squared error of k/n around its mean, times
    n, is m(1-m)(1 + (n-1)/(s+1)). Summed over groups this gives 1/(s+1). ``groups`` is a
    written table; two sums of it reach the driver.
    """
    spread = F.col("mean") * (1 - F.col("mean"))
    seen = F.col("n") > 0
    over, room = groups.agg(
        F.sum(F.when(seen, F.pow(F.col("k") - F.col("n") * F.col("mean"), 2) / F.col("n") - spread)),
        F.sum(F.when(seen, spread * (F.col("n") - 1))),
    ).head()
    share = over / room if room is not None and room > 0 else 0.0
    strength = 1 / max(1 / (settings.strongest + 1), min(1 / (settings.weakest + 1), share)) - 1
    weight = F.col("n") + F.lit(float(strength))
    mean = (F.col("k") + F.lit(float(strength)) * F.col("mean")) / weight
    out = groups.withColumns({"posterior_mean": mean, "posterior_weight": weight})
    sd = F.sqrt(F.col("posterior_mean") * (1 - F.col("posterior_mean")) / (F.col("posterior_weight") + 1))
    return out.withColumn("bound", F.col("posterior_mean") - settings.z * sd)


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = (), settings: Reputation = Reputation()) -> DataFrame:
    """Every page with its host, path, fitting rule, posterior and verdict.

    ``pages``: page_id, url. ``outcomes``: url, good. Other columns are ignored.
    """
    placed = staged(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "placed")
    seen = outcomes.select(host_of(F.col("url")).alias("host"), "good")
    groups = staged(group_posteriors(seen, placed, settings), "hosts")
    judged = lookup(placed, ["host"], groups).withColumn("m", matching_rule(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("bound") >= settings.floor, "allow").otherwise("block")
    return judged.select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", learned).alias("verdict"),
        "posterior_mean", "bound",
    )
