"""Host reputation by empirical Bayes, in built-in expressions.

Labelled pages count as good or bad. Rates are shrunk from the top down: the suffix towards all pages, the registered
domain towards its suffix, the host towards its domain. Each prior is a beta distribution with the mean of the level above
and a strength taken from how much the level's own rates differ. A host is blocked if its bad rate lies above the limit
even at the lower bound of the posterior.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut


#: Labels under which country registries sell names.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "nom", "or", "org", "sch")


@dataclass(frozen=True)
class HostConfig:
    """Bad rate that the posterior bound is held against, its distance in standard deviations, limits of the prior strength,
    and suffixes of two labels: one of `second` under a country's two letters (all of com.br or gov.uk is no one domain), and any in
    `suffixes`. These lists and the rules are short and become part of the expressions."""

    limit: float = 0.5
    deviations: float = 2.0
    least_strength: float = 1.0
    most_strength: float = 100.0
    second: tuple[str, ...] = SECOND_LABELS
    suffixes: tuple[str, ...] = ()


#: Rules as (verdict, host, path prefix).
Rules = list[tuple[str, str, str]]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does. Of equal length the first by text wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    pick = lambda k: F.coalesce(*[F.when(ok, F.lit(k(r))) for ok, r in zip(fits, ordered)], F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def _two_labels(host: Column, cfg: HostConfig) -> Column:
    """The last two labels are a suffix."""
    two = F.substring_index(host, ".", -2)
    return two.rlike(rf"^(?:{'|'.join(map(re.escape, cfg.second))})\.[a-z][a-z]\z") | two.isin(*cfg.suffixes)


def suffix_of(host: Column, cfg: HostConfig) -> Column:
    return F.when(_two_labels(host, cfg), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, cfg: HostConfig) -> Column:
    """One label more than the suffix; the host itself if it has no more."""
    return F.when(_two_labels(host, cfg), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _posterior(level: DataFrame, prior: Column, cfg: HostConfig) -> DataFrame:
    """`level` with `rate` and `strength`: posterior mean of the bad rate, and the weight of prior and pages together.

    The strength of the prior is the same for the whole level. By moments: if rates differ from their priors as much as
    pages of a common rate would, the prior is as strong as allowed; the more they differ beyond, the weaker.
    """
    n = F.col("bad") + F.col("good")
    terms = level.withColumn("prior", prior).filter(n > 1).agg(
        F.sum(n * F.pow(F.col("bad") / n - F.col("prior"), 2)).alias("spread"),
        F.sum(F.col("prior") * (1 - F.col("prior"))).alias("noise"),
        F.sum((n - 1) * F.col("prior") * (1 - F.col("prior"))).alias("scale"),
    ).first()
    strength = cfg.most_strength
    if terms["spread"] and terms["scale"]:
        # E[spread] = noise + scale * share, share = 1 / (strength + 1)
        share = max(0.0, terms["spread"] - terms["noise"]) / terms["scale"]
        strength = min(cfg.most_strength, max(cfg.least_strength, 1 / share - 1 if share > 0 else cfg.most_strength))
    return level.withColumn("rate", (F.col("bad") + strength * prior) / (n + strength)).withColumn("strength", n + strength)


def reputations(outcomes: DataFrame, cfg: HostConfig = HostConfig()) -> DataFrame:
    """`host`, `rate`, `bound`, `blocked` for every host of (`host`, `bad`), `bad` null where a page has no label.

    Hosts are counted before anything else moves, so a host of any number of pages is one row from then on. Levels above
    are sums of those rows.
    """
    bad = F.col("bad")
    hosts = cut(
        outcomes.groupBy("host")
        .agg(F.count(F.when(bad, 1)).alias("bad"), F.count(F.when(~bad, 1)).alias("good"))
        .withColumns({"domain": domain_of(F.col("host"), cfg), "suffix": suffix_of(F.col("host"), cfg)})
    )
    sums = [F.sum("bad").alias("bad"), F.sum("good").alias("good")]
    domains = cut(hosts.groupBy("suffix", "domain").agg(*sums))
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(*sums).first()
    start = ((whole["bad"] or 0) + 1) / ((whole["bad"] or 0) + (whole["good"] or 0) + 2)
    suffixes = cut(_posterior(suffixes, F.lit(start), cfg))
    over = F.col("over")
    domains = domains.join(suffixes.select("suffix", F.col("rate").alias("over")), "suffix")
    domains = cut(_posterior(cut(domains), over, cfg))
    hosts = hosts.join(domains.select("domain", "suffix", F.col("rate").alias("over")), ["domain", "suffix"])
    hosts = _posterior(cut(hosts), over, cfg)
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("strength") + 1))
    bound = F.col("rate") - cfg.deviations * deviation
    return hosts.select("host", "rate", bound.alias("bound"), (bound > cfg.limit).alias("blocked"))


def judged(pages: DataFrame, rules: Rules, cfg: HostConfig = HostConfig(), url_col: str = "url") -> DataFrame:
    """All columns of `pages` plus the struct `site`: `host`, `path`, `rule`, `verdict`, `rate`, `bound`.

    A page that a rule fits has the rule's verdict, and is a labelled outcome for its host: blocked is bad, allowed good. All
    others are judged by their host's posterior. A null url, or one without ://, has an empty host, which is a host like
    any other. Repeated pages count each time. A column `site` of `pages` is replaced.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "site"])
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    parsed = pages.select(row.alias("row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumns(
        {"rule": rule, "by_rule": by_rule}
    )
    known = reputations(parsed.select("host", (F.col("by_rule") == "block").alias("bad")), cfg)
    verdict = F.coalesce("by_rule", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return parsed.join(known, "host").select(
        "row.*", F.struct("host", "path", "rule", verdict.alias("verdict"), "rate", "bound").alias("site")
    )
