"""URL filter: prefix rules, and empirical-Bayes reputation for the rest.

Every page url is split into host and path. A rule ``host/path`` fits its
host and all subdomains when the url's path starts with the rule's; the
longest fitting rule decides. Urls that no rule fits are decided by their
host's reputation: labelled page outcomes (``bad``) are counted per host and
shrunk through a chain of beta-binomial priors

    all pages -> suffix -> registered domain -> host,

each level's posterior mean being the prior mean of the next, with a prior
strength fitted to the spread of that level's rates. A host is blocked when
the lower bound of its posterior bad rate (mean - z * sd) exceeds
``max_rate``; a host with little evidence is held by its parents' prior.

DataFrame functions only. Pages are reduced to one row per host (combined
map-side, so a hot host leaves each task as one row); the verdict joins back
on host, broadcast only after its size was checked, else as a shuffle join
that AQE splits for a hot host.

Defined results: NULL url or no ``://``: host and path empty, no rule, the
verdict of the (empty) host. NULL outcomes: the page has no label. Repeated
rows count each. No pages: no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendlens.llm.common import beta_strength
from stipendlens.plans.joins import bounded_broadcast
from stipendlens.plans.lineage import cut_lineage

#: (verdict, rule); fixed values of the registered query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
MAX_RULES = 500
#: Suffixes of two labels under which names are registered; fixed values, a parameter of ``judge_urls``.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx",
            "com.sg", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.br", "org.uk")
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _name(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, r":[0-9]*\z", "")


def _two(name: Column, suffixes: Sequence[str]) -> Column:
    return F.substring_index(name, ".", -2).isin(*suffixes)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix: two labels where they are one of ``suffixes``, else the last."""
    name = _name(host)
    return F.when(_two(name, suffixes), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def registered_domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix and the label before it."""
    name = _name(host)
    return F.when(_two(name, suffixes), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]], want: str = "rule") -> Column:
    """The longest fitting rule (or its verdict) as one CASE, longest first.
    Rules are a parameter of at most ``MAX_RULES`` entries."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        value = F.lit(rule if want == "rule" else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def junk_page(html: Column) -> Column:
    """A page's outcome label where none is supplied: its visible text is
    mostly repeated words, symbols or capitals (NULL html: no label)."""
    text = F.regexp_replace(html, r"<(?:script|style)[^<]*|<[^>]*>|&[a-z]+;", " ")

    def junk(t: Column) -> Column:
        chars = F.length(t)
        repeated = _let(F.split(t, " +"), lambda w: F.size(F.array_distinct(w)) < 0.2 * F.size(w))
        return (F.regexp_count(t, F.lit("[#*$%|!]")) > 0.1 * chars) | (F.regexp_count(t, F.lit("[A-Z]")) > 0.4 * chars) | repeated

    return F.when(html.isNotNull(), _let(text, junk)).cast("int")


def host_reputation(outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``outcomes(host, bad)`` -> host, n_pages, n_bad, post_mean, post_lower."""
    hosts = cut_lineage(outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("bad").alias("n_bad")))
    hosts = hosts.withColumn("domain", registered_domain_of(F.col("host"), suffixes)).withColumn(
        "suffix", suffix_of(F.col("host"), suffixes))
    sums = [F.sum("n_pages").alias("n"), F.sum("n_bad").alias("x")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    mean, k_suffix = beta_strength(suffixes, "x", "n")
    _, k_domain = beta_strength(domains, "x", "n")
    _, k_host = beta_strength(hosts, "n_bad", "n_pages")

    def shrunk(x, n, prior, k):
        return (F.col(x) + prior * F.lit(k)) / (F.col(n) + F.lit(k))

    suffixes = suffixes.select("suffix", shrunk("x", "n", F.lit(mean), k_suffix).alias("suffix_mean"))
    domains = domains.join(bounded_broadcast(suffixes), "suffix").select(
        "domain", shrunk("x", "n", F.col("suffix_mean"), k_domain).alias("domain_mean"))
    a = F.col("n_bad") + F.col("domain_mean") * F.lit(k_host)
    total = F.col("n_pages") + F.lit(k_host)
    out = hosts.join(bounded_broadcast(domains), "domain").withColumn("post_mean", a / total)
    sd = F.sqrt(F.col("post_mean") * (1 - F.col("post_mean")) / (total + 1))
    return out.select("host", "n_pages", "n_bad", "post_mean",
                      F.greatest(F.lit(0.0), F.col("post_mean") - F.lit(z) * sd).alias("post_lower"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, outcome: Column | None = None,
               max_rate: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``pages(page_id, url, ...)`` -> page_id, host, path, rule, verdict.
    ``outcome`` is the column with a page's label (1 bad, 0 good, NULL none);
    by default a content rule over ``html``. ``suffixes`` are the public
    suffixes of two labels; a host's port is not part of its domain."""
    label = junk_page(F.col("html")) if outcome is None else outcome.cast("int")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = host_reputation(pages.select(host.alias("host"), label.alias("bad")), z, suffixes)
    bad_hosts = seen.filter(F.col("post_lower") > max_rate).select(F.col("host").alias("__bad_host"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    return split.join(bounded_broadcast(bad_hosts), h == F.col("__bad_host"), "left").select(
        "page_id", "host", "path", rule_of(h, p, rules).alias("rule"),
        F.coalesce(rule_of(h, p, rules, "verdict"),
                   F.when(F.col("__bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))
