"""URL filters: rules by host and path, and host reputations by empirical Bayes, with DataFrame functions only.

1. Host, path and rule come from the url alone; pages go to a narrow table with their labelled outcome, if they have one.
2. Outcomes are summed by host, hosts by registered domain, domains by suffix.
3. A suffix's rate of bad pages is shrunk towards the corpus rate, a domain's towards its suffix's, a host's towards its
   domain's, each by a beta prior whose size is fitted to the spread of rates inside the parents beyond what binomial
   sampling gives (method of moments). Hosts that agree with their domain get a strong prior, hosts that differ a weak one.
4. A host is blocked when the lower bound of its posterior rate exceeds the corpus rate by a factor: few labels leave the
   bound low, whatever their rate. A page gets its rule's verdict, or else its host's.

Sums are made before shuffles, so a host with a third of the pages is one row a task. Hosts are joined back to pages by an
equi-join, which Spark splits where a host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lower_ascii

#: Rules of the query: a host with a path, and the verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Standard deviations between the posterior mean and its lower bound: nineteen of twenty rates lie above it.
BOUND = 1.645
#: A host is blocked when its lower bound exceeds the corpus rate by this factor.
FACTOR = 1.1
#: Bounds of the size of a prior, in pages.
LEAST_PRIOR, LARGEST_PRIOR = 1.0, 1e6
#: Second-level names that are part of a suffix below a country's two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
PLACES = 9


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def url_name(host: Column) -> Column:
    """A host's name without user, port and last dots."""
    return F.rtrim(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*\z", ""), F.lit("."))


def url_suffix(name: Column) -> Column:
    """The last label, or the last two below a country (``co.uk``); addresses are suffixes of their own kind."""
    two = F.regexp_extract(name, rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})\z", 1)
    address = name.rlike(r"^[0-9.]+\z") | name.startswith("[")
    return F.when(address, F.lit("address")).when(two != "", two).otherwise(F.substring_index(name, ".", -1))


def url_domain(name: Column, suffix: Column) -> Column:
    """The suffix with one more label: what an owner registers; an address or a bare suffix is its own."""
    label = F.substring_index(F.substring(name, F.lit(1), F.greatest(F.length(name) - F.length(suffix) - 1, F.lit(0))), ".", -1)
    return F.when(suffix == "address", name).when(label == "", suffix).otherwise(F.concat(label, F.lit("."), suffix))


def with_domains(hosts: DataFrame) -> DataFrame:
    """Adds suffix and domain of the column host."""
    named = hosts.withColumn("_name", url_name(F.col("host"))).withColumn("suffix", url_suffix(F.col("_name")))
    return named.withColumn("domain", url_domain(F.col("_name"), F.col("suffix"))).drop("_name")


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(rule, verdict) of the longest rule whose host is the host or a parent of it and whose path starts the path, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The last ``when`` stands outermost, so the longest rule decides.
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def prior_sizes(children: DataFrame, parent: str) -> float:
    """Size of the beta prior of children around their parents' rates: from columns ``parent``, n and k (bad ones of n).

    Without a parent of several children, or without spread beyond sampling, the largest size.
    """
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    own = children.where("n > 0").groupBy(parent).agg(
        F.count("*").alias("c"), F.sum(n).alias("N"), F.sum(k).alias("K"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk")
    )
    rate = F.col("K") / F.col("N")
    sums = own.agg(
        F.sum(F.col("kk") - F.col("K") * rate - (F.col("c") - 1) * rate * (1 - rate)).alias("spread"),
        F.sum((F.col("N") - F.col("nn") / F.col("N") - (F.col("c") - 1)) * rate * (1 - rate)).alias("room"),
    ).first()  # two numbers
    share = sums["spread"] / sums["room"] if sums["room"] and sums["room"] > 1e-12 else 0.0
    return min(max(1 / max(share, 1e-9) - 1, LEAST_PRIOR), LARGEST_PRIOR)


def reputations(
    outcomes: DataFrame, *, bound: float = BOUND, factor: float = FACTOR, scratch: Scratch | None = None
) -> DataFrame:
    """One row a host: host, domain, suffix, n, k, rates of all levels, lower bound, corpus rate, host_blocked.

    ``outcomes``: host, and bad (boolean, null without a label). A host without labels has the posterior of its domain. The
    empty host has no reputation and is not blocked.
    """
    scratch = scratch or Scratch(outcomes.sparkSession)
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("k"))
    hosts = scratch.save(with_domains(hosts), "hosts")
    known = hosts.where("host <> ''")
    sums = F.sum("n").alias("n"), F.sum("k").alias("k")
    domains = scratch.save(known.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = scratch.save(domains.groupBy("suffix").agg(*sums).withColumn("all", F.lit(0)), "suffixes")
    n, k = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    corpus = k / n if n else 0.0
    sizes = prior_sizes(suffixes, "all"), prior_sizes(domains, "suffix"), prior_sizes(known, "domain")

    def shrunk(towards: Column, size: float) -> Column:
        return F.round((F.col("k") + towards * F.lit(size)) / (F.col("n") + F.lit(size)), PLACES)

    suffixes = suffixes.select("suffix", shrunk(F.lit(corpus), sizes[0]).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix_rate", shrunk(F.col("suffix_rate"), sizes[1]).alias("domain_rate"))
    rated = hosts.join(scratch.save(domains, "rated"), "domain", "left").withColumn("host_rate", shrunk(F.col("domain_rate"), sizes[2]))
    mean, total = F.col("host_rate"), F.col("n") + F.lit(sizes[2])
    lower = F.round(F.greatest(F.lit(0.0), mean - F.lit(bound) * F.sqrt(mean * (1 - mean) / (total + 1))), 6)
    rated = rated.withColumns({"rate_bound": lower, "corpus_rate": F.lit(round(corpus, 6))})
    blocked = F.coalesce((F.col("host") != "") & (F.col("rate_bound") > F.lit(round(corpus, 6) * factor)), F.lit(False))
    return rated.select(
        "host", "domain", "suffix", "n", "k", F.round("suffix_rate", 6).alias("suffix_rate"), F.round("domain_rate", 6).alias("domain_rate"),
        F.round("host_rate", 6).alias("host_rate"), "rate_bound", "corpus_rate", blocked.alias("host_blocked"),
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    *,
    rules: tuple[tuple[str, str], ...] = RULES,
    page_id: str = "page_id",
    url: str = "url",
    bound: float = BOUND,
    factor: float = FACTOR,
) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, and the figures of its host.

    ``labels``: page_id and bad (boolean) of labelled pages; a page is bad if one of its labels says so. Rules are a few
    hundred at most, as they become one expression; of two that fit, the longest wins, of equal length the last by name.

    A null url, or one without ``://``, has an empty host and path: it fits no rule and is allowed, as there is no host to
    judge. A null page_id has no label. Null labels are none. Repeated pages count each. Without labels nothing is blocked but
    by rules. An empty table gives an empty table. Other columns play no part.
    """
    scratch = Scratch(pages.sparkSession)
    p = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    given = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
    p = p.join(given, "page_id", "left").withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    p = scratch.save(p, "pages")
    hosts = scratch.save(reputations(p, bound=bound, factor=factor, scratch=scratch), "reputations")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("host_blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return p.join(hosts.withColumnsRenamed({"n": "host_labels", "k": "host_bad"}), "host").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "host_labels", "host_bad",
        "host_rate", "rate_bound", "corpus_rate", "host_blocked",
    )
