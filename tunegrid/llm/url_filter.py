"""URL filters: fixed rules first, then empirical-Bayes reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrid.llm.common import staged

# Fixed values: (verdict, host, path) of the rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A host is blocked when the lower bound of its share of bad pages, Z deviations below the mean, exceeds LIMIT.
Z, LIMIT = 1.645, 0.5
#: Bounds of the within-group correlation, from which a prior's strength 1 / rho - 1 follows.
RHO = (0.001, 0.9)
# Labels that, before a country's two letters, belong to the suffix under which domains are registered.
SECOND = ["ac", "co", "com", "edu", "go", "gob", "gov", "govt", "mil", "ne", "net", "nom", "or", "org", "sch"]
_SUFFIX = rf"(?:{'|'.join(SECOND)})\.[a-z][a-z]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame, mean: str) -> Column:
    """1 / rho - 1 of a one-row moment estimate over groups (n, bad) around their parents' means."""
    p, m = F.col("bad") / F.col("n"), F.col(mean)
    spread, expected = F.sum(F.col("n") * (p - m) * (p - m)), F.sum(m * (1 - m))
    weight = F.sum((F.col("n") - 1) * m * (1 - m))
    rho = F.when(weight > 0, (spread - expected) / F.nullif(weight, F.lit(0.0))).otherwise(0.0)
    return level.agg((1 / F.greatest(F.lit(RHO[0]), F.least(F.lit(RHO[1]), F.coalesce(rho, F.lit(0.0)))) - 1).alias("strength"))


def host_reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors from outcomes (host, bad 0/1): (host, suffix, domain, alpha, beta) of labelled hosts, then the priors
    (domain, alpha, beta), (suffix, alpha, beta) and one row (alpha, beta) of hosts that have no labels.

    The share of bad pages of a suffix is shrunk to the overall share, of a registered domain
    to its suffix's, and of a host to its domain's. Each level's strength is
    the moment estimate of its beta-binomial; a prior has that of the level below its mean. Rows are summed by host before anything is joined.
    """
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).withColumns(names_of("host"))
    hosts = staged(hosts, "hosts")
    overall = hosts.agg((F.sum("bad") / F.sum("n")).alias("overall"))

    def level(key: str, parents: DataFrame, link: list[str], mean: str) -> DataFrame:
        groups = hosts.groupBy(key, *[c for c in ("suffix",) if key == "domain"]).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")) if key != "host" else hosts
        groups = groups.crossJoin(F.broadcast(parents)) if not link else groups.join(parents, link)
        # One number each; as a join, every level would double the plan of the one above.
        return groups.withColumn("strength", F.lit(_strength(groups, mean).first()[0]))

    shrunk = lambda mean: ((F.col("bad") + F.col("strength") * F.col(mean)) / (F.col("n") + F.col("strength")))
    top = level("suffix", overall, [], "overall")
    suffixes = top.select("suffix", shrunk("overall").alias("suffix_mean"))
    middle = level("domain", suffixes, ["suffix"], "suffix_mean")
    domains = middle.select("domain", shrunk("suffix_mean").alias("domain_mean"))
    found = level("host", domains, ["domain"], "domain_mean")

    def prior(groups: DataFrame, key: list[str], mean: str) -> DataFrame:
        return groups.groupBy(*key).agg(F.max(F.col("strength") * F.col(mean)).alias("alpha"), F.max(F.col("strength") * (1 - F.col(mean))).alias("beta"))

    priors = prior(found, ["domain"], "domain_mean"), prior(middle, ["suffix"], "suffix_mean"), prior(top, [], "overall")
    return found.select(
        "host", "suffix", "domain",
        (F.col("bad") + F.col("strength") * F.col("domain_mean")).alias("alpha"),
        (F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("domain_mean"))).alias("beta"),
    ), *priors


def names_of(host: str) -> dict[str, Column]:
    """Registered domain and suffix of a host without its port: the suffix is the last label, or a country's with one of SECOND before it; the domain has one label more."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two = name.rlike(rf"(?:^|\.){_SUFFIX}$")
    return {
        "domain": F.when(two, F.regexp_extract(name, rf"((?:[^.]*\.)?{_SUFFIX})$", 1)).otherwise(F.regexp_extract(name, r"([^.]*(?:\.[^.]*)?)$", 1)),
        "suffix": F.when(two, F.regexp_extract(name, rf"({_SUFFIX})$", 1)).otherwise(F.regexp_extract(name, r"([^.]*)$", 1)),
    }


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound): one row per page.

    labels (page_id, bad 0/1) are the labelled pages; several labels of a page count as its
    worst. A host without labels is judged by the prior of its registered domain, else of its suffix, else of all. Null urls and urls
    without `://` have an empty host and path. Null page ids and repeated rows pass through and
    repeated rows count as pages of their own. bound is the lower bound of the host's own
    posterior (null without labels).
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    worst = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    beta, domains, suffixes, overall = host_reputation(rows.select("page_id", "host").join(worst, "page_id").select("host", "bad"))
    total = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / total
    bound = F.greatest(F.lit(0.0), mean - Z * F.sqrt(mean * (1 - mean) / (total + 1)))
    known = beta.select("host", F.round(bound, 6).alias("bound"))
    unlabelled = rows.select("host").distinct().join(known, "host", "left_anti").withColumns(names_of("host"))
    for key, priors in (("domain", domains), ("suffix", suffixes)):
        unlabelled = unlabelled.join(priors.select(key, bound.alias(f"{key}_bound")), key, "left")
    unlabelled = unlabelled.crossJoin(F.broadcast(overall.select(bound.alias("overall_bound"))))
    backed = unlabelled.select("host", F.lit(None).cast("double").alias("bound"), F.coalesce("domain_bound", "suffix_bound", "overall_bound").alias("judged"))
    known = known.select("host", "bound", F.col("bound").alias("judged")).unionByName(backed)
    rule, verdict = rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules)
    judged = F.when(F.coalesce(F.col("judged"), F.lit(0.0)) > LIMIT, "block").otherwise("allow")
    return rows.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "bound")


_RULE_CASES = " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{{k}}}"
    for k, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2]))
)
_RHO = "1 / greatest({0}, least({1}, coalesce((sum(n * (bad / n - {m}) * (bad / n - {m})) - sum({m} * (1 - {m}))) / nullif(sum((n - 1) * {m} * (1 - {m})), 0), 0))) - 1".format(*RHO, m="m")


def _lower_bound(a: str, b: str) -> str:
    return f"greatest(0.0, ({a}) / ({a} + {b}) - {Z} * sqrt(({a}) / ({a} + {b}) * (1 - ({a}) / ({a} + {b})) / ({a} + {b} + 1)))"


ORACLE = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
bare AS (SELECT DISTINCT host, regexp_replace(host, ':[0-9]*$', '') AS name FROM r),
named AS (SELECT host, CASE WHEN regexp_matches(name, '(?:^|\.){_SUFFIX}$') THEN regexp_extract(name, '((?:[^.]*\.)?{_SUFFIX})$', 1) ELSE regexp_extract(name, '([^.]*(?:\.[^.]*)?)$', 1) END AS domain,
                 CASE WHEN regexp_matches(name, '(?:^|\.){_SUFFIX}$') THEN regexp_extract(name, '({_SUFFIX})$', 1) ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix FROM bare),
h AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad
      FROM r JOIN l ON l.doc_id = r.page_id JOIN named USING (host) GROUP BY host),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT sum(bad) / sum(n) FROM h) AS m FROM h GROUP BY suffix),
sm AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM s, (SELECT {_RHO} AS k FROM s)),
d AS (SELECT domain, any_value(sm.m) AS m, sum(n) AS n, sum(bad) AS bad FROM h JOIN sm USING (suffix) GROUP BY domain),
dm AS (SELECT domain, (bad + k * m) / (n + k) AS m FROM d, (SELECT {_RHO} AS k FROM d)),
hh AS (SELECT host, n, bad, dm.m AS m FROM h JOIN dm USING (domain)),
post AS (SELECT host, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM hh, (SELECT {_RHO} AS k FROM hh)),
bounds AS (SELECT host, round({_lower_bound('a', 'b')}, 6) AS bound FROM post),
by_domain AS (SELECT domain, {_lower_bound('k * m', 'k * (1 - m)')} AS x FROM dm, (SELECT {_RHO} AS k FROM hh)),
by_suffix AS (SELECT suffix, {_lower_bound('k * m', 'k * (1 - m)')} AS y FROM sm, (SELECT {_RHO} AS k FROM d)),
by_all AS (SELECT {_lower_bound('k * m', 'k * (1 - m)')} AS z FROM (SELECT sum(bad) / sum(n) AS m FROM h), (SELECT {_RHO} AS k FROM s))
SELECT page_id, host, path, CASE {_RULE_CASES.format(*[f"'{h}{p}'" for _, h, p in RULES])} END AS rule,
       coalesce(CASE {_RULE_CASES.format(*[f"'{v}'" for v, _, _ in RULES])} END, CASE WHEN coalesce(bound, x, y, z, 0) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, bound
FROM r JOIN named USING (host) LEFT JOIN bounds USING (host) LEFT JOIN by_domain USING (domain) LEFT JOIN by_suffix USING (suffix), by_all
"""
