"""URL filters by rules and by empirical-Bayes host reputation.

Labelled pages give every host a number of outcomes and of bad ones. Outcomes are beta-binomial:
a host's bad rate is drawn around that of its registered domain, the domain's around that of its
suffix, the suffix's around that of all pages. Going down, each level's posterior mean is the mean
of the next level's prior; the prior's strength is estimated per level from how much more the
groups' rates vary than chance does (moments of the beta-binomial). A host without labels has its
domain's posterior, and so on up to the whole web.

A host is blocked if even the lower bound of its posterior bad rate (mean - Z * deviation) is above
``WORST``. Rules come first: the longest rule that fits a page decides.

Defined results: a null url or one without ``://`` has an empty host and path and is judged like
an unknown host. Repeated rows are judged alike; several labels of a page count once, as bad if
any is. Labels that are null in both columns do not count. Other columns are not read. Empty
tables give empty results, and without labels nothing is blocked but by rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm.common import read_table, scratch, store

#: Posterior bad rate that a host's lower bound must exceed to be blocked.
WORST = 0.25
#: Normal quantile of the one-sided 95 % bound.
Z = 1.6448536269514722
#: Bounds of a prior's strength in pseudo-outcomes.
WEAKEST, STRONGEST = 1.0, 1000.0


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: str = "host") -> tuple[Column, Column]:
    """The last label, and the last two; an address of digits is its own domain."""
    name = F.regexp_replace(F.col(host), r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    numeric = name.rlike(r"^[0-9.]+$|^\[")
    suffix = F.when(numeric, F.lit("")).otherwise(F.element_at(labels, -1))
    domain = F.when(numeric | (F.size(labels) < 2), name).otherwise(F.array_join(F.slice(labels, -2, 2), "."))
    return suffix, domain


def outcomes(labels: DataFrame) -> DataFrame:
    """``page_id, bad``: one outcome per labelled page; toxic or of low quality is bad."""
    bad = (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).cast("long")
    return (
        labels.filter("doc_id is not null and (toxic is not null or quality is not null)")
        .groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    )


def _strength(groups: DataFrame) -> float:
    """Prior strength that explains how much the groups' bad rates vary."""
    sums = groups.filter("n > 0").agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("k").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"),
    ).first()
    if not sums["n"] or sums["groups"] < 2:
        return STRONGEST
    mean = sums["k"] / sums["n"]
    chance = mean * (1 - mean)
    between = sums["kk"] - sums["n"] * mean * mean
    room = sums["n"] - sums["nn"] / sums["n"] - (sums["groups"] - 1)
    if chance <= 0 or room <= 0:
        return STRONGEST
    overlap = (between - (sums["groups"] - 1) * chance) / (chance * room)
    if overlap <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, (1 - overlap) / overlap))


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, n, k, bad_rate, deviation, lower`` of every host of ``pages (page_id, host)``."""
    folder = scratch(pages.sparkSession, "reputation")
    suffix, domain = suffix_and_domain()
    counted = pages.join(outcomes(labels), "page_id", "left")
    hosts = store(
        counted.groupBy("host").agg(
            F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")
        ).select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "k"),
        f"{folder}/hosts",
    )
    domains = store(
        hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), f"{folder}/domains"
    )
    suffixes = store(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), f"{folder}/suffixes")
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    overall = (total[1] + 0.5) / (total[0] + 1.0) if total[0] else 0.0

    def shrunk(strength: float, mean: Column) -> Column:
        return (F.lit(strength) * mean + F.col("k")) / (F.lit(strength) + F.col("n"))

    by_suffix = suffixes.select("suffix", shrunk(_strength(suffixes), F.lit(overall)).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select(
        "suffix", "domain", shrunk(_strength(domains), F.col("suffix_rate")).alias("domain_rate")
    )
    strength = _strength(hosts)
    judged = hosts.join(by_domain, ["suffix", "domain"]).withColumn("bad_rate", shrunk(strength, F.col("domain_rate")))
    weight = F.lit(strength) + F.col("n") + 1
    judged = judged.withColumn("deviation", F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / weight))
    return judged.select("host", "n", "k", "bad_rate", "deviation", (F.col("bad_rate") - Z * F.col("deviation")).alias("lower"))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, rules``: the rules of each host and its parents, longest first.

    Every host is looked up under its own name and each parent's, an equi-join.
    """
    labels = F.split("host", r"\.")
    names = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = hosts.select("host", F.explode(names).alias("rule_host")).join(rules, "rule_host")
    key = F.struct((-F.char_length("rule")).alias("order"), "rule", "rule_path", "rule_verdict")
    return fitting.groupBy("host").agg(F.array_sort(F.collect_set(key)).alias("rules"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, lower`` of every row of ``pages (page_id, url)``."""
    spark = pages.sparkSession
    folder = scratch(spark, "url-filter")
    parsed = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    judged = reputation(parsed, labels).select("host", "lower")
    table = spark.createDataFrame(
        [(r.host, r.path, r.text, r.verdict) for r in rules],
        "rule_host string, rule_path string, rule string, rule_verdict string",
    )
    per_host = store(
        judged.join(rules_of_hosts(judged.select("host"), table), "host", "left")
        .select(F.col("host").alias("judged_host"), "lower", "rules"),
        f"{folder}/hosts",
    )
    none = "array<struct<order:int,rule:string,rule_path:string,rule_verdict:string>>"
    fitting = F.filter(F.coalesce("rules", F.array().cast(none)), lambda r: F.startswith(F.col("path"), r["rule_path"]))
    return (
        parsed.join(per_host, F.col("host") == F.col("judged_host"))
        .withColumn("fit", F.get(fitting, 0))
        .select(
            "page_id", "host", "path", F.col("fit.rule").alias("rule"),
            F.coalesce("fit.rule_verdict", F.when(F.col("lower") > WORST, "block").otherwise("allow")).alias("verdict"),
            "lower",
        )
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    return filter_urls(pages, labels).drop("lower")


# The outcome, the strengths and the posterior once more, for DuckDB.
_LEVEL = """{name}_m as (
  select count(*) g, sum(n) n, sum(k) k, sum(n * n) nn, sum(cast(k as double) * k / n) kk from {name} where n > 0),
{name}_c as (select g, n, cast(k as double) / n m, kk, n - cast(nn as double) / n - (g - 1) room from {name}_m),
{name}_o as (
  select g, m * (1 - m) c, room,
    (kk - n * m * m - (g - 1) * m * (1 - m)) / nullif(m * (1 - m) * room, 0) o from {name}_c),
{name}_s as (
  select case when g < 2 or c is null or c <= 0 or room <= 0 or o is null or o <= 0 then %r
    else least(%r, greatest(%r, (1 - o) / o)) end s from {name}_o)""" % (STRONGEST, STRONGEST, WEAKEST)


def oracle_sql() -> str:
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    levels = ",\n".join(_LEVEL.format(name=n) for n in ("suffixes", "domains", "hosts"))
    return f"""
with parsed as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path
  from pages),
outcome as (
  select doc_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) bad from labels
  where doc_id is not null and (toxic is not null or quality is not null) group by doc_id),
named as (
  select host, count(bad) n, coalesce(sum(bad), 0) k, regexp_replace(host, ':[0-9]*$', '') name
  from parsed left join outcome on page_id = doc_id group by host),
hosts as (
  select host, n, k,
    case when regexp_matches(name, '^[0-9.]+$|^\\[') then '' else string_split(name, '.')[-1] end suffix,
    case when regexp_matches(name, '^[0-9.]+$|^\\[') or len(string_split(name, '.')) < 2 then name
      else array_to_string(string_split(name, '.')[-2:], '.') end as domain
  from named),
domains as (select suffix, domain, sum(n) n, sum(k) k from hosts group by suffix, domain),
suffixes as (select suffix, sum(n) n, sum(k) k from domains group by suffix),
overall as (select case when sum(n) > 0 then (sum(k) + 0.5) / (sum(n) + 1.0) else 0.0 end r from suffixes),
{levels},
by_suffix as (select suffix, (s * r + k) / (s + n) rate from suffixes, suffixes_s, overall),
by_domain as (
  select d.suffix, d.domain, (s * rate + k) / (s + n) rate from domains d join by_suffix using (suffix), domains_s),
by_host as (
  select host, n, s, (s * rate + k) / (s + n) rate from hosts join by_domain using (suffix, domain), hosts_s),
judged as (select host, rate - {Z!r} * sqrt(rate * (1 - rate) / (s + n + 1)) low from by_host),
rules(rule_host, rule_path, rule_verdict) as (values {rules}),
fits as (
  select host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) rule,
    max_by(rule_verdict, length(rule_host || rule_path)) rule_verdict
  from (select distinct host, path from parsed) join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path)
select page_id, host, path, rule,
  coalesce(rule_verdict, case when low > {WORST!r} then 'block' else 'allow' end) verdict
from parsed join judged using (host) left join fits using (host, path)"""
