"""URL filter: listed rules first, else empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted for each host, registered
domain and suffix. Each level's rate is shrunk toward the level above by a
beta-binomial prior whose strength comes from the spread between its members
(method of moments), and a host is allowed if the lower bound of its posterior
reaches ``threshold``.

Only DataFrame expressions run here. The counts are pre-aggregated before each
shuffle. Pages meet their hosts, hosts their domains and domains their suffixes
each in a join of which hot keys, with over a thousandth of all rows (so at most
1,000), are joined by broadcast and the rest by a shuffled join.

Defined cases: a null URL or one without ``://`` has an empty host and path and
is judged by the reputation of the empty host; repeated pages count each time;
null outcomes are not counted; without any outcome all rates are ``prior_rate``;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storynet.llm.common import cut, join_hot, table

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = (
    "ac.at", "ac.id", "ac.il", "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.th", "ac.uk", "ac.za", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz",
    "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk",
    "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.ve", "com.vn", "edu.au", "edu.br", "edu.cn", "edu.hk", "edu.mx", "edu.pl", "edu.sg", "edu.tr",
    "edu.tw", "go.jp", "gob.ar", "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "gov.za", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "or.jp",
    "or.kr", "org.au", "org.br", "org.cn", "org.il", "org.in", "org.mx", "org.nz", "org.pl", "org.tr", "org.tw", "org.uk", "org.za", "sch.uk",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def url_domain(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(children: DataFrame, k: str, n: str, rate: str) -> float:
    """Pseudo-counts of the prior that ``children`` share, given each one's parent rate: one row reaches the driver."""
    p, w = F.col(k) / F.col(n), F.col(rate) * (1 - F.col(rate))
    row = (
        children.filter(f"{n} > 0")
        .agg(
            F.sum(F.col(n) * (p - F.col(rate)) * (p - F.col(rate))).alias("s"),
            F.sum(w).alias("w"),
            F.sum(F.col(n) * w).alias("nw"),
        )
        .first()
    )
    spread, within, rest = row.s or 0.0, row.w or 0.0, (row.nw or 0.0) - (row.w or 0.0)
    rho = (spread - within) / rest if rest > 0 else 0.0
    rho = round(min(max(rho, 1e-3), 0.5), 6)
    return (1 - rho) / rho


def host_reputation(hosts: DataFrame, prior_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """Adds rate and bound to ``hosts``(host, n_pages, n, k): n counted outcomes, k good ones.

    ``bound`` is the posterior mean less z standard deviations.
    """
    hosts = hosts.withColumn("suffix", url_suffix(F.col("host"))).withColumn("domain", url_domain(F.col("host")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    root = round((total.k + 1) / (total.n + 2), 6) if total.n else prior_rate
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"), F.count("*").alias("n_hosts")))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"), F.count("*").alias("n_domains"))
    k0 = _strength(suffixes.withColumn("root", F.lit(root)), "sk", "sn", "root")
    suffixes = cut(suffixes.select("suffix", "n_domains", ((F.col("sk") + k0 * root) / (F.col("sn") + k0)).alias("s_rate")))
    domains = join_hot(domains, suffixes, "suffix", "n_domains")
    k1 = _strength(domains, "dk", "dn", "s_rate")
    domains = cut(domains.select("domain", "n_hosts", ((F.col("dk") + k1 * F.col("s_rate")) / (F.col("dn") + k1)).alias("d_rate")))
    hosts = join_hot(hosts, domains, "domain", "n_hosts")
    k2 = _strength(hosts, "k", "n", "d_rate")
    rate, size = (F.col("k") + k2 * F.col("d_rate")) / (F.col("n") + k2), F.col("n") + k2
    return hosts.withColumn("rate", rate).withColumn(
        "bound", F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (size + 1))
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules=RULES,
    threshold: float = 0.7,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Verdict for each row of ``pages``: page_id, host, path, rule, verdict, rate, bound.

    ``outcomes`` has columns host and good (1, 0 or null), a row for each labelled page.
    """
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    seen = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    told = (
        outcomes.filter("good is not null")
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    )
    hosts = cut(seen.join(told, "host", "left").fillna(0, ["n", "k"]))
    judged = cut(host_reputation(hosts).select("host", "n_pages", "rate", "bound"))
    both = join_hot(pages, judged, "host", "n_pages")
    rule = match_rule(F.col("host"), F.col("path"), rules)
    return both.withColumn("m", rule).select(
        "page_id",
        "host",
        "path",
        F.col("m.rule").alias("rule"),
        F.coalesce("m.verdict", F.when(F.col("bound") >= threshold, "allow").otherwise("block")).alias("verdict"),
        F.round("rate", 6).alias("rate"),
        F.round("bound", 6).alias("bound"),
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The number that starts a part of a page's path names a document; its label is the page's outcome."""
    of = pages.select(
        url_host(F.col("url")).alias("host"),
        F.regexp_extract(url_path(F.col("url")), r"/([0-9]{1,18})", 1).alias("d"),
    ).filter("d <> ''")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    told = labels.filter("quality is not null").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good"))
    return of.join(told, of.d.cast("long") == told.doc_id).select("host", "good")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


def _rule_sql(field: int) -> str:
    """CASE over the rules, longest first: the rule (1) or its verdict (0)."""
    cases = []
    for verdict, rule in sorted(RULES, key=lambda x: -len(x[1])):
        name, _, rest = rule.partition("/")
        cases.append(f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}') then '{(verdict, rule)[field]}'")
    return f"case {' '.join(cases)} end"


def _strength_sql(children: str, k: str, n: str, rate: str) -> str:
    p, w = f"({k}::double / {n})", f"({rate} * (1 - {rate}))"
    return (
        f"(select (1 - rho) / rho as k from (select round(least(greatest(case when sum({n} * {w}) - sum({w}) > 0 then (sum({n} * ({p} - {rate}) * ({p} - {rate})) - sum({w}))"
        f" / (sum({n} * {w}) - sum({w})) else 0 end, 1e-3), 0.5), 6) as rho from {children} where {n} > 0))"
    )


_TWO = "array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.')"
_THREE = _TWO.replace("- 1, 1)", "- 2, 1)")
_SUFFIXES = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
SQL = f"""
with u as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
t as (select doc_id, min(case when quality = 1 and coalesce(toxic, 0) = 0 then 1 else 0 end) as good from labels where quality is not null group by doc_id),
o as (select host, good from u join t on t.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})', 1) as bigint)),
h as (select u.host, any_value(coalesce(n, 0)) as n, any_value(coalesce(k, 0)) as k from u left join (select host, count(*) as n, sum(good) as k from o group by host) c on c.host = u.host group by u.host),
h1 as (select *, case when {_TWO} in ({_SUFFIXES}) then {_TWO} else split_part(host, '.', -1) end as suffix, case when {_TWO} in ({_SUFFIXES}) then {_THREE} else {_TWO} end as domain from h),
r as (select case when sum(n) > 0 then round((sum(k) + 1)::double / (sum(n) + 2), 6) else 0.5 end as root from h1),
s as (select suffix, sum(n) as sn, sum(k) as sk, any_value(root) as root from h1, r group by suffix),
s1 as (select suffix, (sk + c.k * root) / (sn + c.k) as s_rate from s, {_strength_sql("s", "sk", "sn", "root")} c),
d as (select domain, any_value(s_rate) as s_rate, sum(n) as dn, sum(k) as dk from h1 join s1 using (suffix) group by domain),
d1 as (select domain, (dk + c.k * s_rate) / (dn + c.k) as d_rate from d, {_strength_sql("d", "dk", "dn", "s_rate")} c),
e as (select * from h1 join d1 using (domain)),
f as (select host, (e.k + c.k * d_rate) / (n + c.k) as rate, n + c.k as size from e, {_strength_sql("e", "k", "n", "d_rate")} c),
g as (select host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1)) as bound from f)
select page_id, u.host as host, path, {_rule_sql(1).replace("host", "u.host")} as rule, coalesce({_rule_sql(0).replace("host", "u.host")}, case when bound >= 0.7 then 'allow' else 'block' end) as verdict,
  round(rate, 6) as rate, round(bound, 6) as bound from u join g on g.host = u.host
"""
