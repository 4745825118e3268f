"""URL filter: rules first, then an empirical-Bayes reputation of hosts.

Pages with a known outcome (1: to block) give every host a binomial count. A suffix ("com") has a beta
prior fitted to all outcomes, a registered domain ("example.com") one centred on its suffix, a host one
centred on its domain; each prior weighs as many pages as its strength says. Strengths come from the
data by the method of moments: how much more the rates of the children differ than their counts alone
would make them. A prior's centre leaves out the child's own pages, which would count twice. A page is blocked if the lower bound of its host's posterior, mean less `z` standard
deviations (the normal approximation of a beta quantile), is above a threshold; a host without outcomes falls back on its domain, then its suffix.
Outcomes are a parameter. Where there are none, the pages that a rule decides serve as such, so that the reputation says how
the rules see a host's other pages; it is then no evidence beside them.

All counts are integers. Pages are counted by host once, combined before the shuffle; all levels come from this table. The hosts that
have more than a thousandth of all pages each, fewer than a thousand, are sent out to the pages; the others join by host.

Defined cases: a null url or one without "://" has an empty host and path, no rule, and is judged like
any host (the empty one, of an empty suffix); repeated rows count as often as they occur; of equally
long rules the first by name wins; without any outcome nothing is blocked beyond the rules; an empty
table gives an empty table; columns of the input that bear an output's name are replaced, others may have any name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm._common import by_position, column, materialise, without


class Rule(NamedTuple):
    """What a url's host (or a domain above it) and the start of its path decide."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: Fixed values.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Suffixes of two labels under which names are registered, beside those of one label.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
THRESHOLD = 0.5
Z = 1.645
#: Bounds of a prior's strength, in pages.
LEAST, MOST = 1.0, 1000.0
#: Hosts with more than this share of all pages are sent out to them.
HOT = 1 / 1000
#: The strength where children are too few to tell how much they differ.
UNKNOWN = 2.0



def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    found = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def suffix(host_: Column) -> Column:
    two = F.substring_index(host_, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(host_, ".", -1))


def domain(host_: Column) -> Column:
    two = F.substring_index(host_, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), F.substring_index(host_, ".", -3)).otherwise(two)


def rule(host_: Column, path_: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(name, verdict) of the longest rule that fits, or null."""
    best = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host_ == r.host) | F.endswith(host_, F.lit(f".{r.host}"))) & F.startswith(path_, F.lit(r.path))
        best = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def _strength(child: DataFrame, parent: str, mean: str) -> DataFrame:
    """(parent, strength): method of moments for the beta-binomial spread of children around their parent's mean.

    With rates p_i = x_i / n_i, expected sum n_i (p_i - m)^2 = m (1 - m) (k + (N - k) r) for k children with N
    pages in all and an intra-class correlation r; the strength is (1 - r) / r.
    """
    m, n = F.col(mean), F.col("n").cast("double")
    rate = F.col("bad") / n
    spread = F.sum((n * (rate - m) * (rate - m)).cast("decimal(38,12)")).cast("double")  # decimals add up alike in any order
    g = child.groupBy(parent).agg(spread.alias("s"), F.count("*").cast("double").alias("k"), F.sum("n").cast("double").alias("total"), F.max(mean).alias("m"))
    r = (F.col("s") / (F.col("m") * (1 - F.col("m"))) - F.col("k")) / (F.col("total") - F.col("k"))
    known = (F.col("m") > 0) & (F.col("m") < 1) & (F.col("k") > 1) & (F.col("total") > F.col("k"))
    strength = F.when(~known, F.lit(UNKNOWN)).when(r <= 0, F.lit(MOST)).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), (1 - r) / r)))
    return g.select(parent, F.round(strength, 6).alias("strength"))


def reputation(outcomes: DataFrame, url_host: str = "host", bad: str = "bad") -> dict[str, DataFrame]:
    """Posteriors by level out of (host, bad 0/1): 'suffix', 'domain' and 'host' tables of (key, n, bad, alpha, beta)."""
    counted = outcomes.where(column(bad).isNotNull()).groupBy(column(url_host).alias("host")).agg(F.count("*").alias("n"), F.sum(column(bad).cast("long")).alias("bad"))
    return _levels(counted)


def _levels(hosts: DataFrame) -> dict[str, DataFrame]:
    """The same out of (host, n, bad)."""
    hosts = hosts.withColumn("domain", domain(F.col("host"))).withColumn("suffix", suffix(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    everything = suffixes.groupBy().agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad")).select(((F.col("all_bad") + 1) / (F.col("all_n") + 2)).alias("mean"))
    level: dict[str, DataFrame] = {}

    def posterior(df: DataFrame, key: str, strength: Column, prior: Column) -> DataFrame:
        a, b = prior * strength, (1 - prior) * strength
        return df.select(key, "n", "bad", (a + F.col("bad")).alias("alpha"), (b + F.col("n") - F.col("bad")).alias("beta"))

    def above(key: str) -> DataFrame:
        return level[key].select(key, F.col("alpha").alias("a"), (F.col("alpha") + F.col("beta")).alias("ab"), (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean"))

    # what the parent would be like without this child's own pages, which count in the child already
    others = (F.col("a") - F.col("bad")) / (F.col("ab") - F.col("n"))
    level["suffix"] = posterior(suffixes.join(F.broadcast(everything)), "suffix", F.lit(UNKNOWN), F.col("mean"))  # one row is sent out
    with_mean = domains.join(above("suffix"), "suffix")
    level["domain"] = posterior(with_mean.join(_strength(with_mean, "suffix", "mean"), "suffix"), "domain", F.col("strength"), others)
    with_mean = hosts.join(above("domain"), "domain")
    level["host"] = posterior(with_mean.join(_strength(with_mean, "domain", "mean"), "domain"), "host", F.col("strength"), others)
    return level


def lower_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    """Mean less z standard deviations of a beta distribution."""
    s = alpha + beta
    return alpha / s - F.lit(z) * F.sqrt(alpha * beta / (s * s * (s + 1)))


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, outcomes: DataFrame | None = None, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """`pages` with host, path, rule, verdict, reputation (the bound, rounded to 6 places) and level it comes from.

    outcomes: (host, bad); by default the pages that a rule decides: blocked ones are bad, allowed ones good.
    """
    named = without(pages, "host", "path", "rule", "verdict", "reputation", "level")
    base, at = by_position(named), F.col(f"c{named.columns.index(url)}")
    told = base.withColumn("host", host(at)).withColumn("path", path(at)).withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    ruled = F.col("rule").isNotNull()
    # pages are reduced to hosts before anything else
    hosts = materialise(told.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(ruled).alias("n"), F.count_if(F.col("rule.verdict") == "block").alias("bad")))
    level = _levels(hosts.where("n > 0").select("host", "n", "bad")) if outcomes is None else reputation(outcomes)
    # every host that pages show, with the nearest level that has outcomes
    seen = hosts.select("host", "pages", domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"))
    for key, df in level.items():
        seen = seen.join(df.select(key, F.round(lower_bound(F.col("alpha"), F.col("beta"), z), 6).alias(f"by_{key}")), key, "left")
    names = [F.when(F.col(f"by_{k}").isNotNull(), k) for k in ("host", "domain", "suffix")]
    seen = materialise(seen.select("host", "pages", F.coalesce("by_host", "by_domain", "by_suffix", F.lit(0.0)).alias("reputation"), F.coalesce(*names, F.lit("none")).alias("level")))
    least = (hosts.agg(F.sum("pages")).first()[0] or 0) * HOT
    hot = seen.where(F.col("pages") > least).drop("pages")
    with_hot = told.join(F.broadcast(hot), "host")  # fewer than 1 / HOT rows
    others = told.join(F.broadcast(hot.select("host")), "host", "left_anti").join(seen.where(F.col("pages") <= least).drop("pages"), "host")
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("reputation") > threshold, "block").otherwise("allow"))
    out = with_hot.unionByName(others).select(*base.columns, "host", "path", F.col("rule.name").alias("rule"), verdict.alias("verdict"), "reputation", "level")
    return out.toDF(*named.columns, "host", "path", "rule", "verdict", "reputation", "level")


def op7_url_reputation(spark, sf_dir: str) -> DataFrame:
    """Every page's url by the rules, or else by the reputation that ruled pages give its host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "reputation", "level")


def op7_sql() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    two_levels = ", ".join(f"'{s}'" for s in SECOND_LEVEL)
    fits = "\n".join(
        f"    WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))
    )
    block = ", ".join(f"'{r.name}'" for r in RULES if r.verdict == "block")
    parts = """CASE WHEN list_contains([{two}], array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')) THEN array_to_string(list_slice(string_split(host, '.'), {a}, -1), '.') ELSE array_to_string(list_slice(string_split(host, '.'), {b}, -1), '.') END"""

    def strength(child: str, parent: str) -> str:
        return f"""SELECT {parent}, round(CASE WHEN NOT known THEN {UNKNOWN} WHEN r <= 0 THEN {MOST} ELSE greatest({LEAST}, least({MOST}, (1 - r) / r)) END, 6) AS strength FROM (
  SELECT {parent}, m > 0 AND m < 1 AND k > 1 AND total > k AS known, CASE WHEN m > 0 AND m < 1 AND total > k THEN (s / (m * (1 - m)) - k) / (total - k) ELSE 0.0 END AS r FROM (
    SELECT {parent}, CAST(sum(CAST(n * (bad / n - mean) * (bad / n - mean) AS DECIMAL(38,12))) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS total, max(mean) AS m FROM {child} GROUP BY {parent}))"""

    bound = f"round(alpha / (alpha + beta) - {Z} * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))), 6)"
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, {low.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
told AS (SELECT page_id, host, path, CASE
{fits}
    ELSE NULL END AS rule FROM named),
hosts AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN rule IN ({block}) THEN 1 ELSE 0 END) AS DOUBLE) AS bad,
  {parts.format(two=two_levels, a=-3, b=-2)} AS domain, {parts.format(two=two_levels, a=-2, b=-1)} AS suffix FROM told WHERE rule IS NOT NULL GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
everything AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS mean FROM suffixes),
suffix_level AS (SELECT suffix, mean * {UNKNOWN} + bad AS alpha, (1 - mean) * {UNKNOWN} + n - bad AS beta FROM suffixes, everything),
domain_mean AS (SELECT d.*, alpha / (alpha + beta) AS mean, (alpha - d.bad) / (alpha + beta - d.n) AS prior FROM domains d JOIN suffix_level USING (suffix)),
domain_strength AS ({strength("domain_mean", "suffix")}),
domain_level AS (SELECT domain, prior * strength + bad AS alpha, (1 - prior) * strength + n - bad AS beta FROM domain_mean JOIN domain_strength USING (suffix)),
host_mean AS (SELECT h.*, alpha / (alpha + beta) AS mean, (alpha - h.bad) / (alpha + beta - h.n) AS prior FROM hosts h JOIN domain_level USING (domain)),
host_strength AS ({strength("host_mean", "domain")}),
host_level AS (SELECT host, prior * strength + bad AS alpha, (1 - prior) * strength + n - bad AS beta FROM host_mean JOIN host_strength USING (domain)),
seen AS (SELECT host, {parts.format(two=two_levels, a=-3, b=-2)} AS domain, {parts.format(two=two_levels, a=-2, b=-1)} AS suffix FROM (SELECT DISTINCT host FROM told)),
judged AS (SELECT seen.host, h.b AS hb, d.b AS db, s.b AS sb FROM seen
  LEFT JOIN (SELECT host, {bound} AS b FROM host_level) h ON h.host = seen.host
  LEFT JOIN (SELECT domain, {bound} AS b FROM domain_level) d ON d.domain = seen.domain
  LEFT JOIN (SELECT suffix, {bound} AS b FROM suffix_level) s ON s.suffix = seen.suffix)
SELECT page_id, told.host, path, rule,
  CASE WHEN rule IN ({block}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN coalesce(hb, db, sb, 0.0) > {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(hb, db, sb, 0.0) AS reputation,
  CASE WHEN hb IS NOT NULL THEN 'host' WHEN db IS NOT NULL THEN 'domain' WHEN sb IS NOT NULL THEN 'suffix' ELSE 'none' END AS level
FROM told JOIN judged ON judged.host = told.host
"""
