"""URL filter by host reputation with empirical Bayes.

Labelled page outcomes (good or not) are counted by host, by registered domain (the suffix and one
label more) and by suffix. Suffixes are told by rules as public suffix lists write them: the longest of the plain rules (``co.uk``) and wildcards (``*.ck``) that fits, an
exception (``!www.ck``) before all others, else the last label; read_suffixes() reads such a list, and ``suffix_rules()`` makes a short one. For these a host has no user or port, and an
address of numbers is its own domain and suffix. At each level a beta-binomial prior is centred on the
posterior mean of the level above; how strongly it pulls is estimated from how much the groups
of that level differ (method of moments). A host is blocked if even the upper
bound of its posterior share of good pages (the mean and z standard deviations of the beta posterior, a normal
approximation) lies below a threshold, so doubt lets a page pass. Hosts
without labels get their domain's or suffix's posterior. Rules on host and path come before.

Scale: outcomes are counted with partial aggregates; levels have one row a group and are joined on the
group's name, where Spark picks broadcast or a split of hot keys. Four numbers a level reach the driver.

Cases: a url that is null or has no "://" has empty host and path and passes, unless a rule fits. Outcomes
with null url or null value are left out. Without outcomes all pages pass. Repeated outcomes count
each time; repeated pages are judged one by one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Host suffix, path prefix, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


# Labels under which countries register domains, the countries that do, and sites that give a name to each user.
SECOND_LABELS = ["ac", "co", "com", "edu", "gob", "gov", "mil", "ne", "net", "or", "org"]
COUNTRIES = ["ar", "au", "bd", "br", "cn", "co", "eg", "hk", "id", "il", "in", "jp", "ke", "kr", "mx", "my", "ng", "nz", "pe", "ph", "pk", "sa", "sg", "th", "tr", "tw", "ua", "ug", "uk", "ve", "vn", "za"]
SITES = ["appspot.com", "blogspot.com", "firebaseapp.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "readthedocs.io", "vercel.app", "web.app", "wordpress.com"]
#: Labels of a suffix at most.
_DEEPEST = 5


def suffix_rules() -> list[str]:
    return [f"{second}.{land}" for land in COUNTRIES for second in SECOND_LABELS] + SITES


def read_suffixes(spark: SparkSession, path: str) -> list[str]:
    """The rules of a suffix list: a rule a line up to the first blank, // begins a comment. Such lists have some ten thousand rules; a longer one is an error."""
    rule = F.lower(F.split(F.trim("value"), r"\s")[0])
    rows = spark.read.text(path).select(rule.alias("rule")).filter("rule <> '' and not startswith(rule, '//')").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("a suffix list of over 100,000 rules")
    return [r["rule"] for r in rows]


def _labels_of_suffix(name: Column, rules: list[str]) -> Column:
    """How many labels the suffix of a name has."""
    plain, wild, but = ({r[cut:] for r in rules if test(r)} for cut, test in ((0, lambda r: r[0] not in "*!"), (2, lambda r: r.startswith("*.")), (1, lambda r: r[0] == "!")))
    tail, count = lambda k: F.substring_index(name, ".", -k), F.size(F.split(name, r"\."))
    found = F.lit(1)
    for k in range(1, _DEEPEST + 1):
        fits = tail(k).isin(*plain) if plain else F.lit(False)
        if wild and k > 1:
            fits = fits | tail(k - 1).isin(*wild)
        found = F.when((count >= k) & fits, k).otherwise(found)
    for k in range(2, _DEEPEST + 2):
        if but:
            found = F.when((count >= k) & tail(k).isin(*but), k - 1).otherwise(found)
    return found


def _grouped(host: Column, more: int, rules: list[str] | None) -> Column:
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$|[.]+$", "")
    labels = _labels_of_suffix(name, suffix_rules() if rules is None else rules) + more
    return F.when(name.rlike(r"^[0-9]+([.][0-9]+){3}$|^\["), name).otherwise(F.call_function("substring_index", name, F.lit("."), -labels))


def domain_of(host: Column, rules: list[str] | None = None) -> Column:
    """The registered domain: the suffix and one label more, or all of a host that is a suffix."""
    return _grouped(host, 1, rules)


def suffix_of(host: Column, rules: list[str] | None = None) -> Column:
    return _grouped(host, 0, rules)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path as one text) and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, prefix, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        name, verdict = F.when(fits, rule_host + prefix).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def strength(groups: DataFrame, least: float = 0.5, most: float = 1000.0) -> tuple[float, float]:
    """Of groups with columns good and n: the overall share and the prior's strength in pages."""
    g = groups.agg(F.sum("good").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("kk"), F.count("*").alias("g")).first()
    if not g["n"]:
        return 0.5, most
    p = g["k"] / g["n"]
    if g["g"] < 2 or not 0 < p < 1:
        return p, most
    spread = g["kk"] - g["n"] * p * p  # sum of n (share - p)^2
    noise = p * (1 - p)
    rho = (spread / noise - (g["g"] - 1)) / (g["n"] - g["nn"] / g["n"] - (g["g"] - 1) or 1)
    return p, min(most, max(least, 1 / rho - 1 if rho > 0 else most))


def reputation(outcomes: DataFrame, url_col: str = "url", good_col: str = "good", z: float = 1.645, suffixes: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Posterior (mean, upper: bound at z deviations) of hosts, domains and suffixes, and of a host of unknown suffix."""
    host = host_of(F.col(url_col))
    seen = outcomes.select(host.alias("host"), F.col(good_col).cast("double").alias("good")).filter("host <> '' and good is not null")
    hosts = seen.groupBy("host").agg(F.sum("good").alias("good"), F.count("*").cast("double").alias("n")).withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    tops = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    (share, k_suffix), (_, k_domain), (_, k_host) = strength(tops), strength(domains), strength(hosts)

    def posterior(groups: DataFrame, prior: Column, k: float) -> DataFrame:
        mean = (F.col("good") + k * prior) / (F.col("n") + k)
        return groups.withColumn("mean", mean).withColumn("upper", F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1)))

    suffix = posterior(tops, F.lit(share), k_suffix).select("suffix", F.col("mean").alias("suffix_mean"), F.col("upper").alias("suffix_upper"))
    domain = posterior(domains.join(suffix, "suffix"), F.col("suffix_mean"), k_domain).select("domain", F.col("mean").alias("domain_mean"), F.col("upper").alias("domain_upper"))
    own = posterior(hosts.join(domain, "domain"), F.col("domain_mean"), k_host).select("host", "good", "n", "mean", "upper")
    unknown = share + z * (share * (1 - share) / (k_suffix + 1)) ** 0.5
    return own, domain, suffix, (share, unknown)


def filter_urls(pages: DataFrame, outcomes: DataFrame, url_col: str = "url", good_col: str = "good", rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5, z: float = 1.645, keep: tuple[str, ...] = ("page_id",), suffixes: list[str] | None = None) -> DataFrame:
    """Per page: the kept columns, host, path, rule, verdict, posterior_mean, posterior_upper. suffixes: rules as read_suffixes() gives them."""
    hosts, domains, tops, (share, unknown) = reputation(outcomes, url_col, good_col, z, suffixes)
    left = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # Groups are judged once and joined by name; a page needs one look at its host, then at larger groups.
    known = left.select("host").distinct().withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    known = known.join(hosts, "host", "left").join(domains, "domain", "left").join(tops, "suffix", "left")
    known = known.select("host", F.coalesce("mean", "domain_mean", "suffix_mean", F.lit(share)).alias("posterior_mean"), F.coalesce("upper", "domain_upper", "suffix_upper", F.lit(unknown)).alias("posterior_upper"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    out = left.join(known, "host").withColumns({"rule": rule, "by_rule": by_rule})
    method = F.when((F.col("host") != "") & (F.col("posterior_upper") < threshold), "block").otherwise("allow")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "posterior_mean", "posterior_upper")


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled outcomes of the test tables: a page is good if the label of its number has quality and isn't toxic."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return pages.select("url", F.col("page_id").alias("doc_id")).join(labels.select("doc_id", good.cast("int").alias("good")), "doc_id").select("url", "good")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = filter_urls(pages, outcomes_of(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("page_id", "host", "path", "rule", "verdict")
