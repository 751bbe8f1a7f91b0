"""Host reputation by empirical Bayes, after a list of rules.

Labelled pages are outcomes, good or bad. A suffix's rate is shrunk to the rate of all, a registered domain's to its
suffix's, a host's to its domain's, each by a beta prior: its mean is the level above, its strength is estimated from how much the rates
of that level differ (method of moments). A page is blocked if the upper bound of its host's posterior good
rate, mean + z standard deviations, is below the limit; so little evidence blocks nobody.

Everything is an aggregate by key with map-side partial sums, so a host with a third of all pages is no hot task. In the join
back, hosts with more than one in `hot_share` of the pages (there are fewer than hot_share of them) go to every task, and their pages are dealt out by page. Nulls: a null url, or one without "://", has an empty host and
path and is judged as the empty host. Labels without an id or outcome are left out; of several for a page the lowest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, shared_dir, written

#: Two-level public suffixes under which names are registered; fixed values.
SECOND_LEVEL = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
#: (host, path, verdict): fixed values of the contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), F.substring_index(name, ".", -3)).otherwise(two)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def shrunk(level: DataFrame, key: str, up: str | None, upper: DataFrame | None, strength: tuple[float, float]) -> DataFrame:
    """level: key, (up,) n, good. Adds the level's prior strength k and its posterior mean m, given the level above.

    Two sums come to the driver and go back as constants.
    """
    if upper is None:
        r = level.agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
        level = level.withColumn("m0", F.lit(((r.g or 0.0) + 1) / ((r.n or 0.0) + 2)))
    else:
        level = level.join(upper.select(F.col("key").alias(up), F.col("m").alias("m0")), up)
    # Moments: n (rate - m0)^2 is m0 (1 - m0) (1 + (n - 1) rho) in expectation; the strength of the prior is 1 / rho - 1.
    rate, var = F.col("good") / F.col("n"), F.col("m0") * (1 - F.col("m0"))
    r = level.agg(F.sum(F.col("n") * (rate - F.col("m0")) * (rate - F.col("m0")) - var).alias("over"), F.sum(var * (F.col("n") - 1)).alias("free")).first()
    rho = r.over / r.free if r.free else 0.0
    k = round(min(max(1 / rho - 1, strength[0]), strength[1]), 6) if rho > 0 else strength[1]
    keep = [F.col(key).alias("key"), *([F.col(up)] if up else []), "n", "good", "m0", F.lit(float(k)).alias("k")]
    return level.select(*keep, ((F.col("good") + k * F.col("m0")) / (F.col("n") + k)).alias("m"))


def reputation(outcomes: DataFrame, *, strength: tuple[float, float] = (2.0, 1000.0)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """outcomes: host, good (0 or 1). Tables of hosts, domains and suffixes with posterior means (m)."""
    o = outcomes.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("good").cast("double").alias("good"))
    o = o.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "good")
    o = written(o, shared_dir(o.sparkSession), "hosts")
    sums = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = shrunk(o.groupBy("suffix").agg(*sums), "suffix", None, None, strength)
    domains = shrunk(o.groupBy("domain", "suffix").agg(*sums), "domain", "suffix", suffixes, strength)
    hosts = shrunk(o.select("host", "domain", "n", "good"), "host", "domain", domains, strength)
    return hosts, domains, suffixes


def judged(pages: DataFrame, labels: DataFrame, *, page: str = "page_id", url: str = "url", label_page: str = "doc_id", good: Column | None = None, limit: float = 0.5, z: float = 1.645, rules=RULES, hot_share: int = 1000) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, good_rate, good_bound."""
    p = pages.select(F.col(page).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ok = good if good is not None else ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    marks = labels.select(F.col(label_page).alias("page_id"), ok.alias("good")).where("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    hosts, domains, suffixes = reputation(p.join(marks, "page_id").select("host", "good"))
    # The distinct hosts, each with its nearest level that has outcomes; then one join with the pages.
    total = pages.count()
    names = p.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    known = (
        names.join(hosts.select(F.col("key").alias("host"), F.col("m").alias("mh"), (F.col("n") + F.col("k")).alias("nh")), "host", "left")
        .join(domains.select(F.col("key").alias("domain"), F.col("m").alias("md"), F.col("k").alias("kd")), "domain", "left")
        .join(suffixes.select(F.col("key").alias("suffix"), F.col("m").alias("ms"), F.col("k").alias("ks")), "suffix", "left")
    )
    mean = F.coalesce("mh", "md", "ms", F.lit(1.0))
    weight = F.coalesce("nh", "kd", "ks", F.lit(2.0))
    sd = F.sqrt(mean * (1 - mean) / (weight + 1))
    known = written(known.select("host", "pages", mean.alias("good_rate"), (mean + z * sd).alias("good_bound")), shared_dir(p.sparkSession), "known")
    hot = (F.col("pages") > total / hot_share).alias("hot")
    few = known.where(hot).select("host", F.col("good_rate").alias("r"), F.col("good_bound").alias("b"))
    p = p.join(F.broadcast(few), "host", "left")
    dealt = F.when(F.col("r").isNull(), F.col("host")).otherwise(F.concat(F.lit("\x00"), F.xxhash64("page_id", "path").cast("string")))
    rest = known.where(~hot).select(F.col("host").alias("h"), "good_rate", "good_bound")
    p = p.withColumn("dealt", dealt).join(rest, (F.col("dealt") == F.col("h")) & F.col("r").isNull(), "left")
    p = p.withColumns({"good_rate": F.coalesce("r", "good_rate"), "good_bound": F.coalesce("b", "good_bound")})
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("good_bound") < limit, "block").otherwise("allow")
    return p.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "good_rate", "good_bound")
