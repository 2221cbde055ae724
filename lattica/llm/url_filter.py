"""URL filters: host/path rules first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes are counted by host. A beta-binomial prior passes down from all pages to the suffix, the
registered domain and the host; its strength at each level comes from the spread of the children's rates (method of
moments). A host is blocked when the lower posterior bound of its bad rate exceeds ``worst``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut

#: Fixed values of the contract: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Bounds of a prior's strength in pages, the width of the posterior bound in standard deviations, and the bad rate to exceed.
LEAST, MOST, Z, WORST = 2.0, 200.0, 1.645, 0.5


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(tail, r"^[^?#]*", 0)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _level(children: DataFrame, key: str, parent: str, above: DataFrame) -> DataFrame:
    """Posterior mean of each child under its parent's mean; ``children`` has (key, parent, n, k).

    The prior's strength follows from the children's spread around their parents' means, over the whole level.
    """
    joined, p = children.join(above, parent), F.col("mean")
    within, off = F.sum(F.col("n") * p * (1 - p)), F.sum(F.pow(F.col("k") - F.col("n") * p, 2) / F.col("n"))
    x = joined.agg(within.alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), off.alias("ss")).first()
    pq = x["w"] / x["n"] if x["n"] else 0.0
    between = (x["ss"] - pq * x["m"]) / x["n"] if x["n"] else 0.0
    s = max(LEAST, min(MOST, pq / between - 1)) if between > 0 else MOST
    return joined.select(key, parent, "n", "k", ((F.col("k") + s * p) / (F.col("n") + s)).alias("post"), F.lit(s).alias("s"))


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, bad_low): lower posterior bound of the bad rate from (host, n, k) counts of labelled pages.

    Hosts without a labelled page take the posterior of the nearest level above that has one.
    """
    named = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    seen = named.where(F.col("n") > 0)
    domains = seen.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = seen.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("root", F.col("suffix"))
    x = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    top = suffixes.select("root", F.lit((x["k"] + 0.5) / (x["n"] + 1.0)).alias("mean"))
    s = _level(suffixes, "suffix", "root", top)
    d = _level(domains, "domain", "suffix", s.select("suffix", F.col("post").alias("mean")))
    h = _level(seen.select("host", "domain", "n", "k"), "host", "domain", d.select("domain", F.col("post").alias("mean")))
    base = named.select("host", "domain", "suffix").join(h.select("host", "post", "n", "s"), "host", "left")
    base = base.join(d.select("domain", F.col("post").alias("dp"), F.col("s").alias("ds")), "domain", "left").join(s.select("suffix", F.col("post").alias("sp"), F.col("s").alias("ss")), "suffix", "left")
    mean = F.coalesce("post", "dp", "sp", F.lit(0.0))
    weight = F.coalesce(F.col("n") + F.col("s"), F.col("ds"), F.col("ss"), F.lit(LEAST))
    return base.select("host", (mean - Z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("bad_low"), mean.alias("bad_mean"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, worst: float = WORST) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the host's posterior figures.

    ``outcomes`` has (page_id, bad boolean); several outcomes of a page each count, null ids and null outcomes none.
    Null urls have an empty host, which is a host like any other. Pages are counted by host before anything is joined,
    so a host with a third of all pages is one row.
    """
    host, path = host_path(F.col("url"))
    parsed = pages.drop("host", "path", "rule", "verdict", "bad_low", "bad_mean").withColumn("host", host).withColumn("path", path)
    label = outcomes.where(F.col("bad").isNotNull()).groupBy(F.col("page_id").alias("l_page")).agg(F.count(F.lit(1)).alias("ln"), F.sum(F.col("bad").cast("long")).alias("lk"))
    slim = parsed.select("page_id", "host")
    counts = slim.join(label, slim["page_id"] == label["l_page"], "left").groupBy("host").agg(F.coalesce(F.sum("ln"), F.lit(0)).alias("n"), F.coalesce(F.sum("lk"), F.lit(0)).alias("k"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    known = parsed.join(reputation(cut(counts)), "host", "left")
    return known.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("bad_low") > worst, F.lit("block")).otherwise(F.lit("allow"))))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Outcomes: the labels whose id is the page's; a page of low quality or a toxic one counts as bad."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
parsed AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
label AS (SELECT doc_id, count(*) AS ln, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS lk FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
counts AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_last(string_split(host, '.')) AS suffix,
  coalesce(sum(ln), 0)::DOUBLE AS n, coalesce(sum(lk), 0)::DOUBLE AS k FROM parsed LEFT JOIN label ON page_id = doc_id GROUP BY host),
seen AS (SELECT * FROM counts WHERE n > 0),
top AS (SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS mean FROM seen),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(mean) AS mean FROM seen, top GROUP BY suffix),
sp AS (SELECT CASE WHEN (ss - pq * m) / n > 0 THEN greatest(2.0, least(200.0, pq / ((ss - pq * m) / n) - 1)) ELSE 200.0 END::DOUBLE AS s FROM (SELECT sum(n * mean * (1 - mean)) / sum(n) AS pq, sum(n) AS n, count(*) AS m, sum((k - n * mean) ** 2 / n) AS ss FROM s0)),
s1 AS (SELECT suffix, (k + s * mean) / (n + s) AS post, s FROM s0, sp),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(post) AS mean FROM seen JOIN s1 USING (suffix) GROUP BY domain, suffix),
dp AS (SELECT CASE WHEN (ss - pq * m) / n > 0 THEN greatest(2.0, least(200.0, pq / ((ss - pq * m) / n) - 1)) ELSE 200.0 END::DOUBLE AS s FROM (SELECT sum(n * mean * (1 - mean)) / sum(n) AS pq, sum(n) AS n, count(*) AS m, sum((k - n * mean) ** 2 / n) AS ss FROM d0)),
d1 AS (SELECT domain, (k + s * mean) / (n + s) AS post, s FROM d0, dp),
h0 AS (SELECT host, n, k, post AS mean FROM seen JOIN d1 USING (domain)),
hp AS (SELECT CASE WHEN (ss - pq * m) / n > 0 THEN greatest(2.0, least(200.0, pq / ((ss - pq * m) / n) - 1)) ELSE 200.0 END::DOUBLE AS s FROM (SELECT sum(n * mean * (1 - mean)) / sum(n) AS pq, sum(n) AS n, count(*) AS m, sum((k - n * mean) ** 2 / n) AS ss FROM h0)),
h1 AS (SELECT host, (k + s * mean) / (n + s) AS post, n + s AS weight FROM h0, hp),
rep AS (SELECT c.host, coalesce(h1.post, d1.post, s1.post, 0) AS mean, coalesce(h1.weight, d1.s, s1.s, 2.0) AS weight FROM counts c LEFT JOIN h1 USING (host) LEFT JOIN d1 ON c.domain = d1.domain LEFT JOIN s1 ON c.suffix = s1.suffix),
ruled AS (SELECT page_id, host, path, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM ruled LEFT JOIN rep USING (host)
"""
