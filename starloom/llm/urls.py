"""URL filters: explicit host and path rules, and empirical-Bayes host reputation where no rule speaks.

A page's outcome is bad if the document that its path names is labelled toxic or of low quality. Outcomes are shrunk
level by level: a suffix (last label) towards all pages, a registered domain (last two labels) towards its suffix, a
host towards its domain, each through a beta prior whose weight comes from the spread of that level's shares. A host
is blocked if the lower posterior bound of its share of bad pages exceeds the share among all labelled pages: if it is
worse than the corpus, as far as its pages tell. DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: The rules of this query: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
TIMES = 1.0  # the corpus's share of bad pages, taken so many times, is what the lower bound must exceed to block
DEVIATIONS = 1.28  # of the posterior, between its mean and its bound: about nine in ten, by the normal approximation
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0  # of a prior, in pages
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, #
    or the end. Null urls and those without :// have empty ones."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _CAPITALS, _SMALL), path


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host is the url's or a parent of it, its path starts the
    url's. Null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, pages, bad): labelled pages by host. The document's id is the first number that makes a whole segment of
    the path, or starts one before a dot. Labels are merged by id first: bad if any says so."""
    host, path = url_parts(F.col("url"))
    found = pages.select(host.alias("host"), F.regexp_extract(path, r"/([0-9]{1,18})(?:[./]|$)", 1).alias("id")).where("id <> '' and host <> ''")
    seen = found.groupBy("host", F.col("id").cast("bigint").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    bad = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id")
    bad = bad.agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return seen.join(bad, "doc_id").groupBy("host").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.col("bad")).alias("bad"))


def _level(counts: DataFrame, keys: list[str], prior: Column, name: str) -> DataFrame:
    """Adds `name`: the posterior mean of each group of `keys`, and `name`_weight: its posterior weight in pages. The
    prior's weight follows from the spread of shares over what chance gives, by the method of moments."""
    by = counts.groupBy(*keys).agg(F.sum("pages").alias("m"), F.sum("bad").alias("k"), F.first(prior).alias("p"))
    share = F.col("k") / F.col("m")
    chance = F.col("p") * (1 - F.col("p"))
    fit = by.agg(
        F.sum(F.col("m") * (share - F.col("p")) * (share - F.col("p"))).alias("spread"), F.sum(chance).alias("chance"), F.sum(F.col("m") * chance).alias("whole"), F.count(F.lit(1)).alias("groups")
    )
    # E[m (share - p)^2] = p(1-p) (1 + (m-1) rho), with rho = 1 / (weight + 1)
    rho = (F.col("spread") - F.col("chance")) / (F.col("whole") - F.col("chance"))
    weight = F.when((F.col("whole") > F.col("chance")) & (rho > 0), F.least(F.greatest(1 / rho - 1, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))).otherwise(MOST_WEIGHT)
    posterior = by.join(F.broadcast(fit.select(weight.alias("w"))))
    posterior = posterior.select(*keys, ((F.col("k") + F.col("w") * F.col("p")) / (F.col("m") + F.col("w"))).alias(name), (F.col("m") + F.col("w")).alias(f"{name}_weight"))
    return stage(counts.join(posterior, keys), name)


def domains(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the last two labels and the last one; a numeric address is its own domain and suffix."""
    numeric = host.rlike(r"^[0-9.]+(:[0-9]*)?$")
    return F.when(numeric, host).otherwise(F.substring_index(host, ".", -2)), F.when(numeric, host).otherwise(F.substring_index(host, ".", -1))


def reputation(seen: DataFrame) -> DataFrame:
    """Rows of hosts with labelled pages: posterior means and weights by suffix, domain and host, and the host's bound.
    The table is small beside the pages, and each level reads it twice, so it is written out level by level."""
    domain, suffix = domains(F.col("host"))
    counts = seen.select("host", domain.alias("domain"), suffix.alias("suffix"), F.col("pages").cast("double").alias("pages"), F.col("bad").cast("double").alias("bad"))
    whole = counts.agg(((F.sum("bad") + 1) / (F.sum("pages") + 2)).alias("all"))
    counts = stage(counts.join(F.broadcast(whole)), "hosts")
    counts = _level(counts, ["suffix"], F.col("all"), "by_suffix")
    counts = _level(counts, ["domain", "suffix"], F.col("by_suffix"), "by_domain")
    counts = _level(counts, ["host", "domain", "suffix"], F.col("by_domain"), "share")
    return counts.select("host", "domain", "suffix", "by_domain", "by_domain_weight", "by_suffix", "by_suffix_weight", "share", "all", bound("share", "share_weight").alias("bound"))


def bound(mean: str, weight: str) -> Column:
    """Lower bound of a beta posterior: its mean less DEVIATIONS standard deviations."""
    m, w = F.col(mean), F.col(weight)
    return m - DEVIATIONS * F.sqrt(m * (1 - m) / (w + 1))


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_bound, bad_limit) of each page.

    A host without labelled pages goes by its domain, then by its suffix; one without either, and an empty host, is
    allowed. Null urls have empty hosts and paths. Repeated pages stay, an empty table gives none; without labels only
    rules block. Columns besides page_id and url are not read.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    known = reputation(outcomes(pages, labels))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    domain, suffix = domains(F.col("host"))
    hosts = rows.select("host").distinct().withColumns({"domain": domain, "suffix": suffix})
    by_host = known.select("host", F.col("bound").alias("b1"))
    by_domain = known.groupBy("domain").agg(F.first(bound("by_domain", "by_domain_weight")).alias("b2"))
    by_suffix = known.groupBy("suffix").agg(F.first(bound("by_suffix", "by_suffix_weight")).alias("b3"))
    hosts = hosts.join(by_host, "host", "left").join(by_domain, "domain", "left").join(by_suffix, "suffix", "left")
    # Written out, so that both sides of the join are shuffled for it and a host with very many pages can be split
    limit = known.agg(F.round(F.max("all") * TIMES, 9).alias("bad_limit"))
    hosts = hosts.select("host", F.round(F.coalesce("b1", "b2", "b3"), 9).alias("bad_bound")).join(F.broadcast(limit))
    hosts = stage(hosts, "bounds")
    out = rows.join(hosts, "host", "left").withColumns({"rule": rule, "stated": verdict})
    verdict = F.coalesce("stated", F.when(F.col("bad_bound") > F.col("bad_limit"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_bound", "bad_limit")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


_LEVEL_SQL = """{name}_by AS (SELECT {keys}, sum(pages) m, sum(bad) k, min({prior}) p FROM {source} GROUP BY {keys}),
{name}_fit AS (SELECT sum(m * (k / m - p) * (k / m - p)) spread, sum(p * (1 - p)) chance, sum(m * p * (1 - p)) whole FROM {name}_by),
{name}_w AS (SELECT CASE WHEN whole > chance AND (spread - chance) / (whole - chance) > 0 THEN least(greatest(1 / ((spread - chance) / (whole - chance)) - 1, 2.0), 1000.0) ELSE 1000.0 END w FROM {name}_fit),
{name}_c AS (SELECT c.*, (b.k + w * b.p) / (b.m + w) AS {name}, b.m + w AS {name}_weight FROM {source} c JOIN {name}_by b USING ({keys}), {name}_w)"""

SQL = (
    r"""WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM cut),
seen AS (SELECT host, CAST(regexp_extract(path, '/([0-9]{1,18})(?:[./]|$)', 1) AS BIGINT) doc_id, count(*) n FROM p WHERE host <> '' AND regexp_extract(path, '/([0-9]{1,18})(?:[./]|$)', 1) <> '' GROUP BY ALL),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
hosts AS (SELECT host, @DOMAIN@ domain, @SUFFIX@ suffix, sum(n)::DOUBLE pages, sum(n * bad)::DOUBLE bad FROM seen JOIN marks USING (doc_id) GROUP BY ALL),
c0 AS (SELECT hosts.*, (SELECT (sum(bad) + 1) / (sum(pages) + 2) FROM hosts) AS everything FROM hosts),
"""
    + ",\n".join(
        _LEVEL_SQL.format(name=n, keys=k, prior=p, source=s)
        for n, k, p, s in (("by_suffix", "suffix", "everything", "c0"), ("by_domain", "domain, suffix", "by_suffix", "by_suffix_c"), ("share", "host, domain, suffix", "by_domain", "by_domain_c"))
    )
    + """,
b1 AS (SELECT host, share - 1.28 * sqrt(share * (1 - share) / (share_weight + 1)) b FROM share_c),
b2 AS (SELECT domain, min(by_domain - 1.28 * sqrt(by_domain * (1 - by_domain) / (by_domain_weight + 1))) b FROM share_c GROUP BY 1),
b3 AS (SELECT suffix, min(by_suffix - 1.28 * sqrt(by_suffix * (1 - by_suffix) / (by_suffix_weight + 1))) b FROM share_c GROUP BY 1),
r AS (SELECT p.*, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS "rule",
  round(coalesce(b1.b, b2.b, b3.b), 9) bad_bound, (SELECT round(max(everything), 9) FROM c0) bad_limit
  FROM p LEFT JOIN b1 USING (host) LEFT JOIN b2 ON b2.domain = @DOMAIN@ LEFT JOIN b3 ON b3.suffix = @SUFFIX@)
SELECT page_id, host, path, "rule", CASE "rule" WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
  ELSE CASE WHEN bad_bound > bad_limit THEN 'block' ELSE 'allow' END END AS verdict, bad_bound, bad_limit FROM r"""
)
_NUMERIC = "CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]*)?$') THEN host ELSE {} END"
SQL = SQL.replace("@DOMAIN@", _NUMERIC.format("array_to_string(string_split(host, '.')[-2:], '.')")).replace("@SUFFIX@", _NUMERIC.format("string_split(host, '.')[-1]"))
