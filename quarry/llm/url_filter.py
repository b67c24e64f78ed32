"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Rules are (host, path prefix); a rule fits its host and all subdomains if the url's
path starts with the rule's path, and the longest fitting rule wins. Every other url
gets the method's verdict: labelled page outcomes are counted by host, registered
domain and public suffix; each level's rate is shrunk towards its parent's by a
beta-binomial prior whose strength is the level's moment estimate, but never more than
the number of all labelled pages, which is all that is known about a level without
measurable spread; a url is blocked if the lower posterior bound of its host's rate of
bad pages exceeds the rate of all labelled pages `worse` times over: if its host is
credibly worse than the table. The bound holds the parents' uncertainty: by the law of
total variance a level's variance is its own and its parent's times the square of the
prior's share. So the verdict doesn't hang on how common bad pages are or how many are
labelled: a host that differs by chance is as a rule allowed, with few labels as with many.

Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased. Path: then up
to `?`, `#` or end. A null url or one without `://` has empty host and path, which
make up a host like any other. Null outcomes count as unlabelled; a page labelled more
than once, or in repeated rows, is bad if one of its labels is. Repeated rows of pages
return repeated rows and, having one page_id, share their outcome. Rules of equal length
that fit go by code point. Very long urls are taken whole. Empty tables give empty
results; with no outcome at all the rate is 0 and nothing is blocked. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, table

#: (verdict, rule)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Public suffixes of two labels; any other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx", "co.kr")
#: One posterior in a hundred lies below the bound.
Z = 2.326
#: A host is blocked if the lower bound of its rate exceeds the table's rate so many times over.
WORSE = 1.0
WEAKEST, STRONGEST = 1.0, 10_000.0
#: Host tables are broadcast up to this many rows, and joined by shuffling beyond.
BROADCAST_HOSTS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule or null; a list of rules that fits in one expression."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, rest = rule.partition("/")
        fits.append(F.when(((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}"), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def strength(children: DataFrame, evidence: float) -> float:
    """The prior strength of a level, by moments, at most `evidence`. children: n, s (bad ones), m (the parent's rate)."""
    n, m = F.col("n").cast("double"), F.col("m")
    row = children.where("n > 0").agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"), F.sum(n * (F.col("s") / n - m) * (F.col("s") / n - m)).alias("ss"), F.sum(n * m * (1 - m)).alias("v")).first()
    most = max(WEAKEST, min(STRONGEST, evidence))
    if not row["k"] or row["n"] is None or row["v"] <= 0:
        return most
    mean_v, spread = row["v"] / row["n"], row["n"] - row["n2"] / row["n"]
    between = (row["ss"] - (row["k"] - 1) * mean_v) / spread if spread > 0 else 0.0
    return min(most, max(WEAKEST, mean_v / between - 1)) if between > 0 else most


def reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, s) -> (host, rate, lower, base): posterior mean and lower bound of each host's rate of bad pages, and the rate of all pages."""
    hosts = cut(outcomes.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    labelled = float(total["n"] or 0)
    base = total["s"] / labelled if labelled else 0.0

    def shrunk(level: DataFrame, *keys: str) -> DataFrame:
        """keys, m and v: mean and variance of the rate of each row of level (n, s, and the parent's m and v)."""
        k = F.lit(strength(level, labelled))
        a, b = k * F.col("m") + F.col("s"), k * (1 - F.col("m")) + F.col("n") - F.col("s")
        mean, share = a / (a + b), k / (k + F.col("n"))
        return level.select(*keys, mean.alias("m"), (mean * (1 - mean) / (a + b + 1) + share * share * F.col("v")).alias("v"))

    counts = (F.sum("n").alias("n"), F.sum("s").alias("s"))
    root = {"m": F.lit(base), "v": F.lit(base * (1 - base) / (labelled + 1))}
    suffixes = cut(shrunk(hosts.groupBy("suffix").agg(*counts).withColumns(root), "suffix"))
    domains = cut(shrunk(hosts.groupBy("domain", "suffix").agg(*counts).join(suffixes, "suffix"), "domain"))
    out = shrunk(cut(hosts.join(domains, "domain")), "host")
    return cut(out.select("host", F.col("m").alias("rate"), F.greatest(F.lit(0.0), F.col("m") - z * F.sqrt("v")).alias("lower"), F.lit(base).alias("base")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, worse: float = WORSE, z: float = Z) -> DataFrame:
    """Verdicts of pages (page_id, url). outcomes: (page_id, bad 0/1 or null), one row a page at most."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where(F.col("bad").isNotNull()).select(F.col("page_id").alias("_id"), F.col("bad").cast("long").alias("bad"))
    counted = urls.join(known, F.col("page_id") == F.col("_id"), "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("s"))
    hosts = reputation(counted, z)
    small = hosts.count() <= BROADCAST_HOSTS
    verdicts = dict((rule, verdict) for verdict, rule in rules)
    out = urls.join(F.broadcast(hosts) if small else hosts, "host", "left").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(*(F.when(F.col("rule") == rule, F.lit(verdict)) for rule, verdict in verdicts.items()), F.when(F.col("lower") > F.col("base") * worse, F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", by_rule.alias("verdict"), F.round("rate", 4).alias("bad_rate"), F.round("lower", 4).alias("bad_lower"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled outcomes: the first number in a url's path names the document it shows; bad if that is labelled of low quality or toxic."""
    shown = pages.select("page_id", F.nullif(F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|$)", 1), F.lit("")).cast("long").alias("doc_id"))
    bad = F.max(((F.col("quality") == 0) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad")
    marked = labels.groupBy("doc_id").agg(bad)
    return shown.where(F.col("page_id").isNotNull()).join(marked, "doc_id").groupBy("page_id").agg(F.max("bad").alias("bad"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


def _oracle() -> str:
    two = ", ".join(f"'{s}'" for s in SUFFIXES)
    last = lambda k: f"array_to_string(list_slice(string_split(host, '.'), -{k}, -1), '.')"
    rules = " ".join(f"WHEN (host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])))
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)

    def level(name: str, rows: str) -> str:
        most = f"greatest({WEAKEST}::DOUBLE, least({STRONGEST}::DOUBLE, (SELECT coalesce(sum(n), 0)::DOUBLE FROM h)))"
        return f"""{name}_in AS ({rows}),
{name}_k AS (SELECT CASE WHEN count(*) = 0 OR sum(n * m * (1 - m)) <= 0 THEN {most} ELSE (
    SELECT CASE WHEN btw > 0 THEN least({most}, greatest({WEAKEST}::DOUBLE, mv / btw - 1)) ELSE {most} END
    FROM (SELECT mv, CASE WHEN sp > 0 THEN (ss - (kk - 1) * mv) / sp ELSE 0 END AS btw FROM (
      SELECT count(*) AS kk, sum(n * m * (1 - m)) / sum(n) AS mv, sum(n::DOUBLE) - sum(n::DOUBLE * n) / sum(n) AS sp, sum(n * (s / n::DOUBLE - m) * (s / n::DOUBLE - m)) AS ss FROM {name}_in WHERE n > 0))) END AS k FROM {name}_in WHERE n > 0),
{name}_p AS (SELECT i.*, k, k * m + s AS a, k * (1 - m) + n - s AS b FROM {name}_in i, {name}_k),
{name} AS (SELECT * EXCLUDE (m, v), a / (a + b) AS m, a / (a + b) * (1 - a / (a + b)) / (a + b + 1) + k / (k + n) * (k / (k + n)) * v AS v FROM {name}_p)"""

    return rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR coalesce(toxic = 1, FALSE) THEN 1 WHEN quality IS NULL THEN NULL ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT page_id, max(bad) AS bad FROM u JOIN lab ON lab.doc_id = nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1), '')::BIGINT GROUP BY page_id),
c AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS s FROM u LEFT JOIN o USING (page_id) GROUP BY host),
h AS (SELECT *, CASE WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix, CASE WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain FROM c),
b AS (SELECT coalesce(sum(s) / nullif(sum(n), 0)::DOUBLE, 0) AS base, coalesce(sum(n), 0)::DOUBLE AS labelled FROM h),
{level("sx", "SELECT suffix, sum(n)::DOUBLE AS n, sum(s) AS s, any_value(base) AS m, any_value(base * (1 - base) / (labelled + 1)) AS v FROM h, b GROUP BY suffix")},
{level("dm", "SELECT domain, any_value(h.suffix) AS suffix, sum(h.n)::DOUBLE AS n, sum(h.s) AS s, any_value(sx.m) AS m, any_value(sx.v) AS v FROM h JOIN sx ON h.suffix = sx.suffix GROUP BY domain")},
{level("ho", "SELECT host, h.n::DOUBLE AS n, h.s, dm.m, dm.v FROM h JOIN dm ON h.domain = dm.domain")},
r AS (SELECT host, m AS rate, greatest(0.0::DOUBLE, m - {Z}::DOUBLE * sqrt(v)) AS lower_, base FROM ho, b),
j AS (SELECT u.*, rate, lower_, base, CASE {rules} END AS rule FROM u LEFT JOIN r USING (host))
SELECT page_id, host, path, rule, CASE {verdicts} WHEN lower_ > base * {WORSE}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict, round(rate, 4) AS bad_rate, round(lower_, 4) AS bad_lower FROM j
"""


QUERIES = {"op3_host_reputation": op3_host_reputation}
ORACLES = {"op3_host_reputation": _oracle()}
