"""URL filters in DataFrame functions only.

A URL is expanded into host-suffix and path-prefix expressions, joined with the rules on the first 32 bits of their digests, and
confirmed by the full digests; the longest rule wins, and of equally long ones a block. Distinct URLs are judged once.

Defined results: a URL that is null or has no ``://`` has an empty host and path; what no rule fits gets the default verdict
and a null rule; an empty rule list fits nothing; repeated rows stay repeated; a host of any length costs what the rules' lengths do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"
PREFIX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """(verdict, host, path) rules as a small table, with rule, digest and its prefix."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rules)
    frame = spark.sql(f"select * from values {values} as r(verdict, host, path)" if rules else "select '' as verdict, '' as host, '' as path where false")
    rule = F.concat(F.translate("host", _UPPER, _LOWER), "path")
    labels = F.size(F.split("host", r"\.", -1)).alias("labels")
    return frame.select("verdict", rule.alias("rule"), labels, F.length("path").alias("path_length"), F.sha2(rule, 256).alias("digest")).withColumn("prefix", F.left("digest", F.lit(PREFIX)))


def expressions(host: Column, path: Column, lengths: list[tuple[int, int]]) -> Column:
    """The host's last labels with the path's first characters, in every combination of numbers that some rule has. What no rule is as long as isn't built."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    known = F.transform(F.array(*(F.struct(F.lit(n).alias("labels"), F.lit(m).alias("length")) for n, m in lengths)), lambda x: x)
    fitting = F.filter(known, lambda x: (x["labels"] <= labels) & (x["length"] <= F.length(path)))
    suffixes = F.create_map(*(x for n in sorted({n for n, _ in lengths}) for x in (F.lit(n), F.substring_index(host, ".", -n))))
    return F.transform(fitting, lambda x: F.concat(F.element_at(suffixes, x["labels"]), F.left(path, x["length"])))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``pages`` (with url) plus host, path, rule and verdict, which take the place of columns so called.

    The rules' sizes (labels and path length), at most as many as the longest rule allows, come to the driver. Spark broadcasts the rules if their size allows.
    """
    lengths = sorted(map(tuple, rules.select("labels", "path_length").distinct().collect()))
    urls = pages.select("url").where("url is not null").distinct().select("url", host(F.col("url")).alias("h"), path(F.col("url")).alias("p"))
    if lengths:
        terms = urls.where("h != ''").select("url", F.explode(expressions(F.col("h"), F.col("p"), lengths)).alias("t"))
    else:
        terms = urls.where("false").select("url", F.lit("").alias("t"))
    terms = terms.withColumn("d", F.sha2("t", 256)).withColumn("prefix", F.left("d", F.lit(PREFIX)))
    fits = terms.join(rules, "prefix").where("d = digest")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("block"), "rule", "verdict")).alias("b"))
    best = best.select(F.concat("url", F.lit("")).alias("u"), F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))
    out = pages.select(F.struct("*").alias("page")).join(best, F.col("page.url") == F.col("u"), "left")
    url, made = F.col("page.url"), ("host", "path", "rule", "verdict")
    kept = [F.col("page").getField(c).alias(c) for c in pages.columns if c.lower() not in made]
    return out.select(*kept, host(url).alias("host"), path(url).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def url_filter_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
with r(v, h, p) as (values {rules}),
u as (select page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1), '') as path from pages),
m as (select page_id, host, path, h || p as rule, v, row_number() over (partition by page_id order by length(h || p) desc nulls last, v desc, h) as k
  from u left join r on (host = h or host like '%.' || h) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, '{DEFAULT}') as verdict from m where k = 1
"""
