"""URL filters: list rules first, then association rules mined by FP-growth. Native throughout.

``parse`` splits a url, ``tokens`` turns it into a small set of items, ``mine`` runs Spark's
FP-growth over the urls that bear a label and keeps the sets that imply it, pruned by support, by
confidence relative to the label's share among all labelled urls (lift), and by shorter rules that
already say so. Each label is mined apart, for sets of any size; of tokens that occur in exactly the
same labelled urls the least stands for all, so that a copied url of many parts makes no
exponential number of sets. ``match`` finds rules through an inverted index: each rule hangs on the
rarest of its tokens, urls look their own tokens up there, and a rule fires where all of its tokens
are present.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and no
tokens, and is allowed; a null label is none; long urls are read whole; repeated rows keep their
copies; ties between list rules of equal length go to the first in the list; ties between tokens go
to the least; without urls that bear a label, or in an empty table, no rule is mined. Of the pages
only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, input_bytes, stage, tasks_for

#: (verdict, host, path)
LIST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: A rule's tokens occur in so many thousandths of the urls that bear the label, in so many of them at
#: least, and its confidence is at least so many halves of the label's share.
MIN_SUPPORT_MILLE = 2
MIN_COUNT = 3
MIN_LIFT_HALVES = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(pages: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path`` to a frame with a ``url``."""
    return pages.drop("host", "path").select(
        "*",
        F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"),
    )


def list_rule(rules=LIST_RULES):
    """(rule, verdict) columns of the longest list rule that fits ``host`` and ``path``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens():
    """Items of a parsed url: host labels, registered domain, path parts with digits folded, query keys."""
    return F.expr(
        r"""array_distinct(if(host = '', cast(array() as array<string>), concat(
            transform(slice(split(host, '\\.'), 1, greatest(size(split(host, '\\.')) - 2, 0)), x -> concat('h:', x)),
            array(concat('d:', array_join(slice(split(host, '\\.'), -least(2, size(split(host, '\\.'))), 2), '.'))),
            transform(filter(split(path, '/'), x -> x <> ''), x -> concat('p:', regexp_replace(x, '[0-9]+', '0'))),
            transform(filter(split(regexp_extract(url, '(?s)^[^?#]*[?]([^#]*)', 1), '&'), x -> x <> ''), x -> concat('q:', split(x, '=')[0])),
            if(url like '%#%', array('f:'), cast(array() as array<string>)))))"""
    )


_RULES = "items array<string>, n_items int, confidence double, n_bad bigint"


def _folded(baskets: DataFrame, tasks: int | None) -> DataFrame:
    """``baskets`` (basket, items, bad) with only those tokens that stand for others."""
    single = baskets.select("basket", "bad", F.explode("items").alias("token"))
    where = single.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("basket")).alias("x"), F.bit_xor(F.xxhash64("basket", F.lit(1))).alias("y"))
    heads = stage(where.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token"), "url-tokens", tasks)
    return single.join(heads, "token").groupBy("basket", "bad").agg(F.collect_list("token").alias("items"))


def mine(labelled: DataFrame, support_mille: int = MIN_SUPPORT_MILLE, min_count: int = MIN_COUNT, lift_halves: int = MIN_LIFT_HALVES, tasks: int | None = None) -> DataFrame:
    """``labelled`` (items array<string>, bad boolean) → rules (items, n_items, confidence, n_bad); tables
    on the way are stored in at most ``tasks`` files."""
    spark = labelled.sparkSession
    rows = labelled.filter("size(items) > 0").select(F.monotonically_increasing_id().alias("basket"), "items", F.coalesce("bad", F.lit(False)).alias("bad"))
    baskets = stage(rows, "url-baskets", tasks)
    total, n_bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    if not n_bad:
        discard(baskets)
        return spark.createDataFrame([], _RULES)
    held = stage(_folded(baskets, tasks), "url-folded", tasks)
    at_least = max(min_count, -(-support_mille * n_bad // 1000))
    # FP-growth gets the bad baskets only: an itemset's count there is that of set and label together.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (at_least - 0.5) / n_bad), minConfidence=1.0).fit(held.filter("bad").select("items"))
    together = stage(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n_bad")).filter(F.col("n_bad") >= at_least), "url-itemsets", tasks)
    # How often each candidate occurs at all: through the same inverted index that matching uses.
    patterns = stage(held.select(F.array_sort("items").alias("items")).groupBy("items").agg(F.count("*").alias("n")), "url-seen", tasks)
    counted = match(patterns, together, tasks).groupBy("rule_items").agg(F.sum("n").alias("n_all"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    rules = (
        together.join(counted, together.items == counted.rule_items)
        .filter(2 * whole("n_bad") * F.lit(total) >= F.lit(lift_halves * n_bad) * whole("n_all"))
        .select("items", F.size("items").alias("n_items"), (F.col("n_bad") / F.col("n_all")).alias("confidence"), "n_bad")
    )
    rules = stage(rules, "url-rules", tasks)
    covered = match(rules.select("items", "n_items"), rules, tasks).filter("size(rule_items) < n_items").select("items").distinct()
    pruned = stage(rules.join(covered, "items", "left_anti"), "url-pruned", tasks)
    discard(baskets, held, together, patterns, rules)
    return pruned


def match(urls: DataFrame, rules: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows of ``urls`` (items, …) with each of ``rules`` (items) that fires on them, as ``rule_items``.

    The index holds a rule under that of its tokens which fewest of ``urls`` have. Catalyst broadcasts
    it while it is below the session's threshold and shuffles both sides beyond, where AQE splits a
    hot token. ``urls`` is read twice.
    """
    parts = rules.select(F.col("items").alias("rule_items"), F.explode("items").alias("token"))
    tokens = stage(parts.select("token").distinct(), "rule-tokens", tasks)
    often = urls.select(F.explode("items").alias("token")).join(tokens, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = parts.join(often, "token", "left").groupBy("rule_items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"))
    index = stage(rarest.select(F.col("r.token").alias("token"), "rule_items"), "rule-index", tasks)
    return (
        urls.select("*", F.explode("items").alias("token"))
        .join(index, "token")
        .filter(F.size(F.array_except("rule_items", "items")) == 0)
        .drop("token")
    )


def mined_rules(labelled: DataFrame, **limits) -> DataFrame:
    """``labelled`` (url and a boolean column for each label) → item sets that imply a label."""
    marks = [c for c in labelled.columns if c != "url"]
    seen = parse(labelled).select(tokens().alias("items"), *marks)
    found = None
    for mark in marks:
        part = mine(seen.select("items", F.col(mark).alias("bad")), **limits).select("items", F.lit(mark).alias("label"), "confidence")
        found = part if found is None else found.unionAll(part)
    return found


def url_filter(pages: DataFrame, labelled: DataFrame, rules=LIST_RULES, **limits) -> DataFrame:
    """``pages`` (page_id, url) with the verdict of the longest list rule, or else of the mined ones.

    ``labelled`` has ``url`` and a boolean column for each label that makes a url bad.
    """
    tasks = tasks_for(input_bytes(pages))
    mined = stage(mined_rules(labelled, tasks=tasks, **limits).select("items").distinct(), "url-mined", tasks)
    rule, verdict = list_rule(rules)
    judged = parse(pages.select("page_id", "url")).select("*", tokens().alias("items"), rule.alias("rule"), verdict.alias("listed"))
    # A set of tokens is judged once, however many urls have it.
    patterns = stage(judged.filter("listed IS NULL AND size(items) > 0").select("items").distinct(), "url-patterns", tasks)
    bad = stage(match(patterns, mined, tasks).select("items").distinct().withColumn("mined", F.lit(True)), "url-bad", tasks)
    discard(mined, patterns)
    return judged.join(bad, "items", "left").select(
        "page_id", "host", "path", "rule", F.expr("coalesce(listed, if(mined, 'block', 'allow'))").alias("verdict")
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls with the labels of the document that a page shows: the first number of the path is its doc_id.
    ``low`` is low quality; of several rows of a document any that bears a label counts."""
    number = F.expr(r"try_cast(regexp_extract(path, '/([0-9]{1,18})', 1) AS bigint)")
    low, toxic = (F.coalesce(F.max(F.col(c) == v), F.lit(False)) for c, v in (("quality", 0), ("toxic", 1)))
    marks = stage(labels.groupBy("doc_id").agg(low.alias("low"), toxic.alias("toxic")), "url-labels", tasks_for(input_bytes(labels)))
    return parse(pages.select("url")).withColumn("doc_id", number).join(marks, "doc_id").select("url", "low", "toxic")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_filter(pages, labelled_urls(pages, labels))


_CASES = " ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{{{kind}}}{host}{path}'"
    for kind, host, path in sorted(LIST_RULES, key=lambda r: -len(r[1] + r[2]))
)
ORACLE = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), i AS (
  SELECT *, string_split(host, '.') AS h, regexp_extract(url, '(?s)^[^?#]*[?]([^#]*)', 1) AS q FROM u
), t AS (
  SELECT page_id, url, host, path, CASE {_CASES} END AS listed,
         CASE WHEN host = '' THEN [] ELSE list_distinct(
           list_transform(h[1:greatest(len(h) - 2, 0)], lambda x: 'h:' || x) || ['d:' || array_to_string(h[greatest(len(h) - 1, 1):], '.')]
           || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g'))
           || list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: 'q:' || string_split(x, '=')[1])
           || CASE WHEN contains(url, '#') THEN ['f:'] ELSE [] END) END AS items
  FROM i
), b AS (
  SELECT row_number() OVER () AS r, items, low, toxic
  FROM t JOIN (SELECT doc_id, coalesce(bool_or(quality = 0), false) AS low, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1) l
    ON l.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})', 1) AS BIGINT)
  WHERE len(items) > 0
), x AS (
  SELECT r, unnest(items) AS a FROM b
), heads AS (
  SELECT min(a) AS a FROM (SELECT a, list(r ORDER BY r) AS rs FROM x GROUP BY a) GROUP BY rs
), f AS (
  SELECT r, list(a ORDER BY a) AS items, any_value(low) AS low, any_value(toxic) AS toxic FROM x JOIN heads USING (a) JOIN b USING (r) GROUP BY r
), marked AS (
  SELECT r, items, low AS bad, 'low' AS label FROM f UNION ALL SELECT r, items, toxic, 'toxic' FROM f
), sizes AS (
  SELECT label, count(*)::HUGEINT AS n, count(*) FILTER (bad)::HUGEINT AS n_bad FROM marked GROUP BY label
), grown AS (
  SELECT label, r, items, [a] AS s FROM (SELECT label, r, items, unnest(items) AS a FROM marked WHERE bad)
  UNION ALL
  SELECT label, r, items, list_append(s, a) FROM (SELECT label, r, items, s, unnest(items) AS a FROM grown) WHERE a > s[-1]
), sets AS (
  SELECT label, s, count(*) AS k FROM grown GROUP BY label, s
), rules AS (
  SELECT DISTINCT s FROM sets JOIN sizes USING (label)
  WHERE k >= greatest({MIN_COUNT}, ({MIN_SUPPORT_MILLE} * n_bad + 999) // 1000)
    AND 2 * k * n >= {MIN_LIFT_HALVES} * n_bad * (SELECT count(*) FROM f WHERE list_has_all(f.items, s))
)
SELECT page_id, host, path, substr(listed, instr(listed, '}}') + 1) AS rule,
       CASE WHEN listed IS NOT NULL THEN substr(listed, 2, instr(listed, '}}') - 2)
            WHEN EXISTS (SELECT 1 FROM rules WHERE list_has_all(t.items, s)) THEN 'block' ELSE 'allow' END AS verdict
FROM t
"""
