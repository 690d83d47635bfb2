"""Quality rules: a threshold table compiled into one native projection.

Every metric is a built-in SQL expression over the whole text; the table of limits is data, and
``compile_rules`` turns it into one boolean column. No Python runs on the executors.

Defined results: a null text has no words (all counts 0, ``base_failed`` true, ``kept`` false), as
has an empty one; texts of any length are read whole; repeated rows are judged row by row; an empty
table gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns of any name
neither clash nor matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

# Frequent function words of the four languages that the rules know.
STOP_WORDS = """
a an and are as at be by for from he in is it of on or that the this to was with
au aux avec ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une
als auf das dem den der die ein eine er es im ist mit nicht sich sie und von zu
al asi como con del el ella ese esta lo los las mas no o para pero por se si su sus una y
""".split()

#: (name, numerator, denominator, least, most) in thousandths; a document of zero denominator passes.
#: Only counts and whole-number comparisons, so that every engine gives the same verdict.
THRESHOLDS = [
    ("word_length", "word_chars", "n_words", 1500, 25000),
    ("symbols_per_word", "n_symbols", "n_words", 0, 150),
    ("stop_words", "n_stop_words", "n_words", 20, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", 0, 600),
    ("upper_case", "n_upper", "n_letters", 0, 500),
    ("bangs_per_word", "n_bangs", "n_words", 0, 300),
]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def compile_rules(table=THRESHOLDS) -> str:
    """One SQL condition that is true where every rule of ``table`` holds."""
    parts = []
    for _, num, den, low, high in table:
        if low:
            parts.append(f"1000 * {num} >= {low} * {den}")
        if high is not None:
            parts.append(f"1000 * {num} <= {high} * {den}")
    return " AND ".join(f"({p})" for p in parts)


def metrics(documents: DataFrame) -> DataFrame:
    """Counts that the rules use, one row per input row.

    The counts leave through a generator of one row: a later filter on a verdict stays above it,
    where pushing it down would copy these expressions into each other many times over."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    counts = (
        documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .select("doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
        .select(
            "doc_id",
            "text",
            "words",
            F.expr("size(words)").alias("n"),
            F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
            F.expr(
                "sort_array(if(size(words) < 3, array(), transform(sequence(0, size(words) - 3), "
                "i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS p))))"
            ).alias("grams"),
        )
        .select(
            "doc_id",
            "text",
            "words",
            "n",
            "lines",
            F.expr(
                "sort_array(transform(filter(grams, (g, i) -> (i > 0 AND grams[greatest(i - 1, 0)].h = g.h) "
                "OR (i < n - 3 AND grams[least(i + 1, n - 3)].h = g.h)), g -> g.p))"
            ).alias("twice"),
        )
        .select(
            "doc_id",
            F.expr("bigint(n)").alias("n_words"),
            F.expr("bigint(length(array_join(words, '')))").alias("word_chars"),
            F.expr(r"bigint(length(regexp_replace(text, '[^#*$%&|<>]+', '')))").alias("n_symbols"),
            F.expr("bigint(size(lines) - size(array_distinct(lines)))").alias("n_dup_lines"),
            F.expr(
                "bigint(aggregate(twice, struct(0 AS total, -3 AS last), "
                "(a, p) -> struct(a.total + least(3, p - a.last) AS total, p AS last), a -> a.total))"
            ).alias("n_repeat_words"),
            F.expr(f"bigint(size(filter(words, w -> lower(w) IN ({stop}))))").alias("n_stop_words"),
            F.expr("bigint(size(lines))").alias("n_lines"),
            F.expr("bigint(length(regexp_replace(text, '[^A-Z]+', '')))").alias("n_upper"),
            F.expr("bigint(length(regexp_replace(text, '[^A-Za-z]+', '')))").alias("n_letters"),
            F.expr("bigint(length(regexp_replace(text, '[^!]+', '')))").alias("n_bangs"),
        )
    )
    return counts.select(F.inline(F.array(F.struct(*counts.columns))))


def quality_rules(documents: DataFrame, table=THRESHOLDS, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """``documents`` (doc_id, text) → metrics, ``base_failed`` and the verdict ``kept``."""
    failed = F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words")
    return (
        metrics(documents)
        .withColumn("base_failed", failed)
        .withColumn("kept", F.expr(f"NOT base_failed AND {compile_rules(table)}"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT row_number() OVER () AS r, * FROM d
), w AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM g WHERE len(words) >= 3)
), t AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM w) WHERE k > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM t) GROUP BY r
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words,
         len(lines)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_bangs
  FROM g LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND {compile_rules()} AS kept FROM b
"""
