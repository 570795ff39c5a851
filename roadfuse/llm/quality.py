"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

A sketch counts values in buckets whose bounds grow by a fixed factor, so each quantile has a
bounded relative error and two sketches merge by adding counts. The counts of all documents are
summed per language, source and measure before the shuffle; groups with few documents take the
merged sketch of their language, or of everything. A document is kept if no measure lies outside
its group's fences. Everything is built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from roadfuse.session import compute_once

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules.

    Fixed base: at least ``min_words`` words, and at most ``max_repeat_percent`` % of them in
    repeated 3-word windows. Adaptive: a measure may exceed its group's upper quartile (or fall
    below its lower one, for the two-sided word length) by ``spread`` interquartile ranges, and by
    ``slack`` of the measure at least, so that groups of even texts refuse nobody. ``growth`` is
    the factor between bucket bounds. A group needs ``min_docs`` documents for its own thresholds.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    spread: float = 4.0
    growth: float = 1.02
    min_docs: int = 200


#: Measure -> (slack, whether low values count too). All are rates in thousandths.
MEASURES = {"word_length": (1500, True), "symbol_rate": (100, False), "dup_line_rate": (400, False), "repeat_rate": (300, False)}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != "")


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all long; a null text has none.

    Columns of these names are replaced. A 3-word window repeats if its three words stand twice or
    more in the text; the words of all such windows count, the first occurrence's too.
    """
    docs = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    docs = compute_once(docs, {"_words": _words(F.col("_text"))})
    n = F.size("_words")
    # Windows as (hash, place): the places of equal hashes are neighbours once sorted.
    last = F.greatest(n - 2, F.lit(0))
    second, third = F.slice("_words", 2, last), F.slice("_words", 3, last)
    pairs = F.zip_with(
        F.zip_with(F.slice("_words", 1, last), second, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        third,
        lambda ab, c: F.xxhash64(ab["a"], ab["b"], c),
    )
    docs = compute_once(docs, {"_windows": F.sort_array(F.transform(pairs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))})
    same = lambda x, j: F.get("_windows", j)["h"].eqNullSafe(x["h"])
    docs = compute_once(
        docs, {"_again": F.sort_array(F.transform(F.filter("_windows", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))}
    )
    # Each repeated window covers three words, less those that the next one covers.
    covered = F.aggregate(
        F.transform("_again", lambda i, j: F.least(F.coalesce(F.get("_again", j + 1) - i, F.lit(3)), F.lit(3)).cast("long")),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: F.translate(x, WHITE, "") != "")
    docs = compute_once(docs, {"_lines": lines})
    length = lambda drop: F.char_length(F.translate("_text", drop, ""))
    return docs.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": length(WHITE).cast("long"),
            "n_symbols": (F.char_length("_text") - length(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered,
            "_n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_text", "_words", "_windows", "_again", "_lines")


def _rates() -> dict[str, Column]:
    per = lambda x, y: F.when(F.col(y) > 0, F.floor(1000 * F.col(x) / F.col(y))).otherwise(0).cast("long")
    return {
        "word_length": per("word_chars", "n_words"),
        "symbol_rate": per("n_symbols", "n_words"),
        "dup_line_rate": per("n_dup_lines", "_n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
    }


def sketches(measured: DataFrame, growth: float) -> DataFrame:
    """(lang, source, measure, bucket, n): bucket 0 holds 0, bucket b values from growth**(b-1) on."""
    long = measured.select("lang", "source", F.expr(f"stack({len(MEASURES)}, {', '.join(f"'{m}', {m}" for m in MEASURES)}) AS (measure, value)"))
    bucket = F.when(F.col("value") <= 0, 0).otherwise(F.floor(F.log("value") / F.log(F.lit(growth)) + F.lit(1e-9)) + 1)
    return long.withColumn("bucket", bucket.cast("int")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """Per key and measure: number of documents, low and high fence. One row per bucket is sorted."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "measure")
    upto = merged.withColumns({"upto": F.sum("n").over(of.orderBy("bucket")), "docs": F.sum("n").over(of)})
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.pow(F.lit(rules.growth), F.col("bucket") - 0.5))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, value))
    out = upto.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    slack = F.element_at(F.create_map(*[F.lit(x) for m, (s, _) in MEASURES.items() for x in (m, s)]), F.col("measure"))
    reach = F.greatest(F.lit(rules.spread) * (F.col("q3") - F.col("q1")), slack.cast("double"))
    low = F.when(F.col("measure").isin([m for m, (_, both) in MEASURES.items() if both]), F.col("q1") - reach)
    return out.select(*keys, "measure", "docs", low.alias("low"), (F.col("q3") + reach).alias("high"))


def _wide(fences: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    at = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return fences.groupBy(*keys).agg(
        F.max("docs").alias(f"{prefix}docs"), *[at(m, c).alias(f"{prefix}{m}_{c}") for m in MEASURES for c in ("low", "high")]
    )


def thresholds(sketch: DataFrame, rules: Rules) -> DataFrame:
    """Per (lang, source) the fences of its own sketch, or of its language's, or of everything."""
    own = _wide(_fences(sketch, ["lang", "source"], rules), ["lang", "source"], "own_")
    by_lang = _wide(_fences(sketch, ["lang"], rules), ["lang"], "lang_").withColumnRenamed("lang", "_lang")
    overall = _wide(_fences(sketch, [], rules), [], "all_").withColumn("_one", F.lit(1))
    both = own.withColumn("_one", F.lit(1)).join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).join(overall, "_one")
    pick = lambda c: (
        F.when(F.col("own_docs") >= rules.min_docs, F.col(f"own_{c}")).when(F.col("lang_docs") >= rules.min_docs, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    )
    return both.select("lang", "source", *[pick(f"{m}_{c}").alias(f"{m}_{c}") for m in MEASURES for c in ("low", "high")])


def apply_rules(docs: DataFrame, rules: Rules = Rules(), keep_measured=None) -> DataFrame:
    """``docs`` (text, lang, source, ...) with base_columns, base_failed and kept.

    Thresholds come from documents that pass the base; null languages and sources are groups like
    others. ``keep_measured`` may store the measured rows (without text), which are used twice.
    """
    measured = base_columns(docs)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed).withColumns(_rates())
    if keep_measured:
        measured = keep_measured(measured)
    limits = thresholds(sketches(measured.filter("not base_failed"), rules.growth), rules)
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True)) & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    dropped = ["_lang", "_source", "_n_lines", *[f"{m}_{c}" for m in MEASURES for c in ("low", "high")]]
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop(*dropped)


def _twin() -> str:
    rules = Rules()
    names = list(MEASURES)
    slack = "CASE measure " + " ".join(f"WHEN '{m}' THEN {s}" for m, (s, _) in MEASURES.items()) + " END"
    two_sided = ", ".join(f"'{m}'" for m, (_, both) in MEASURES.items() if both)

    def fences(keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""
  SELECT {by}measure, docs, CASE WHEN measure IN ({two_sided}) THEN q1 - reach END AS low, q3 + reach AS high FROM (
    SELECT *, greatest({rules.spread} * (q3 - q1), {slack}::DOUBLE) AS reach FROM (
      SELECT {by}measure, max(docs) AS docs, min(v) FILTER (WHERE upto * 4 >= docs) AS q1, min(v) FILTER (WHERE upto * 4 >= docs * 3) AS q3 FROM (
        SELECT {by}measure, CASE WHEN bucket = 0 THEN 0 ELSE pow({rules.growth}, bucket - 0.5) END AS v,
               sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS docs
        FROM (SELECT {by}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL))"""

    def pick(m: str, c: str) -> str:
        return f"CASE WHEN o.docs >= {rules.min_docs} THEN o.{c} WHEN l.docs >= {rules.min_docs} THEN l.{c} ELSE a.{c} END"

    return rf"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines
  FROM documents
),
grams AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM texts)
),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id
),
measured AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length,
         CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbol_rate,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_rate,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_rate
  FROM counts
),
sketch AS (
  SELECT lang, source, measure, CASE WHEN value <= 0 THEN 0 ELSE floor(ln(value) / ln({rules.growth}) + 1e-9) + 1 END::INT AS bucket, count(*) AS n
  FROM (SELECT * FROM measured WHERE NOT base_failed) UNPIVOT (value FOR measure IN ({', '.join(names)})) GROUP BY ALL
),
own AS ({fences('lang, source')}), of_lang AS ({fences('lang')}), overall AS ({fences('')}),
limits AS (
  SELECT o.lang, o.source, o.measure, {pick('', 'low')} AS low, {pick('', 'high')} AS high
  FROM own o JOIN of_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN overall a ON o.measure = a.measure
),
outside AS (
  SELECT DISTINCT v.doc_id FROM (SELECT * FROM measured UNPIVOT (value FOR measure IN ({', '.join(names)}))) v
  JOIN limits t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source AND v.measure = t.measure
  WHERE v.value > t.high OR v.value < t.low
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.doc_id IS NULL AS kept
FROM measured m LEFT JOIN outside o ON m.doc_id = o.doc_id
"""


#: DuckDB SQL for the base columns, base_failed and kept over ``documents``.
TWIN = _twin()
