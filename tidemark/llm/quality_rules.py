"""Quality rules whose cutoffs come with a guarantee on good documents.  DataFrame functions only.

Fixed base rules reject very short and very repetitive documents.  Above them, five shares per
document (``RULES``) are cut off where labelled documents show that little good text is lost.  For a
rule and a stratum, each cutoff of a fixed grid is a hypothesis "more than ``risk / rules`` of good
documents lie above it".  It is refuted by the exact binomial tail: with ``k`` of ``n`` labelled good
documents above the cutoff, P(Binomial(n, risk / rules) <= k) has to be at most
``delta / (strata * rules)``.  Along a grid the tests go from lenient to strict and stop at the first
that fails (fixed-sequence testing), so a grid needs no correction of its own; Bonferroni covers
strata and rules.  With probability ``1 - delta`` no stratum loses more than ``risk`` of its good
documents to the learnt rules.  Among the cutoffs that passed, the one that separates the labelled
poor from the labelled good documents best is used; where none separates, or too few good documents
are labelled (about ``log(strata * rules / delta) / risk * rules``), the rule stays silent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

WORDS = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """Reject where ``1000 * top / bottom`` is above the cutoff; cutoffs are multiples of ``step`` up to ``high``."""

    name: str
    top: str
    bottom: str
    step: int
    high: int


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 10, 1000),
    Rule("repeats", "n_repeat_words", "n_words", 10, 1000),
    Rule("dup_lines", "n_dup_lines", "n_words", 5, 500),
    Rule("capitals", "n_capitals", "word_chars", 10, 1000),
    Rule("word_length", "word_chars", "n_words", 250, 25000),
)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the word statistics of each whole text added (a null text has no words).

    Existing columns of those names are replaced.
    """
    clash = [c for c in docs.columns if c in STATISTICS]
    own = docs.drop(*clash)
    text, words, windows, spots, lines = (_free(own, n) for n in ("text_", "words_", "windows_", "spots_", "lines_"))
    keep = own.columns
    one = own.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    one = one.withColumn(words, F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0)))
    one = one.withColumn(lines, F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(WORDS)))
    two = one.select(
        *keep, text, words,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col(text), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
        F.regexp_count(F.col(text), F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        # Hash of the five words from each place on.
        F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5))))
        .otherwise(F.array().cast("array<bigint>")).alias(windows),
    )
    marked = F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    three = two.withColumn(spots, F.when(F.size(F.array_distinct(F.col(windows))) < F.size(windows), F.sort_array(marked)))
    twin = F.filter(F.col(spots), lambda x, j: (F.get(F.col(spots), j - 1)["h"] == x["h"]) | (F.get(F.col(spots), j + 1)["h"] == x["h"]))
    four = three.withColumn(spots, F.when(F.col(spots).isNotNull(), F.sort_array(F.transform(twin, lambda x: x["i"]))))
    gaps = F.transform(F.col(spots), lambda p, j: F.least(F.coalesce(F.get(F.col(spots), j + 1) - p, F.lit(5)), F.lit(5)))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))
    return four.withColumn("n_repeat_words", covered).select(*keep, *STATISTICS)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _value(rule: Rule) -> Column:
    return F.expr(f"1000 * {rule.top} div greatest({rule.bottom}, 1)")


def _log_factorial(n: Column) -> Column:
    """ln n!, by the exact factorial up to 20 and Stirling's series above."""
    x = (n + 1).cast("double")
    series = ((x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
              + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))))
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k <= n * p, and 1 above that.

    Terms are summed downwards from k; those more than a dozen standard deviations below it vanish.
    """
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 60)
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1).cast("bigint"), steps), start, add, lambda s: s["total"])
    return F.when(k > n * p, F.lit(1.0)).when(k <= 0, first).otherwise(total)


def cutoffs(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", quality_col: str = "quality",
            risk: float = 0.02, delta: float = 0.1) -> DataFrame:
    """Chosen cutoff per stratum and rule: (stratum, rule, cutoff), from the labelled rows of ``stats`` that pass the base rules.

    ``labels`` may repeat an id (the better label counts); null labels are left out.  A null stratum
    counts as the empty string.
    """
    marks = labels.where(F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(
        F.max(F.col(quality_col)).alias("good"))
    rows = stats.where(~base_failed()).select(
        F.col(id_col).alias("label_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.step).alias("step"),
                           F.least(F.ceil(_value(r) / r.step), F.lit(r.high // r.step + 1)).alias("slot")) for r in RULES]).alias("values"))
    seen = rows.join(marks, "label_id").select("stratum", "good", F.inline("values"))
    counted = seen.groupBy("stratum", "rule", "step", "slot").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("poor"))
    group = Window.partitionBy("stratum", "rule")
    # A value in slot s lies above every cutoff of a lower slot; the slots without rows have the counts of their lower neighbour.
    above = group.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    tested = counted.select(
        "stratum", "rule", (F.col("slot") * F.col("step")).cast("long").alias("cutoff"),
        F.coalesce(F.sum("good").over(above), F.lit(0)).alias("k"), F.coalesce(F.sum("poor").over(above), F.lit(0)).alias("caught"),
        F.sum("good").over(group).alias("n"), F.sum("poor").over(group).alias("n_poor"))
    strata = counted.agg(F.count_distinct("stratum").alias("strata"))
    passed = tested.crossJoin(strata).where(
        binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= F.lit(delta) / (F.col("strata") * len(RULES)))
    gain = F.col("caught") * F.col("n") - F.col("k") * F.col("n_poor")
    return passed.where(gain > 0).groupBy("stratum", "rule").agg(
        F.max_by("cutoff", F.struct(gain, F.col("cutoff"))).alias("cutoff"))


def verdicts(stats: DataFrame, chosen: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``; columns of those names are replaced."""
    stats = stats.drop("base_failed", "kept")
    key, limits = _free(stats, "stratum_"), _free(stats, "limits_")
    # One row per stratum, written so that Spark knows its size when it picks the join.
    table = stored(chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits")), "cutoffs")
    table = table.select(F.col("stratum").alias(key), F.col("limits").alias(limits))
    joined = stats.join(table, F.coalesce(stats[stratum_col].cast("string"), F.lit("")) == table[key], "left")
    learnt = F.lit(False)
    for rule in RULES:
        learnt = learnt | F.coalesce(_value(rule) > F.element_at(F.col(limits), rule.name), F.lit(False))
    return joined.select(*stats.columns, base_failed().alias("base_failed"), (~base_failed() & ~learnt).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          risk: float = 0.02, delta: float = 0.1, keep_text: bool = True) -> DataFrame:
    """Statistics and verdict for every row of ``docs`` (all its columns, or id and stratum only).

    Null texts have no words and fail the base rules, as empty ones do; repeated rows are judged alike;
    empty tables give empty results; without labels only the base rules speak.
    """
    if not keep_text:
        stats = stored(statistics(docs.select(id_col, stratum_col, text_col), text_col).drop(text_col), "quality")
    else:
        stats = stored(statistics(docs, text_col), "quality")
    return verdicts(stats, cutoffs(stats, labels, id_col, stratum_col, risk=risk, delta=delta), stratum_col)


def oracle(risk: float = 0.02, delta: float = 0.1) -> str:
    """DuckDB twin of ``judge`` over documents and labels."""
    rules = " UNION ALL ".join(
        f"SELECT doc_id, lang, '{r.name}' AS rule, {r.step} AS step, 1000 * {r.top} // greatest({r.bottom}, 1) AS value, {r.high} AS high FROM base"
        for r in RULES)
    share = risk / len(RULES)
    return f"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM docs WHERE len(words) >= 5),
runs AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 4], ' ')) AS n FROM places),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM runs, range(5) AS t(k) WHERE n > 1 GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
twins AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
plain AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
  FROM docs d LEFT JOIN twins t ON d.doc_id = t.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM plain),
valued AS ({rules}),
marks AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT v.lang, rule, step, least(ceil(value / step), high // step + 1)::BIGINT AS slot, good
  FROM valued v JOIN marks m ON v.doc_id = m.doc_id JOIN base b ON v.doc_id = b.doc_id WHERE NOT base_failed),
slots AS (SELECT lang, rule, slot, any_value(step) AS step, count(*) FILTER (good = 1) AS good, count(*) FILTER (good <> 1) AS poor
  FROM labelled GROUP BY lang, rule, slot),
tested AS (SELECT lang, rule, slot * step AS cutoff,
    coalesce(sum(good) OVER (PARTITION BY lang, rule ORDER BY slot DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
    coalesce(sum(poor) OVER (PARTITION BY lang, rule ORDER BY slot DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caught,
    sum(good) OVER (PARTITION BY lang, rule) AS n, sum(poor) OVER (PARTITION BY lang, rule) AS n_poor FROM slots),
passed AS (SELECT * FROM tested WHERE n > 0 AND k <= n * {share!r} AND list_sum(list_transform(range(0, k::BIGINT + 1),
    lambda j: exp(lgamma(n::DOUBLE + 1) - lgamma(j::DOUBLE + 1) - lgamma(n::DOUBLE - j + 1) + j * ln({share!r}) + (n::DOUBLE - j) * ln(1 - {share!r}))))
    <= {delta!r} / ((SELECT count(DISTINCT lang) FROM slots) * {len(RULES)})),
chosen AS (SELECT lang, rule, arg_max(cutoff, (caught * n - k * n_poor, cutoff)) AS cutoff FROM passed WHERE caught * n - k * n_poor > 0 GROUP BY lang, rule),
rejected AS (SELECT DISTINCT doc_id FROM valued v JOIN chosen c ON v.lang = c.lang AND v.rule = c.rule WHERE value > cutoff)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND r.doc_id IS NULL AS kept
FROM base b LEFT JOIN rejected r ON b.doc_id = r.doc_id"""
