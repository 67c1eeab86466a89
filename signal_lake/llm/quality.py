"""Quality rules: a threshold table compiled into one projection over native column expressions.

Defined cases: a null text is an empty text, with no words; an empty text fails the base rule on the number of
words; rows are judged one by one, so repeated rows get the same verdict each; all columns that came in stay,
and a column named like a metric is replaced by the metric.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signal_lake.llm.common import ASCII_SPACE, ASCII_SPACE_RE, let

#: Frequent function words of English, French, German and Spanish. Fixed values.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with he be at by this had not from or an which you but his "
    "le la les de des et un une est que qui dans pour en du sur pas au aux par elle il ce se ne "
    "der die das und ist den von zu mit sich auf nicht ein eine dem im auch als es sie "
    "el los las y por con no para del al lo como su"
).split()

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Keep a text while low <= metric <= high, if it has at least min_words words."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Wide enough that ordinary prose of any length passes.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.04, min_words=50),
    Rule("dup_line_ratio", high=0.5),
)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{ASCII_SPACE_RE}+"))


def _covered(starts: Column) -> Column:
    """Words covered by windows at these ascending starts."""
    gaps = let(starts, lambda p: F.transform(p, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - s, F.lit(WINDOW)))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur more than once. Equal windows have equal hashes, so a text whose hashes all differ
    has none; only the others have their windows themselves sorted and compared."""

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))

    def exact(w: Column) -> Column:
        windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
        twice = let(windows, lambda s: F.filter(s, lambda x, j: (x["w"] == F.get(s, j - 1)["w"]) | (x["w"] == F.get(s, j + 1)["w"])))
        return _covered(F.array_sort(F.transform(twice, lambda x: x["i"])))

    # F.get() gives null outside the array; null-safe because null | true is true and null | false filters out.
    return let(words, lambda w: F.when(F.size(w) < WINDOW, 0).otherwise(let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(exact(w)))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs and the metrics of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_words = docs.withColumns({"__text": t, "__words": words_of(t)})
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    stop = F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS)))
    base = with_words.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": (F.length("__text") - F.regexp_count("__text", F.lit(ASCII_SPACE_RE))).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long"),
            "__lines": counts,
            "n_repeat_words": _repeat_words(F.col("__words")).cast("long"),
            "n_stop_words": stop.cast("long"),
        }
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return base.withColumns(
        {
            "n_lines": F.col("__lines.n").cast("long"),
            "n_dup_lines": (F.col("__lines.n") - F.col("__lines.d")).cast("long"),
            "mean_word_chars": F.col("word_chars") / n,
            "symbol_ratio": F.col("n_symbols") / n,
            "stop_word_ratio": F.col("n_stop_words") / n,
            "dup_line_ratio": (F.col("__lines.n") - F.col("__lines.d")) / F.greatest(F.col("__lines.n"), F.lit(1)),
        }
    ).drop("__text", "__words", "__lines")


def compile_rules(rules=RULES) -> Column:
    """One boolean expression that is true where every rule holds."""
    verdict = F.lit(True)
    for r in rules:
        m = F.col(r.metric)
        ok = (m >= r.low if r.low is not None else F.lit(True)) & (m <= r.high if r.high is not None else F.lit(True))
        verdict = verdict & (ok if not r.min_words else ok | (F.col("n_words") < r.min_words))
    return verdict


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with metrics, base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measure(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that every rule keeps, with the columns that came in, also those named like a metric."""
    own = [F.col(c).alias(f"__in{i}") for i, c in enumerate(docs.columns)]
    judged = judge(docs.select(*own, F.col(text).alias("text")), "text", rules).where("kept")
    return judged.select(*[F.col(f"__in{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    from signal_lake.llm.common import table

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i+4], ' ')) AS c FROM i),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(5) AS r(k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n BETWEEN 2.0 AND 15.0 AND n_symbols / n <= 0.1
         AND (n_words < 50 OR n_stop / n >= 0.04) AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM b
"""
