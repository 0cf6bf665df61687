"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a column expression and every rule a comparison on metrics, so the whole operator is a
map without a shuffle, whatever the size of the table.

Defined results: a null or empty text has no words and fails; repeated rows are judged one by one; an
empty table gives no rows; columns of the input are kept by ``judge`` and ``apply_rules``, but for those named
like the three that ``judge`` adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import packed, quoted

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with this is are was for in on it as by from at or an a "
    "der die das und ist nicht ein eine zu den mit von auf für im dem des sich auch "
    "le la les de des et est un une en que qui dans pour sur au du par avec pas "
    "el los las y es una por con para del se lo como más su al"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [least, most]; a bound of None is open."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The production table.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 1.5, 14.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.3),
    Rule("mark_ratio", "n_marks / n_words", None, 0.6),
    Rule("upper_ratio", "n_upper / word_chars", None, 0.35),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    Rule("characters_per_line", "word_chars / n_lines", 4.0, None),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _repeat_words(grams: Column) -> Column:
    """Words in windows whose hash occurs twice or more.  Most texts have none, which a set of hashes tells;
    the others sort (hash, place), so equal windows become neighbours."""
    m = F.size(grams)
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.zip_with(
        F.slice(placed, F.lit(1), F.greatest(m - 1, F.lit(0))),
        F.slice(placed, F.lit(2), F.greatest(m - 1, F.lit(0))),
        lambda a, b: F.when(
            a["h"] == b["h"],
            F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2),
        ).otherwise(F.array().cast("array<int>")),
    )
    return F.when(F.size(F.array_distinct(grams)) == m, F.lit(0)).otherwise(
        F.size(F.array_distinct(F.flatten(twice)))
    )


def with_metrics(docs: DataFrame, text_col: str = "text", into: str = "_q") -> DataFrame:
    """Add the struct ``into`` of metrics, all long, in one map over the table."""
    text, words, grams, lines = (f"{into}_{x}" for x in ("text", "words", "grams", "lines"))
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(words, F.array_remove(F.split(text, WORD_GAP), ""))
    n = F.size(words)
    gram = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    windows = F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), gram)
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    df = df.withColumns({grams: windows, lines: F.filter(F.split(text, "\n"), has_word)})
    t = F.col(text)
    metrics = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        _count_of(t, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(grams)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        _count_of(t, "[!?]").alias("n_marks"),
        _count_of(t, r"\p{Lu}").alias("n_upper"),
        F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        # not deterministic, so a filter on the metrics stays above them instead of repeating them for each use
        F.monotonically_increasing_id().alias("barrier"),
    )
    return df.withColumn(into, metrics).drop(text, words, grams, lines)


def compile_rules(rules: tuple[Rule, ...], into: str = "_q") -> Column:
    """One boolean column: all rules hold.  A metric that is undefined (no words) fails its rule."""
    verdict = F.lit(True)
    for rule in rules:
        over, under = (x.strip() for x in rule.metric.split("/"))
        value = F.col(f"{into}.{over}") / F.nullif(F.col(f"{into}.{under}"), F.lit(0))
        if rule.least is not None:
            verdict = verdict & F.coalesce(value >= F.lit(rule.least), F.lit(False))
        if rule.most is not None:
            verdict = verdict & F.coalesce(value <= F.lit(rule.most), F.lit(False))
    return verdict


def base_failed(into: str = "_q", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> Column:
    q = F.col(into)
    return (q["n_words"] < min_words) | (100 * q["n_repeat_words"] > max_repeat * q["n_words"])


def _judged(docs: DataFrame, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """(row, q, base_failed, kept)"""
    df = packed(docs).withColumn("content", F.col(f"row.{quoted(text_col)}"))
    df = with_metrics(df, "content", "q").withColumn("base_failed", base_failed("q"))
    return df.withColumn("kept", ~F.col("base_failed") & compile_rules(rules, "q"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents with the struct ``_q`` of metrics and booleans ``_base_failed`` and ``_kept``."""
    rest = [F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c.lower() not in ("_q", "_base_failed", "_kept")]
    done = _judged(docs, rules, text_col)
    return done.select(*rest, F.col("q").alias("_q"), F.col("base_failed").alias("_base_failed"), F.col("kept").alias("_kept"))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return _judged(docs, rules, text_col).where("kept").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    done = _judged(docs.select("doc_id", "text"), RULES, "text")
    return done.select("row.doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")
