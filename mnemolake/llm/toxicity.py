"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, brings compatibility forms together, drops zero-width characters, maps homoglyphs to Latin
letters and digit substitutions to the letters they stand for, and turns all else into spaces; accents stay, as
they tell words apart.  The lexicon holds beginnings of
words with weights, learned from labelled training rows: document frequencies in toxic and clean documents give
a log-odds weight, kept where the likelihood ratio stands out among all beginnings counted.  A word counts by its
longest entry.  Exception phrases (an entry with the word before or after it) are learned from clean documents and
their hits do not count.  Weights per length and in total go through a logistic curve.

Learning reads at most ``FIT_TOXIC`` + ``FIT_CLEAN`` labelled texts, chosen by a hash of the id, one for each id; scoring reads all.
The lexicon, at most ``LEXICON`` entries, and ``EXCEPTIONS`` phrases go to every task.

Defined results: null or empty texts score as texts without hits; rows that repeat an id are scored one by one, and the
least text of each id is learned from; without labelled rows nothing is learned and all scores are 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, python_ready

FIT_TOXIC = 20_000
FIT_CLEAN = 20_000
LEXICON = 20_000
EXCEPTIONS = 2_000
SHORTEST, LONGEST = 3, 9
THRESHOLD = 0.7
#: Log-odds of an entry, at least: 12 times as frequent in toxic documents.
LEAST_WEIGHT = math.log(12)

#: Characters that look like the Latin letters they are folded to.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])
_TABLE = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()} | _INVISIBLE
_OTHER = re.compile(r"[\W\d_]+")
_NUMBER = re.compile(r"(?<!\w)[\d.,:/+-]*\d[\d.,:/+-]*(?!\w)")


def fold(text: str | None) -> str:
    """The folded words of a text, each after one space."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
    text = _NUMBER.sub(" ", text).translate(_TABLE)
    return " " + _OTHER.sub(" ", text).strip()


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            own = set()
            for w in set(fold(text).split()):
                own.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
            words.extend(own)
            toxic.extend([label] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["w", "toxic"])


def _automaton(lexicon: dict[str, float]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, x in lexicon.items():
        a.add_word(" " + w, (len(w) + 1, w, x))
    a.make_automaton()
    return a


def _hits(folded: str, automaton) -> Iterator[tuple[str, float, str, str]]:
    """(entry, weight, word before, word after) of each hit."""
    for end, (length, entry, weight) in automaton.iter_long(folded):
        start = end - length + 1
        before = folded[folded.rfind(" ", 0, start) + 1 : start] if start > 0 else ""
        stop = folded.find(" ", end + 1)
        after = "" if stop < 0 else folded[stop + 1 : folded.find(" ", stop + 1) if folded.find(" ", stop + 1) > 0 else len(folded)]
        yield entry, weight, before, after


def _phrases(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(lexicon)
        for batch in batches:
            out, toxic = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own = set()
                for entry, _, before, after in _hits(fold(text), automaton):
                    own.update(x for x in (f"{before} {entry}" if before else "", f"{entry} {after}" if after else "") if x)
                out.extend(own)
                toxic.extend([label] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int32())], names=["w", "toxic"])

    return run


def measure(folded: str, automaton, exceptions: frozenset[str]) -> tuple[float, float]:
    """(weight in total, weight a hundred words) of the hits that count."""
    total = 0.0
    for entry, weight, before, after in _hits(folded, automaton):
        if f"{before} {entry}" not in exceptions and f"{entry} {after}" not in exceptions:
            total += weight
    return total, 100.0 * total / (folded.count(" ") + 20.0)


def _measures(lexicon: dict[str, float], exceptions: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(lexicon) if lexicon else None
        for batch in batches:
            m = [measure(fold(t), automaton, exceptions) if automaton else (0.0, 0.0) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([x for x, _ in m], pa.float64()), pa.array([y for _, y in m], pa.float64())],
                names=["doc_id", "total", "density"],
            )

    return run


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))


def choose_entries(counts: DataFrame, n_toxic: int, n_clean: int, limit: int) -> dict[str, float]:
    """Log-odds of the beginnings that toxic documents use more, significant among all of them."""
    tests = max(counts.count(), 2)
    p = n_toxic / (n_toxic + n_clean)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    weight = F.log((t + 0.5) / (n_toxic + 1.0)) - F.log((c + 0.5) / (n_clean + 1.0))
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((t + c) * share))).otherwise(0.0)
    ratio = 2 * (part(t, p) + part(c, 1 - p))
    rows = (
        counts.select("w", weight.alias("weight"), ratio.alias("g"))
        .where((F.col("weight") > LEAST_WEIGHT) & (F.col("g") > 2 * math.log(tests) + 10))
        .orderBy(F.desc("g"), "w").limit(limit).collect()
    )
    return {r["w"]: float(r["weight"]) for r in rows}


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of a logistic curve on (log total, log density), classes weighing alike; ridge."""
    z = np.column_stack([np.ones(len(x)), np.log1p(x)])
    s = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        grad = z.T @ (s * (p - y)) + 1e-5 * w * [0, 1, 1]
        hess = (z * (s * p * (1 - p))[:, None]).T @ z + 1e-5 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def scored(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; ``held_out``: a column of doc_id whose rows are never learned from."""
    with python_ready(docs.sparkSession):
        return materialise(_scored(docs, labels, held_out), "scores")


def _scored(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chance = F.xxhash64(F.lit(11), "doc_id")
    few = lambda k, n: marks.where(F.col("toxic") == k).orderBy(chance, "doc_id").limit(n)
    chosen = materialise(few(1, FIT_TOXIC).unionByName(few(0, FIT_CLEAN)), "chosen")
    one = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = materialise(one, "sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lexicon: dict[str, float] = {}
    exceptions: frozenset[str] = frozenset()
    curve = np.zeros(3)
    if size.get(1) and size.get(0):
        counts = materialise(_counted(sample.mapInArrow(_beginnings, "w string, toxic int")).where("t + c >= 2"), "counts")
        lexicon = choose_entries(counts, size[1], size[0], LEXICON)
    if lexicon:
        phrases = _counted(sample.mapInArrow(_phrases(lexicon), "w string, toxic int"))
        excused = phrases.where(f"c >= 3 and c / {size[0]} > 4 * t / {size[1]}").orderBy(F.desc("c"), "w").limit(EXCEPTIONS)
        exceptions = frozenset(r["w"] for r in excused.collect())
        m = sample.mapInArrow(_measures(lexicon, exceptions), "doc_id bigint, total double, density double").join(chosen, "doc_id").toPandas()
        curve = fit_curve(m[["total", "density"]].to_numpy(), m["toxic"].to_numpy())
    done = texts.mapInArrow(_measures(lexicon, exceptions), "doc_id bigint, total double, density double")
    if not lexicon:
        score = F.lit(0.0)
    else:
        line = F.lit(float(curve[0])) + F.lit(float(curve[1])) * F.log1p("total") + F.lit(float(curve[2])) * F.log1p("density")
        score = 1 / (1 + F.exp(-line))
    return done.select("doc_id", held_out.alias("held_out"), score.cast("double").alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored(docs, labels, held_out)
