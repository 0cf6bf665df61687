"""Text expressions: tokens, lexical scores, normal forms, policy predicates.  All are Column functions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM_GAP = r"[^\p{IsAlphabetic}\p{N}]+"

#: Words that carry no information in a quote.
STOP_WORDS = (
    "a an and the to of for in on with i we you that this it them those these do then alright ok okay please just good sounds".split()
)
#: Names that say nothing about an entity.
GENERIC_SURFACES = (
    "agent application assistant client code data deployment devtool documentation entry file flow implementation "
    "lane pipeline project repository request response script scripts server session shader state status system "
    "tool tooling user"
).split()
#: Words left out of an entity's token set.
GENERIC_TOKENS = (
    "application component directory file module project repository repo server service subsystem system tool"
).split()
#: Phrases of summaries that describe something transient.
TRANSIENT_PHRASES = (
    "source-control branch", "source control branch", "git branch", "temporary branch", "task branch",
    "temporary worktree", "task worktree", "benchmark run", "test run", "build instance", "deployment instance",
    "session instance", "dated snapshot",
)
#: Phrases of summaries that describe a category.
WRAPPER_PHRASES = (
    "category of", "general category", "class of systems", "class of tools", "class of applications",
    "broad concept", "general concept",
)
#: Numbers in words.
UNITS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), ALNUM_GAP), "")


def lexical_terms(text: Column) -> Column:
    """Distinct tokens by first place."""
    return F.array_distinct(words(text))


def count_within(text: Column, term: Column) -> Column:
    """Occurrences of a substring, without overlaps."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(0).cast("int")


def lexical_score(text: Column, terms: Sequence[str]) -> Column:
    """0.85 x share of terms that are tokens + 0.15 x their capped frequency."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return F.lit(0.0)
    n = len(terms)
    # text and tokens are bound once a row, whatever the number of terms, and so are the counts
    bound = F.array(F.struct(F.lower(F.coalesce(text, F.lit(""))).alias("low"), words(text).alias("own")))
    capped = lambda x, t: F.when(F.array_contains(x["own"], t), F.least(count_within(x["low"], t), F.lit(4))).otherwise(0)
    counts = F.transform(bound, lambda x: F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: capped(x, t)))
    matched = lambda c: F.size(F.filter(c, lambda x: x > 0))
    often = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    score = lambda c: F.lit(0.85) * matched(c) / n + F.lit(0.15) * F.least(often(c) / F.lit(2.0 * n), F.lit(1.0))
    return F.get(F.transform(counts, score), F.lit(0))


def long_tokens(text: Column) -> Column:
    """Distinct tokens of more than one byte."""
    return F.filter(lexical_terms(text), lambda t: F.octet_length(t) > 1)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def normalize(text: Column) -> Column:
    """Lower case; letters, digits and apostrophes; single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}']+", " "))


def informative_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(normalize(text), " "), lambda w: (w != "") & ~w.isin(STOP_WORDS)))


def canonical_label(x: Column) -> Column:
    return F.replace(F.lower(F.trim(x)), F.lit("-"), F.lit("_"))


def surface_key(x: Column) -> Column:
    """An entity's surface without all but letters and digits."""
    return F.lower(F.regexp_replace(x, r"[^\p{IsAlphabetic}\p{N}]", ""))


def ordered_identity_tokens(x: Column) -> Column:
    """Tokens, also split before an upper-case letter between lower-case ones."""
    split = F.regexp_replace(x, r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})", " ")
    return F.array_remove(F.split(F.lower(split), ALNUM_GAP), "")


def single_token(x: Column) -> Column:
    """The one token of a surface that has no other; else null."""
    t = ordered_identity_tokens(x)
    return F.when(F.size(t) == 1, F.get(t, F.lit(0)))


def discovery_tokens(text: Column, first: int = 512, kept: int = 256) -> Column:
    """Distinct lower-case tokens among the first ``kept`` of those of more than one byte; only ``first`` are looked at."""
    long = F.filter(F.array_remove(F.split(F.coalesce(text, F.lit("")), ALNUM_GAP), ""), lambda t: F.octet_length(t) > 1)
    return F.array_distinct(F.transform(F.slice(F.slice(long, 1, first), 1, kept), F.lower))


def identity_tokens(x: Column) -> Column:
    return F.filter(lexical_terms(x), lambda t: (F.octet_length(t) >= 4) & ~t.isin(GENERIC_TOKENS))


def guard_keys(surface: Column, qualifiers: Sequence[str] = ()) -> Column:
    """Joined tokens; also without a generic last or qualifying first token; the same for the last path part.

    Tokens are bound by a transform of one element, so each surface is split once however often its tokens are named."""
    last = F.try_element_at(F.filter(F.split(surface, r"[/\\]"), lambda p: F.trim(p) != ""), F.lit(-1))
    none = F.array().cast("array<string>")

    def keys(t: Column) -> Column:
        n = F.size(t)
        joined = F.array(F.array_join(t, ""))
        shorter = F.when((n > 1) & F.element_at(t, -1).isin("package", "module", "component"), F.array(F.array_join(F.slice(t, F.lit(1), n - 1), ""))).otherwise(none)
        later = F.when((n > 1) & F.get(t, F.lit(0)).isin(list(qualifiers) or [""]), F.array(F.array_join(F.slice(t, F.lit(2), n - 1), ""))).otherwise(none)
        return F.when(n > 0, F.concat(joined, shorter, later)).otherwise(none)

    tokens = F.transform(F.array_distinct(F.array(surface, last)), ordered_identity_tokens)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, keys))))


def hex_of(x: Column) -> Column:
    return F.lower(F.hex(x))


def term_hashes(text: Column, most: int = 256) -> Column:
    """Sorted SHA-256 of the first terms."""
    return F.array_sort(F.array_distinct(F.transform(F.slice(lexical_terms(text), 1, most), lambda t: F.sha2(t.cast("binary"), 256))))


def valid_identifier(x: Column) -> Column:
    return (F.trim(x) != "") & (F.octet_length(x) <= 512) & ~x.rlike(r"\p{Cntrl}")


def generic_surface(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), "^the ", "").isin(GENERIC_SURFACES)


def object_id_like(x: Column) -> Column:
    return x.rlike("^[0-9a-fA-F]{6,40}$")


def transient_occurrence(surface: Column, context: Column) -> Column:
    """Branches, object ids, numbered builds and runs, explicit ids."""
    s, c = F.lower(F.trim(surface)), F.lower(context)
    plain = F.regexp_replace(c, "[`'\"]", "")
    near = F.lit(False)
    for kind in ("branch", "worktree"):
        near = near | F.contains(plain, F.concat(s, F.lit(f" {kind}"))) | F.contains(plain, F.concat(F.lit(f"{kind} "), s))
    object_id = object_id_like(F.trim(surface)) & c.rlike("commit|rollback|revision")
    numbered = s.rlike(r"^(build|benchmark run|test run|deployment)[\s#:-]*[0-9a-f_.-]*[0-9a-f_.]+[0-9a-f_.-]*$")
    explicit = s.rlike(r"^(request|response|run|build|deployment|session) id[\s:#=]*[0-9a-z_./-]{4,}$")
    return near | s.rlike("^commit [`'\"]*[0-9a-f]{6,40}[`'\"]*$") | object_id | numbered | explicit


def describes_transient(surface: Column, summary: Column) -> Column:
    s, t = F.lower(F.trim(surface)), F.lower(summary)
    found = F.contains(t, F.concat(F.lit("branch named "), s)) | F.contains(t, F.concat(F.lit("worktree named "), s))
    for phrase in TRANSIENT_PHRASES:
        found = found | t.contains(phrase)
    return found


def describes_category(kind: Column, summary: Column) -> Column:
    t, found = F.lower(summary), F.lit(False)
    for phrase in WRAPPER_PHRASES:
        found = found | t.contains(phrase)
    return kind.isin("domain_entity", "other") & found


def parse_number(x: Column) -> Column:
    """Digits, or English words up to ninety-nine; null otherwise."""
    t = F.lower(F.trim(x))
    values = {w: i + 1 for i, w in enumerate(UNITS)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
    single = F.create_map(*[F.lit(y) for k in values.items() for y in k])
    parts = F.split(t, r"[- ]")
    tens, unit = F.try_element_at(single, F.get(parts, F.lit(0))), F.try_element_at(single, F.get(parts, F.lit(1)))
    return (
        F.when(t.rlike("^[0-9]{1,9}$"), t.try_cast("int"))
        .when(F.size(parts) == 1, F.try_element_at(single, t))
        .when((F.size(parts) == 2) & (tens >= 20) & (unit < 10), tens + unit)
    )


def span_matches(body: Column, start: Column, end: Column, surface: Column) -> Column:
    """Whether bytes [start, end) of the UTF-8 body are the surface."""
    raw = F.encode(body, "UTF-8")
    return (start >= 0) & (start < end) & (end <= F.octet_length(body)) & (F.substring(raw, start + 1, end - start) == F.encode(surface, "UTF-8"))


def citations_valid(summary: Column, positions: Column, cut: Column) -> Column:
    """Every ``source:a..b`` cites known ids (a map id -> position) with a <= b <= cut."""
    found = F.regexp_extract_all(summary, F.lit(r"source:([A-Za-z0-9_-]+\.\.[A-Za-z0-9_-]+)"), F.lit(1))

    def ok(x: Column) -> Column:
        a = F.try_element_at(positions, F.split(x, r"\.\.")[0])
        b = F.try_element_at(positions, F.split(x, r"\.\.")[1])
        return F.coalesce((a <= b) & (b <= cut), F.lit(False))

    return F.forall(found, ok)


def osa_distance(a: str, b: str) -> int:
    """Restricted Damerau-Levenshtein: swapping neighbours costs one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return rows[-1][-1]


def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def _truncate(x: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode()[: int(m)].decode(errors="ignore") for t, m in zip(x, most)])


def edit_distance() -> object:
    """OSA distance as a Pandas UDF; Spark's levenshtein counts a swap twice."""
    return F.pandas_udf(_osa, "int")


def truncate_utf8() -> object:
    """Cut to a number of bytes on a character's boundary."""
    return F.pandas_udf(_truncate, "string")


# Policy of extracted candidates -------------------------------------------------------------------------------

#: Units and completions of execution receipts, and signals of durable state.
RECEIPT_UNITS = (
    "prompt", "prompts", "phase", "phases", "step", "steps", "test run", "tests", "commit", "push", "merge",
    "verification", "cleanup", "worktree", "branch", "milestone",
)
#: Words of a finished task.
RECEIPT_DONE = (
    "completed", "complete", "done", "finished", "passed", "pushed", "merged", "committed", "verified", "reached", "clean",
)
#: Phrases of lasting facts.
DURABLE_SIGNALS = (
    "uses", "owns", "references", "stores", "requires", "configured", "now uses", "moved to", "lives in", "returns",
    "sends", "persists", "wired through", "routes through", "supports", "rejects", "accepts",
)
#: Words of progress.
PROGRESS = (
    "completed", "complete", "done", "finished", "passed", "reached", "checkpoint", "milestone", "progress", "through", "up to",
)
#: Phrases that make a question a statement.
QUESTION_EXCEPTIONS = ("have to", "has to", "must", "will", "i prefer", "i don't want", "i do not want")
#: Words that begin a question.
QUESTION_STARTS = (
    "what why how when where who can could would should is are am do does did will have has".split()
)
#: Endings of tag questions.
TAG_ENDINGS = ("right", "correct", "is it", "isn't it", "are they", "aren't they", "don't they", "doesn't it", "yeah", "no")
#: Answers that say yes and nothing else.
ACKNOWLEDGEMENTS = (
    "sounds good", "that works", "this works", "good rule", "do that", "do this", "do it", "add that", "add this",
    "change that", "change this", "finish that", "finish this", "finish it", "get it done", "get that done",
    "alright do that then", "alright that works", "ok done", "okay done",
)
#: Verbs that say what is to be remembered.
INLINE_PREDICATES = (
    "am is are was were use uses prefer prefers want wants need needs should must will have has own owns run runs "
    "store stores require requires"
).split()


def _any(padded: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | padded.contains(f" {p} ")
    return found


def numbered_progress(combined: Column) -> Column:
    """A prompt, phase or step with a number among the next four tokens, and a word of progress."""
    unit = combined.rlike(r" (prompts?|phases?|steps?)( [^ ]+){0,3} [0-9][^ ]* ")
    return unit & _any(combined, PROGRESS)


def execution_receipt(title: Column, content: Column) -> Column:
    combined = F.concat(F.lit(" "), normalize(title), F.lit(" "), normalize(content), F.lit(" "))
    durable = _any(F.concat(F.lit(" "), normalize(content), F.lit(" ")), DURABLE_SIGNALS)
    return numbered_progress(combined) | (_any(combined, RECEIPT_UNITS) & _any(combined, RECEIPT_DONE) & ~durable)


def unsupported_question(quote: Column, category: Column) -> Column:
    t = F.trim(quote)
    body = F.left(t, F.length(t) - 1)
    n = normalize(t)
    tag = F.lit(False)
    for e in TAG_ENDINGS:
        tag = tag | n.endswith(f" {e}")
    asks = F.lit(False)
    for w in QUESTION_STARTS:
        asks = asks | n.startswith(f"{w} ")
    declarative = category.isin("fact", "correction") & ~asks & tag
    return t.endswith("?") & ~body.contains(". ") & ~body.contains("! ") & ~_any(F.concat(F.lit(" "), n, F.lit(" ")), QUESTION_EXCEPTIONS) & ~declarative


def vague_authority(quote: Column, content: Column) -> Column:
    n = normalize(quote)
    tokens = F.array_remove(F.split(n, " "), "")
    deictic = F.exists(tokens, lambda w: w.isin("that", "this", "it", "them", "those", "these"))
    vague = deictic & (F.size(tokens) <= 8) & (informative_tokens(quote) <= 2) & (informative_tokens(content) >= 5)
    return F.when(n.isin(*ACKNOWLEDGEMENTS), informative_tokens(content) >= 3).otherwise(vague)


def retention_needs_source(quote: Column) -> Column:
    n = normalize(quote)
    rest = F.regexp_replace(n, "^remember (that|this) ", "")
    predicate = _any(F.concat(F.lit(" "), rest, F.lit(" ")), INLINE_PREDICATES)
    callback = F.lit(False)
    for m in (" discussed", " talked about", " mentioned", " earlier", " before"):
        callback = callback | n.contains(m)
    return (
        F.when(n.isin("remember that", "remember this", "remember it", "retain that", "retain this"), True)
        .when(n.rlike("^remember (that|this) "), ~quote.contains(":") & ~predicate)
        .otherwise(n.startswith("remember the ") & callback)
    )


def authority_rejection(kind: Column, category: Column, title: Column, quote: Column, content: Column, has_authority: Column, has_grounding: Column) -> Column:
    """The first rule that rejects a candidate, or null."""
    return (
        F.when(kind.isin("direct", "correction") & has_authority, "authority source not allowed")
        .when((kind == "adoption") & ~has_authority, "adoption needs an authority source")
        .when((kind == "retention") & retention_needs_source(quote) & ~has_authority, "retention needs an authority source")
        .when(~has_authority & ~has_grounding & vague_authority(quote, content), "vague authority")
        .when(unsupported_question(quote, category), "question")
        .when(execution_receipt(title, content), "execution receipt")
    )
