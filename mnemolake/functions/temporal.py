"""Temporal expressions in text: anchors, recurrences, durations, times of day, unresolved words.

Everything is proleptic Gregorian UTC; spans are half-open nanoseconds; weeks start on Monday.  A table of patterns
is tried in order and text once claimed is not matched again.  The parser runs in a Pandas UDF; anchors come back as
an array of structs, so matching is an ordinary join.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as BL
from .text import TENS, UNITS, osa_distance

NS = 1_000_000_000
DAY = 86_400 * NS

#: Names of the calendar.
MONTHS = "january february march april may june july august september october november december".split()
SHORT = {m[:3]: i + 1 for i, m in enumerate(MONTHS) if m != "may"} | {"sept": 9}
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
SEASONS = {"spring": 3, "summer": 6, "autumn": 9, "fall": 9, "winter": 12}
CADENCES = {
    "hourly": ("hour", 1), "daily": ("day", 1), "weekly": ("week", 1), "fortnightly": ("week", 2), "monthly": ("month", 1),
    "quarterly": ("quarter", 1), "yearly": ("year", 1), "annually": ("year", 1), "weekdays": ("weekday", 1),
}
AMBIGUOUS = {"biweekly": ("week", 2), "bimonthly": ("month", 2)}
#: Scores of a match by kind of anchor.
SCORES = {"instant": 1.0, "day": 0.98, "range": 0.96, "week": 0.92, "month": 0.88, "quarter": 0.84, "season": 0.82, "year": 0.80}
OVERLAP, RECURRENCE = 0.75, 0.70
UNIT_WORDS = r"(?:minute|hour|day|week|month|quarter|year)"
NUMBER = r"(?:\d{1,4}|(?:" + "|".join(TENS) + r")(?:[- ](?:" + "|".join(UNITS[:9]) + r"))?|" + "|".join(reversed(UNITS)) + ")"
_M = "|".join(MONTHS)
_S = "|".join(sorted(SHORT, key=len, reverse=True))
_W = "|".join(WEEKDAYS)
_LONG = re.compile(r"[a-z]{5,}")
VOCABULARY = [*MONTHS, *WEEKDAYS, "today", "yesterday", "tomorrow", "weekly", "monthly", "yearly", "quarter"]


@dataclass
class Found:
    anchors: list[tuple] = field(default_factory=list)
    recurrences: list[tuple] = field(default_factory=list)
    durations: list[tuple] = field(default_factory=list)
    times: list[str] = field(default_factory=list)
    unresolved: list[str] = field(default_factory=list)


def number(text: str) -> int:
    if text.isdigit():
        return int(text)
    total = 0
    for w in re.split(r"[- ]", text):
        total += 20 + 10 * TENS.index(w) if w in TENS else UNITS.index(w) + 1
    return total


def ns(d: date) -> int:
    return int((datetime(d.year, d.month, d.day) - datetime(1970, 1, 1)).total_seconds()) * NS


def shift_months(d: date, n: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def span(kind: str, d: date) -> tuple[str, int, int]:
    """The calendar span of a kind that holds a day."""
    if kind == "day":
        return kind, ns(d), ns(d) + DAY
    if kind == "week":
        start = d - timedelta(days=d.weekday())
        return kind, ns(start), ns(start) + 7 * DAY
    months = {"month": 1, "quarter": 3, "season": 3, "year": 12}[kind]
    first = date(d.year, d.month if kind in ("month", "season") else 1 if kind == "year" else (d.month - 1) // 3 * 3 + 1, 1)
    return kind, ns(first), ns(shift_months(first, months))


def _ordinal(text: str) -> int:
    return int(re.match(r"\d+", text)[0])


def _month(text: str) -> int:
    return MONTHS.index(text) + 1 if text in MONTHS else SHORT[text]


def _move(d: date, unit: str, n: int) -> date:
    return d + timedelta(days=n * {"day": 1, "week": 7}[unit]) if unit in ("day", "week") else shift_months(d, n * {"month": 1, "quarter": 3, "year": 12}[unit])


def _weekday(ref: date, name: str, forward: bool) -> date:
    ahead = (WEEKDAYS.index(name) - ref.weekday()) % 7 or 7
    return ref + timedelta(days=ahead if forward else ahead - 7 if ahead < 7 else -7)


def _named_month(ref: date, which: str, m: int) -> date:
    if which == "this":
        return date(ref.year, m, 1)
    if which == "next":
        return date(ref.year + (m <= ref.month), m, 1)
    return date(ref.year - (m >= ref.month), m, 1)


def _instant(m: re.Match, ref: date | None) -> tuple:
    t = datetime.fromisoformat(m[0].upper().replace("Z", "+00:00")).astimezone(timezone.utc)
    at = int((t.replace(tzinfo=None) - datetime(1970, 1, 1)) / timedelta(microseconds=1)) * 1000
    return "instant", at, at + 1


def _season(m: re.Match, ref: date | None) -> tuple:
    month = SEASONS[m["s"]] if m["h"].startswith("north") else (SEASONS[m["s"]] + 5) % 12 + 1
    return span("season", date(int(m["y"]), month, 1))


Absolute = Callable[[re.Match, "date | None"], tuple]
#: (pattern, handler, whether a reference day is needed), in order of preference.
ANCHORS: list[tuple[str, Absolute, bool]] = [
    (r"\d{4}-\d\d-\d\dt\d\d:\d\d:\d\d(?:\.\d{1,6})?(?:z|[+-]\d\d:\d\d)", _instant, False),
    (r"(\d{4}-\d\d-\d\d)\s*(?:to|through|until|–|—)\s*(\d{4}-\d\d-\d\d)", lambda m, r: ("range", ns(date.fromisoformat(m[1])), ns(date.fromisoformat(m[2])) + DAY), False),
    (r"\d{4}-\d\d-\d\d", lambda m, r: span("day", date.fromisoformat(m[0])), False),
    (rf"({_M}) (\d{{1,2}}),? (\d{{4}})", lambda m, r: span("day", date(int(m[3]), _month(m[1]), int(m[2]))), False),
    (rf"(\d{{1,2}}) ({_M}),? (\d{{4}})", lambda m, r: span("day", date(int(m[3]), _month(m[2]), int(m[1]))), False),
    (rf"(\d{{1,2}}(?:st|nd|rd|th)) of ({_M}),? (\d{{4}})", lambda m, r: span("day", date(int(m[3]), _month(m[2]), _ordinal(m[1]))), False),
    (rf"({_S})\.? (\d{{1,2}}),? (\d{{4}})", lambda m, r: span("day", date(int(m[3]), _month(m[1]), int(m[2]))), False),
    (r"q([1-4])[ -](\d{4})", lambda m, r: span("quarter", date(int(m[2]), 3 * int(m[1]) - 2, 1)), False),
    (rf"({_M}|{_S})\.? (\d{{4}})", lambda m, r: span("month", date(int(m[2]), _month(m[1]), 1)), False),
    (r"(\d{4})-(\d\d)", lambda m, r: span("month", date(int(m[1]), int(m[2]), 1)), False),
    (rf"(?P<h>northern|southern)(?: hemisphere)? (?P<s>{'|'.join(SEASONS)}) (?:of )?(?P<y>\d{{4}})", _season, False),
    (rf"({_M}) (\d{{1,2}}) (this|next|last) year", lambda m, r: span("day", date(r.year + {"this": 0, "next": 1, "last": -1}[m[3]], _month(m[1]), int(m[2]))), True),
    (rf"(this|next|last) ({_M})", lambda m, r: span("month", _named_month(r, m[1], _month(m[2]))), True),
    (r"(?:in|during|since|by) (\d{4})", lambda m, r: span("year", date(int(m[1]), 1, 1)), False),
    (r"today|yesterday|tomorrow", lambda m, r: span("day", r + timedelta(days={"today": 0, "yesterday": -1, "tomorrow": 1}[m[0]])), True),
    (rf"(next|last) ({_W})", lambda m, r: span("day", _weekday(r, m[2], m[1] == "next")), True),
    (r"(this|next|last) (week|month|quarter|year)", lambda m, r: span(m[2], _move(r.replace(day=1) if m[2] != "week" else r, m[2], {"this": 0, "next": 1, "last": -1}[m[1]])), True),
    (rf"in ({NUMBER}) (day|week|month|year)s?", lambda m, r: span("day", _move(r, m[2], number(m[1]))), True),
    (rf"({NUMBER}) (day|week|month|year)s? ago", lambda m, r: span("day", _move(r, m[2], -number(m[1]))), True),
]
#: Whether a pattern cannot match without a digit: all but a few, and those that take numbers in words.
_ANCHORS = [(re.compile(rf"(?<![\w-])(?:{p})(?![\w-])"), h, need, not need or "this|next|last) year" in p) for p, h, need in ANCHORS]
_DIGIT = re.compile(r"\d")
_CUE = re.compile(r"(?:\b(from|since|starting|after|until|ending|before|and|to)\s+)$")
_TIME = re.compile(r"\b(1[0-2]|0?[1-9]):([0-5]\d)(?::([0-5]\d))? ?([ap])\.?m\b")
_DURATION = re.compile(rf"\b(for|lasting|took|takes|within|about|around|approximately|roughly)\s+(?:(about|around|approximately|roughly)\s+)?({NUMBER})(?:\s*(?:to|-|–)\s*({NUMBER}))? ({UNIT_WORDS})s?\b")
_EVENT = re.compile(rf"\b({NUMBER}) ({UNIT_WORDS})s? (before|after) (?:the )?([a-z]\w*)")
_EVERY = re.compile(rf"\bevery (?:(other|{NUMBER}) )?({UNIT_WORDS}|{_W})s?\b|\b(twice) (weekly|monthly)\b|\b(twice) a (week|month)\b")
_MONTHLY = re.compile(r"\bmonthly on the (\d{1,2})(?:st|nd|rd|th)\b")
_YEARLY = re.compile(rf"\b(?:yearly|annually|every year) on ({_M}) (\d{{1,2}})\b")
_CADENCE = re.compile(r"\b(" + "|".join(CADENCES) + r")\b")
_AMBIGUOUS = re.compile(r"\b(biweekly|bimonthly)\b")
_UNRESOLVED = re.compile(rf"\b(soon|recently|lately|today|yesterday|tomorrow|(?:this|next|last) (?:week|month|quarter|year|{_W}|{_M}))\b")


@lru_cache(maxsize=1 << 16)
def _calendar_word(w: str) -> str:
    if w in VOCABULARY:
        return w
    near = [v for v in VOCABULARY if abs(len(v) - len(w)) <= 1 and osa_distance(w, v) == 1]
    return near[0] if len(near) == 1 else w


def corrected(text: str) -> str:
    """Words of five letters or more, one edit from exactly one calendar word, replaced by it."""
    return _LONG.sub(lambda m: _calendar_word(m[0]), text)


def _boundary(cue: str, kind: str, a: int, b: int) -> tuple[str, int | None, int | None]:
    if cue in ("since", "starting"):
        return "since", a, None
    if cue == "after":
        return "after", b, None
    if cue in ("until", "ending"):
        return "until", None, b
    if cue == "before":
        return "before", None, a
    return kind, a, b


def parse(text: str | None, ref_ns: int | None = None) -> Found:
    """All temporal material of a text; relative words need a reference time."""
    out = Found()
    if not text:
        return out
    low = corrected(text.lower())
    ref = (datetime(1970, 1, 1) + timedelta(microseconds=ref_ns // 1000)).date() if ref_ns is not None else None
    claimed = bytearray(len(low))

    def free(m: re.Match) -> bool:
        if any(claimed[m.start() : m.end()]):
            return False
        claimed[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        return True

    for pattern, keep in ((_MONTHLY, lambda m: ("month", 1, int(m[1]))), (_YEARLY, lambda m: ("year", 1, _month(m[1]) * 100 + int(m[2])))):
        out.recurrences += [keep(m) for m in pattern.finditer(low) if free(m)]
    for m in _EVERY.finditer(low):
        if free(m):
            if m[3] or m[5]:
                out.recurrences.append(((m[4] or m[6]).removesuffix("ly"), 0, 2))
            else:
                out.recurrences.append((m[2], 2 if m[1] == "other" else number(m[1]) if m[1] else 1, 0))
    out.recurrences += [(*CADENCES[m[1]], 0) for m in _CADENCE.finditer(low) if free(m)]
    for m in _AMBIGUOUS.finditer(low):
        unit, n = AMBIGUOUS[m[1]]
        clause = re.split(r"[.;!?]", low[: m.start()])[-1] + re.split(r"[.;!?]", low[m.end() :])[0]
        two, twice = re.search(rf"every (two|2|other) {unit}s?", clause), re.search(rf"twice (a|per) {unit}", clause)
        if bool(two) == bool(twice) or re.search(r"\b(not|maybe|perhaps|or|might)\b", clause):
            out.unresolved.append(m[1])
        else:
            out.recurrences.append((unit, n, 0) if two else (unit, 0, 2))
    spans: list[tuple[int, int, str, int, int]] = []
    digit = _DIGIT.search(low) is not None
    for pattern, handle, need, numeric in _ANCHORS:
        if (need and ref is None) or (numeric and not digit):
            continue
        for m in pattern.finditer(low):
            try:
                found = handle(m, ref)
            except (ValueError, OverflowError):
                continue
            if found[1] < found[2] and free(m):
                spans.append((m.start(), m.end(), *found))
    spans.sort()
    skip = -1
    for k, (start, end, kind, a, b) in enumerate(spans):
        if k == skip:
            continue
        cue = _CUE.search(low[:start])
        cue = cue[1] if cue else ""
        if cue == "from" and k + 1 < len(spans) and low[end : spans[k + 1][0]].strip() in ("to", "until", "through") and a < spans[k + 1][4]:
            out.anchors.append(("range", a, spans[k + 1][4]))
            skip = k + 1
        else:
            out.anchors.append(_boundary(cue, kind, a, b))
    out.times += [f"{int(m[1]) % 12 + (12 if m[4] == 'p' else 0):02d}:{m[2]}:{m[3] or '00'}" for m in _TIME.finditer(low)]
    for m in _DURATION.finditer(low):
        if free(m):
            about = bool(m[2]) or m[1] in ("about", "around", "approximately", "roughly")
            out.durations.append((number(m[3]), number(m[4]) if m[4] else number(m[3]), m[5], about))
    out.unresolved += [f"{m[3]} {m[4]}" for m in _EVENT.finditer(low) if free(m)]
    out.unresolved += [m[0] for m in _UNRESOLVED.finditer(low) if free(m)]
    return out


def status(f: Found) -> str:
    if f.unresolved:
        return "unresolved"
    return "resolved" if f.anchors or f.recurrences or f.durations or f.times else "none"


RESULT = (
    "anchors array<struct<kind:string,start:bigint,end:bigint>>, recurrences array<struct<unit:string,every:int,part:int>>, "
    "durations array<struct<least:int,most:int,unit:string,about:boolean>>, times array<string>, unresolved array<string>, status string"
)


def _parse_series(text: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = []
    for t, r in zip(text, ref):
        f = parse(t, None if pd.isna(r) else int(r))
        rows.append({
            "anchors": [dict(zip(("kind", "start", "end"), x)) for x in dict.fromkeys(f.anchors)],
            "recurrences": [dict(zip(("unit", "every", "part"), x)) for x in dict.fromkeys(f.recurrences)],
            "durations": [dict(zip(("least", "most", "unit", "about"), x)) for x in dict.fromkeys(f.durations)],
            "times": list(dict.fromkeys(f.times)), "unresolved": list(dict.fromkeys(f.unresolved)), "status": status(f),
        })
    return pd.DataFrame(rows, columns=["anchors", "recurrences", "durations", "times", "unresolved", "status"])


def analyse(text: Column, ref: Column) -> Column:
    return F.pandas_udf(_parse_series, RESULT)(text, ref)


#: Kinds of temporal indications, in order.
KINDS = ("explicit", "calendar", "relative", "boundary", "recurrence", "duration")
_EXACT = {
    **dict.fromkeys([*MONTHS, *WEEKDAYS, *[k for k in SHORT if k not in ("mar", "dec", "sept")], "spring", "summer", "autumn", "winter", "quarter"], "calendar"),
    **dict.fromkeys(["today", "yesterday", "tomorrow", "ago", "recently", "lately", "soon"], "relative"),
    **dict.fromkeys([*CADENCES, *AMBIGUOUS], "recurrence"),
}
_EDGE = {"since", "until", "before", "after", "from", "starting", "ending"}
_SPAN_UNITS = {f"{u}{s}" for u in ("minute", "hour", "day", "week", "month", "quarter", "year") for s in ("", "s")}
_NEAR = {"this", "next", "last"}
_CUES = {"in", "during", "since", "by", "of", "before", "after", "until", "from"} | set(MONTHS)
_TOKEN = re.compile(r"[A-Za-z]+|\d+")
_WHOLE = re.compile(r"\d{4}-\d\d-\d\d(?:T\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d))?|\b[Qq][1-4][ -]\d{4}\b")


def indicated(text: str | None) -> list[tuple[str, int, int, str | None]]:
    """(kind, start byte, end byte, corrected word) of what in a text points to time, in order.

    Boundary words and "every" need a temporal neighbour, units a number before them or "ago" or "later" after them, and
    a bare year a cue before it."""
    if not text:
        return []
    at = lambda i: len(text[:i].encode())
    out = [("explicit", m.start(), m.end(), None) for m in _WHOLE.finditer(text)]
    tokens = [m for m in _TOKEN.finditer(text) if not any(a <= m.start() < b for _, a, b, _ in out)]
    low = [_calendar_word(t) if len(t) >= 5 else t for t in (m[0].lower() for m in tokens)]
    numeric = lambda w: w.isdigit() or w in UNITS or w in TENS
    timely = lambda k: 0 <= k < len(low) and (low[k] in _EXACT or low[k] in _SPAN_UNITS or low[k] in _NEAR or bool(re.fullmatch(r"[12]\d{3}", low[k])))
    whole = {a for _, a, _, _ in out}
    for k, (m, w) in enumerate(zip(tokens, low)):
        after = low[k + 1] if k + 1 < len(low) else ""
        before = low[k - 1] if k else ""
        kind = None
        if w in _EXACT:
            kind = _EXACT[w] if w != "may" or m[0][0].isupper() else None
        elif w in _NEAR and (after in _SPAN_UNITS or after in _EXACT):
            kind = "relative"
        elif w in _EDGE and (timely(k + 1) or any(0 <= a - m.end() <= 1 for a in whole)):
            kind = "boundary"
        elif w == "every" and (timely(k + 1) or timely(k + 2)):
            kind = "recurrence"
        elif w in _SPAN_UNITS and (numeric(before) or after in ("ago", "later")):
            kind = "duration"
        elif re.fullmatch(r"(?:19|20)\d\d", w) and before in _CUES:
            kind = "calendar"
        if kind:
            out.append((kind, m.start(), m.end(), w if w != m[0].lower() else None))
    return [(kind, at(a), at(b), w) for kind, a, b, w in sorted(out, key=lambda x: (x[1], x[2], KINDS.index(x[0])))]


INDICATIONS = "array<struct<kind:string,start:int,end:int,normal:string>>"


def _indicated_series(text: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("kind", "start", "end", "normal"), x)) for x in indicated(t)] for t in text])


def indications(text: Column) -> Column:
    """What in a text points to time: kinds and byte spans."""
    return F.pandas_udf(_indicated_series, INDICATIONS)(text)


def verifies(expression: Column, kind: Column, ref: Column) -> Column:
    """Whether an inferred expression, read on its own, resolves fully and as the kind it claims to be."""
    read = analyse(expression, ref)
    some = lambda c: F.size(read[c]) > 0
    edge = F.exists(read["anchors"], lambda a: a["start"].isNull() | a["end"].isNull() | (a["kind"] == "range"))
    fits = (
        F.when(kind.isin("explicit", "calendar"), some("anchors")).when(kind == "relative", some("anchors")).when(kind == "boundary", edge)
        .when(kind == "recurrence", some("recurrences")).when(kind == "duration", some("durations"))
    )
    return (read["status"] == "resolved") & F.coalesce(fits, F.lit(False))


def merged(base: DataFrame, extra: DataFrame, meaning: list[str]) -> DataFrame:
    """Two analyses as rows (id, the columns of the meaning, evidence): what means the same counts once, the base's evidence first."""
    both = base.withColumn("_from", F.lit(0)).unionByName(extra.withColumn("_from", F.lit(1)))
    return both.groupBy("id", *meaning).agg(F.min_by("evidence", F.struct("_from", "evidence")).alias("evidence"))


#: Inferences or texts that a task of ``with_inferences`` holds.
SHARE = 50_000


def with_inferences(texts: DataFrame, inferences: DataFrame) -> DataFrame:
    """The verdict of each inference (id, kind, start, end, evidence, expression, ref) about a text (id, text; ids are distinct).

    It must quote its span, name an indication that the text has, be the only one for it, and verify.

    Texts and inferences are dealt by id to as many tasks as their rows need: their bytes compress too well to tell, and texts of
    a small file would be broadcast.  A text meets its inferences once, with its indications beside it, and does not go on to the sort that
    finds repeated ones."""
    key = ["id", "kind", "start", "end"]
    tasks = max(1, -(-max(texts.count(), inferences.count()) // SHARE))
    # a Python function ends the partitioning by id
    said = texts.repartition(tasks, "id").select("id", "text", indications(F.col("text")).alias("_seen")).repartition(tasks, "id")
    quote = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("evidence").cast("binary")
    named = F.exists("_seen", lambda i: (i["kind"] == F.col("kind")) & (i["start"] == F.col("start")) & (i["end"] == F.col("end")))
    met = inferences.repartition(tasks, "id").join(said.hint("merge"), "id", "left")
    judged = met.select(*key, "expression", "ref", F.coalesce(quote, F.lit(False)).alias("_quote"), F.coalesce(named, F.lit(False)).alias("_named"))
    many = F.count("*").over(Window.partitionBy(*key))
    verdict = (
        F.when(~F.col("_quote"), "evidence differs").when(~F.col("_named"), "no such indication").when(many > 1, "repeated")
        .when(~verifies(F.col("expression"), F.col("kind"), F.col("ref")), "not resolvable").otherwise("accepted")
    )
    return judged.select(*key, verdict.alias("verdict"))


def iso_days(text: Column) -> Column:
    """The ISO dates of a text by expressions alone: an array of valid dates in order."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d\d-\d\d)\b"), F.lit(1))
    return F.array_compact(F.transform(found, lambda d: F.unix_date(F.try_to_date(d, "yyyy-MM-dd"))))


#: Days of nanoseconds in 64 bits, shifted to be positive, have this many bits.
DAY_BITS, DAY_SHIFT = 18, 1 << 17


def _dated(anchors: DataFrame) -> DataFrame:
    """Anchors with their bounds, where open ones end far away, and their first and last days."""
    lo, hi = F.coalesce(F.col("start"), F.lit(-(1 << 62))), F.coalesce(F.col("end"), F.lit(1 << 62))
    day = lambda ns: F.call_function("div", ns, F.lit(DAY)) - (ns % DAY < 0).cast("long")
    a, b = day(lo), day(hi - 1)  # doubles would take the end of a day for the next one
    return anchors.select("*", lo.alias("_lo"), hi.alias("_hi"), F.least(a, b).alias("_first"), F.greatest(a, b).alias("_last"))


def _anchors(rows: DataFrame, key: str, day_limit: int) -> tuple[DataFrame, bool, bool, int]:
    """Distinct anchors by id with their first and last days; whether some id has several, and whether some are wide or open;
    the most days that an only anchor takes.

    Only where an id is repeated are anchors grouped; rows without an id go with the ids of several."""
    repeated = (rows.groupBy(key).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) > 1
    each = rows.select(key, F.col(key).isNull().alias("_many"), "place", "kind", "start", "end")
    if repeated:
        each = rows.groupBy(key).agg(F.collect_set(F.struct("place", "kind", "start", "end")).alias("_a")).select(key, ((F.size("_a") > 1) | F.col(key).isNull()).alias("_many"), F.explode("_a").alias("_a")).select(key, "_many", "_a.*")
    bounded = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") - F.col("start") <= day_limit * DAY)
    dated = _dated(each).withColumn("_wide", ~F.coalesce(bounded, F.lit(False)))
    many, wide, days = dated.agg(F.bool_or("_many"), F.bool_or("_wide"), F.max(F.when(~F.col("_many"), F.col("_last") - F.col("_first") + 1))).first()
    return dated, bool(many), bool(wide), days or 0


def _cover(first: Column, last: Column, levels: int = DAY_BITS + 1) -> Column:
    """The dyadic ranges whose disjoint union is the days from first to last, as codes of level and place."""
    level = lambda k: (F.ceil((first + DAY_SHIFT) / (1 << k)), F.floor((last + DAY_SHIFT + 1) / (1 << k)))
    code = lambda k, x: (x + (k << 20)).cast("long")
    out = []
    for k in range(levels):
        left, right = level(k)
        out += [F.when((left < right) & (left % 2 == 1), code(k, left)), F.when((left < right) & (right % 2 == 1), code(k, right - 1))]
    return F.array_compact(F.array(*out))


def _above(day: Column, levels: int = DAY_BITS + 1) -> Column:
    """The codes of the dyadic ranges that hold a day, one a level."""
    return F.array(*[(F.floor((day + DAY_SHIFT) / (1 << k)) + (k << 20)).cast("long") for k in range(levels)])


def match(queries: DataFrame, memories: DataFrame, most: int = 6, day_limit: int = 400) -> DataFrame:
    """Best score of a memory for a query by overlapping anchors; the first ``most`` overlaps in list order count.

    Inputs: (query_id | memory_id, place, kind, start, end); null bounds are open.  All joins are equalities, and a pair of
    anchors leaves them once.  Ids with one anchor travel in blocks of those whose spans are equal, and their pairs are made
    last: the first day of one span lies in a dyadic range of the other.  Only ids with several anchors are grouped: their
    spans of up to ``day_limit`` days meet on the first day they share; longer or open ones as above."""
    q, q_many, q_wide, q_days = _anchors(queries, "query_id", day_limit)
    m, m_many, m_wide, m_days = _anchors(memories, "memory_id", day_limit)
    renamed = lambda df, key, x: df.select(key, *[F.col(c).alias(f"{x}{c}") for c in df.columns if c != key])
    only = lambda df, some: df.where("not _many") if some else df
    alike = lambda df, key, x: renamed(_dated(BL.packed(df.select(key, "kind", "start", "end"), key, ["kind", "start", "end"])), "ids", x)
    q_alike, m_alike = alike(only(q, q_many), "query_id", "q"), alike(only(m, m_many), "memory_id", "m")
    q, m = renamed(q, "query_id", "q"), renamed(m, "memory_id", "m")
    overlap = (F.col("q_lo") < F.col("m_hi")) & (F.col("m_lo") < F.col("q_hi"))
    days = lambda df, x: df.withColumn("_day", F.explode(F.sequence(f"{x}_first", f"{x}_last")))
    codes = lambda df, c: df.withColumn("_code", F.explode(c))
    same = F.col("qkind").eqNullSafe(F.col("mkind")) & F.col("qstart").eqNullSafe(F.col("mstart")) & F.col("qend").eqNullSafe(F.col("mend"))
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv]), F.col("qkind"))
    score = F.when(same, F.coalesce(exact, F.lit(OVERLAP))).otherwise(OVERLAP).alias("score")

    def met_alike(a: DataFrame, b: DataFrame) -> DataFrame:
        blocks = BL.met(a, b, ["_code"], overlap).select(F.col("l.ids").alias("qs"), F.col("r.ids").alias("ms"), score)
        return BL.each(blocks, "qs", "ms").select(F.col("x").alias("query_id"), F.col("y").alias("memory_id"), "score")

    def found_in(q: DataFrame, m: DataFrame) -> DataFrame:
        near = days(q.where("not q_wide"), "q").join(days(m.where("not m_wide"), "m"), "_day").where(overlap & (F.col("_day") == F.greatest("q_first", "m_first")))
        parts = [near.drop("_day")]
        for some, a, b in ((q_wide, q.where("q_wide"), m), (m_wide, q.where("not q_wide"), m.where("m_wide"))):
            if some:
                parts.append(codes(a, _cover(F.col("q_first"), F.col("q_last"))).join(codes(b, _above(F.col("m_first"))), "_code").where(overlap).drop("_code"))
                parts.append(codes(a, _above(F.col("q_first"))).join(codes(b, _cover(F.col("m_first") + 1, F.col("m_last"))), "_code").where(overlap).drop("_code"))
        all_of = parts[0]
        for part in parts[1:]:
            all_of = all_of.unionByName(part)
        return all_of.select("query_id", "memory_id", F.col("qplace").alias("qp"), F.col("mplace").alias("mp"), score)

    levels = max(1, m_days.bit_length())
    found = met_alike(codes(q_alike, _above(F.col("q_first"), levels)), codes(m_alike, _cover(F.col("m_first"), F.col("m_last"), levels)))
    if q_days > 1:
        levels = q_days.bit_length()
        found = found.unionByName(met_alike(codes(q_alike, _cover(F.col("q_first") + 1, F.col("q_last"), levels)), codes(m_alike, _above(F.col("m_first"), levels))))
    one = lambda df, x, some: df.where(f"not {x}_many") if some else df
    k = F.row_number().over(Window.partitionBy("query_id", "memory_id").orderBy("qp", "mp"))
    for some, pairs in ((q_many, lambda: found_in(q.where("q_many"), m)), (m_many, lambda: found_in(one(q, "q", q_many), m.where("m_many")))):
        if some:
            found = found.unionByName(pairs().withColumn("_k", k).where(F.col("_k") <= most).groupBy("query_id", "memory_id").agg(F.max("score").alias("score")))
    return found


def recurrence_match(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """Pairs with an equal recurrence (unit, every, part), null-safe."""
    q, m = queries.alias("q"), memories.alias("m")
    same = F.lit(True)
    for c in ("unit", "every", "part"):
        same = same & F.col(f"q.{c}").eqNullSafe(F.col(f"m.{c}"))
    return q.join(m, same).select("query_id", "memory_id").distinct().withColumn("score", F.lit(RECURRENCE))
