"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

DataFrame functions only.  Places of matches come from splitting a text at its matches and summing the lengths
of pieces; sums run in blocks, so a text with many matches costs no quadratic work.  Offsets are code points,
ends exclusive.

Entropy: a candidate is a maximal run of key characters.  A window slides over it; counts of its characters are
carried from step to step, one taken off for the character that leaves and one added for the one that enters, and
with them the sum S of c * log2 c over the counts, so that the window's entropy is log2 W - S / W.  A window's
character class is the narrowest that holds all its characters, counted the same way, and each class has its own
threshold; a candidate is a secret if a window of it reaches the threshold of its class.  Candidates on the
allow-list are suppressed: UUIDs, and names made of words and short numbers joined by marks.  All patterns are linear.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned one by one; an empty
table gives no rows; the input's columns are kept by ``scan``, but for those named like the two that it adds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import packed, quoted

#: Fixed patterns: kind, pattern, group whose length counts, least length.
BASE = (
    (
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Bits a character at least, by class of the window; windows of digits only are no secrets.
THRESHOLDS = {"hex": 2.9, "alnum": 3.4, "base64": 3.5}
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: In names of words and numbers no letter touches a digit, and numbers are short.
NO_NAME = "[0-9][A-Za-z]|[A-Za-z][0-9]|[0-9]{5}"
#: Windows that begin in the same so many characters are taken together.
CHUNK = 1024
FIRST_CODE, LAST_CODE = ord("+"), ord("z")
#: A count takes 5 bits, and 12 counts a long.
COUNT, PACKED = 32, 12
LONGS = (LAST_CODE - FIRST_CODE) // PACKED + 1
BLOCK = 256
SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string,size:bigint>>"


def _prefix_starts(lengths: Column) -> Column:
    """For structs (gap, hit) in order: the start of each hit.  Sums inside blocks, then over blocks."""
    blocks = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    empty = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("long")
    inside = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda b: F.aggregate(
            F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)),
            F.struct(zero.alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["hit"]).alias("at"),
                F.concat(acc["out"], F.array(acc["at"] + x["gap"])).alias("out"),
            ),
        ),
    )
    done = F.aggregate(
        inside,
        F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.transform(x["out"], lambda v: v + acc["at"]))).alias("out"),
        ),
        lambda acc: F.flatten(acc["out"]),
    )
    return done


def _spans(df: DataFrame, text: str, pattern: str, group: int, least: int, kind: str, order: int, into: str) -> DataFrame:
    """Add ``into``: the spans of the pattern's leftmost matches that do not overlap.  Only texts with a match
    pay for more than one pass."""
    t, lit = F.col(text), F.lit(pattern)
    found = F.when(t.rlike(pattern), F.regexp_extract_all(t, lit, F.lit(0)))
    df = df.withColumn(f"{into}_m", found)
    gaps = F.split(t, pattern, -1)
    hits = F.col(f"{into}_m")
    counted = F.regexp_extract_all(t, lit, F.lit(group)) if group else hits
    df = df.withColumn(
        f"{into}_l",
        F.when(
            hits.isNotNull(),
            F.transform(
                F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("g"), hits.alias("m"), counted.alias("c")),
                lambda x: F.struct(
                    F.length(x["g"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("hit"),
                    F.length(x["c"]).cast("long").alias("size"), x["m"].alias("m"),
                ),
            ),
        ),
    )
    lengths = F.col(f"{into}_l")
    spans = F.zip_with(
        _prefix_starts(lengths), lengths,
        lambda at, x: F.struct(
            at.alias("start"), F.lit(order).alias("ord"), (at + x["hit"]).alias("end"), F.lit(kind).alias("kind"),
            x["size"].alias("size"),
        ),
    )
    kept = F.filter(spans, lambda s: s["size"] >= least)
    return df.withColumn(into, F.when(lengths.isNotNull(), kept).otherwise(F.array().cast(SPAN))).drop(f"{into}_m")


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def _codes(s: Column) -> Column:
    """Characters as numbers: place from ``FIRST_CODE``, plus 128, 256 and 512 if no digit, no hex digit, no letter or digit."""
    known = []
    for c in map(chr, range(128)):
        place = min(max(ord(c), FIRST_CODE), LAST_CODE) - FIRST_CODE
        known.append(place + 128 * (not c.isdigit()) + 256 * (c not in "0123456789abcdefABCDEF") + 512 * (not c.isalnum()))
    return F.transform(F.slice(F.split(s, ""), F.lit(1), F.length(s)), lambda c: F.get(_ints(known), F.least(F.ascii(c), F.lit(127))))


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


class _Window:
    """Counts of a window's characters and what follows from them, as a struct that ``aggregate`` carries."""

    def __init__(self, width: int):
        self.width = width
        self.weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)])
        self.units = F.array(*[F.lit(COUNT ** (k % PACKED)).cast("long") for k in range(LONGS * PACKED)])

    def empty(self) -> Column:
        zero = F.lit(0).cast("long")
        return F.struct(*[zero.alias(f"c{k}") for k in range(LONGS)], *[F.lit(0).alias(x) for x in ("nd", "nh", "na")], F.lit(0.0).alias("s"), F.lit(-1e9).alias("best"))

    def change(self, acc: Column, code: Column, by: int) -> Column:
        """One character more or less."""
        place = F.pmod(code, F.lit(128))
        group = _whole(place, F.lit(PACKED))
        unit = F.get(self.units, place)
        own = F.when(group == 0, acc["c0"])
        for k in range(1, LONGS):
            own = own.when(group == k, acc[f"c{k}"])
        count = F.pmod(_whole(own, unit), F.lit(COUNT)).cast("int")
        bit = lambda n: F.pmod(_whole(code, F.lit(n)), F.lit(2)).cast("int")
        return F.struct(
            *[(acc[f"c{k}"] + F.when(group == k, by * unit).otherwise(F.lit(0).cast("long"))).alias(f"c{k}") for k in range(LONGS)],
            *[(acc[x] + by * bit(n)).alias(x) for x, n in (("nd", 128), ("nh", 256), ("na", 512))],
            (acc["s"] + F.get(self.weight, count + by) - F.get(self.weight, count)).alias("s"),
            acc["best"].alias("best"),
        )

    def judged(self, acc: Column) -> Column:
        """The best margin over a threshold so far, with the window as it is now."""
        bits = F.lit(math.log2(self.width)) - acc["s"] / float(self.width)
        least = F.when(acc["nh"] == 0, THRESHOLDS["hex"]).when(acc["na"] == 0, THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
        return F.greatest(acc["best"], F.when(acc["nd"] == 0, F.lit(-1e9)).otherwise(bits - least))


def window_margin(s: Column, width: int = WINDOW) -> Column:
    """By how many bits a character the entropy of a window of ``width`` characters passes the threshold of its class, at most."""
    w = _Window(width)

    def of_chunk(chunk: Column) -> Column:
        codes = _codes(chunk)
        more = F.greatest(F.length(chunk) - width, F.lit(0))
        moves = F.zip_with(F.slice(codes, F.lit(1), more), F.slice(codes, F.lit(width + 1), more), lambda out, new: out * 1024 + new)
        first = F.aggregate(F.slice(codes, F.lit(1), F.lit(width)), w.empty(), lambda acc, c: w.change(acc, c, 1))

        def step(acc: Column, move: Column) -> Column:
            # two changes, each on a struct bound once, then the verdict
            less = F.transform(F.array(acc), lambda a: w.change(a, _whole(move, F.lit(1024)).cast("int"), -1))
            both = F.transform(less, lambda a: w.change(a, F.pmod(move, F.lit(1024)), 1))
            return F.get(F.transform(both, lambda a: a.withField("best", w.judged(a))), F.lit(0))

        begun = F.get(F.transform(F.array(first), lambda a: a.withField("best", w.judged(a))), F.lit(0))
        return F.when(F.length(chunk) >= width, F.aggregate(moves, begun, step, lambda acc: acc["best"])).otherwise(-1e9)

    chunks = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    after = F.concat(F.slice(F.transform(chunks, lambda c: F.substring(c, 1, width - 1)), F.lit(2), F.size(chunks)), F.array(F.lit("")))
    return F.array_max(F.zip_with(chunks, after, lambda c, n: of_chunk(F.concat(c, n))))


def _is_secret(s: Column) -> Column:
    named = s.rlike(UUID) | (s.rlike("^[A-Za-z]") & ~s.rlike(NO_NAME))
    return s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~named & (window_margin(s) >= 0)


def scan(docs: DataFrame, text_col: str = "text", base_col: str = "_base", spans_col: str = "_spans") -> DataFrame:
    """Add ``base_col`` and ``spans_col``: arrays of structs (start, ord, end, kind, size), sorted."""
    df = packed(docs).withColumn("t", F.coalesce(F.col(f"row.{quoted(text_col)}"), F.lit("")))
    for k, (kind, pattern, group, least) in enumerate(BASE):
        df = _spans(df, "t", pattern, group, least, kind, k, kind).drop(f"{kind}_l")
    df = df.withColumn("base", F.array_sort(F.concat(*[k for k, *_ in BASE])))
    df = _spans(df, "t", CANDIDATE, 0, WINDOW, "entropy", len(BASE), "found")
    base, blocks = F.col("base"), F.col("blocks")
    block = lambda b: F.slice(base, b * BLOCK + 1, F.lit(BLOCK))
    # base spans in blocks with their bounds, so a text with many spans and many candidates stays cheap
    df = df.withColumn("blocks", F.transform(
        F.filter(F.sequence(F.lit(0), F.ceil(F.size(base) / F.lit(BLOCK)).cast("int")), lambda b: b * BLOCK < F.size(base)),
        lambda b: F.struct(F.get(base, b * BLOCK)["start"].alias("start"), F.array_max(F.transform(block(b), lambda x: x["end"])).alias("end"), block(b).alias("spans")),
    ))
    meets = lambda b, c: (b["start"] < c["end"]) & (c["start"] < b["end"])
    strong = F.filter(
        F.zip_with("found", "found_l", lambda c, x: F.struct(c.alias("c"), x["m"].alias("m"))),
        lambda x: ((F.size(blocks) == 0) | ~F.exists(blocks, lambda b: meets(b, x["c"]) & F.exists(b["spans"], lambda y: meets(y, x["c"])))) & _is_secret(x["m"]),
    )
    extra = F.when(F.size("found") > 0, F.transform(strong, lambda x: x["c"])).otherwise(F.array().cast(SPAN))
    kept = [F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c.lower() not in (base_col.lower(), spans_col.lower())]
    return df.select(*kept, base.alias(base_col), F.array_sort(F.concat(base, extra)).alias(spans_col))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    base, spans = F.col("base"), F.col("spans")
    of = lambda kind: F.size(F.filter(base, lambda b: b["kind"] == kind)).cast("long")
    return scan(docs.select("doc_id", "text"), base_col="base", spans_col="spans").select(
        "doc_id", *[of(k).alias(f"n_{k}") for k, *_ in BASE], F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"), _text_of(spans).alias("spans")
    )
