"""Expressions against known values."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.functions import temporal as TP
from mnemolake.functions import text as T
from mnemolake.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_terms_keep_first_order(spark):
    assert one(spark, T.lexical_terms(F.lit("Été—ALPHA été 你好"))) == ["été", "alpha", "你好"]


def test_lexical_score(spark):
    assert one(spark, T.lexical_score(F.lit("alpha alpha alpha"), ["alpha", "beta"])) == pytest.approx(0.5375)
    assert one(spark, T.lexical_score(F.lit(None).cast("string"), ["alpha"])) == 0


def test_hybrid(spark):
    assert one(spark, V.combine_hybrid(F.lit(0.8), F.lit(0.6))) == pytest.approx(0.69)
    assert one(spark, V.combine_hybrid(F.lit(0.0), F.lit(0.6))) == pytest.approx(0.6)


def test_fragment_id(spark):
    from mnemolake.operators.archive import fragment_id

    assert one(spark, fragment_id(F.lit("c"), F.lit("a"), F.lit("b"))) == "a396c3bf8ae8bb1a842bd3177f2bb20e6f1517c8cc200220f758292a4ad835e8"


def test_bonus_is_monotone(spark):
    got = [r[0] for r in spark.range(101).orderBy("id").select(V.semantic_bonus(F.col("id") / 100.0)).collect()]
    assert got == sorted(got) and got[74] == 0 and got[75] == 1 and got[100] == 10


def test_edit_distance():
    assert T.osa_distance("tomrorow", "tomorrow") == 1
    assert T.osa_distance("", "abc") == 3


def test_numbers(spark):
    rows = spark.createDataFrame([("7",), ("twenty-one",), ("forty",), ("twelve",), ("x",)], "t string")
    assert [r[0] for r in rows.select(T.parse_number(F.col("t"))).collect()] == [7, 21, 40, 12, None]


def test_guard_keys(spark):
    assert one(spark, T.guard_keys(F.lit("src/FooBar module"))) == ["foobar", "foobarmodule", "srcfoobar", "srcfoobarmodule"]


def test_policy(spark):
    assert one(spark, T.execution_receipt(F.lit("t"), F.lit("Prompt 3 of the plan completed today"))) is True
    assert one(spark, T.execution_receipt(F.lit("t"), F.lit("The merge done: service uses sockets"))) is False
    assert one(spark, T.unsupported_question(F.lit("Is it blue?"), F.lit("fact"))) is True
    assert one(spark, T.unsupported_question(F.lit("It is blue, right?"), F.lit("fact"))) is False
    assert one(spark, T.transient_occurrence(F.lit("build 123"), F.lit("see build 123"))) is True
    assert one(spark, T.vague_authority(F.lit("do that"), F.lit("use postgres storage layer"))) is True


def test_splitmix_step():
    assert int(V.splitmix64(np.zeros(1, np.uint64))[0]) == 0xE220A8397B1DCDAF


REF = TP.ns(date(2026, 3, 18))


@pytest.mark.parametrize(
    ("text", "kind", "start", "end"),
    [
        ("on 2025-03-04", "day", date(2025, 3, 4), date(2025, 3, 5)),
        ("2025-03-04 to 2025-04-01", "range", date(2025, 3, 4), date(2025, 4, 2)),
        ("Q3 2025", "quarter", date(2025, 7, 1), date(2025, 10, 1)),
        ("March 5, 2025", "day", date(2025, 3, 5), date(2025, 3, 6)),
        ("next tuesday", "day", date(2026, 3, 24), date(2026, 3, 25)),
        ("tomrorow", "day", date(2026, 3, 19), date(2026, 3, 20)),
        ("in three days", "day", date(2026, 3, 21), date(2026, 3, 22)),
        ("1 month ago", "day", date(2026, 2, 18), date(2026, 2, 19)),
        ("northern winter 2025", "season", date(2025, 12, 1), date(2026, 3, 1)),
        ("next march", "month", date(2027, 3, 1), date(2027, 4, 1)),
    ],
)
def test_anchors(text, kind, start, end):
    assert TP.parse(text, REF).anchors == [(kind, TP.ns(start), TP.ns(end))]


def test_other_temporal_material():
    assert TP.parse("since 2025-01-01").anchors == [("since", TP.ns(date(2025, 1, 1)), None)]
    assert TP.parse("every other week").recurrences == [("week", 2, 0)]
    assert TP.parse("for about 3 to 5 days").durations == [(3, 5, "day", True)]
    assert TP.parse("at 5:30 pm").times == ["17:30:00"]
    assert TP.parse("tomorrow").anchors == [] and TP.status(TP.parse("tomorrow")) == "unresolved"
    assert TP.status(TP.parse("biweekly")) == "unresolved"
    assert TP.status(TP.parse("nothing may be here")) == "none" and TP.status(TP.parse(None)) == "none"
    assert TP.parse("2025-02-30").anchors == []
