"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.digest(_read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.digest(_read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    return quality_rules.digest(_read(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digest(_read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.digest(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup

    return near_dedup.digest(_read(spark, sf_dir, "documents"))


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import katz

    return katz.digest(_read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pu_classifier

    return pu_classifier.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    found = (
        op1_substring_dedup, op2_mixing, op3_quality_rules, op4_katz_backoff, op5_quality_classifier, op6_secrets, op7_sharding,
        op8_decontamination, op9_near_dedup, op10_toxicity,
    )
    return {f.__name__: f for f in found}


WORDS = "list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP1 = f"""
with d as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 18)) as i, w from d where len(w) >= 20),
g as (select doc_id, i, row_number() over (partition by array_to_string(w[i:i + 19], ' ') order by doc_id, i) as k from s),
c as (select distinct doc_id, unnest(range(i, i + 20)) as i from g where k > 1),
t as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
k as (select t.doc_id, count(c.i) as n_removed, string_agg(word, ' ' order by t.i) filter (c.i is null) as kept from t left join c on c.doc_id = t.doc_id and c.i = t.i group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""


def _op3() -> str:
    from . import quality_rules as q

    stop = ", ".join(f"'{w}'" for w in q.STOP_WORDS)
    tests = []
    for r in q.RULES:
        over, under = (x.strip() for x in r.metric.split("/"))
        value = f"({over} / nullif({under}, 0))"
        tests += [f"coalesce({value} >= {r.least}, false)"] * (r.least is not None) + [f"coalesce({value} <= {r.most}, false)"] * (r.most is not None)
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, {WORDS.format("coalesce(text, '')")} as w from documents),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
r as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from g),
c as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from r where n > 1) group by 1),
m as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '{q.SYMBOLS}')) as n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, len(regexp_extract_all(t, '[!?]')) as n_marks, len(regexp_extract_all(t, '\p{{Lu}}')) as n_upper,
 len(list_filter(w, lambda x: x in ({stop}))) as n_stop_words, coalesce(n_repeat_words, 0) as n_repeat_words from d left join c using (doc_id)),
f as (select *, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {' and '.join(tests)} as kept from f
"""


_OP9 = f"""
with recursive d as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both_n from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_n >= 85 * (x.n + y.n - both_n)),
u as (select a, b from l union select b, a from l),
r(node, other) as (select a, a from u union select r.node, u.b from r join u on u.a = r.other),
c as (select node as doc_id, min(other) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, coalesce(c.component_id, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join c using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Exact counterparts; the other operators learn, draw or hash and are tested against brute force."""
    return {"op1_substring_dedup": _OP1, "op3_quality_rules": _op3(), "op9_near_dedup": _OP9}
