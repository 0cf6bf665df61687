"""Queries of functions and smaller operators: search orders, guards, inferences, imports, endpoints, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import endpoints as EP
from ..functions import temporal as TP
from ..functions import text as T
from ..operators import archive as A
from ..operators import entities as E
from ..operators import extraction as X
from ..operators import freshness as FR
from ..operators import graph as G
from ..operators import inspection as I
from ..operators import retrieval as R
from ..operators import versioned as VR
from ..sources import chat_export as S
from . import tables as TB
from .q_core import MEM, QUERY, REV, TOK, _LEX, _LEX_PARTS, _memories
from .registry import query

REL = TB.RELATIONS_SQL


# search orders


def _lex_sql(table: str, text: str, columns: str) -> str:
    parts = ", ".join(f"{p} as c{i}" for i, p in enumerate(_LEX_PARTS))
    return f"t as (select {columns}, lower(coalesce({text}, '')) as low, {TOK.format(text)} as tok from {table}), c as (select *, {parts} from t), lex as (select *, {_LEX} as score from c)"


@query(f"with {_lex_sql('conversations', 'text', 'conv_id * 1000 + turn as id, turn, text')} select id, turn, round(score, 9) as score from lex where score > 0 order by score desc, turn desc, id limit 10")
def raw_turn_search(spark, sf_dir):
    c = TB.read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", "text")
    return R.raw_search(c, QUERY, F.col("text"), "id", "turn").select("id", "turn", F.round("score", 9).alias("score"))


FILE_QUERY = ("page", "ref", "fr", "com")


@query(
    f"with t as (select page_id, url, lower(url) as low, {TOK.format('url')} as tok from pages), c as (select page_id, url, " + ", ".join(f"case when list_contains(tok, '{t}') then cast((length(low) - length(replace(low, '{t}', ''))) / {len(t)} as int) else 0 end as c{i}" for i, t in enumerate(FILE_QUERY))
    + " from t) select page_id, url, round(score, 9) as score from (select *, 0.85 * ((c0 > 0)::int + (c1 > 0)::int + (c2 > 0)::int + (c3 > 0)::int) / 4.0 + 0.15 * least((least(c0, 4) + least(c1, 4) + least(c2, 4) + least(c3, 4)) / 8.0, 1.0) as score from c) where score > 0 order by score desc, url, page_id limit 10"
)
def file_name_search(spark, sf_dir):
    found = R.file_search(TB.read(spark, sf_dir, "pages").select("page_id", "url"), FILE_QUERY, "url", "page_id")
    return found.select("page_id", "url", F.round("score", 9).alias("score"))


@query("select l_partkey, l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as k from lineitem) where k = 1")
def first_candidates(spark, sf_dir):
    li = TB.read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", (-F.col("l_extendedprice")).alias("r"))
    return R.first_of_each(li, ["l_partkey", "l_suppkey"], ["r", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query(
    "with cen as (select label, vec_id as id, embedding, row_number() over (partition by label order by vec_id) as c from embeddings), "
    "s as (select e.label, e.vec_id as id, c, round(greatest(-1.0, least(1.0, list_cosine_similarity(cen.embedding::double[], e.embedding::double[]))), 9) as cos from embeddings e join cen on cen.label = e.label and c <= 2), "
    "r1 as (select label, id from (select *, row_number() over (partition by label order by cos desc, id) as k from s where c = 1) where k <= 2), "
    "r2 as (select label, id from (select *, row_number() over (partition by label order by cos desc, id) as k from s where c = 2 and (label, id) not in (select label, id from r1)) where k <= 2), "
    "r3 as (select label, id from (select *, row_number() over (partition by label order by best desc, id) as k from (select label, id, max(cos) as best from s where (label, id) not in (select label, id from r1 union all select label, id from r2) group by 1, 2)) where k <= 4) "
    "select label, string_agg(id::varchar, ',' order by id) as representatives from (select * from r1 union all select * from r2 union all select * from r3) group by 1"
)
def community_representatives(spark, sf_dir):
    """The two least ids of each label stand for its centroids."""
    v = TB.read(spark, sf_dir, "embeddings")
    two = v.groupBy("label").agg(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), 1, 2).alias("two"))
    cent = two.select("label", F.posexplode("two").alias("centroid_no", "x")).select("label", "centroid_no", F.col("x.embedding").alias("centroid"))
    found = R.representatives(v, cent, "label", "vec_id", "embedding")
    return found.select("label", F.array_join(F.transform("representatives", lambda x: x.cast("string")), ",").alias("representatives"))


# archive


@query("with p as (select distinct conv_id, conv_id || ':' || (conv_id % 4) as leaf, conv_id % 4 as k from conversations) select conv_id, leaf, case when not exists (select 1 from conversations c where c.conv_id = p.conv_id and c.turn = k) then 'unknown node' when not exists (select 1 from conversations c where c.conv_id = p.conv_id and c.turn = 1) then 'created' when k = 1 then 'unchanged' when k > 1 then 'advanced' else 'not a descendant' end as verdict from p")
def branch_advance(spark, sf_dir):
    t = A.turns(TB.read(spark, sf_dir, "conversations"))
    heads = t.where("turn = 1").select("conv_id", F.lit("main").alias("branch"), F.col("node_id").alias("leaf"))
    asked = t.select("conv_id").distinct().select("conv_id", F.lit("main").alias("branch"), F.concat_ws(":", "conv_id", F.col("conv_id") % 4).alias("leaf"))
    return A.advance_branches(t, heads, asked).select("conv_id", "leaf", "verdict")


@query("select conv_id, turn, role, text from conversations where conv_id = 3 and turn = 1")
def single_turn(spark, sf_dir):
    return A.read_turn(TB.read(spark, sf_dir, "conversations"), 3, 1)


@query("select c.conv_id as range_id, c.conv_id || ':' || c.turn as node_id, c.turn - 1 as place from conversations c join (select conv_id, max(turn) as m from conversations group by 1) using (conv_id) where m >= 1 and c.turn >= 1")
def ancestor_slices(spark, sf_dir):
    t = A.turns(TB.read(spark, sf_dir, "conversations"))
    ends = t.groupBy("conv_id").agg(F.max("turn").alias("m")).where("m >= 1")
    node = lambda c: F.concat_ws(":", "conv_id", c)
    return A.ancestor_slice(t, ends.select(F.col("conv_id").alias("range_id"), node(F.lit(1)).alias("start"), node("m").alias("end")))


# versioned


@query(f"with {MEM}, kept as (select memory_id from mem where state = 'canonical' and not archived), {REV}, u as (select memory_id, version, event_type, value, 'revision' as change from rev where memory_id in (select memory_id from kept) union all select memory_id, version, null, null, 'tombstone' from tomb where memory_id in (select memory_id from kept)) select memory_id, event_type, value, change, row_number() over (order by version, change = 'tombstone', memory_id) as new_version from u")
def rewritten_history(spark, sf_dir):
    kept = VR.rewrite_filter(_memories(spark, sf_dir), states=["canonical"], archived=False)
    return VR.rewrite(TB.revisions(spark, sf_dir), kept, TB.tombstones(spark, sf_dir), "memory_id", "version").select("memory_id", "event_type", "value", "change", "new_version")


@query("select c_custkey as k, c_custkey as mutation_id, case when c_custkey % 11 = 0 then 'replay' when c_custkey % 13 = 0 then 'reused mutation' when c_custkey % 3 = 1 then 'stale' when c_custkey % 5 = 0 then 'immutable field' when c_custkey % 7 = 0 then 'clock went back' else 'applied' end as verdict from customer")
def record_updates(spark, sf_dir):
    k = F.col("c_custkey")
    c = TB.read(spark, sf_dir, "customer").select(k)
    now = c.select(k.alias("k"), F.lit(2).alias("revision"), F.lit(100).alias("updated_at"), F.lit("x").alias("created_at"))
    asked = c.select(k.alias("k"), k.alias("mutation_id"), F.lit("d").alias("digest"), F.when(k % 3 == 1, 1).otherwise(2).alias("expected"), F.when(k % 7 == 0, 99).otherwise(101).alias("updated_at"), F.when(k % 5 == 0, "y").otherwise("x").alias("created_at"))
    applied = c.where("c_custkey % 11 = 0 or c_custkey % 13 = 0").select(k.alias("mutation_id"), F.when(k % 11 == 0, "d").otherwise("other").alias("digest"))
    return VR.update_records(now, asked, applied, "k", ["created_at"])


@query("select p_partkey as k, case when p_partkey % 2 = 1 then 'not tombstoned' when p_partkey % 10 = 4 then 'shared body' when p_partkey % 10 = 6 then 'referenced' else 'pruned' end as verdict from part where p_partkey < 100")
def prune_verdicts(spark, sf_dir):
    k = F.col("p_partkey")
    p = TB.read(spark, sf_dir, "part").select(k)
    refs = p.select(k.alias("k"), k.alias("body")).union(p.where("p_partkey < 100 and p_partkey % 10 = 4").select(k + 1_000_000, k))
    return VR.prune_targets(p.where("p_partkey < 100").select(k.alias("k")), p.where("p_partkey % 2 = 0").select(k.alias("k")), refs, p.where("p_partkey % 10 = 6").select(k.alias("body")), "k", "body")


@query("select kind, c_custkey as key, case when kind = 'identity' then case when c_custkey % 3 > 0 then 'identity is fixed' else 'applied' end when kind = 'synthesis' then case when c_custkey % 3 = c_custkey % 2 then 'applied' else 'not the latest synthesis' end when c_custkey % 3 = c_custkey % 4 then 'applied' else 'stale' end as verdict, case when kind = 'identity' then case when c_custkey % 3 = 0 then 1 end when kind = 'synthesis' then case when c_custkey % 3 = c_custkey % 2 then c_custkey % 3 + 1 end when c_custkey % 3 = c_custkey % 4 then c_custkey % 3 + 1 end as new_revision from (select c_custkey, unnest(['identity', 'anchor', 'synthesis']) as kind from customer where c_custkey % 12 > 0)")
def ego_writes(spark, sf_dir):
    k = F.col("c_custkey")
    c = TB.read(spark, sf_dir, "customer").where("c_custkey % 12 > 0").select(k, F.explode(F.array(F.lit("identity"), F.lit("anchor"), F.lit("synthesis"))).alias("kind"))
    stored = c.where("c_custkey % 3 > 0").select("kind", k.alias("key"), (k % 3).alias("revision"))
    expected = F.when(F.col("kind") == "identity", 0).otherwise(k % 4)
    return VR.ego_writes(stored, c.select("kind", k.alias("key"), expected.alias("expected"), (k % 2).alias("previous")))


# entities


@query("select l_orderkey as mention, l_linenumber as entity, rank from (select *, row_number() over (partition by l_orderkey order by l_quantity > 40 desc, l_returnflag = 'A' desc, l_linestatus = 'F' desc, (l_tax > 0.04)::int + (l_suppkey % 3 > 0)::int + (l_partkey % 2 > 0)::int desc, l_discount desc, l_suppkey % 3 desc, l_partkey % 2 desc, l_linenumber) as rank from lineitem) where rank <= 8")
def ranked_entities(spark, sf_dir):
    li = TB.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("mention"), F.col("l_linenumber").alias("entity"), (F.col("l_quantity") > 40).alias("exact"), (F.col("l_returnflag") == "A").alias("normalised"), (F.col("l_linestatus") == "F").alias("alias"),
        (F.col("l_tax") > 0.04).alias("source_association"), (F.col("l_suppkey") % 3).alias("lexical_hits"), (F.col("l_partkey") % 2).alias("graph_hits"), F.col("l_discount").alias("best_lexical"),
    )
    return E.ranked_candidates(li, "mention").select("mention", "entity", "rank")


@query("with e as (select p_partkey as id, p_partkey % 3 as revision, case when p_size = 1 then 'principal' else p_type end as kind from part), a as (select p_partkey as l, (p_partkey * 7 + p_size) % (select count(*) from part) as r, case when p_partkey % 5 = 0 then 'related' else 'same' end as relation, p_partkey % 3 as lr, p_partkey % 4 = 0 as off from part) select a.l as \"left\", a.r as \"right\", case when a.l = a.r then 'same entity' when relation <> 'same' then 'not same identity' when x.id is null or y.id is null then 'missing entity' when off then 'stale revision' when x.kind = 'principal' or y.kind = 'principal' then 'principal entity' when x.kind <> y.kind then 'kind mismatch' else 'proposed' end as verdict from a left join e x on x.id = a.l left join e y on y.id = a.r")
def merge_proposals(spark, sf_dir):
    k = F.col("p_partkey")
    p = TB.read(spark, sf_dir, "part").select(k, "p_size", "p_type")
    n = p.count()
    entities = p.select(k.alias("id"), (k % 3).alias("revision"), F.when(F.col("p_size") == 1, "principal").otherwise(F.col("p_type")).alias("kind"))
    right = (k * 7 + F.col("p_size")) % n
    asked = p.select(k.alias("left"), F.when(k % 4 == 0, 9).otherwise(k % 3).alias("left_revision"), right.alias("right"), (right % 3).alias("right_revision"), F.when(k % 5 == 0, "related").otherwise("same").alias("relation"))
    return E.merge_proposals(asked, entities)


_GENERIC = ", ".join(f"'{w}'" for w in T.GENERIC_SURFACES)


@query(
    f"with t as (select l_orderkey, l_linenumber, ['tool', 'north', 'Shader', 'quartz'][l_linenumber % 4 + 1] as s, * from lineitem) select l_orderkey, l_linenumber, case when l_suppkey % 10 = 3 then 'invalid span' when lower(s) in ({_GENERIC}) then 'generic_role' when l_partkey % 12 > 8 then 'too many candidates' "
    "when l_partkey % 12 > 0 and l_quantity / 50 >= 0.95 and l_quantity / 50 - l_discount >= 0.15 and l_linestatus = 'F' then 'accept' when l_returnflag = 'A' then case when l_tax > 0.02 then 'accept' else 'unresolved' end when l_returnflag = 'N' then 'unresolved' else 'reject' end as verdict from t"
)
def entity_resolution(spark, sf_dir):
    li = TB.read(spark, sf_dir, "lineitem")
    surface = F.element_at(F.array(*[F.lit(x) for x in ("tool", "north", "Shader", "quartz")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    choice = F.when(F.col("l_returnflag") == "A", "candidate").when(F.col("l_returnflag") == "N", "create").otherwise("reject")
    verdict = E.resolution(
        F.col("l_suppkey") % 10 != 3, surface, F.lit("a stone of some kind"), F.col("l_partkey") % 12, F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_linestatus") == "F",
        choice, F.lit("same"), F.col("l_tax") > 0.02,
    )
    return li.select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


@query(f"select p_partkey, case when len(t) = 1 then t[1] end as token from (select p_partkey, {TOK.format('case when p_partkey % 2 = 0 then p_name else p_type end')} as t from part)")
def single_tokens(spark, sf_dir):
    x = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type"))
    return TB.read(spark, sf_dir, "part").select("p_partkey", T.single_token(x).alias("token"))


@query(f"select doc_id, len(list_distinct(list_filter({TOK.format('text')}, lambda x: strlen(x) > 1)[1:256])) as n from documents")
def discovery_tokens(spark, sf_dir):
    return TB.read(spark, sf_dir, "documents").select("doc_id", F.size(T.discovery_tokens(F.lower("text"))).cast("long").alias("n"))


# temporal


@query("select o_orderkey as id, o_orderkey % 6 < 3 as ok from orders")
def inference_verification(spark, sf_dir):
    o, k = TB.read(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    said = F.when(k.isin(0, 3), F.date_format("o_orderdate", "yyyy-MM-dd")).when(k.isin(1, 4), "every 2 weeks").when(k == 2, "for three days").otherwise("soon")
    kind = F.when(k.isin(0, 4), "calendar").when(k.isin(1, 3), "recurrence").when(k == 2, "duration").otherwise("relative")
    return o.select(F.col("o_orderkey").alias("id"), TP.verifies(said, kind, F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ok"))


@query("select event_id as id, unnest([{'kind': 'explicit', 's': 3, 'e': 13}, {'kind': 'relative', 's': 31, 'e': 40}, {'kind': 'boundary', 's': 42, 'e': 47}, {'kind': 'calendar', 's': 48, 'e': 54}, {'kind': 'recurrence', 's': 56, 'e': 61}, {'kind': 'duration', 's': 66, 'e': 71}], recursive := true) from events")
def temporal_indications(spark, sf_dir):
    e = TB.read(spark, sf_dir, "events")
    text = F.concat(F.lit("On "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" we met; it began yesterday, since Monday; every two weeks."))
    return e.select(F.col("event_id").alias("id"), F.explode(TP.indications(text)).alias("i")).select("id", "i.kind", F.col("i.start").alias("s"), F.col("i.end").alias("e"))


@query("select event_id as id, case when event_id % 4 = 0 then 'accepted' when event_id % 4 = 1 then 'evidence differs' when event_id % 4 = 2 then 'no such indication' else 'not resolvable' end as verdict from events")
def applied_inferences(spark, sf_dir):
    e, k = TB.read(spark, sf_dir, "events"), F.col("event_id") % 4
    texts = e.select(F.col("event_id").alias("id"), F.lit("It began yesterday.").alias("text"))
    said = e.select(
        F.col("event_id").alias("id"), F.lit("relative").alias("kind"), F.when(k == 2, 0).otherwise(9).alias("start"), F.when(k == 2, 2).otherwise(18).alias("end"),
        F.when(k == 1, "tomorrow").when(k == 2, "It").otherwise("yesterday").alias("evidence"), F.when(k == 3, "some day").otherwise("2024-01-01").alias("expression"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ref"),
    )
    return TP.with_inferences(texts, said).select("id", "verdict")


@query("with b as (select o_orderkey as id, 'day' as kind, o_orderkey * 10 as s, o_orderkey * 10 + 10 as e, 'base' as evidence from orders), x as (select o_orderkey as id, 'day' as kind, o_orderkey * 10 + case when o_orderkey % 2 = 0 then 0 else 5 end as s, o_orderkey * 10 + 10 as e, 'extra' as evidence from orders) select * from b union all select * from x where not exists (select 1 from b where b.id = x.id and b.s = x.s and b.e = x.e)")
def merged_analyses(spark, sf_dir):
    k = F.col("o_orderkey")
    o = TB.read(spark, sf_dir, "orders")
    rows = lambda shift, name: o.select(k.alias("id"), F.lit("day").alias("kind"), (k * 10 + shift).alias("s"), (k * 10 + 10).alias("e"), F.lit(name).alias("evidence"))
    return TP.merged(rows(F.lit(0), "base"), rows(F.when(k % 2 == 0, 0).otherwise(5), "extra"), ["kind", "s", "e"])


#: One sentence for each form the parser knows, with what it reads, for a reference of Wednesday 2024-05-15.
FORMS = (
    ("2024-02-03", "day:2024-02-03:1"), ("2024-02-03 to 2024-02-05", "range:2024-02-03:3"), ("March 4, 2023", "day:2023-03-04:1"), ("4 March 2023", "day:2023-03-04:1"), ("the 4th of March 2023", "day:2023-03-04:1"),
    ("Mar 4, 2023", "day:2023-03-04:1"), ("Q2 2023", "quarter:2023-04-01:91"), ("October 2023", "month:2023-10-01:31"), ("2023-11", "month:2023-11-01:30"), ("northern summer 2023", "season:2023-06-01:92"),
    ("June 3 last year", "day:2023-06-03:1"), ("last March", "month:2024-03-01:31"), ("next March", "month:2025-03-01:31"), ("in 2023", "year:2023-01-01:365"), ("today", "day:2024-05-15:1"), ("tomorrow", "day:2024-05-16:1"),
    ("next Friday", "day:2024-05-17:1"), ("last Friday", "day:2024-05-10:1"), ("this week", "week:2024-05-13:7"), ("last month", "month:2024-04-01:30"), ("next quarter", "quarter:2024-07-01:92"), ("last year", "year:2023-01-01:365"),
    ("in three days", "day:2024-05-18:1"), ("two weeks ago", "day:2024-05-01:1"), ("5 months ago", "day:2023-12-15:1"), ("yesterdya", "day:2024-05-14:1"), ("last Octobr", "month:2023-10-01:31"), ("from 2024-02-03 until 2024-02-09", "range:2024-02-03:7"),
)
_FORM_ROWS = ", ".join("({}, '{}', date '{}', {})".format(i, *w.split(":")) for i, (_, w) in enumerate(FORMS))


@query(f"select i as form, kind, epoch_ns(d::timestamp) as s, epoch_ns(d::timestamp) + n * 86400000000000 as e from (values {_FORM_ROWS}) t(i, kind, d, n)")
def temporal_forms(spark, sf_dir):
    """Every form of anchor in a sentence of its own."""
    rows = spark.createDataFrame([(i, f"We met {x}, they said.") for i, (x, _) in enumerate(FORMS)], "form int, text string")
    ref = F.lit(1715731200).cast("long") * F.lit(10**9)
    return rows.select("form", F.explode(TP.analyse(F.col("text"), ref)["anchors"]).alias("a")).select("form", "a.kind", F.col("a.start").alias("s"), F.col("a.end").alias("e"))


@query("select a.o_orderkey as query_id, b.o_orderkey as memory_id, cast(0.7 as double) as score from orders a join orders b on a.o_orderkey % 20 = 0 and b.o_custkey = a.o_custkey and a.o_orderkey % 3 = b.o_orderkey % 3")
def recurrence_matches(spark, sf_dir):
    o = TB.read(spark, sf_dir, "orders")
    rows = lambda df, name: df.select(F.col("o_orderkey").alias(name), F.col("o_custkey").cast("string").alias("unit"), (F.col("o_orderkey") % 3).alias("every"), F.lit(None).cast("int").alias("part"))
    return TP.recurrence_match(rows(o.where("o_orderkey % 20 = 0"), "query_id"), rows(o, "memory_id"))


# functions


@query("select c_custkey, c_custkey % 3 = 0 and c_custkey % 10 < 9 as ok from customer")
def probe_compatibility(spark, sf_dir):
    k = F.col("c_custkey")
    cosines = F.array(F.lit(1.0), 0.999 - (k % 10) / 1000.0, F.lit(0.995))
    return TB.read(spark, sf_dir, "customer").select("c_custkey", EP.probes_compatible(F.when(k % 10 == 9, F.array(F.lit(0.98))).otherwise(cosines), k % 3 == 0).alias("ok"))


@query("select c_custkey, cast(c_custkey * 3 % 10 as bigint) as carry from customer")
def initial_carry(spark, sf_dir):
    return TB.read(spark, sf_dir, "customer").select("c_custkey", FR.initial_carry(F.col("c_custkey"), F.col("c_custkey") * 3).cast("long").alias("carry"))


@query("select conv_id, turn, strlen(text) % 7 as a, turn as b from conversations")
def embedded_texts(spark, sf_dir):
    """An injected embedding endpoint, the first that is there."""
    routes = EP.first_route(None, lambda texts: [[float(len(t.encode()) % 7), 1.0] for t in texts], None)
    c = TB.read(spark, sf_dir, "conversations")
    v = EP.embed(routes)(F.col("text"))
    return c.select("conv_id", "turn", F.get(v, F.lit(0)).cast("long").alias("a"), (F.get(v, F.lit(1)) * F.col("turn")).cast("long").alias("b"))


def _yes(states: list, questions: list) -> list:
    return [('{"version":1,"approved":true}' if '"n":1' in s or '"n":3' in s else '{"version":1}') for s in states]


@query("select c_custkey, c_custkey % 4 in (1, 3) as answered from customer")
def decision_endpoint(spark, sf_dir):
    k = F.col("c_custkey")
    answer = EP.decision(_yes, EP.payload(n=k % 4), F.lit('{"instruction":"approve"}'), ["version", "approved"])
    return TB.read(spark, sf_dir, "customer").select("c_custkey", answer.isNotNull().alias("answered"))


@query("select c_custkey, c_custkey % 3 <> 2 as ok from customer")
def enumerated_field(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("same"), F.lit("related"), F.lit("other")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return TB.read(spark, sf_dir, "customer").select("c_custkey", EP.one_of(EP.payload(relation=kind), "relation", ["same", "related"]).alias("ok"))


@query("select p_partkey, damerau_levenshtein(p_name, case p_partkey % 4 when 0 then p_name when 1 then substr(p_name, 2, 1) || left(p_name, 1) || substr(p_name, 3) when 2 then substr(p_name, 2) else 'Z' || p_name || 'Z' end) as distance from part")
def edit_distances(spark, sf_dir):
    """Names against themselves with two letters swapped, one left out, or two added."""
    k, x = F.col("p_partkey") % 4, F.col("p_name")
    rest = lambda n: F.expr(f"substr(p_name, {n})")
    other = F.when(k == 0, x).when(k == 1, F.concat(F.substring(x, 2, 1), F.left(x, F.lit(1)), rest(3))).when(k == 2, rest(2)).otherwise(F.concat(F.lit("Z"), x, F.lit("Z")))
    return TB.read(spark, sf_dir, "part").select("p_partkey", T.edit_distance()(x, other).cast("long").alias("distance"))


@query("select conv_id, turn, left(text, len(list_filter(range(1, length(text) + 1), lambda i: strlen(left(text, i)) <= 41))) as head from conversations")
def truncated_texts(spark, sf_dir):
    return TB.read(spark, sf_dir, "conversations").select("conv_id", "turn", T.truncate_utf8()(F.col("text"), F.lit(41)).alias("head"))


NUMBERS = (("seven", 7), ("Twenty-three", 23), ("ninety nine", 99), ("30", 30), ("twenty-twenty", None), ("eleventy", None), ("", None), ("nineteen", 19), ("forty", 40), ("1234567890", None))
_NUMBERS = ", ".join(f"({i}, {'null' if n is None else n})" for i, (_, n) in enumerate(NUMBERS))


@query(f"select p_partkey, n as number from part join (values {_NUMBERS}) t(i, n) on i = p_partkey % {len(NUMBERS)}")
def parsed_numbers(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(w) for w, _ in NUMBERS]), (F.col("p_partkey") % len(NUMBERS) + 1).cast("int"))
    return TB.read(spark, sf_dir, "part").select("p_partkey", T.parse_number(said).alias("number"))


@query("select c_custkey, c_custkey % 5 <> 3 and c_custkey % 20 >= 10 as ok from customer")
def cited_summaries(spark, sf_dir):
    """Summaries that cite a range of known ids; by key the ids are unknown, or the range ends after the cut."""
    k = F.col("c_custkey")
    summary = F.concat(F.lit("They agreed (source:"), F.when(k % 5 == 3, "zz").otherwise("n1"), F.lit("..n7) and then (source:n2..n3)."))
    ids = F.create_map(*[x for i in range(1, 9) for x in (F.lit(f"n{i}"), F.lit(i))])
    return TB.read(spark, sf_dir, "customer").select("c_custkey", T.citations_valid(summary, ids, F.when(k % 20 >= 10, 7).otherwise(6)).alias("ok"))


# imports


def _export_nodes(spark, sf_dir):
    """Nodes of each kind of omission, by turn."""
    c, k = TB.read(spark, sf_dir, "conversations"), F.col("turn") % 6
    message = F.struct(
        F.struct(F.when(k == 2, "tool").otherwise(F.col("role")).alias("role")).alias("author"), F.when(k != 4, F.col("turn").cast("double")).alias("create_time"),
        F.struct(F.when(k == 3, "image").otherwise("text").alias("content_type"), F.array("text").alias("parts")).alias("content"), F.struct((k == 1).alias("is_visually_hidden_from_conversation")).alias("metadata"),
    )
    node = lambda t: F.concat_ws(":", "conv_id", t)
    return c.select("conv_id", node("turn").alias("node_id"), F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("parent_id"), F.when(k != 0, message).alias("m"))


@query("select count(*) as nodes, count(*) filter (turn % 6 = 5) as accepted, count(*) filter (turn % 6 = 0) as omitted_empty, count(*) filter (turn % 6 = 1) as omitted_hidden, count(*) filter (turn % 6 = 2) as omitted_role, count(*) filter (turn % 6 = 3) as omitted_content, count(*) filter (turn % 6 = 4) as omitted_untimed, 0 as omitted_window from conversations")
def import_coverage(spark, sf_dir):
    return I.import_coverage(_export_nodes(spark, sf_dir).withColumn("reason", S.omission()))


@query("select conv_id, conv_id || ':' || turn as node_id, conv_id || ':' || (turn - 1) as old_parent, case when p is not null then conv_id || ':' || p end as new_parent from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as p from conversations where turn % 3 = 2) where turn > 0")
def parent_mappings(spark, sf_dir):
    """Every third turn is kept: its parent, always dropped, is replaced by the turn three before, if any."""
    t = A.turns(TB.read(spark, sf_dir, "conversations"))
    return S.parent_mappings(t.select("conv_id", "node_id", "parent_id", (F.col("turn") % 3 == 2).alias("kept")))


@query("select conv_id, turn, case when turn % 2 = 0 then sha256(text) else sha256('window|' || sha256(text) || '|0|900') end as key from conversations")
def import_keys(spark, sf_dir):
    c = TB.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, S.import_key(F.col("text"))).otherwise(S.import_key(F.col("text"), 0, 900)).alias("key"))


@query("select l_orderkey as item, case when n > 4 then 'too many requests' when l_orderkey % 4 = 0 then 'coverage' when l_orderkey % 4 = 1 and r > 1 then 'bounds' end as error from (select l_orderkey, count(distinct l_linenumber) as n, count(*) as r from lineitem group by 1)")
def evidence_checks(spark, sf_dir):
    """Responses leave a turn out for orders divisible by 4, and are too long for those after them."""
    k = F.col("l_orderkey")
    li = TB.read(spark, sf_dir, "lineitem").select(k.alias("item"), F.col("l_linenumber").alias("request"), F.concat_ws(":", k, "l_linenumber").alias("node_id"))
    first = F.col("request") == F.min("request").over(Window.partitionBy("item"))
    left = li.withColumn("_first", first).where((F.col("item") % 4 != 0) | ~F.col("_first")).drop("_first")
    text = F.repeat(F.lit("x"), F.when(F.col("item") % 4 == 1, 70_000).otherwise(10))
    return X.evidence_errors(li, left.select("item", "node_id", text.alias("text")))


# graph


@query(f"with {REL} select vec_id % 7 as kind_no, vec_id as source, case when vec_id % 7 = 0 then 'self edge' when vec_id % 7 in (1, 2, 3) then 'association' else 'memory relation' end as reason from embeddings where vec_id % 7 < 6")
def relation_shapes(spark, sf_dir):
    i = F.col("vec_id")
    k = i % 7
    e = TB.read(spark, sf_dir, "embeddings").select(
        k.alias("kind_no"), i.alias("source"), F.when(k == 0, i).otherwise(i + 1).alias("target"), F.when(k.between(1, 3), "association").otherwise("topical").alias("kind"),
        F.when(k.isin(1, 4), "entity").otherwise("memory").alias("source_type"), F.when(k == 2, "memory").when(k.isin(3), "entity").otherwise("memory").alias("target_type"), F.when(k == 3, "organiser").when(k == 5, "perception").otherwise("user").alias("origin"),
    )
    return G.shape_errors(e).select("kind_no", "source", "reason")


@query("select user_id as source, event_id % 10 as target, arg_max(event_type, event_id) as state from events where event_id <= 9000 group by 1, 2")
def edges_at_cut(spark, sf_dir):
    log = TB.read(spark, sf_dir, "events").select(F.col("user_id").alias("source"), (F.col("event_id") % 10).alias("target"), F.lit("topical").alias("kind"), F.col("event_id").alias("version"), F.col("event_type").alias("state"))
    return G.current_edges(log, 9000).select("source", "target", "state")


@query(f"with {REL} select vec_id as node, target as other, 'out' as side from relations join embeddings on vec_id = source where active and vec_id % 10 = 0 union all select vec_id, source, 'in' from relations join embeddings on vec_id = target where active and vec_id % 10 = 0")
def directed_edges(spark, sf_dir):
    nodes = TB.read(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("node"))
    r = TB.relations(spark, sf_dir)
    return G.outgoing(r, nodes).select("node", "other", F.lit("out").alias("side")).unionByName(G.incoming(r, nodes).select("node", "other", F.lit("in").alias("side")))


@query("select label as community, count(*) as n, sum(vec_id) as ids, 4 as generation from embeddings group by 1")
def community_generation(spark, sf_dir):
    v = TB.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("community"))
    done = G.publish_communities(3, 4, v, v.select("node"))
    return done.select("community", F.size("members").cast("long").alias("n"), F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"), "generation")


@query("select o_orderkey as use_id, 'x' || (o_orderkey % 5) as first, 'y' as other from orders where o_orderkey % 5 < 2")
def use_conflicts(spark, sf_dir):
    k = F.col("o_orderkey")
    o = TB.read(spark, sf_dir, "orders")
    first = o.select(k.alias("use_id"), F.array(F.concat(F.lit("x"), (k % 5).cast("string"))).alias("sources"))
    again = o.select(k.alias("use_id"), F.when(k % 5 < 2, F.array(F.lit("y"))).otherwise(F.array(F.concat(F.lit("x"), (k % 5).cast("string")))).alias("sources"))
    return FR.use_conflicts(first.union(again)).select("use_id", F.get("first", F.lit(0)).alias("first"), F.get("other", F.lit(0)).alias("other"))


@query("with a as (select event_id, user_id, max(event_id) over (partition by user_id) as last from events where event_id % 2 = 0), l as (select user_id, max(event_id) as last from events where event_id % 2 = 0 group by 1) select e.event_id, case when e.event_id % 2 = 0 and e.event_id % 3 = 0 then 'conflict' when e.event_id % 2 = 0 then 'replay' when e.event_id < l.last then 'regressed' else 'apply' end as verdict from events e left join l using (user_id)")
def late_events(spark, sf_dir):
    i = F.col("event_id")
    e = TB.read(spark, sf_dir, "events").select(F.col("user_id").alias("memory_id"), i, i.alias("position"), F.lit(5).alias("amount"))
    batch = e.withColumn("amount", F.when((i % 2 == 0) & (i % 3 == 0), 6).otherwise(5))
    return FR.late_events(e.where("event_id % 2 = 0"), batch, "memory_id").select("event_id", "verdict")
