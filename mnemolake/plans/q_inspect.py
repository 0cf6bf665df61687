"""Queries of endpoint checks, extraction and inspection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import endpoints as EP
from ..operators import extraction as X
from ..operators import inspection as I
from . import tables as TB
from .registry import query


@query("select event_id, list_sort(json_keys(props)) = ['browser', 'v'] or false as exact from events")
def json_shape(spark, sf_dir):
    e = TB.read(spark, sf_dir, "events")
    return e.select("event_id", EP.has_exactly(F.col("props"), ["browser", "v"]).alias("exact"))


@query("select c_custkey, '{\"a\":\"' || c_name || '\",\"b\":\"' || c_mktsegment || '\"}' as merged from customer")
def ledger_repair(spark, sf_dir):
    c = TB.read(spark, sf_dir, "customer")
    base = EP.payload(a=F.col("c_name"))
    patch = EP.payload(a=F.lit("other"), b=F.col("c_mktsegment"))
    return c.select("c_custkey", EP.repaired(base, patch).alias("merged"))


@query("select conv_id, turn, '{\"n\":' || length(cast(to_json({'role': role, 'text': text}) as varchar)) || '}' as answer from conversations")
def injected_endpoint(spark, sf_dir):
    """A stub model that answers with the length of its payload."""
    ask = EP.complete_json(lambda s: f'{{"n":{len(s)}}}')
    c = TB.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", ask(EP.payload(role=F.col("role"), text=F.col("text"))).alias("answer"))


@query("with c as (select conv_id * 100 + turn as idx, conv_id, turn, role, text, case when turn % 4 = 0 then 'direct' when turn % 4 = 2 then 'adoption' else 'rumour' end as authority, case when turn % 4 = 2 then turn - 1 when turn % 8 = 0 and turn > 0 then turn - 1 end as src from conversations), j as (select c.*, s.role as srole from c left join conversations s on s.conv_id = c.conv_id and s.turn = c.src) select idx, case when authority = 'rumour' then 'unknown authority' when role <> 'user' then 'not a user turn' when idx % 3 = 0 and not contains(text, left(text, 10) || '#') then 'quote not verbatim' when src is not null and authority <> 'adoption' then 'authority source not allowed' when src is not null and (srole is null or srole <> 'assistant') then 'authority source is no assistant turn' end as rejection from j")
def candidate_validation(spark, sf_dir):
    c = TB.read(spark, sf_dir, "conversations")
    turns = c.select("conv_id", "turn", "role", "text", F.concat_ws(":", "conv_id", "turn").alias("node_id"))
    t, idx = F.col("turn"), F.col("conv_id") * 100 + F.col("turn")
    src = F.when(t % 4 == 2, t - 1).when((t % 8 == 0) & (t > 0), t - 1)
    cand = turns.select(
        idx.alias("idx"), "node_id", F.when(idx % 3 == 0, F.concat(F.left("text", F.lit(10)), F.lit("#"))).otherwise(F.left("text", F.lit(10))).alias("quote"), F.lit("t").alias("title"), "text",
        F.when(t % 4 == 0, "direct").when(t % 4 == 2, "adoption").otherwise("rumour").alias("authority"), F.when(src.isNotNull(), F.concat_ws(":", "conv_id", src)).alias("authority_node"),
    ).withColumnRenamed("text", "content")
    return X.validated(cand, turns).select("idx", "rejection")


@query("with g as (select role, length(text) % 7 as k, min(conv_id * 100 + turn) as first, string_agg(left(text, 5), '|' order by conv_id * 100 + turn) as clauses from conversations group by 1, 2) select role, k, first, clauses from g order by first limit 64")
def retained_clauses(spark, sf_dir):
    c = TB.read(spark, sf_dir, "conversations").select("role", (F.length("text") % 7).alias("k"), (F.col("conv_id") * 100 + F.col("turn")).alias("position"), F.left("text", F.lit(5)).alias("clause"))
    return X.retained_groups(c, ["role", "k"]).withColumn("clauses", F.array_join("clauses", "|"))


@query("select doc_id as memory_id, case when doc_id % 10 = 0 then 'direct' when doc_id % 10 = 1 then 'absent' when doc_id % 10 = 2 then 'unavailable' when lang <> 'en' then 'restricted' else 'available' end as status from documents")
def provenance(spark, sf_dir):
    d = TB.read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    mem = d.select(i.alias("memory_id"), F.when(i % 10 == 0, "management").otherwise("extraction").alias("origin"), F.when(i % 10 != 1, i).alias("source_node"))
    src = d.where(i % 10 != 2).select(i.alias("node_id"), F.col("lang").alias("owner"), "text")
    return I.provenance(mem, src, "en").select("memory_id", "status")


@query(f"with {TB.RELATIONS_SQL}, l as (select * from relations where active and source % 3 <> 0 and target % 3 <> 0) select source as node, 'out' as direction, target as other, kind from l where source < 100 union all select target, 'in', source, kind from l where target < 100")
def neighbour_inspection(spark, sf_dir):
    nodes = TB.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"))
    return I.neighbours(TB.relations(spark, sf_dir), nodes.where("node < 100"), nodes.where("node % 3 <> 0"))


@query("with l as (select l_orderkey as submission, bool_and(l_linestatus = 'O') as c, bool_and(l_linestatus = 'F') as d from lineitem group by 1) select o_orderkey as submission, case when o_orderstatus = 'P' then 'committed' else 'pending' end as state, case when o_orderstatus = 'P' then 'none' when c then 'cancel' when d then 'finalise' else 'wait' end as allows from orders left join l on submission = o_orderkey")
def submission_queue(spark, sf_dir):
    o = TB.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("submission"), F.lit(1).alias("revision"), F.when(F.col("o_orderstatus") == "P", "committed").otherwise("pending").alias("state"))
    ops = TB.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("submission"), F.when(F.col("l_linestatus") == "O", "cancelled").otherwise("completed").alias("op_state"))
    return I.submissions(o, ops)


@query("select label as profile, vec_id as body, case when vec_id % 3 = 0 then 'noop' when vec_id % 3 = 1 then 'conflict' else 'bound' end as verdict from embeddings")
def vector_generation(spark, sf_dir):
    e = TB.read(spark, sf_dir, "embeddings").select(F.col("label").alias("profile"), F.col("vec_id").alias("body"), F.col("vec_id").alias("content_id"), F.col("embedding").alias("vector"))
    old = e.where("body % 3 <> 2").withColumn("content_id", F.when(F.col("body") % 3 == 0, F.col("content_id")).otherwise(-1))
    return I.publish_generation(old, e, 64).select("profile", "body", "verdict")


@query("select l_suppkey as profile, case when count(distinct l_returnflag) = (select count(distinct l_returnflag) from lineitem) then 'keep' else 'retire' end as verdict from lineitem group by 1")
def profile_repair(spark, sf_dir):
    li = TB.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("profile"), F.col("l_returnflag").alias("body"))
    return I.profile_repair(li.select("profile").distinct(), li, li.select("body"))


@query("select doc_id as memory_id, case when doc_id % 2 = 0 and lang <> 'en' then 'other owner' when doc_id % 2 = 1 then 'invalid score' when doc_id % 7 = 0 then 'skipped' when doc_id % 11 = 0 then 'archived' else 'selected' end as verdict from documents")
def supplied_evidence(spark, sf_dir):
    d = TB.read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    mem = d.select(i.alias("memory_id"), F.col("lang").alias("owner"), (i % 11 == 0).alias("archived"), (i % 7 == 0).alias("tombstoned"))
    return I.supplied_evidence(d.select(i.alias("memory_id"), F.when(i % 2 == 1, 2.0).otherwise(0.5).alias("score")), mem, "en")
