"""Queries of organisation, entity, queue, context, temporal, source and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal as TP
from ..functions import text as T
from ..functions import vectors as V
from ..operators import archive as A
from ..operators import context as C
from ..operators import entities as E
from ..operators import freshness as FR
from ..operators import graph as G
from ..operators import organise as O
from ..operators import queues as QU
from ..operators import versioned as VR
from ..sources import chat_export as S
from ..streaming import feeds
from . import tables as TB
from .registry import query

CAND = (
    "cand as (select o_custkey as source, o_orderkey as id, o_totalprice / 1000000 as semantic, case when o_orderkey % 3 = 0 then 0 else o_orderkey % 97 / 97.0 end as lexical, "
    "case when o_orderkey % 5 = 0 then 0.9 end as temporal, 500000 as source_time, o_orderkey * 100 as time from orders)"
)
RANKED = (
    CAND + ", lanes as (select *, case when semantic > 0 then row_number() over (partition by source, semantic > 0 order by semantic desc, id) end as rs, "
    "case when time <= source_time and semantic > 0 then row_number() over (partition by source, time <= source_time and semantic > 0 order by semantic desc, id) end as rp, "
    "case when lexical > 0 then row_number() over (partition by source, lexical > 0 order by lexical desc, id) end as rl, "
    "case when temporal > 0 then row_number() over (partition by source, coalesce(temporal > 0, false) order by temporal desc, id) end as rt from cand), "
    "cut as (select source, id, case when rs <= 24 then rs end as rs, case when rp <= 3 then rp end as rp, case when rl <= 8 then rl end as rl, case when rt <= 8 then rt end as rt from lanes), "
    "fused as (select *, coalesce(1.0 / (60 + rs), 0) + coalesce(0.6 / (60 + rp), 0) + coalesce(0.35 / (60 + rl), 0) + coalesce(1.0 / (60 + rt), 0) as fused from cut)"
)


def _candidates(spark, sf_dir):
    o = TB.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("source"), k.alias("id"), (F.col("o_totalprice") / 1000000).alias("semantic"), F.when(k % 3 == 0, 0.0).otherwise((k % 97) / 97.0).alias("lexical"),
        F.when(k % 5 == 0, 0.9).alias("temporal"), F.lit(500000).cast("long").alias("source_time"), (k * 100).alias("time"),
    )


@query(f"with {RANKED} select source, id, rs as r_semantic, rp as r_prior, rl as r_lexical, rt as r_temporal from cut")
def lane_ranks(spark, sf_dir):
    return O.lane_ranks(_candidates(spark, sf_dir)).select("source", "id", "r_semantic", "r_prior", "r_lexical", "r_temporal")


@query(f"with {RANKED}, k as (select *, row_number() over (partition by source order by rp is null, fused desc, id) as k from fused where fused > 0) select source, id, round(fused, 9) as fused, row_number() over (partition by source order by fused desc, id) as rank from k where k <= 12")
def reserved_selection(spark, sf_dir):
    return O.select(_candidates(spark, sf_dir)).select("source", "id", F.round("fused", 9).alias("fused"), "rank")


REL = TB.RELATIONS_SQL


@query(f"with {REL}, p as (select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_partkey <> l_suppkey) select a, b from p where a % 4 <> 0 and not exists (select 1 from relations r where active and least(source, target) = a and greatest(source, target) = b)")
def unseen_pairs(spark, sf_dir):
    li = TB.read(spark, sf_dir, "lineitem")
    pairs = li.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    done = pairs.where(F.least("a", "b") % 4 == 0)
    return O.unseen_pairs(pairs, done, TB.relations(spark, sf_dir))


TERMS = "terms as (select distinct conv_id * 1000 + turn as id, unnest(" + "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')" + ") as term from conversations)"


@query(f"with {TERMS}, df as (select term, count(*) as df from terms group by 1), t as (select id, term, df, row_number() over (partition by id order by df, term) as mine, row_number() over (partition by term order by id) as post from terms join df using (term)), h as (select a.id as source, b.id as id, count(*) as hits from t a join t b using (term) where a.mine <= 16 and b.post <= 4 and a.id <> b.id group by 1, 2), r as (select *, row_number() over (partition by source order by hits desc, id) as k from h) select source, id, hits from r where k <= 32")
def rare_term_candidates(spark, sf_dir):
    c = TB.read(spark, sf_dir, "conversations")
    terms = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.explode(T.lexical_terms(F.col("text"))).alias("term"))
    return O.rare_term_candidates(terms, "id", "term")


@query("with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) select a.o_orderkey as source, b.o_orderkey as id from o a join o b on a.o_custkey = b.o_custkey and a.k <> b.k and abs(a.k - b.k) <= 12")
def time_neighbours(spark, sf_dir):
    return O.time_neighbours(TB.read(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", "o_custkey")


@query(f"with {REL} select source, target, kind, 'deactivate' as change from relations where active and source % 4 = 0 union all select source + 1000, target, kind, 'activate' from relations where active and source % 4 = 2")
def relation_diff(spark, sf_dir):
    r = TB.relations(spark, sf_dir)
    live = r.where("active")
    desired = live.where("source % 4 = 2").unionByName(live.where("source % 4 = 2").withColumn("source", F.col("source") + 1000))
    pairs = live.select(F.col("source").alias("a"), F.col("target").alias("b"))
    return O.relation_diff(desired, r, pairs)


FACTS = "facts as (select doc_id as id, case when doc_id % 3 = 0 then 'extracted' when doc_id % 3 = 1 then 'knowledge' else 'other' end as state, doc_id % 17 = 0 as archived, doc_id % 13 = 0 as sup, doc_id % 5 = 0 as dup, doc_id % 7 = 0 as promotes, lang, source, n_chars from documents)"


def _facts(spark, sf_dir):
    i = F.col("doc_id")
    return TB.read(spark, sf_dir, "documents").select(
        i.alias("id"), F.when(i % 3 == 0, "extracted").when(i % 3 == 1, "knowledge").otherwise("other").alias("state"), (i % 17 == 0).alias("archived"), F.when(i % 13 == 0, i).alias("superseded_by"),
        (i % 5 == 0).alias("has_duplicate"), (i % 7 == 0).alias("promotes"), F.concat("lang", "source").alias("component"), F.when(i % 4 != 0, F.col("n_chars")).alias("time"),
    )


@query(f"with {FACTS} select id, case when sup or (state = 'extracted' and dup) then state when promotes then 'canonical' when state = 'extracted' then 'knowledge' else state end as new_state, archived or sup or (state = 'extracted' and dup) as new_archived from facts")
def lifecycle_plan(spark, sf_dir):
    return O.lifecycle(_facts(spark, sf_dir))


@query("with f as (select lang || source as component, doc_id as id, case when doc_id % 3 = 0 then 2 when doc_id % 3 = 1 then 1 else 3 end as s, coalesce(case when doc_id % 4 <> 0 then n_chars end, 9223372036854775807) as t from documents where doc_id % 17 <> 0) select component, id as representative from (select *, row_number() over (partition by component order by s, t, id) as k from f) where k = 1")
def duplicate_representatives(spark, sf_dir):
    return O.representative(_facts(spark, sf_dir))


@query("with f as (select lang || source as component, doc_id as id, case when doc_id % 4 <> 0 then n_chars end as t from documents) select id as source, target from (select id, lag(id) over (partition by component order by t asc nulls last, id) as target from f) where target is not null")
def duplicate_chains(spark, sf_dir):
    return O.duplicate_chain(_facts(spark, sf_dir))


# entities


def _entities(spark, sf_dir):
    p = TB.read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.concat("p_brand", F.lit(" "), "p_type"), F.concat("p_name", F.lit(" x"))).alias("aliases"), F.when(F.col("p_size") % 10 == 0, "principal").otherwise(F.col("p_type")).alias("kind"))


ENT = "ent as (select p_partkey as id, p_name as name, case when p_size % 10 = 0 then 'principal' else p_type end as kind, p_brand || ' ' || p_type as a1, p_name || ' x' as a2 from part), claims as (select distinct id, kind, claim from (select id, kind, lower(trim(unnest([name, a1, a2]))) as claim from ent where kind <> 'principal') where claim <> '')"
_GEN = ", ".join(f"'{w}'" for w in T.GENERIC_TOKENS)


@query(f"with {ENT}, x as (select distinct l.id as a, r.id as b, true as exact, 65535 as score from claims l join claims r on l.claim = r.claim and l.kind = r.kind and l.id < r.id), tok as (select id, kind, list_filter(list_distinct(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+')), lambda x: strlen(x) >= 4 and x not in ({_GEN})) as t from ent where kind <> 'principal'), post as (select id, kind, t, unnest(t) as w from tok), ok as (select w from post group by 1 having count(*) <= 32), y as (select distinct l.id as a, r.id as b, cast(floor(len(list_intersect(l.t, r.t)) * 1000 / len(list_distinct(list_concat(l.t, r.t)))) as int) as score, len(list_intersect(l.t, r.t)) = least(len(l.t), len(r.t)) as inside from post l join post r on l.w = r.w and l.kind = r.kind and l.id < r.id where l.w in (select w from ok)), u as (select * from x union all select a, b, false, score from y where inside or score >= 330) select a, b, bool_or(exact) as exact, max(score) as score from u group by 1, 2")
def entity_reconciliation(spark, sf_dir):
    return E.reconciliation_pairs(_entities(spark, sf_dir), None)


@query("select proposal, entity, rank from (select b.p_partkey + 100000 as proposal, a.p_partkey as entity, row_number() over (partition by b.p_partkey order by a.p_partkey) as rank from part a join part b on a.p_name = b.p_name and (case when a.p_size % 10 = 0 then 'principal' else a.p_type end) = (case when b.p_size % 10 = 0 then 'principal' else b.p_type end)) where rank <= 8")
def entity_creation_conflicts(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return E.creation_conflicts(e, e.select((F.col("id") + 100000).alias("id"), "name", "kind"))


@query("select mention_id, entity, how, rank from (select b.p_partkey as mention_id, a.p_partkey as entity, 1 as how, row_number() over (partition by b.p_partkey order by a.p_partkey) as rank from part a join part b on a.p_name = b.p_name) where rank <= 8")
def mention_candidates(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return E.mention_candidates(e.select(F.col("id").alias("mention_id"), F.upper("name").alias("surface")), e)


@query("select l_partkey as entity, bool_or(l_quantity > 45) as exact, count(*) filter (l_discount > 0) as lexical_hits, count(*) filter (l_linenumber = 1) as graph_hits, max(l_discount) as best_lexical, array_to_string(list_sort(list(distinct l_orderkey))[1:8], ',') as supporting from lineitem group by 1")
def entity_evidence_rollup(spark, sf_dir):
    li = TB.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), (F.col("l_quantity") > 45).alias("exact"), F.col("l_discount").alias("lexical"), (F.col("l_linenumber") == 1).alias("in_graph"), F.col("l_orderkey").alias("memory"))
    return E.evidence_rollup(li).withColumn("supporting", F.array_join(F.transform("supporting", lambda x: x.cast("string")), ","))


@query("select l_orderkey, l_linenumber, l_quantity / 50 >= 0.95 and l_quantity / 50 - l_discount >= 0.15 and l_linenumber <= 2 as accepted, case when l_returnflag = 'A' then case when l_linestatus = 'F' and l_tax > 0.02 then 'accept' when l_linestatus = 'O' then 'create' else 'unresolved' end when l_returnflag = 'N' then case when l_linestatus = 'F' then 'unresolved' else 'create' end else 'reject' end as verdict from lineitem")
def entity_judgments(spark, sf_dir):
    li = TB.read(spark, sf_dir, "lineitem")
    choice = F.when(F.col("l_returnflag") == "A", "candidate").when(F.col("l_returnflag") == "N", "create").otherwise("reject")
    relation = F.when(F.col("l_linestatus") == "F", "same").otherwise("related")
    return li.select("l_orderkey", "l_linenumber", E.fast_path(F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_linenumber") <= 2).alias("accepted"), E.judgment(choice, relation, F.col("l_tax") > 0.02).alias("verdict"))


#: Made mentions: surface, context, kind, summary, recurrences, and the verdict.
MENTIONS = (
    ("The Tool", "we use it", "other", "a thing", 3, "generic_role"), ("release-7", "on branch release-7 today", "other", "a thing", 3, "transient_value"), ("commit 4f3a9bc1", "it broke", "other", "a thing", 3, "transient_value"),
    ("4f3a9bc1", "the rollback of it", "other", "a thing", 3, "transient_value"), ("build #1042", "it broke", "other", "a thing", 3, "transient_value"), ("run id: ab12cd", "it broke", "other", "a thing", 3, "transient_value"),
    ("parseTree", "in the code", "code_symbol", "a function", 1, "recurrence_required"), ("parseTree", "in the code", "code_symbol", "a function", 2, None), ("falcon", "it runs", "service", "A temporary branch of work", 3, "transient_value"),
    ("falcon", "it runs", "other", "A broad concept of birds", 3, "wrapper_category"), ("falcon", "it runs", "service", "A broad concept of birds", 3, None), ("falcon", "it runs", "other", "the service that sends mail", 0, None),
)
_MENTIONS = ", ".join(f"({i}, {'null' if m[5] is None else repr(m[5])})" for i, m in enumerate(MENTIONS))


@query(f"select p_partkey, v as verdict from part join (values {_MENTIONS}) t(i, v) on i = p_partkey % {len(MENTIONS)}")
def entity_admission(spark, sf_dir):
    m = spark.createDataFrame([(i, *m[:5]) for i, m in enumerate(MENTIONS)], "i long, surface string, context string, kind string, summary string, n int")
    p = TB.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(MENTIONS)).alias("i"))
    verdict = E.admission(F.col("surface"), F.col("context"), F.col("kind"), F.col("summary"), F.col("n"))
    return p.join(F.broadcast(m), "i").select("p_partkey", verdict.alias("verdict"))


# queues and feeds

WORK = "work as (select user_id * 10 + event_id % 10 as item, event_id as revision, case when event_type = 'click' then 'failed' when event_type = 'purchase' then 'complete' when event_id % 3 = 0 then 'processing' else 'pending' end as state, event_id % 5 as priority, event_id % 1000 as retry_at, event_id % 700 as lease_until, user_id as conversation, event_id as source_through, event_id as start from events)"


def _work(spark, sf_dir):
    e, i = TB.read(spark, sf_dir, "events"), F.col("event_id")
    state = F.when(F.col("event_type") == "click", "failed").when(F.col("event_type") == "purchase", "complete").when(i % 3 == 0, "processing").otherwise("pending")
    return e.select((F.col("user_id") * 10 + i % 10).alias("item"), i.alias("revision"), state.alias("state"), (i % 5).alias("priority"), (i % 1000).alias("retry_at"), (i % 700).alias("lease_until"), F.col("user_id").alias("conversation"), i.alias("source_through"), i.alias("start"))


_LATEST_WORK = WORK + ", l as (select * from (select *, row_number() over (partition by item order by revision desc) as k from work) where k = 1)"


@query(f"with {_LATEST_WORK} select item, state from l where state = 'pending' or (state = 'failed' and retry_at <= 500) or (state = 'processing' and lease_until <= 500) order by priority, source_through, conversation, start, item limit 25")
def queue_claims(spark, sf_dir):
    return QU.claim(_work(spark, sf_dir), 500, 25).select("item", "state")


@query(f"with {_LATEST_WORK} select count(*) filter (state = 'pending') as n_pending, count(*) filter (state = 'processing') as n_processing, count(*) filter (state = 'held') as n_held, count(*) filter (state = 'failed') as n_failed, count(*) filter (state = 'complete') as n_complete, count(*) as n from l")
def work_progress(spark, sf_dir):
    return QU.progress(_work(spark, sf_dir))


@query(f"with {_LATEST_WORK} select item, revision + 1 as revision, 'held' as state from l where item % 2 = 0")
def work_transitions(spark, sf_dir):
    w = _work(spark, sf_dir)
    now = VR.latest(w, ["item"], "revision")
    asked = now.select("item", F.when(F.col("item") % 2 == 0, F.col("revision")).otherwise(F.col("revision") - 1).alias("expected"), F.lit("held").alias("new_state"))
    return QU.transition(w, asked)


CHG = "chg as (select event_id + 1 as sequence, case when event_id % 50 = 0 then 'delete' when event_id % 7 = 0 then 'visibility' else 'upsert' end as kind, user_id as conversation, event_id % 20 as message, event_type as hash, event_id % 2 = 0 as visible from events)"


def _changes(spark, sf_dir):
    e, i = TB.read(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(i % 50 == 0, "delete").when(i % 7 == 0, "visibility").otherwise("upsert")
    return e.select((i + 1).alias("sequence"), kind.alias("kind"), F.col("user_id").alias("conversation"), (i % 20).alias("message"), F.col("event_type").alias("hash"), (i % 2 == 0).alias("visible"))


FEED_SQL = f"with {CHG}, d as (select conversation, max(sequence) as dead from chg where kind = 'delete' group by 1), n as (select conversation, message, max(sequence) as sequence, arg_max(hash, sequence) as hash, arg_max(visible, sequence) as visible from chg where kind = 'upsert' group by 1, 2), v as (select conversation, message, max(sequence) as vs, arg_max(visible, sequence) as vis from chg where kind = 'visibility' group by 1, 2) select n.conversation, n.message, n.sequence, n.hash, case when vs > n.sequence then vis else n.visible end as visible from n left join d using (conversation) left join v using (conversation, message) where dead is null or n.sequence > dead"


@query(FEED_SQL)
def change_feed(spark, sf_dir):
    empty = _changes(spark, sf_dir).where("false")
    return QU.apply_changes(empty, _changes(spark, sf_dir))


@query("select count(*) as n, case when min(event_id) = 0 or min(event_id) = 1 then 'apply' else 'gap' end as verdict from events")
def feed_contiguity(spark, sf_dir):
    c = _changes(spark, sf_dir)
    low = TB.read(spark, sf_dir, "events").agg(F.min("event_id")).first()[0]
    return QU.contiguous(c, low, 0)


@query("select c_custkey as subscriber, case when c > t then 'error' when c + 1 < 500 then 'resync_required' when c = t then 'up_to_date' when t - c > 64 then 'resync_required' else 'deliver' end as verdict, case when not c > t and not c + 1 < 500 and c <> t and t - c <= 64 then c + 1 end as next from (select c_custkey, c_custkey * 7 as c, (select max(event_id) from events) as t from customer)")
def cursor_delivery(spark, sf_dir):
    log = TB.read(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), F.lit(10).alias("bytes"))
    cursors = TB.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subscriber"), (F.col("c_custkey") * 7).alias("cursor"))
    return QU.deliver(log, cursors, 500)


@query("select user_id, b + 1 as \"from\", event_id - 1 as \"to\" from (select user_id, event_id, lag(event_id) over (partition by user_id order by event_id) as b from events) where event_id > b + 1")
def delivery_gaps(spark, sf_dir):
    return QU.gaps(TB.read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("sequence")), "user_id")


@query("with recursive e as (select user_id as memory_id, event_id as position, case when event_type = 'purchase' then 50 when event_type = 'click' then 25 else 5 end as amount, row_number() over (partition by user_id order by event_id) as k, min(event_id) over (partition by user_id) as admitted from events), f as (select memory_id, k, position, admitted, least(100 + amount, 100) as score from e where k = 1 union all select e.memory_id, e.k, e.position, e.admitted, least(greatest(f.score - (floor((e.position - e.admitted) / 10.0) - floor((f.position - e.admitted) / 10.0)), -100) + e.amount, 100) from f join e on e.memory_id = f.memory_id and e.k = f.k + 1), l as (select memory_id, max(k) as k from e group by 1) select f.memory_id, cast(f.score as int) as score, f.position from f join l using (memory_id, k)")
def streaming_freshness(spark, sf_dir):
    """Keyed state over a stream of the events file; the last row by key."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    amount = F.when(F.col("event_type") == "purchase", 50).when(F.col("event_type") == "click", 25).otherwise(5)
    events = e.select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("position"), "event_id", amount.alias("amount"))
    rows = feeds.run_to_table(feeds.freshness_state(events), "streaming_freshness", "update")
    return VR.latest(rows, ["memory_id"], "position").select("memory_id", "score", "position")


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def streaming_deduplicated(spark, sf_dir):
    """Every event twice through a deduplicating stream, then summed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "event_type", "value")
    once = feeds.deduplicated(e.unionByName(e), ["event_id"])
    return feeds.run_to_table(once, "streaming_deduplicated").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# context


@query("with s as (select conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '\\S+')) as tokens from conversations), w as (select *, sum(tokens) over (partition by conv_id order by turn) as up, sum(tokens) over (partition by conv_id order by turn desc) as down, max(turn) over (partition by conv_id) as last from s) select conv_id, turn, tokens, case when turn = last or down <= 100 then 'tail' when up <= 150 then 'compact' else 'wait' end as part from w")
def compaction_plan(spark, sf_dir):
    return C.compaction_plan(TB.read(spark, sf_dir, "conversations"), 100, 150)


@query("with s as (select conv_id, turn, strlen(text) as bytes, row_number() over (partition by conv_id order by turn) as n, sum(strlen(text)) over (partition by conv_id order by turn) as b from conversations) select conv_id, turn, bytes from s where n <= 64 and b <= 500")
def context_assembly(spark, sf_dir):
    items = TB.read(spark, sf_dir, "conversations").withColumn("position", F.col("turn"))
    return C.assemble(items, 64, 500).select("conv_id", "turn", "bytes")


@query("select conv_id, string_agg('[' || role || ' round=' || turn || ']' || chr(10) || text, chr(10) order by turn) as evidence from conversations group by 1")
def rendered_evidence(spark, sf_dir):
    c = TB.read(spark, sf_dir, "conversations")
    return C.render_evidence(c.select("conv_id", F.col("turn").alias("position"), F.col("role").alias("label"), F.col("turn").alias("round"), F.lit(None).cast("string").alias("name"), "text"))


@query("select conv_id, turn, regexp_extract(trim(text), '^(\\S+(\\s+\\S+){0,4})', 1) as summary from conversations")
def trimmed_summaries(spark, sf_dir):
    return TB.read(spark, sf_dir, "conversations").select("conv_id", "turn", C.trim_summary(F.col("text"), 5).alias("summary"))


# statistics


@query("select count(*) as turns, count(distinct conv_id) as conversations, max(turn) as last_turn, sum(strlen(coalesce(text, ''))) as bytes from conversations")
def owner_statistics(spark, sf_dir):
    return TB.read(spark, sf_dir, "conversations").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))


@query("select label, count(*) as rows, sum(len(embedding)) * 4 as bytes from embeddings group by 1")
def vector_statistics(spark, sf_dir):
    return TB.read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("rows"), (F.sum(F.size("embedding")) * 4).alias("bytes"))


@query("select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def vector_coverage(spark, sf_dir):
    v = TB.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return TB.read(spark, sf_dir, "documents").join(v, "doc_id", "left_anti").select("doc_id")


@query("select o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, '|' order by o_orderkey)) as digest from orders group by 1")
def chained_digest(spark, sf_dir):
    o = TB.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), "o_orderstatus").alias("t"))
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "t"))).alias("x"))
    return rows.select("o_custkey", F.sha2(F.array_join(F.transform("x", lambda s: s["t"]), "|").cast("binary"), 256).alias("digest"))


# temporal


@query("select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(\\d{4}-\\d\\d-\\d\\d)\\b', 1))), ',') as days from (select event_id as doc_id, 'noted on ' || strftime(ts, '%Y-%m-%d') || ' and on ' || strftime(ts + interval 3 day, '%Y-%m-%d') as text from events)")
def iso_days(spark, sf_dir):
    e = TB.read(spark, sf_dir, "events")
    text = F.concat(F.lit("noted on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" and on "), F.date_format(F.col("ts") + F.expr("interval 3 days"), "yyyy-MM-dd"))
    days = F.array_sort(F.array_distinct(TP.iso_days(text)))
    return e.select(F.col("event_id").alias("doc_id"), F.array_join(F.transform(days, lambda d: F.date_from_unix_date(d).cast("string")), ",").alias("days"))


@query("select event_id as doc_id, 'day' as kind, epoch_ns(date_trunc('day', ts)) as \"start\", epoch_ns(date_trunc('day', ts)) + 86400000000000 as \"end\" from events union all select event_id, 'day', epoch_ns(date_trunc('day', ts)) - 86400000000000, epoch_ns(date_trunc('day', ts)) from events")
def temporal_parse(spark, sf_dir):
    """Anchors of generated sentences: an ISO date, and a word relative to it."""
    e = TB.read(spark, sf_dir, "events")
    text = F.concat(F.lit("On "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" we met; it began yesterday."))
    ref = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select(F.col("event_id").alias("doc_id"), F.explode(TP.analyse(text, ref)["anchors"]).alias("a")).select("doc_id", "a.kind", "a.start", "a.end")


SPANS = "m as (select o_orderkey as id, epoch_ns(date_trunc('day', o_orderdate)) as s, epoch_ns(date_trunc('day', o_orderdate)) + 86400000000000 * (1 + o_orderkey % 20) as e from orders), q as (select o_orderkey as id, epoch_ns(date_trunc('day', o_orderdate)) as s, epoch_ns(date_trunc('day', o_orderdate)) + 86400000000000 as e from orders where o_orderkey % 20 = 0)"


@query(f"with {SPANS} select q.id as query_id, m.id as memory_id, (case when q.s = m.s and q.e = m.e then 0.98 else 0.75 end)::double as score from q join m on q.s < m.e and m.s < q.e")
def temporal_match(spark, sf_dir):
    day = lambda c: F.unix_micros(F.date_trunc("day", F.col(c).cast("timestamp"))) * 1000
    o = TB.read(spark, sf_dir, "orders")
    e = o.where("o_orderkey % 20 = 0")
    m = o.select(F.col("o_orderkey").alias("memory_id"), F.lit(0).alias("place"), F.lit("day").alias("kind"), day("o_orderdate").alias("start"), (day("o_orderdate") + TP.DAY * (1 + F.col("o_orderkey") % 20)).alias("end"))
    q = e.select(F.col("o_orderkey").alias("query_id"), F.lit(0).alias("place"), F.lit("day").alias("kind"), day("o_orderdate").alias("start"), (day("o_orderdate") + TP.DAY).alias("end"))
    return TP.match(q, m)


# sources


@query("select conv_id, turn, role from conversations where role in ('user', 'assistant') and turn < 4")
def chat_export(spark, sf_dir):
    """Conversations written as an export of node trees and read back in a half-open time window."""
    c = TB.read(spark, sf_dir, "conversations")
    node = F.struct(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.when(F.col("turn") > 0, F.concat_ws(":", "conv_id", F.col("turn") - 1)).alias("parent"),
        F.struct(F.struct("role").alias("author"), F.col("turn").cast("double").alias("create_time"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content")).alias("message"),
    )
    trees = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "conv_id", "turn"), node))).alias("mapping")).select(F.col("conv_id").cast("string").alias("conversation_id"), "mapping")
    path = feeds.scratch(spark, "export")
    trees.write.mode("overwrite").json(path)
    raw = spark.read.schema(S.EXPORT).json(path)
    nodes = raw.select(F.col("conversation_id").alias("conv_id"), "current_node", F.explode("mapping").alias("node_id", "node")).select("conv_id", "current_node", "node_id", F.col("node.parent").alias("parent_id"), F.col("node.message").alias("m"))
    turns, _ = S.plan_import(nodes, 0, 4 * 1_000_000_000)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.split("node_id", ":")[1].cast("long").alias("turn"), "role")


@query("select conv_id * 1000 + turn as message, case when turn % 5 = 0 then 'missing' when turn % 3 = 0 then 'mismatch' else 'ok' end as status from conversations")
def external_hydration(spark, sf_dir):
    c = TB.read(spark, sf_dir, "conversations")
    d = c.select(F.col("conv_id").alias("conversation"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.octet_length("text").alias("bytes"))
    t = c.where("turn % 5 <> 0").select(F.col("conv_id").alias("conversation"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message"), F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return S.hydrate(d, t).select("message", "status")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) as ordinal from conversations")
def historical_timeline(spark, sf_dir):
    c = TB.read(spark, sf_dir, "conversations")
    n = c.select("conv_id", "turn", F.col("turn").cast("string").alias("node_id"), (F.col("turn") * 10).alias("timestamp_ns"), F.col("turn").alias("depth"))
    return S.timeline(n).select("conv_id", F.col("node_id").cast("long").alias("turn"), "ordinal")
