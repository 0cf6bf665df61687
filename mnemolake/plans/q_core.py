"""Queries of text, archive, versioned state, retrieval, graph and freshness operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import archive as A
from ..operators import freshness as FR
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import versioned as VR
from . import tables as TB
from .registry import query

QUERY = ("the", "stupid", "of", "clown", "heat")
TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_LEX_PARTS = [
    f"case when list_contains(tok, '{t}') then cast((length(low) - length(replace(low, '{t}', ''))) / {len(t)} as int) else 0 end" for t in QUERY
]
_LEX = (
    "0.85 * (" + " + ".join(f"(case when c{i} > 0 then 1 else 0 end)" for i in range(len(QUERY))) + f") / {len(QUERY)}.0 + 0.15 * least(("
    + " + ".join(f"least(c{i}, 4)" for i in range(len(QUERY))) + f") / {2.0 * len(QUERY)}, 1.0)"
)
LEX_SQL = (
    f"t as (select doc_id, lower(coalesce(text, '')) as low, {TOK.format('text')} as tok from documents), "
    "c as (select doc_id, " + ", ".join(f"{p} as c{i}" for i, p in enumerate(_LEX_PARTS)) + " from t), "
    f"lex as (select doc_id, {_LEX} as score from c)"
)


@query(f"with {LEX_SQL} select doc_id, round(score, 9) as score from lex where score > 0 order by score desc, doc_id limit 10")
def lexical_search(spark, sf_dir):
    docs = TB.read(spark, sf_dir, "documents")
    return R.lexical_search(docs, QUERY, F.col("text"), "doc_id").withColumn("score", F.round("score", 9))


@query(f"with {LEX_SQL} select doc_id, round(score, 9) as score from lex where score > 0")
def lexical_matches_all(spark, sf_dir):
    return R.lexical_search(TB.read(spark, sf_dir, "documents"), QUERY, F.col("text"), "doc_id", None).withColumn("score", F.round("score", 9))


@query(f"select doc_id, len(list_distinct(tok)) as n_terms, array_to_string(list_sort(list_distinct(tok)), ' ') as terms from (select doc_id, {TOK.format('text')} as tok from documents)")
def lexical_terms(spark, sf_dir):
    t = T.lexical_terms(F.col("text"))
    return TB.read(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_terms"), F.array_join(F.array_sort(t), " ").alias("terms"))


@query("select doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(tok, lambda x: true)[1:8], lambda x: sha256(x)))), ',') as hashes from (select doc_id, list_filter(tok, lambda x, i: list_position(tok, x) = i) as tok from (select conv_id * 1000 + turn as doc_id, " + TOK.format("text") + " as tok from conversations))")
def term_hashes(spark, sf_dir):
    c = TB.read(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.array_join(T.term_hashes(F.col("text"), 8), ",").alias("hashes"))


NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"select conv_id, turn, {NORM.format('text')} as normal, len(list_filter(string_split({NORM.format('text')}, ' '), lambda x: x <> '' and x not in ({_STOP}))) as informative from conversations")
def policy_text(spark, sf_dir):
    c = TB.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.normalize(F.col("text")).alias("normal"), T.informative_tokens(F.col("text")).alias("informative"))


@query("select conv_id, turn, trim(text) like '%?' as asks from (select conv_id, turn, case when turn % 3 = 0 then regexp_replace(text, '[.!\\s]+', ' ', 'g') || '?' else text end as text from conversations) where trim(text) like '%?' and not left(trim(text), length(trim(text)) - 1) like '%. %' and not left(trim(text), length(trim(text)) - 1) like '%! %' and not regexp_matches(' ' || " + NORM.format("text") + " || ' ', ' (have to|has to|must|will|i prefer|i don''t want|i do not want) ')")
def unsupported_questions(spark, sf_dir):
    """Every third turn ends as a question."""
    c = TB.read(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat(F.regexp_replace("text", "[.!\\s]+", " "), F.lit("?"))).otherwise(F.col("text")))
    return c.where(T.unsupported_question(F.col("text"), F.lit("preference"))).select("conv_id", "turn", F.lit(True).alias("asks"))


#: Made quotes, one for each rule and some for none, and what the policy says of each as a direct and an adopted memory.
QUOTES = (
    ("I prefer dark mode in the editor", None), ("sounds good", "vague authority"), ("do that then please", "vague authority"), ("is the cache large enough?", "question"),
    ("it must be faster, right?", None), ("the tests passed and the branch merged", "execution receipt"), ("the service uses redis for tests that passed", None), ("remember the plan we discussed earlier", None),
)
_QUOTES = ", ".join(f"({i}, {'null' if r is None else repr(r)})" for i, (_, r) in enumerate(QUOTES))


@query(f"select p_partkey, case when p_partkey % 3 = 1 then 'authority source not allowed' when p_partkey % 3 = 2 then 'adoption needs an authority source' else r end as rejection from part join (values {_QUOTES}) t(i, r) on i = p_partkey % {len(QUOTES)}")
def candidate_authority_policy(spark, sf_dir):
    k = F.col("p_partkey")
    quote = F.element_at(F.array(*[F.lit(q) for q, _ in QUOTES]), (k % len(QUOTES) + 1).cast("int"))
    kind = F.when(k % 3 == 2, "adoption").otherwise("direct")
    content = F.when(quote.isin("sounds good", "do that then please"), "the nightly backup copies five databases elsewhere").otherwise(quote)
    reason = T.authority_rejection(kind, F.lit("fact"), F.lit("a title"), quote, content, k % 3 == 1, F.lit(False))
    return TB.read(spark, sf_dir, "part").select("p_partkey", reason.alias("rejection"))


@query("select p_partkey, lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) as surface, replace(lower(trim(p_type)), '-', '_') as label, lower(hex(p_brand)) as hex, trim(p_name) <> '' and strlen(p_name) <= 512 as valid from part")
def surface_keys(spark, sf_dir):
    p = TB.read(spark, sf_dir, "part")
    return p.select("p_partkey", T.surface_key(F.col("p_name")).alias("surface"), T.canonical_label(F.col("p_type")).alias("label"), T.hex_of(F.col("p_brand")).alias("hex"), T.valid_identifier(F.col("p_name")).alias("valid"))


@query("select p_partkey, array_to_string(list_sort(list_distinct([b || n || 'module', b || n, substr(b, 6) || n || 'module', n || 'module', n])), ',') as keys from (select p_partkey, replace(lower(p_brand), '#', '') as b, replace(p_name, ' ', '') as n from part)")
def identity_guard_keys(spark, sf_dir):
    p = TB.read(spark, sf_dir, "part")
    keys = T.guard_keys(F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit("Module")), ["brand"])
    return p.select("p_partkey", F.array_join(keys, ",").alias("keys"))


@query("select conv_id, turn, substr(text, 3, 4) <> '' and turn % 2 = 0 as ok from conversations")
def mention_spans(spark, sf_dir):
    """A mention of the third to sixth character of each turn, in odd turns one byte off."""
    c = TB.read(spark, sf_dir, "conversations")
    surface, start = F.substring("text", 3, 4), F.octet_length(F.substring("text", 1, 2))
    ok = T.span_matches(F.col("text"), start, start + F.octet_length(surface), surface) & (F.col("turn") % 2 == 0)
    return c.select("conv_id", "turn", F.coalesce(ok, F.lit(False)).alias("ok"))


@query("with d as (select doc_id, lang, source, list_filter(list_distinct(" + TOK.format("text") + "), lambda x: strlen(x) > 1) as tok from documents), p as (select a.doc_id as a, b.doc_id as b, a.tok as x, b.tok as y, a.lang = b.lang as l, a.source = b.source as s from d a join d b on b.doc_id = a.doc_id + 1) select a, b, round((case when len(list_distinct(list_concat(x, y))) > 0 then len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) else 0 end) + (case when l then 0.08 else 0 end) + (case when s then 0.08 else 0 end), 9) as score from p")
def pair_lexical_score(spark, sf_dir):
    d = TB.read(spark, sf_dir, "documents").select("doc_id", "lang", "source", T.long_tokens(F.col("text")).alias("tok"))
    a, b = d.alias("a"), d.alias("b")
    p = a.join(b, F.col("b.doc_id") == F.col("a.doc_id") + 1)
    same = F.when(F.col("a.lang") == F.col("b.lang"), 0.08).otherwise(0.0) + F.when(F.col("a.source") == F.col("b.source"), 0.08).otherwise(0.0)
    return p.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.round(T.jaccard(F.col("a.tok"), F.col("b.tok")) + same, 9).alias("score"))


# archive

TURNS_SQL = "turns as (select conv_id, turn, role, text, conv_id || ':' || turn as node_id, conv_id || ':' || lag(turn) over (partition by conv_id order by turn) as parent_id, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from conversations)"


def _turns(spark, sf_dir):
    return A.turns(TB.read(spark, sf_dir, "conversations"))


@query("select conv_id, turn, case when role in ('user', 'assistant') then sum(case when role in ('user', 'assistant') then 1 else 0 end) over (order by conv_id, turn) end as activity_position from conversations")
def activity_positions(spark, sf_dir):
    return A.activity_positions(_turns(spark, sf_dir), ["turn"]).select("conv_id", "turn", "activity_position")


@query(f"with {TURNS_SQL}, w as (select conv_id, n, unnest(list_distinct(list_concat(case when n >= 8 then range(0, n - 7, 6) else []::bigint[] end, [greatest(n - 8, 0)]))) as a from (select distinct conv_id, n from turns)) select w.conv_id, s.node_id as start_node, e.node_id as end_node, sha256(w.conv_id || chr(0) || s.node_id || chr(0) || e.node_id || chr(0)) as fragment_id from w join turns s on s.conv_id = w.conv_id and s.i = w.a join turns e on e.conv_id = w.conv_id and e.i = least(w.a + 8, w.n) - 1")
def fragment_windows(spark, sf_dir):
    return A.fragments(_turns(spark, sf_dir))


@query("with recursive f as (select conv_id, turn, strlen(coalesce(text, '')) as size, row_number() over (partition by conv_id order by turn) as k from conversations), g as (select conv_id, turn, k, 0 as seg, 1 as n, size as b from f where k = 1 union all select f.conv_id, f.turn, f.k, case when g.n >= 24 or (g.b > 0 and g.b + f.size > 24000) then g.seg + 1 else g.seg end, case when g.n >= 24 or (g.b > 0 and g.b + f.size > 24000) then 1 else g.n + 1 end, case when g.n >= 24 or (g.b > 0 and g.b + f.size > 24000) then f.size else g.b + f.size end from g join f on f.conv_id = g.conv_id and f.k = g.k + 1) select conv_id, seg as segment, min(turn) as first_turn, max(turn) as last_turn, count(*) as n_turns from g group by 1, 2")
def packed_segments(spark, sf_dir):
    return A.pack_segments(_turns(spark, sf_dir))


@query("select conv_id, turn, 0 as covered from conversations where conv_id % 5 = 0")
def segment_validation(spark, sf_dir):
    """The segments of every fifth conversation are missing."""
    t = _turns(spark, sf_dir)
    return A.segment_errors(t, A.pack_segments(t).where("conv_id % 5 > 0")).select("conv_id", "turn", F.col("covered").cast("int").alias("covered"))


@query(f"with {TURNS_SQL} select conv_id || ':' || max(turn) over (partition by conv_id) as leaf, node_id, i as depth from turns")
def branch_paths(spark, sf_dir):
    t = _turns(spark, sf_dir)
    leaves = t.groupBy("conv_id").agg(F.max("turn").alias("m")).select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("m").cast("string")).alias("leaf"))
    return A.branch_path(t, leaves)


@query("with s as (select *, row_number() over (order by conv_id, turn) as rn, sum(strlen(coalesce(text, ''))) over (order by conv_id, turn) as b from conversations), h as (select conv_id, turn, role, row_number() over (order by rn) as k, sum(strlen(text)) over (order by rn) as o from s where rn <= 4096 and b <= 1048576 and contains(lower(text), 'the')) select conv_id, turn, role, (select count(*) from h) > 5 or (select max(rn) from s) > 4096 or (select max(b) from s) > 1048576 as truncated from h where k <= 5 and o <= 131072")
def archive_search(spark, sf_dir):
    return A.bounded_search(_turns(spark, sf_dir), "the")


@query("select conv_id, turn, role, conv_id || ':' || turn as node_id from conversations where conv_id = 1 order by turn limit 5 offset 1")
def transcript_page(spark, sf_dir):
    return A.transcript_page(_turns(spark, sf_dir), 1, 1, 5)


@query("select conv_id, turn, text from conversations where conv_id = 2 and turn between 0 and 3")
def conversation_range(spark, sf_dir):
    return A.turn_range(_turns(spark, sf_dir), 2, 0, 3).select("conv_id", "turn", "text")


# versioned state

REV = "rev as (select user_id as memory_id, event_id as version, event_type, round(value, 6) as value from events), tomb as (select memory_id, max(version) as version from rev where memory_id % 7 = 0 group by 1)"


@query(f"with {REV} select memory_id, max(version) as version, arg_max(event_type, version) as event_type, arg_max(value, version) as value from rev group by 1")
def latest_state(spark, sf_dir):
    return VR.latest(TB.revisions(spark, sf_dir), ["memory_id"], "version").select("memory_id", "version", "event_type", "value")


@query(f"with {REV} select memory_id, max(version) as version, arg_max(event_type, version) as event_type, arg_max(value, version) as value from rev where version <= 9000 and memory_id not in (select memory_id from tomb where version <= 9000) group by 1")
def as_of_cut(spark, sf_dir):
    return VR.as_of(TB.revisions(spark, sf_dir), ["memory_id"], "version", 9000, TB.tombstones(spark, sf_dir)).select("memory_id", "version", "event_type", "value")


@query(f"with {REV}, k as (select memory_id, max(case when version <= 100 then 1 end) as seen, arg_max(event_type, version) filter (where version <= 100) as body from rev group by 1) select memory_id, case when memory_id in (select memory_id from tomb where version <= 100) then 'tombstoned' when seen is null then 'unavailable' when body not in ('click', 'view') then 'absent' else 'available' end as status from k")
def history_status(spark, sf_dir):
    r = TB.revisions(spark, sf_dir)
    bodies = r.select("event_type").where("event_type in ('click', 'view')").distinct()
    return VR.history_status(r, bodies, TB.tombstones(spark, sf_dir), "memory_id", "version", "event_type", 100)


MEM = "mem as (select doc_id as memory_id, case when doc_id % 3 = 0 then 'canonical' when doc_id % 3 = 1 then 'knowledge' else 'extracted' end as state, doc_id % 11 = 0 as archived, case when doc_id % 13 = 0 then doc_id + 1 end as superseded_by, doc_id as created, doc_id + 10 as updated, case when doc_id % 5 <> 0 then doc_id * 2 end as source_time, cast(doc_id % 200 as int) - 100 as freshness from documents)"


def _memories(spark, sf_dir):
    i = F.col("doc_id")
    return TB.read(spark, sf_dir, "documents").select(
        i.alias("memory_id"), F.when(i % 3 == 0, "canonical").when(i % 3 == 1, "knowledge").otherwise("extracted").alias("state"), (i % 11 == 0).alias("archived"),
        F.when(i % 13 == 0, i + 1).alias("superseded_by"), i.alias("created"), (i + 10).alias("updated"), F.when(i % 5 != 0, i * 2).alias("source_time"), ((i % 200).cast("int") - 100).alias("freshness"),
    )


@query(f"with {MEM} select memory_id, state, freshness from mem where state in ('canonical', 'knowledge') and not archived and superseded_by is null and created >= 10 and updated < 900 and source_time >= 50 and source_time < 1500 and freshness >= -50 and memory_id not in (12, 13)")
def rewrite_row_filter(spark, sf_dir):
    found = VR.rewrite_filter(_memories(spark, sf_dir), exclude=[12, 13], states=["canonical", "knowledge"], archived=False, superseded=False, created=(10, None), updated=(None, 900), source_time=(50, 1500), min_freshness=-50)
    return found.select("memory_id", "state", "freshness")


@query(f"with {REV} select memory_id, version from rev where version >= 9900")
def revision_filter(spark, sf_dir):
    return VR.revision_filter(TB.revisions(spark, sf_dir), "memory_id", "version", "version", "since", 9900).select("memory_id", "version")


@query("select 'conflict' as outcome, count(*) as n from customer where c_custkey % 3 > 0 and c_custkey % 10 = 0 union all select 'appended', count(*) from customer where c_custkey % 3 = 0")
def idempotent_insert(spark, sf_dir):
    c = TB.read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    stored = c.where("c_custkey % 3 > 0").withColumn("v", F.col("c_custkey"))
    batch = c.withColumn("c_name", F.when((F.col("c_custkey") % 10 == 0) & (F.col("c_custkey") % 3 > 0), F.lit("other")).otherwise(F.col("c_name")))
    fresh, conflicts = VR.insert_once(stored, batch, ["c_custkey"], "v")
    return conflicts.agg(F.lit("conflict").alias("outcome"), F.count("*").alias("n")).union(fresh.agg(F.lit("appended"), F.count("*")))


@query("select c_custkey as k, c_custkey as mutation_id, case when c_custkey % 4 <> c_custkey % 3 then 'stale' else 'applied' end as verdict, case when c_custkey % 4 = c_custkey % 3 then c_custkey % 3 + 1 end as new_revision from customer")
def optimistic_publish(spark, sf_dir):
    c = TB.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    now = c.select("k", (F.col("k") % 3).alias("revision")).where("revision > 0")
    asked = c.select("k", F.col("k").alias("mutation_id"), (F.col("k") % 4).alias("expected"))
    return VR.publish(now, asked, "k", "revision")


@query("select p_partkey as body, case when p_partkey % 6 = 0 then null else p_name end as p_name, p_partkey % 6 = 0 as pruned from part")
def guarded_prune(spark, sf_dir):
    p = TB.read(spark, sf_dir, "part")
    bodies = p.select(F.col("p_partkey").alias("body"), "p_name")
    refs = p.select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("body"))
    return VR.prune(bodies, refs, refs.select("k").where("k % 2 = 0"), refs.select("k").where("k % 3 = 0"), "k", "body")


@query("select p_partkey from part where p_partkey in (select l_partkey from lineitem)")
def reclaim_orphans(spark, sf_dir):
    refs = TB.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return VR.reclaim(TB.read(spark, sf_dir, "part"), refs, "p_partkey").select("p_partkey")


@query("select count(*) as n_left, count(*) - 100 as n_right, 500 as common_prefix, 'diverged' as relation from orders")
def divergent_histories(spark, sf_dir):
    o = TB.read(spark, sf_dir, "orders")
    ranked = VR.with_versions(o.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], "ordinal").select("ordinal", F.concat(F.col("o_orderkey").cast("string"), F.lit("x")).alias("digest"))
    n = o.count()
    other = ranked.where(F.col("ordinal") <= n - 100).withColumn("digest", F.when(F.col("ordinal") <= 500, F.col("digest")).otherwise(F.lit("changed")))
    return VR.reconcile(ranked, other, "ordinal", "digest")


@query("select c_custkey, c_name from customer where c_custkey > 100 order by c_custkey limit 20")
def keyset_page(spark, sf_dir):
    return VR.keyset_page(TB.read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 20)


@query("select c_custkey, c_mktsegment from customer order by c_custkey limit 50 offset 30")
def offset_page(spark, sf_dir):
    return VR.budget_page(TB.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], 30, 50)


@query("select o_orderkey, row_number() over (order by o_orderkey) + 1000 as version from orders")
def publication_versions(spark, sf_dir):
    return VR.with_versions(TB.read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "version", 1000).select("o_orderkey", "version")


# vectors

Q_SQL = "q as (select vec_id as query_id, embedding::double[] as query from embeddings where vec_id % 20 = 0)"


def _vectors(spark, sf_dir):
    return TB.read(spark, sf_dir, "embeddings")


def _vector_queries(spark, sf_dir):
    return _vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


COS = "greatest(-1.0, least(1.0, list_cosine_similarity(q.query, {0}::double[])))"


@query(f"with {Q_SQL}, s as (select query_id, vec_id, {COS.format('embedding')} as score from q, embeddings), r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s where score > 0) select query_id, vec_id, round(score, 6) as score, rank from r where rank <= 10")
def vector_search(spark, sf_dir):
    return R.vector_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), "vec_id", "embedding", digits=9).withColumn("score", F.round("score", 6))


@query("select vec_id, len(embedding) = 64 as valid, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def vector_validation(spark, sf_dir):
    e = F.col("embedding")
    return _vectors(spark, sf_dir).select("vec_id", V.valid_vector(e, 64).alias("valid"), F.round(V.l2_norm(e), 6).alias("norm"))


@query("with m as (select label, i, avg(x::double) as m from (select label, unnest(embedding) as x, unnest(range(1, 65)) as i from embeddings) group by 1, 2) select label, round(sum(m * i), 3) as moment from m group by 1")
def mean_vectors(spark, sf_dir):
    m = R.mean_vectors(_vectors(spark, sf_dir), "label", "embedding")
    return m.select("label", F.round(F.aggregate(F.transform("mean", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3).alias("moment"))


@query()
def community_sub_centroids(spark, sf_dir):
    return R.community_centroids(_vectors(spark, sf_dir), "label", "vec_id", "embedding")


@query()
def routed_vector_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return R.routed_search(v, _vector_queries(spark, sf_dir), R.community_centroids(v, "label", "vec_id", "embedding"), "vec_id", "embedding", "label")


@query(f"with {LEX_SQL}, l as (select doc_id, score from lex where score > 0), s as (select vec_id as doc_id, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as score from embeddings), j as (select coalesce(l.doc_id, s.doc_id) as doc_id, coalesce(l.score, 0) as a, coalesce(s.score, 0) as b from l full join (select * from s where score > 0) s using (doc_id)) select doc_id, round(case when a > 0 and b > 0 then 0.45 * a + 0.55 * b when a > 0 then a else b end, 9) as score from j where a > 0 or b > 0")
def hybrid_search(spark, sf_dir):
    lex = R.lexical_search(TB.read(spark, sf_dir, "documents"), QUERY, F.col("text"), "doc_id", None)
    v = _vectors(spark, sf_dir)
    one = v.where("vec_id = 0").select(F.col("embedding").alias("query"))
    sem = v.join(F.broadcast(one)).select(F.col("vec_id").alias("doc_id"), V.cosine(F.col("query"), F.col("embedding")).alias("score")).where("score > 0")
    return R.hybrid(lex, sem, "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query()
def diversified_ranking(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    hits = R.vector_search(v, _vector_queries(spark, sf_dir), "vec_id", "embedding", 50)
    cand = hits.join(v.select("vec_id", F.col("label").alias("conversation"), F.col("embedding").alias("vector")), "vec_id").select("query_id", F.col("vec_id").alias("id"), "conversation", "score", "vector")
    return R.diversify(cand, None, 10)


@query("with m as (select d.doc_id, d.doc_id % 11 = 0 as archived, e.embedding, l.quality from documents d left join embeddings e on e.vec_id = d.doc_id left join labels l on l.doc_id = d.doc_id) select doc_id, embedding is not null as has_vector, quality from m where not archived")
def snapshot_assembly(spark, sf_dir):
    d = TB.read(spark, sf_dir, "documents")
    mem = d.select("doc_id", F.col("doc_id").alias("body_id"), (F.col("doc_id") % 11 == 0).alias("archived"))
    bodies = d.select(F.col("doc_id").alias("body_id"), "text")
    vec = _vectors(spark, sf_dir).select(F.col("vec_id").alias("body_id"), "embedding")
    lab = TB.read(spark, sf_dir, "labels").select("doc_id", "quality")
    return R.snapshot(mem, bodies, vec, lab, "doc_id", "body_id").select("doc_id", F.col("embedding").isNotNull().alias("has_vector"), "quality")


@query(f"with {LEX_SQL}, h as (select doc_id, score, row_number() over (order by score desc, doc_id) as rn from lex where score > 0) select doc_id, round(score, 9) as score, (select count(*) from h) > 10 as truncated from h where rn <= 10")
def search_page(spark, sf_dir):
    hits = R.lexical_search(TB.read(spark, sf_dir, "documents"), QUERY, F.col("text"), "doc_id", None)
    return R.page(hits, [F.desc("score"), "doc_id"], 10).withColumn("score", F.round("score", 9))


@query("select l_partkey, max(l_extendedprice) as score from lineitem group by 1")
def max_merge(spark, sf_dir):
    return R.max_merge(TB.read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("score")), "l_partkey")


@query("select user_id, event_id, value as cosine from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r = 1")
def best_candidate(spark, sf_dir):
    e = TB.read(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("cosine"))
    return R.best_per_key(e, "user_id", ["event_id"])


@query(f"with {MEM} select memory_id, cast(floor((row_number() over (order by freshness desc, memory_id) - 1) / 10) as int) as batch from mem")
def freshness_offers(spark, sf_dir):
    return R.offers(_memories(spark, sf_dir), "memory_id").select("memory_id", "batch")


# graph

REL = TB.RELATIONS_SQL


@query(f"with {REL} select source as node, 'out' as direction, target as other, kind from relations where active and source % 10 = 0 union all select target, 'in', source, kind from relations where active and target % 10 = 0")
def incident_edges(spark, sf_dir):
    nodes = TB.read(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("node"))
    return G.incident(TB.relations(spark, sf_dir), nodes)


@query(f"with {REL} select distinct node from (select source as node from relations where active union all select target from relations where active)")
def active_nodes(spark, sf_dir):
    return G.active_nodes(TB.relations(spark, sf_dir))


@query(f"with {REL}, u as (select source as a, target as b from relations where active and source <> target union select target, source from relations where active and source <> target) select a, array_to_string(list_sort(list(b)), ',') as neighbours from u where a % 3 <> 0 and b % 3 <> 0 group by 1")
def adjacency_lists(spark, sf_dir):
    ok = TB.read(spark, sf_dir, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("node"))
    adj = G.adjacency(TB.relations(spark, sf_dir), ok)
    return adj.select("a", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query(f"with recursive {REL}, u as (select source as a, target as b from relations where active and kind = 'duplicate' and source <> target union select target, source from relations where active and kind = 'duplicate' and source <> target), reach(node, other) as (select a, a from u union select r.node, u.b from reach r join u on u.a = r.other) select node, min(other) as component from reach group by 1")
def duplicate_components(spark, sf_dir):
    return G.components(TB.relations(spark, sf_dir).where("kind = 'duplicate'"))


@query(f"with recursive {REL}, u as (select source as a, target as b from relations where active and source <> target union select target, source from relations where active and source <> target), r(seed, node, depth) as (select vec_id, vec_id, 0 from embeddings where vec_id % 20 = 0 union select seed, b, depth + 1 from r join u on u.a = r.node where depth < 3) select seed, node, min(depth) as depth from r group by 1, 2")
def bounded_hops(spark, sf_dir):
    seeds = TB.read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("node"))
    return G.within_hops(TB.relations(spark, sf_dir), seeds, 3)


@query(f"with recursive {REL}, c(key) as (select vec_id from embeddings where vec_id % 20 = 0 union select target from c join relations on source = key) select key from c")
def dependency_closure(spark, sf_dir):
    seeds = TB.read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("key"))
    return G.closure(seeds, TB.relations(spark, sf_dir).select(F.col("source").alias("key"), F.col("target").alias("needs")))


@query(f"with {REL}, n as (select distinct node from (select source as node from relations where active union all select target from relations where active)) select coalesce(e.vec_id, n.node) as node, case when n.node is null then 'not active' when e.vec_id is null then 'not covered' end as reason from (select vec_id from embeddings where vec_id % 9 <> 0) e full join n on n.node = e.vec_id where n.node is null or e.vec_id is null")
def community_validation(spark, sf_dir):
    members = TB.read(spark, sf_dir, "embeddings").where("vec_id % 9 <> 0").select(F.col("vec_id").alias("node"), "label")
    return G.community_errors(members, G.active_nodes(TB.relations(spark, sf_dir)))


# freshness

REC = "rec as (select c_custkey as id, cast(c_custkey % 201 as int) - 100 as score, case when c_custkey % 7 = 0 then null else c_custkey % 50 end as admitted, c_custkey % 50 as accounted from customer)"


def _records(spark, sf_dir):
    k = F.col("c_custkey")
    return TB.read(spark, sf_dir, "customer").select(k.alias("id"), ((k % 201).cast("int") - 100).alias("score"), F.when(k % 7 != 0, k % 50).alias("admitted"), (k % 50).alias("accounted"))


@query(f"with {REC}, s as (select id, cast(case when admitted is null then score when 1000 < accounted then null else greatest(score - floor((1000 - accounted) / 10.0), -100) end as int) as score from rec) select id, score, case when score >= 1 then 'fresh' when score >= -50 then 'stale' else 'dormant' end as state from s")
def freshness_scores(spark, sf_dir):
    s = FR.score_at(F.col("score"), F.col("admitted"), F.col("accounted"), F.lit(1000))
    return _records(spark, sf_dir).select("id", s.alias("score")).withColumn("state", FR.state(F.col("score")))


@query(f"with {REC}, b as (select *, case when score >= 1 then accounted + score * 10 when score >= -50 then accounted + (score + 51) * 10 end as boundary, greatest(score - floor((500 - accounted) / 10.0), -100) as now from rec) select id, boundary, case when score >= 1 then 'fresh' when score >= -50 then 'stale' else 'dormant' end as from_state, case when now >= 1 then 'fresh' when now >= -50 then 'stale' else 'dormant' end as to_state from b where admitted is not null and boundary <= 500 order by boundary, id limit 100")
def freshness_due(spark, sf_dir):
    return FR.due(_records(spark, sf_dir), 500, "id", 100)


@query(f"with {REC} select id, boundary, from_state, to_state from (select id, accounted + score * 10 as boundary, 'fresh' as from_state, 'stale' as to_state from rec where admitted is not null and score >= 1 union all select id, accounted + (score + 51) * 10, 'stale', 'dormant' from rec where admitted is not null and score >= -50) where boundary <= 900")
def freshness_crossings(spark, sf_dir):
    return FR.crossings(_records(spark, sf_dir), 900, "id")


@query("with recursive e as (select user_id as memory_id, event_id as position, case when event_type = 'purchase' then 50 when event_type = 'click' then 25 else 5 end as amount, row_number() over (partition by user_id order by event_id) as k, min(event_id) over (partition by user_id) as admitted from events), f as (select memory_id, k, position, admitted, least(100 + amount, 100) as score from e where k = 1 union all select e.memory_id, e.k, e.position, e.admitted, least(greatest(f.score - (floor((e.position - e.admitted) / 10.0) - floor((f.position - e.admitted) / 10.0)), -100) + e.amount, 100) from f join e on e.memory_id = f.memory_id and e.k = f.k + 1), l as (select memory_id, max(k) as k from e group by 1) select f.memory_id, f.admitted, cast(greatest(f.score - (floor(((select max(event_id) from events) - f.admitted) / 10.0) - floor((f.position - f.admitted) / 10.0)), -100) as int) as score from f join l using (memory_id, k)")
def freshness_history(spark, sf_dir):
    events = TB.freshness_events(spark, sf_dir)
    return FR.fold(events, "memory_id", events.agg(F.coalesce(F.max("position"), F.lit(0))).first()[0])


@query(f"with recursive {REL}, u as (select source as a, target as b from relations where active and source <> target union select target, source from relations where active and source <> target), r(event_id, origin, node, credit) as (select vec_id, label, vec_id, 50 from embeddings where vec_id % 20 = 0 union select event_id, origin, u.b, credit - (case when e.label = origin then 5 else 10 end) from r join u on u.a = r.node join embeddings e on e.vec_id = u.b where credit - (case when e.label = origin then 5 else 10 end) > 0) select event_id, node, max(credit) as credit from r group by 1, 2")
def freshness_propagation(spark, sf_dir):
    e = TB.read(spark, sf_dir, "embeddings")
    roots = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("event_id"), F.col("vec_id").alias("node"), F.lit(50).alias("amount"))
    return FR.propagate(TB.relations(spark, sf_dir), roots, e.select(F.col("vec_id").alias("node"), F.col("label").alias("community")))


@query("select distinct o_orderkey as use_id, l_partkey as source, 25 as amount from orders join lineitem on l_orderkey = o_orderkey")
def accepted_uses(spark, sf_dir):
    uses = TB.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("use_id")).agg(F.collect_list("l_partkey").alias("sources"))
    return FR.accept_use(uses.union(uses))


@query(f"with {Q_SQL}, s as (select query_id as fragment_id, vec_id as memory_id, {COS.format('embedding')} * 0.5 + 0.6 as c from q, embeddings where vec_id < query_id), b as (select *, cast(least(1 + floor((c - 0.75) * 9 / 0.25), 10) as int) as bonus from s where c >= 0.75), r as (select *, row_number() over (partition by fragment_id order by round(c, 9) desc, memory_id) as rank from b) select fragment_id, memory_id, bonus, rank from r where rank <= 64")
def semantic_bonus_plan(spark, sf_dir):
    v, q = _vectors(spark, sf_dir), _vector_queries(spark, sf_dir)
    hits = R.vector_search(v, q, "vec_id", "embedding", 64, 9, 0.5, 0.6, 0.75, F.col("vec_id") + 1, F.col("query_id"))
    cand = hits.select(F.col("query_id").alias("fragment_id"), F.col("vec_id").alias("memory_id"), F.col("score").alias("cosine"), F.lit(True).alias("eligible"))
    return FR.semantic_plan(cand).select("fragment_id", "memory_id", "bonus", "rank")


@query("select c_custkey, cast(w * 50 // 100 as bigint) as trigger, cast((w * 50 // 100) * 80 // 100 as bigint) as target, cast(w * 80 // 100 as bigint) as input from (select c_custkey, c_custkey * 1000 as w from customer)")
def context_budgets(spark, sf_dir):
    b = V.context_budgets(F.col("c_custkey") * 1000)
    return TB.read(spark, sf_dir, "customer").select("c_custkey", b["trigger"].alias("trigger"), b["target"].alias("target"), b["input"].alias("input"))
