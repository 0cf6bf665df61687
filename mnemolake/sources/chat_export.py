"""Sources: chat exports (a JSON array of conversations with a node tree), normalised manifests, verified files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXPORT = (
    "conversation_id string, id string, title string, current_node string, mapping map<string, struct<id:string, parent:string, "
    "message:struct<id:string, author:struct<role:string>, create_time:double, content:struct<content_type:string, parts:array<string>>, "
    "metadata:struct<is_visually_hidden_from_conversation:boolean>>>>"
)
MANIFEST = (
    "conversations array<struct<id:string>>, turns array<struct<conversation_id:string, id:string, parent_id:string, role:string, timestamp_ns:bigint, content:string>>, "
    "branches array<struct<conversation_id:string, id:string, leaf:string>>, episodes array<struct<conversation_id:string, start:string, end:string>>"
)
ROLES = ("user", "assistant")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """One row for each node of the exported trees."""
    raw = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    conv = F.coalesce("conversation_id", "id")
    return raw.select(conv.alias("conv_id"), "current_node", F.explode("mapping").alias("node_id", "node")).select("conv_id", "current_node", "node_id", F.col("node.parent").alias("parent_id"), F.col("node.message").alias("m"))


def omission(m: str = "m") -> Column:
    """Why a node is no turn; null if it is one."""
    x = F.col(m)
    return (
        F.when(x.isNull(), "empty").when(F.coalesce(x["metadata"]["is_visually_hidden_from_conversation"], F.lit(False)), "hidden")
        .when(~F.coalesce(x["author"]["role"].isin(*ROLES), F.lit(False)), "role").when(F.coalesce(x["content"]["content_type"], F.lit("")) != "text", "content")
        .when(x["create_time"].isNull(), "untimed")
    )


def plan_import(nodes: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns in the half-open window, counts of omissions); parents are the nearest turns kept."""
    when_ns = F.floor(F.col("m.create_time") * 1_000_000_000).cast("long")
    outside = (F.lit(False) if start_ns is None else when_ns < start_ns) | (F.lit(False) if end_ns is None else when_ns >= end_ns)
    judged = nodes.withColumn("reason", F.coalesce(omission(), F.when(outside, "window")))
    kept = judged.where("reason is null").select("conv_id", "node_id", F.col("m.author.role").alias("role"), when_ns.alias("timestamp_ns"), F.array_join("m.content.parts", "\n").alias("content"))
    return remap_parents(judged.select("conv_id", "node_id", "parent_id", F.col("reason").isNull().alias("kept"))).join(kept, ["conv_id", "node_id"]), judged.groupBy("reason").agg(F.count("*").alias("n"))


def remap_parents(links: DataFrame, most: int = 40) -> DataFrame:
    """Each kept node's nearest kept ancestor: dropped parents are replaced by their parents, doubling the step.

    Parents that are still dropped after ``most`` doublings lie on a cycle, which is an error."""
    drop = links.where("not kept").select(F.col("conv_id").alias("_c"), F.col("node_id").alias("_d"), F.col("parent_id").alias("_up"))
    out = links.where("kept").select("conv_id", "node_id", "parent_id")
    for _ in range(most):
        step = out.join(drop, (F.col("conv_id") == F.col("_c")) & (F.col("parent_id") == F.col("_d")), "left")
        if step.where("_d is not null").isEmpty():
            return out
        out = step.select("conv_id", "node_id", F.when(F.col("_d").isNotNull(), F.col("_up")).otherwise(F.col("parent_id")).alias("parent_id"))
        far = drop.select(F.col("_c").alias("_fc"), F.col("_d").alias("_fd"), F.col("_up").alias("_far"))
        drop = drop.join(far, (F.col("_c") == F.col("_fc")) & (F.col("_up") == F.col("_fd")), "left").select(
            "_c", "_d", F.when(F.col("_fd").isNotNull(), F.col("_far")).otherwise(F.col("_up")).alias("_up")
        )
    raise ValueError("parents form a cycle")


def parent_mappings(links: DataFrame) -> DataFrame:
    """(conv_id, node_id, old_parent, new_parent) of the kept nodes whose parent was dropped."""
    old = links.where("kept").select("conv_id", "node_id", F.col("parent_id").alias("old_parent"))
    both = old.join(remap_parents(links).withColumnRenamed("parent_id", "new_parent"), ["conv_id", "node_id"])
    return both.where(~F.col("old_parent").eqNullSafe(F.col("new_parent")))


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return {k: raw.select(F.explode(k).alias("x")).select("x.*") for k in ("conversations", "turns", "branches", "episodes")}


def import_key(content: Column, start_ns: int | None = None, end_ns: int | None = None) -> Column:
    digest = F.sha2(content.cast("binary"), 256)
    return digest if start_ns is None and end_ns is None else F.sha2(F.concat_ws("|", F.lit("window"), digest, F.lit(str(start_ns)), F.lit(str(end_ns))), 256)


def verified_files(spark: SparkSession, path: str, expected: DataFrame, most: int = 16 * 1024 * 1024) -> DataFrame:
    """Files whose bytes have the expected SHA-256 (path, sha256): (path, content)."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("path"), F.sha2("content", 256).alias("sha256"), "content").join(expected, ["path", "sha256"])


def hydrate(descriptors: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that match their descriptors (conversation, message, hash, bytes)."""
    joined = descriptors.join(texts, ["conversation", "message"], "left")
    status = F.when(F.col("text").isNull(), "missing").when((F.sha2(F.col("text").cast("binary"), 256) != F.col("hash")) | (F.octet_length("text") != F.col("bytes")), "mismatch").otherwise("ok")
    return joined.select("conversation", "message", status.alias("status"))


def timeline(nodes: DataFrame) -> DataFrame:
    """Order by (time, key) that respects ancestry: by the greatest time on the path where clocks ran back.

    Nodes: conv_id, node_id, timestamp_ns, depth.  An ancestor later than its descendant is an error row."""
    w = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    ranked = nodes.withColumn("_t", F.max("timestamp_ns").over(w))
    order = Window.partitionBy("conv_id").orderBy("_t", "depth", "node_id")
    return ranked.select("conv_id", "node_id", F.row_number().over(order).alias("ordinal"), (F.col("_t") > F.col("timestamp_ns")).alias("clock_error"))
