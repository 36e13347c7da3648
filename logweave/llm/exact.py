"""Exact dedup with a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.words import unused
from logweave.plans.materialize import materialize

#: A digest over this share of all rows is certain to be split off; so at most its inverse are, and the broadcast has as many rows.
SUPPORT = 1 / 256


def _digest() -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null counts as empty. The row
    with the smallest doc_id stays. A null doc_id is larger than any other and stays only where its group has no other; rows
    that repeat the smallest doc_id of their group all count as it. Other columns are ignored.

    A Misra-Gries summary of the digests (a counter per 1/support, merged over partitions) names the frequent ones. Exact
    counts confirm them; their groups are resolved on the map side by a broadcast of at most 1/support rows, and only the
    rest is shuffled: once to group, once to join back, with no key above the support.
    """
    digests = materialize(docs.select("doc_id", _digest().alias("digest")).withColumn("h", F.xxhash64("digest")))
    frequent = digests.select("h").freqItems(["h"], support).select(F.explode("h_freqItems").alias("h"))
    group = lambda df: df.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = materialize(group(digests.join(F.broadcast(frequent), "h", "left_semi")))
    heavy = digests.join(F.broadcast(winners), "digest")
    light = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rest = light.join(group(light), "digest")
    cols = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    return heavy.select(*cols).unionByName(rest.select(*cols))


def deduplicated(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs (doc_id, text, ...)`` that stay, with all their columns: of each group of equal texts the one with the smallest doc_id.

    Rows that repeat that id and text leave one; a null id stays only where its group has no other. Null texts are empty ones.
    An empty table stays empty.
    """
    own = unused(docs, "digest")
    kept = exact_dedup(docs, support).where("kept").select(F.col("doc_id").alias(own + "id"), F.unhex("text_sha256").alias(own + "of")).distinct()
    rows = docs.withColumn(own, _digest())
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept[own + "id"]) & (rows[own] == kept[own + "of"]), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).drop(own)
