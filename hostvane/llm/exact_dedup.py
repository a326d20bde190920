"""Exact duplicates through an extendible-hash index kept on shared files.

Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Every text gets a 64-bit
hash, its key. The index maps keys to buckets through a directory over the leading bits of the key: a bucket
with too many keys is split on one more bit, which doubles the directory where it is needed, until every
bucket fits. Documents are dealt out to their buckets first; everything else is done inside a bucket: counting,
chaining different texts with one key, comparing texts of a shared key byte by byte, and looking up.

Everything is DataFrame code. Copies are folded into one chain entry before anything is shuffled by bucket, so
a text that a third of all rows repeat costs each task one entry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvane.operators.joins import join_checked
from hostvane.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_DEPTH = 16  # directory bits: at most 65,536 cells, so the directory may be broadcast
BUCKET_KEYS = 50_000
KEY_BITS = 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def text_key(body: Column, key_bits: int = KEY_BITS) -> Column:
    """The leading ``key_bits`` of the text's hash. Short keys collide often, which tests use."""
    return F.shiftleft(F.xxhash64(body), KEY_BITS - key_bits)


def cell_of(max_depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - max_depth).cast("int")


def directory(keys: DataFrame, bucket_keys: int | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Cell (the ``max_depth`` leading bits of a key) to its bucket: (cell, depth, bucket), for distinct ``keys``.

    A bucket is a run of leading bits; its local depth is the least one at which its keys fit. A very large
    index has larger buckets instead of a larger directory: four times the mean of a cell, so that all fit
    (at the greatest depth only keys made short for a test do not).
    """
    cells = materialize(keys.groupBy(cell_of(max_depth).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "dedup-cells")
    if bucket_keys is None:
        n = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        bucket_keys = max(BUCKET_KEYS, -(-4 * n // (1 << max_depth)))
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth)))).withColumn(
        "bucket", F.expr(f"shiftright(cell, {max_depth} - depth)")
    )
    sizes = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("n"))
    fits = sizes.where((F.col("n") <= bucket_keys) | (F.col("depth") == max_depth)).select("depth", "bucket")
    # Both sides have a row per cell and depth, which Spark takes for less: never broadcast.
    first = levels.join(fits.hint("merge"), ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("b"))
    return first.select("cell", "b.depth", "b.bucket")


@dataclass(frozen=True)
class ExactIndex:
    """``directory``: (cell, depth, bucket). ``pages``: one row per distinct text, (depth, bucket, key, chain,
    text_sha256, keep_id, group_size), stored in key ranges. ``entries``: one slim row per document with its bucket."""

    directory: DataFrame
    pages: DataFrame
    entries: DataFrame


BUCKET = ["depth", "bucket"]


def build(
    docs: DataFrame, bucket_keys: int | None = None, max_depth: int = MAX_DEPTH, key_bits: int = KEY_BITS
) -> ExactIndex:
    """Index whole texts of ``docs`` (doc_id, text; other columns are not read)."""
    body = normalised(F.col("text"))
    texts = docs.select("doc_id", body.alias("body")).withColumn("key", text_key(F.col("body"), key_bits))
    entries = materialize(texts.select("doc_id", "key", F.unhex(F.sha2("body", 256)).alias("sha")), "dedup-entries")
    cells = materialize(directory(entries.select("key").distinct(), bucket_keys, max_depth), "dedup-directory")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("cell", cell_of(max_depth)).join(F.broadcast(cells), "cell").drop("cell")

    owned = placed(entries)
    folded = owned.groupBy(*BUCKET, "key").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"), F.max("sha").alias("sha")
    )
    folded = materialize(folded, "dedup-keys")
    # Only texts whose key occurs again are read a second time, to be compared.
    shared = folded.where("group_size > 1").select("key")
    met = placed(join_checked(texts, shared, ["key"], "left_semi"))
    chained = met.groupBy(*BUCKET, "key", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entry = [*BUCKET, "key", "sha", "keep_id", "group_size"]
    chained = chained.withColumn("sha", F.unhex(F.sha2("body", 256))).select(*entry)
    every = folded.where("group_size = 1").select(*entry).unionByName(chained)
    # Owner tasks take ranges of buckets, by their first key.
    first = F.expr(f"shiftleft(bucket, {max_depth} - depth)")
    ranged = every.withColumn("first", first).repartitionByRange("first", "key").sortWithinPartitions("first", "key", "keep_id")
    return ExactIndex(cells, materialize(ranged.select(*entry), "dedup-pages"), owned)


def exact_duplicates(docs: DataFrame, **index: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The largest doc_id of equal texts stays. Rows repeating a doc_id count one by one and share its answer; a
    null doc_id is never the one that stays while the group has another. An empty table gives no rows.
    """
    built = build(docs, **index)
    looked_up = built.entries.join(built.pages, [*BUCKET, "key", "sha"])
    return looked_up.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
