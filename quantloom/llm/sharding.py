"""Extendible hashing: a directory over hash-prefix bits that splits only buckets above a byte limit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash bits: 15 hexadecimal digits of an MD5, so that they fit a signed long.
BITS = 60


def hash_bits(*columns: Column) -> Column:
    """60 evenly spread bits of some string columns; null counts as empty."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(c, F.lit("")) for c in columns)).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _prefix(bits: int | str) -> Column:
    return F.expr(f"shiftright(_h, cast({BITS} - ({bits}) as int))")


def directory(rows: DataFrame, limit: int, bits: int) -> DataFrame:
    """Leaf of each cell of ``bits`` prefix bits: (_cell, _depth, _bytes, _open).  A cell's leaf is the
    shortest prefix whose rows fit the limit; _open marks cells that need bits beyond these."""
    cells = rows.groupBy(_prefix(bits).alias("_cell")).agg(F.sum("_size").alias("_b"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    levels = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("_d")).withColumn("_p", F.expr(f"shiftright(_cell, {bits} - _d)"))
    sums = levels.groupBy("_d", "_p").agg(F.sum("_b").alias("_sum"))
    fits = levels.join(sums.where(F.col("_sum") <= limit), ["_d", "_p"]).groupBy("_cell").agg(F.min(F.struct("_d", "_sum")).alias("_leaf"))
    return cells.join(fits, "_cell", "left").select(
        "_cell", F.coalesce("_leaf._d", F.lit(bits)).alias("_depth"), F.coalesce("_leaf._sum", "_b").alias("_bytes"),
        (F.col("_leaf").isNull() & (F.col("_lo") < F.col("_hi"))).alias("_open"),
    )


def assign(docs: DataFrame, limit: int, extra: int = 6) -> DataFrame:
    """Shard of each document: doc_id, n_bytes, shard_id (its prefix bits as text), local_depth, shard_bytes.

    Sizes are the UTF-8 bytes of the text, 0 for a null or empty one.  Every shard fits ``limit``, but for
    one that a single longer text, or repeats of one row, fill alone: these have all 60 bits.  Rows of
    one doc_id differ by their texts, so a frequent doc_id spreads.  A null doc_id hashes as an empty
    one; an empty table gives no rows.  Only sizes and hashes are shuffled, never texts; the directory is
    joined, and broadcast only below the session's threshold.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_size"),
        hash_bits(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).alias("_h"),
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(BITS, extra + max(0, math.ceil(math.log2(max(1, total / limit)))))
    found, left = rows.join(directory(rows, limit, bits).withColumnRenamed("_cell", "_c"), _prefix(bits) == F.col("_c")), None
    while bits < BITS:
        open_ = found.where("_open") if left is None else left.where("_open")
        if open_.isEmpty():
            break
        # Only the cells that are still too large take further bits.
        more = min(BITS, bits + 12)
        deep = directory(open_.select("_h", "_size"), limit, more).withColumnRenamed("_cell", "_c")
        left = open_.select("doc_id", "_h", "_size").join(deep, _prefix(more) == F.col("_c"))
        found = found.where("not _open").unionByName(left)
        bits = more
    shard = F.expr(f"case when _depth = 0 then '' else lpad(bin(shiftright(_h, cast({BITS} - _depth as int))), _depth, '0') end")
    return found.select("doc_id", F.col("_size").alias("n_bytes"), shard.alias("shard_id"), F.col("_depth").cast("long").alias("local_depth"), F.col("_bytes").alias("shard_bytes"))
