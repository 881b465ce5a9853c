"""Global shuffle into shards: a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash of id and text. Pass two loads a
bucket, Fisher-Yates shuffles it with a generator seeded by the bucket, and writes it. The buckets, one behind the
other, are the global order, and the shards are equal slices of it, so their row counts are at most one apart. Where a
bucket begins follows from the buckets' row counts, summed in two levels; each bucket gets its own with its rows, and
nothing but totals comes to the driver.

The hash sees the whole record, so a hot source or copies with ids of their own spread evenly. Rows that repeat both
id and text would share a bucket: where a bucket is larger than chance allows, such rows are counted (before the
shuffle), numbered, and scattered by their number as well. Nothing depends on the order of tasks or rows: a bucket
is sorted by its hashes before it is shuffled, and a lost task gives the same rows again.

Defined cases: a null text has no bytes (size 1) and crc32 0; rows that repeat everything are all kept; an empty
table gives no rows. Columns other than id and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_BYTES = 16 << 20
#: Buckets whose counts are summed together.
BLOCK = 4096


def fisher_yates(n: int, seed: int, bucket: int) -> list[int]:
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(n)
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def _shuffle(seed: int, total: int, shards: int, key: tuple, rows: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
    """One bucket's rows in shuffled order, with their places among the shards."""
    bucket, n = int(key[0]), len(rows)
    rows = rows.sort_values(["_h", "_id", "_n"], kind="stable").iloc[fisher_yates(n, seed, bucket)]
    edges = np.array([k * total // shards for k in range(shards + 1)], np.int64)
    place = int(counted["_start"].iloc[0]) + np.arange(n, dtype=np.int64)
    shard = np.searchsorted(edges[1:], place, side="right")
    return pd.DataFrame({"id": rows["_id"].values, "text": rows["_text"].values, "shard": shard.astype(np.int32), "slot": place - edges[shard]})


def starts(counts: DataFrame) -> DataFrame:
    """(_of, _start) from (_bucket, n), _of being the bucket: the rows before each bucket, summed within blocks of buckets and over the blocks."""
    blocked = counts.withColumn("_block", F.floor(F.col("_bucket") / BLOCK))
    blocks = blocked.groupBy("_block").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_block", before(W.orderBy("_block")).alias("_base"))  # one row for each BLOCK buckets
    inner = blocked.withColumn("_own", before(W.partitionBy("_block").orderBy("_bucket")))
    return inner.join(blocks, "_block").select(F.col("_bucket").alias("_of"), (F.col("_base") + F.col("_own")).alias("_start"))


def shard(docs: DataFrame, shards: int = 8, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, shard, slot) for every row; slots count from 0 within each shard, row counts are at most one apart."""
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    plain = plain.withColumn("_h", F.xxhash64(F.lit(seed), "_id", "_text"))
    size, rows = plain.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 1), F.count("*")).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    plain = plain.withColumn("_bucket", F.pmod(F.col("_h"), F.lit(buckets))).withColumn("_n", F.lit(1).cast("long"))
    limit = 2 * -(-rows // buckets) + 1000  # uniform buckets stay below; beyond it, rows repeat
    hot = sorted(r["_bucket"] for r in plain.groupBy("_bucket").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect())
    if hot:  # fewer than half the buckets, and as a rule none or few
        repeated = F.col("_bucket").isin(hot)
        numbered = plain.where(repeated).groupBy("_id", "_text", "_h").count().withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "count")))
        numbered = numbered.withColumn("_bucket", F.pmod(F.xxhash64("_h", "_n"), F.lit(buckets)))
        plain = plain.where(~repeated).unionByName(numbered.drop("count"))
    counts = plain.groupBy("_bucket").agg(F.count("*").alias("n"))
    kind = plain.schema["_id"].dataType.simpleString()

    def run(key: tuple, rows_: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        return _shuffle(seed, rows, shards, key, rows_, counted)

    return plain.groupBy("_bucket").cogroup(starts(counts).groupBy("_of")).applyInPandas(run, f"id {kind}, text string, shard int, slot long")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Parquet folders shard=0, shard=1, ...; within a file, rows lie in slot order. Pass two writes them, without another shuffle."""
    shard(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
