"""Length buckets with the least padding, and token-budget batches inside each bucket.

Lengths are UTF-8 bytes (one token per byte for a byte-level model).  Texts beyond the context
are cut into pieces of at most `context` tokens, so the global histogram has at most `context`
rows whatever the corpus size; dynamic programming over it chooses the bucket boundaries that
minimise total padding.  Batches of `budget` tokens form inside a bucket: each row of a batch
takes the boundary's length, so a batch holds budget // boundary rows.

Pieces are numbered across tasks without gathering a bucket: every bucket is spread over slots
of an id hash, slot counts (at most buckets x `SLOTS` rows) give each slot its first number,
and rows are ranked inside their slot only.  One batch per bucket at most is not full.

Defined results: null and empty texts have no tokens and no pieces; rows with equal ids are
separate texts; null ids form pieces with a null id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTEXT = 4096
BUCKETS = 16
BUDGET = 65_536
SLOTS = 4096


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the smallest total padding.

    cost(i, j) pads lengths i..j to length j.  best[k][j] = min over i of best[k-1][i] +
    cost(i, j); ties take the smallest i.  Rows of the table are vectors, O(buckets n^2) work.
    """
    if not lengths:
        return []
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    n = len(x)
    rows, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(x * c)])
    best = x * rows[1:] - tokens[1:]
    back = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        new, came = best.copy(), np.full(n, -1, dtype=np.int64)
        for j in range(1, n):
            cost = best[:j] + x[j] * (rows[j + 1] - rows[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], came[j] = cost[i], i
        back.append(came)
        best = new
    ends, j = [], n - 1
    for came in reversed(back[1:]):
        if came[j] < 0:
            continue
        ends.append(int(x[j]))
        j = int(came[j])
    return sorted([*ends, int(x[j])])


def pieces(docs: DataFrame, context: int = CONTEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, n_tokens): every token of every text in exactly one piece."""
    rows = docs.select(F.col(id_col), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_n")).where("_n > 0")
    starts = F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(context)))
    rows = rows.select(id_col, "_n", starts.alias("start"))
    return rows.select(
        id_col,
        (F.col("start") / context).cast("int").alias("piece"),
        "start",
        F.least(F.lit(context), F.col("_n") - F.col("start")).cast("int").alias("n_tokens"),
    )


def plan(parts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Boundaries for these pieces; the histogram has at most `context` rows."""
    hist = parts.groupBy("n_tokens").count().collect()
    return boundaries([r["n_tokens"] for r in hist], [r["count"] for r in hist], buckets)


def pack(docs: DataFrame, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, n_tokens, bucket_len, batch, place, padding), one row per piece."""
    if budget < context:
        raise ValueError("a batch must hold at least one piece of full length")
    parts = pieces(docs, context, id_col, text_col)
    ends = plan(parts, buckets)
    slot = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), 1, 3), 16, 10)
    bucket = F.lit(None).cast("int")
    for end in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end)).otherwise(bucket)
    # A long text's pieces go to slots of their own, so one text cannot fill a slot.
    slot = F.pmod(slot.cast("int") + F.col("piece"), F.lit(SLOTS)).cast("int")
    parts = parts.withColumn("bucket_len", bucket).withColumn("_slot", slot)
    counts = parts.groupBy("bucket_len", "_slot").agg(F.count("*").alias("_n"))
    before = W.partitionBy("bucket_len").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("bucket_len", "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = W.partitionBy("bucket_len", "_slot").orderBy(id_col, "piece", "n_tokens")
    at = F.col("_first") + F.row_number().over(inside) - 1
    size = F.floor(F.lit(budget) / F.col("bucket_len"))
    return (
        parts.join(F.broadcast(first), ["bucket_len", "_slot"])  # at most buckets x SLOTS rows
        .withColumn("_at", at)
        .select(
            id_col,
            "piece",
            "start",
            "n_tokens",
            "bucket_len",
            F.floor(F.col("_at") / size).cast("long").alias("batch"),
            F.pmod(F.col("_at"), size).cast("int").alias("place"),
            (F.col("bucket_len") - F.col("n_tokens")).cast("int").alias("padding"),
        )
    )
