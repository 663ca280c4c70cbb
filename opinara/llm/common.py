"""Row keys, reliable cuts of the lineage and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.session import checkpointed

# Bytes that separate words, as a Java and RE2 character class.
BLANK = r"\x20\x09-\x0D"
WORD = f"[^{BLANK}]+"
# Stands for a null key inside joins; sorts before every other key.
NULL_KEY = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def key_of(id_col: str) -> Column:
    """A long that is never null."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, text, _key, _copy, _n): one identity for each text of an id, also
    where ids repeat or are null.

    Texts of one id are told apart and ordered by a hash, `_copy`; rows equal in id and text are
    numbered by `_n`, in any order.  The rows are dealt by `_key` and `_copy`, so an id with very
    many texts is spread; every later join on them reuses that one exchange.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col), *carry, text, key_of(id_col).alias("_key"))
    rows = rows.withColumn("_copy", F.xxhash64("text")).repartition("_key", "_copy")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("_key", "_copy").orderBy("_key")))


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """Whole rows in one struct `_row`, so that no working column can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[F.col(c).alias(f"_{c}") for c in keep])


def set_apart(docs: DataFrame) -> DataFrame:
    """(_row, _doc_id, _text): `_row` holds all columns but the text."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("_row"), F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"))


def rewritten(rows: DataFrame, names: list[str], text: str) -> DataFrame:
    """The columns of documents with a new text and its length."""
    return unpacked(rows, names, text=F.col(text), n_chars=F.char_length(text).cast("long"))


def unpacked(rows: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    return rows.select(*[replaced.get(c, F.col("_row")[c]).alias(c) for c in names])


def scratch(df: DataFrame) -> DataFrame:
    """Written to the cluster's shared folder and read back, without its history."""
    return checkpointed(df)


def fresh(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge (a, b); component is the smallest node.

    Alternates large-star and small-star: each round hangs neighbours under the smallest node
    known nearby, which halves the depth of any chain.  Only minima are gathered per node, so a
    node with very many neighbours costs partial aggregates and a join Spark can split.
    """
    e = scratch(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
