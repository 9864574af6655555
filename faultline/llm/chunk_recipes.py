"""Exact duplicates by recipes: a text is cut where its content says so, equal chunks share a verified identifier, and documents
are compared by their ordered lists of identifiers. A distinct chunk moves once; documents themselves never move.

A chunk ends at the first sentence mark or line end after LEAST characters, or after MOST characters. Its identifier is a 64-bit
hash and its place among the distinct chunks that share this hash (nearly always the only one), so two chunks have one
identifier only if their characters agree. Everything is a DataFrame function.

Defined results: a null text is the empty one, and all empty texts are equal; of equal texts the row with the largest doc_id
stays (a null doc_id is below all others); rows alike in doc_id and text share their doc_id's decision and count in group_size;
texts of any length are read whole; other columns, whatever their names, are not read; an empty table gives an empty one.
A group of any size is a row for each of its copies: its count and maximum are made before the shuffle, and the decision is
joined to a copy by its recipe, where Spark may split the copies of one key over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, collect_garbage, discard, table, written

#: Characters of a chunk, but for a text's last one.
LEAST, MOST = 512, 4096


def chunks(text, least: int = LEAST, most: int = MOST):
    """The chunks of a text, in order; put together they are the text. The empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least - 1},{most - 1}}}?[.!?;\n]|.{{1,{most}}}"), F.lit(0))


def _digest(chunk):
    return F.xxhash64(chunk)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))


def _places(texts: DataFrame, digest, cut) -> DataFrame | None:
    """doc_id, text_sha256, places: for documents with a chunk whose hash another chunk has too, the place of each such chunk among
    the distinct ones of its hash. None if there are no such hashes, which is how it nearly always is."""
    held = texts.select(F.explode(cut("text")).alias("chunk")).withColumn("h", digest(F.col("chunk")))
    shared = written(held.groupBy("h").agg(F.count_distinct("chunk").alias("n")).filter("n > 1").select("h"), "recipe-hashes")
    if shared.isEmpty():
        discard(shared)
        return None
    chunk = held.join(shared, "h", "left_semi").select("h", "chunk").distinct()
    chunk = chunk.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    at = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(cut("text")).alias("at", "chunk")).withColumn("h", digest(F.col("chunk")))
    return at.join(chunk, ["h", "chunk"]).groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("at", "place"))).alias("places"))


def recipes(docs: DataFrame, digest=_digest, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, text_sha256, ids, places, for each row: texts are equal exactly if ids and places are."""
    texts = _texts(docs)
    cut = lambda c: chunks(F.col(c), least, most)
    lists = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(cut("text"), digest).alias("ids"))
    places = _places(texts, digest, cut)
    if places is None:
        return lists.withColumn("places", F.expr("cast(array() as array<struct<at:int,place:int>>)"))
    places = places.withColumnRenamed("doc_id", "of").withColumnRenamed("text_sha256", "sha")
    both = lists.join(places, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_sha256") == F.col("sha")), "left")
    return both.select("doc_id", "text_sha256", "ids", F.coalesce("places", F.expr("cast(array() as array<struct<at:int,place:int>>)")).alias("places"))


def groups(docs: DataFrame, digest=_digest, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, for each row of docs."""
    spark = docs.sparkSession
    lists = written(recipes(docs, digest, least, most), "recipes")
    collect_garbage(spark)  # the shuffle of chunks is over
    key = ["ids", "places"]
    found = written(lists.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
    return lists.join(found, key).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; rows alike in doc_id and text stay or go together."""
    kept = groups(docs).filter("kept").select("doc_id", "text_sha256").distinct()
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("of"), F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256).alias("sha"))
    return named.join(kept, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256")), "left_semi").select("row.*")


def op11_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE = """WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
  g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
  SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm"""
