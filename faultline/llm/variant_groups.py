"""Spelling variants by a symmetric-delete join: every word files itself and its distinct single deletions under 64-bit keys,
words that share a key are joined, each pair is verified on the words themselves, and every word takes the most frequent near
word as its form. Forms are followed to their roots by joins.

Words at distance one share exactly one string among themselves and their deletions, so a pair is found once. Keys of a word are
made from prefix sums of its code points, in time linear in its length, and entries carry a word's number, not the word: a word
of a million letters is a million short rows. How many words share a key is bounded by the letters there are, not by the data.

Defined results: a null text has no words; a null doc_id is hashed as the empty text; repeated rows count each time; forms that
tie in count are told apart by code points; words of any length are whole; other columns are not read; an empty table gives an
empty one. A frequent word is counted before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import ascii_lower, discard, table, written

#: Code points of a word, its occurrences, and one in how many (document, run) pairs loses a letter.
LEAST_LETTERS, LEAST_COUNT, ONE_IN = 5, 3, 97
LETTERS = r"[a-zÀ-ÿ]+"
#: Letters of the words whose keys are made at a time.
LETTERS_AT_ONCE = 200_000


def words(docs: DataFrame) -> DataFrame:
    """word, n, word_id: the words of all documents with their counts, written, so that their numbers stay."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    run = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text").cast("string")), F.lit(LETTERS), F.lit(0))).alias("run"))
    h = F.crc32(F.encode(F.concat_ws(":", "doc", "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % ONE_IN == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    counted = run.select(word.alias("word")).filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    return written(counted.withColumn("word_id", F.monotonically_increasing_id()), "variant-words")


ENTRY = "key long, word_id long, letters int, first int, last int"


def _entries(ids: np.ndarray, texts: list[str]) -> list[np.ndarray]:
    """Rows of ENTRY: a word's own key (first is -1), and the key of each distinct deletion with the places of the letter whose removal gives it."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    powers, inverses = common._power_tables(len(points) + 2)
    with np.errstate(over="ignore"):
        codes = common.mix64((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(codes * powers[: len(points)], out=sums[1:])
        own = common.mix64((sums[ends] - sums[starts]) * inverses[starts] + sizes.astype(np.uint64))
        word = np.repeat(np.arange(len(texts)), sizes)
        new = np.ones(len(points), bool)
        new[1:] = (points[1:] != points[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(points))[: len(first)] - 1
        w = word[first]
        s, e = starts[w], ends[w]
        cut = (sums[first] - sums[s]) * inverses[s] + (sums[e] - sums[first + 1]) * inverses[s + 1]
        keys = common.mix64(cut + (sizes[w] - 1).astype(np.uint64))
    none = np.full(len(texts), -1, np.int64)
    parts = [(own, ids, sizes, none, none), (keys, ids[w], sizes[w], first - s, last - s)]
    return [np.concatenate([p[i] for p in parts]) for i in range(5)]


def _entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "word_id", "letters", "first", "last"]

    def made(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        key, word, letters, first, last = _entries(np.array(ids, np.int64), texts)
        arrays = [pa.array(key.view(np.int64)), pa.array(word), *(pa.array(x.astype(np.int32)) for x in (letters, first, last))]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and held + len(t) > LETTERS_AT_ONCE:
                yield made(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
        if texts:
            yield made(ids, texts)


def _without(word: str, at) -> F.Column:
    return F.concat(F.substring(F.col(word), F.lit(1), at), F.substring(F.col(word), at + 2, F.length(word)))


def links(known: DataFrame) -> DataFrame:
    """word, n, other, other_n: each pair of words at distance one, in both directions. known: word, n, word_id."""
    entries = written(known.select("word_id", "word").mapInArrow(_entry_batches, ENTRY), "variant-keys")
    a = entries.filter("first >= 0").select("key", F.col("word_id").alias("a"), F.col("letters").alias("of"), F.col("first").alias("lo"), F.col("last").alias("hi"))
    b = entries.select("key", F.col("word_id").alias("b"), "letters", "first", "last")
    one_less = (F.col("first") < 0) & (F.col("letters") == F.col("of") - 1)
    replaced = (F.col("first") >= 0) & (F.col("letters") == F.col("of")) & (F.col("a") < F.col("b")) & (F.col("first") <= F.col("hi")) & (F.col("lo") <= F.col("last"))
    pairs = a.join(b, "key").filter(one_less | replaced).select("a", "b", F.when(F.col("first") < 0, F.col("lo")).otherwise(F.greatest("lo", "first")).alias("at"), (F.col("first") < 0).alias("inserted"))
    side = lambda c: known.select(F.col("word_id").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    rest = F.when(F.col("inserted"), F.col("b_word")).otherwise(_without("b_word", F.col("at")))
    near = both.filter((_without("a_word", F.col("at")) == rest) & (F.col("a_word") != F.col("b_word")))
    ways = F.array(*[F.struct(F.col(f"{x}_word").alias("word"), F.col(f"{x}_n").alias("n"), F.col(f"{y}_word").alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")])
    out = written(near.select(F.explode(ways).alias("way")).select("way.*"), "variant-links")
    discard(entries)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last. The pointers of each round are twice as far; a form has twice the count
    of its word at least, so there are no cycles and few rounds."""
    at = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        discard(at)
        at = new.drop("moved")
        at._faultline_path = new._faultline_path
        if new.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    known = words(docs)
    near = links(known)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best")
    told = near.groupBy("word").agg(F.count("*").alias("n_near"), best).select(F.col("word").alias("of"), "n_near", "best")
    enough = -F.col("best.less") >= 2 * F.col("n")
    joined = known.join(told, known["word"] == told["of"], "left")
    formed = written(joined.select("word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")), "variant-forms")
    discard(near)
    root = roots(formed.filter("form IS NOT NULL"))
    out = formed.join(root.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 by its definition: a table of 256 made by eight shifts, then one step a byte (here a list of two hexadecimal digits each).
CRC_TABLE = "SELECT list(list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, k: xor(c // 2, (c % 2) * 3988292384)) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i) b"
CRC_OF_HEX = "xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(length({0}) // 2), lambda j: CAST('0x' || substr({0}, CAST(2 * j + 1 AS BIGINT), 2) AS UBIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT))"

ORACLE = f"""WITH RECURSIVE crc AS ({CRC_TABLE}),
  run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LETTERS}')) AS run FROM documents),
  held AS (SELECT run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM run GROUP BY doc_id, run),
  hashed AS (SELECT run, c, CAST({CRC_OF_HEX.format("x")} AS BIGINT) AS h FROM held, crc),
  made AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
  w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
  cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w) d),
  near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON c.key = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON c.key = w.word),
  told AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
  best AS (SELECT t.word, t.n_near, t.most, min(n.other) AS form FROM told t JOIN near n ON t.word = n.word AND t.most = n.other_n GROUP BY t.word, t.n_near, t.most),
  formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 2 * w.n THEN b.form END AS form, CASE WHEN b.most >= 2 * w.n THEN b.most END AS form_n FROM w LEFT JOIN best b ON w.word = b.word),
  chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
  SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word JOIN formed l ON l.word = c.root AND l.form IS NULL"""
