"""What the training-data operators share: table access, the shared working folder, and hashing of words in bulk."""

from __future__ import annotations

import gc
import re
import string
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temp folder in local mode (tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/faultline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs only a re-read."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._faultline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_faultline_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver's JVM finds them unreachable; asks it to look now."""
    gc.collect()
    spark._jvm.System.gc()


def fold_of(doc_id) -> int:
    """crc32(doc_id as text) mod 3; 1 is the held-out third."""
    return zlib.crc32(str(doc_id).encode()) % 3


def fold_column(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


def ascii_lower(text):
    """text with A-Z lower-cased and nothing else. lower() is the fast way where no other character of the text has another lower case."""
    rest = F.regexp_replace(text, "[A-Z]+", "")
    return F.when(F.lower(rest) == rest, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


_MULT = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        m = max(n, 2 * len(_POWERS))
        factors = np.array([[_MULT], [pow(_MULT, -1, 2**64)]], np.uint64).repeat(m, 1)
        factors[:, 0] = 1
        _POWERS, _INVERSES = np.cumprod(factors, axis=1, dtype=np.uint64)
    return _POWERS, _INVERSES


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in UTF-8 bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased. Prefix sums of byte codes times powers; the word's share is scaled back by the inverse power, so equal words hash alike wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_TABLE[_LOWER[data]] * powers[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * inverses[starts])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for j in range(1, k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
        return mix64(h)
