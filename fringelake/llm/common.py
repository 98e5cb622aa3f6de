"""What the operators of this subpackage share: sessions, scratch tables, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringelake.shipping import ship

#: Bytes of text that one Arrow batch may carry to a Python worker.
BATCH_BYTES = 4 << 20

#: Lower-cases A-Z and turns ASCII white space, control characters and
#: punctuation into blanks; other bytes stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32
              for c in range(256))
#: Words between ASCII white space, A-Z lower-cased.
SPACED = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors and bound Arrow batches by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only local sessions that set none get a
    temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="fringelake-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: For tables of rows of megabytes: Parquet sizes its row groups after every row, not after a hundred, and ends them
#: at some (compressed) megabytes, as writers and readers hold whole ones.
LONG_ROWS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1",
             "parquet.page.size.row.check.max": "1"}


def save(df: DataFrame, name: str, codec: str = "zstd", *, long_rows: bool = False) -> tuple[DataFrame, str]:
    """Write a table to a new place in the shared folder and read it again, which
    cuts the lineage. It goes when the application ends, or with `forget`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    df.write.options(compression=codec, **(LONG_ROWS if long_rows else {})).parquet(path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Remove tables that `save` wrote and nothing reads any more."""
    for path in paths:
        p, fs = _path(spark, path)
        fs.delete(p, True)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def in_blocks(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[range]:
    """Neighbouring rows of about `limit` bytes in all; a larger row is its own block."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield range(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield range(start, len(sizes))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_MULT = np.uint64(0x9E3779B97F4A7C15)


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for a sequence of word hashes, place by place."""
    with np.errstate(over="ignore"):
        out = hashes[0] * _MULT
        for h in hashes[1:]:
            out = (out ^ (out >> np.uint64(29))) * _MULT + h
        return (out ^ (out >> np.uint64(32))) * _MULT


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; a shorter text is one shingle of all its
    words, and an empty one has none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    return combine([words[i:i + n] for i in range(size)] + [np.uint64(size)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About `rows` rows, those of smallest key hash, and never more than twice as many; all of
    them if there are no more."""
    total = df.count()
    if total <= rows:
        return df
    span = 1 << 40
    chance = F.pmod(F.xxhash64(*keys), F.lit(span))
    return df.filter(chance < F.lit(int(span * (rows / total)))).limit(2 * rows)


def one_row_per_id(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, text) that share an id the one of smallest text hash, so that a bound on ids bounds rows."""
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fold(doc_id):
    """crc32 of the id's decimal text modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


