"""Helpers shared by the operators: scratch tables, size checks, word rules."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast only when its table has at most so many rows and bytes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Rows and bytes in one Arrow batch; a row that is larger by itself is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

#: Bytes of a row group of a scratch table, which is what its writer holds in memory.
ROW_GROUP = 16 << 20

#: Scratch tables of each operator that runs now, innermost last.
_open: list[list[str]] = []
#: The folder of sessions on one machine that name none.
_local: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine gets a local one where none is named; on a
    cluster that is an error, since each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="blockyard-"))
        found = _local[0]
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage: an executor that is lost later costs a reread, not a
    recomputation, and the row count of the table is cheap to take.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/blockyard-{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    """Names of the scratch tables that ``df`` reads."""
    return {file.rsplit("/", 2)[-2] for file in df.inputFiles() if "/blockyard-" in file}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Delete the tables that ``materialize`` wrote for ``df`` and that no result needs any more."""
    own = _folders(df)
    for made in _open:
        for path in [p for p in made if p.rsplit("/", 1)[1] in own]:
            _delete(df.sparkSession, path)
            made.remove(path)


def scratched(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator``, deleting its scratch tables at the end but for those that its result reads; on an error all."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **how) -> DataFrame:
        made: list[str] = []
        _open.append(made)
        kept: set[str] = set()
        try:
            out = operator(docs, *args, **how)
            if isinstance(out, DataFrame):
                kept = _folders(out)
        finally:
            _open.remove(made)
            for path in made:
                if path.rsplit("/", 1)[1] not in kept:
                    _delete(docs.sparkSession, path)
                elif _open:
                    _open[-1].append(path)
        return out

    return run


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number ``_row``, written once, so that each later reading finds the same rows under it."""
    return materialize(df.select(F.monotonically_increasing_id().alias("_row"), "*"), name, "zstd")


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files of a scratch table."""
    spark, total = df.sparkSession, 0
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def fits(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether a scratch table has at most ``limit`` rows in ``most`` bytes of files; reads footers and sizes only."""
    return df.count() <= limit and table_bytes(df) <= most


def sized(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if it ``fits``.

    ``df`` must be a scratch table, perhaps with columns renamed or rows left
    out; its bytes are those of the whole table.  Larger sides are left for a
    shuffled join, which adaptive execution splits where a key is
    hot.
    """
    return F.broadcast(df) if fits(df, limit, most) else df


def small_batches(spark: SparkSession) -> None:
    """Lower the rows and bytes per Arrow batch for this session, never raise them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if now.startswith(("-", "0")) or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give memory that is free back to the system; idle Python workers would keep it while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, releasing memory once its task has ended."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return tidied


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words of a text as an array: lower-cased maximal runs without white space."""
    text = ascii_lower(F.coalesce(c, F.lit("")))
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def least_by_hash(df: DataFrame, key: str, limit: int, rows: int) -> DataFrame:
    """At most ``limit`` rows of ``df``, which has ``rows``: those of the least hash of ``key``.

    Rows of a hash that cannot be among them are left out before any sorting, so
    what a single task has to sort does not grow with the partitions.
    """
    share = min(1.0, 2.0 * limit / max(1, rows))
    hashed = F.xxhash64(key).bitwiseAND(F.lit((1 << 52) - 1))
    return df.where(hashed < int(share * (1 << 52)) + 1).orderBy(hashed, key).limit(limit)


def text_digest(c: Column) -> Column:
    """128 bits that tell rows of one id apart by their text; null counts as empty."""
    return F.md5(F.coalesce(c, F.lit("")).cast("binary"))


def fresh(columns, *names: str) -> list[str]:
    """Working names for columns that no column of the caller's table has."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
