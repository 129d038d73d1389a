"""What the operators share: tables in a folder that all executors see, and Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made by this process; clean() removes what a result no longer needs.
_made: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir. Without that setting: a temporary folder in local mode, else an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isEmpty():
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="cauza-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            sc.setCheckpointDir("file://" + folder)
            now = sc._jsc.sc().getCheckpointDir()
        base = now.get()
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df after a round trip through a Parquet table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cauza_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | str) -> None:
    """Removes tables made by written(), or folders, that nothing reads any more."""
    spark = SparkSession.getActiveSession()
    for table in tables:
        path = table if isinstance(table, str) else table.cauza_path
        _remove(spark, path)
        if path in _made:
            _made.remove(path)


def clean(spark: SparkSession) -> None:
    """Removes every folder that is left. Results that were not written elsewhere cannot be read after it."""
    while _made:
        _remove(spark, _made.pop())


def _give_back() -> None:
    """Returns freed memory to the system. Workers live on between tasks, and what they keep counts beside the JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """A function over batches whose worker gives its memory back when a task ends."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return out


def give_back(spark: SparkSession) -> None:
    """Has each executor's JVM collect its garbage, so that it returns the heap that earlier work made it take: as many tasks as cores, which the scheduler deals to all that are idle."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each string, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 8 << 20):
    """Runs of rows of about most_bytes of text, so that Python objects stay few; a longer single row stands alone."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


#: Bits of the filter that keeps rows from being shuffled, whatever the data: 1 MB for documents, 8 MB for lines. Executors hold a filter for a while after its use.
FILTER_BITS, LINE_BITS = 1 << 23, 1 << 26


def split_by_filter(rows: DataFrame, keys: dict[str, Column], some: DataFrame, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows surely not in some, the rest): some has the columns keys. A bitmap of hashes is broadcast; it only saves shuffling, a row in the second part may still not be in some."""
    tag = uuid.uuid4().hex  # of column names, so that they meet no others
    bucket, place, bits = f"bucket_{tag}", f"place_{tag}", f"bits_{tag}"
    spot = lambda of: F.pmod(F.xxhash64(*of), F.lit(filter_bits)) + 1
    marks = some.select(spot([F.col(k) for k in keys]).alias("x")).groupBy(F.bitmap_bucket_number("x").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias(bits))
    marks = written(marks, "filter")
    own = list(keys.values())
    both = rows.withColumns({bucket: F.bitmap_bucket_number(spot(own)), place: F.bitmap_bit_position(spot(own))}).join(F.broadcast(marks), bucket, "left")
    byte = f"cast(conv(hex(substring({bits}, cast({place} div 8 + 1 as int), 1)), 16, 10) as int)"
    hit = F.coalesce(F.expr(f"shiftright({byte}, cast({place} % 8 as int)) & 1") == 1, F.lit(False))
    names = [F.col(f"`{c}`") for c in rows.columns]
    return both.filter(~hit).select(names), both.filter(hit).select(names)


def _equal(keys: dict[str, Column], other: DataFrame, names: dict[str, str]) -> Column:
    cond = F.lit(True)
    for k, n in names.items():
        cond = cond & keys[k].eqNullSafe(other[n])
    return cond


def leave(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of docs whose keys (names in gone to expressions over docs) are not in gone. Only rows that the bitmap cannot rule out are shuffled."""
    safe, asked = split_by_filter(docs, keys, gone)
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    other = gone.select(*(F.col(k).alias(n) for k, n in names.items()))
    return safe.unionByName(asked.join(other, _equal(keys, other, names), "left_anti"))


def among(docs: DataFrame, some: DataFrame, keys: dict[str, Column], filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of docs whose keys are in some, with the other columns of some. Only rows that the bitmap cannot rule out are shuffled."""
    _, asked = split_by_filter(docs, keys, some, filter_bits)
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    other = some.select(*(F.col(k).alias(n) for k, n in names.items()), *(c for c in some.columns if c not in keys))
    return asked.join(other, _equal(keys, other, names)).drop(*names.values())
