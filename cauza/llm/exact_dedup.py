"""Exact deduplication by keyed streaming state on disk.

A stream of (digest, identifier, size, locator) rows runs through a stateful aggregation without a watermark, so its
state never expires; the state store is RocksDB, whose files lie in the checkpoint. For each digest the state retains
the document that stays (most code points, then smallest identifier), the locator of its content (file and row), and
the number of rows. Partial aggregation before the shuffle leaves one row for each digest and task, however hot a digest
is. Each arrival takes all data that has come and ends; the next one on the same checkpoint meets the state that is
there. exact_dedup() lets its rows arrive in ``arrivals`` parts.

A digest that the state has seen more than once is a hit, and hits are held against full bytes: the content that the
state's locator leads to, of the document that stays, is fetched and compared with those of the rows that arrived. A digest
whose rows have other bytes than that is a collision, and its documents are grouped by their bytes. Contents of documents
without a hit are never moved.

With a ``checkpoint`` the state outlives the call: a later call on it meets what earlier ones brought, counts it, and
compares its bytes, which it reads where the earlier documents lie (their files have to stay; documents that came from no
file are written below the checkpoint). A call adds its rows to the state, also if they were there before.

Two texts are equal when they are identical after every character of [\\x20\\x09-\\x0D] is deleted.

Defined cases: null text counts as empty, and empty texts equal each other; a null identifier orders after all
others; rows that repeat an identifier get a result row each, with the same values; an empty table gives no rows;
other columns of the input are not read, so that their names do not matter. A row that a state retains and whose file is
gone is an error. Of a digest that collides across calls, earlier rows are known by the retained one alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, shared_dir, written

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",  # an executor's; a store is open while its task runs
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else all of an executor's stores stay open until long after the query
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each state partition reserves megabytes of disk
}
KEYED = "digest string, id bigint, size bigint, locator string"
ARRIVALS = 2


def normal(text: Column) -> Column:
    """The text without white space; byte-wise replacement is far cheaper here than a regular expression."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\f\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


#: The file of a row and its number there.
WHERE = "concat_ws('#', _metadata.file_path, cast(_metadata.row_index AS string)) AS locator"


def located(docs: DataFrame, key: str, text: str, folder: str | None = None) -> DataFrame:
    """(id, text, locator): locator is the file and the number of the row in it. Rows that do not come from files are written to some first, below folder or in the shared one."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    if "_metadata" not in docs.columns:
        try:
            return docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.expr(WHERE))
        except AnalysisException:  # no file source below
            pass
    if folder is None:
        return written(rows, "dedup-contents").select("id", "text", F.expr(WHERE))
    rows.write.parquet(folder)
    return docs.sparkSession.read.schema(rows.schema).parquet(folder).select("id", "text", F.expr(WHERE))


def stateful(rows: DataFrame) -> DataFrame:
    """Of a stream with the columns KEYED: per digest, the document that stays and the number of rows so far."""
    # ~id orders identifiers downwards without overflow
    return rows.groupBy("digest").agg(F.max(F.struct("size", F.bitwise_not("id").alias("not_id"), "locator")).alias("best"), F.count(F.lit(1)).alias("rows"))


def run_available(spark: SparkSession, folder: str, checkpoint: str, per_trigger: int = 64 << 30) -> None:
    """Takes the Parquet files below folder that this checkpoint has not seen into the state, per_trigger bytes in each batch."""
    session = spark.newSession()  # the state store is set for this query alone
    for k, v in (ROCKSDB | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        session.conf.set(k, v)
    stream = session.readStream.schema(KEYED).option("maxBytesPerTrigger", str(per_trigger)).parquet(folder)
    query = stateful(stream).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, keep_id, locator, group_size."""
    state = spark.newSession().read.format("statestore").load(checkpoint)
    best = next(f.name for f in state.schema["value"].dataType.fields if f.dataType.typeName() == "struct")
    rows = next(f.name for f in state.schema["value"].dataType.fields if f.dataType.typeName() == "long")
    return state.select(F.col("key.digest").alias("digest"), F.bitwise_not(F.col(f"value.{best}.not_id")).alias("keep_id"), F.col(f"value.{best}.locator").alias("locator"), F.col(f"value.{rows}").alias("group_size"))


def contents(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (locator and other columns) with the content at each locator; rows of source that are not wanted are not shuffled."""
    found = among(source.select("locator", "text"), wanted, {"locator": F.col("locator")})
    return found.select("*", normal(F.col("text")).alias("content")).drop("text")


def earlier(spark: SparkSession, wanted: DataFrame, text: str) -> DataFrame:
    """wanted (locator, digest) of earlier calls with the content at each locator, read from their files."""
    files = [unquote(r.file) for r in wanted.select(F.regexp_replace("locator", r"#\d+$", "").alias("file")).distinct().collect()]  # as many as input files
    parts = []
    for own in (False, True):  # files of documents, and those that a call wrote
        some = [f for f in files if (f"/{CONTENTS}" in f) == own]
        if some:
            parts.append(contents(spark.read.parquet(*some).select(F.col("text" if own else text).alias("text"), F.expr(WHERE)), wanted))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


CONTENTS = "dedup-contents-"


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", digest: Callable[[Column], Column] = sha256, arrivals: int = ARRIVALS, per_trigger: int = 64 << 30, checkpoint: str | None = None) -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, text_sha256, text_hash (xxhash64 of the text as it is). checkpoint: a shared folder whose state the call meets and adds to; without one the state is the call's own."""
    spark = docs.sparkSession
    source = located(docs, key, text, checkpoint and f"{checkpoint}/{CONTENTS}{uuid.uuid4().hex}")
    content = source.select("id", "text", "locator", F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("size"), normal(F.col("text")).alias("content"))
    keyed = written(content.select(digest(F.col("content")).alias("digest"), "id", "size", "locator", sha256(F.col("content")).alias("sha"), F.xxhash64("text").alias("text_hash")), "dedup-keys")
    folder, held = (f"{checkpoint}/arrivals", f"{checkpoint}/state") if checkpoint else (shared_dir(spark, "dedup-arrivals"), shared_dir(spark, "dedup-state"))
    for part in range(arrivals):
        keyed.filter(F.pmod(F.xxhash64("locator"), F.lit(arrivals)) == part).select("digest", "id", "size", "locator").write.mode("append").parquet(folder)
        run_available(spark, folder, held, per_trigger)
    state = written(read_state(spark, held), "dedup-classes")

    rows = keyed.drop("size").join(state.withColumnRenamed("locator", "retained"), "digest")
    hits = rows.filter("group_size > 1")
    found = contents(source, hits.select("locator", "digest", "id", "sha", "text_hash", "retained"))
    bytes_of = found.select("digest", "content", (F.col("locator") == F.col("retained")).alias("stays"))
    if checkpoint:  # what stays may have come earlier
        before = written(hits.select(F.col("retained").alias("locator"), "digest").distinct().join(keyed.select("locator"), "locator", "left_anti"), "dedup-earlier")
        if not before.isEmpty():
            bytes_of = bytes_of.unionByName(earlier(spark, before, text).select("digest", "content", F.lit(True).alias("stays")))
    compared = written(bytes_of.groupBy("digest").agg(F.min("content").alias("a"), F.max("content").alias("b"), F.max(F.when(F.col("stays"), F.col("content"))).alias("stays")).select("digest", F.col("stays").isNull().alias("gone"), ((F.col("a") != F.col("stays")) | (F.col("b") != F.col("stays"))).alias("unlike")), "dedup-compared")
    if not compared.filter("gone").isEmpty():
        raise RuntimeError("the content at a locator of the state is gone")
    collided = written(compared.filter("unlike").select("digest"), "dedup-collisions")
    out = [F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "text_hash"]
    if collided.isEmpty():
        return rows.select(*out)
    apart = found.drop("retained").join(collided, "digest", "left_semi").join(keyed.select("locator", "size"), "locator")
    best = apart.groupBy("digest", "content").agg(F.max(F.struct("size", F.bitwise_not("id").alias("not_id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    fixed = apart.join(best, ["digest", "content"]).withColumn("keep_id", F.bitwise_not("best.not_id"))
    return rows.join(collided, "digest", "left_anti").select(*out).unionByName(fixed.select(*out))


SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS content FROM documents),
g AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY content ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size, sha256(content) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
