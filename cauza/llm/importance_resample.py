"""Draws documents so that their hashed n-grams come to lie as those of a target: importance resampling.

Features are the runs of 1 to ``n`` consecutive words of a text, words being runs of ASCII letters, digits and characters
beyond ASCII, A-Z in lower case. A feature's bucket is the CRC-32 of its bytes, modulo ``buckets``.

Each batch of a partition numbers its words and sorts the suffixes of its texts, cut at ``n`` words, by these numbers.
The common prefixes of neighbours make runs: k words that start a run of suffixes are one n-gram, however often it
repeats. It is put together and hashed once, and its bucket goes back to all the places of the run.

A first pass counts buckets over all documents and over the target (s of S, t of T features); a task returns its counts
once. The gain of a bucket is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), so that ``buckets`` numbers
are all that the second pass takes along. The weight of a document is the mean gain of its features, floored, and its
score the weight plus Gumbel noise floor(-1000 ln(-ln((h + 0.5) / 2^32))), where h is the first 8 hexadecimal digits of
the SHA-256 of "<seed>:<key>". The highest scores win: a draw without replacement in proportion to exp(weight / 1000).

Scores are whole numbers of fewer than 220,000 values, whatever the data (gains lie within 1000 ln 2^126, noise between
-3,200 and 23,000), so that the counts of documents by score fit the driver. They tell every score's first rank; ranks
inside a score come from its own documents, which the noise keeps to 0.04 % of all.

Defined cases: null text has no features, weight 0; so has text without words; only texts of ``least_words`` words or more
are drawn or counted; ties go to the smaller key, then to fewer features; a null key hashes as an empty one and comes
last in ties; repeated rows are documents of their own; an empty target or table is no error. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import among, as_bytes, lean, slices, written

N, BUCKETS, LEAST_WORDS, SHARE, SEED = 1, 10_000, 20, 10, 2024
PIECE = 2 << 20

#: Bytes of words in lower case, others as spaces.
TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


class Words:
    """Numbers of words, from 1 in the order of first use."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def numbers(self, text: bytes, piece: int = PIECE) -> np.ndarray:
        """The words of a text; a long one is read in pieces that end at a space."""
        text, known, out, at = text.translate(TABLE), self.known, [], 0
        while at < len(text):
            end = len(text)
            if end - at > piece:
                end = text.rfind(b" ", at, at + piece) + 1 or text.find(b" ", at + piece) + 1 or len(text)
            words = text[at:end].split()
            out.append(np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int32, len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def spelled(self) -> list[bytes]:
        return [b"", *self.known]


def suffix_array(ids: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ids, cut at n numbers and at the text's end (left: numbers from here to it), and each one's common prefix with the one before it."""
    padded = np.r_[ids, np.zeros(n, ids.dtype)]
    columns = [np.where(left > k, padded[k : k + len(ids)], 0) for k in range(n)]
    order = np.lexsort(columns[::-1])
    lcp = np.zeros(len(ids), np.int64)
    alike = np.ones(max(0, len(ids) - 1), bool)
    for c in columns:
        c = c[order]
        alike &= c[1:] == c[:-1]
        lcp[1:] += alike
    return order, lcp


def bucket_runs(ids: np.ndarray, left: np.ndarray, spelled: list[bytes], n: int, buckets: int):
    """For each length k up to n: (places, bucket of the k words that start there), each distinct n-gram hashed once."""
    order, lcp = suffix_array(ids, left, n)
    for k in range(1, n + 1):
        long = left[order] >= k
        places, run = order[long], np.cumsum(lcp < k)[long]
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else run
        values = [zlib.crc32(b" ".join([spelled[i] for i in ids[p : p + k].tolist()])) % buckets for p in places[first].tolist()]
        yield places, np.repeat(np.array(values, np.int64), np.diff(np.r_[first, len(run)]))


def featured(texts: list[bytes], n: int, buckets: int, piece: int = PIECE):
    """Number of words of each text, and for each length of n-grams (text of each place, its bucket)."""
    words = Words()
    found = [words.numbers(t, piece) for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    ids = np.concatenate([np.zeros(0, np.int32), *found])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
    owner = np.repeat(np.arange(len(texts)), sizes)
    return sizes, [(owner[places], bucket) for places, bucket in bucket_runs(ids, left, words.spelled(), n, buckets)]


def bucket_counts(docs: DataFrame, text: str = "text", n: int = N, buckets: int = BUCKETS, piece: int = PIECE) -> np.ndarray:
    """How many features of all documents lie in each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0, piece):
                for _, bucket in featured(as_bytes(part.column(0)), n, buckets, piece)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(lean(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one for each bucket at most
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    up, down = float(own.sum() + len(own)), float(target.sum() + len(own))
    return np.array([math.floor(1000 * math.log((t + 1.0) * up / ((s + 1.0) * down))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id", n: int = N, piece: int = PIECE) -> DataFrame:
    """(key, n_words, n_features, weight) of each row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, piece):
                sizes, found = featured(as_bytes(part.column(1)), n, len(gain), piece)
                count, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                for owner, bucket in found:
                    count += np.bincount(owner, minlength=len(sizes))
                    np.add.at(total, owner, gain[bucket])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(count), pa.array(total // np.maximum(count, 1))], [key, "n_words", "n_features", "weight"])

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {dict(docs.dtypes)[key]}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """(key, n_features, weight, score, rank) of each row; rank is null unless the row is among the floor(share N / 100) drawn of N long ones."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text, n, buckets, piece), bucket_counts(target, text, n, buckets, piece))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = written(weighed(docs, gain, text, key, n, piece).withColumn("score", (F.col("weight") + noise).cast("long")), "scores")
    by_score = scored.filter(F.col("n_words") >= least_words).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded, see above
    left, before, starts = share * sum(r.n for r in by_score) // 100, 0, []
    for r in sorted(by_score, key=lambda r: -r.score):
        if before >= left:
            break
        starts.append((r.score, before))
        before += r.n
    known = spark.createDataFrame(starts, "score bigint, before bigint")
    asked = scored.join(F.broadcast(known), "score", "left").withColumn("before", F.when(F.col("n_words") >= least_words, F.col("before")))
    inside = F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last(key), "n_features", "weight"))
    drawn = asked.filter("before is not null").withColumn("rank", F.col("before") + inside).withColumn("rank", F.when(F.col("rank") <= left, F.col("rank")))
    rest = asked.filter("before is null").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(key, "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that a draw takes, with all their columns; keys are taken as unique."""
    found = written(resample(docs, target, key=key, **options).filter("rank is not null").select(key), "drawn")
    return among(docs, found, {key: F.col(key)})


SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
a AS (SELECT FALSE AS target, doc_id AS id, text FROM documents UNION ALL SELECT TRUE, item_id, text FROM benchmark),
w AS (SELECT target, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM a),
u AS (SELECT target, id, unnest(words) AS word FROM w),
x AS (SELECT word, hex(encode(word)) AS h, t FROM (SELECT DISTINCT word FROM u), tab),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255)::INTEGER + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM x),
n AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM u JOIN b ON u.word = b.word GROUP BY bucket),
m AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS gain FROM n, m),
f AS (SELECT id, count(*) AS n_features, sum(gain) AS total FROM u JOIN b ON u.word = b.word JOIN g ON b.bucket = g.bucket WHERE NOT target GROUP BY id),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT::DOUBLE AS h FROM documents LEFT JOIN f ON doc_id = id),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, (SELECT 10 * count(*) // 100 FROM e WHERE n_features >= 20) AS most FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= most THEN place END AS rank FROM r
"""
