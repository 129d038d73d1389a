"""Audit of sources: how far the terms of each source of a language lie from those of its other sources and of the whole.

Terms are runs of ASCII letters, A-Z in lower case, and of characters beyond ASCII. A lookup table over the joined UTF-8
bytes of many texts finds their boundaries at once, XXH64 groups the slices between them, and each slice is compared with
its group's first one byte by byte; groups with unlike slices are dealt out anew by their bytes. Tasks give counts of
(language, source, term), which Spark sums.

A language keeps the terms of ``least_docs`` or more of its documents. A group (language, source) with N occurrences of
kept terms gives each of the V kept terms the share p = 1 + floor(10^9 (count + smoothing) / (N + smoothing V)). The kept
terms of a language are dealt to parts by hash, as many as its number of counts asks for, so that a task holds a matrix of
``PART`` counts or so: sources as rows, terms as columns, in compressed rows. Sums of |p - q| along rows are reductions of
slices of the compressed values; columns that a row does not hold enter by their number, as their share is the same.
Everything is integers: shares by long division, exact up to N + smoothing V of 9 * 10^15.

Result, a row for each (lang, source, part, item): part "pair" has the other sources of the language with the sum of
|p - q| over all kept terms; part "term" the ``top`` kept terms that the source holds more often than its language.

Defined cases: null text, language and source are empty strings; a group without terms, and one of a language that keeps
none (pairs of value 0), is there all the same; a source alone in its language has no pairs; repeated rows count as often
as they occur; ties go to the lesser item by UTF-8; an empty table gives no rows; identifiers and other columns are not
read. A text of any length is read in pieces that end between terms.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, lean, slices, written

LEAST_DOCS, SMOOTHING, TOP = 30, 5, 50
#: Counts in a task's matrix, and bytes of text that are looked at together.
PART, PIECE = 20_000, 2 << 20

#: Each byte's place in a term: itself, its lower case, or 0 outside of terms.
LOOKUP = np.arange(256, dtype=np.uint8)
LOOKUP[65:91] += 32
LOOKUP[:128][[chr(i) not in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" for i in range(128)]] = 0


def pieces(text: bytes, most: int):
    """The text in runs of ``most`` bytes or so, cut between terms; a term that is longer stays whole."""
    at = 0
    while len(text) - at > most:
        outside = np.flatnonzero(LOOKUP[np.frombuffer(text, np.uint8, most, at)] == 0)
        end = at + most if not len(outside) else at + int(outside[-1]) + 1
        if not len(outside):
            while end < len(text) and LOOKUP[text[end]]:
                end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def boundaries(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes in lower case, and (start, end, number of the text) of each term in them."""
    low = LOOKUP[np.frombuffer(b"".join(texts), np.uint8)]
    first = np.cumsum([0, *map(len, texts)])
    inside, fresh = np.zeros(len(low) + 2, bool), np.zeros(len(low) + 1, bool)
    inside[1:-1], fresh[first] = low != 0, True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | fresh))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | fresh))
    return low, start, end, np.searchsorted(first, start, "right") - 1


def grouped(low: np.ndarray, start: np.ndarray, end: np.ndarray, digest: Callable[[bytes], int] | None = None) -> tuple[list[bytes], np.ndarray]:
    """The distinct slices, and the number of each slice among them: equal hashes first, then equal bytes."""
    from xxhash import xxh64_intdigest

    digest, data = digest or xxh64_intdigest, low.tobytes()
    values = np.fromiter((digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    _, chief, place = np.unique(values, return_index=True, return_inverse=True)
    size = end - start
    same = size == size[chief][place]
    some = np.flatnonzero(same)
    length = size[some]
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    unlike = low[np.repeat(start[some], length) + step] != low[np.repeat(start[chief][place[some]], length) + step]
    same[np.repeat(some, length)[unlike]] = False
    terms = [data[a:b] for a, b in zip(start[chief].tolist(), end[chief].tolist(), strict=True)]
    if not same.all():  # a collision: these slices by their bytes
        known = {t: i for i, t in enumerate(terms)}
        for i in np.flatnonzero(~same).tolist():
            place[i] = known.setdefault(data[start[i] : end[i]], len(known))
        terms = list(known)
    return terms, place


def counted(texts: list[bytes], groups: np.ndarray, digest: Callable[[bytes], int] | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and (group, number of the term, occurrences, texts that hold it) for texts that lie in groups."""
    low, start, end, owner = boundaries(texts)
    terms, place = grouped(low, start, end, digest)
    held, n = np.unique(owner * max(1, len(terms)) + place, return_counts=True)
    owner, place = held // max(1, len(terms)), held % max(1, len(terms))
    both, at, docs = np.unique(groups[owner] * max(1, len(terms)) + place, return_inverse=True, return_counts=True)
    return terms, both // max(1, len(terms)), both % max(1, len(terms)), np.bincount(at, n, len(both)).astype(np.int64), docs


COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", piece: int = PIECE) -> DataFrame:
    """COUNTS: occurrences of each term in each group and the documents that hold it; each group also has a row with a null term."""

    def rows(names, terms, group, place, n, found):
        langs, sources = pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.string())
        marks = pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(names), pa.string()), *[pa.array(np.zeros(len(names), np.int64))] * 2], ["lang", "source", "term", "n", "docs"])
        at = pa.array(group)
        return [marks, pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(place)), pa.array(n), pa.array(found)], ["lang", "source", "term", "n", "docs"])]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, piece):
                known: dict[tuple, int] = {}
                own = [known.setdefault(x, len(known)) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                texts = as_bytes(part.column(2))
                if len(texts) == 1 and len(texts[0]) > piece:
                    held: dict[bytes, int] = {}
                    for some in pieces(texts[0], piece):
                        terms, _, place, n, _ = counted([some], np.zeros(1, np.int64))
                        for i, k in zip(place.tolist(), n.tolist(), strict=True):
                            held[terms[i]] = held.get(terms[i], 0) + k
                    every = np.arange(len(held))
                    yield from rows(known, list(held), 0 * every, every, np.array(list(held.values()), np.int64), 0 * every + 1)
                else:
                    yield from rows(known, *counted(texts, np.array(own, np.int64)))

    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    return own.mapInArrow(lean(run), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total, kept, smoothing: int = SMOOTHING) -> np.ndarray:
    """1 + floor(10^9 (n + smoothing) / (total + smoothing kept)), three digits at a time."""
    rest, by, out = n + smoothing, total + smoothing * kept, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return out + 1


class Matrix:
    """Counts of sources (rows) and terms (columns) in compressed rows, with their shares."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n: np.ndarray, totals: np.ndarray, kept: int, columns: int, smoothing: int = SMOOTHING):
        by = np.lexsort((column, row))
        self.row, self.column, self.n, self.columns = row[by], column[by], n[by], columns
        self.starts = np.searchsorted(self.row, np.arange(len(totals) + 1))
        self.p = shares(self.n, totals[self.row], kept, smoothing)
        self.absent = shares(np.zeros(len(totals), np.int64), totals, kept, smoothing)
        sums = np.bincount(self.column, minlength=columns) * 0
        np.add.at(sums, self.column, self.n)
        self.whole = shares(sums, int(totals.sum()), kept, smoothing)

    def along(self, values: np.ndarray) -> np.ndarray:
        """Sums of values by row."""
        out = np.add.reduceat(np.append(values, 0), self.starts[:-1])
        return np.where(self.starts[1:] > self.starts[:-1], out, 0)

    def distances(self, a: int) -> np.ndarray:
        """Sum of |p - q| over all columns, between row a and each row."""
        own = slice(self.starts[a], self.starts[a + 1])
        line, held = np.full(self.columns, self.absent[a]), np.zeros(self.columns, bool)
        line[self.column[own]], held[self.column[own]] = self.p[own], True
        both = held[self.column]
        seen = line[self.column]
        of_other = self.along(np.abs(self.p - seen))
        # columns of a alone: all of a's against the other's absent share, without those that the other holds
        values = np.sort(self.p[own])
        below = np.searchsorted(values, self.absent)
        sums = np.r_[0, np.cumsum(values)]
        of_a = sums[-1] - 2 * sums[below] - self.absent * (len(values) - 2 * below) - self.along(np.where(both, np.abs(seen - self.absent[self.row]), 0))
        neither = self.columns - len(values) - np.diff(self.starts) + self.along(both.astype(np.int64))
        return of_other + of_a + neither * np.abs(self.absent - self.absent[a])


PAIRS = "lang string, source string, part string, item string, value bigint"


def _matrix_rows(smoothing: int, top: int):
    """A function from a part's counts (lang, source, term, n) and its language's sources (lang, source, total, kept) to rows of PAIRS: sums of this part's terms for sources in order, and each source's best terms here."""

    def run(counts: pa.Table, sources: pa.Table) -> pa.Table:
        names = sources.column("source").combine_chunks()
        totals = sources.column("total").to_numpy()
        kept, lang = sources.column("kept")[0].as_py(), sources.column("lang")[0].as_py()
        out = []
        if kept:
            terms = counts.column("term").combine_chunks().dictionary_encode()
            row = pc.index_in(counts.column("source").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
            column = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            m = Matrix(row, column, counts.column("n").to_numpy().astype(np.int64), totals.astype(np.int64), kept, len(terms.dictionary), smoothing)
        for a in range(len(names)):
            value = m.distances(a)[a + 1 :] if kept else np.zeros(len(names) - a - 1, np.int64)
            out.append((a, "pair", names.slice(a + 1), value))
            if kept:
                own = slice(m.starts[a], m.starts[a + 1])
                gap = m.p[own] - m.whole[m.column[own]]
                best = np.flatnonzero(gap > 0)
                if len(best) > top:  # and all that tie with the last
                    best = best[gap[best] >= -np.partition(-gap[best], top - 1)[top - 1]]
                item = terms.dictionary.take(pa.array(m.column[own][best]))
                order = sorted(range(len(best)), key=lambda i: (-gap[best[i]], item[i].as_py().encode()))[:top]
                out.append((a, "term", item.take(pa.array(order, pa.int64())), gap[best][order]))
        sizes = [len(v) for _, _, _, v in out]
        source = names.take(pa.array(np.repeat([a for a, *_ in out], sizes).astype(np.int64)))
        return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": source, "part": pa.array(np.repeat([p for _, p, _, _ in out], sizes).tolist(), pa.string()), "item": pa.concat_arrays([i for _, _, i, _ in out]), "value": pa.array(np.concatenate([v for *_, v in out]).astype(np.int64))})

    return run


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, smoothing: int = SMOOTHING, top: int = TOP, part: int = PART, piece: int = PIECE) -> DataFrame:
    """(lang, source, part, item, value, rank) as above."""
    counts = written(term_counts(docs, text, lang, source, piece), "audit-counts")
    groups = counts.filter("term is null").select("lang", "source")
    kept = written(counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term"), "audit-kept")
    entries = written(counts.filter("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "audit-entries")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left").join(entries.groupBy("lang").agg(F.count(F.lit(1)).alias("entries")), "lang", "left")
    # a part's sums are as many as pairs of sources, so that parts grow with these
    langs = langs.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.greatest(F.lit(1), F.ceil(F.coalesce("entries", F.lit(0)) / F.greatest(F.lit(part), F.col("sources") * F.col("sources")))).cast("int").alias("parts"))
    langs = written(langs, "audit-languages")
    totals = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang")
    rows = totals.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    cells = entries.join(langs.select("lang", "parts"), "lang").select("lang", F.pmod(F.xxhash64("term"), "parts").cast("int").alias("p"), "source", "term", "n")
    found = written(cells.groupBy("lang", "p").cogroup(rows.groupBy("lang", "p")).applyInArrow(_matrix_rows(smoothing, top), PAIRS), "audit-parts")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("w")
    pairs = pairs.select("lang", "part", ways, "value").select("lang", "w.source", "part", "w.item", "value")
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(found.filter("part = 'term'")).filter(F.col("rank") <= top))


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
u AS (SELECT lang, source, unnest(words) AS term FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM u GROUP BY ALL),
dd AS (SELECT lang, unnest(list_distinct(words)) AS term FROM d),
kept AS (SELECT lang, term FROM dd GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
t AS (SELECT lang, source, sum(n) AS total, count(*) AS kept FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 5)) // (t.total + 5 * t.kept)::HUGEINT AS p FROM c JOIN t ON c.lang = t.lang AND c.source = t.source),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
lt AS (SELECT lang, sum(n) AS total, count(*) AS kept FROM l GROUP BY ALL),
q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n::HUGEINT + 5)) // (lt.total + 5 * lt.kept)::HUGEINT AS q FROM l JOIN lt ON l.lang = lt.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
