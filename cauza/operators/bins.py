"""Bins of features: few-valued ones by a plan, others by a greedy scan over sorted values with counts, categories by frequency.

Zero has a bin of its own, bins include their upper bound, the last is infinite, NaN comes after it.

The scan is exact at any size, although no task or driver holds a feature's values. It runs on the driver over cells:
ranges between approximate quantiles, ``parts`` of them at first, with their least and greatest value and their rows.
A cell of one value is that value. A bound that falls behind a whole cell for certain is exact, as both neighbours of it
are known; a cell inside which a bound may fall is open, and so is one that could hold a value above the mean count. Rows of
open cells, a few for each bound, are kept apart and cut anew, until no cell that decides anything is open.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

ZERO = 1e-35  # fixed value: how far the bin of zero reaches on either side
PARTS = 1024
BOUNDS = "cauza.bounds"


def value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, n) of all features in one pass; NaN as null."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    rows = df.select(F.explode(pairs).alias("p")).select("p.feature", F.when(~F.isnan("p.value"), F.col("p.value")).alias("value"))
    return rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def small_bounds(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, bin, bound): midpoints between neighbouring values."""
    by = W.partitionBy("feature").orderBy("value")
    v = value_counts(df, features).filter("value is not null")
    return v.select("feature", (F.row_number().over(by) - 1).alias("bin"), F.coalesce((F.col("value") + F.lead("value").over(by)) / 2, F.lit(float("inf"))).alias("bound"))


def _after(x: np.ndarray | float) -> np.ndarray | float:
    return np.nextafter(x, np.inf)


class Cells:
    """Sorted ranges of a feature's values: least and greatest value, rows. Values that follow each other without one between count as one, the larger."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: np.ndarray, first: np.ndarray | None = None, start: np.ndarray | None = None):
        self.low, self.high, self.n = low, high, n
        self.first = np.arange(len(n) + 1) if first is None else first  # of the cells that these were made of
        self.start = low if start is None else start  # least value before values were joined

    @property
    def single(self) -> np.ndarray:
        return self.low == self.high

    def __len__(self) -> int:
        return len(self.n)

    def __getitem__(self, part: slice) -> Cells:
        start, stop, _ = part.indices(len(self))
        return Cells(self.low[part], self.high[part], self.n[part], self.first[start : stop + 1], self.start[part])

    def merged(self) -> Cells:
        """Neighbouring single values without a number between them joined."""
        if len(self) < 2:
            return self
        single = self.single
        start = np.flatnonzero(np.r_[True, ~((self.low[1:] <= _after(self.high[:-1])) & single[1:] & single[:-1])])
        end = np.r_[start[1:], len(self)] - 1
        low = np.where(single[end], self.low[end], self.low[start])
        return Cells(low, self.high[end], np.add.reduceat(self.n, start), np.r_[self.first[start], self.first[-1]], self.low[start])


def greedy(cells: Cells, most: int, least_rows: int) -> tuple[list[float], set[int]]:
    """Upper bounds of at most ``most`` bins of about equal counts, values above the mean count alone; and the open cells. Without any, the bounds are those of the values themselves."""
    size, single, n = len(cells), cells.single, cells.n
    if not size:
        return [], set()
    opened: set[int] = set()
    ends: list[int] = []
    near = np.r_[cells.start[1:] <= _after(cells.high[:-1]), False] if size > 1 else np.zeros(1, bool)  # not told apart yet
    if size <= most:
        opened.update(np.flatnonzero(~single).tolist())
        held = 0
        for i in range(size - 1):
            held += n[i]
            if held >= least_rows:
                ends.append(i)
                held = 0
    else:
        most = max(1, min(most, int(n.sum()) // least_rows)) if least_rows > 0 else most
        mean = n.sum() / most
        opened.update(np.flatnonzero((n >= mean) & ~single).tolist())
        run = np.cumsum(np.r_[0, ~near[:-1]])
        together = np.bincount(run, n)[run] >= mean  # may turn out to be one frequent value
        opened.update(np.flatnonzero(together & (np.bincount(run)[run] > 1)).tolist())
        big = (n >= mean) & single
        rest_bins, rest = most - int(big.sum()), n[~big].sum()
        mean = rest / max(1, rest_bins)
        held, left = 0, rest
        for i in range(size - 1):
            left -= 0 if big[i] else n[i]
            held += n[i]
            if big[i] or held >= mean or (big[i + 1] and held >= max(1.0, mean * 0.5)):
                if not single[i] and held >= mean:
                    opened.update((i, max(0, i - 1)))  # the end may lie inside; when it is known, later ones lie a little earlier
                ends.append(i)
                held = 0
                if len(ends) >= most - 1:
                    break
                if not big[i]:
                    rest_bins -= 1
                    mean = left / max(1, rest_bins)
        if not single[-1] and len(ends) < most - 1 and held + n[-1] >= mean:
            opened.update((size - 1, max(0, size - 2)))
    bounds: list[float] = []
    for i in ends:
        if near[i]:
            opened.update((i, i + 1))
        if not single[i + 1] or near[i + 1]:  # its first value may yet grow
            opened.update((i + 1, min(i + 2, size - 1)) if single[i + 1] else (i + 1,))
        b = float(_after((cells.high[i] + cells.low[i + 1]) / 2))
        if not bounds or b > _after(bounds[-1]):
            bounds.append(b)
    made = [k for i in opened for k in range(cells.first[i], cells.first[i + 1])]
    return [*bounds, float("inf")], set(made)


def _around_zero(cells: Cells, max_bin: int, least_rows: int) -> tuple[list[float], set[int]]:
    """Negatives, zero and positives apart."""
    low, high = int(np.searchsorted(cells.high, -ZERO, "left")), int(np.searchsorted(cells.low, ZERO, "right"))
    n_low, n_zero, n_high = cells.n[:low].sum(), cells.n[low:high].sum(), cells.n[high:].sum()
    bounds: list[float] = []
    opened: set[int] = set()
    if n_low:
        share = max(1, int(n_low / max(1, n_low + n_high) * (max_bin - 1)))
        bounds, opened = greedy(cells[:low], share, least_rows)
        bounds[-1] = -ZERO
    if n_high:
        room = max_bin - 1 - len(bounds) - (1 if n_zero or n_low else 0)
        upper, more = greedy(cells[high:], max(1, room), least_rows)
        bounds, opened = bounds + ([ZERO] if n_zero or n_low else []) + upper, opened | more
    else:
        bounds.append(float("inf"))
    return bounds, opened


def _around_forced(cells: Cells, max_bin: int, least_rows: int, forced: Sequence[float]) -> tuple[list[float], set[int]]:
    """Bounds around zero and the forced ones, as far as there is room; what is left goes to the gaps between them by their rows."""
    fixed = [float("inf")]
    if max_bin == 2:
        fixed.append(-ZERO if len(cells) and cells.low[0] < -ZERO else ZERO)
    elif max_bin > 2 and len(cells):
        fixed += [-ZERO] * bool(cells.low[0] < -ZERO) + [ZERO] * bool(cells.high[-1] > ZERO)
    fixed = sorted(fixed + [float(b) for b in dict.fromkeys(forced) if abs(b) > ZERO][: max(0, max_bin - len(fixed))])
    free, whole = max_bin - len(fixed), max(1, int(cells.n.sum()))
    added: list[float] = []
    opened: set[int] = set()
    start = 0
    for b in fixed:
        stop = int(np.searchsorted(cells.high, b, "left"))
        left = free - len(added)
        share = left if b == fixed[-1] else min(left, int(np.floor(cells.n[start:stop].sum() * free / whole + 0.5)))
        found, more = greedy(cells[start:stop], share + 1, least_rows)
        added, opened, start = added + found[:-1], opened | more, stop
    return sorted(fixed + added), opened


def scan(cells: Cells, max_bin: int, least_rows: int, forced: Sequence[float] = ()) -> tuple[list[float], set[int]]:
    """Bounds of one feature, and the cells that have to be cut before they are exact."""
    cells = cells.merged()
    return _around_forced(cells, max_bin, least_rows, forced) if len(forced) else _around_zero(cells, max_bin, least_rows)


def feature_bounds(values: np.ndarray, counts: np.ndarray, max_bin: int = 64, least_rows: int = 10, forced: Sequence[float] = ()) -> list[float]:
    """Bounds of one feature from all of its values, max_bin at most; NaN apart."""
    order = np.argsort(values, kind="stable")
    return scan(Cells(values[order], values[order], counts[order]), max_bin, least_rows, forced)[0]


def _cuts(found: Sequence[float] | None) -> np.ndarray:
    """Ends of ranges from approximate quantiles: what lies below a frequent value, of more rows than a range, gets one of its own."""
    q = np.array(found or [], float)
    return np.unique(np.concatenate([q, np.nextafter(q[1:][q[1:] == q[:-1]], -np.inf)]))


def _count(rows: DataFrame, ends: list[np.ndarray]) -> list[Cells]:
    """Cells of each feature i, from rows (i, value): ranges that end at ends[i], both ends' values and rows counted; empty ones left out."""

    def run(parts):
        held = [(np.zeros(len(e) + 1, np.int64), np.full(len(e) + 1, np.inf), np.full(len(e) + 1, -np.inf)) for e in ends]
        for pdf in parts:
            which, value = pdf["i"].to_numpy(), pdf["value"].to_numpy()
            for i in np.unique(which).tolist():
                x = value[which == i]
                at = np.searchsorted(ends[i], x, side="left")
                n, low, high = held[i]
                n += np.bincount(at, minlength=len(n))
                np.minimum.at(low, at, x)
                np.maximum.at(high, at, x)
        for i, (n, low, high) in enumerate(held):
            at = np.flatnonzero(n)
            yield pd.DataFrame({"i": np.full(len(at), i), "at": at, "n": n[at], "low": low[at], "high": high[at]})

    counted = rows.mapInPandas(run, "i int, at int, n bigint, low double, high double").groupBy("i", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    parts = [counted[counted["i"] == i].sort_values("at") for i in range(len(ends))]
    return [Cells(*(p[c].to_numpy() for c in ("low", "high", "n"))) for p in parts]


def fit_bins(df: DataFrame, features: Sequence[str], max_bin: int = 64, least_rows: int = 10, forced: dict | None = None, parts: int = PARTS) -> dict[str, list[float]]:
    """Exact bounds of each feature. The driver holds ``parts`` cells of a feature, and as many again for each one that a bound opens."""
    forced = forced or {}
    steps = [k / parts for k in range(1, parts)]
    clean = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    found = df.agg(*(F.percentile_approx(c, steps, 2 * parts).alias(f"q{i}") for i, c in enumerate(clean))).first()
    ends = [np.unique(np.concatenate([_cuts(found[f"q{i}"]), np.nextafter(np.array([-ZERO, *(forced.get(f) or ())], float), -np.inf), [ZERO]])) for i, f in enumerate(features)]
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), c.alias("value")) for i, c in enumerate(clean)))
    every = rows = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null")
    cells, held = _count(rows, ends), None
    while True:
        scanned = [scan(c, max_bin, least_rows, forced.get(f) or ()) for f, c in zip(features, cells, strict=True)]
        opened = [np.array([k for k in sorted(o) if c.low[k] < c.high[k]], int) for (_, o), c in zip(scanned, cells, strict=True)]
        if not any(map(len, opened)):
            return {f: bounds for f, (bounds, _) in zip(features, scanned, strict=True)}
        asked = [(c.low[k], c.high[k]) for c, k in zip(cells, opened, strict=True)]
        if held is None or not all(map(_covered, asked, held)):
            rows = every
        rows, held = checkpointed(_inside(rows, asked)), asked
        found = rows.groupBy("i", "cell").agg(F.percentile_approx("value", steps, 2 * parts).alias("q")).collect()  # a row for each open cell
        fresh = _count(rows, [np.unique(np.concatenate([c.high[k], *(_cuts(r.q) for r in found if r.i == i)])) for i, (c, k) in enumerate(zip(cells, opened, strict=True))])
        for i, (c, k, new) in enumerate(zip(cells, opened, fresh, strict=True)):
            low, high, n = (np.concatenate([np.delete(a, k), b]) for a, b in ((c.low, new.low), (c.high, new.high), (c.n, new.n)))
            by = np.argsort(low)
            cells[i] = Cells(low[by], high[by], n[by])


def _covered(some: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether each of some ranges lies in a held one."""
    at = np.searchsorted(held[1], some[1], side="left")
    return bool((at < len(held[0])).all() and (held[0][at] <= some[0]).all())


def _inside(rows: DataFrame, ranges: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(i, value, cell): the rows (i, value) that lie in one of feature i's ranges (low, high), which do not overlap."""

    def run(parts):
        for pdf in parts:
            which, value = pdf["i"].to_numpy(), pdf["value"].to_numpy()
            cell = np.full(len(pdf), -1)
            for i in np.unique(which).tolist():
                low, high = ranges[i]
                here = np.flatnonzero(which == i)
                if len(low):
                    at = np.minimum(np.searchsorted(high, value[here], side="left"), len(low) - 1)
                    cell[here] = np.where((low[at] <= value[here]) & (value[here] <= high[at]), at, -1)
            yield pd.DataFrame({"i": which, "value": value, "cell": cell})[cell >= 0]

    return rows.select("i", "value").mapInPandas(run, "i int, value double, cell int")


def attached(df: DataFrame, bounds: dict[str, list[float]]) -> DataFrame:
    """df with the bounds in the metadata of its columns, where selections, subsets and Parquet files keep them."""
    for f, b in bounds.items():
        df = df.withMetadata(f, {**df.schema[f].metadata, BOUNDS: json.dumps(b)})
    return df


def found_bounds(df: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """The bounds that columns bring along."""
    held = {f: df.schema[f].metadata.get(BOUNDS) for f in features}
    return {f: json.loads(b) for f, b in held.items() if b}


def write_bounds(spark, path: str, bounds: dict[str, list[float]]) -> None:
    """Bounds as a table (feature, bin, bound)."""
    rows = [(f, i, float(b)) for f, own in bounds.items() for i, b in enumerate(own)]
    spark.createDataFrame(rows, "feature string, bin int, bound double").coalesce(1).write.mode("overwrite").parquet(path)


def read_bounds(spark, path: str) -> dict[str, list[float]]:
    out: dict[str, list[float]] = {}
    for r in spark.read.parquet(path).orderBy("feature", "bin").collect():
        out.setdefault(r.feature, []).append(r.bound)
    return out


def assigned(df: DataFrame, feature: str, bounds: Sequence[float]) -> Column:
    """The bin of a numeric feature as a Column: how many bounds lie below it; the one after the last if it is missing."""
    x = F.col(feature).cast("double")
    below = F.aggregate(F.array(*(F.lit(float(b)) for b in bounds)), F.lit(0), lambda n, b: n + F.when(x > b, 1).otherwise(0))
    return F.when(x.isNull() | F.isnan(x), len(bounds)).otherwise(below)


def transform(x: np.ndarray, bounds: Sequence[float]) -> np.ndarray:
    """Bin numbers; NaN to the bin after the last."""
    out = np.searchsorted(np.asarray(bounds), x, side="left")
    return np.where(np.isnan(x), len(bounds), out).astype(np.int32)


def inverse(bins: np.ndarray, bounds: Sequence[float]) -> np.ndarray:
    """The upper bound of each bin, NaN for the one of NaN."""
    return np.append(np.asarray(bounds, float), np.nan)[bins]


def categories(values: np.ndarray, counts: np.ndarray, cover: float = 0.99, least: int = 1) -> list[int]:
    """Category codes from the most frequent on, until the share ``cover`` of rows is reached; negative codes count as missing."""
    keep = values >= 0
    order = np.lexsort((values[keep], -counts[keep]))
    v, n = values[keep][order], counts[keep][order]
    until = int(np.searchsorted(np.cumsum(n), cover * n.sum(), "left")) + 1
    return [int(x) for x, k in zip(v[:until], n[:until]) if k >= least]


def fit_categories(df: DataFrame, feature: str, max_bin: int = 64, cover: float = 0.99, least: int = 1) -> list[str]:
    """The most frequent values of a feature, as text, until the share ``cover`` of rows that are not missing is reached; max_bin - 2 at most, as the rest and what is missing have a bin each. Negative numbers count as missing."""
    counts = df.select(category(df, feature).alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).first()[0] or 0
    out, held = [], 0
    for r in counts.orderBy(F.desc("n"), "value").limit(max(1, max_bin - 2)).collect():
        if held >= cover * whole or r.n < least:
            break
        out.append(r.value)
        held += r.n
    return out


def category(df: DataFrame, feature: str) -> Column:
    """A feature's categories as text; null if missing or a negative number."""
    c = F.col(feature)
    return c.cast("string") if dict(df.dtypes)[feature] in ("string", "boolean") else F.when(c >= 0, c.cast("string"))


def category_code(df: DataFrame, feature: str, known: Sequence[str]) -> Column:
    """The place of a category among the known ones, len(known) for any other, NaN if it is missing."""
    value = category(df, feature)
    at = F.array_position(F.array(*map(F.lit, known)), value) if known else F.when(value.isNotNull(), F.lit(0))
    return F.when(value.isNull(), float("nan")).when(at == 0, float(len(known))).otherwise((at - 1).cast("double"))


def category_bounds(known: Sequence[str]) -> list[float]:
    """Bounds over codes: a bin for each known category and one for the rest; NaN comes after them."""
    return [*map(float, range(len(known))), float("inf")]


def trivial(bounds: Sequence[float], counts: np.ndarray, least_rows: int) -> bool:
    """Whether no bound of a feature leaves least_rows rows on both sides."""
    c = np.cumsum(counts)
    return not any(min(x, c[-1] - x) >= least_rows for x in c[:-1])
