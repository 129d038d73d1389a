"""Causal frames as a data source: ``spark.read.format("causal_frame")`` over Parquet files, columns told by their roles."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .frames import CausalFrame

NAME = "causal_frame"
#: Under this key Spark's Parquet files hold their schema, with the metadata of columns.
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
#: Values of an IN that are still sent to the files.
MOST_VALUES = 100
COMPARED = {D.EqualTo: "__eq__", D.GreaterThan: "__gt__", D.GreaterThanOrEqual: "__ge__", D.LessThan: "__lt__", D.LessThanOrEqual: "__le__"}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the Parquet files, by path."""
    system, place = _place(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"no path {path}")
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(place) :].split("/"))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not hidden(f.path))


@dataclass
class Slices(D.InputPartition):
    """Byte ranges of files; a row group belongs to the range in which it starts, so that nobody reads footers ahead."""

    ranges: list[tuple[str, int, int]]


def slices(files: Sequence[tuple[str, int]], most: int) -> list[Slices]:
    """Ranges of at most ``most`` bytes, small files together."""
    out, room = [], 0
    for path, size in files:
        parts = -(-size // most)
        for k in range(parts):
            start, end = size * k // parts, size * (k + 1) // parts
            if not out or end - start > room:
                out.append(Slices([]))
                room = most
            out[-1].ranges.append((path, start, end))
            room -= end - start
    return out


class CausalReader(D.DataSourceReader):
    def __init__(self, source: CausalSource):
        self.source = source
        self.filters: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if self.source.expression(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> Sequence[D.InputPartition]:
        return slices(_files(self.source.path), self.source.most) or [Slices([])]

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        source, kind = self.source, ds.ParquetFileFormat()
        system, _ = _place(source.path)
        wanted = None
        for f in self.filters:
            wanted = source.expression(f) if wanted is None else wanted & source.expression(f)
        for path, start, end in partition.ranges:
            with system.open_input_file(path) as file:
                meta = pq.read_metadata(file)
            groups = [i for i in range(meta.num_row_groups) if start <= _begin(meta.row_group(i)) < end]
            if groups:
                part = kind.make_fragment(path, system, row_groups=groups)
                for batch in part.scanner(columns=source.read_columns, filter=wanted).to_batches():
                    if batch.num_rows:
                        yield source.convert(batch)


def _begin(group) -> int:
    column = group.column(0)
    return column.dictionary_page_offset if column.has_dictionary_page and column.dictionary_page_offset else column.data_page_offset


class CausalSource(D.DataSource):
    """Options: path; features, side (names separated by commas); treatment ("w"), key ("id"); outcomes: one array column, or
    columns of numbers that become the array ``y`` in their order; n_period (for an array column, 1); check ("true");
    max_partition_bytes (128 MB).

    Features are doubles, or text. Only columns with a role are read, filters on single columns go to the files (and skip
    row groups there), metadata of columns (the bounds of bins) stays. With check a row that is read and whose treatment is not
    0 or 1, or which lacks an outcome, is an error.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        names = lambda o: [n.strip() for n in options.get(o, "").split(",") if n.strip()]
        self.path = options.get("path", "")
        self.features, self.side, self.outcomes = names("features"), names("side"), names("outcomes") or ["y"]
        self.treatment, self.key = options.get("treatment", "w"), options.get("key", "id")
        self.check = options.get("check", "true").lower() == "true"
        self.most = int(options.get("max_partition_bytes", 128 << 20))
        if not self.path or not self.features:
            raise ValueError("path and features are needed")
        files = _files(self.path)
        if not files:
            raise ValueError(f"no Parquet files in {self.path}")
        system, _ = _place(self.path)
        with system.open_input_file(files[0][0]) as file:
            stored = pq.read_schema(file)
        self.read_columns = [self.key, self.treatment, *self.features, *self.side, *self.outcomes]
        if missing := [c for c in self.read_columns if c not in stored.names]:
            raise ValueError(f"columns are missing: {missing}")
        self.array = len(self.outcomes) == 1 and pa.types.is_list(stored.field(self.outcomes[0]).type)
        self.periods = int(options.get("n_period", 1)) if self.array else len(self.outcomes)
        self.out = self.outcomes[0] if self.array else "y"
        if len({*self.read_columns, self.out}) < len(self.read_columns) + (self.out not in self.read_columns) or self.out in self.read_columns[: -len(self.outcomes)]:
            raise ValueError("a column has two roles")
        self.types = {c: stored.field(c).type for c in self.read_columns}
        told = json.loads((stored.metadata or {}).get(SPARK_SCHEMA, b'{"fields": []}'))
        self.metadata = {f["name"]: f.get("metadata") or {} for f in told["fields"]}

    def _type(self, c: str):
        if c == self.treatment:
            return IntegerType()
        if c in self.features:
            t = self.types[c]
            if pa.types.is_string(t) or pa.types.is_large_string(t):
                return StringType()
            if not (pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_decimal(t) or pa.types.is_boolean(t)):
                raise ValueError(f"{c} is neither a number nor text")
            return DoubleType()
        return from_arrow_type(self.types[c])

    def schema(self) -> StructType:
        fields = [StructField(c, self._type(c), True, self.metadata.get(c) or None) for c in self.read_columns[: -len(self.outcomes)]]
        return StructType([*fields, StructField(self.out, ArrayType(DoubleType()))])

    def reader(self, schema: StructType) -> CausalReader:
        return CausalReader(self)

    def _field(self, c: str) -> pc.Expression:
        """A column as the frame shows it."""
        kind = self._type(c)
        if isinstance(kind, IntegerType) and c == self.treatment and self.types[c] != pa.int32():
            return pc.field(c).cast(pa.int32())
        return pc.field(c).cast(pa.float64(), safe=False) if isinstance(kind, DoubleType) and self.types[c] != pa.float64() else pc.field(c)

    def expression(self, f: D.Filter) -> pc.Expression | None:
        """A filter over the files' columns, equal to Spark's on nulls and NaN (the greatest number, equal to itself); None if Spark has to apply it."""
        if isinstance(f, D.Not):
            inner = self.expression(f.child)
            return None if inner is None else ~inner
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column not in self.read_columns[: -len(self.outcomes)]:
            return None
        x, number = self._field(column), isinstance(self._type(column), DoubleType) or pa.types.is_floating(self.types[column])
        if isinstance(f, (D.IsNull, D.IsNotNull)):
            return x.is_null() if isinstance(f, D.IsNull) else x.is_valid()
        plain = lambda v: isinstance(v, (bool, int, str)) or isinstance(v, float) and not math.isnan(v)
        if isinstance(f, D.In) and 0 < len(f.value) <= MOST_VALUES and all(map(plain, f.value)):
            out = x == f.value[0]
            for v in f.value[1:]:
                out = out | (x == v)
            return out
        if (how := COMPARED.get(type(f))) is None or not plain(f.value):
            return None
        out = getattr(x, how)(pc.scalar(f.value))
        return out | pc.is_nan(x) if number and how in ("__gt__", "__ge__") else out

    def convert(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """A batch of the files as one of the frame, checked."""
        fields = self.schema().fields
        columns = []
        for c, field in zip(self.read_columns[: -len(self.outcomes)], fields, strict=False):
            column = batch.column(c)
            if isinstance(field.dataType, IntegerType) and c == self.treatment:
                column = pc.cast(column, pa.int32())
            elif isinstance(field.dataType, DoubleType):
                column = pc.cast(column, pa.float64(), safe=False)
            columns.append(column)
        if self.array:
            y = pc.cast(batch.column(self.out), pa.list_(pa.float64()))
        else:
            parts = [pc.cast(batch.column(c), pa.float64(), safe=False) for c in self.outcomes]
            flat = pa.concat_arrays(parts).take(pa.array([k * batch.num_rows + i for i in range(batch.num_rows) for k in range(len(parts))]))
            y = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(parts)), pa.int32()), flat)
        if self.check:
            bad = batch.num_rows - (pc.sum(pc.is_in(columns[1], pa.array([0, 1], pa.int32()))).as_py() or 0)
            short = batch.num_rows - (pc.sum(pc.equal(pc.list_value_length(y), self.periods)).as_py() or 0)
            lacking = y.flatten().null_count
            if bad or short or lacking:
                raise ValueError(f"{bad} rows with a treatment other than 0 and 1, {short} with other numbers of outcomes, {lacking} missing outcomes")
        return pa.RecordBatch.from_arrays([*columns, y], names=[f.name for f in fields])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and has filters sent to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CausalSource)


def read_causal(spark: SparkSession, path: str, features: Sequence[str], outcomes: Sequence[str] = ("y",), treatment: str = "w", key: str = "id", side: Sequence[str] = (), treat_dt: int = 0, n_period: int | None = None, categorical: Sequence[str] = (), check: bool = True) -> CausalFrame:
    """Parquet files as a frame with its roles."""
    register(spark)
    periods = n_period or len(outcomes)
    df = spark.read.format(NAME).options(features=",".join(features), outcomes=",".join(outcomes), treatment=treatment, key=key, side=",".join(side), n_period=str(periods), check=str(check).lower()).load(path)
    return CausalFrame(df, list(features), treatment, df.columns[-1], key, periods, treat_dt, list(side), list(categorical))
