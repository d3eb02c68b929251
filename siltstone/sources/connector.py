"""Sources as Spark data sources: ``spark.read.format("ycombinator").load(folder)`` gives a source's saved payloads.

Each of the registry's sources is a format of its name.  A payload is a file;
its folder below the source's is the target it answers for (a board's token, a
host), if there is one.  Many small payloads are kept in archives: Parquet files
of rows (name, target, fetched_at, payload).  Batches list files once, on the
driver, and read them, archives by row groups, in parts of about ``PART_BYTES``,
as Arrow batches of about ``BATCH_BYTES``; filters on name, target
and fetched_at leave out payloads before they are opened, ``columns`` without
payload opens no plain file and reads no text of an archive, and ``limit`` takes
the first payloads by target and name.  Streams read files in the order in which
they were written, each once, from where their checkpoint stands.

``path`` is a folder or URI that all machines reach through pyarrow's file systems.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import UTC, date, datetime
from itertools import islice
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from siltstone.sources.registry import MAPPERS

COLUMNS = {"name": "string", "target": "string", "fetched_at": "timestamp", "payload": "string"}
PART_BYTES = 32 << 20
BATCH_BYTES = 4 << 20


class Saved(NamedTuple):
    """A payload's file."""

    path: str
    name: str
    target: str | None
    written: int  # nanoseconds since 1970
    size: int
    groups: tuple[int, ...] | None = None  # an archive's row groups, all if None

    @property
    def fetched_at(self) -> datetime:
        return datetime.fromtimestamp(self.written // 1000 / 1e6, UTC)


def saved(path: str) -> tuple[object, list[Saved]]:
    """The file system and the payloads below a folder, by target and name; hidden files are none."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    root, out = root.rstrip("/"), []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        inner = info.path[len(root) + 1 :].split("/")
        if info.type == fs.FileType.File and not any(p[0] in "._" for p in inner):
            out.append(Saved(info.path, inner[-1], inner[0] if len(inner) > 1 else None, info.mtime_ns or 0, info.size or 0))
    return system, sorted(out, key=lambda s: (s.target or "", s.name, s.path))


def archive(s: Saved) -> bool:
    return s.name.endswith(".parquet")


def system_of(path: str) -> object:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()


def utc(value: object) -> datetime | None:
    """An archive's time, which can be without a zone and finer than a datetime."""
    value = value.to_pydatetime(warn=False) if hasattr(value, "to_pydatetime") else value
    return value.replace(tzinfo=UTC) if value is not None and value.tzinfo is None else value


def by_groups(system: object, s: Saved) -> Iterator[Saved]:
    """An archive's row groups, each with the bytes that it takes when it is read; other files as they are."""
    if not archive(s):
        yield s
        return
    import pyarrow.parquet as pq

    about = pq.ParquetFile(system.open_input_file(s.path)).metadata
    for k in range(about.num_row_groups):
        yield s._replace(size=about.row_group(k).total_byte_size, groups=(k,))


def archived_batches(columns: Sequence[str], system: object, s: Saved, most: int | None, keeps: Callable[[dict], bool] | None) -> Iterator[object]:
    """An archive's rows as Arrow batches."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    file = pq.ParquetFile(system.open_input_file(s.path))
    groups = list(range(file.metadata.num_row_groups)) if s.groups is None else list(s.groups)
    rows, size = (sum(getattr(file.metadata.row_group(k), what) for k in groups) for what in ("num_rows", "total_byte_size"))
    # what filters compare is read besides what is asked for
    read = [c for c in COLUMNS if c in columns or keeps is not None and c != "payload"]
    for b in file.iter_batches(max(1, min(10_000, rows * BATCH_BYTES // max(size, 1))), row_groups=groups, columns=read):
        b = b if most is None else b.slice(0, most)
        most = None if most is None else most - b.num_rows
        if keeps is not None:
            known = b.select([c for c in read if c != "payload"]).to_pylist()
            b = b.filter(pa.array([keeps(r | {"fetched_at": utc(r["fetched_at"])}) for r in known], pa.bool_()))
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column(c).cast(pa.timestamp("us", "UTC") if c == "fetched_at" else pa.string(), safe=False) for c in columns], list(columns))
        if most == 0:
            return


def wanted(columns: Sequence[str], system: object, files: Sequence[tuple[Saved, int | None]], keeps: Callable[[dict], bool] | None = None) -> Iterator[object]:
    """Arrow batches of the columns asked for, of each file as many rows as its number says; plain files are opened only for their payload."""
    import pyarrow as pa

    schema = pa.schema([(c, pa.timestamp("us", "UTC") if c == "fetched_at" else pa.string()) for c in columns])
    rows, size = [], 0
    for s, most in files:
        if archive(s):
            yield from archived_batches(columns, system, s, most, keeps)
            continue
        row = {"name": s.name, "target": s.target, "fetched_at": s.fetched_at}
        if keeps is None or keeps(row):
            if "payload" in columns:
                with system.open_input_stream(s.path) as f:
                    row["payload"] = f.read().decode("utf-8", "replace")
            rows.append({c: row[c] for c in columns})
            size += len(row.get("payload", "")) + 100
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


#: Filters that files are left out by, each a comparison of a file's value with the filter's.
COMPARED: dict[type, Callable] = {
    EqualTo: lambda v, w: v == w,
    GreaterThan: lambda v, w: v > w,
    GreaterThanOrEqual: lambda v, w: v >= w,
    LessThan: lambda v, w: v < w,
    LessThanOrEqual: lambda v, w: v <= w,
    In: lambda v, w: v in w,
    StringStartsWith: lambda v, w: v.startswith(w),
}


class Part(InputPartition):
    def __init__(self, files: list[tuple[Saved, int | None]]):
        self.files = files


def in_parts(files: Iterable[tuple[Saved, int | None]]) -> list[Part]:
    """Files in their order, in parts of about ``PART_BYTES``; one without files if there are none."""
    parts, size = [], PART_BYTES
    for s, most in files:
        if size >= PART_BYTES:
            parts.append([])
            size = 0
        parts[-1].append((s, most))
        size += s.size + 4096
    return [Part(p) for p in parts] or [Part([])]


class PayloadReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], limit: int | None):
        self.path, self.columns, self.limit = path, columns, limit
        self.filters: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kind, at = type(f), ".".join(f.attribute) if hasattr(f, "attribute") else ""
            # a limit is of all payloads, so what is filtered must stay above it
            if kind in COMPARED and at in ("name", "target", "fetched_at") and self.limit is None:
                self.filters.append((kind, at, f.value))
            else:
                yield f

    def keeps(self, row: dict) -> bool:
        values = ((kind, row[at], value) for kind, at, value in self.filters)
        return all(v is not None and COMPARED[kind](v, w) for kind, v, w in values)

    def _limited(self, system: object, files: list[Saved]) -> Iterator[tuple[Saved, int | None]]:
        """The first files with ``limit`` payloads; archives tell how many they have."""
        left = self.limit
        for s in files:
            if left is None:
                yield s, None
            elif left > 0:
                if archive(s):
                    import pyarrow.parquet as pq

                    has = pq.ParquetFile(system.open_input_file(s.path)).metadata.num_rows
                else:
                    has = 1
                yield s, min(has, left)
                left -= min(has, left)

    def partitions(self) -> list[Part]:
        system, files = saved(self.path)
        files = [s for s in files if archive(s) or self.keeps(s._asdict() | {"fetched_at": s.fetched_at})]
        if self.limit is None:
            return in_parts((g, None) for s in files for g in by_groups(system, s))
        return in_parts(self._limited(system, files))

    def read(self, partition: Part) -> Iterator[object]:
        return wanted(self.columns, system_of(self.path), partition.files, self.keeps if self.filters else None)


class PayloadStream(DataSourceStreamReader):
    """Offsets are (time written, path) of the last file; a batch is all files behind the one before, read in parts by the executors."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def initialOffset(self) -> dict:
        return {"written": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((s.written, s.path) for s in saved(self.path)[1]), default=(-1, ""))
        return {"written": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after, until = (start["written"], start["path"]), (end["written"], end["path"])
        system, files = saved(self.path)
        found = [s for s in files if after < (s.written, s.path) <= until]
        return in_parts((g, None) for s in sorted(found, key=lambda s: (s.written, s.path)) for g in by_groups(system, s))

    def read(self, partition: Part) -> Iterator[object]:
        return wanted(self.columns, system_of(self.path), partition.files)


class PayloadSource(DataSource):
    """Options: path; columns, comma-separated; limit, payloads of a batch at most."""

    source = ""

    @classmethod
    def name(cls) -> str:
        return cls.source

    def columns(self) -> list[str]:
        asked = [c.strip() for c in self.options.get("columns", ",".join(COLUMNS)).split(",")]
        if unknown := [c for c in asked if c not in COLUMNS]:
            raise ValueError(f"no such columns: {', '.join(unknown)}; known: {', '.join(COLUMNS)}")
        return asked

    def path(self) -> str:
        if "path" not in self.options:
            raise ValueError(f"{self.source} needs a path: the folder of its payloads")
        return self.options["path"].removeprefix("file://") if self.options["path"].startswith("file:///") else self.options["path"].removeprefix("file:")

    def schema(self) -> str:
        return ", ".join(f"{c} {COLUMNS[c]}" for c in self.columns())

    def reader(self, schema: StructType) -> PayloadReader:
        limit = self.options.get("limit")
        if limit is not None and int(limit) < 0:
            raise ValueError(f"limit is not negative: {limit}")
        return PayloadReader(self.path(), self.columns(), None if limit is None else int(limit))

    def streamReader(self, schema: StructType) -> PayloadStream:
        return PayloadStream(self.path(), self.columns())


FORMATS: dict[str, type[PayloadSource]] = {name: type(f"{name.title().replace('_', '')}Source", (PayloadSource,), {"source": name, "__module__": __name__}) for name in MAPPERS}
globals().update({c.__name__: c for c in FORMATS.values()})  # found by name where tasks load them


def register(spark: SparkSession) -> SparkSession:
    """Makes every source a format of its name in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for kind in FORMATS.values():
        spark.dataSource.register(kind)
    return spark


def payloads(spark: SparkSession, source: str, path: str, **options: object) -> DataFrame:
    """A source's saved payloads."""
    if source not in FORMATS:
        raise KeyError(f"unknown source {source!r}; known: {', '.join(FORMATS)}")
    return register(spark).read.format(source).options(**options).load(path)


def scan(spark: SparkSession, source: str, path: str, since: date | None = None, *, now: datetime | None = None, **options: object) -> DataFrame:
    """A source's payloads mapped to its rows, those fetched since a day if one is given.

    Rows carry the target of their payload; feeds are cut by age against ``now``.
    """
    rows = payloads(spark, source, path, **options)
    if since is not None:
        rows = rows.where(F.col("fetched_at") >= F.lit(datetime(since.year, since.month, since.day, tzinfo=UTC)))
    if source == "hn_hiring":
        return MAPPERS[source](rows)
    if source == "company_site":
        return MAPPERS[source](rows.withColumn("url", F.concat(F.lit("https://"), "target", F.lit("/"), F.regexp_replace("name", r"[.]html?$", ""))), html="payload")
    if source == "funding_rss":
        return MAPPERS[source](rows, ["target"], F.lit(now) if now is not None else F.current_timestamp())
    return MAPPERS[source](rows, ["target"])
