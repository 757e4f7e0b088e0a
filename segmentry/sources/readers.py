"""Python data sources: file signatures from a few bytes of each file, and sources that are read page by page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from segmentry.sources.files import dealt

#: The first and last bytes of formats.
SIGNATURES = {"jpeg": (b"\xff\xd8", b"\xff\xd9"), "png": (b"\x89PNG\r\n\x1a\n", b"IEND\xaeB`\x82"), "parquet": (b"PAR1", b"PAR1"), "gif": (b"GIF8", b"\x3b")}
MODES = ("none", "fast", "strict")


def file_status(path: str, kind: str, mode: str) -> tuple[int, int, bool, str | None]:
    """(size, bytes read, valid, error). ``none`` asks only whether the file is there, ``fast`` reads its head and tail,
    ``strict`` the whole file, so that every byte can be read. A file that is missing or cannot be read is not valid."""
    from pyarrow import fs

    try:
        store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        info = store.get_file_info(name)
        if info.type != fs.FileType.File:
            return 0, 0, False, "missing"
        if mode == "none":
            return info.size, 0, True, None
        head, tail = SIGNATURES[kind]
        with store.open_input_file(name) as f:
            first = f.read(len(head))
            n = len(first)
            if mode == "strict":
                while part := f.read(1 << 20):
                    n += len(part)
            f.seek(max(info.size - len(tail), 0))
            last = f.read(len(tail))
        ok = info.size >= len(head) + len(tail) and first == head and last == tail
        return info.size, (n if mode == "strict" else n + len(last)), ok, None if ok else "signature"
    except OSError as e:
        return 0, 0, False, type(e).__name__


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SignatureSource(DataSource):
    """Options: paths (one a line), kind, mode, at_once (files in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "file_signatures"

    def schema(self) -> str:
        return "path string, size long, bytes_read long, valid boolean, error string"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        kind, mode, at_once = options.get("kind", "jpeg"), options.get("mode", "fast"), int(options.get("at_once", 1000))
        if kind not in SIGNATURES or mode not in MODES:
            raise ValueError(f"unknown kind or mode: {kind}, {mode}")
        paths = [p for p in options.get("paths", "").split("\n") if p]

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [_Files(paths[at : at + at_once]) for at in range(0, len(paths), at_once)] or [_Files([])]

            def read(self, partition) -> Iterator[tuple]:
                for path in partition.paths:
                    yield (path, *file_status(path, kind, mode))

        return Reader()


def check_files(files: DataFrame, kind: str = "jpeg", mode: str = "fast", tasks: int | None = None) -> DataFrame:
    """Adds size, bytes_read, valid and error to ``files`` (path), for tables of any size: each task checks its own rows. Rows are
    dealt to ``tasks``, as many as there are shuffle partitions by default: a file costs time, however few bytes its row has."""
    if mode not in MODES or (kind not in SIGNATURES and mode != "none"):
        raise ValueError(f"unknown kind or mode: {kind}, {mode}")

    def run(batches):
        for rows in batches:
            found = [(0, 0, False, "missing") if p is None else file_status(p, kind, mode) for p in rows["path"]]
            yield rows.assign(**{c: [f[i] for f in found] for i, c in enumerate(("size", "bytes_read", "valid", "error"))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return dealt(files, tasks).mapInPandas(run, f"{fields}, size long, bytes_read long, valid boolean, error string")


def paged_source(fetch: Callable[[int], list[tuple]], fields: str, name: str = "pages", first: int = 0) -> type[DataSource]:
    """A data source over ``fetch(page)``, a list of rows, from page ``first`` on until one is empty. Rows have ``fields`` and
    then page and error. A page that fails ends the scan with a row that has its number and the error only. Options: limit (rows at
    most) and pages (pages at most); pages are fetched as rows are asked for, so a LIMIT in SQL stops early too."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"{fields}, page int, error string"

        def reader(self, schema) -> DataSourceReader:
            limit, pages = (int(self.options.get(o, 1 << 62)) for o in ("limit", "pages"))
            width = len(schema.fields) - 2

            class Reader(DataSourceReader):
                def read(self, partition) -> Iterator[tuple]:
                    n, page = 0, first
                    while n < limit and page < first + pages:
                        try:
                            rows = fetch(page)
                        except Exception as e:  # noqa: BLE001  (whatever a source raises is told)
                            yield (*[None] * width, page, f"{type(e).__name__}: {e}")
                            return
                        if not rows:
                            return
                        for row in rows[: limit - n]:
                            yield (*row, page, None)
                        n, page = n + len(rows), page + 1

            return Reader()

    return Paged


def read_pages(spark: SparkSession, fetch: Callable[[int], list[tuple]], fields: str, name: str = "pages", first: int = 0, **options) -> DataFrame:
    spark.dataSource.register(paged_source(fetch, fields, name, first))
    return spark.read.format(name).options(**options).load()


def read_signatures(spark: SparkSession, paths: list[str], kind: str = "jpeg", mode: str = "fast") -> DataFrame:
    """For lists of paths that are at hand; ``check_files`` takes a table of them."""
    spark.dataSource.register(SignatureSource)
    return spark.read.format("file_signatures").options(paths="\n".join(paths), kind=kind, mode=mode).load()
