"""Pages as a data source: `spark.read.format("papyra_pages").load(folder)`.

One row for each page of each PDF or image file: path, page_number, width, height and rotate (of PDF pages, in points and degrees),
image (the page's own scan, or the image file itself) and error. Files are dealt to partitions by their bytes; conditions on
page_number and path are pushed into the source, so that files and pages that nothing asks for are not read or unpacked. A file that
can't be read is a row with an error.

Register it once for a session: `register(spark)`. Files are reached by pyarrow's file systems (a folder that all executors see, or a
store's address); for stores that only Spark reads, take Spark's own `binaryFile` and the column functions of `pdf`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from papyra.config import MAX_FILE_BYTES

SCHEMA = "path string, page_number int, width double, height double, rotate int, image binary, error string"
#: Bytes of files for a partition, and what a file counts as at least.
PARTITION_BYTES, LEAST_BYTES = 64 << 20, 256 << 10
#: Kinds of files by their names.
KINDS = {".pdf": "pdf", ".jpg": "image", ".jpeg": "image", ".png": "image", ".webp": "image", ".gif": "image"}


class Files(InputPartition):
    """Files of a partition, and which of their pages are asked for (None: all)."""

    def __init__(self, paths: list[str], asked: Asked):
        super().__init__(0)
        self.paths, self.asked = paths, asked


@dataclass
class Asked:
    """The pages that conditions leave: between two numbers, and of a set if there is one."""

    low: int = 1
    high: int | None = None
    only: frozenset[int] | None = None
    paths: frozenset[str] | None = None

    def has(self, page: int) -> bool:
        return page >= self.low and (self.high is None or page <= self.high) and (self.only is None or page in self.only)

    def add(self, f: Filter) -> bool:
        """Whether a condition is kept to by the source alone."""
        column = getattr(f, "attribute", None)
        if column == ("path",) and isinstance(f, (EqualTo, In)):
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.paths = values if self.paths is None else self.paths & values
            return True
        if column != ("page_number",):
            return False
        if isinstance(f, (EqualTo, In)):
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.only = values if self.only is None else self.only & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            most = f.value - isinstance(f, LessThan)
            self.high = most if self.high is None else min(self.high, most)
        else:
            return False
        return True

    @property
    def all(self) -> bool:
        return self.low <= 1 and self.high is None and self.only is None


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "papyra_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.images = options["path"], str(options.get("images", "true")).lower() == "true"
        self.asked = Asked()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.asked.add(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder) if ":/" in self.folder else (fs.LocalFileSystem(), self.folder)
        found = [system.get_file_info(root)] if system.get_file_info(root).type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size or 0) for i in found if i.type == fs.FileType.File and _kind(i.path) and (self.asked.paths is None or i.path in self.asked.paths))
        parts, size = [[]], 0
        for path, n in files:
            if size + n > PARTITION_BYTES and parts[-1]:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += max(n, LEAST_BYTES)
        return [Files(p, self.asked) for p in parts]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.folder)[0] if ":/" in self.folder else fs.LocalFileSystem()
        for path in partition.paths:
            try:
                if system.get_file_info(path).size > MAX_FILE_BYTES:
                    raise ValueError("File is too large.")
                if _kind(path) == "image" and not partition.asked.has(1):
                    continue
                with system.open_input_stream(path) as f:
                    rows = list(self._pages(path, f.read(), partition.asked))
            except Exception as e:  # a broken file is a row, not the end of the job
                rows = [(path, None, None, None, None, None, str(e))] if partition.asked.all else []
            yield from rows

    def _pages(self, path: str, content: bytes, asked: Asked) -> Iterator[tuple]:
        from .pdf import Pdf

        if _kind(path) == "image":
            yield path, 1, None, None, None, content if self.images else None, None
            return
        file = Pdf(content)
        pages = file.pages()
        if not pages:
            raise ValueError("No pages found.")
        for number, page in enumerate(pages, 1):
            if asked.has(number):
                try:
                    image, error = (file.image(page) if self.images else None), None
                except Exception as e:  # the page's image can't be unpacked; its size is known
                    image, error = None, str(e)
                yield (path, number, *file.size(page), image, error)


def _kind(path: str) -> str | None:
    dot = path.rfind(".")
    return KINDS.get(path[dot:].lower()) if dot >= 0 else None


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets conditions be pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
