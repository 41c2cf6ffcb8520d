"""Documents in pages as a data source: one partition a file, pages taken out by a pluggable extractor.

    spark.dataSource.register(PageSource)
    spark.read.format("document_pages").load("s3://bucket/contracts")

gives (path, page, text, confidence).  Text and markdown are read as they are, a form
feed starts a page.  Other kinds need an extractor: ``option("extractor.pdf", "module:function")``
names a function that takes a file's bytes and yields its pages' texts; it is imported
in the tasks.  Without one the read fails with ``NoExtractor`` before any task runs.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import UnsupportedFile

PLAIN = (".txt", ".md", ".markdown", ".text")
#: Kinds that take an extractor, and the pages of one document.
EXTRACTED, MOST_PAGES = (".pdf",), 200


class NoExtractor(UnsupportedFile):
    """A file of a kind for which no extractor was named."""


class TooManyPages(ValueError):
    """A document with more pages than is allowed."""


@dataclass
class FilePart(InputPartition):
    path: str
    suffix: str


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith(("file:", "/")):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def plain_pages(content: bytes) -> list[str]:
    return content.decode("utf-8-sig", "replace").replace("\r\n", "\n").split("\f")


def named(function: str) -> Callable[[bytes], Iterable[str]]:
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path of documents is needed")
        self.path, self.most = options["path"], int(options.get("maxpages", MOST_PAGES))
        self.extractors = {"." + k.lower().removeprefix("extractor."): v for k, v in options.items() if k.lower().startswith("extractor.")}

    def partitions(self) -> list[InputPartition]:
        fs, path = file_system(self.path)
        found = fs.get_file_info(path)
        infos = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        parts = []
        for info in sorted((i for i in infos if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))), key=lambda i: i.path):
            suffix = f".{info.extension.lower()}"
            if suffix not in PLAIN and suffix not in self.extractors:
                raise (NoExtractor if suffix in EXTRACTED else UnsupportedFile)(f"{info.path}: no extractor for {suffix}")
            parts.append(FilePart(info.path, suffix))
        return parts

    def read(self, partition: FilePart) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as f:
            content = f.read()
        take = named(self.extractors[partition.suffix]) if partition.suffix in self.extractors else plain_pages
        for number, text in enumerate(take(content), 1):
            if number > self.most:
                raise TooManyPages(f"{partition.path} has more than {self.most} pages")
            yield partition.path, number, text, 0.98 if text.strip() else 0.2


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return "path string, page int, text string, confidence double"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)
