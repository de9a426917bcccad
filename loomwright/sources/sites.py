"""Sinks for what browsers read: one file a page, and ordered JSON in one file, both written by the executors.

Pages go through a data source: each task writes its files into a staging folder of its own, the commit moves names and an abort
removes the staging folder, so a failed task or job leaves nothing. Two pages of one name are an error, told before anything moves.

An ordered file is made of range-partitioned parts. Each task writes the text of its part and tells its size; a prefix sum gives the
parts' places in the file, and the executors put them there (a file system that can only append gets them one after the other, a
buffer at a time). The driver sees a number a part and no row.

Folders are URIs or paths that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_BUFFER = 8 << 20


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class PageWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".html")
        self.name, self.content, self.overwrite = options.get("name", "slug"), options.get("content", "html"), overwrite
        self.staging = f"_staged-{uuid.uuid4().hex}"
        store, root = file_system(self.folder)
        store.create_dir(f"{root}/{self.staging}")  # on the driver; tasks that outlive an abort find it gone

    def write(self, rows: Iterator) -> Staged:
        store, root = file_system(self.folder)
        task = TaskContext.get()
        mine, names = f"{root}/{self.staging}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}", []
        store.create_dir(mine, recursive=False)
        try:
            for r in rows:
                name = f"{r[self.name]}{self.suffix}"
                if r[self.name] is None or "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"no file can be named {name!r}")
                with store.open_output_stream(f"{mine}/{name}") as out:
                    out.write((r[self.content] or "").encode())
                names.append(name)
        except BaseException:
            if store.get_file_info(mine).type == fs.FileType.Directory:
                store.delete_dir(mine)
            raise
        return Staged(mine, names)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = file_system(self.folder)
        done = [m for m in messages if m]
        new = {n for m in done for n in m.names}
        if len(new) != sum(len(m.names) for m in done):
            self.abort(messages)
            raise ValueError("two pages have the same name")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.is_file and old.base_name.endswith(self.suffix) and old.base_name not in new:
                    store.delete_file(old.path)
        for m in done:
            for n in m.names:
                store.move(f"{m.folder}/{n}", f"{root}/{n}")
        self._clean(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean(*file_system(self.folder))

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class Pages(DataSource):
    """df.write.format("site_pages").mode(..).save(folder): a file for each row. Options: name, content (columns), suffix."""

    @classmethod
    def name(cls) -> str:
        return "site_pages"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PageWriter(dict(self.options), overwrite)


def write_pages(pages: DataFrame, folder: str, name: str = "slug", content: str = "html") -> None:
    """NAME.html for every row; pages of an earlier build go."""
    pages.sparkSession.dataSource.register(Pages)
    pages.select(name, content).write.format("site_pages").mode("overwrite").option("name", name).option("content", content).save(folder)


@dataclass
class Rows:
    """Ordered entries of a file: `text` makes one of a key and a row's JSON; `between` stands between two; `end` follows if there are any."""

    df: DataFrame
    order: tuple[str, ...]
    text: Callable[[str, str], str]
    between: str = ","
    end: str = ""


def as_is(key: str, row: str) -> str:
    return row


def compact(key: str, row: str) -> str:
    return json.dumps(json.loads(row), ensure_ascii=False, separators=(",", ":"))


def member(level: int) -> Callable[[str, str], str]:
    """An object's member at some level of an indented file."""

    def text(key: str, row: str) -> str:
        return json.dumps({str(key): json.loads(row)}, ensure_ascii=False, indent=2)[1:-2].replace("\n", "\n" + "  " * (level - 1))

    return text


def _write_part(text: Callable[[str, str], str], between: str, folder: str):
    def run(batches):
        store, root = file_system(folder)
        task = TaskContext.get()
        path, size, n = f"{root}/{task.partitionId()}-{uuid.uuid4().hex}", 0, 0
        with store.open_output_stream(path) as out:
            for batch in batches:
                for key, row in zip(batch.column("key").to_pylist(), batch.column("row").to_pylist(), strict=True):
                    entry = (between + text(key, row)).encode()
                    out.write(entry)
                    size, n = size + len(entry), n + 1
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "path": [path], "size": pa.array([size], pa.int64()), "n": pa.array([n], pa.int64())})

    return run


def _place(folder: str, target: str):
    def run(batches):
        store, _ = file_system(folder)
        for batch in batches:
            for path, skip, at in zip(*[batch.column(c).to_pylist() for c in ("path", "skip", "at")], strict=True):
                with store.open_input_stream(path) as read, open(target, "r+b") as out:
                    read.read(skip)
                    out.seek(at)
                    while chunk := read.read(_BUFFER):
                        out.write(chunk)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return run


def write_ordered(spark: SparkSession, content: list[str | Rows], path: str) -> int:
    """One file of texts and ordered rows; its size. Rows' frames have `key` and `row` (JSON) beside what they are ordered by."""
    parts_n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staging = f"{path}-parts-{uuid.uuid4().hex}"
    store, root = file_system(staging)
    store.create_dir(root)
    _, target = file_system(path)
    pieces: list[tuple[bytes | str, int, int]] = []  # a text, or a part's path with its size and the bytes to skip
    try:
        for item in content:
            if isinstance(item, str):
                pieces.append((item.encode(), len(item.encode()), 0))
                continue
            ordered = item.df.repartitionByRange(parts_n, *item.order).sortWithinPartitions(*item.order).select(F.col("key").cast("string").alias("key"), "row")
            parts = sorted(ordered.mapInArrow(_write_part(item.text, item.between, staging), "part int, path string, size long, n long").where("n > 0").collect())
            for k, part in enumerate(parts):
                skip = 0 if k else len(item.between.encode())
                pieces.append((part.path, part.size - skip, skip))
            if parts:
                pieces.append((item.end.encode(), len(item.end.encode()), 0))
        at, offsets = 0, []
        for _, size, _ in pieces:
            offsets.append(at)
            at += size
        built = f"{root}/whole"
        if isinstance(store, fs.LocalFileSystem):
            with open(built, "wb") as out:
                out.truncate(at)
                for (text, _, _), start in zip(pieces, offsets, strict=True):
                    if isinstance(text, bytes):
                        out.seek(start)
                        out.write(text)
            if moved := [(text, skip, start) for (text, _, skip), start in zip(pieces, offsets, strict=True) if isinstance(text, str)]:
                spark.createDataFrame(moved, "path string, skip long, at long").repartition(min(len(moved), parts_n)).mapInArrow(_place(staging, built), "n long").agg(F.sum("n")).collect()
        else:
            with store.open_output_stream(built) as out:
                for text, _, skip in pieces:
                    if isinstance(text, bytes):
                        out.write(text)
                        continue
                    with store.open_input_stream(text) as read:
                        read.read(skip)
                        while chunk := read.read(_BUFFER):
                            out.write(chunk)
        store.move(built, target)
        return at
    finally:
        store.delete_dir(root)


def json_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and row, the JSON of some columns, beside all columns."""
    return df.withColumn("row", F.to_json(F.struct(*columns))).withColumn("key", F.col(key))


def write_search_script(docs: DataFrame, path: str) -> int:
    """The search documents as one compact array in a global, in the order of their slugs."""
    rows = Rows(json_rows(docs, "slug", docs.columns), ("slug",), compact)
    return write_ordered(docs.sparkSession, ["window.WIKI_SEARCH_INDEX = [", rows, "];\n"], path)


def write_previews_script(previews: DataFrame, page_maps: DataFrame, path: str) -> int:
    """Previews by slug and page maps by book as two indented globals; previews: (slug, ..), page_maps: (book, page, slug, title, sections).
    The names of the books are the only rows that the driver sees."""
    shown = json_rows(previews, "slug", [c for c in previews.columns if c != "slug"])
    content: list[str | Rows] = ["window.WIKI_PREVIEWS = {", Rows(shown, ("slug",), member(1), end="\n"), "};\nwindow.WIKI_PAGE_MAP = {"]
    books = [r.book for r in page_maps.select("book").distinct().orderBy("book").collect()]
    for k, book in enumerate(books):
        mine = json_rows(page_maps.where(F.col("book") == book), "page", ["slug", "title", "sections"])
        content += [f"{',' if k else ''}\n  {json.dumps(book, ensure_ascii=False)}: {{", Rows(mine, ("page",), member(2), end="\n  "), "}"]
    return write_ordered(previews.sparkSession, [*content, "\n" if books else "", "};\n"], path)
