"""Folders of Word packages as Spark data sources: parts to read, packages to publish.

``wordparts`` reads (path, part, size, csize, crc, content, error).  Folders are listed once and dealt out by bytes.  A task opens a
package at random access, judges it by its directory alone, and reads only the members that the query asks for: filters on path and part
are pushed into the source, so neither other packages nor other members are opened.  Options: ``members`` (stories or all), ``content``
(false leaves bytes unread), ``partitionBytes``.  A package that is refused or can't be read is one row with an error and no part.

``wordpackages`` publishes rows (file, content, converted, warnings, error) in two phases.  Tasks write into a staging folder of the
job, each attempt into one of its own; the commit moves the files of finished attempts to their names, then their rows of status into
``_status/<tag>``, and removes the staging folder; an abort removes it and leaves the target as it was.  Rows without content have a status alone.
With mode append, a name that is there already stops the commit before anything is moved.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from glyphmill.operators import package

PARTS = "path string, part string, size long, csize long, crc long, content binary, error string"
#: Bytes of packages that one task reads, unless an option says so: a thousandth of the folder within these bounds, as packages are
#: compressed and a megabyte of them may hold a hundred thousand paragraphs.
LEAST_BYTES, PARTITION_BYTES, TASKS = 64 << 10, 128 << 20, 1000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def refusal(members: list[tuple[str, int, int, int]]) -> str | None:
    """Why a package with these members (name, size, csize, flags) is refused; the reasons and their order are those of ``package.admission``."""
    names = [m[0] for m in members]
    rules = (
        (sum(m[2] for m in members) > package.MOST_BYTES, "package is too large"),
        (len(names) > package.MOST_MEMBERS, "too many members"),
        (len(names) != len(set(names)), "duplicate member"),
        (not set(package.REQUIRED) <= set(names), "required part is missing"),
        (any(m[3] & 1 for m in members), "encrypted member"),
        (any(m[1] > package.MOST_MEMBER for m in members), "member is too large"),
        (sum(m[1] for m in members) > package.MOST_TOTAL, "expanded package is too large"),
        (any(m[1] / max(m[2], 1) > package.MOST_RATIO for m in members), "suspicious compression ratio"),
    )
    return next((reason for holds, reason in rules if holds), None)


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it, of a URI as Spark writes them."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def escaped(name: str) -> str:
    """A file name as a reader of patterns takes it literally."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


#: How a pushed filter looks at a value.
TESTS = {
    EqualTo: lambda v, x: v == x,
    EqualNullSafe: lambda v, x: v == x,
    In: lambda v, x: v in x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x),
    StringContains: lambda v, x: x in v,
    IsNotNull: lambda v, x: True,
}


@dataclass
class Files(InputPartition):
    paths: list[str]


class PartsReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.stories = options.get("members", "stories") == "stories"
        self.content = options.get("content", "true").lower() == "true"
        self.bytes = int(options.get("partitionBytes", 0))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in (("path",), ("part",)) and getattr(f, "value", "") is not None:
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def asked(self, column: str, value: str | None) -> bool:
        own = [(kind, x) for name, kind, x in self.tests if name == column]
        return all(value is not None and TESTS[kind](value, x) for kind, x in own)

    def partitions(self) -> list[Files]:
        store, root = store_of(self.root)
        found = [(i.path, i.size) for i in store.get_file_info(fs.FileSelector(root, recursive=False)) if i.type == fs.FileType.File and re.search(r"(?i)\.doc[xm]$", i.path)]
        out, size = [Files([])], 0
        found = [(path, n) for path, n in ((f"{self.root}/{p.rpartition('/')[2]}", n) for p, n in sorted(found)) if self.asked("path", path)]
        most = self.bytes or min(PARTITION_BYTES, max(LEAST_BYTES, sum(n for _, n in found) // TASKS))
        for path, n in found:
            if out[-1].paths and size + n > most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            store, at = store_of(path)
            try:
                with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    infos = z.infolist()
                    if error := refusal([(i.filename, i.file_size, i.compress_size, i.flag_bits) for i in infos]):
                        if self.asked("part", None):
                            yield path, None, None, None, None, None, error
                        continue
                    for i in sorted(infos, key=lambda i: i.filename):
                        if (self.stories and not re.match(package.STORY, i.filename)) or not self.asked("part", i.filename):
                            continue
                        try:
                            yield path, i.filename, i.file_size, i.compress_size, i.CRC, z.read(i) if self.content else None, None
                        except package.BROKEN as e:
                            yield path, i.filename, i.file_size, i.compress_size, i.CRC, None, f"PART_UNREADABLE: {e}"
            except package.BROKEN:
                if self.asked("part", None):
                    yield path, None, None, None, None, None, "package can't be read"


class WordParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wordparts"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema) -> PartsReader:
        return PartsReader(self.options)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class PackagesWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.root, self.overwrite, self.tag = options["path"].rstrip("/"), overwrite, options.get("tag", "all")
        self.stage = f"{self.root}/.staged-{uuid.uuid4().hex}"

    def write(self, iterator) -> Staged:
        folder = f"{self.stage}/{uuid.uuid4().hex}"
        store, at = store_of(folder)
        store.create_dir(f"{at}/files", recursive=True)
        n = 0
        with store.open_output_stream(f"{at}/status.json") as status:
            for r in iterator:
                if "/" in r.file or r.file in ("", ".", ".."):
                    raise ValueError(f"not a file name: {r.file!r}")
                if r.content is not None:
                    with store.open_output_stream(f"{at}/files/{r.file}") as out:
                        out.write(bytes(r.content))
                    n += 1
                line = {"file": r.file, "published": r.content is not None, "converted": r.converted, "warnings": list(r.warnings or []), "error": r.error}
                status.write((json.dumps(line, ensure_ascii=False) + "\n").encode())
        return Staged(folder, n)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = store_of(self.root)
        moves = []
        for m in filter(None, messages):
            _, at = store_of(m.folder)
            moves += [(i.path, f"{root}/{i.path.rpartition('/')[2]}") for i in store.get_file_info(fs.FileSelector(f"{at}/files"))]
        names = [to for _, to in moves]
        there = [] if self.overwrite else [i.path for i in store.get_file_info(names) if i.type != fs.FileType.NotFound]
        if there or len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"already there: {there[0]}" if there else "a file name occurs twice")
        for source, to in moves:
            store.move(source, to)
        store.create_dir(f"{root}/_status/{self.tag}", recursive=True)
        for m in filter(None, messages):
            _, at = store_of(m.folder)
            store.move(f"{at}/status.json", f"{root}/_status/{self.tag}/{at.rpartition('/')[2]}.json")
        store.delete_dir(store_of(self.stage)[1])

    def abort(self, messages) -> None:
        store, at = store_of(self.stage)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class WordPackages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wordpackages"

    def schema(self) -> str:
        return "file string, content binary, converted int, warnings array<string>, error string"

    def writer(self, schema, overwrite: bool) -> PackagesWriter:
        return PackagesWriter(self.options, overwrite)


def registered(spark: SparkSession) -> None:
    spark.dataSource.register(WordParts)
    spark.dataSource.register(WordPackages)
    spark.conf.set(PUSHDOWN, "true")


def read_parts(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """PARTS of a folder's packages: story parts, unless members is all.

    Spark keeps the filters that it pushes with the relation, so what one query filters in two ways must be read twice.
    """
    registered(spark)
    return spark.read.format("wordparts").options(**options).load(folder)


def publish(results: DataFrame, folder: str, overwrite: bool = False, tag: str | None = None) -> DataFrame:
    """results (path, content, converted, warnings, error) as files of the same names in another folder; returns the rows of status of this call."""
    spark = results.sparkSession
    registered(spark)
    tag = tag or uuid.uuid4().hex
    rows = results.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", "converted", "warnings", "error")
    rows.write.format("wordpackages").option("tag", tag).mode("overwrite" if overwrite else "append").save(folder)
    return spark.read.schema("file string, published boolean, converted int, warnings array<string>, error string").json(f"{folder.rstrip('/')}/_status/{tag}")
