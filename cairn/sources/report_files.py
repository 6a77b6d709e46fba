"""A sink of named text files, one for each row: spark.dataSource.register(ReportFiles), then df.write.format("report_files").

Rows are (name string, text string). Each task writes into a folder of its own
attempt below the target; commit moves the files of the attempts that count into
place, abort deletes them. So a failed or repeated task leaves no file, and
readers see a file whole or not at all. A name with a slash, a blank or a
repeated one fails the write. Paths are those of pyarrow.fs (file, hdfs, s3, gs).

One file for each report is what its readers ask for. By default all lie in the
target itself: the driver knows every name and renames them one by one, so this
is for reports that people open. Many go into folders (option folders, or
write_in_folders): a task's files stay together in a folder of the target, so
the driver renames and lists folders alone, whatever the number of files. Rows
are dealt by name then, so equal names meet in a task; a target takes one write.
spark.read.format("report_files").load(path) reads both: (name, text), a task for each folder.

A small file takes a block of its disk at least, so where reports are small and
as many as documents, packages take their place (option packages, for writing
and reading, or write_in_packages): each task's files in one tar archive, packed
with zstd, from which `tar --zstd -x` takes the same named files. Rows stay
where they are then; names are compared by themselves before, in Spark.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


#: A package's name within its task's folder.
PACKAGE = "reports.tar.zst"


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder and the names in it."""

    folder: str
    names: list[str]


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ReportFiles(DataSource):
    """The data source; option path is the folder, mode overwrite replaces files of the same names and leaves others."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackageReader(self.options["path"]) if self.options.get("packages", "false") == "true" else ReportReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields][:2] != ["name", "text"]:
            raise ValueError("rows of report files are (name, text)")
        if self.options.get("packages", "false") == "true":
            return PackageWriter(self.options["path"], overwrite)
        if self.options.get("folders", "false") == "true":
            return FolderWriter(self.options["path"], overwrite)
        return ReportWriter(self.options["path"], overwrite)


def write_in_folders(rows: DataFrame, path: str, parts: int) -> None:
    """rows (name, text) as files in so many folders of the target, which has none yet."""
    rows.repartition(parts, "name").write.format("report_files").option("folders", "true").mode("append").save(path)


def write_in_packages(rows: DataFrame, path: str, names: DataFrame) -> None:
    """rows (name, text) as files in packages, one for each partition, of a target that has none yet.

    names has the names of rows, made without their texts: of two rows with one name in it nothing is written.
    """
    twice = names.groupBy("name").count().filter("count > 1").select("name").head(3)
    if twice:
        raise ValueError(f"files that have one name: {[r['name'] for r in twice]}")
    rows.write.format("report_files").option("packages", "true").mode("append").save(path)


def _checked(name: str | None) -> str:
    if not name or "/" in name or name.startswith("."):
        raise ValueError(f"no name for a file: {name!r}")
    return name


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, root = file_system(self.path)
        folder = f"{root}/.{self.job}/{uuid.uuid4().hex}"  # an attempt's own
        system.create_dir(folder, recursive=True)
        names: list[str] = []
        for row in rows:
            with system.open_output_stream(f"{folder}/{_checked(row['name'])}") as out:
                out.write((row["text"] or "").encode())
            names.append(row["name"])
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        done = [m for m in messages if m]
        names = [n for m in done for n in m.names]
        from pyarrow import fs

        there = {f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.is_file} if not self.overwrite else set()
        twice = {n for n in names if n in there} | {n for n, k in Counter(names).items() if k > 1}
        if twice:
            self.abort(messages)
            raise ValueError(f"files that are there already or have one name: {sorted(twice)[:3]}")
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: system.move(*x), ((f"{m.folder}/{n}", f"{root}/{n}") for m in done for n in m.names)))
        system.delete_dir(f"{root}/.{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        from pyarrow import fs

        if system.get_file_info(f"{root}/.{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/.{self.job}")


class FolderWriter(ReportWriter):
    """A folder for each task. Messages name folders alone, and commit moves those."""

    def write(self, rows: Iterator) -> Written:
        names: set[str] = set()

        def once():
            for row in rows:
                if row["name"] in names:
                    raise ValueError(f"files that have one name: {row['name']!r}")
                names.add(row["name"])
                yield row

        return Written(super().write(once()).folder, [])

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        if any(not f.base_name.startswith(".") for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True))):
            self.abort(messages)
            raise ValueError(f"there already are files by name in {self.path}")
        for m in messages:
            if m:
                system.move(m.folder, f"{root}/{m.folder.rsplit('/', 1)[1]}")
        if system.get_file_info(f"{root}/.{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/.{self.job}")


class Frames:
    """What is written goes to out as zstd frames of some megabytes each: half of the size that a stream at pyarrow's fixed level has."""

    def __init__(self, out) -> None:
        import pyarrow as pa

        self.out, self.codec, self.held, self.size = out, pa.Codec("zstd", compression_level=9), [], 0

    def write(self, data: bytes) -> int:
        self.held.append(bytes(data))
        self.size += len(data)
        if self.size >= 4 << 20:
            self.flush()
        return len(data)

    def flush(self) -> None:
        if self.size:
            self.out.write(self.codec.compress(b"".join(self.held)))
        self.held, self.size = [], 0

    def __enter__(self) -> Frames:
        return self

    def __exit__(self, *error) -> None:
        self.flush()


class PackageWriter(FolderWriter):
    """A package for each task, in its folder."""

    def write(self, rows: Iterator) -> Written:
        import io
        import tarfile

        system, root = file_system(self.path)
        folder = f"{root}/.{self.job}/{uuid.uuid4().hex}"  # an attempt's own
        system.create_dir(folder, recursive=True)
        names: set[str] = set()
        with system.open_output_stream(f"{folder}/{PACKAGE}", compression=None) as out, Frames(out) as frames, tarfile.open(fileobj=frames, mode="w|", format=tarfile.PAX_FORMAT) as package:
            for row in rows:
                if row["name"] in names:
                    raise ValueError(f"files that have one name: {row['name']!r}")
                names.add(row["name"])
                raw = (row["text"] or "").encode()
                member = tarfile.TarInfo(_checked(row["name"]))
                member.size = len(raw)
                package.addfile(member, io.BytesIO(raw))
        return Written(folder, [])


class ReportReader(DataSourceReader):
    """A task for each folder, and one for the files in the target itself."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = file_system(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(root)) if not f.base_name.startswith(".")]
        folders = [f.path for f in found if f.type == fs.FileType.Directory]
        return [InputPartition(f) for f in ([root] if len(folders) < len(found) else []) + folders] or [InputPartition(root)]

    def files(self, folder: str) -> Iterator[tuple[str, bytes]]:
        from pyarrow import fs

        system, _ = file_system(self.path)
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.is_file and not f.base_name.startswith("."):
                with system.open_input_stream(f.path) as file:
                    yield f.base_name, file.read()

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([("name", pa.string()), ("text", pa.string())])
        names, texts = [], []
        for name, raw in self.files(partition.value):
            names.append(name)
            texts.append(raw.decode())
            if len(names) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], schema=kind)
                names, texts = [], []
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], schema=kind)


class PackageReader(ReportReader):
    """A task for each package, which passes file by file."""

    def files(self, folder: str) -> Iterator[tuple[str, bytes]]:
        import tarfile

        from pyarrow import fs

        system, _ = file_system(self.path)
        if system.get_file_info(f"{folder}/{PACKAGE}").type != fs.FileType.File:
            return
        with system.open_input_stream(f"{folder}/{PACKAGE}", compression="zstd") as raw, tarfile.open(fileobj=raw, mode="r|") as package:
            for member in package:
                yield member.name, package.extractfile(member).read()
                package.members = []  # else all headers are kept
