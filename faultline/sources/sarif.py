"""SARIF as a data source: spark.read.format("sarif").load(folder), and df.write.format("sarif").mode("append").save(folder).

Large files are read in byte ranges, a task each, without a look at what stands before: an unescaped "ruleId" can only be a key,
the brace that opens its object is found by walking back over whole strings and brackets, and an object belongs to the range in
which it opens. Filters that compare a column with a value are applied while reading (Spark pushes them where
spark.sql.python.filterPushdown.enabled is set). Writers leave a file each, as one run with a result a line, in a folder aside;
the commit moves them into place, and what a lost task left goes with that folder."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "rule_id string, level string, message string, location string, line int, file string"
#: Bytes of a range, and of what is read at a time.
RANGE, CHUNK = 16 << 20, 1 << 20
_KEY = re.compile(rb'"ruleId"\s*:')


def _fs(path: str):
    """The file system of a path and the path in it; paths without a scheme are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else os.path.abspath(path))


def _escaped(data: bytes, at: int) -> bool:
    """Does an odd number of backslashes stand before."""
    n = at
    while n and data[n - 1] == 92:
        n -= 1
    return (at - n) % 2 == 1


def opening(data: bytes, at: int) -> int:
    """Where the object opens in which the key at the offset stands; -1 if before the data."""
    depth = 0
    at -= 1
    while at >= 0:
        c = data[at]
        if c == 34:  # the end of a string: go to its beginning
            at = data.rfind(b'"', 0, at)
            while at >= 0 and _escaped(data, at):
                at = data.rfind(b'"', 0, at)
            if at < 0:
                return -1
        elif c in b"}]":
            depth += 1
        elif c in b"{[":
            if depth == 0:
                return at
            depth -= 1
        at -= 1
    return -1


def results(handle, size: int, start: int, stop: int) -> Iterator[dict]:
    """The results that open in [start, stop) of an open file."""
    decode = json.JSONDecoder().raw_decode
    handle.seek(start)
    data, base, at, held = b"", start, 0, 0  # held: where the last result ended; what follows may belong to the next
    while True:
        m = _KEY.search(data, at)
        if m is None or m.end() == len(data):
            more = handle.read(CHUNK)
            if not more:
                return
            at = max(held, (m.start() if m else len(data) - len(b'"ruleId"') - 64))
            data, base, at, held = data[held:] + more, base + held, max(0, at - held), 0
            continue
        at = m.end()
        begin = -1 if _escaped(data, m.start()) else opening(data, m.start())
        if begin < 0:  # in a text, or of an object that opens before the range
            continue
        while (end := _closing(data, begin)) < 0:  # until all of the object is there
            more = handle.read(CHUNK)
            if not more:
                return
            data += more
        value, _ = decode(data[begin:end].decode())
        if isinstance(value, dict) and "message" in value:
            if base + begin >= stop:
                return
            yield value
            at = held = end


def _closing(data: bytes, begin: int) -> int:
    """The end of the object that opens at begin; -1 if it is not there yet."""
    depth, text = 0, False
    for m in re.finditer(rb'\\.|["{}]', data[begin:], re.S):
        c = m[0]
        if c == b'"':
            text = not text
        elif not text and c == b"{":
            depth += 1
        elif not text and c == b"}":
            depth -= 1
            if depth == 0:
                return begin + m.end()
    return -1


def _row(r: dict, name: str) -> tuple:
    place = ((r.get("locations") or [{}])[0] or {}).get("physicalLocation") or {}
    line = (place.get("region") or {}).get("startLine")
    return r.get("ruleId"), r.get("level") or r.get("kind"), (r.get("message") or {}).get("text"), (place.get("artifactLocation") or {}).get("uri"), line if isinstance(line, int) else None, name


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class SarifReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))
        self.allowed: list[tuple[int, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in names:
                self.allowed.append((names.index(f.attribute[0]), [f.value]))
            elif isinstance(f, In) and f.attribute[0] in names:
                self.allowed.append((names.index(f.attribute[0]), list(f.value)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = _fs(self.path)
        found = system.get_file_info(path)
        files = system.get_file_info(fs.FileSelector(path, recursive=True)) if found.type == fs.FileType.Directory else [found]
        plain = [f for f in files if f.is_file and not any(p[:1] in "._" for p in f.path[len(path) :].split("/") if p)]
        return [Range(f.path, at, min(at + self.range, f.size)) for f in plain for at in range(0, f.size, self.range)]

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = _fs(self.path)
        with system.open_input_file(partition.path) as handle:
            for r in results(handle, handle.size(), partition.start, partition.stop):
                row = _row(r, partition.path)
                if all(row[i] in values for i, values in self.allowed):
                    yield row


@dataclass
class Written(WriterCommitMessage):
    path: str


class SarifWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.tool, self.overwrite = options["path"], options.get("tool", "faultline"), overwrite
        self.aside = f"_writing-{uuid.uuid4().hex}"
        self.names = schema.names

    def write(self, iterator: Iterator) -> Written:
        system, path = _fs(self.path)
        system.create_dir(f"{path}/{self.aside}", recursive=True)
        name = f"part-{uuid.uuid4().hex}.sarif"  # a task that runs twice leaves two files, of which one is committed
        with system.open_output_stream(f"{path}/{self.aside}/{name}") as out:
            head = {"tool": {"driver": {"name": self.tool}}}
            out.write(b'{"version": "2.1.0", "runs": [' + json.dumps(head).encode()[:-1] + b', "results": [')
            first = True
            for row in iterator:
                r = dict(zip(self.names, row, strict=True))
                place = {"artifactLocation": {"uri": r.get("location")}} | ({"region": {"startLine": r["line"]}} if r.get("line") is not None else {})
                result = {"ruleId": r.get("rule_id"), "level": r.get("level"), "message": {"text": r.get("message") or ""}, "locations": [{"physicalLocation": place}]}
                out.write((b"\n" if first else b",\n") + json.dumps(result).encode())
                first = False
            out.write(b"\n]}]}\n")
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = _fs(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.is_file:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None:
                system.move(f"{path}/{self.aside}/{m.path}", f"{path}/{m.path}")
        self._clean(system, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_fs(self.path))

    def _clean(self, system, path: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{path}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.aside}")


class SarifSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sarif"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SarifReader:
        return SarifReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SarifWriter:
        return SarifWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters into Python sources."""
    spark.dataSource.register(SarifSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
