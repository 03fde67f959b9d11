"""Files of binary values, back to back: a reader of one row per value, and a writer."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import wire

SUFFIX = ".values"
FIELDS = "path string, ordinal long, type string, json string, error string"


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal, type, json, error for each value of the files under path.

    A value that cannot be decoded keeps its row, with the error; bytes that
    cannot even be framed end their file with one such row.
    """

    def run(batches):
        for b in batches:
            rows = []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                at, k = 0, 0
                while at < len(content):
                    row = {"path": name, "ordinal": k, "type": None, "json": None, "error": None}
                    try:
                        row["type"], _, end = wire.read(content, at)
                    except wire.Malformed as e:
                        rows.append(row | {"error": str(e)})
                        break
                    try:
                        row["json"] = json.dumps(wire.plain(wire.decode(content, at)), ensure_ascii=False)
                    except wire.Malformed as e:
                        row["error"] = str(e)
                    rows.append(row)
                    at, k = end, k + 1
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("type", pa.string()), ("json", pa.string()), ("error", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FIELDS)


@F.pandas_udf(T.BinaryType())
def encoded(s):
    """The binary form of JSON text: numbers, strings, booleans, null, arrays as vectors, objects as records."""

    def of(v):
        if isinstance(v, dict):
            return wire.Record({k: of(x) for k, x in v.items()})
        return [of(x) for x in v] if isinstance(v, list) else v

    return s.map(lambda x: None if x is None else wire.encode(of(json.loads(x))))


@F.pandas_udf(T.StringType())
def decoded(b):
    """JSON text of a binary value; null where it is malformed."""

    def one(x):
        try:
            return None if x is None else json.dumps(wire.plain(wire.decode(bytes(x))), ensure_ascii=False)
        except wire.Malformed:
            return None

    return b.map(one)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, column: str, overwrite: bool, roll: int):
        self.path, self.column, self.overwrite, self.roll = path.removeprefix("file://"), column, overwrite, roll
        self.job = uuid.uuid4().hex  # one for all tasks and attempts of this write

    def write(self, iterator):
        from pyspark import TaskContext

        task, names = TaskContext.get(), []
        stem = f"part-{task.partitionId():05d}-{self.job}-{uuid.uuid4().hex}"
        os.makedirs(self.path, exist_ok=True)
        out, size = None, 0
        for batch in iterator:
            for b in batch.column(self.column).to_pylist():
                value = wire.encode(None) if b is None else b
                if out is not None and size + len(value) > self.roll:
                    out.close()
                    out = None
                if out is None:
                    names.append(f"{stem}-{len(names):03d}{SUFFIX}")
                    out, size = open(os.path.join(self.path, "_" + names[-1]), "wb"), 0
                out.write(value)
                size += len(value)
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages):
        new = [n for m in messages if m is not None for n in m.names]
        old = [n for n in os.listdir(self.path) if n.endswith(SUFFIX) and not n.startswith("_")] if self.overwrite and os.path.isdir(self.path) else []
        for n in new:
            os.rename(os.path.join(self.path, "_" + n), os.path.join(self.path, n))
        for n in old:
            os.remove(os.path.join(self.path, n))
        self._clean()

    def abort(self, messages):
        self._clean()

    def _clean(self):
        """Removes what attempts of this write have left that are not part of it."""
        for n in os.listdir(self.path) if os.path.isdir(self.path) else []:
            if n.startswith("_part-") and f"-{self.job}-" in n:
                os.remove(os.path.join(self.path, n))


@dataclass
class _Written(WriterCommitMessage):
    names: list


class ValueFiles(DataSource):
    """Sink "marlstone_values": a binary column of encoded values, back to back in files that read_values reads.

    The path is a folder mounted on the driver and all executors. Options:
    column, and roll, the size in bytes from which a task starts its next file.
    Files appear when the whole job commits; names with a leading underscore are
    of attempts under way, which the job's end removes and readers skip. A null is written as the null value.
    """

    @classmethod
    def name(cls):
        return "marlstone_values"

    def writer(self, schema, overwrite):
        column = self.options.get("column", schema.names[0])
        if not isinstance(schema[column].dataType, T.BinaryType):
            raise ValueError(f"column {column} is not binary")
        return _Writer(self.options["path"], column, overwrite, int(self.options.get("roll", 64 << 20)))


def write_values(df: DataFrame, column: str, path: str, mode: str = "append", roll: int = 64 << 20) -> None:
    df.sparkSession.dataSource.register(ValueFiles)
    df.select(column).write.format(ValueFiles.name()).option("column", column).option("roll", roll).mode(mode).save(path)
