"""Record shards as a Spark data source: a partition for each file, and a sink whose files appear only when all are written."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators import model
from .msgpack import items, pack, sized

SCHEMA = (
    "text string, font string, num_nodes bigint, node_dim int, num_edges bigint, num_contours bigint, node_features array<float>, edge_index array<bigint>, "
    "edge_features array<float>, contour_features array<float>, edge_labels array<smallint>, node_char_ids array<bigint>, node_contour_ids array<bigint>"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: The array columns of a record and their numbers' types.
ARRAYS = {"node_features": "f4", "edge_index": "u4", "edge_features": "f4", "contour_features": "f4", "edge_labels": "u1", "node_char_ids": "u4", "node_contour_ids": "u4"}
FORMAT = "graph_shards"
#: Records that are decoded at a time.
AT_ONCE = 64


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def record(row: dict) -> bytes:
    """A row of SCHEMA as it is stored."""
    arrays = {c: np.asarray(row[c], kind) for c, kind in ARRAYS.items()}
    numbers = {c: int(row[c]) for c in ("num_nodes", "node_dim", "num_contours")}
    return pack({**numbers, "edge_dim": len(model.EDGE), "contour_dim": len(model.CONTOUR), **arrays, "text": row["text"], "font": row["font"]})


@dataclass
class File(InputPartition):
    path: str


class ShardReader(DataSourceReader):
    def __init__(self, folder: str, limit: int, schema: StructType | None = None):
        self.folder, self.limit, self.schema = folder, limit, schema

    def partitions(self) -> list[File]:
        """The .msgpack files right in the folder, by name; the first limit of them unless that is 0. None is opened here."""
        fs, at = opened(self.folder)
        found = fs.get_file_info(pa.fs.FileSelector(at))
        names = sorted(f.base_name for f in found if f.type == pa.fs.FileType.File and f.extension == "msgpack")
        if not names:
            raise ValueError(f"no shards in {self.folder}")
        return [File(f"{self.folder.rstrip('/')}/{n}") for n in names[: self.limit or None]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        """The records of a file, a few at a time: the file's bytes are in memory, not all its records."""
        fs, at = opened(partition.path)
        with fs.open_input_file(at) as f:
            raw = f.read_buffer()
        schema, held = to_arrow_schema(self.schema), []
        for r in items(memoryview(raw)):
            held.append({"text": "", "font": "", "num_edges": len(r.get("edge_labels", ())), **{k: v for k, v in r.items() if k in NAMES}})
            if len(held) == AT_ONCE:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ShardWriter(DataSourceArrowWriter):
    """Rows of SCHEMA and shard, in order of shard: each task writes its shards beside their final place, and the driver moves
    them there when all tasks have ended. A task that fails or runs twice leaves nothing that is read."""

    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    def _beside(self) -> str:
        return f"{self.folder}/_writing_{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = opened(self._beside())
        fs.create_dir(at, recursive=True)
        attempt, files, shard, parts = uuid.uuid4().hex, [], None, []

        def closed() -> None:
            if shard is not None:
                name = f"shard_{shard:05}.msgpack"
                with fs.open_output_stream(f"{at}/{attempt}_{name}") as f:
                    f.write(sized(len(parts), 0x90, 15, "dcdd"))
                    for p in parts:
                        f.write(p)
                files.append((f"{attempt}_{name}", name))

        for batch in iterator:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    closed()
                    shard, parts = row["shard"], []
                if row["num_nodes"] is not None:
                    parts.append(record(row))
        closed()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self._beside())
        _, to = opened(self.folder)
        for m in messages:
            for name, final in m.files if m else ():
                fs.move(f"{at}/{name}", f"{to}/{final}")
        fs.delete_dir(at)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = opened(self._beside())
        if fs.get_file_info(at).type == pa.fs.FileType.Directory:
            fs.delete_dir(at)


class Shards(DataSource):
    """Options: path, a folder; limit, how many shards to read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options["path"], int(self.options.get("limit", 0)), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"])


def folder_of(spark: SparkSession, folder: str) -> str:
    """The folder as all executors reach it; ValueError for a path of one machine on a cluster."""
    if "://" not in folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} must be an address that all executors reach")
    return folder


def read(spark: SparkSession, folder: str, limit: int = 0) -> DataFrame:
    """Records of a folder's .msgpack shards; of the first limit by name unless that is 0. A folder without any is an error."""
    spark.dataSource.register(Shards)
    folder = folder_of(spark, folder)
    ShardReader(folder, limit).partitions()
    return spark.read.format(FORMAT).option("limit", str(limit)).load(folder)


def write(rows: DataFrame, folder: str, size: int, count: int) -> DataFrame:
    """Writes records (SCHEMA and g) to shard_00000.msgpack and on in folder, graph g to shard g div size; (shard, n).

    There is a file for each shard of count graphs; graphs that were filtered out leave shorter ones. A shard is in one task,
    its size bounds it. Files of the same names are replaced when all tasks have ended; if one fails for good, none appears.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Shards)
    shard = F.expr(f"g div {size}").alias("shard")
    every = spark.range((count + size - 1) // size).select(F.col("id").alias("shard"))
    own = rows.select(shard, "g", *NAMES)
    placed = own.unionByName(every, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("g").asc_nulls_first())
    placed.drop("g").write.format(FORMAT).mode("append").save(folder_of(spark, folder))
    return every.join(own.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left").na.fill(0, ["n"])
