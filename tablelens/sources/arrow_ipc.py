"""Arrow IPC files as a Spark data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 128 * 1024 * 1024


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of one file, or of the .ipc and .arrow files below a folder."""
    from pyarrow import fs

    system, root = _open(path)
    found = system.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    infos = system.get_file_info(fs.FileSelector(root, recursive=True))
    head = path[: len(path) - len(root)] if path.endswith(root) else ""
    return sorted((head + i.path, i.size) for i in infos if i.path.lower().endswith((".ipc", ".arrow")))


class _Slice(InputPartition):
    """Share `part` of `parts` of one file's record batches."""

    def __init__(self, path: str, part: int, parts: int):
        super().__init__(part)
        self.path, self.part, self.parts = path, part, parts


class _Reader(DataSourceReader):
    def __init__(self, schema, files):
        self.schema, self.files = schema, files

    def partitions(self):
        # Shares come from the listed sizes; no file is opened on the driver.
        out = []
        for path, size in self.files:
            parts = max(1, -(-size // SPLIT_BYTES))
            out += [_Slice(path, i, parts) for i in range(parts)]
        return out

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.schema)
        system, path = _open(partition.path)
        with system.open_input_file(path) as source:
            reader = pa.ipc.open_file(source)
            n = reader.num_record_batches
            for i in range(n * partition.part // partition.parts, n * (partition.part + 1) // partition.parts):
                table = pa.Table.from_batches([reader.get_batch(i)])
                columns = []
                for field in want:
                    column = table.column(field.name)
                    if pa.types.is_dictionary(column.type):
                        column = column.cast(column.type.value_type)
                    columns.append(column.cast(field.type, safe=False))
                yield from pa.Table.from_arrays(columns, schema=want).to_batches()


class ArrowIpcSource(DataSource):
    """format('arrow_ipc'): option `path` names a file or a folder of IPC files."""

    @classmethod
    def name(cls):
        return "arrow_ipc"

    def _listed(self):
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no .ipc or .arrow file below {self.options['path']}")
        return files

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        system, path = _open(self._listed()[0][0])
        with system.open_input_file(path) as source:
            found = pa.ipc.open_file(source).schema
        plain = [
            f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in found
        ]
        return from_arrow_schema(pa.schema(plain))

    def reader(self, schema):
        return _Reader(schema, self._listed())


def read_ipc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Arrow IPC files; a file or folder, or a list of them with one schema."""
    spark.dataSource.register(ArrowIpcSource)
    paths = [path] if isinstance(path, str) else path
    frames = [spark.read.format("arrow_ipc").load(p) for p in paths]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
