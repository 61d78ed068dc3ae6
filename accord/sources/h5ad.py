"""Optional source of annotated matrices: one row a sample and layer. Needs h5py, which is imported on use; Parquet is the usual interchange."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class H5adSource(DataSource):
    """spark.dataSource.register(H5adSource); spark.read.format("h5ad").option("paths", "a.h5ad,b.h5ad").load()"""

    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def schema(self) -> str:
        return "source_path string, row_pos int, layer string, vec array<float>"

    def reader(self, schema) -> DataSourceReader:
        return H5adReader(self.options["paths"].split(","))


class H5adReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import h5py

        with h5py.File(partition.value, "r") as f:
            for layer, data in f["layers"].items():
                if hasattr(data, "shape"):
                    for i in range(data.shape[0]):
                        yield partition.value, i, layer, [float(v) for v in data[i]]
                else:
                    starts, at, values = data["indptr"][:], data["indices"], data["data"]
                    width = int(data.attrs["shape"][1])
                    for i in range(len(starts) - 1):
                        row = [0.0] * width
                        for k, v in zip(at[starts[i] : starts[i + 1]], values[starts[i] : starts[i + 1]]):
                            row[int(k)] = float(v)
                        yield partition.value, i, layer, row
