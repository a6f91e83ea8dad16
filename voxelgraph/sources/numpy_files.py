"""NumPy files as a Spark data source: byte ranges of .npy files and of stored .npz members, a partition for each run of voxels.

A partition reads its own rows of its own subject and its own rows of the coordinates, so no task holds a file. Filters on subject_id
are taken over by the source: other subjects' bytes aren't read. Paths are local or shared ones, or of any store that pyarrow.fs opens.
A compressed .npz member can't be cut: it becomes one partition, inflated and sent on a run of rows at a time.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from voxelgraph.functions.series import lists

VOXELS = "subject_id int, voxel_id long, i int, j int, k int, series array<double>"
DATA_KEYS, COORD_KEYS = ("data", "arr_0"), ("voxel_coord", "coords", "arr_0")

#: Bytes of a partition, about, and of a batch.
PARTITION, BATCH = 64 << 20, 4 << 20


def opened(path: str):
    fs, inner = pa.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


@dataclass(frozen=True)
class Stored:
    """An array in a file: where its bytes begin (None: in a compressed member of this name), its shape and type."""

    path: str
    at: int | None
    member: str | None
    shape: tuple[int, ...]
    kind: str

    def rows(self, first: int, n: int, row: int) -> np.ndarray:
        """n rows of `row` values, from row `first` on."""
        size = np.dtype(self.kind).itemsize * row
        with opened(self.path) as f:
            return np.frombuffer(f.read_at(n * size, self.at + first * size), self.kind).reshape(n, row)

    def stream(self, row: int, batch: int) -> Iterator[np.ndarray]:
        """All rows in order, a batch at a time, of a compressed member."""
        size = np.dtype(self.kind).itemsize * row
        with opened(self.path) as f, zipfile.ZipFile(f) as archive, archive.open(self.member) as inner:
            _header(inner)
            while raw := inner.read(batch * size):
                yield np.frombuffer(raw, self.kind).reshape(-1, row)


def _header(f) -> tuple[tuple[int, ...], str]:
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran and len(shape) > 1:
        raise ValueError("arrays in Fortran order can't be read by rows")
    if kind.hasobject:
        raise ValueError("arrays of objects aren't read")
    return shape, kind.str


def pick(names: list[str], keys: tuple[str, ...]) -> str:
    """The array under the first of keys, else the only one."""
    for key in keys:
        if key in names:
            return key
    if len(names) == 1:
        return names[0]
    raise ValueError(f"no array named {', '.join(keys)} among {names}")


def find(path: str, keys: tuple[str, ...]) -> Stored:
    with opened(path) as f:
        if path.endswith(".npy"):
            head = io.BytesIO(f.read_at(min(f.size(), 1 << 16), 0))
            shape, kind = _header(head)
            return Stored(path, head.tell(), None, shape, kind)
        with zipfile.ZipFile(f) as archive:
            name = pick([n.removesuffix(".npy") for n in archive.namelist()], keys) + ".npy"
            info = archive.getinfo(name)
            with archive.open(name) as inner:
                shape, kind = _header(inner)
            if info.compress_type != zipfile.ZIP_STORED:
                return Stored(path, None, name, shape, kind)
            size = np.dtype(kind).itemsize * prod(shape)
            named, extra = struct.unpack("<HH", f.read_at(4, info.header_offset + 26))
            return Stored(path, info.header_offset + 30 + named + extra + info.file_size - size, name, shape, kind)


class Run(InputPartition):
    """Voxels first to first + n of one subject; subject None: all of a compressed member."""

    def __init__(self, data: Stored, coord: Stored, subject: int | None, first: int, n: int):
        self.data, self.coord, self.subject, self.first, self.n = data, coord, subject, first, n


class NumpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.only = options, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("subject_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        data, coord = find(self.options["data"], DATA_KEYS), find(self.options["coord"], COORD_KEYS)
        if len(data.shape) != 3 or len(coord.shape) != 2 or coord.shape[0] != data.shape[1]:
            raise ValueError("data is (subjects, voxels, times) and coordinates (voxels, axes), with as many voxels")
        if coord.shape[1] < 3:
            raise ValueError("three coordinates are needed")
        subjects, voxels, times = data.shape
        if data.at is None:
            return [Run(data, coord, None, 0, voxels)]
        most = max(1, int(self.options.get("partition", PARTITION)) // max(1, times * np.dtype(data.kind).itemsize))
        return [Run(data, coord, s, v, min(most, voxels - v)) for s in range(subjects) if self.only is None or s in self.only for v in range(0, voxels, most)]

    def _batch(self, coord: Stored, s: int, first: int, x: np.ndarray) -> pa.RecordBatch:
        if coord.at is None:
            xyz = np.concatenate(list(coord.stream(coord.shape[1], 1 << 16)))[first : first + len(x)]
        else:
            xyz = coord.rows(first, len(x), coord.shape[1])
        axes = [pa.array(xyz[:, c].astype("int32")) for c in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), s, "int32")), pa.array(np.arange(first, first + len(x))), *axes, lists(x.astype(float))], names=["subject_id", "voxel_id", "i", "j", "k", "series"])

    def read(self, part: Run) -> Iterator[pa.RecordBatch]:
        subjects, voxels, times = part.data.shape
        step = max(1, BATCH // (8 * max(1, times)))
        if part.subject is not None:
            for v in range(part.first, part.first + part.n, step):
                n = min(step, part.first + part.n - v)
                yield self._batch(part.coord, part.subject, v, part.data.rows(part.subject * voxels + v, n, times))
            return
        at = 0
        for x in part.data.stream(times, step):
            while len(x):
                s, v = divmod(at, voxels)
                n = min(len(x), voxels - v)
                if self.only is None or s in self.only:
                    yield self._batch(part.coord, s, v, x[:n])
                at, x = at + n, x[n:]


class NumpyVoxels(DataSource):
    """spark.read.format("numpy_voxels").option("data", ...).option("coord", ...)"""

    @classmethod
    def name(cls) -> str:
        return "numpy_voxels"

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema) -> NumpyReader:
        return NumpyReader(dict(self.options))
