"""Python data sources: ``.npy`` volumes read by plane ranges, and VTK XML sinks (``.vti`` pieces with their ``.pvti``, ``.vtp`` with their ``.pvtp``).

Paths are whatever ``pyarrow.fs`` opens from driver and executors: a shared mount, S3, GCS or HDFS. ``register`` makes the
formats known to a session."""

from __future__ import annotations

import ast
import re
import struct
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _files(path: str, suffix: str) -> list[str]:
    """The file itself, or a folder's files with the suffix, sorted."""
    fs, at = _opened(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [at]
    return sorted(i.path for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File and i.path.endswith(suffix))


def npy_header(stream) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """Type, Fortran order, shape and the data's first byte."""
    magic = stream.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = 2 if magic[6] == 1 else 4
    size = struct.unpack("<H" if wide == 2 else "<I", stream.read(wide))[0]
    head = ast.literal_eval(stream.read(size).decode("latin1"))
    return np.dtype(head["descr"]), head["fortran_order"], tuple(head["shape"]), 8 + wide + size


@dataclass
class Planes(InputPartition):
    path: str
    first: int
    last: int

    def __hash__(self) -> int:
        return hash((self.path, self.first))


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.step = options["path"], int(options.get("planes", "8"))
        self.channels = len(schema.fields) - 4
        self.low, self.high = 0, None  # planes wanted

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds on ``z`` limit what is read; Spark tests the filters once more."""
        for f in filters:
            if getattr(f, "attribute", None) == ("z",):
                if isinstance(f, (EqualTo, In)):
                    values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                    self._bound(min(values), max(values))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self._bound(f.value + isinstance(f, GreaterThan), None)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self._bound(None, f.value - isinstance(f, LessThan))
            yield f

    def _bound(self, low: int | None, high: int | None) -> None:
        self.low = max(self.low, low if low is not None else 0)
        self.high = high if self.high is None else self.high if high is None else min(self.high, high)

    def partitions(self) -> list[Planes]:
        """Ranges of planes of every file, of which the headers alone are read here."""
        out = []
        for path in _files(self.path, ".npy"):
            with _opened(self.path)[0].open_input_file(path) as stream:
                shape = npy_header(stream)[2]
            last = shape[0] - 1 if self.high is None else min(shape[0] - 1, self.high)
            out += [Planes(path, z, min(z + self.step - 1, last)) for z in range(self.low, last + 1, self.step)]
        return out or [Planes("", 0, -1)]

    def read(self, partition: Planes) -> Iterator[pa.RecordBatch]:
        if partition.last < partition.first:
            return
        name = re.sub(r"\.npy$", "", partition.path.rsplit("/", 1)[-1])
        with _opened(self.path)[0].open_input_file(partition.path) as stream:
            kind, fortran, shape, start = npy_header(stream)
            if fortran or len(shape) not in (3, 4) or kind.hasobject:
                raise ValueError(f"{partition.path}: planes of a C-ordered (Z, Y, X) or (Z, Y, X, C) array are read, not {shape}")
            if (shape[3] if len(shape) == 4 else 1) != self.channels:
                raise ValueError(f"{partition.path}: {shape} does not hold {self.channels} channels")
            size = int(np.prod(shape[1:])) * kind.itemsize
            y, x = np.indices(shape[1:3], np.int32)
            for z in range(partition.first, partition.last + 1):
                stream.seek(start + z * size)
                raw = stream.read(size)
                if len(raw) < size:
                    raise ValueError(f"{partition.path} ends within plane {z}")
                plane = np.frombuffer(raw, kind).reshape(*shape[1:3], self.channels)
                yield pa.RecordBatch.from_arrays([pa.array([name] * y.size), pa.array(np.full(y.size, z, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), *(pa.array(plane[..., c].ravel().astype(np.float64)) for c in range(self.channels))], ["dataset_id", "z", "y", "x", *(f"c{c}" for c in range(self.channels))])


class NpyVolumes(DataSource):
    """``dataset_id, z, y, x, c0, ...`` of (Z, Y, X, C) or (Z, Y, X) arrays; options ``path`` (a file or folder), ``channels``, ``planes`` (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "npy_planes"

    def schema(self) -> str:
        return "dataset_id string, z int, y int, x int, " + ", ".join(f"c{c} double" for c in range(int(self.options.get("channels", "1"))))

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(dict(self.options), schema)


@dataclass
class Piece(WriterCommitMessage):
    written: str | None
    lines: str


NAMES = {pa.float64(): "Float64", pa.float32(): "Float32", pa.int32(): "Int32", pa.int64(): "Int64", pa.bool_(): "UInt8"}


def _array(name: str, kind: pa.DataType, values: np.ndarray, width: int = 1) -> str:
    text = " ".join(map(repr, values.tolist())) if values.dtype.kind == "f" else " ".join(map(str, values.astype(np.int64).tolist()))
    more = f' NumberOfComponents="{width}"' if width > 1 else ""
    return f'<DataArray type="{NAMES[kind]}" Name="{name}"{more} format="ascii">{text}</DataArray>'


def _file(kind: str, head: str, body: str) -> str:
    return f'<?xml version="1.0"?>\n<VTKFile type="{kind}" version="1.0" byte_order="LittleEndian">\n<{kind}{head}>\n{body}\n</{kind}>\n</VTKFile>\n'


class VtkWriter(DataSourceArrowWriter):
    """Each task writes its piece under a temporary name; the commit moves the pieces to their places and writes the index that
    names them, last. An abort, or a commit, takes the temporary folder away with what failed attempts left there."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = options["path"].rstrip("/"), options["kind"], overwrite
        self.shape = [int(v) for v in options["shape"].split(",")] if self.kind == "vti" else []
        self.spacing = options.get("spacing", "1,1,1").split(",")  # z, y, x
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Piece:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Piece(None, "")
        rows = pa.Table.from_batches(batches)
        lines, text = self._image(rows) if self.kind == "vti" else self._surface(rows)
        fs, at = _opened(self.path)
        fs.create_dir(f"{at}/{self.job}", recursive=True)
        # attempts of one task don't share a name
        name = f"{self.job}/{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{at}/{name}") as out:
            out.write(text.encode())
        return Piece(name, lines)

    def _image(self, rows: pa.Table) -> tuple[str, str]:
        at = [rows[c].to_numpy().astype(np.int64) for c in ("z", "y", "x")]
        low, high = int(at[0].min()), int(at[0].max())
        size = (high - low + 1, *self.shape[1:])
        extent = f"0 {self.shape[2] - 1} 0 {self.shape[1] - 1} {low} {high}"
        arrays = []
        for name in rows.column_names:
            if name in ("z", "y", "x"):
                continue
            kind = rows.schema.field(name).type
            own = rows[name].to_numpy(zero_copy_only=False)
            full = np.full(size, np.nan if pa.types.is_floating(kind) else 0, own.dtype)
            full[at[0] - low, at[1], at[2]] = own
            arrays.append(_array(name, kind, full.ravel()))  # x runs fastest
        z, y, x = self.spacing
        head = f' WholeExtent="{extent}" Origin="0 0 0" Spacing="{x} {y} {z}"'
        return f'<Piece Extent="{extent}" Source="{{}}"/>', _file("ImageData", head, f'<Piece Extent="{extent}"><PointData>{"".join(arrays)}</PointData></Piece>')

    def _surface(self, rows: pa.Table) -> tuple[str, str]:
        corners = np.stack([np.stack([rows[f"{c}{k}"].to_numpy() for c in "xyz"], 1) for k in range(4)], 1)
        points, index = np.unique(corners.reshape(-1, 3), axis=0, return_inverse=True)
        fields = [c for c in rows.column_names if not re.fullmatch(r"[xyz][0-3]", c)]
        data = "".join(_array(c, rows.schema.field(c).type, rows[c].to_numpy(zero_copy_only=False)) for c in fields)
        polys = _array("connectivity", pa.int64(), index.ravel()) + _array("offsets", pa.int64(), np.arange(1, len(rows) + 1) * 4)
        body = f'<Piece NumberOfPoints="{len(points)}" NumberOfPolys="{len(rows)}"><Points>{_array("points", pa.float64(), points.ravel(), 3)}</Points><Polys>{polys}</Polys><CellData>{data}</CellData></Piece>'
        return '<Piece Source="{}"/>', _file("PolyData", "", body)

    def commit(self, messages: list[Piece | None]) -> None:
        fs, at = _opened(self.path)
        fs.create_dir(at, recursive=True)
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(at)) if re.search(rf"(^|/)(part-\d+-\w+\.{self.kind}|index\.p{self.kind})$", i.path)]
        if old and not self.overwrite:
            raise ValueError(f"{self.path} holds pieces already")
        pieces, job = [], self.job[-8:]
        for k, m in enumerate(m for m in messages if m and m.written):
            name = f"part-{k:05d}-{job}.{self.kind}"
            fs.move(f"{at}/{m.written}", f"{at}/{name}")
            pieces.append(m.lines.format(name))
        whole, kind = "", "PPolyData"
        if self.kind == "vti":
            z, y, x = self.spacing
            kind, whole = "PImageData", f' WholeExtent="0 {self.shape[2] - 1} 0 {self.shape[1] - 1} 0 {self.shape[0] - 1}" GhostLevel="0" Origin="0 0 0" Spacing="{x} {y} {z}"'
        with fs.open_output_stream(f"{at}/index.p{self.kind}") as out:
            out.write(_file(kind, whole, "\n".join(pieces)).encode())
        for path in old:  # what the new index doesn't name
            if not path.endswith(f"index.p{self.kind}"):
                fs.delete_file(path)
        self.abort([])

    def abort(self, messages: list[Piece | None]) -> None:
        fs, at = _opened(self.path)
        if fs.get_file_info(f"{at}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.job}")


class VtkFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vtk_pieces"

    def writer(self, schema: StructType, overwrite: bool) -> VtkWriter:
        return VtkWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (NpyVolumes, VtkFiles):
        spark.dataSource.register(source)


def read_npy_planes(spark: SparkSession, path: str, channels: int = 1, planes: int = 8) -> DataFrame:
    """Volumes in ``.npy`` files as voxels, ``planes`` planes a partition; a filter on ``z`` leaves other planes' bytes unread."""
    register(spark)
    return spark.read.format("npy_planes").option("path", path).option("channels", channels).option("planes", planes).load()


def write_vti(vox: DataFrame, path: str, shape: tuple[int, int, int], fields: list[str], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), pieces: int | None = None) -> None:
    """A volume's columns as point data: ranges of planes are pieces, each a task's; absent voxels are NaN or 0."""
    register(vox.sparkSession)
    rows = vox.select("z", "y", "x", *fields)
    rows = rows.repartitionByRange(pieces, "z") if pieces else rows.repartitionByRange("z")
    rows.write.format("vtk_pieces").mode("overwrite").option("path", path).option("kind", "vti").option("shape", ",".join(map(str, shape))).option("spacing", ",".join(map(str, spacing))).save()


def write_vtp(faces: DataFrame, path: str) -> None:
    """Quads (corners ``x0, y0, z0`` to ``x3, y3, z3``, all other columns as cell data); a task's quads are a piece, its points are shared."""
    register(faces.sparkSession)
    faces.write.format("vtk_pieces").mode("overwrite").option("path", path).option("kind", "vtp").save()


def read_vti(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the ASCII pieces that a folder's index names: ``z, y, x`` and a double for each array. A piece is a task's row."""
    fs, at = _opened(path)
    with fs.open_input_file(f"{at}/index.pvti") as stream:
        names = [p.get("Source") for p in ET.fromstring(stream.read().decode()).iter("Piece")]
    if not names:
        return spark.createDataFrame([], "z int, y int, x int")
    with fs.open_input_file(f"{at}/{names[0]}") as stream:
        fields = [a.get("Name") for a in ET.fromstring(stream.read().decode()).iter("DataArray")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                piece = next(ET.fromstring(content.as_py().decode()).iter("Piece"))
                x0, x1, y0, y1, z0, z1 = map(int, piece.get("Extent").split())
                z, y, x = (a.ravel().astype(np.int32) for a in np.mgrid[z0 : z1 + 1, y0 : y1 + 1, x0 : x1 + 1])
                yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(y), pa.array(x), *(pa.array(np.array(a.text.split(), np.float64)) for a in piece.iter("DataArray"))], ["z", "y", "x", *fields])

    files = spark.read.format("binaryFile").load([f"{path.rstrip('/')}/{n}" for n in names]).select("content")
    return files.mapInArrow(parse, "z int, y int, x int, " + ", ".join(f"`{f}` double" for f in fields))
