"""GeoTIFF files as a Spark data source: ``spark.read.format("geotiff")`` and ``df.write.format("geotiff")`` once ``register`` has run.

Reading: a partition a file, a row for each band of each internal tile, so no raster is one row; files are left out by the date in their names
(..._20240131.tif) where a filter allows.  Classic and big TIFF of either byte order, tiles or strips, bands by pixel or by plane, plain or DEFLATE,
with horizontal (2) or floating-point (3) predictor; other compressions are errors.

Writing: a row a file, with all its bands: tiles of 256 x 256, DEFLATE level 5, predictor 2 for whole numbers and 3 for floats, a plane a band with its name.
Nulls become the raster's nodata value (floats: NaN without one).  A file gets its name when the whole job succeeds; a task or job that fails leaves none.

Folders may be in any store that pyarrow opens (file, s3, gs, abfs, hdfs).
"""

from __future__ import annotations

import datetime as dt
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

TILE = 256
READ_SCHEMA = "path string, obs_date date, band int, name string, row0 int, col0 int, height int, width int, west double, north double, step_x double, step_y double, epsg int, nodata double, data array<double>"
WRITE_SCHEMA = "name string, obs_date date, height int, width int, west double, north double, step_x double, step_y double, epsg int, dtype string, nodata double, names array<string>, bands array<array<double>>"

# Fixed values of the TIFF and GeoTIFF formats: field types (struct codes), tags, sample formats by kind of number.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, BANDS, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT, PIXEL_SCALE, TIE_POINT, GEO_KEYS, GDAL_METADATA, GDAL_NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42112, 42113
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
KINDS = {1: "u", 2: "i", 3: "f"}


def _store(path: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def day_of(path: str) -> dt.date | None:
    """The day in a name such as product_20240131.tif."""
    found = re.search(r"_(\d{8})\.tiff?$", path)
    try:
        return dt.datetime.strptime(found.group(1), "%Y%m%d").date() if found else None
    except ValueError:
        return None


# ---- predictors ----------------------------------------------------------------------------------------------------------


def predicted(values: np.ndarray, predictor: int) -> bytes:
    """Rows (height, width, samples) as bytes, differenced by pixel (2) or by byte planes (3)."""
    if predictor == 2:
        out = values.copy()
        out[:, 1:] -= values[:, :-1]
        return out.tobytes()
    if predictor == 3:
        height, width, samples = values.shape
        planes = values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(height, width * samples, -1).transpose(0, 2, 1).reshape(height, -1)
        out = planes.copy()
        out[:, samples:] -= planes[:, :-samples]
        return out.tobytes()
    return values.tobytes()


def unpredicted(raw: bytes, dtype: np.dtype, height: int, width: int, samples: int, predictor: int) -> np.ndarray:
    """The values of a tile or strip: (height, width, samples)."""
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8, height * width * samples * dtype.itemsize).reshape(height, -1, samples)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(height, dtype.itemsize, width * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(height, width, samples)
    values = np.frombuffer(raw, dtype, height * width * samples).reshape(height, width, samples)
    if predictor == 2:
        return np.cumsum(values, axis=1, dtype=dtype.newbyteorder("="))
    return values


# ---- files -----------------------------------------------------------------------------------------------------------------


class Tiff:
    """The first image of a TIFF file."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        head = file.read_at(16, 0)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        self.order = "<" if head[:2] == b"II" else ">"
        version = self._unpack("H", head, 2)[0]
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = version == 43
        at = self._unpack("Q", head, 8)[0] if self.big else self._unpack("I", head, 4)[0]
        n_format, entry = ("Q", 20) if self.big else ("H", 12)
        size = struct.calcsize(n_format)
        n = self._unpack(n_format, file.read_at(size, at), 0)[0]
        raw = file.read_at(n * entry, at + size)
        self.tags = dict(self._field(raw[i : i + entry]) for i in range(0, len(raw), entry))
        self.width, self.height = self.tags[WIDTH][0], self.tags[HEIGHT][0]
        self.samples, self.planar, self.predictor = self._one(BANDS, 1), self._one(PLANAR, 1) == 2, self._one(PREDICTOR, 1)
        bits, kind = set(self.tags.get(BITS, [1])), set(self.tags.get(FORMAT, [1]))
        if len(bits) > 1 or len(kind) > 1 or not bits <= {8, 16, 32, 64} or not kind <= set(KINDS):
            raise ValueError(f"samples of {sorted(bits)} bits and formats {sorted(kind)} are not supported")
        self.dtype = np.dtype(f"{self.order}{KINDS[kind.pop()]}{bits.pop() // 8}")
        if self._one(COMPRESSION, 1) not in (1, 8, 32946):
            raise ValueError(f"compression {self._one(COMPRESSION, 1)} is not supported")
        if self.predictor not in (1, 2, 3):
            raise ValueError(f"predictor {self.predictor} is not supported")
        tiled = TILE_OFFSETS in self.tags
        self.block = (self.tags[TILE_HEIGHT][0], self.tags[TILE_WIDTH][0]) if tiled else (min(self._one(ROWS_PER_STRIP, self.height), self.height), self.width)
        self.tiled, self.offsets, self.sizes = tiled, *((self.tags[TILE_OFFSETS], self.tags[TILE_BYTES]) if tiled else (self.tags[STRIP_OFFSETS], self.tags[STRIP_BYTES]))

    def _unpack(self, code: str, raw: bytes, at: int) -> tuple:
        return struct.unpack_from(self.order + code, raw, at)

    def _field(self, raw: bytes) -> tuple[int, list]:
        tag, kind, n = self._unpack("HHQ" if self.big else "HHI", raw, 0)
        code, at, room = TYPES.get(kind, "B"), (12, 8) if self.big else (8, 4), 8 if self.big else 4
        size = n * (1 if code == "s" else struct.calcsize(self.order + code))
        body = raw[at[0] :] if size <= room else self.file.read_at(size, self._unpack("Q" if self.big else "I", raw, at[0])[0])
        if code == "s":
            return tag, [body[:n].rstrip(b"\0").decode("utf-8", "replace")]
        return tag, list(self._unpack(code * n if len(code) > 1 else f"{n}{code}", body, 0))

    def _one(self, tag: int, default: int) -> int:
        return self.tags.get(tag, [default])[0]

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, [])
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return found.get(PROJECTED) or found.get(GEOGRAPHIC)

    @property
    def names(self) -> dict[int, str]:
        """Band (from 0) -> its description."""
        text = self.tags.get(GDAL_METADATA, [""])[0]
        items = ElementTree.fromstring(text).iter("Item") if text else ()
        return {int(i.get("sample", "0")): i.text or "" for i in items if i.get("role") == "description"}

    def corner(self) -> tuple[float | None, ...]:
        """west, north, step in x, step in y (downwards)."""
        scale, tie = self.tags.get(PIXEL_SCALE), self.tags.get(TIE_POINT)
        if not scale or not tie:
            return None, None, None, None
        return tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1]

    def tiles(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(band, first row, first column, values) of each band of each tile or strip, cut at the image's edges."""
        high, wide = self.block
        down, across = -(-self.height // high), -(-self.width // wide)
        nodata = self._one(GDAL_NODATA, "") if GDAL_NODATA in self.tags else ""
        for plane in range(self.samples if self.planar else 1):
            for i in range(down):
                for j in range(across):
                    k = (plane * down + i) * across + j
                    rows = high if self.tiled else min(high, self.height - i * high)
                    samples = 1 if self.planar else self.samples
                    if self.sizes[k]:
                        raw = self.file.read_at(self.sizes[k], self.offsets[k])
                        if self._one(COMPRESSION, 1) != 1:
                            raw = zlib.decompress(raw)
                        values = unpredicted(raw, self.dtype, rows, wide, samples, self.predictor)
                    else:  # a tile that was never written
                        values = np.full((rows, wide, samples), float(nodata) if nodata else 0).astype(self.dtype)
                    values = values[: self.height - i * high, : self.width - j * wide]
                    for s in range(samples):
                        yield (plane if self.planar else s), i * high, j * wide, values[:, :, s]


def encoded(bands: Sequence[np.ndarray], names: Sequence[str], west: float, north: float, step_x: float, step_y: float, epsg: int | None, nodata: float | None = None, level: int = 5) -> bytes:
    """A tiled GeoTIFF of bands (arrays of one shape and type), big if it needs more than 32-bit offsets."""
    height, width = bands[0].shape
    dtype = bands[0].dtype
    predictor = 3 if dtype.kind == "f" else 2
    blocks = []
    for band in bands:
        for i in range(0, max(height, 1), TILE):
            for j in range(0, max(width, 1), TILE):
                tile = np.zeros((TILE, TILE, 1), dtype.newbyteorder("<"))
                part = band[i : i + TILE, j : j + TILE]
                tile[: part.shape[0], : part.shape[1], 0] = part
                blocks.append(zlib.compress(predicted(tile, predictor), level))
    body = sum(map(len, blocks))
    big = body + 64 * len(blocks) + 100_000 > 1 << 32
    start = 16 if big else 8
    offsets = [start]
    for b in blocks[:-1]:
        offsets.append(offsets[-1] + len(b))
    n = len(bands)
    far = "Q" if big else "I"
    kind = {v: k for k, v in KINDS.items()}[dtype.kind]
    items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{_escaped(x)}</Item>' for i, x in enumerate(names))
    geographic = epsg is not None and 4000 <= epsg < 5000
    keys = [1, 1, 0, 3, MODEL_TYPE, 0, 1, 2 if geographic else 1, RASTER_TYPE, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, epsg or 32767]
    fields = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [dtype.itemsize * 8] * n), (COMPRESSION, "H", [8]), (PHOTOMETRIC, "H", [1]), (BANDS, "H", [n]), (PLANAR, "H", [2]), (PREDICTOR, "H", [predictor]),
        (TILE_WIDTH, "H", [TILE]), (TILE_HEIGHT, "H", [TILE]), (TILE_OFFSETS, far, offsets), (TILE_BYTES, far, [len(b) for b in blocks]), (FORMAT, "H", [kind] * n), (PIXEL_SCALE, "d", [step_x, step_y, 0.0]), (TIE_POINT, "d", [0.0, 0.0, 0.0, west, north, 0.0]),
        (GEO_KEYS, "H", keys), (GDAL_METADATA, "s", f"<GDALMetadata>{items}</GDALMetadata>"),
    ]
    if nodata is not None:
        fields.append((GDAL_NODATA, "s", repr(nodata)))
    at = start + body + (body & 1)
    entry, room, count = (20, 8, "Q") if big else (12, 4, "I")
    after = at + (8 if big else 2) + entry * len(fields) + (8 if big else 4)
    table, more = [], b""
    code_of = {"H": 3, "I": 4, "d": 12, "Q": 16, "s": 2}
    for tag, code, values in fields:
        raw = values.encode() + b"\0" if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        size = len(raw) if code == "s" else len(values)
        if len(raw) > room:
            held = struct.pack("<" + far, after + len(more))
            more += raw + b"\0" * (-len(raw) % 8)
        else:
            held = raw.ljust(room, b"\0")
        table.append(struct.pack("<HH" + count, tag, code_of[code], size) + held)
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    directory = struct.pack("<Q" if big else "<H", len(fields)) + b"".join(table) + b"\0" * (8 if big else 4)
    return b"".join([head, *blocks, b"\0" * (body & 1), directory, more])


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


# ---- the data source -------------------------------------------------------------------------------------------------------


@dataclass
class OneFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.days = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters by day choose files; all are given back, so files without a day in their name stay Spark's to judge."""
        for f in filters:
            if getattr(f, "attribute", None) == ("obs_date",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)):
                self.days.append(f)
            yield f

    def _wanted(self, day: dt.date | None) -> bool:
        if day is None:
            return not self.days  # a filter by day is never true of a null
        tests = {EqualTo: lambda f: day == f.value, GreaterThan: lambda f: day > f.value, GreaterThanOrEqual: lambda f: day >= f.value, LessThan: lambda f: day < f.value, LessThanOrEqual: lambda f: day <= f.value, In: lambda f: day in f.value}
        return all(tests[type(f)](f) for f in self.days)

    def partitions(self) -> list[OneFile]:
        fs, path = _store(self.folder)
        info = fs.get_file_info(path)
        found = [info] if info.type == pfs.FileType.File else fs.get_file_info(pfs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in found if f.type == pfs.FileType.File and re.search(r"\.tiff?$", f.path) and not f.base_name.startswith((".", "_")))
        return [OneFile(p) for p in names if self._wanted(day_of(p))]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        fs, _ = _store(self.folder)
        with fs.open_input_file(partition.path) as file:
            image = Tiff(file)
            names, place, day = image.names, image.corner(), day_of(partition.path)
            nodata = image.tags.get(GDAL_NODATA)
            for band, row0, col0, values in image.tiles():
                row = (partition.path, day, band + 1, names.get(band), row0, col0, *values.shape, *place, image.epsg, float(nodata[0]) if nodata else None, values.ravel().astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW, strict=True)], names=_NAMES)


_NAMES = [c.split()[0] for c in READ_SCHEMA.split(", ")]
_ARROW = [{"string": pa.string(), "date": pa.date32(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[c.split()[1]] for c in READ_SCHEMA.split(", ")]


class Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator) -> Written:
        fs, path = _store(self.folder)
        fs.create_dir(path, recursive=True)
        done: list[tuple[str, str]] = []
        try:
            for r in iterator:
                day = f"_{r['obs_date']:%Y%m%d}" if r["obs_date"] is not None else ""
                if not re.fullmatch(r"[\w.-]+", r["name"] or ""):
                    raise ValueError(f"{r['name']!r} is not a file name")
                if len(r["names"]) != len(r["bands"]) or any(len(b) != r["height"] * r["width"] for b in r["bands"]) or not r["bands"]:
                    raise ValueError(f"{r['name']}: bands are not {r['height']} x {r['width']}, or not as many as their names")
                empty = r["nodata"] if r["nodata"] is not None else np.nan
                if np.isnan(empty) and np.dtype(r["dtype"]).kind != "f" and any(v is None for b in r["bands"] for v in b):
                    raise ValueError(f"{r['name']}: nulls in whole numbers need a nodata value")
                bands = [np.array([empty if v is None else v for v in b], np.float64).astype(r["dtype"]).reshape(r["height"], r["width"]) for b in r["bands"]]
                raw = encoded(bands, r["names"], r["west"], r["north"], r["step_x"], r["step_y"], r["epsg"], r["nodata"])
                pending = f"{path}/.{r['name']}{day}.{uuid.uuid4().hex}.part"
                done.append((pending, f"{path}/{r['name']}{day}.tif"))
                with fs.open_output_stream(pending) as out:
                    out.write(raw)
        except BaseException:
            _removed(fs, [p for p, _ in done])
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _store(self.folder)
        files = [f for m in messages if m for f in m.files]
        if len({f for _, f in files}) < len(files):
            _removed(fs, [p for p, _ in files])
            raise ValueError("two rasters have one name and day")
        if self.overwrite:
            keep = {f for _, f in files}
            _removed(fs, [f.path for f in fs.get_file_info(pfs.FileSelector(path, allow_not_found=True)) if re.search(r"\.tiff?$", f.path) and f.path not in keep])
        for pending, final in files:
            fs.move(pending, final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _store(self.folder)
        _removed(fs, [p for m in messages if m for p, _ in m.files])


def _removed(fs: pfs.FileSystem, paths: Sequence[str]) -> None:
    for p in paths:
        if fs.get_file_info(p).type == pfs.FileType.File:
            fs.delete_file(p)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        missing = {c.split()[0] for c in WRITE_SCHEMA.split(", ")} - set(schema.names)
        if missing:
            raise ValueError(f"a raster needs the columns {sorted(missing)}")
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.dataSource.register(GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
