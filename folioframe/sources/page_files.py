"""Pages of multi-page TIFF files as a data source, in batch and as a stream.

    spark.dataSource.register(PageFiles)
    spark.read.format("page_files").load("/scans").where("page between 10 and 19")

A large file is read by many tasks: each follows the chain of page directories,
a few bytes a page, and decodes the pages whose directory lies in its part of the
file. Filters on page and doc_id reach the tasks, so pages that aren't asked for
are never read; neither are pixels where the image isn't among the columns of the
schema given. As a stream, files are taken in the order of their modification
times; every page comes once, with its number, and the last one is marked.

A file or page that can't be read gives a row with its error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioframe.images import unpack_lzw
from folioframe.sources.files import listed, name_of, store_of

PAGE = "doc_id string, path string, page int, n_pages int, is_last boolean, image struct<height:int,width:int,nChannels:int,data:binary>, error string"
SUFFIXES = (".tif", ".tiff")
#: Bytes of a file, or of small files together, that a task takes.
SPLIT = 32 << 20
# Bytes and format of a directory entry's types, and the tags that matter.
KINDS = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, PALETTE, TILES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320, 322


class Tiff:
    """A TIFF file (either byte order, 32 or 64 bits) that is read where it is asked for."""

    def __init__(self, f):
        self._f = f
        head = self._at(0, 16)
        self._order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = self._order and struct.unpack_from(self._order + "H", head, 2)[0]
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        self._big = version == 43
        self.first = struct.unpack_from(self._order + ("Q" if self._big else "I"), head, 8 if self._big else 4)[0]

    def _at(self, offset: int, size: int) -> bytes:
        self._f.seek(offset)
        return self._f.read(size)

    def directories(self) -> Iterator[tuple[int, bytes]]:
        """(offset, raw entries) of each page, in their order."""
        n_size, entry, n_next, count, link = (8, 20, 8, "Q", "Q") if self._big else (2, 12, 4, "H", "I")
        at, seen = self.first, set()
        while at:
            if at in seen:
                raise ValueError("directories run in a circle")
            seen.add(at)
            n = struct.unpack(self._order + count, self._at(at, n_size))[0]
            raw = self._at(at + n_size, n * entry + n_next)
            yield at, raw[: n * entry]
            at = struct.unpack_from(self._order + link, raw, n * entry)[0]

    def tags(self, raw: bytes) -> dict[int, list[int]]:
        entry, inline = (20, 8) if self._big else (12, 4)
        found = {}
        for i in range(0, len(raw), entry):
            tag, kind = struct.unpack_from(self._order + "HH", raw, i)
            n = struct.unpack_from(self._order + ("Q" if self._big else "I"), raw, i + 4)[0]
            if kind in KINDS:
                size, code = KINDS[kind]
                value = raw[i + entry - inline : i + entry]
                if n * size > inline:
                    value = self._at(struct.unpack(self._order + ("Q" if self._big else "I"), value)[0], n * size)
                found[tag] = list(struct.unpack_from(f"{self._order}{n}{code}", value))
        return found

    def pixels(self, tags: dict[int, list[int]]) -> np.ndarray:
        """(height, width, channels), gray or RGB, eight bits."""
        one = lambda tag, default=None: tags.get(tag, [default])[0]
        w, h, n, bits, packed, shown = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, 1), one(PHOTOMETRIC, 1)
        if not w or not h or TILES in tags or bits not in (1, 8) or (bits == 1 and n > 1) or one(PLANAR, 1) != 1 or shown not in (0, 1, 2) or set(tags.get(BITS, [bits])) != {bits}:
            raise ValueError(f"a kind of page that isn't read: {n} samples of {bits} bits, photometric {shown}")
        row = (w * n * bits + 7) // 8
        per = min(one(ROWS, h), h)
        strips = []
        for i, (at, size) in enumerate(zip(tags[OFFSETS], tags[COUNTS], strict=True)):
            want = row * min(per, h - i * per)
            strips.append(self._unpacked(self._at(at, size), packed, want)[:want].ljust(want, b"\0"))
        a = np.frombuffer(b"".join(strips), np.uint8)[: row * h].reshape(h, row)
        if bits == 1:
            a = np.unpackbits(a, axis=1)[:, :w] * 255
        a = a.reshape(h, w, n)
        if one(PREDICTOR, 1) == 2:
            a = np.cumsum(a, axis=1, dtype=np.uint8)
        return (255 - a if shown == 0 else a)[:, :, : 3 if n >= 3 else 1]

    @staticmethod
    def _unpacked(data: bytes, packed: int, want: int) -> bytes:
        if packed == 1:
            return data
        if packed in (8, 32946):
            return zlib.decompress(data)
        if packed == 5:
            return unpack_lzw(data, want)
        if packed == 32773:
            out, i = bytearray(), 0
            while i < len(data) and len(out) < want:
                n = data[i]
                out += data[i + 1 : i + 2 + n] if n < 128 else data[i + 1 : i + 2] * (257 - n) if n > 128 else b""
                i += n + 2 if n < 128 else 2 if n > 128 else 1
            return bytes(out)
        raise ValueError(f"compression {packed} isn't read")


@dataclass
class Asked:
    """What filters leave of pages and documents."""

    least: int = 1
    most: int | None = None
    pages: set[int] | None = None
    documents: set[str] | None = None

    def take(self, f: Filter) -> bool:
        """Whether the filter is answered here."""
        column = getattr(f, "attribute", None)
        if isinstance(f, (EqualTo, EqualNullSafe, In)) and column in (("page",), ("doc_id",)):
            values = set(f.value) if isinstance(f, In) else {f.value}
            if None in values:
                return False
            name = "pages" if column == ("page",) else "documents"
            had = getattr(self, name)
            setattr(self, name, values if had is None else had & values)
            return True
        if column != ("page",) or getattr(f, "value", None) is None:
            return False
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.least = max(self.least, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            limit = f.value - isinstance(f, LessThan)
            self.most = limit if self.most is None else min(self.most, limit)
        else:
            return False
        return True

    def page(self, n: int) -> bool:
        return n >= self.least and (self.most is None or n <= self.most) and (self.pages is None or n in self.pages)

    @property
    def everything(self) -> bool:
        return self.least <= 1 and self.most is None and self.pages is None


@dataclass
class Part(InputPartition):
    """Files, each with the range of bytes in which the directories of a task's pages begin."""

    files: list[tuple[str, int, int]] = field(default_factory=list)


def _parts(files: list, split: int) -> list[Part]:
    parts, small, size = [], [], 0
    for f in files:
        n = max(1, -(-f.size // split))
        if n > 1:
            step = -(-f.size // n)
            parts += [Part([(f.path, i * step, (i + 1) * step if i < n - 1 else 1 << 62)]) for i in range(n)]
            continue
        small.append((f.path, 0, 1 << 62))
        size += f.size
        if size >= split:
            parts.append(Part(small))
            small, size = [], 0
    return parts + ([Part(small)] if small else [])


class _Reading:
    """What the batch and the stream reader share."""

    def __init__(self, schema: StructType, options: dict):
        self._columns, self._arrow = schema.names, to_arrow_schema(schema)
        self._path, self._split = options["path"], int(options.get("split", SPLIT))
        self._asked = Asked()

    def _rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self._path)
        for path, low, high in part.files:
            doc = {"doc_id": name_of(path), "path": path}
            if self._asked.documents is not None and doc["doc_id"] not in self._asked.documents:
                continue
            try:
                with store.open_input_file(path) as f:
                    for row in self._pages(Tiff(f), low, high):
                        yield self._batch(doc | row)
            except (ValueError, OSError, struct.error, zlib.error) as e:
                if low == 0 and self._asked.everything:  # one row a file, whose page isn't known
                    yield self._batch(doc | {"error": f"{type(e).__name__}: {e}"})

    def _pages(self, tiff: Tiff, low: int, high: int) -> Iterator[dict]:
        own, n = [], 0
        for at, raw in tiff.directories():
            n += 1
            if low <= at < high and self._asked.page(n):
                own.append((n, raw))
        for page, raw in own:
            row = {"page": page, "n_pages": n, "is_last": page == n}
            if "image" in self._columns:
                try:
                    a = tiff.pixels(tiff.tags(raw))
                    row["image"] = {"height": a.shape[0], "width": a.shape[1], "nChannels": a.shape[2], "data": np.ascontiguousarray(a[:, :, ::-1]).tobytes()}
                except (ValueError, KeyError, OSError, struct.error, zlib.error) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
            yield row

    def _batch(self, row: dict) -> pa.RecordBatch:
        """One page: a batch never holds more than one image."""
        return pa.RecordBatch.from_pydict({c: pa.array([row.get(c)], self._arrow.field(c).type) for c in self._columns}, schema=self._arrow)


class PageReader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return [f for f in filters if not self._asked.take(f)]

    def partitions(self) -> Sequence[InputPartition]:
        files = listed(self._path, SUFFIXES)
        if self._asked.documents is not None:
            files = [f for f in files if name_of(f.path) in self._asked.documents]
        return _parts(files, self._split) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self._rows(partition)


class PageStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are the modification time and path of the last file taken; a file must be put in its place whole, as by a move."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return max(({"time": f.mtime_ns or 0, "path": f.path} for f in listed(self._path, SUFFIXES)), key=self._place, default=self.initialOffset())

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        files = [f for f in listed(self._path, SUFFIXES) if self._place(start) < (f.mtime_ns or 0, f.path) <= self._place(end)]
        return _parts(files, self._split)

    @staticmethod
    def _place(offset: dict) -> tuple[int, str]:
        return offset["time"], offset["path"]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self._rows(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class PageFiles(DataSource):
    """Options: path, split (bytes a task takes). Columns: those of PAGE, or of them the ones that the schema given names."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)

    def streamReader(self, schema: StructType) -> PageStreamReader:  # noqa: N802
        return PageStreamReader(schema, self.options)


def _columns(columns: list[str] | None) -> StructType:
    whole = StructType.fromDDL(PAGE)
    return whole if columns is None else StructType([whole[c] for c in columns])


def read_page_files(spark: SparkSession, path: str, columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """Pages of the files at or below path: the columns of PAGE, or those named; filters on page and doc_id are answered by the source."""
    spark.dataSource.register(PageFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("page_files").schema(_columns(columns)).option("split", split).load(path)


def stream_page_files(spark: SparkSession, path: str, columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """The pages of files that are put down below path, as they come."""
    spark.dataSource.register(PageFiles)
    return spark.readStream.format("page_files").schema(_columns(columns)).option("split", split).load(path)
