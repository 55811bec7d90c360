"""Draw commands to PDF files, one a document, as a data source's writer.

    write_pdf(style.draw_commands(blocks), "/out")

A document's commands come to one task in the order of its pages; the task writes
page after page and keeps only the places of what it has written. Files stand in a
folder of the task's own attempt until the job commits, which moves the files of
the attempts that counted; a job that fails leaves nothing.

Texts are set in a serif typeface that the viewer brings along. Its characters
are named one by one in each font's encoding, 224 a font, as many fonts as a
document's letters need, and mapped back to Unicode, so any script that the
typeface has is shown, and all text can be searched and copied.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from folioframe.functions.geometry import A4_HEIGHT, A4_WIDTH
from folioframe.sources.files import listed, name_of, store_of

COMMANDS = "doc_id string, page int, block_no long, line_no int, line string, font string, size double, anchor string, x double, y double, underline boolean"
# The typeface's cuts, and the published widths of its characters in thousandths of the size (others: 500).
CUTS = {"regular": "TimesNewRoman", "bold": "TimesNewRoman,Bold", "italic": "TimesNewRoman,Italic", "bold-italic": "TimesNewRoman,BoldItalic"}
WIDTHS = {180: "'", 200: "|", 250: " ,.", 278: "/:;ijlt\\", 333: "!()-I[]`fr", 389: "Js", 408: '"', 444: "?acez", 469: "^", 480: "{}", 541: "~", 556: "FPS", 564: "+<=>", 611: "ELTZ", 667: "BCR", 722: "ADGHKNOQUVXYw", 778: "&m", 833: "%", 889: "M", 921: "@", 944: "W"}
BOLD = {220: "|", 250: " ,.", 278: "'/ijl\\", 333: "!():;-[]`ft", 389: "Is", 394: "{}", 444: "cerz", 500: "#$*?J_agovxy", 520: "~", 555: '"', 556: "bdhkpqunS", 570: "+<=>", 581: "^", 611: "FP", 667: "BELTZ", 722: "ACDNRUVXYw", 778: "GHKOQ", 833: "&m", 930: "@", 944: "M", 1000: "%W"}
PER_FONT = 224
FOUND = "doc_id string, n_pages int, length long, path string"
Command = namedtuple("Command", [f.split()[0] for f in COMMANDS.split(", ")])


class _Widths(dict):
    """A character's width; an accented letter is as wide as its base, which is looked up once."""

    def __init__(self, widths: dict[int, str]):
        super().__init__({c: w for w, chars in widths.items() for c in chars})

    def __missing__(self, char: str) -> int:
        base = unicodedata.normalize("NFD", char)[:1]
        found = self[char] = self[base] if base in self else 500
        return found


_REGULAR, _BOLD = _Widths(WIDTHS), _Widths(BOLD)


def width(text: str, font: str, size: float) -> float:
    """How long a line is; an accented letter is as wide as its base."""
    table = _BOLD if font.startswith("bold") else _REGULAR
    return sum(map(table.__getitem__, text)) * size / 1000


class _Codes(dict):
    """One cut's characters, for str.translate: each as its code, or as None where it stands in a later font than the first."""

    def __init__(self, cut: str, held: list[tuple[str, dict[str, int]]]):
        self._cut, self._held, self._open, self.later = cut, held, -1, {}

    def __missing__(self, point: int) -> int | None:
        """The next free code, in a new font if the last one is full."""
        first = self._open < 0
        if first or len(self._held[self._open][1]) == PER_FONT:
            self._open = len(self._held)
            self._held.append((self._cut, {}))
            if first:
                self.font = self._open
        codes = self._held[self._open][1]
        code = codes[chr(point)] = 32 + len(codes)
        if self._open == self.font:
            self[point] = code
        else:
            self.later[point], self[point] = (self._open, code), None
        return self[point]


class Fonts:
    """A document's fonts: each cut has as many as its characters need, a code for each character."""

    def __init__(self):
        self.held: list[tuple[str, dict[str, int]]] = []
        self._cuts: dict[str, _Codes] = {}

    def runs(self, cut: str, text: str) -> list[tuple[int, bytes]]:
        """(font, codes) of each stretch of characters of one font; a text whose characters all stand in the cut's first font is one stretch."""
        codes = self._cuts.get(cut)
        if codes is None:
            codes = self._cuts[cut] = _Codes(cut, self.held)
        plain = text.translate(codes).encode("latin-1")
        if len(plain) == len(text):
            return [(codes.font, plain)] if text else []
        out: list[tuple[int, bytearray]] = []
        for point in map(ord, text):
            font, code = codes.later.get(point) or (codes.font, codes[point])
            if not out or out[-1][0] != font:
                out.append((font, bytearray()))
            out[-1][1].append(code)
        return [(f, bytes(b)) for f, b in out]


class Pdf:
    """One document, written as it comes."""

    def __init__(self, out):
        self._out, self._at, self._places, self._pages, self.fonts = out, 0, {}, [], Fonts()
        self._free = 4  # 1 the catalogue, 2 the pages, 3 their resources
        self._put(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self._at += len(data)

    def _object(self, body: bytes, number: int | None = None) -> int:
        if number is None:
            number, self._free = self._free, self._free + 1
        self._places[number] = self._at
        self._put(b"%d 0 obj\n%s\nendobj\n" % (number, body))
        return number

    def _stream(self, data: bytes) -> int:
        packed = zlib.compress(data)
        return self._object(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))

    def page(self, commands: list[Command]) -> None:
        ops = []
        for c in commands:
            text, size = re.sub(r"[\x00-\x1f\x7f]", " ", c.line or ""), c.size
            long = width(text, c.font, size) if c.anchor != "left" or c.underline else 0
            x = c.x - (long / 2 if c.anchor == "center" else long if c.anchor == "right" else 0)
            ops.append(f"BT 1 0 0 1 {x:.2f} {c.y:.2f} Tm".encode())
            for font, codes in self.fonts.runs(c.font, text):
                ops.append(b"/F%d %.2f Tf <%s> Tj" % (font, size, codes.hex().encode()))
            ops.append(b"ET")
            if c.underline:
                ops.append(f"0.6 w {x:.2f} {c.y - size * 0.12:.2f} m {x + long:.2f} {c.y - size * 0.12:.2f} l S".encode())
        content = self._stream(b"\n".join(ops))
        self._pages.append(self._object(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources 3 0 R /Contents %d 0 R >>" % (A4_WIDTH, A4_HEIGHT, content)))

    def close(self) -> int:
        """Fonts, the page tree and the table of places; returns the number of pages."""
        names = []
        for i, (cut, codes) in enumerate(self.fonts.held):
            named = " ".join(f"/u{ord(c):04X}" if ord(c) > 0xFFFF else f"/uni{ord(c):04X}" for c in codes)
            pairs = "\n".join(f"<{code:02x}> <{c.encode('utf-16-be').hex()}>" for c, code in codes.items())
            groups = pairs.split("\n")
            maps = "".join(f"{len(g)} beginbfchar\n" + "\n".join(g) + "\nendbfchar\n" for g in (groups[k : k + 100] for k in range(0, len(groups), 100)))
            back = self._stream(
                "/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Back def /CMapType 2 def\n1 begincodespacerange <00> <ff> endcodespacerange\n"
                f"{maps}endcmap CMapName currentdict /CMap defineresource pop end end".encode()
            )
            wide = " ".join(str(int(width(c, cut, 1000))) for c in codes)
            face = self._object(b"<< /Type /FontDescriptor /FontName /%s /Flags 34 /FontBBox [-568 -307 2000 1007] /ItalicAngle %d /Ascent 891 /Descent -216 /CapHeight 662 /StemV %d >>" % (CUTS[cut].encode(), -16 * ("italic" in cut), 136 if "bold" in cut else 80))
            font = self._object(
                b"<< /Type /Font /Subtype /TrueType /BaseFont /%s /FirstChar 32 /LastChar %d /Widths [%s] /FontDescriptor %d 0 R /Encoding << /Type /Encoding /Differences [32 %s] >> /ToUnicode %d 0 R >>"
                % (CUTS[cut].encode(), 31 + len(codes), wide.encode(), face, named.encode(), back)
            )
            names.append(b"/F%d %d 0 R" % (i, font))
        self._object(b"<< /Font << %s >> >>" % b" ".join(names), 3)
        self._object(b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % p for p in self._pages), len(self._pages)), 2)
        self._object(b"<< /Type /Catalog /Pages 2 0 R >>", 1)
        start = self._at
        self._put(b"xref\n0 %d\n0000000000 65535 f \n" % self._free + b"".join(b"%010d 00000 n \n" % self._places[i] for i in range(1, self._free)))
        self._put(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (self._free, start))
        return len(self._pages)


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder and the names of its files (of one, if the folder is moved as a whole)."""

    at: str
    files: list[str]


def file_name(doc_id: str) -> str:
    """A document's name as a file's: what a path can't hold is written as its code."""
    safe = re.sub(r"[^\w .()+=,@-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), doc_id)
    return (safe if safe.strip(". ") else f"%{safe}") + ".pdf"


class PdfWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self._path, self._overwrite, self._job = options["path"].rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"
        self._folders = options.get("folders", "false").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = store_of(self._path)
        at = f"{top}/{self._job}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(at, recursive=True)
        files, pdf, out, doc, page, held = [], None, None, None, None, []
        seen = set()

        def turn(new_doc, new_page):
            nonlocal pdf, out, doc, page, held
            if held:
                pdf.page(held)
            if new_doc != doc:
                if pdf is not None:
                    pdf.close()
                    out.close()
                if new_doc is not None:
                    name = file_name(new_doc)
                    if name in seen:
                        raise ValueError(f"rows of document {new_doc} don't come together: write them with write_pdf")
                    seen.add(name)
                    files.append(name)
                    out = store.open_output_stream(f"{at}/{name}")
                    pdf = Pdf(out)
            doc, page, held = new_doc, new_page, []

        for row in (Command(*row) for batch in iterator for row in zip(*(batch.column(f).to_pylist() for f in Command._fields), strict=True)):
            key = (row.doc_id if row.doc_id is not None else "null", row.page)
            if key != (doc, page):
                turn(*key)
            held.append(row)
        turn(None, None)
        return Written(at, files[:1] if self._folders else files)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = store_of(self._path)
        if self._overwrite:
            for f in listed(self._path, (".pdf",)):
                store.delete_file(f.path)
        for m in (m for m in messages if m and m.files):
            if self._folders:
                store.move(m.at, f"{top}/part-{self._job[9:]}-{m.at.rpartition('/')[2]}")
                continue
            for name in m.files:
                store.move(f"{m.at}/{name}", f"{top}/{name}")
        self._drop(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*store_of(self._path))

    def _drop(self, store, top: str) -> None:
        if store.get_file_info(f"{top}/{self._job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/{self._job}")


class PdfFiles(DataSource):
    """Options: path, folders. Takes the columns of COMMANDS, a document's rows together and in order."""

    @classmethod
    def name(cls) -> str:
        return "pdf_files"

    def schema(self) -> str:
        return COMMANDS

    def writer(self, schema: StructType, overwrite: bool) -> PdfWriter:
        return PdfWriter(self.options, overwrite)


@dataclass
class Folder(InputPartition):
    path: str


def found_in(file: fs.FileInfo, store: fs.FileSystem) -> int:
    """The number of pages that a file's page tree counts, found as viewers find it: by the table of places at the file's end."""
    with store.open_input_file(file.path) as f:
        f.seek(max(0, file.size - 64))
        table = int(re.search(rb"startxref\s+(\d+)", f.read())[1])
        f.seek(table)
        end = f.read()
        root = int(re.search(rb"/Root (\d+) 0 R", end)[1])
        rows = end.split(b"\n", 2)[2]
        at = lambda number: int(rows[20 * number : 20 * number + 10])
        f.seek(at(root))
        tree = at(int(re.search(rb"/Pages (\d+) 0 R", f.read(128))[1]))
        f.seek(tree)
        return int(re.search(rb"/Count (\d+)", f.read(at(root) - tree))[1])


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self._path = options["path"].rstrip("/")

    def partitions(self) -> list[Folder]:
        store, top = store_of(self._path)
        inside = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return [Folder(self._path), *(Folder(f"{self._path}/{f.base_name}") for f in inside if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        store, top = store_of(partition.path)
        shown = partition.path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", partition.path) else f"file:{partition.path}"
        for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if f.is_file and f.base_name.endswith(".pdf"):
                yield name_of(f.base_name), found_in(f, store), f.size, f"{shown}/{f.base_name}"


class PdfDocuments(DataSource):
    """Option: path, where PdfFiles wrote. Each folder is listed and read by a task of its own."""

    @classmethod
    def name(cls) -> str:
        return "pdf_documents"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema: StructType) -> PdfReader:
        return PdfReader(self.options)


def write_pdf(commands: DataFrame, path: str, mode: str = "append", folders: bool = False) -> None:
    """One PDF file below path for each document of style.draw_commands(): its name is doc_id, its pages are those that have
    commands, in their order. mode: append (a file of the same name is replaced) or overwrite (files that are there go).
    folders: each task's files stay in a folder of their own, which is moved as a whole, so that the driver handles tasks
    and not documents; a document that an earlier write left in another folder is not replaced then."""
    commands.sparkSession.dataSource.register(PdfFiles)
    order = ["doc_id", "page", "block_no", "line_no"]
    own = StructType.fromDDL(COMMANDS)
    rows = commands.select(*(commands[f.name].cast(f.dataType).alias(f.name) for f in own))
    rows.repartition("doc_id").sortWithinPartitions(*order).write.format("pdf_files").option("folders", str(folders)).mode(mode).save(path)


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_pages, length, path) of the files that write_pdf() left at path, read from the files themselves."""
    spark.dataSource.register(PdfDocuments)
    return spark.read.format("pdf_documents").load(path)
