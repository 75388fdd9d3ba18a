"""XML books read once each, by an event parser.

A file goes through expat from start to end; what is asked of it is picked up on the way, so nothing is parsed twice and no tree
is built. Spark reads the files (any store that it can), by parts of about equal size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.sources.shared import slices

FIELDS = "parse_error boolean, is_book boolean, body string, genre array<string>, title string, first_name string, middle_name string, last_name string, annotation string, language string, series string, series_number int, publisher string, year int, isbn string"
# Elements of the format, by where their first occurrence stands (parent first).
ELEMENTS = {
    ("title-info", "book-title"): "title", ("title-info", "author", "first-name"): "first_name", ("title-info", "author", "middle-name"): "middle_name", ("title-info", "author", "last-name"): "last_name",
    ("title-info", "annotation"): "annotation", ("title-info", "lang"): "language", ("publish-info", "publisher"): "publisher", ("publish-info", "year"): "year", ("publish-info", "isbn"): "isbn",
}
ROOT = "FictionBook"


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\s*[+-]?[0-9]{1,10}\s*", text) and -(1 << 31) <= int(text) < 1 << 31 else None


class Book:
    """Gathers the fields of one file while its parser runs."""

    def __init__(self):
        self.path: list[str] = []
        self.bodies = self.hidden = 0  # bodies and left-out elements that are open
        self.root, self.genre, self.words, self.piece = None, [], [], []
        self.found: dict[str, list[str]] = {}
        self.open: list[tuple[int, str]] = []  # depth and field of elements whose text is being gathered
        self.attributes: dict[str, str] = {}

    def _end_text(self) -> None:
        """A run of text has ended."""
        if self.piece:
            text = "".join(self.piece)
            self.piece = []
            if self.bodies and not self.hidden:
                self.words.append(text)
            if self.path[-2:] == ["title-info", "genre"]:
                self.genre.append(text)
            for _, field in self.open:
                self.found[field].append(text)

    def start(self, name: str, attributes: dict) -> None:
        self._end_text()
        name = name.rpartition(":")[2]
        self.root = self.root or name
        self.path.append(name)
        self.bodies += name == "body" and (self.bodies > 0 or attributes.get("name") != "notes")
        self.hidden += name in ("binary", "image")
        for tail, field in ELEMENTS.items():
            if tuple(self.path[-len(tail) :]) == tail and field not in self.found:
                self.found[field] = []
                self.open.append((len(self.path), field))
        if self.path[-2:] == ["title-info", "sequence"]:
            for a in ("name", "number"):
                if a in attributes:
                    self.attributes.setdefault(a, attributes[a])

    def end(self, name: str) -> None:
        self._end_text()
        self.open = [x for x in self.open if x[0] < len(self.path)]
        name = self.path.pop()
        self.hidden -= name in ("binary", "image")
        if name == "body" and self.bodies:
            self.bodies -= 1

    def text(self, data: str) -> None:
        self.piece.append(data)

    def row(self) -> dict:
        text = {field: "".join(parts).strip() or None for field, parts in self.found.items()}
        return {**text, "parse_error": False, "is_book": self.root == ROOT, "body": " ".join(" ".join(self.words).split()), "genre": self.genre, "series": (self.attributes.get("name") or "").strip() or None, "series_number": _number(self.attributes.get("number")), "year": _number(text.get("year"))}


def parse(content: str | bytes | None) -> dict:
    """The fields of one file; of what is not well-formed, parse_error and nulls. Bytes are read in the encoding that they declare."""
    nothing = {"parse_error": True, "is_book": False}
    if content is None:
        return nothing
    book, parser = Book(), expat.ParserCreate("utf-8" if isinstance(content, str) else None)
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = book.start, book.end, book.text
    try:
        parser.Parse(content.lstrip().encode("utf-8", "surrogatepass") if isinstance(content, str) else content, True)
    except (expat.ExpatError, LookupError, ValueError, UnicodeError):
        return nothing
    return book.row()


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row and content in -> row and the fields of its content. The strings of a few files are there at a time, not of a batch."""
    kinds = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split(" ") for f in FIELDS.split(", "))])
    for batch in batches:
        for part in slices(batch, "content"):
            rows = [parse(x.as_py()) for x in part.column("content")]
            columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([part.column("row"), *columns], ["row", *kinds.names])


def parsed(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` with the fields of each file's content (text or bytes); columns of these names are replaced."""
    fields = StructType.fromDDL(FIELDS)
    keep = [c for c in files.columns if c not in fields.names]
    packed = files.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{content}`").alias("content"))
    out = packed.mapInArrow(parse_batches, StructType([packed.schema["row"], *fields.fields]))
    return out.select(*(F.col("row")[c].alias(c) for c in keep), *fields.names)


_KINDS = {"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path (or pattern) as books: file_path, length, and their fields. Spark deals the files to tasks by size
    (spark.sql.files.maxPartitionBytes)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_path"), "length", "content")
    return parsed(files).drop("content")
