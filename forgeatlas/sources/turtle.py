"""Turtle scan (A20): prefixes, lists of predicates and objects, statements over many lines.

A file is cut into chunks of whole lines, which are worked on in parallel. What a chunk means
depends on what is before it, so the work is in three passes over stored chunks, with two
small ones between that read a short row per chunk, in order within a file:

1. a chunk is folded to its *transition*: for each state it may begin in (plain, or inside one
   of the two long quotes) the state it ends in and the change of bracket depth;
   -> the transitions of a file, put together in order, say how every chunk begins;
2. the chunk is cut at the separators ``. ; ,`` outside brackets. Pieces that lie inside stay;
   the first and the last piece, directives, and the last subject and predicate go on;
   -> first and last pieces are joined over the borders and read, and subject, predicate,
   prefixes and base are carried on: the context in which the inside of a chunk is read;
3. the inside of a chunk is read in its context.

The context of a chunk reaches it by a lookup that is broadcast only within checked bounds.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.operators.lookup import lookup
from forgeatlas.session import scratch_path

CHUNK_CHARS = 1 << 20
PLAIN, DOUBLE, SINGLE = range(3)
_QUOTE = {'"""': DOUBLE, "'''": SINGLE}
_CLOSE = {
    DOUBLE: re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S),
    SINGLE: re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S),
}
_LOCAL = r"(?:(?:[\w:%-]|\\.)(?:(?:[\w:.%-]|\\.)*(?:[\w:%-]|\\.))?)?"
_TOKEN = re.compile(
    rf"""
    (?P<space>\s+|\#[^\n]*)
  | (?P<long>\"{{3}}|'{{3}})
  | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<iri><[^<>"{{}}|^`\x00-\x20]*>)
  | (?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<type>\^\^)
  | (?P<blank>_:\w(?:[\w.-]*[\w-])?)
  | (?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+)(?![\w:]))
  | (?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:{_LOCAL})
  | (?P<word>[A-Za-z]+)
  | (?P<mark>[.;,\[\]()])
    """,
    re.X,
)
# Fixed values of the format.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
# End of fixed values.
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_TRIPLE = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]


def _unescaped(text: str) -> str:
    def plain(found: re.Match) -> str:
        code = found[1] or found[2]
        if code:
            return chr(int(code, 16))
        if found[3] not in _ESCAPES:
            raise ValueError(f"unknown escape \\{found[3]}")
        return _ESCAPES[found[3]]

    return _ESCAPE.sub(plain, text) if "\\" in text else text


# Lexical level ------------------------------------------------------------------


class Scan:
    """Tokens of a text that begins in a given state; :attr:`state` is the one it ends in.
    ``strict`` raises at what is no token, otherwise a character is skipped."""

    def __init__(self, text: str, state: int = PLAIN, strict: bool = True):
        self.text, self.state, self.strict = text, state, strict

    def __iter__(self) -> Iterator[tuple[str, int, int]]:
        text, at, begun = self.text, 0, 0
        while at < len(text):
            if self.state != PLAIN:
                close = _CLOSE[self.state].match(text, at)
                if close is None:
                    yield "open", begun, len(text)
                    return
                yield "quoted", begun, close.end()
                at, self.state = close.end(), PLAIN
                continue
            found = _TOKEN.match(text, at)
            if found is None:
                if self.strict:
                    raise ValueError(f"not Turtle: {text[at : at + 80]!r}")
                at += 1
                continue
            if found.lastgroup == "long":
                begun, self.state = at, _QUOTE[found[0]]
                if found.end() == len(text):
                    yield "open", begun, len(text)
            elif found.lastgroup != "space":
                yield found.lastgroup, at, found.end()
            at = found.end()


def transition(text: str) -> list[int]:
    """End state and change of depth for each of the three states a text may begin in."""
    out = []
    for state in (PLAIN, DOUBLE, SINGLE):
        scan, depth = Scan(text, state, strict=False), 0
        for kind, start, _ in scan:
            if kind == "mark":
                depth += (text[start] in "[(") - (text[start] in "])")
        out += [scan.state, depth]
    return out


def cut(text: str, state: int, depth: int) -> list[tuple[str | None, str]]:
    """Pieces of a text between the separators outside brackets, with the separator before
    each; the first piece goes on from what is before the text."""
    pieces, before, begun = [], None, 0
    for kind, start, end in Scan(text, state):
        if kind != "mark":
            continue
        mark = text[start]
        depth += (mark in "[(") - (mark in "])")
        if depth < 0:
            raise ValueError(f"closing bracket without an opening one: {text[max(0, start - 40) : end]!r}")
        if depth == 0 and mark in ".;,":
            pieces.append((before, text[begun:start]))
            before, begun = mark, end
    return [*pieces, (before, text[begun:])]


# Statements ---------------------------------------------------------------------


@dataclass
class Context:
    """What a piece is read in. ``subject`` and ``predicate`` are terms."""

    prefixes: dict[str, str] = field(default_factory=dict)
    base: str | None = None
    subject: str | None = None
    predicate: str | None = None

    def packed(self) -> str:
        return json.dumps([self.prefixes, self.base, self.subject, self.predicate])

    @classmethod
    def unpacked(cls, text: str) -> Context:
        return cls(*json.loads(text))


class Reader:
    """Reads pieces in order. ``label`` begins the names of nodes without one. With ``raw``
    terms are left as they are written."""

    def __init__(self, context: Context, raw: bool = False):
        self.context, self.raw = context, raw
        self.triples: list[tuple] = []

    def read(self, before: str, text: str, label: str) -> None:
        self.tokens = [(kind, text[a:b]) for kind, a, b in Scan(text)]
        self.at, self.label, self.made = 0, label, 0
        context = self.context
        try:
            if before == ".":
                context.subject = context.predicate = None
                while self.at < len(self.tokens) and self._directive():
                    pass
                if self.at == len(self.tokens):
                    return
                bracket = self._peek() == "["
                context.subject = self._resource()
                if bracket and self.at == len(self.tokens):
                    return
            if before in ".;":
                if self.at == len(self.tokens):
                    return
                context.predicate = self._verb()
            if context.subject is None or context.predicate is None:
                raise ValueError("an object without a predicate")
            self._state(context.subject, context.predicate, self._object())
            if self.at != len(self.tokens):
                raise ValueError("more than three terms")
        except (ValueError, IndexError) as problem:
            raise ValueError(f"not a statement ({problem}): {text.strip()[:200]!r}") from None

    def _peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def _take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def _state(self, s: str, p: str, o: tuple) -> None:
        self.triples.append((s, p, *o))

    def _directive(self) -> bool:
        word = self.tokens[self.at][1]
        name = word.lstrip("@").lower()
        if name not in ("prefix", "base") or self.tokens[self.at][0] not in ("tag", "word"):
            return False
        self._take()
        prefix = self._take()[1] if name == "prefix" else None
        kind, value = self._take()
        if kind != "iri" or (prefix is not None and not prefix.endswith(":")):
            raise ValueError("bad directive")
        iri = self._iri(value)
        if prefix is None:
            self.context.base = iri
        else:
            self.context.prefixes[prefix[:-1]] = iri
        return True

    def _iri(self, written: str) -> str:
        iri = _unescaped(written[1:-1])
        return urljoin(self.context.base, iri) if self.context.base else iri

    def _named(self, kind: str, text: str) -> str:
        if self.raw or kind == "blank":
            return text
        if kind == "iri":
            return self._iri(text)
        prefix, _, local = text.partition(":")
        if prefix not in self.context.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.context.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def _node(self) -> str:
        self.made += 1
        return f"_:{self.label}x{self.made - 1}"

    def _resource(self) -> str:
        kind, text = self._take()
        if kind in ("iri", "name", "blank"):
            return self._named(kind, text)
        if text == "[":
            node = self._node()
            while self._peek() != "]":
                verb = self._verb()
                self._state(node, verb, self._object())
                while self._peek() == ",":
                    self._take()
                    self._state(node, verb, self._object())
                if self._peek() not in (";", "]"):
                    raise ValueError("unfinished property list")
                while self._peek() == ";":
                    self._take()
            self._take()
            return node
        if text == "(":
            first = last = None
            while self._peek() != ")":
                node = self._node()
                if last is None:
                    first = node
                else:
                    self._state(last, RDF + "rest", (node, "uri", None, None))
                self._state(node, RDF + "first", self._object())
                last = node
            self._take()
            if last is None:
                return RDF + "nil"
            self._state(last, RDF + "rest", (RDF + "nil", "uri", None, None))
            return first
        raise ValueError(f"{text[:40]!r} is no resource")

    def _verb(self) -> str:
        kind, text = self._take()
        if text == "a":
            return RDF + "type" if not self.raw else "a"
        if kind not in ("iri", "name"):
            raise ValueError(f"{text[:40]!r} is no predicate")
        return self._named(kind, text)

    def _object(self) -> tuple:
        kind, text = self.tokens[self.at]
        if kind in ("string", "quoted"):
            self._take()
            edge = 3 if kind == "quoted" else 1
            value, datatype, tag = _unescaped(text[edge:-edge]), XSD + "string", None
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "tag":
                datatype, tag = RDF + "langString", self._take()[1][1:]
            elif self._peek() == "^^":
                self._take()
                datatype = self._named(*self._take())
            return value, "literal", datatype, tag
        if kind == "number":
            self._take()
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return text, "literal", XSD + name, None
        if text in ("true", "false"):
            self._take()
            return text, "literal", XSD + "boolean", None
        return self._resource(), "uri", None, None


def _outline(pieces: list[tuple[str | None, str]], labels: list[str]) -> Iterator[tuple[int, str, str]]:
    """``(place, kind, text)`` of what later pieces need to know of these: all directives, the
    last subject and the last predicate, as they are written."""
    lately = re.compile(r"\s*(?:\#[^\n]*\n\s*)*(?:@?prefix|@?base)\b", re.I)
    found = [(k, "directive", text) for k, (mark, text) in enumerate(pieces) if mark == "." and lately.match(text)]
    wanted = {"subject", "predicate"}
    for k in range(len(pieces) - 1, -1, -1):
        mark, text = pieces[k]
        if not wanted or mark == ",":
            continue
        reader = Reader(Context(subject="", predicate=""), raw=True)
        reader.read(mark, text, labels[k])
        context = reader.context
        if context.predicate and "predicate" in wanted:
            wanted.discard("predicate")
            found.append((k, "predicate", context.predicate))
        if mark == ".":
            wanted.clear()
            found.append((k, "subject", context.subject or ""))
    order = ("directive", "subject", "predicate")
    return iter(sorted(found, key=lambda row: (row[0], order.index(row[1]))))


def _label(file: str, place: int, number: int, piece: int) -> str:
    return f"g{zlib.crc32(file.encode()):08x}x{place}x{number}x{piece}"


# Passes -------------------------------------------------------------------------

_PLACE = "file string, place long, number long"
_ENDS = [f"{what}{state}" for state in range(3) for what in ("end", "depth")]


def _chunks(spark: SparkSession, path: str, chunk_chars: int) -> DataFrame:
    """Whole lines of a split, put together up to a size, with their transition."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "place", "number", "text", *_ENDS]
        key, number, held, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            text = "".join(held)
            row = [*key, number, text, *transition(text)]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema)

        schema = pa.schema(
            [("file", pa.string()), ("place", pa.int64()), ("number", pa.int64()), ("text", pa.string()),
             *((name, pa.int64()) for name in _ENDS)]
        )
        for batch in batches:
            for line, *where in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if where != key or size >= chunk_chars:
                    if held:
                        yield flush()
                    if where != key:
                        key, number = where, 0
                held.append(line + "\n")
                size += len(line) + 1
        if held:
            yield flush()

    schema = f"{_PLACE}, text string, {', '.join(f'{name} long' for name in _ENDS)}"
    return lines.mapInArrow(run, schema)


def _ordered(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("file").sortWithinPartitions("file", "place", "number", *more)


def _entries(chunks: DataFrame) -> DataFrame:
    """``chunk, state, depth, first``: how every chunk begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state, depth = None, PLAIN, 0
        for batch in batches:
            out: list[tuple] = []
            for name, chunk, *ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = name != file
                if first:
                    file, state, depth = name, PLAIN, 0
                out.append((chunk, state, depth, first))
                depth += ends[2 * state + 1]
                state = ends[2 * state]
            columns = zip(*out, strict=True) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["chunk", "state", "depth", "first"]
            )

    rows = _ordered(chunks.select("file", "place", "number", "chunk", *_ENDS)).select("file", "chunk", *_ENDS)
    return rows.mapInArrow(run, "chunk long, state long, depth long, first boolean")


_BORDER = f"{_PLACE}, chunk long, piece long, turn long, kind string, mark string, text string"


def _borders(chunks: DataFrame) -> DataFrame:
    """First and last pieces of all chunks and the outline of what lies between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, place, number, chunk = (row[c] for c in ("file", "place", "number", "chunk"))
                pieces = cut(row["text"], row["state"], row["depth"])
                whole = "first" if len(pieces) > 1 else "through"
                rows = [(0, whole, None, pieces[0][1])]
                inside = pieces[1:-1]
                labels = [_label(file, place, number, k + 1) for k in range(len(inside))]
                rows += [(1 + k, kind, None, text) for k, kind, text in _outline(inside, labels)]
                if len(pieces) > 1:
                    rows.append((len(pieces) - 1, "last", *pieces[-1]))
                yield pa.RecordBatch.from_pylist([
                    dict(zip(names, (file, place, number, chunk, piece, turn, *rest), strict=True))
                    for turn, (piece, *rest) in enumerate(rows)
                ], schema)

    names = ["file", "place", "number", "chunk", "piece", "turn", "kind", "mark", "text"]
    texts = {"file", "kind", "mark", "text"}
    schema = pa.schema([(name, pa.string() if name in texts else pa.int64()) for name in names])
    return chunks.mapInArrow(run, _BORDER)


_TRIPLE_DDL = ", ".join(f"{c} string" for c in _TRIPLE)
_TRIPLE_FIELDS = [(c, pa.string()) for c in _TRIPLE]


def _term(reader: Reader, text: str) -> str:
    """Term behind what an outline has carried."""
    if text.startswith("_:") or text == RDF + "nil":
        return text
    ((kind, _, _),) = Scan(text)
    return RDF + "type" if text == "a" else reader._named(kind, text)


def _joined(borders: DataFrame) -> DataFrame:
    """``chunk, context`` of every chunk with an inside, and among them (without a chunk) the
    triples of the pieces that lie on borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("context", pa.string()), *_TRIPLE_FIELDS])
        file, reader, held = None, Reader(Context()), None

        def finish() -> None:
            if held is not None and any(True for _ in Scan("".join(held[1]))):
                raise ValueError(f"{file} ends inside a statement: {''.join(held[1]).strip()[-200:]!r}")

        for batch in batches:
            out: list[tuple] = []
            for name, place, number, chunk, piece, kind, mark, text in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if name != file:
                    finish()
                    file, reader, held = name, Reader(Context()), (".", [], _label(name, place, number, piece))
                context = reader.context
                if kind in ("first", "through"):
                    held[1].append(text)
                    if kind == "first":
                        reader.read(held[0], "".join(held[1]), held[2])
                        out += [(None, None, *triple) for triple in reader.triples]
                        reader.triples.clear()
                        out.append((chunk, context.packed(), *[None] * len(_TRIPLE)))
                elif kind == "last":
                    held = (mark, [text], _label(file, place, number, piece))
                elif kind == "directive":
                    Reader(context).read(".", text, "")
                elif kind == "subject":
                    context.subject, context.predicate = _term(reader, text) if text else None, None
                else:
                    context.predicate = _term(reader, text)
            yield _rows(out, schema)
        finish()

    names = ["file", "place", "number", "chunk", "piece", "kind", "mark", "text"]
    return _ordered(borders, "turn").select(names).mapInArrow(run, f"chunk long, context string, {_TRIPLE_DDL}")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _insides(chunks: DataFrame) -> DataFrame:
    """Triples of what lies between the first and the last piece of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_TRIPLE_FIELDS)
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(Context.unpacked(row["context"]))
                pieces = cut(row["text"], row["state"], row["depth"])
                for k, (mark, text) in enumerate(pieces[1:-1]):
                    reader.read(mark, text, _label(row["file"], row["place"], row["number"], k + 1))
                    if len(reader.triples) >= 4096:
                        yield _rows(reader.triples, schema)
                        reader.triples.clear()
                yield _rows(reader.triples, schema)

    return chunks.filter("context IS NOT NULL").mapInArrow(run, _TRIPLE_DDL)


def read_turtle(spark: SparkSession, path: str, *, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Triples of all Turtle files below ``path``: ``s, p, o, o_kind, o_datatype, o_lang``, as
    :func:`.ntriples.read_ntriples` gives them.

    Known are prefixes and base in both spellings, ``a``, lists of predicates and objects,
    labelled and bracketed nodes, collections, the four quotes, numbers, booleans, datatypes
    and language tags. Prefixes hold from where they stand to the end of their file. Nodes
    without a name get one that is unique in all files; line ends in long strings are line
    feeds. What is not Turtle, and a file that ends inside a statement, is an error.
    """
    folder = scratch_path(spark, "turtle")
    _chunks(spark, path, chunk_chars).withColumn("chunk", F.monotonically_increasing_id()).write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    begun = lookup(chunks.drop(*_ENDS), _entries(chunks), "chunk", spread="chunk")
    _borders(begun).write.parquet(f"{folder}/borders")
    _joined(spark.read.parquet(f"{folder}/borders")).write.parquet(f"{folder}/joined")
    joined = spark.read.parquet(f"{folder}/joined")
    contexts = joined.filter("chunk IS NOT NULL").select("chunk", "context")
    inside = _insides(lookup(begun, contexts, "chunk", spread="chunk"))
    return inside.unionByName(joined.filter("chunk IS NULL").select(_TRIPLE))
