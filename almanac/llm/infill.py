"""Fill-in-middle transformation of documents by a piece table.

A document is a list of descriptors (buffer, start, end) over two immutable buffers: its text and the sentinels.
Cutting splits descriptors, an arrangement permutes the three parts and puts sentinels between them, and the
inverse permutation puts parts found in an output back in place. Text is copied once, when an output is
written; hashes are fed descriptor by descriptor.

A document is cut at two places between tokens (words with the white space before them) that its id decides.
Null ids are hashed as no digits, null texts count as empty, documents that repeat an id are each transformed,
texts that contain a sentinel stay plain. Columns other than id and text are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINELS = b"<P><S><M>"
TEXT, MARKS = 0, 1
ROWS = 256


class Piece(NamedTuple):
    buffer: int
    start: int
    end: int


#: Marks before the parts, by the part's place in the text: prefix, middle, suffix.
MARK = (Piece(MARKS, 0, 3), Piece(MARKS, 6, 9), Piece(MARKS, 3, 6))
#: Order of the parts in an output.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


def token_ends(text: bytes) -> np.ndarray:
    """Ends (bytes) of the tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`` from left to right."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    last = ~blank
    last[:-1] &= blank[1:]
    last[-1] = True  # a word's end or the blanks that nothing follows
    return np.flatnonzero(last) + 1


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The descriptors before and after the first ``at`` bytes."""
    left = []
    for i, p in enumerate(pieces):
        size = p.end - p.start
        if at < size:
            mid = p.start + at
            return left + ([p._replace(end=mid)] if at else []), [p._replace(start=mid), *pieces[i + 1:]]
        left.append(p)
        at -= size
    return left, []


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    return [p for i in ORDERS[form] for p in (MARK[i], *parts[i])]


def inverse(output: bytes, form: str) -> list[Piece]:
    """Descriptors over an output (as text buffer) that spell the text it was made from."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    spans, at = [], 0
    for i in ORDERS[form]:  # no text holds a mark, so the first one found is the mark
        start = output.index(SENTINELS[MARK[i].start:MARK[i].end], at)
        if spans:
            spans[-1][2] = start
        at = start + 3
        spans.append([i, at, len(output)])
    return [Piece(TEXT, start, end) for _, start, end in sorted(spans)]


def streamed(pieces: list[Piece], text: bytes) -> Iterator[memoryview]:
    views = memoryview(text), memoryview(SENTINELS)
    return (views[p.buffer][p.start:p.end] for p in pieces)


def digest(pieces: list[Piece], text: bytes) -> str:
    h = hashlib.sha256()
    for view in streamed(pieces, text):
        h.update(view)
    return h.hexdigest()


def _points(text: bytes, pieces: list[Piece]) -> int:
    """Code points of descriptors over the text."""
    b = np.frombuffer(text, np.uint8)
    return int(sum(np.count_nonzero((b[p.start:p.end] & 0xC0) != 0x80) for p in pieces))


class Infilled(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    pieces: list[Piece]


def infill(text: bytes, doc_id: int | None, seed: int, rate: int, spm: int) -> Infilled:
    ends = token_ends(text)
    n = len(ends)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i:i + 8], 16) for i in range(0, 32, 8))
    whole = [Piece(TEXT, 0, len(text))] if text else []
    if not text or h3 % 100 >= rate or any(SENTINELS[m.start:m.end] in text for m in MARK):
        return Infilled(n, "plain", None, None, whole)
    at = [int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    head, suffix = cut(whole, at[1])
    prefix, middle = cut(head, at[0])
    form = "spm" if h4 % 100 < spm else "psm"
    return Infilled(n, form, _points(text, prefix), _points(text, middle), arrange([prefix, middle, suffix], form))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null
    if plain), output, output_sha256. ``rate`` percent of the documents are rearranged, ``spm`` percent of those
    suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                done, outputs, digests = [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    text = text or b""
                    made = infill(text, doc_id, seed, rate, spm)
                    outputs.append(b"".join(streamed(made.pieces, text)))
                    digests.append(digest(made.pieces, text))
                    done.append(made[:4])
                n, form, prefix, middle = zip(*done)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"))


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form", texts: bool = True) -> DataFrame:
    """The rows of ``outputs`` with restored_sha256, and with ``texts`` restored: the text rebuilt from output and
    form. Columns of these names are replaced."""
    outputs = outputs.drop("restored", "restored_sha256")
    schema = outputs.schema
    at_output, at_form = schema.names.index(output_col), schema.names.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rebuilt, digests = [], []
                for output, form in zip(part.column(at_output).cast(pa.binary()).to_pylist(), part.column(at_form).to_pylist()):
                    pieces = inverse(output, form)
                    digests.append(digest(pieces, output))
                    if texts:
                        rebuilt.append(b"".join(streamed(pieces, output)))
                more = [pa.array(digests, pa.string())] + ([pa.array(rebuilt, pa.binary()).cast(pa.string())] if texts else [])
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "restored_sha256"] + ["restored"] * texts)

    added = [T.StructField(name, T.StringType()) for name in ["restored_sha256"] + ["restored"] * texts]
    return outputs.mapInArrow(run, T.StructType([*schema.fields, *added]))
