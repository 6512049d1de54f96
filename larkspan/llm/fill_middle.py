"""Fill-in-middle transformation by block rotation inside one buffer, and its exact inverse.

A text is cut twice at line ends. Its bytes are laid out once in a bytearray,
with sentinels in front of prefix, middle and suffix; the order a form asks for
is made in that buffer by exchanging two neighbouring blocks, each exchange
being three reversals. Restoring finds the sentinels, runs the inverse
exchange and takes the sentinels out. Reversals swap pieces of bounded size from
both ends, so nothing but the buffer grows with the text.

Lines are ``[^\\n]*\\n|[^\\n]+``. The cuts and the form come from a hash of a seed
and the document's id, so they don't depend on partitioning.

Forms: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) and
``plain`` (the text as it is): empty texts, texts that hold a sentinel, and those
beyond ``rate``. Sentinels must not be able to overlap one another, so that a
transformed text holds each of them exactly once.

Cases: a null text is empty, and restores to the empty text. A null id hashes as
the empty string. Texts are taken whole, of any length; cuts of a text without
line ends fall on its two ends. Repeated rows give repeated rows, rows with one
id and different texts are cut by the same numbers, an empty table gives an
empty one. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larkspan.llm.words import text_buffers

SWAP_BYTES = 1 << 16
BATCH_BYTES = 1 << 23
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        own = self.encoded()
        for i, a in enumerate(own):
            if not a:
                raise ValueError("a sentinel is empty")
            for j, b in enumerate(own):
                if i != j and a in b:
                    raise ValueError(f"sentinel {a!r} occurs in {b!r}")
                if any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"sentinel {b!r} may start inside {a!r}")

    def encoded(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def reverse(view: np.ndarray, lo: int, hi: int) -> None:
    """Reverse ``view[lo:hi]`` in place, swapping pieces from both ends."""
    while hi - lo > 1:
        n = min((hi - lo) // 2, SWAP_BYTES)
        left = view[lo : lo + n].copy()
        view[lo : lo + n] = view[hi - n : hi][::-1]
        view[hi - n : hi] = left[::-1]
        lo, hi = lo + n, hi - n


def exchange(view: np.ndarray, lo: int, cut: int, hi: int) -> None:
    """Swap the neighbouring blocks ``[lo, cut)`` and ``[cut, hi)`` in place by three reversals."""
    if lo < cut < hi:
        reverse(view, lo, cut)
        reverse(view, cut, hi)
        reverse(view, lo, hi)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def line_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the lines of a text, its own end included."""
    ends = np.flatnonzero(data == 10) + 1
    return np.append(ends, len(data)) if len(data) and data[-1] != 10 else ends


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def transform(data: np.ndarray, form: str, first: int, second: int, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The bytes of a text cut at ``first`` and ``second`` in the order of ``form``."""
    prefix, suffix, middle = marks
    out = bytearray(data.tobytes())
    if form == PLAIN:
        return out
    # Insert from the back, so that the earlier cuts stay where they are.
    out[second:second] = suffix
    out[first:first] = middle
    out[0:0] = prefix
    view = np.frombuffer(out, np.uint8)
    middle_at = len(prefix) + first
    suffix_at = len(prefix) + len(middle) + second
    exchange(view, middle_at if form == PSM else 0, suffix_at, len(out))
    return out


def restore(data: np.ndarray, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The bytes of the text that ``transform`` was given."""
    prefix, suffix, middle = marks
    out = bytearray(data.tobytes())
    if form == PLAIN:
        return out
    places = {m: out.find(m) for m in marks}
    if min(places.values()) < 0:
        raise ValueError(f"a {form} text lacks a sentinel")
    view = np.frombuffer(out, np.uint8)
    if form == PSM:
        exchange(view, places[suffix], places[middle], len(out))
        middle_at, suffix_at = places[suffix], places[suffix] + len(out) - places[middle]
    else:
        exchange(view, 0, places[prefix], len(out))
        middle_at, suffix_at = places[middle] - places[prefix], len(out) - places[prefix]
    del view
    del out[suffix_at : suffix_at + len(suffix)]
    del out[middle_at : middle_at + len(middle)]
    del out[: len(prefix)]
    return out


class _Rows:
    """Rows gathered until their texts reach a bounded size."""

    def __init__(self, schema: pa.Schema, text: str):
        self.schema, self.at = schema, schema.get_field_index(text)
        self.cols: list[list] = [[] for _ in schema]
        self.held = 0

    def add(self, *row) -> bool:
        for col, value in zip(self.cols, row):
            col.append(value)
        self.held += len(row[self.at])
        return self.held >= BATCH_BYTES

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.cols[0]:
            # Texts come as bytes that are UTF-8 already.
            arrays = [pa.array(c, pa.binary()).view(pa.string()) if i == self.at else pa.array(c, self.schema.field(i).type) for i, c in enumerate(self.cols)]
            self.cols, self.held = [[] for _ in self.schema], 0
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars and middle_chars (null if plain), and the transformed text.

    ``rate`` percent of the documents are transformed, ``spm`` percent of those with the suffix first.
    """
    marks = sentinels.encoded()
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(schema, "output")
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for doc_id, lo, hi in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = data[lo:hi]
                ends = line_ends(own)
                n = len(ends)
                h1, h2, h3, h4 = draws(doc_id, seed)
                form = PLAIN if not n or h3 % 100 >= rate else SPM if h4 % 100 < spm else PSM
                if form != PLAIN:
                    raw = own.tobytes()
                    if any(m in raw for m in marks):
                        form = PLAIN
                if form == PLAIN:
                    full = rows.add(doc_id, n, form, None, None, own.tobytes())
                else:
                    units = sorted((h1 % (n + 1), h2 % (n + 1)))
                    first, second = (int(ends[u - 1]) if u else 0 for u in units)
                    full = rows.add(doc_id, n, form, code_points(own[:first]), code_points(own[first:second]), bytes(transform(own, form, first, second, marks)))
                if full:
                    yield from rows.take()
        yield from rows.take()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, text_col: str = "output", out: str = "restored", sentinels: Sentinels = Sentinels()) -> DataFrame:
    """``rows`` and the exact text behind ``text_col``, from it and ``form`` alone; ``out`` replaces a column of that name."""
    marks = sentinels.encoded()
    kept = rows.drop(out)
    names = kept.columns
    text_at, form_at = names.index(text_col), names.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(text_at))
            start, part, held = 0, [], 0
            for i, form in enumerate(batch.column(form_at).to_pylist()):
                part.append(bytes(restore(data[offsets[i] : offsets[i + 1]], form, marks)))
                held += len(part[-1])
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    own = batch.slice(start, len(part))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(part, pa.binary()).view(pa.string())], [*names, out])
                    start, part, held = i + 1, [], 0

    return kept.mapInArrow(run, StructType([*kept.schema, StructField(out, StringType())]))
