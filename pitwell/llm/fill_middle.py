"""Operator 11: fill-in-the-middle over seekable compressed frames.

Texts are stored as independent zstandard frames of about FRAME_BYTES bytes. With
each frame stand the cumulative counts at its end: units (tokens of the contract
that end in it or before), code points and bytes. A cut after u units is found by
a search in the counts and by decompressing the one frame in which unit u ends.
The transformed text is a list of frames too: whole frames of the store are passed
on as they are, only the parts of cut frames and the marks are compressed anew,
and since zstandard streams may be joined, the list is one valid stream of the
output. Digests and the way back stream those frames in order, one at a time.

A unit is a word with the white space before it; white space after the last word
is one more unit. Frames end at a unit's end as long as units are shorter than a
frame; longer units pass over several frames and count where they end.

The store is a table on the shared folder: other cuts (another seed) are made from
it without reading or splitting texts again. No step shuffles.

Defined results: a null text is empty (plain, no unit); a null doc_id hashes as '';
rows are handled one by one, so that repeated rows give repeated results; other
columns are ignored. A text that holds one of the marks stays plain, so that marks
in an output are always the operator's own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from pitwell.llm.shared import SPACE, documents, slices, stored

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED = "42:"
FRAME_BYTES = 1 << 16
LEVEL = 1
#: Of 100 texts, those cut at all, and of these the ones that begin with the suffix.
CUT_RATE, SPM_RATE = 50, 80

FRAME = "frames array<binary>, units array<long>, chars array<long>, bytes array<long>, marked boolean"


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Places behind the last byte of each unit."""
    space = SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(data)) if len(data) else ends


def frame_borders(ends: np.ndarray, n: int, size: int) -> list[int]:
    """Ends of the frames: each the last unit's end within `size` bytes, or `size` bytes inside a longer unit."""
    out, at = [], 0
    while at < n:
        k = int(np.searchsorted(ends, at + size, "right"))
        last = int(ends[k - 1]) if k else 0
        at = last if last > at else min(n, at + size)
        out.append(at)
    return out


def store_text(text: bytes, pack: zstandard.ZstdCompressor, size: int = FRAME_BYTES) -> tuple[list[bytes], list[int], list[int], list[int], bool]:
    """Frames of a text and the cumulative counts of units, code points and bytes at their ends; whether a mark stands in it."""
    data = np.frombuffer(text, np.uint8)
    ends = unit_ends(data)
    borders = frame_borders(ends, len(data), size)
    units = np.searchsorted(ends, borders, "right").tolist()
    heads = [int(np.count_nonzero((data[a:b] & 0xC0) != 0x80)) for a, b in zip([0, *borders], borders)]
    frames = [pack.compress(text[a:b]) for a, b in zip([0, *borders], borders)]
    return frames, units, np.cumsum(heads, dtype=np.int64).tolist(), borders, any(m in text for m in MARKS)


def text_frames(docs: DataFrame, size: int = FRAME_BYTES) -> DataFrame:
    """doc_id, frames, units, chars, bytes (arrays, a place for each frame), marked: the seekable form of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        for b in batches:
            for part in slices(b):
                rows = [store_text((t.as_py() or "").encode(), pack, size) for t in part.column("text")]
                frames, units, chars, ends, marked = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(frames, pa.list_(pa.binary())), *(pa.array(x, pa.list_(pa.int64())) for x in (units, chars, ends)), pa.array(marked)],
                    names=["doc_id", "frames", "units", "chars", "bytes", "marked"],
                )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FRAME}")


class FramedText:
    """A stored text: places of units by seeking, parts of it as frames."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int], ends: list[int]):
        self.frames, self.units, self.chars, self.ends = frames, units, chars, ends
        self.n = units[-1] if units else 0
        self.size = ends[-1] if ends else 0

    def place(self, u: int, unpack: zstandard.ZstdDecompressor) -> tuple[int, int, int]:
        """Where unit u (from 1) ends, 0: the text's start: frame, bytes of it before the cut, code points before the cut."""
        if not u:
            return 0, 0, 0
        k = bisect_left(self.units, u)
        before = (self.units[k - 1], self.chars[k - 1], self.ends[k - 1]) if k else (0, 0, 0)
        if u == self.units[k]:
            return k, self.ends[k] - before[2], self.chars[k]
        data = np.frombuffer(unpack.decompress(self.frames[k]), np.uint8)
        at = int(unit_ends(data)[u - before[0] - 1])
        return k, at, before[1] + int(np.count_nonzero((data[:at] & 0xC0) != 0x80))

    def part(self, a: tuple[int, int, int], b: tuple[int, int, int], pack: zstandard.ZstdCompressor, unpack: zstandard.ZstdDecompressor) -> Iterator[bytes]:
        """Frames of the text between two places; whole ones as they are stored."""
        for k in range(a[0], min(b[0], len(self.frames) - 1) + 1):
            length = self.ends[k] - (self.ends[k - 1] if k else 0)
            low, high = a[1] if k == a[0] else 0, b[1] if k == b[0] else length
            if high - low == length:
                yield self.frames[k]
            elif high > low:
                yield pack.compress(unpack.decompress(self.frames[k])[low:high])


def draws(doc_id: object, seed: str = SEED) -> list[int]:
    """The first four 32-bit numbers of the document's digest."""
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def form_of(h: list[int], n: int, marked: bool) -> str:
    if not n or marked or h[2] % 100 >= CUT_RATE:
        return "plain"
    return "spm" if h[3] % 100 < SPM_RATE else "psm"


def transformed(text: FramedText, h: list[int], form: str, pack: zstandard.ZstdCompressor, unpack: zstandard.ZstdDecompressor) -> tuple[list[bytes], int | None, int | None]:
    """Frames of the output, code points of prefix and middle (None if plain)."""
    if form == "plain":
        return text.frames, None, None
    low, high = sorted((h[0] % (text.n + 1), h[1] % (text.n + 1)))
    a, b = text.place(low, unpack), text.place(high, unpack)
    start, end = (0, 0, 0), (len(text.frames) - 1, text.size - (text.ends[-2] if len(text.ends) > 1 else 0), text.chars[-1])
    parts = {PREFIX: (start, a), MIDDLE: (a, b), SUFFIX: (b, end)}
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    frames = [f for m in order for f in (pack.compress(m), *text.part(*parts[m], pack, unpack))]
    return frames, a[2], b[2] - a[2]


def decompressed(frames: Iterable[bytes], unpack: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    for f in frames:
        yield unpack.decompress(f)


def mark_places(blocks: Iterable[bytes]) -> dict[bytes, int]:
    """Byte places of the marks in a streamed output, also of those that lie over two blocks."""
    found, tail, at = {}, b"", 0
    for block in blocks:
        window = tail + block
        for m in MARKS:
            if m not in found and (i := window.find(m)) >= 0:
                found[m] = at - len(tail) + i
        tail, at = window[-2:], at + len(block)
    return found


def restored(frames: list[bytes], form: str, unpack: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """Blocks of the text from an output and its form alone."""
    if form == "plain":
        yield from decompressed(frames, unpack)
        return
    at = mark_places(decompressed(frames, unpack))
    borders = sorted(at.values())
    for m in (PREFIX, MIDDLE, SUFFIX):
        low = at[m] + len(m)
        high = next((x for x in borders if x > at[m]), None)
        place = 0
        for f in frames:
            length = zstandard.frame_content_size(f)
            if place + length > low and (high is None or place < high):
                yield unpack.decompress(f)[max(0, low - place) : None if high is None else max(0, high - place)]
            place += length


def sha256_of(blocks: Iterable[bytes]) -> str:
    out = hashlib.sha256()
    for block in blocks:
        out.update(block)
    return out.hexdigest()


def fill_in_middle(store: DataFrame, seed: str = SEED, digests_only: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, unless digests_only, output (one zstandard stream) of every stored text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), zstandard.ZstdDecompressor()
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                rows, outputs = [], []
                for r in part.to_pylist():
                    text, h = FramedText(r["frames"], r["units"], r["chars"], r["bytes"]), draws(r["doc_id"], seed)
                    form = form_of(h, text.n, r["marked"])
                    frames, prefix, middle = transformed(text, h, form, pack, unpack)
                    rows.append((text.n, form, prefix, middle, sha256_of(decompressed(frames, unpack)), sha256_of(restored(frames, form, unpack))))
                    if not digests_only:
                        outputs.append(b"".join(frames))
                n, form, prefix, middle, out, back = zip(*rows)
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string()), pa.array(back, pa.string())]
                columns += [] if digests_only else [pa.array(outputs, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    kind = store.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *([] if digests_only else ["output"])]
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return store.mapInArrow(run, schema + ("" if digests_only else ", output binary"))


def output_texts(outputs: DataFrame) -> DataFrame:
    """doc_id, form, text: the outputs of fill_in_middle as texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                stream = unpack.stream_reader(b.column("output")[i].as_py(), read_across_frames=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), b.column("form").slice(i, 1), pa.array([stream.read().decode()])], names=["doc_id", "form", "text"])

    return outputs.select("doc_id", "form", "output").mapInArrow(run, f"doc_id {outputs.schema['doc_id'].dataType.simpleString()}, form string, text string")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(stored(text_frames(documents(spark, sf_dir)), "op11-frames"), digests_only=True)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || x || '<M>' || m ELSE '<P>' || x || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
