"""Operator 9: SentencePiece BPE encoding and decoding with a merge-type prefix table.

Every prefix of a text has one BPE encoding, so it is enough to store, for each
prefix, its unique last token. An automaton lists the vocabulary pieces that end
at each place; the piece t that ends there is the last token exactly if the
prefix before t is empty and t encodes to itself, or if the last token u of that
prefix and t are compatible, that is if no merge ever crosses the border of u
and t. Ids are then read backwards. Compatibility undoes the merges of u and t
by priority and looks for an earlier merge across the border.

No piece has another character before the space mark, no piece mixes some kinds
of characters (letters and signs, say), and characters that stand in no longer
piece (those outside the vocabulary, which become byte pieces, too) never merge.
So a text falls into chunks (a run of space marks with the characters of one kind
after it, or a run of those that never merge) that are encoded by themselves;
tasks keep a bounded table of chunks seen.
New chunks are read in sorted order: the last tokens of a prefix shared with the
chunk before are there already.

Only the vocabulary file is read with the sentencepiece library. Spark deals
documents out; a task keeps one bundle of texts and a table of chunks that is
bounded by TABLE_BYTES, counted while it is filled (chunks of more than
LONG_CHUNK characters don't stay in it). The table is two halves: when the young
one is full it becomes the old one, from which chunks that come again move on.

Defined results: a null text counts as empty (one id, the end id); other
columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pitwell.llm.shared import documents, in_batches

MARK = "▁"
#: Bytes of the table of chunks seen in a worker, about, and characters of the longest chunk that is kept there.
TABLE_BYTES, LONG_CHUNK = 40 << 20, 64
#: Characters of the texts that are taken together (a longer text is alone), and chunks looked up together.
BUNDLE, STRIDE = 1 << 19, 1 << 16
#: Pairs of pieces whose compatibility a worker remembers, about 80 bytes each.
KNOWN_PAIRS = 1 << 18
MODEL = "piece_bpe_32k.model"
#: States by the next character, the state of the longest ending (None at the root), pieces with their sizes.
State = tuple[dict[str, "State"], "State | None", tuple[tuple[str, int], ...]]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCodec:
    """Encoder and decoder over the vocabulary of one BPE model with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = model.eos_id()
        # Marks stand as spaces from here on, as in the texts.
        pieces = [model.id_to_piece(i).replace(MARK, " ") for i in range(model.get_piece_size())]
        self.byte = {int(pieces[i][1:-1], 16): i for i in range(len(pieces)) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        odd = {i for i in range(len(pieces)) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        #: What an id adds to a text: nothing for control ids, None for bytes.
        self.surface = [None if i in self.of_byte else "" if i in odd else p for i, p in enumerate(pieces)]
        self.ids = {p: i for i, p in enumerate(pieces) if i not in odd}
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -model.get_score(self.ids[p]))
        #: Priority of the merge that makes a piece; single characters are there from the start.
        self.rank = {p: r for r, p in enumerate(order)}
        self.known = {p for p in self.ids if len(p) == 1}
        self.halves: dict[str, tuple[str, str] | None] = {}
        #: Whether a piece may stand after another one, as far as asked: right pieces by left piece.
        self.beside: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        # A piece that no merge makes never stands in an encoding.
        made = {p for p in self.ids if len(p) == 1 or self.split(p)}
        #: The automaton; pieces that end at a state are listed longest first.
        self.root: State = ({}, None, ())
        states = {"": self.root}
        for name in sorted({p[:n] for p in made for n in range(1, len(p) + 1)}, key=len):
            ending = name[1:]
            while ending not in states:
                ending = ending[1:]
            pieces_here = states[ending][2]
            if name in made:
                self.beside[name] = {}
                pieces_here = ((name, len(name)), *pieces_here)
            states[name] = states[name[:-1]][0][name[-1]] = ({}, states[ending], pieces_here)
        kinds: list[set[str]] = []
        for kind in (set(p) - {" "} for p in self.rank):
            kinds, met = [k for k in kinds if not k & kind], [k for k in kinds if k & kind]
            kinds.append(kind.union(*met))
        #: Characters that merge with each other, directly or over others; letters and signs fall apart.
        self.kinds = ["".join(map(re.escape, sorted(k))) for k in sorted(kinds, key=len, reverse=True) if k]
        one_kind = "|".join(f"[{k}]+" for k in self.kinds)
        self.chunk = re.compile(f" *+(?:{one_kind})| +|[^ {''.join(self.kinds)}]+")
        #: The text read last, with the state and the last token at each place.
        self.read, self.states, self.last = "", [self.root], [""]
        #: Ids of chunks seen, as text; `odd` holds those whose decoded text isn't the chunk itself.
        self.table: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.held = 0

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two halves whose merge makes the piece when it is encoded by itself; None if it never is, or is one character."""
        if piece not in self.halves:
            parts, found = list(piece), None
            while len(parts) > 1:
                ranked = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
                if not ranked:
                    break
                i = min(ranked)[1]
                found = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[piece] = found if len(parts) == 1 else None
        return self.halves[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the pieces stay side by side; remembered for KNOWN_PAIRS pairs, then anew."""
        if self.pairs >= KNOWN_PAIRS:
            for after in self.beside.values():
                after.clear()
            self.pairs = 0
        self.pairs += 1
        fits = self.beside[left][right] = self.undone(left, right)
        return fits

    def undone(self, left: str, right: str) -> bool:
        """Compatibility of two pieces: undoing merges from the latest on, none across the border comes first."""
        rank, limit, halves = self.rank, len(self.rank), self.halves
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # made later, so its right half stood at the border before
                limit, left = a, halves[left][1]
            else:  # of two equal merges the left one is made first
                limit, right = b + 1, halves[right][0]

    def last_tokens(self, text: str) -> list[str]:
        """The last token of every prefix of a text of known characters, till the next call; place 0 stays empty."""
        states, last, beside = self.states, self.last, self.beside
        end = 0
        for x, y in zip(self.read, text):
            if x != y:
                break
            end += 1
        del states[end + 1 :], last[end + 1 :]
        self.read, state = text, states[end]
        for c in text[end:]:
            end += 1
            while (after := state[0].get(c)) is None:
                state = state[1]
            state = after
            states.append(state)
            for piece, size in state[2]:
                if end != size:
                    left = last[end - size]
                    fits = beside[left].get(piece)
                    if fits is None:
                        fits = self.compatible(left, piece)
                    if not fits:
                        continue
                last.append(piece)
                break
        return last

    def encode_known(self, text: str) -> list[int]:
        last, ids, back = self.last_tokens(text), self.ids, []
        i = len(text)
        while i:
            token = last[i]
            back.append(ids[token])
            i -= len(token)
        back.reverse()
        return back

    def encode_chunk(self, chunk: str) -> list[int]:
        if self.known.issuperset(chunk):
            return self.encode_known(chunk)
        out: list[int] = []
        for known, part in groupby(chunk, self.known.__contains__):
            text = "".join(part)
            out += self.encode_known(text) if known else [self.byte[b] for b in text.encode("utf-8", "replace")]
        return out

    def decode_pieces(self, ids: Iterable[int]) -> str:
        """Text of ids without the rule for the first space mark."""
        ids = list(ids)
        texts = [self.surface[i] for i in ids]
        if None not in texts:
            return "".join(texts)
        out, raw = [], bytearray()
        for i in ids:
            text = self.surface[i]
            if text is None:
                raw.append(self.of_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(text)
        return "".join(out) + raw.decode("utf-8", "replace") if raw else "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_pieces(ids).removeprefix(" ")

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(" " + text.replace(MARK, " ")) if text else []

    def learn(self, chunks: Iterable[str]) -> None:
        """Enters ids and decoded text of chunks that the young half of the table doesn't hold."""
        table, old = self.table, self.old
        for chunk in sorted(chunks):
            listed = old.get(chunk)
            if listed is None:
                ids = self.encode_chunk(chunk)
                listed, text = " ".join(map(str, ids)), self.decode_pieces(ids)
                if text != chunk:
                    self.odd[chunk] = text
            table[chunk] = listed
            if len(chunk) <= LONG_CHUNK:
                self.held += getsizeof(chunk) + getsizeof(listed) + 110 + (getsizeof(self.odd[chunk]) + 110 if chunk in self.odd else 0)

    def listed(self, chunks: list[str]) -> tuple[list[str], dict[str, str]]:
        """Ids of every chunk, as text; chunks whose decoded text is another one, with that text."""
        out: list[str] = []
        odd: dict[str, str] = {}
        for at in range(0, len(chunks), STRIDE):
            if self.held > TABLE_BYTES // 2:
                self.table, self.old, self.held = {}, self.table, 0
                self.odd = {c: t for c, t in self.odd.items() if c in self.old}
            part = chunks[at : at + STRIDE]
            new = set(part).difference(self.table)
            self.learn(new)
            out += map(self.table.__getitem__, part)
            if self.odd:
                odd |= {c: self.odd[c] for c in part if c in self.odd}
            for c in new:
                if len(c) > LONG_CHUNK:
                    del self.table[c]
                    self.odd.pop(c, None)
        return out, odd

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them, with the end id."""
        return [i for c in self.chunks(text) for i in self.encode_chunk(c)] + [self.end]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the ids and digest of the decoded text of every text."""
        chunks: list[str] = []
        ends = []
        for text in texts:
            chunks += self.chunks(text)
            ends.append(len(chunks))
        listed, odd = self.listed(chunks)
        out = []
        for text, at, end in zip(texts, [0, *ends], ends):
            ids = " ".join([*listed[at:end], str(self.end)])
            back = "".join([odd.get(c, c) for c in chunks[at:end]]).removeprefix(" ") if odd else text.replace(MARK, " ")
            out.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()))
        return out


def bundles(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in their order, BUNDLE characters at a time or one longer text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > BUNDLE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of every document, with the end id."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids = [c.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").transform(in_batches, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows of doc_id, ids."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").transform(in_batches, run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, without the ids themselves."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            at = 0
            for texts in bundles(t.as_py() or "" for t in b.column(1)):
                n, ids, back = zip(*c.digests(texts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(in_batches, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))
