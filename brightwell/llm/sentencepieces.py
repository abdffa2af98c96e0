"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

Greedy merging by score has two properties: a row of tokens is the encoding
of its text exactly if each two neighbours are the encoding of theirs, and
what precedes the last token is the encoding of its own text. So each prefix
has one last token: the one that ends there (found by an automaton over the
vocabulary) and is compatible with the last token of the prefix before it.
The table is filled left to right and the ids are read backwards.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, paused_gc, worker_held

SPACE = "▁"
#: Segments kept with their ids in a worker, and their characters at most; the memo starts anew beyond.
MEMO, MEMO_CHARS = 300_000, 64


def _proto(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {5: 4, 1: 8}[kind]
        yield tag >> 3, data[at : at + n]
        at += n


class PieceModel:
    """A BPE model with byte fallback and identity normalisation, as read from its file.

    Other kinds of model are refused with a ValueError, as they encode otherwise.
    """

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, data: bytes):
        import struct

        self.pieces: list[str] = []
        self.score: dict[str, tuple[float, int]] = {}
        self.byte_id: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        self.control: set[int] = set()
        self.unknown = 0
        self.dummy_prefix = True
        kind_of_model, fallback, normaliser, strip = 1, False, "", True
        for number, value in _proto(data):
            if number == 1:
                got = dict(_proto(value))
                piece, kind = got[1].decode(), got.get(3, self.NORMAL)
                i = len(self.pieces)
                self.pieces.append(piece)
                if kind == self.NORMAL:
                    self.score[piece] = (struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], i)
                elif kind == self.BYTE:
                    self.byte_id[int(piece[3:5], 16)] = i
                    self.byte_of[i] = int(piece[3:5], 16)
                elif kind == self.CONTROL:
                    self.control.add(i)
                elif kind == self.UNKNOWN:
                    self.unknown = i
                else:
                    raise ValueError(f"piece {piece!r} of type {kind} is not supported")
            elif number == 2:
                spec = dict(_proto(value))
                kind_of_model, fallback = spec.get(3, 1), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_proto(value))
                normaliser, self.dummy_prefix, strip = spec.get(1, b"").decode(), bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if not spec.get(5, 1) or spec.get(2):
                    raise ValueError("only the identity normaliser with escaped white space is supported")
        if kind_of_model != 2 or not fallback or normaliser != "identity" or strip:
            raise ValueError("only BPE with byte fallback, identity normaliser and kept white space is supported")
        self.automaton = ahocorasick.Automaton()
        self._history: dict[str, tuple[bool, list[tuple[float, str, str]]]] = {}
        self.size = list(map(len, self.pieces))
        if any(c not in self.score for p in self.score for c in p):
            raise ValueError("a character of a piece is no piece")
        for piece, (_, i) in self.score.items():
            if self.history(piece)[0]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        # Where no piece holds a space after another character, or a line end, texts can be cut there.
        self.cut = None
        if not any(SPACE in p.lstrip(SPACE) for p in self.score) and not any("\n" in p for p in self.score):
            self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

    def history(self, piece: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Greedy merging of a piece by definition: best score first, then leftmost.

        Whether it ends as one token (others never occur), and the score of
        each merge with the first and last symbol before it.
        """
        if (got := self._history.get(piece)) is None:
            parts, steps = list(piece), []
            while True:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    s = self.score.get(parts[k] + parts[k + 1])
                    if s is not None and (best is None or s[0] > best):
                        best, at = s[0], k
                steps.append((-math.inf if best is None else best, parts[0], parts[-1]))
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = self._history[piece] = (len(parts) == 1, steps)
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two, side by side, stay as they are.

        Both are merged along their own histories, in the order in which they
        would be side by side; they fail if at some point the pair across the
        border comes first (ties go to the left).
        """
        a, b = self.history(self.pieces[left])[1], self.history(self.pieces[right])[1]
        i = j = 0
        ok = True
        while True:
            across = self.score.get(a[i][2] + b[j][1])
            if across is not None and across[0] > a[i][0] and across[0] >= b[j][0]:
                ok = False
                break
            if i == len(a) - 1 and j == len(b) - 1:
                break
            if a[i][0] >= b[j][0] and i < len(a) - 1:
                i += 1
            else:
                j += 1
        if len(self._pairs) > 600_000:
            self._pairs.clear()
        self._pairs[left << 20 | right] = ok
        return ok

    def segment(self, text: str) -> list[int]:
        """Ids of a text without a dummy prefix, from the table of last tokens."""
        n = len(text)
        # last[i]: the last token of the first i characters; -1: a character outside the vocabulary, which nothing merges with.
        last = [-1] * (n + 1)
        known, compatible = self._pairs.get, self.compatible
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:  # each prefix has one
                before = last[end - size]
                if before < 0:
                    last[end] = token
                    continue
                ok = known(before << 20 | token)
                if ok or ok is None and compatible(before, token):
                    last[end] = token
        out: list[int] = []
        while n:
            token = last[n]
            if token >= 0:
                out.append(token)
                n -= self.size[token]
            else:
                out.extend(self.byte_id[b] for b in reversed(text[n - 1].encode()))
                n -= 1
        out.reverse()
        return out

    def encode(self, text: str, memo: dict[str, list[int]]) -> list[int]:
        """Ids as the library's encode() without begin and end ids."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.dummy_prefix:
            text = SPACE + text
        if self.cut is None:
            return self.segment(text)
        out: list[int] = []
        extend, get = out.extend, memo.get
        for part in self.cut.findall(text):
            ids = get(part)
            if ids is None:
                ids = self.segment(part)
                if len(part) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[part] = ids
            extend(ids)
        return out

    def decoder(self):
        """A function from ids to text, as the library's decode().

        Bytes of byte pieces that are not UTF-8 become U+FFFD one by one.
        """
        table = [p.replace(SPACE, " ") for p in self.pieces]
        for i in self.control:
            table[i] = ""
        table[self.unknown] = " ⁇ "
        first = list(table)
        if self.dummy_prefix:
            first = [t[1:] if t.startswith(" ") and i != self.unknown else t for i, t in enumerate(table)]
        byte_of = self.byte_of
        # Single-byte characters need no gathering.
        mark = [None if i in byte_of and byte_of[i] >= 128 else chr(byte_of[i]) if i in byte_of else t for i, t in enumerate(table)]

        def decode(ids: list[int]) -> str:
            if not ids:
                return ""
            start = 0
            while start < len(ids) and ids[start] in self.control:
                start += 1
            if start == len(ids):
                return ""
            parts = [mark[i] for i in ids[start:]]
            if ids[start] not in byte_of:
                parts[0] = first[ids[start]]
            if None not in parts:
                return "".join(parts)
            out: list[str] = []
            run = bytearray()
            for i, part in zip(ids[start:], parts):
                if part is None:
                    run.append(byte_of[i])
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run.clear()
                out.append(part)
            if run:
                out.append(_utf8(bytes(run)))
            return "".join(out)

        return decode


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _held(data: bytes) -> tuple[PieceModel, dict[str, list[int]]]:
    """The model and memo of this worker; they live as long as it does."""
    return worker_held(("piece model", hashlib.sha256(data).digest()), lambda: (PieceModel(data), {}))


def encode_decode(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded: one row per input row. Null texts count as empty (no ids).

    The model file is read on the driver and broadcast (its size is that of a
    vocabulary). One pass, no shuffle; a worker's memory is bounded by the
    memo and one document. Extra columns are not read.
    """
    return _run(documents, model_path, "ids array<int>, decoded string", lambda ids, text, _: (ids, text), (pa.list_(pa.int32()), pa.string()), ("ids", "decoded"))


def digests(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the same ids and texts, without moving them out of the worker."""

    def digest(ids: list[int], text: str, _: str) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _run(documents, model_path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest, (pa.int64(), pa.string(), pa.string()), ("n_tokens", "ids_sha256", "decoded_sha256"))


def tokens(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back."""

    def row(ids: list[int], text: str, source: str) -> tuple[int, list[int], bool]:
        return len(ids), ids, text == source

    return _run(documents, model_path, "n_tokens bigint, ids array<int>, round_trip boolean", row, (pa.int64(), pa.list_(pa.int32()), pa.bool_()), ("n_tokens", "ids", "round_trip"))


def _run(documents: DataFrame, model_path: str, schema: str, make, kinds: tuple, names: tuple) -> DataFrame:
    with open(model_path, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = _held(model.value)
        decode = m.decoder()
        for b in batches:
            rows = []
            with paused_gc():
                for t in b.column(1).to_pylist():
                    ids = m.encode(t or "", memo)
                    rows.append(make(ids, decode(ids), t or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", *names])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").transform(bounded_batches).mapInArrow(run, f"doc_id bigint, {schema}")
