"""Token files: documents' ids in rANS blocks under one shared frequency table.

Ids are counted over the whole corpus for the table, rows are ranged by
doc_id, and each task writes files of bounded size: a header, blocks (the
documents' ids and lengths, and the coded ids, each with a checksum) and an
index of the blocks. Each stretch between two checkpoints of a block is read
by itself, so decoding is as parallel as there are stretches; what a document
has in several is put together by its checksum.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, open_bytes, paused_gc, put_bytes, qualified, scratch, worker_held, written
from .rans import Coder, Table, stretches

FILE_MAGIC, END_MAGIC = b"TOKRANS1", b"TOKREND1"
#: Ids of a block, and of a file before the next begins. Both bound memory.
BLOCK_IDS, FILE_IDS = 1 << 18, 1 << 23
END_ID = 1
MEMO = 600_000

TOKENS = "doc_id bigint, n_tokens bigint, ids binary"
#: A row for each block: its place in the order (part, seq, block), where it lies, and what it holds.
BLOCKS = "part int, seq int, block int, path string, at bigint, size bigint, n_ids bigint, n_docs bigint, stretches int"
PARTS = "doc_id bigint, doc_start bigint, at bigint, n bigint, crc bigint, whole boolean"
#: Texts of these characters only are normalised by lower-casing alone and cut by CUT as the tokenizer's own pattern cuts them.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: itself if printable, else the next character from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in keep else next(rest)) for b in range(256)]


class _Words(dict):
    """Ids of words, as bytes of uint16, from the library's model."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize = tokenizer.model.tokenize
        self.stand_in = _byte_characters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        mapped = word if word.isascii() else "".join(self.stand_in[b] for b in word.encode())
        ids = self[word] = np.array([t.id for t in self.tokenize(mapped)], dtype="<u2").tobytes()
        return ids


class WordTokenizer:
    """A tokenizer file of the tokenizers library: ids of whole texts, without special tokens.

    The library encodes texts whole, but for those of PLAIN characters without
    the string of an added token, if the file has just the normaliser and
    pattern NORMAL and PATTERN: on these CUT finds the same words (tests hold
    it against the library for every character of PLAIN), each new word is
    encoded by the library's model, and its ids are remembered.
    """

    #: What a file must say for CUT to be its rule.
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    PATTERN = [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data)
        spec = json.loads(data)
        self.size = max(self.library.get_vocab_size(), END_ID + 1)
        if self.size > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = _Words(self.library)
        same = (spec["normalizer"] or {}).get("normalizers") == self.NORMAL and (spec["pre_tokenizer"] or {}).get("pretokenizers") == self.PATTERN
        self.plain = PLAIN.fullmatch if same else lambda _: None

    def ids(self, text: str) -> bytes:
        if self.plain(text) and not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, CUT.findall(text.lower())))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()


def tokenize(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint16), the end id last. Null texts count as empty: the end id alone."""
    with open(tokenizer_path, encoding="utf-8") as f:
        data = documents.sparkSession.sparkContext.broadcast(f.read())
    end = struct.pack("<H", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = data.value
        tokenizer = worker_held(("word tokenizer", hashlib.sha256(text.encode()).digest()), lambda: WordTokenizer(text))
        for b in batches:
            with paused_gc():
                ids = [tokenizer.ids(t) + end if t else end for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").transform(bounded_batches).mapInArrow(run, TOKENS)


def frequencies(tokens: DataFrame) -> Table:
    """The table of all ids. Each task counts its ids; what reaches the driver is as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            counts += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2"), minlength=1 << 16)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["id", "n"])

    rows = tokens.select("ids").transform(bounded_batches).mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max([r["id"] for r in rows], default=0), dtype=np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return Table.of(counts)


def _file(coder: Coder, table_crc: int, docs: list[tuple[int | None, bytes]]) -> tuple[list[bytes], list[tuple[int, int, int, int]]]:
    """The parts of a file (header, blocks, index of blocks), and (at, size, ids, documents that end) of each block."""
    parts = [FILE_MAGIC + struct.pack("<IQQ", table_crc, len(docs), sum(len(x) // 2 for _, x in docs))]
    at, placed = len(parts[0]), []
    pending: list[tuple[int | None, int]] = []
    held: list[np.ndarray] = []
    n = before = 0  # before: ids that the block's first document has in earlier blocks

    def flush(then: int) -> None:
        nonlocal at, n, before
        names = struct.pack("<IQ", len(pending), before) + b"".join(struct.pack("<?qI", i is None, i or 0, k) for i, k in pending)
        block = names + struct.pack("<I", zlib.crc32(names)) + coder.encode(np.concatenate(held) if held else np.empty(0, dtype=np.int64))
        placed.append((at, len(block), n, sum(k < 1 << 31 for _, k in pending)))
        parts.append(block)
        at += len(block)
        pending.clear()
        held.clear()
        n, before = 0, then

    for i, raw in docs:
        ids = np.frombuffer(raw, "<u2").astype(np.int64)
        done = 0
        while True:  # a document goes on in the next block
            take = min(len(ids) - done, BLOCK_IDS - n)
            more = done + take < len(ids)
            pending.append((i, take | (more << 31)))
            held.append(ids[done : done + take])
            n += take
            done += take
            if n >= BLOCK_IDS:
                flush(done if more else 0)
            if not more:
                break
    if pending:
        flush(0)
    index = b"".join(struct.pack("<QQ", a, size) for a, size, _, _ in placed)
    parts.append(index + struct.pack("<II", len(placed), zlib.crc32(index)) + END_MAGIC)
    return parts, placed


def block_names(block: bytes) -> tuple[int, list[tuple[int | None, int, bool]], int]:
    """(ids before the block that its first document has, (doc_id, ids here, whether it ends here) of each, where the coded ids begin)."""
    docs, before = struct.unpack_from("<IQ", block)
    names = block[: 12 + 13 * docs]
    if struct.unpack_from("<I", block, len(names))[0] != zlib.crc32(names):
        raise ValueError("damaged list of documents")
    return before, [(None if null else i, k & 0x7FFFFFFF, k < 1 << 31) for null, i, k in struct.iter_unpack("<?qI", names[12:])], len(names) + 4


def read_stretch(block: bytes, coder: Coder, stretch: int, span: int, start: int) -> Iterator[tuple[int | None, int, int, np.ndarray, bool]]:
    """(doc_id, its first id's place, place of the first id here, ids here, whether they are all) of the documents in a stretch.

    start: the place of the block's first id in the whole corpus.
    """
    before, names, at = block_names(block)
    ids = coder.decode(block[at:], stretch, stretch + 1)
    lo, hi, pos = stretch * span, stretch * span + len(ids), 0
    for k, (i, n, ends) in enumerate(names):
        a, b = max(pos, lo), min(pos + n, hi)
        if a < b:
            first = start + pos - (before if k == 0 else 0)
            whole = ends and a == pos and b == pos + n and first == start + pos
            yield i, first, start + a, ids[a - lo : b - lo], whole
        pos += n


def read_file(f, coder: Coder, table_crc: int) -> Iterator[tuple[int | None, np.ndarray, bool]]:
    """(doc_id, ids, whether the document ends here) of a file by itself, in order; one block in memory at a time."""
    head = f.read(28)
    if head[:8] != FILE_MAGIC or struct.unpack_from("<I", head, 8)[0] != table_crc:
        raise ValueError("not a token file of this frequency table")
    f.seek(-16, 2)
    n, crc = struct.unpack("<II", (end := f.read(16))[:8])
    f.seek(-16 - 16 * n, 2)
    index = f.read(16 * n)
    if end[8:] != END_MAGIC or zlib.crc32(index) != crc:
        raise ValueError("damaged index of blocks")
    for at, size in struct.iter_unpack("<QQ", index):
        f.seek(at)
        block = f.read(size)
        _, names, begin = block_names(block)
        ids, pos = coder.decode(block[begin:]), 0
        for i, k, ends in names:
            yield i, ids[pos : pos + k], ends
            pos += k


def write(tokens: DataFrame, table: Table, folder: str, *, file_ids: int = FILE_IDS) -> DataFrame:
    """Write files in ascending doc_id order (nulls first): a row for each block, with first_id, its place in the order.

    tokens: a written table. Rows of one id are ranged by their place in it,
    so no id fills a task. A file's name holds the task attempt, and only rows
    of attempts that ended well are listed, so a retried task leaves at most a
    file that nothing names.
    """
    raw = table.to_bytes()
    spark = tokens.sparkSession
    folder = qualified(spark, folder)
    shared = spark.sparkContext.broadcast(raw)
    schema = pa.schema([(x.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        coder, crc = Coder(Table.from_bytes(shared.value)), zlib.crc32(shared.value)
        docs: list[tuple[int | None, bytes]] = []
        seq = ids = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, seq
            path = f"{folder}/part-{part:05d}-{seq:05d}-{attempt}.rans"
            parts, placed = _file(coder, crc, docs)
            put_bytes(path, parts)
            rows = [(part, seq, k, path, *p, stretches(p[2])[0]) for k, p in enumerate(placed)]
            docs.clear()
            ids = 0
            seq += 1
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append((i, x))
                ids += len(x) // 2
                if ids >= file_ids:
                    yield flush()
        if docs:
            yield flush()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    ranged = tokens.select("doc_id", "ids", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = written(ranged.select("doc_id", "ids").transform(bounded_batches).mapInArrow(run, BLOCKS), "token-blocks")
    # Places: a row for each task first, then the blocks of each task by themselves.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("s")).withColumn("p0", F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "p0")
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("k0", inside).join(F.broadcast(totals), "part").withColumn("first_id", F.col("p0") + F.col("k0")).drop("p0", "k0")


def crc32_joined(a: int, b: int, n: int) -> int:
    """The CRC-32 of x + y from those of x and y, y being n bytes: a is carried over n zero bytes by squaring."""
    matrix = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit

    def times(m: list[int], v: int) -> int:
        out = k = 0
        while v:
            if v & 1:
                out ^= m[k]
            v >>= 1
            k += 1
        return out

    bits = 8 * n
    while bits:
        if bits & 1:
            a = times(matrix, a)
        matrix = [times(matrix, row) for row in matrix]
        bits >>= 1
    return a ^ b


def read(blocks: DataFrame, table_bytes: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the listed blocks (a written table).

    A row of work is a stretch between checkpoints; what is shuffled besides
    are the pieces of documents that lie in several, without their ids.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(table_bytes)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = blocks.select("path", "at", "size", "n_ids", "first_id", F.explode(F.sequence(F.lit(0), F.col("stretches") - 1)).alias("stretch"))
    schema = pa.schema([("doc_id", pa.int64()), ("doc_start", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Table.from_bytes(shared.value))
        for b in batches:
            for path, at, size, n, first, stretch in zip(*(b.column(k).to_pylist() for k in range(6))):
                with open_bytes(path) as f:
                    f.seek(at)
                    block = f.read(size)
                rows = [(i, start, a, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole) for i, start, a, ids, whole in read_stretch(block, coder, stretch, stretches(n)[1], first)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(schema.types)], schema=schema)

    pieces = written(work.repartition(tasks, "path", "at", "stretch").transform(bounded_batches).mapInArrow(run, PARTS), "token-pieces")
    whole = pieces.where("whole").select("doc_id", F.col("doc_start").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))

    # A document has one piece for each stretch it lies in: some bytes for 2^16 ids.
    def join(parts):
        out = 0
        for p in sorted(parts):
            out = crc32_joined(out, p[2], 4 * p[1])
        return out

    joined = F.udf(join, "bigint")
    some = pieces.where("not whole").groupBy("doc_id", "doc_start").agg(F.sum("n").alias("n_tokens"), joined(F.collect_list(F.struct("at", "n", "crc"))).alias("ids_crc32"))
    return whole.unionByName(some.select("doc_id", F.col("doc_start").alias("start"), "n_tokens", "ids_crc32"))


def round_trip(documents: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Tokenise, write and read back: doc_id, start, n_tokens, ids_crc32.

    Null texts count as empty; rows that repeat a doc_id are written each;
    null ids come first. Extra columns are not read. An empty table gives no
    file and an empty result.
    """
    spark: SparkSession = documents.sparkSession
    folder = folder or scratch(spark, "token-data")
    tokens = written(tokenize(documents, tokenizer_path), "tokens")
    table = frequencies(tokens)
    blocks = written(write(tokens, table, folder), "token-index")
    return read(blocks, table.to_bytes())
