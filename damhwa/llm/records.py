"""Token ids as length-delimited binary records, with an offset index beside each file for shuffled reads.

A file `shard-<n>.rec` is a run of records: length (8 bytes), masked CRC-32C of the length, payload, masked CRC-32C of the
payload, all little-endian. A payload is the document id (8 bytes), a byte of flags (1: no document id; 2: ids take four
bytes, not two) and the ids. `shard-<n>.idx` has offset and length (8 bytes each) of each record, so a reader can take
records in any order. Shards hold ascending ranges of document ids and are ascending within.

Texts are range-partitioned once; each task encodes its range in order and streams records to a file under a name of
its own, renamed when whole, so a repeated task leaves the same file. Files go through a file system chosen by the
folder's URI, and that folder is shared. Words between single spaces or line feeds that recur are encoded once per
worker, in tables bounded by bytes; the tokenizer sees every other one, so ids are those of the whole text.

Edge cases: null text counts as empty (only the end id); null document ids come first; equal ids are ordered by text;
an empty table gives no shard and no row; extra columns are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from damhwa.llm.common import arrow_schema, claim, materialize, to_batch, work_dir

HEAD = "<qB"
NO_ID, WIDE = 1, 2
BLOCK = 1024
#: Of a worker's remembered words, and what one takes besides its characters and ids.
MAX_BYTES, ENTRY_BYTES = 448 << 20, 200
LINES = 500


@cache
def _tables() -> tuple[list[int], np.ndarray, list[list[int]], list[list[int]]]:
    """CRC-32C: by byte; by place in a block and byte; a state moved on by a whole block, by each byte of the state."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ 0x82F63B78, t >> 1).astype(np.uint32)
    move = lambda c: c >> 8 ^ t[c & 255]
    rows = [t]
    for _ in range(BLOCK - 1):
        rows.append(move(rows[-1]))
    on = np.stack([np.arange(256, dtype=np.uint32) << (8 * k) for k in range(4)])
    powers = {}
    for k in range(BLOCK):
        on = move(on)
        powers[k + 1] = on
    return t.tolist(), np.concatenate(rows[::-1]), powers[BLOCK].tolist(), powers


def crc32c(data: bytes) -> int:
    table, places, (a, b, c, d), powers = _tables()
    size, state = len(data), 0xFFFFFFFF
    if size < 64:
        for byte in data:
            state = state >> 8 ^ table[(state ^ byte) & 255]
        return state ^ 0xFFFFFFFF
    base = np.arange(BLOCK, dtype=np.int32) * 256
    first = size % BLOCK
    if first:
        p = powers[first]
        moved = int(p[0][state & 255]) ^ int(p[1][state >> 8 & 255]) ^ int(p[2][state >> 16 & 255]) ^ int(p[3][state >> 24])
        state = moved ^ int(np.bitwise_xor.reduce(places[base[BLOCK - first :] + np.frombuffer(data, np.uint8, first)]))
    for at in range(first, size, 256 * BLOCK):
        part = np.frombuffer(data, np.uint8, min(size - at, 256 * BLOCK), at).reshape(-1, BLOCK)
        for s in np.bitwise_xor.reduce(places[base + part], axis=1).tolist():
            state = a[state & 255] ^ b[state >> 8 & 255] ^ c[state >> 16 & 255] ^ d[state >> 24] ^ s
    return state ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


@lru_cache(50_000)
def _length_head(n: int) -> bytes:
    raw = n.to_bytes(8, "little")
    return raw + masked(crc32c(raw)).to_bytes(4, "little")


def frame(payload: bytes) -> bytes:
    return _length_head(len(payload)) + payload + masked(crc32c(payload)).to_bytes(4, "little")


def unframe(record: bytes) -> bytes:
    """The payload of one framed record; ValueError where a length or checksum is wrong."""
    n = int.from_bytes(record[:8], "little")
    if len(record) != n + 16 or record[:12] != _length_head(n) or masked(crc32c(record[12 : 12 + n])) != int.from_bytes(record[12 + n :], "little"):
        raise ValueError("a record's length or checksum is wrong")
    return record[12 : 12 + n]


#: White space other than single spaces and line feeds between other characters: such a text is encoded whole.
_LOOSE = re.compile(r"[^\S \n]|[ \n](?=\s|\Z)|\A[ \n]")


#: The same for ASCII, by plain searches.
_LOOSE_ASCII = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")


def _loose(t: str) -> bool:
    if t.isascii():
        return t[0] in " \n" or t[-1] in " \n" or any(x in t for x in _LOOSE_ASCII)
    return _LOOSE.search(t) is not None


class Encoder:
    """texts -> ids as packed little-endian bytes, by a byte-level tokenizer file.

    A pre-token of these tokenizers never reaches over a space or line feed that stands alone: the space begins one, the
    line feed is one. Texts are cut there, and words that recur are encoded once: `words` (after a space) and `firsts`
    (at a line's start) keep them in two generations, of MAX_BYTES together.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.set_threshold(200_000, 50, 100)  # its tables hold no garbage in cycles
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.wide = max(self.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = np.array(self.newline, self.dtype).tobytes()
        self.size, self.words, self.firsts, self.old = 0, {}, {}, ({}, {})

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: list[str]) -> list[bytes]:
        """Each word's ids: LINES go at a time as lines of one text, whose line feeds show where a word's ids end."""
        if len(self.newline) != 1:
            return self._raw(words)
        out, width = [], self.dtype.itemsize
        parts = [words[k : k + LINES] for k in range(0, len(words), LINES)]
        for part, raw in zip(parts, self._raw(["\n".join(part) for part in parts])):
            cuts = np.flatnonzero(np.frombuffer(raw, self.dtype) == self.newline[0])
            if len(cuts) == len(part) - 1:
                out += [raw[i:j] for i, j in zip([0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(raw)])]
            else:
                out += self._raw(part)
        return out

    def _learn(self, words: set[str], table: dict, old: dict, before: str) -> None:
        known = words & old.keys()
        table.update(zip(known, map(old.__getitem__, known)))
        new = list(words - known)
        ids = self._lines([before + w for w in new])
        table.update(zip(new, ids))
        self.size += sum(map(len, words)) + sum(map(len, ids)) + ENTRY_BYTES * len(words)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 500):
            part = [t or "" for t in texts[at : at + 500]]
            split = [None if not t or _loose(t) else [line.split(" ") for line in t.split("\n")] for t in part]
            whole = iter(self._raw([t for t, s in zip(part, split) if s is None]))
            if self.size > MAX_BYTES // 2:
                self.size, self.old, self.words, self.firsts = 0, (self.words, self.firsts), {}, {}
            lines = [line for s in split if s for line in s]
            self._learn(set().union(*[line[1:] for line in lines]).difference(self.words), self.words, self.old[0], " ")
            self._learn({line[0] for line in lines}.difference(self.firsts), self.firsts, self.old[1], "")  # not `- keys()`, which walks the table
            word, first = self.words.__getitem__, self.firsts.__getitem__
            for s in split:
                yield (next(whole) if s is None else self.feed.join([first(line[0]) + b"".join(map(word, line[1:])) for line in s])) + self.end


@lru_cache(2)
def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path, end_id)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _publish(files: pafs.FileSystem, temporary: str, final: str) -> None:
    if files.get_file_info(final).type != pafs.FileType.NotFound:
        files.delete_file(final)
    files.move(temporary, final)


SHARDS = "shard int, records long, tokens long, bytes long"


def write_shards(df: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write; one row for each file. The rows stand in the shared folder, so files are written once."""
    ordered = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    schema = arrow_schema(df.sparkSession, SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__, encoder.cache_clear)
        shard, files, own, out = TaskContext.get().partitionId(), None, None, None
        records = tokens = at = 0
        offsets: list[bytes] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files, base = open_fs(folder)
                files.create_dir(base, recursive=True)
                own = f"{base}/shard-{shard:08d}"
                attempt = f"{own}.{uuid.uuid4().hex}"
                out = files.open_output_stream(attempt)
            enc = encoder(path, end_id)
            width = enc.dtype.itemsize
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                record = frame(struct.pack(HEAD, doc or 0, NO_ID * (doc is None) | WIDE * enc.wide) + ids)
                out.write(record)
                offsets.append(struct.pack("<QQ", at, len(record)))
                at += len(record)
                tokens += len(ids) // width
                records += 1
        if out is not None:
            out.close()
            with files.open_output_stream(f"{attempt}.idx") as index:
                index.write(b"".join(offsets))
            _publish(files, f"{attempt}.idx", f"{own}.idx")
            _publish(files, attempt, f"{own}.rec")
            yield to_batch({"shard": [shard], "records": [records], "tokens": [tokens], "bytes": [at]}, schema)

    return materialize(ordered.mapInArrow(run, SHARDS), "record-shards")


def read_index(folder: str, shard: int) -> np.ndarray:
    """(offset, length) of each record of a shard."""
    files, base = open_fs(folder)
    with files.open_input_stream(f"{base}/shard-{shard:08d}.idx") as f:
        return np.frombuffer(f.read(), "<u8").reshape(-1, 2)


def read_records(folder: str, shard: int, order: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of the records of a shard: all as they stand, or those of `order` by offset."""
    files, base = open_fs(folder)
    index = read_index(folder, shard)

    def of(record: bytes) -> tuple[int | None, np.ndarray]:
        payload = unframe(record)
        doc, flags = struct.unpack_from(HEAD, payload)
        return None if flags & NO_ID else doc, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=struct.calcsize(HEAD))

    if order is None:
        with files.open_input_stream(f"{base}/shard-{shard:08d}.rec") as f:
            for size in index[:, 1].tolist():
                yield of(f.read(size))
    else:
        with files.open_input_file(f"{base}/shard-{shard:08d}.rec") as f:
            for k in order.tolist():
                yield of(f.read_at(int(index[k, 1]), int(index[k, 0])))


def read_documents(shards: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; `start` counts the ids of all documents before.

    Only the shards' totals, one row a file, meet in one place.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ddl = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(shards.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: dict[str, list] = {k: [] for k in (id_col, "start", "n_tokens", "ids_crc32")}
                for doc, ids in read_records(folder, shard):
                    for k, v in zip(rows, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        rows[k].append(v)
                    start += len(ids)
                    if len(rows["start"]) == 10_000:
                        yield to_batch(rows, schema)
                        rows = {k: [] for k in rows}
                if rows["start"]:
                    yield to_batch(rows, schema)

    spread = shards.select("shard", before.alias("start")).repartition(max(1, shards.count()), "shard")  # a task a file
    return spread.mapInArrow(run, ddl)


def store_and_read(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    folder = folder or work_dir(df.sparkSession, "records")
    return read_documents(write_shards(df, folder, path, end_id, id_col, text_col), folder, id_col)
