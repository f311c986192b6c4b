"""Token ids in binary shard files, as zstandard-compressed planes.

A shard holds the ids of consecutive documents in ascending order of their ids::

    magic
    chunk 0, chunk 1, ...      a chunk is PLANES planes of one block of ids, each compressed
    index                      zstandard of: chunk table, document table
    length of the index (8 bytes, little-endian), magic

A block of BLOCK ids (unsigned 32-bit) is transposed: byte planes put the first bytes of
all ids together, then the second, and so on; bit planes do so bit by bit. The chunk
table gives for each chunk its offset, its number of ids and the length of each plane,
so that a reader can fetch one chunk alone. Tasks write shards under names of their own
and return a manifest row; a shard of a task that failed is in no manifest.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from spindrift.session import bound_batches, new_shared_path, open_store, written

MAGIC = b"SDTOKEN1"
BLOCK = 1 << 16
_MANIFEST = "shard int, path string, n_docs long, n_ids long"


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, least significant first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(bits[:, k]), bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The block that :func:`to_planes` gave these planes of."""
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if len(rows) == 4:
        return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard to an open binary stream, some documents at a time."""

    def __init__(self, stream, kind: str = "byte", block: int = BLOCK, level: int = 3):
        self.stream, self.kind, self.block = stream, kind, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = stream.write(MAGIC)
        self.pending: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.chunks: list[tuple] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents, all their ids, and how many each has."""
        self.doc_ids += doc_ids
        self.lengths += lengths.tolist()
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            rest = np.concatenate(self.pending)
            while len(rest) >= self.block:
                self._chunk(rest[: self.block])
                rest = rest[self.block :]
            self.pending, self.waiting = [rest], len(rest)

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.chunks.append((self.at, len(ids), *map(len, planes)))
        self.at += self.stream.write(b"".join(planes))

    def close(self) -> None:
        if self.waiting:
            self._chunk(np.concatenate(self.pending))
        planes = 4 if self.kind == "byte" else 32
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        parts = (
            struct.pack("<QQQ", planes, len(self.chunks), len(self.doc_ids)),
            np.array(self.chunks, "<u8").tobytes(),
            np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
            known.tobytes(),
            np.array(self.lengths, "<u8").tobytes(),
        )
        index = self.zip.compress(b"".join(parts))
        self.stream.write(index + struct.pack("<Q", len(index)) + MAGIC)


class ShardReader:
    """Reads a shard: its tables at once, its chunks one by one."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        end = stream.tell()
        stream.seek(end - 16)
        tail = stream.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard, or a cut one")
        (length,) = struct.unpack("<Q", tail[:8])
        stream.seek(end - 16 - length)
        raw = zstandard.ZstdDecompressor().decompress(stream.read(length))
        self.planes, n_chunks, n_docs = struct.unpack_from("<QQQ", raw)
        at = 24
        width = 2 + self.planes
        self.chunks = np.frombuffer(raw, "<u8", n_chunks * width, at).reshape(n_chunks, width)
        at += 8 * n_chunks * width
        ids = np.frombuffer(raw, "<i8", n_docs, at)
        known = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.lengths = np.frombuffer(raw, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = (int(x) for x in self.chunks[k])
        self.stream.seek(at)
        raw, unzip, planes = self.stream.read(sum(sizes)), zstandard.ZstdDecompressor(), []
        for size in sizes:
            planes.append(unzip.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids, in order."""
        have, k = np.empty(0, "<u4"), 0
        for doc_id, n in zip(self.doc_ids, self.lengths):
            parts = [have]
            size = len(have)
            while size < n:
                parts.append(self.chunk(k))
                size += len(parts[-1])
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield doc_id, have[:n]
            have = have[n:]


#: Pieces that a worker remembers: it forgets those that it has not met among the last so many, or more.
REMEMBERED = 120_000
#: Bytes of text, about, that are cut in one call, and new pieces that the tokenizer gets in one.
PORTION, FRESH = 2 << 20, 4096
_REMEMBERED: dict[str, list[dict[str, bytes]]] = {}
# Texts that are encoded as they are: control characters, white space that is no single space or line end inside.
_AS_IT_IS = r"[\x00-\x09\x0B-\x1F\x7F-\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"
# A letter or digit (of scripts that all versions of Unicode agree on) and an ASCII mark after it.
_BEFORE_MARK = r"([0-9A-Za-zÀ-ÖØ-öø-ɏ])([!-/:-@\[-`{-~])"
_CUT, _END, _WHOLE = "\x00", "\x01", "\x02"


class Encoder:
    """Byte-level BPE of whole texts, each distinct piece encoded once for as long as it is remembered.

    What the tokenizer looks at ends before a space, around a line end, and between a letter
    or digit and a mark after it; a text may be cut there. The new pieces of a call are
    encoded as one text, a line for each. A text with white space of another kind, or with one of the
    vocabulary's added tokens, is encoded as it is.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.as_it_is = "|".join([_AS_IT_IS, *added])
        self.newline = self._ids("\n")
        if len(self.newline) != 1:
            raise ValueError("the vocabulary must have one id for a line end")
        self.fixed = {"": b"", "\n": self.newline.tobytes(), _END: np.zeros(1, "<u4").tobytes()}
        self.known = _REMEMBERED.setdefault(vocabulary, [{}, {}])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _pieces(self, pieces: list[str], own: dict[str, bytes]) -> list[bytes]:
        """The ids of distinct pieces; ``own``: of those that are not to be looked up."""
        new, old = self.known
        out = list(map(new.get, pieces))
        fresh = []
        for i in [i for i, x in enumerate(out) if x is None]:
            p = pieces[i]
            if (found := own.get(p)) is not None:
                out[i] = found
            elif (found := old.get(p)) is not None:
                out[i] = new[p] = found
            else:
                fresh.append(i)
        for lo in range(0, len(fresh), FRESH):
            some = fresh[lo : lo + FRESH]
            names = [pieces[i] for i in some]
            ids = self._ids("\n" + "\n".join(names))
            at = np.append(np.flatnonzero(ids == self.newline[0]), len(ids))
            raw, at = ids.tobytes(), (4 * at).tolist()
            found = [raw[i + 4 : j] for i, j in zip(at, at[1:])]
            new.update(zip(names, found, strict=True))
            for i, x in zip(some, found):
                out[i] = x
        if len(new) > REMEMBERED:
            self.known[:] = {}, new
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, the end id after each, and how many each text has."""
        texts = texts.cast(pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.as_it_is).to_numpy(zero_copy_only=False))
        own = self.fixed | {f"{_WHOLE}{i}": self._ids(texts[i].as_py()).tobytes() for i in odd.tolist()}
        cut = pc.replace_substring_regex(texts, _BEFORE_MARK, f"\\1{_CUT}\\2")
        cut = pc.replace_substring(pc.replace_substring(cut, " ", f"{_CUT} "), "\n", f"{_CUT}\n{_CUT}")
        if len(odd):
            names = pa.array([f"{_WHOLE}{i}" for i in odd.tolist()], pa.large_string())
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            cut = pc.replace_with_mask(cut, pa.array(mask), names)
        lists = pc.split_pattern(pc.binary_join_element_wise(cut, pa.scalar(_END, pa.large_string()), pa.scalar(_CUT, pa.large_string())), _CUT)
        coded = lists.flatten().dictionary_encode()
        found = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), own)
        table, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        stop = np.cumsum(n)
        start = (np.cumsum(sizes) - sizes)[codes]
        ids = table[np.repeat(start - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
        offsets = lists.offsets.to_numpy()
        before = np.append(0, stop)[offsets - offsets[0]]
        return ids, np.diff(before)


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about PORTION bytes."""
    stop = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = done = 0
    while lo < len(stop):
        hi = max(lo + 1, int(np.searchsorted(stop, done + PORTION, side="right")))
        yield lo, hi
        lo, done = hi, int(stop[hi - 1])


def write_tokens(
    docs: DataFrame, vocabulary: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", kind: str = "byte", block: int = BLOCK
) -> DataFrame:
    """Encode every whole text, append id 0, and write shards in ascending order of ``id_col``.

    Returns the manifest ``shard, path, n_docs, n_ids, start``: the shards in order, with the
    number of ids before each. Null texts are empty texts (one id, the end); null ids come
    first; rows with the same id are ordered by text. An empty table gives no shards.
    Other columns are not read. ``vocabulary`` is the path of a tokenizer file that all
    executors can read; ``folder`` is by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or new_shared_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        shard, writer = TaskContext.get().partitionId(), None
        store, root = open_store(folder)
        path = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.tok"
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in _portions(texts):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(f"{root}/{path}")
                    writer = ShardWriter(stream, kind, block)
                writer.add(ids[lo:hi], *encode(texts[lo:hi]))
        if writer is not None:
            writer.close()
            stream.close()
            row = [[shard], [f"{folder}/{path}"], [len(writer.doc_ids)], [writer.n_ids]]
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=["shard", "path", "n_docs", "n_ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(ordered.mapInArrow(write, _MANIFEST), "op3-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of the shards: ``doc_id, start, n_tokens, ids_crc32`` and, ``with_ids``, ``ids``.

    ``start`` counts the ids of all documents before this one, ``n_tokens`` includes the end id.
    All ids are read and summed up in any case. A task holds one shard's tables and one document's ids at a time.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as stream:
                    start, rows, held = row["start"], [], 0
                    for doc_id, ids in ShardReader(stream).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), ids.view(np.int32) if with_ids else None))
                        start, held = start + len(ids), held + (len(ids) if with_ids else 16)
                        if held > 1 << 20:
                            yield _rows(rows, with_ids)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows, with_ids)

    return manifest.select("path", "start").repartition("path").mapInArrow(read, schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
    if not with_ids:
        return pa.RecordBatch.from_arrays(cols, names=names)
    flat = pa.array(np.concatenate([r[4] for r in rows]), pa.int32())
    ends = np.concatenate(([0], np.cumsum([len(r[4]) for r in rows])))
    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
    return pa.RecordBatch.from_arrays(cols, names=[*names, "ids"])


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoded(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True, **options) -> DataFrame:
    """Write the files and read them back: one row per row of ``docs`` (see :func:`read_tokens`).

    Null texts have one id, the end; a null id comes first; repeated rows come back repeated, ordered by
    text where ids are equal; an empty table gives no rows; other columns are not read.
    """
    return read_tokens(write_tokens(docs, vocabulary or vocabulary_path(), **options), with_ids)
