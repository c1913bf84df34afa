"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, the lowest first. Level k of a file
holds the k-th chunks of all ids that have one, and a bitmap that tells for each
whether the id goes on; a directory of ranks (set bits before each 512) finds
its place in the next level. Any token of a file is read by one byte and one
rank per level, no block is decoded.

Texts are dealt to files in ascending order of doc_id. They are cut at single
spaces and before single newlines between other characters, where the tokenizer
always starts a new word. Of a batch only the different words are looked up, and
each that is new is encoded by the tokenizers library once per cache.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicspark.llm.binary_files import read_files, write_files
from topicspark.llm.common import row_slices, shared_path, small_batches, written

#: Tokens of a file (a longer document has a file of its own); words a worker remembers; the id after each document.
FILE_TOKENS, CACHE_WORDS, END_ID = 4 << 20, 700_000, 0
RANK_BITS = 512
#: Texts encoded at a time; the more, the more of their words repeat.
SLICE_ROWS = 1024
MAGIC = b"DAC\x01"
VOCABULARY = "byte_bpe_50k.json"

_HEAD = struct.Struct("<iiqqB")  # partition, file in it, documents, tokens, levels; before MAGIC
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_CUT = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n\S))")


# --- directly addressable codes ------------------------------------------------

def pack(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """Levels (chunks, continuation bitmap, rank directory) of ``ids`` (unsigned 32 bits)."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest > 0xFF
        words = -(-len(rest) // RANK_BITS)
        bits = np.zeros(words * RANK_BITS, bool)
        bits[:len(rest)] = more
        ranks = np.zeros(words, np.uint32)
        np.cumsum(bits.reshape(words, RANK_BITS).sum(axis=1)[:-1], out=ranks[1:])
        levels.append(((rest & 0xFF).astype(np.uint8).tobytes(), np.packbits(bits, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()))
        rest = rest[more] >> 8
    return levels


class TokenFile:
    """A file's documents, and its tokens by position."""

    def __init__(self, data: bytes):
        if data[-4:] != MAGIC:
            raise ValueError("not a token file")
        end = len(data) - 4
        self.partition, self.number, self.n_docs, self.n_tokens, n_levels = _HEAD.unpack(data[end - _HEAD.size:end])
        sizes = np.frombuffer(data, "<i8", 3 * n_levels, end - _HEAD.size - 24 * n_levels).reshape(n_levels, 3)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, 0)
        self.no_id = np.frombuffer(data, np.uint8, self.n_docs, 8 * self.n_docs) > 0
        self.bounds = np.frombuffer(data, "<i8", self.n_docs + 1, 9 * self.n_docs)
        at, self.levels = 17 * self.n_docs + 8, []
        for row in sizes.tolist():
            parts = []
            for dtype, size in zip((np.uint8, np.uint8, "<u4"), row):
                parts.append(np.frombuffer(data, dtype, size // np.dtype(dtype).itemsize, at))
                at += size
            self.levels.append(parts)

    def token(self, i: int) -> int:
        """The token at position ``i`` of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = shift = 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_BITS * (RANK_BITS // 8)
            before = np.unpackbits(bits[first:(i >> 3) + 1], bitorder="little", count=i % RANK_BITS) if i % RANK_BITS else ()
            i, shift = int(ranks[i // RANK_BITS]) + int(np.sum(before)), shift + 8
        return out

    def tokens(self) -> np.ndarray:
        """All tokens of the file."""
        out = np.zeros(self.n_tokens, np.uint32)
        at = np.arange(self.n_tokens)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)]
        return out


def file_bytes(partition: int, number: int, doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """A file but for its last four bytes, the magic number."""
    levels = pack(ids)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    none = np.array([d is None for d in doc_ids], np.uint8)
    bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype("<i8")
    sizes = np.array([[len(x) for x in level] for level in levels], "<i8")
    return b"".join([known.tobytes(), none.tobytes(), bounds.tobytes(), *(x for level in levels for x in level),
                     sizes.tobytes(), _HEAD.pack(partition, number, len(doc_ids), len(ids), len(levels))])


# --- texts to ids --------------------------------------------------------------

def words_of(text: str) -> list[str]:
    """``text`` cut at the single spaces, and before the single newlines, that
    stand between two characters other than white space; the spaces are left
    out. The pre-tokenizer never joins what such a place separates: it puts the
    space to the word after it, and leaves the newline alone."""
    return _CUT.split(text) if _uneven(text) else text.replace("\n", " \n").split(" ")


def _uneven(text: str) -> bool:
    """Whether white space other than single spaces and newlines between other characters stands in ``text``."""
    return ("  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[:1].isspace() or text[-1:].isspace() or any(c in text for c in _BLANKS))


class Encoder:
    """Ids of whole texts; remembers up to ``CACHE_WORDS`` different words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.place: dict[str, int] = {}  # a word's place in ``start`` and ``size``
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0  # the ids of all words, one after the other
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a character of a byte-level token stands for a byte; added tokens are plain ASCII
            self.bytes[i] = len(token)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, at: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put ``ids`` of words with ``sizes`` ids each at the places from ``at`` on."""
        end, last = self.used + len(ids), at + len(sizes)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(2 * end - self.used, np.uint32)])
        if last > len(self.start):
            self.start, self.size = (np.concatenate([x[:at], np.zeros(2 * last - at, np.int64)]) for x in (self.start, self.size))
        self.pool[self.used:end] = ids
        self.size[at:last] = sizes
        self.start[at:last] = self.used + np.cumsum(sizes) - sizes
        self.used = end

    def _learn(self, words: list[str]) -> None:
        """Encode different words, many in one text: byte lengths of the tokens tell where each ends."""
        ends = [w for w in words if w[-1:].isspace()]  # the last word of a text; its white space must stay last
        if ends:
            found = self._plain([w if w[:1] == "\n" else " " + w for w in ends])
            self._add(len(self.place), np.array([i for ids in found for i in ids], np.uint32), np.array(list(map(len, found)), np.int64))
            self.place.update(zip(ends, range(len(self.place), len(self.place) + len(ends))))
        words = [w for w in words if not w[-1:].isspace()]
        parts = [words[s:s + 512] for s in range(0, len(words), 512)]
        for s in range(0, len(parts), 64):
            own = parts[s:s + 64]
            units = [[w if w[:1] == "\n" else " " + w for w in p] for p in own]
            for p, u, ids in zip(own, units, self._plain(["".join(u) for u in units])):
                ids = np.array(ids, np.uint32)
                ends_at = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(x.encode()) for x in u]), side="right")
                self._add(len(self.place), ids, np.diff(ends_at, prepend=0))
                self.place.update(zip(p, range(len(self.place), len(self.place) + len(p))))

    def _forget(self, keep: int) -> None:
        """Keep the words met first, mostly the frequent ones."""
        self.place = dict(islice(self.place.items(), keep))
        self.used = int(self.start[keep])

    def _words(self, cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that ``cut`` holds as words, and the bounds of each text's ids."""
        rows = np.asarray(cut.offsets).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        at, words = np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        inner = np.ones(len(at), bool)
        inner[rows[:-1] - rows[0]] = False  # the first word of a text has no space before it and is done on its own
        asked = np.zeros(len(words), bool)
        asked[at[inner]] = True
        if len(self.place) > CACHE_WORDS:
            self._forget(CACHE_WORDS // 2)
        known = self.place.get
        place = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(asked & (place < 0))
        if len(new):
            self._learn([words[i] for i in new.tolist()])
            place[new] = [self.place[words[i]] for i in new.tolist()]
        each = place[at]
        firsts, which = np.unique(at[~inner], return_inverse=True)
        found = self._plain([words[i] for i in firsts.tolist()])
        used, base = self.used, len(self.place)
        self._add(base, np.array([i for ids in found for i in ids], np.uint32), np.array(list(map(len, found)), np.int64))
        each[~inner] = base + which
        sizes = self.size[each]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.start[each] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.used = used  # first words are not kept
        return ids, np.concatenate([[0], ends])[rows - rows[0]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts, one text after the other, and the bounds of each; null is empty."""
        rows = [t or "" for t in texts.to_pylist()]
        uneven = np.fromiter(map(_uneven, rows), bool, len(rows))
        even = pa.array([t.replace("\n", " \n") for t, u in zip(rows, uneven) if not u], pa.large_string())
        parts = [self._words(pc.split_pattern(even, " "))]
        if uneven.any():
            parts.append(self._words(pa.array([_CUT.split(t) for t, u in zip(rows, uneven) if u], pa.large_list(pa.large_string()))))
        if len(parts) == 1:
            return parts[0]
        counts = np.zeros(len(rows), np.int64)
        for (_, bounds), own in zip(parts, (~uneven, uneven)):
            counts[own] = np.diff(bounds)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(bounds[-1], np.uint32)
        row = np.repeat(uneven, counts)
        ids[~row], ids[row] = parts[0][0], parts[1][0]
        return ids, bounds


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- files ---------------------------------------------------------------------

def _files(path: str, end_id: int):
    end = np.array([end_id], np.uint32)

    def run(batches):
        encoder, partition, number = _encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, counts, parts, total = [], [], [], 0

        def closed():
            data = file_bytes(partition, number, doc_ids, counts, np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["file"])

        for part in row_slices(batches, SLICE_ROWS):
            ids, bounds = encoder.encode(part.column("text"))
            for doc_id, s, e in zip(part.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                n = e - s + 1
                if doc_ids and total + n > FILE_TOKENS:
                    yield closed()
                    number, doc_ids, counts, parts, total = number + 1, [], [], [], 0
                doc_ids.append(doc_id)
                counts.append(n)
                parts += ids[s:e], end
                total += n
        if doc_ids:
            yield closed()
    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every whole text of ``docs`` <doc_id bigint, text> to
    files under ``path``, documents in ascending order of doc_id (null first;
    rows that repeat a doc_id by text), each followed by ``end_id``.

    Null text counts as empty. An empty table writes no file.
    """
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write_files(dealt.mapInArrow(_files(vocabulary, end_id), "file binary"), "file", MAGIC, path)


def _entries(batches):
    names = ["partition", "number", "doc_id", "local_start", "n_tokens", "ids_crc32"]
    for b in batches:
        for content in b.column("content"):
            f = TokenFile(content.as_py())
            ids = f.tokens().astype("<u4").tobytes()
            bounds = f.bounds.tolist()
            crc = [zlib.crc32(ids[4 * s:4 * e]) for s, e in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(f.n_docs, f.partition), pa.int32()), pa.array(np.full(f.n_docs, f.number), pa.int32()),
                pa.array(f.doc_ids, pa.int64(), mask=f.no_id), pa.array(f.bounds[:-1], pa.int64()),
                pa.array(np.diff(f.bounds), pa.int64()), pa.array(crc, pa.int64())], names)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """<doc_id, start, n_tokens, ids_crc32> of the documents in the files under
    ``path``; ``start`` counts the ids of all documents before."""
    rows = written(read_files(spark, path).mapInArrow(
        _entries, "partition int, number int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"), "documents")
    files = rows.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    in_part = Window.partitionBy("partition").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("in_part", F.coalesce(F.sum("n").over(in_part), F.lit(0)))
    # one row for each writing task
    parts = files.groupBy("partition").agg(F.sum("n").alias("n"))
    parts = parts.select("partition", F.coalesce(F.sum("n").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    places = files.join(parts, "partition").select("partition", "number", (F.col("before") + F.col("in_part")).alias("first"))
    return rows.join(places, ["partition", "number"]).select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _find(wanted: list[int]):
    ids = np.array(sorted(wanted), np.int64)

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                f = TokenFile(content.as_py())
                for i in np.flatnonzero(np.isin(f.doc_ids, ids) & ~f.no_id):
                    s, e = int(f.bounds[i]), int(f.bounds[i + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([int(f.doc_ids[i])], pa.int64()), pa.array([[f.token(k) for k in range(s, e)]], pa.list_(pa.int64()))], ["doc_id", "ids"])
    return run


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """<doc_id, ids> of a few documents, read by random access."""
    return read_files(spark, path).mapInArrow(_find(doc_ids), "doc_id bigint, ids array<bigint>")


def token_documents(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Write the token files (under ``path``, or a new path in the shared
    folder) and read them back: a row for each row of ``docs``."""
    path = path or shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary)
    return read_documents(docs.sparkSession, path)
