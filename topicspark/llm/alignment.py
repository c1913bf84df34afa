"""Alignment of two tokenizers over the same texts, with corpus-wide pair counts.

The tokens of both sides cover the same bytes: places where both end cut a text
into groups, and tokens whose bytes overlap are linked. How often two ids are
linked in the whole corpus is counted outside memory:

* Tasks write the links as (pair, document, times) records to sorted runs of
  zstd pages. A run holds the pairs of one radix of side B's ids, side B first.
* Runs are merged: a heap of the open pages' last keys tells up to where all
  runs are read, and what lies before that is counted. Counts of merges add up
  to the corpus-wide ones, and the highest of each B id follows from them.
* Runs are dealt into bins of bounded size (a radix with many records has many
  bins) and merged once more beside the counts in the same order; what each
  record contributes to its document streams out.

Both tokenizers begin anew at a single space, and at a newline, between other
characters, so each different stretch between such places is tokenised once per
cache.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import struct
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import row_slices, small_batches, written
from topicspark.llm.token_files import words_of

VOCABULARY_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Radices of side B's ids; links and documents of a flush; records of a page; records of a bin.
RADICES, LINKS, DOCS, PAGE, BIN = 16, 4 << 20, 60_000, 1 << 15, 8 << 20
#: Stretches that a worker remembers within a task; texts aligned at a time.
CACHE_UNITS, SLICE_ROWS = 400_000, 512

#: Bits of an id of side A and of a document within a flush, in a record's key.
_A_BITS, _DOC_BITS, _ROW_BITS = 20, 24, 40
_SPACE = "▁"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: visible
    Latin-1 characters for themselves, from 256 on for the others in turn."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


# --- texts to groups and links ---------------------------------------------------

def _spelling(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, the first of each and their number."""
    size = np.array(list(map(len, tokens)), np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


class Aligner:
    """Groups and links of whole texts; remembers up to ``CACHE_UNITS`` different stretches."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        chars = byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode())
            if not self.b.is_byte(i) and (_SPACE in piece.lstrip(_SPACE) or "\n" in piece):
                raise ValueError("a piece crosses the beginning of a word or a line")
        if self.bytes_b[self.b.encode("\n")[0]] != b" ":
            raise ValueError("the model puts no space before a text")
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << _A_BITS:
            raise ValueError("a vocabulary is too large")
        #: side B's ids are renumbered so that those of a radix follow each other
        self.width = -(-len(self.bytes_b) // RADICES)
        self.table_a, self.table_b = _spelling(self.bytes_a), _spelling(self.bytes_b)
        #: each id with the sign after it: within a group, and at the end of A's or B's part of one
        self.signs = [f"{i}{c}" for n, last in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")) for c in (",", last) for i in range(n)]
        self.sign_sizes = np.array(list(map(len, self.signs)), np.int64)
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.size = np.zeros((1 << 12, 4), np.int64)  # tokens of A and of B, groups, links
        self.same, self.start = np.zeros(1 << 12, bool), np.zeros(1 << 12, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint64), 0

    def side(self, b: int) -> int:
        return b % RADICES * self.width + b // RADICES

    def tokens(self, units: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides of stretches that begin with a space, or with a newline inside a text."""
        ours = self.a.encode_batch_fast(units, add_special_tokens=False)
        theirs = self.b.encode([u[1:] if u[:1] == " " else u for u in units], num_threads=1)
        for u, a, b in zip(units, ours, theirs):
            yield a.ids, b if u[:1] == " " else b[1:]  # the model's own space before a newline is not the text's

    def aligned(self, unit: str, a: list[int], b: list[int]) -> tuple[str, int, list[int]] | None:
        """Groups, their number and the links of one stretch; None if a side's bytes differ from it."""
        own_a, own_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        data = unit.encode()
        if b"".join(own_a) != data or b"".join(own_b) != data:
            return None
        ends_a, ends_b = list(accumulate(map(len, own_a))), list(accumulate(map(len, own_b)))
        links, groups, i, j, first_i, first_j = [], [], 0, 0, 0, 0
        while i < len(a):
            links.append(self.side(b[j]) << _A_BITS | a[i])
            d = ends_a[i] - ends_b[j]
            i += d <= 0
            j += d >= 0
            if d == 0:
                groups.append(f"{','.join(map(str, a[first_i:i]))}|{','.join(map(str, b[first_j:j]))}")
                first_i, first_j = i, j
        return ";".join(groups), len(groups), links

    def _one_by_one(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups, sizes (groups -1 where a side's bytes differ) and links of all units."""
        groups, sizes, links = [], [], []
        for u, (a, b) in zip(units, self.tokens(units)):
            found = self.aligned(u, a, b)
            own, n, pairs = found or ("", 0, [])
            groups.append(own)
            sizes.append((len(a), len(b), n, len(pairs)) if found else (0, 0, -1, 0))
            links += pairs
        return groups, np.array(sizes, np.int64).reshape(-1, 4), np.array(links, np.uint64)

    def _in_one_text(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """The same of units that don't end in white space, joined to one text;
        None if the tokens don't spell it, or one crosses the end of a unit."""
        text = "".join([" x", *units])  # the stretch before them begins with the space that the model adds
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = np.cumsum([2, *(len(u.encode()) for u in units)])
        sides = []
        for ids, (spelled, first, size) in ((self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.table_a), (self.b.encode(text[1:]), self.table_b)):
            ids = np.array(ids, np.int64)
            n = size[ids]
            ends = np.cumsum(n)
            if ends[-1] != len(data) or (spelled[np.repeat(first[ids] - (ends - n), n) + np.arange(len(data))] != data).any():
                return None
            if (ends[np.searchsorted(ends, cuts)] != cuts).any():
                return None
            skip = np.searchsorted(ends, 2, side="right")
            sides.append((ids[skip:], ends[skip:]))
        (a, ends_a), (b, ends_b) = sides
        # links: the B tokens from the one that holds a token's first byte to the one that holds its last
        lo = np.searchsorted(ends_b, np.concatenate([[2], ends_a[:-1]]), side="right")
        n = np.searchsorted(ends_b, ends_a) - lo + 1
        own_b = b[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        links = (own_b % RADICES * self.width + own_b // RADICES) << _A_BITS | np.repeat(a, n)
        both = ends_a[np.isin(ends_a, ends_b)]
        last_a, last_b = np.isin(ends_a, both), np.isin(ends_b, both)
        # text of the groups: of each, A's tokens and then B's, each with the sign after it
        order = np.argsort(np.concatenate([2 * np.searchsorted(both, ends_a), 2 * np.searchsorted(both, ends_b) + 1]), kind="stable")
        sign = np.concatenate([a + last_a * len(self.bytes_a), b + last_b * len(self.bytes_b) + 2 * len(self.bytes_a)])[order]
        whole = "".join([self.signs[i] for i in sign.tolist()])
        long = np.cumsum(self.sign_sizes[sign])
        at = [np.searchsorted(e, cuts, side="right") for e in (ends_a, ends_b, both)]
        text_ends = [0, *long[at[0][1:] + at[1][1:] - 1].tolist()]
        links_before = np.concatenate([[0], np.cumsum(n)])[at[0]]
        sizes = np.stack([np.diff(x) for x in (*at, links_before)], axis=1)
        return [whole[s:e - 1] for s, e in zip(text_ends, text_ends[1:])], sizes, links.astype(np.uint64)

    def _learn(self, keys: list[str]) -> None:
        plain, blank = [], []
        for k in keys:
            (blank if k[-1:].isspace() else plain).append(k)
        for own, joint in [(plain[s:s + 512], True) for s in range(0, len(plain), 512)] + [(blank, False)]:
            if own:
                units = [k if k[:1] in (" ", "\n") else " " + k for k in own]
                self._add(own, *(joint and self._in_one_text(units) or self._one_by_one(units)))

    def _add(self, keys: list[str], groups: list[str], sizes: np.ndarray, links: np.ndarray) -> None:
        at, end = len(self.place), self.used + len(links)
        last = at + len(keys)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(2 * end - self.used, np.uint64)])
        if last > len(self.start):
            self.start, self.same = np.resize(self.start, 2 * last), np.resize(self.same, 2 * last)
            self.size = np.resize(self.size, (2 * last, 4))
        self.pool[self.used:end] = links
        self.size[at:last], self.same[at:last] = sizes, sizes[:, 2] >= 0
        self.start[at:last] = self.used + np.cumsum(sizes[:, 3]) - sizes[:, 3]
        self.used = end
        self.groups += groups
        self.place.update(zip(keys, range(at, last)))

    def forget(self, keep: int) -> None:
        """Keep the stretches met first, mostly the frequent ones."""
        if keep < len(self.place):
            self.place = dict(islice(self.place.items(), keep))
            self.used = int(self.start[keep])
            del self.groups[keep:]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Tokens of A and B, groups and links of each text, the digest of its
        groups, and for all links the pair and the text's number."""
        flat, count = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                words = words_of(t)
                words[0] = " " + words[0]
                flat += words
                count[k] = len(words)
        sizes, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        if not flat:
            return sizes, digests, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        if len(self.place) > CACHE_UNITS:
            self.forget(CACHE_UNITS // 2)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.place.get
        place = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            own = [words[i] for i in new.tolist()]
            self._learn(own)
            place[new] = [self.place[w] for w in own]
        each, doc = place[np.asarray(coded.indices)], np.repeat(np.arange(len(texts)), count)
        good = (count > 0) & (np.bincount(doc, ~self.same[each], minlength=len(texts)) == 0)
        inside = good[doc]
        each, doc = each[inside], doc[inside]
        for c in range(4):
            sizes[:, c] = np.bincount(doc, self.size[each, c], minlength=len(texts)).astype(np.int64)
        groups, at = [self.groups[i] for i in each.tolist()], 0
        for k in np.flatnonzero(good).tolist():
            digests[k] = hashlib.sha256(";".join(groups[at:at + count[k]]).encode()).hexdigest()
            at += count[k]
        n = self.size[each, 3]
        ends = np.cumsum(n)
        links = self.pool[np.repeat(self.start[each] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return sizes, digests, links, np.repeat(doc, n)


@functools.cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# --- runs ------------------------------------------------------------------------

_HEAD = struct.Struct("<IIBB")


def _least(x: np.ndarray) -> np.ndarray:
    return x.astype(f"<u{next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)}")


def page(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Records in order of pair as one zstd frame: each different pair (as the
    step from the one before) with its number of records, then documents and times."""
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    doc, times = _least(doc), _least(times)
    body = [np.diff(pair[first], prepend=np.uint64(0)).astype("<u8").tobytes(), np.diff(first, append=len(pair)).astype("<u4").tobytes(), doc.tobytes(), times.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(_HEAD.pack(len(pair), len(first), doc.itemsize, times.itemsize) + b"".join(body))


def records(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, document and times of a page's records."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n, pairs, doc_size, times_size = _HEAD.unpack_from(data)
    at, out = _HEAD.size, []
    for dtype, size in (("<u8", pairs), ("<u4", pairs), (f"<u{doc_size}", n), (f"<u{times_size}", n)):
        out.append(np.frombuffer(data, dtype, size, at))
        at += out[-1].nbytes
    return np.repeat(np.cumsum(out[0], dtype=np.uint64), out[1]), out[2].astype(np.int64), out[3].astype(np.int64)


def runs(keys: np.ndarray, width: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Radix, records and pages of each run of a flush; ``keys`` are its links as pair and document."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times, keys = np.diff(first, append=len(keys)), keys[first]
    pair, doc = keys >> np.uint64(_DOC_BITS), keys & np.uint64((1 << _DOC_BITS) - 1)
    bounds = np.searchsorted(pair >> np.uint64(_A_BITS), np.arange(RADICES + 1, dtype=np.uint64) * np.uint64(width)).tolist()
    for r, (s, e) in enumerate(zip(bounds, bounds[1:])):
        if s < e:
            yield r, e - s, [page(*(x[p:min(e, p + PAGE)] for x in (pair, doc, times))) for p in range(s, e, PAGE)]


def merged(own: list[tuple[int, list[bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pair, row and times of the records of all runs (the row of the first
    document, and pages), in pieces: no pair of a piece is less than one of the
    piece before. Of each run one page is open."""
    pages = [iter(p) for _, p in own]
    open_: dict[int, tuple[np.ndarray, ...]] = {}
    heap: list[tuple[int, int]] = []

    def turn(i: int) -> None:
        data = next(pages[i], None)
        if data is None:
            open_.pop(i, None)
            return
        pair, doc, times = records(data)
        open_[i] = pair, own[i][0] + doc, times
        heapq.heappush(heap, (int(pair[-1]), i))

    for i in range(len(own)):
        turn(i)
    while heap:
        # up to the least last pair of the open pages, all runs are known
        limit, parts = np.uint64(heap[0][0]), []
        for i in list(open_):
            k = int(np.searchsorted(open_[i][0], limit, side="right"))
            if k:
                parts.append(tuple(x[:k] for x in open_[i]))
                open_[i] = tuple(x[k:] for x in open_[i])
        done = []  # a run's next page may end at the same pair; it is for the next piece
        while heap and heap[0][0] <= limit:
            done.append(heapq.heappop(heap)[1])
        for i in done:
            turn(i)
        yield tuple(np.concatenate(x) for x in zip(*parts))


# --- over tables -----------------------------------------------------------------

_MADE = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
         "radix int, records bigint, pages array<binary>")
_MADE_NAMES = [c.split()[0] for c in _MADE.split(", ")]


def _documents_and_runs(path_a: str, path_b: str):
    def run(batches):
        aligner, first = _aligner(path_a, path_b), TaskContext.get().partitionId() << _ROW_BITS
        n = base = held = 0
        keys: list[np.ndarray] = []

        def flushed():
            for radix, size, pages in runs(np.concatenate(keys), aligner.width):
                none = [pa.nulls(1, t) for t in (*[pa.int64()] * 5, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([first + base], pa.int64()), *none, pa.array([radix], pa.int32()),
                                                  pa.array([size], pa.int64()), pa.array([pages], pa.list_(pa.binary()))], _MADE_NAMES)

        for part in row_slices(batches, SLICE_ROWS):
            sizes, digests, links, doc = aligner.align(part.column("text").to_pylist())
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + n, first + n + rows), pa.int64()), part.column("doc_id"), *(pa.array(sizes[:, c]) for c in range(4)),
                                              pa.array(digests, pa.string()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.list_(pa.binary()))], _MADE_NAMES)
            if len(links):
                keys.append(links << np.uint64(_DOC_BITS) | (doc + (n - base)).astype(np.uint64))
                held += len(links)
            n += rows
            if held > LINKS or n - base > DOCS:
                if keys:
                    yield from flushed()
                keys, held, base = [], 0, n
        if keys:
            yield from flushed()
        aligner.forget(CACHE_UNITS // 2)  # the worker lives on
    return run


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], *(np.add.reduceat(v[order], first) for v in values)


def _counts(batches):
    """Times of each pair, added up over the runs of a task."""
    own: dict[int, list] = {}
    for b in batches:
        for radix, row, pages in zip(*(b.column(c).to_pylist() for c in ("radix", "row", "pages"))):
            own.setdefault(radix, []).append((row, pages))
    for _, those in sorted(own.items()):
        for pair, _, times in merged(those):
            key, n = _summed(pair.astype(np.int64), times)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])


class _Bin:
    """The records of a bin, met by the counts in their order."""

    def __init__(self, own: list[tuple[int, list[bytes]]]):
        self.pieces, self.open = merged(own), None
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def meet(self, pair: np.ndarray, count: np.ndarray, best: np.ndarray) -> None:
        while True:
            if self.open is None:
                self.open = next(self.pieces, None)
                if self.open is None:
                    return
            own, row, times = self.open
            own = own.astype(np.int64)
            now = own <= pair[-1]
            if now.any():
                at = np.searchsorted(pair, own[now])
                self.found.append((row[now], times[now] * best[at], times[now] * count[at]))
                self.held += len(at)
                if self.held > 1 << 20:
                    self.found = [_summed(*map(np.concatenate, zip(*self.found)))]
                    self.held = len(self.found[0][0])
            if not now.all():
                self.open = tuple(x[~now] for x in self.open)
                return
            self.open = None

    def contributions(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _summed(*map(np.concatenate, zip(*self.found))))), ["row", "n_best", "count_sum"])


def _contributions(batches):
    """What the records of each bin add to their documents; of a bin the runs come first, then the counts by pair."""
    bin_, runs_, held = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        radix, salt, kind = (np.asarray(b.column(c)) for c in ("radix", "salt", "kind"))
        edges = [0, *(np.flatnonzero((np.diff(radix) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1).tolist(), b.num_rows]
        for s, e in zip(edges, edges[1:]):
            part = b.slice(s, e - s)
            if (radix[s], salt[s]) != bin_:
                if held:
                    yield from held.contributions()
                bin_, runs_, held = (radix[s], salt[s]), [], None
            if kind[s] == 0:
                runs_ += zip(part.column("row").to_pylist(), part.column("pages").to_pylist())
                continue
            if held is None:
                held, runs_ = _Bin(runs_), []
            held.meet(*(np.asarray(part.column(c)) for c in ("pair", "count", "best")))
    if held:
        yield from held.contributions()


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per row of ``docs`` <doc_id bigint, text>: doc_id, n_a, n_b,
    n_groups, n_links, n_best, count_sum, groups_sha256.

    Side A encodes a space and the text, side B the text, to which it adds the
    space; strings of special tokens are plain text. ``n_best`` counts the links
    whose pair is linked as often in the corpus as any of its B id (ties count),
    ``count_sum`` adds up the pairs' counts over all links. Texts that are null
    or empty, or that a side's tokens do not spell byte by byte, have zeros and
    an empty digest, and add to no count. Rows that repeat a doc_id or a text
    count each. No rows: no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    path_a, path_b = path_a or public_path(VOCABULARY_A), path_b or public_path(MODEL_B)
    made = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_documents_and_runs(path_a, path_b), _MADE), "runs")
    own = made.where("radix is not null").select("radix", "row", "records", "pages")

    counts = own.select("radix", "row", "pages").mapInArrow(_counts, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("count"))
    counts = written(counts.withColumn("side", F.shiftright("pair", _A_BITS)), "counts")
    width = -(-_vocabulary_size(path_b) // RADICES)
    tops = counts.groupBy("side").agg(F.max("count").alias("top"))
    counts = counts.join(tops, "side").select(F.expr(f"cast(side div {width} as int)").alias("radix"), "pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))

    # one row for each radix
    bins = F.broadcast(own.groupBy("radix").agg(F.ceil(F.sum("records") / BIN).cast("int").alias("bins")))
    runs_ = own.join(bins, "radix").select("radix", F.pmod(F.xxhash64("row"), F.col("bins")).cast("int").alias("salt"), F.lit(0).alias("kind"),
                                           F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("long").alias("best"), "row", "pages")
    beside = counts.join(bins, "radix").select("radix", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("salt"), F.lit(1).alias("kind"),
                                               "pair", "count", "best", F.lit(None).cast("long").alias("row"), F.lit(None).cast("array<binary>").alias("pages"))
    dealt = runs_.unionByName(beside).repartition("radix", "salt").sortWithinPartitions("radix", "salt", "kind", "pair")
    added = dealt.mapInArrow(_contributions, "row bigint, n_best bigint, count_sum bigint").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    documents = made.where("radix is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    none = F.lit(0).cast("long")
    return documents.join(added, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
                                                       F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def _vocabulary_size(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
