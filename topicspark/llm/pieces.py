"""N-best segmentation of whole texts over a SentencePiece vocabulary, and decoding.

The lattice of a text has an edge for each vocabulary piece at each place; a
path's score is the sum of its pieces' scores. Forward Viterbi gives the best
score of every prefix, which is an exact heuristic for A-star search backward
from the end: the first N paths to reach the beginning are the N best.

No piece crosses the beginning of a run of spaces or a line, so a text's
lattice is a chain of short ones (units). Different units are segmented once per
cache, many at a time: forward and backward Viterbi give each one's best path
and the gap to its second best. Among the N best paths of a text only the N - 1
units of smallest gap can differ from their best path, so A-star runs on those,
and their paths are combined in order of the sum.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import row_slices, small_batches

#: Paths of a text; units that a worker remembers within a task and beyond it, and units whose N best paths it remembers.
N_BEST, CACHE_UNITS, KEEP_UNITS, BEST_UNITS = 4, 400_000, 100_000, 30_000
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_NONE = -1e18
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Units longer than this, and lengths that few units share, are done one by one.
_LONG, _FEW = 48, 24


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Decoder:
    """The bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [b""] * sp.get_piece_size()
        for i in range(len(self.text)):
            if sp.is_byte(i):
                self.text[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()

    def decode(self, ids) -> str:
        """The text of ``ids``: pieces joined, the space before the first word dropped."""
        text = b"".join([self.text[i] for i in ids])
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


class Vocabulary(Decoder):
    """Pieces, scores and byte pieces of a model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        special = {i for i in every if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.ids = {sp.id_to_piece(i): i for i in every if i not in special}
        self.score = np.array([sp.get_score(i) for i in every])
        self.byte = {int(sp.id_to_piece(i)[3:-1], 16): i for i in every if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses the beginning of a word or a line")
        self.unknown = min(self.score[i] for i in self.ids.values()) - 10
        self.longest = max(map(len, self.ids))
        chars = [np.frombuffer(p.encode("utf-32-le"), "<u4") for p in self.ids]
        self.size, self.first_char = np.zeros(len(self.score), np.int64), np.zeros(len(self.score), np.int64)
        own = list(self.ids.values())
        self.size[own] = [len(c) for c in chars]
        self.first_char[own] = np.cumsum(self.size[own]) - self.size[own]
        self.chars = np.concatenate(chars)
        # hashes of all prefixes of pieces, each with its piece or -1, for lookups of many at a time
        prefixes = {p[:k]: -1 for p in self.ids for k in range(1, len(p) + 1)} | self.ids
        keys = np.array([self._hash(p) for p in prefixes], np.uint64)
        order = np.argsort(keys)
        self.keys, self.piece_at = keys[order], np.array(list(prefixes.values()), np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two prefixes share a hash")

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    # --- one unit ---

    def arcs(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """For each end 1..n the arcs (start, piece, score) that end there; piece -1 is a character without a piece."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(unit) + 1)]
        get, score = self.ids.get, self.score
        for s in range(len(unit)):
            for e in range(s + 1, min(len(unit), s + self.longest) + 1):
                i = get(unit[s:e], -1)
                if i >= 0:
                    out[e].append((s, i, float(score[i])))
                elif e == s + 1:
                    out[e].append((s, -1, float(self.unknown)))
        return out

    def spelled(self, unit: str, path: list[tuple[int, int]]) -> list[int]:
        """Ids of a path of (piece, start); a character without a piece becomes its bytes."""
        out = []
        for piece, start in path:
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte[b] for b in unit[start].encode()]
        return out

    def segment(self, unit: str) -> tuple[list[int], float, float]:
        """Ids of the best path, its score, and the gap to the second best path."""
        arcs, n = self.arcs(unit), len(unit)
        ahead, back, last = [0.0] + [_NONE] * n, [_NONE] * n + [0.0], [None] * (n + 1)
        for e in range(1, n + 1):
            for arc in arcs[e]:
                if ahead[arc[0]] + arc[2] > ahead[e]:
                    ahead[e], last[e] = ahead[arc[0]] + arc[2], arc
        path, e = [], n
        while e:
            path.append((last[e][1], last[e][0]))
            e = last[e][0]
        on, second = set(path), _NONE
        for e in range(n, 0, -1):
            for s, i, w in arcs[e]:
                back[s] = max(back[s], w + back[e])
        # an arc is named by its start and piece: a path that uses one off the best path differs from it
        for e in range(1, n + 1):
            for s, i, w in arcs[e]:
                if (i, s) not in on:
                    second = max(second, ahead[s] + w + back[e])
        return self.spelled(unit, path[::-1]), ahead[n], ahead[n] - second if second > _NONE / 2 else float("inf")

    # --- many units of one length ---

    def segment_many(self, units: list[str]) -> list[tuple[bytes, float, float]]:
        """``segment`` of units of the same length, in arrays over the units; ids as bytes."""
        n, size = len(units), len(units[0])
        chars = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").reshape(n, size)
        wide = chars.astype(np.uint64) + np.uint64(1)
        width = min(size, self.longest)
        piece = np.full((width, size, n), -1, np.int32)  # piece of length k + 1 from each start
        row, col = np.divmod(np.arange(n * size), size)
        h = np.zeros(n * size, np.uint64)
        for k in range(width):
            if k:
                inside = col + k < size
                row, col, h = row[inside], col[inside], h[inside]
            h = h * _BASE + wide[row, col + k]
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == h
            row, col, h, at = row[known], col[known], h[known], at[known]
            piece[k, col, row] = self.piece_at[at]
            if not len(row):
                width = k + 1
                break
        some = (piece[:width] >= 0).any(axis=2)
        some[0] = True
        weight = {(k, s): np.where(piece[k, s] >= 0, self.score[piece[k, s]], self.unknown if k == 0 else _NONE) for k, s in np.argwhere(some).tolist()}
        ahead, back = np.full((size + 1, n), _NONE), np.full((size + 1, n), _NONE)
        step = np.zeros((size + 1, n), np.int8)
        ahead[0], back[size] = 0, 0
        for e in range(1, size + 1):
            for k in range(min(width, e) - 1, -1, -1):  # the longest piece first, as starts rise
                if some[k, e - k - 1]:
                    total = ahead[e - k - 1] + weight[k, e - k - 1]
                    better = total > ahead[e]
                    np.copyto(ahead[e], total, where=better)
                    step[e][better] = k + 1
        for s in range(size - 1, -1, -1):
            for k in range(min(width, size - s)):
                if some[k, s]:
                    np.maximum(back[s], weight[k, s] + back[s + k + 1], out=back[s])
        on = np.zeros((size, n), np.int8)  # length of the best path's piece from each start on it
        place, every = np.full(n, size), np.arange(n)
        while len(every):
            k = step[place[every], every]
            place[every] -= k
            on[place[every], every] = k
            every = every[place[every] > 0]
        second = np.full(n, _NONE)
        for (k, s), w in weight.items():
            total = ahead[s] + w + back[s + k + 1]
            total[on[s] == k + 1] = _NONE
            np.maximum(second, total, out=second)
        gap = np.where(second > _NONE / 2, ahead[size] - second, np.inf).tolist()
        score = ahead[size].tolist()

        row, start = np.nonzero(on.T)  # the pieces of all best paths in order
        length = on[start, row].astype(np.int64)
        taken = piece[length - 1, start, row].astype(np.int64)
        # pieces against characters: a unit with a character that has no piece, or whose hash led astray, is done alone
        put = np.repeat(self.first_char[taken], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        alone = ((self.chars[put % len(self.chars)] != chars.ravel()) | np.repeat(taken < 0, length)).reshape(n, size).any(axis=1)
        data, bounds = taken.astype("<u4").tobytes(), (4 * np.searchsorted(row, np.arange(n + 1))).tolist()
        out = [(data[s:e], w, g) for s, e, w, g in zip(bounds, bounds[1:], score, gap)]
        for i in np.flatnonzero(alone).tolist():
            ids, w, g = self.segment(units[i])
            out[i] = np.array(ids, "<u4").tobytes(), w, g
        return out

    # --- A-star ---

    def n_best(self, units: list[str], n: int) -> list[tuple[float, list[list[int]]]]:
        """The ``n`` best paths through the chain of ``units``: score and ids per unit."""
        chain = [self.arcs(u) for u in units]
        ahead = []
        for arcs in chain:
            a = [0.0]
            for ends in arcs[1:]:
                a.append(max(a[s] + w for s, _, w in ends))
            ahead.append(a)
        before = [0.0]
        for a in ahead:
            before.append(before[-1] + a[-1])
        # (minus the score of the best whole path through it, unit, place, order, score from here on, path from here on)
        queue, order, out = [(-before[-1], len(units) - 1, len(units[-1]) if units else 0, 0, 0.0, None)], 1, []
        popped: dict[tuple[int, int], int] = {}
        while queue and len(out) < n:
            bound, u, place, _, score, path = heapq.heappop(queue)
            # what leaves the queue at one place does so from the best on; no path beyond the n-th of a place is among the n best
            seen = popped[u, place] = popped.get((u, place), 0) + 1
            if seen > n:
                continue
            while u > 0 and place == 0:
                u -= 1
                place = len(units[u])
            if u < 0 or place == 0:
                steps: list[list[tuple[int, int]]] = [[] for _ in units]
                while path:
                    unit, piece, start, path = path
                    steps[unit].append((piece, start))
                out.append((-bound, [self.spelled(x, s) for x, s in zip(units, steps)]))
                continue
            for s, i, w in chain[u][place]:
                total = score + w
                if popped.get((u, s), 0) < n:
                    heapq.heappush(queue, (-(total + before[u] + ahead[u][s]), u, s, order, total, (u, i, s, path)))
                order += 1
        return out


def _spaced(parts: list[str]) -> list[str]:
    """Units, without their first space, of parts that each follow a space; empty parts are further spaces."""
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts:
        if p:
            out.append(SPACE * run + p)
            run = 0
        else:
            run += 1
    if run:
        out.append(SPACE * (run - 1))
    return out


def unit_keys(text: str) -> list[str]:
    """The units of ``text`` in order; the space before each is left out, and
    those that begin a further line begin with its newline instead."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    first, *lines = text.split("\n")
    out = list(_spaced(first.split(" ")))
    for line in lines:
        parts = line.split(" ")
        out.append("\n" + parts[0])
        out += _spaced(parts[1:])
    return out


def unit_text(key: str) -> str:
    return key if key[:1] == "\n" else SPACE + key


class Segmenter:
    """N-best paths of whole texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.place: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.score, self.gap, self.size = np.zeros(1024), np.zeros(1024), np.zeros(1024, np.int64)
        self.best: dict[tuple[int, int], list[tuple[float, bytes]]] = {}

    def forget(self, keep: int) -> None:
        """Keep the units met first, mostly the frequent ones."""
        self.place = dict(islice(self.place.items(), keep))
        del self.ids[keep:]
        self.best.clear()

    def learn(self, keys: set[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for k in sorted(keys):
            by_size.setdefault(len(k) + (k[:1] != "\n"), []).append(k)
        for size, own in sorted(by_size.items()):
            one_by_one = size > _LONG or len(own) < _FEW
            for s in range(0, len(own), 4096):
                part = own[s:s + 4096]
                units = [unit_text(k) for k in part]
                if one_by_one:
                    found = [(np.array(ids, "<u4").tobytes(), w, g) for ids, w, g in map(self.vocabulary.segment, units)]
                else:
                    found = self.vocabulary.segment_many(units)
                ids, score, gap = zip(*found)
                first = len(self.ids)
                end = first + len(part)
                if end > len(self.score):
                    self.score, self.gap, self.size = (np.resize(x, 2 * end) for x in (self.score, self.gap, self.size))
                self.ids += ids
                self.score[first:end], self.gap[first:end], self.size[first:end] = score, gap, [len(x) // 4 for x in ids]
                self.place.update(zip(part, range(first, end)))

    def paths(self, texts: list[str], n: int = N_BEST) -> list[tuple[bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]]:
        """Per text: ids of the best path, and the ``n`` best paths as (score,
        edits of the best path: place, pieces replaced, ids instead), best first."""
        cut = [unit_keys(t) for t in texts]
        if len(self.ids) > CACHE_UNITS:
            self.forget(CACHE_UNITS // 2)
        known = self.place.get
        found = [list(map(known, keys)) for keys in cut]
        open_ = [k for k, f in enumerate(found) if None in f]
        if open_:
            self.learn({u for k in open_ for u, f in zip(cut[k], found[k]) if f is None})
            for k in open_:
                found[k] = list(map(self.place.__getitem__, cut[k]))
        return [self._of(keys, f, n) for keys, f in zip(cut, found)]

    def _unit(self, i: int, key: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best paths of a unit, its remembered best path first: (loss against it, ids)."""
        if (i, n) not in self.best:
            if len(self.best) >= BEST_UNITS:
                self.best.clear()
            found = [(score, np.array(ids, "<u4").tobytes()) for score, (ids,) in self.vocabulary.n_best([unit_text(key)], n)]
            others = [(float(self.score[i]) - score, ids) for score, ids in found if ids != self.ids[i]]
            self.best[i, n] = [(0.0, self.ids[i]), *others][:n]
        return self.best[i, n]

    def _of(self, keys: list[str], found: list[int], n: int):
        at, own = np.array(found, np.int64), self.ids
        ids = b"".join([own[i] for i in found])
        best = float(self.score[at].sum())
        paths: list[tuple[float, list]] = [(best, [])]
        if n > 1 and len(at):
            gaps = self.gap[at]
            near = np.argpartition(gaps, n - 2)[:n - 1] if len(gaps) >= n else np.arange(len(gaps))
            # of equal gaps the first places, whatever the partition picked
            limit = gaps[near].max()
            near = np.flatnonzero(gaps < limit)
            near = np.sort(np.concatenate([near, np.flatnonzero(gaps == limit)[:max(0, n - 1 - len(near))]]))
            near = near[gaps[near] < np.inf]
            if len(near):
                choices = [self._unit(found[i], keys[i], n) for i in near.tolist()]
                places, sizes = (np.cumsum(self.size[at]) - self.size[at])[near].tolist(), self.size[at[near]].tolist()
                for loss, picks in _cheapest([[c[0] for c in own] for own in choices], n)[1:]:
                    paths.append((best - loss, [(p, z, c[k][1]) for p, z, c, k in zip(places, sizes, choices, picks) if k]))
        return ids, paths


def _cheapest(losses: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` smallest sums of one loss from each rising list, and which were taken."""
    first = (0,) * len(losses)
    queue, seen, out = [(0.0, first)], {first}, []
    while queue and len(out) < n:
        total, picks = heapq.heappop(queue)
        out.append((total, picks))
        for i, k in enumerate(picks):
            more = picks[:i] + (k + 1,) + picks[i + 1:]
            if k + 1 < len(losses[i]) and more not in seen:
                seen.add(more)
                heapq.heappush(queue, (total - losses[i][k] + losses[i][k + 1], more))
    return out


@functools.cache
def _segmenter(path: str) -> Segmenter:
    return Segmenter(path)


@functools.cache
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def edited(ids: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """The ids of a path from those of the best path and its edits."""
    out, at = [], 0
    for place, n, new in edits:
        out += ids[4 * at:4 * place], new
        at = place + n
    return b"".join([*out, ids[4 * at:]])


_EDITS = pa.list_(pa.struct([("place", pa.int32()), ("replaced", pa.int32()), ("ids", pa.binary())]))
_PATHS = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), ("ids_crc32", pa.int64()), ("edits", _EDITS)]))
_PATHS_DDL = "array<struct<score:double,n_pieces:int,ids_crc32:bigint,edits:array<struct<place:int,replaced:int,ids:binary>>>>"


def _encode(path: str, n: int):
    def run(batches):
        segmenter = _segmenter(path)
        for part in row_slices(batches):
            ids, paths = [], []
            for best, found in segmenter.paths([t or "" for t in part.column("text").to_pylist()], n):
                ids.append(best)
                paths.append([{"score": score, "n_pieces": len(x := edited(best, e)) // 4, "ids_crc32": zlib.crc32(x),
                               "edits": [{"place": p, "replaced": r, "ids": new} for p, r, new in e]} for score, e in found])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(paths, _PATHS)], ["doc_id", "ids", "paths"])
        segmenter.forget(KEEP_UNITS)  # the worker lives on
    return run


def encode(docs: DataFrame, n: int = N_BEST, model: str | None = None) -> DataFrame:
    """<doc_id, ids, paths> for each row of ``docs`` <doc_id, text>.

    ``ids`` are those of the best path, as little-endian unsigned 32-bit
    integers; ``paths`` are the ``n`` best, or all where there are fewer, best
    first, each with score, number and crc32 of its ids, and its edits of the
    best path. Equal scores come in any order, the same on every run over the
    same rows. Null and empty texts have no ids and one path without pieces.
    Rows are independent; an empty table gives no rows, other columns are not
    read.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode(model or model_path(), n), f"doc_id {id_type}, ids binary, paths {_PATHS_DDL}")


def decoded(ids: Column, model: str | None = None) -> Column:
    """The text of a column of ids as ``encode`` writes them."""
    path = model or model_path()

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        decode = _decoder(path).decode  # a worker of its own, so it holds no lattice
        return pd.Series([None if x is None else decode(np.frombuffer(x, "<u4").tolist()) for x in column], dtype=object)

    return run(ids)


def summary(encoded: DataFrame) -> DataFrame:
    """Per document: number and digest of the best ids, scores and digests of all paths, digest of the decoded text."""
    text = decoded(F.col("ids"))
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.transform("paths", lambda p: p["score"]).alias("scores"), F.transform("paths", lambda p: p["ids_crc32"]).alias("paths_crc32"),
        F.sha2(text, 256).alias("decoded_sha256"))
