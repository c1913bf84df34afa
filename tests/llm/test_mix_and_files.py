"""Mixing, token files and WARC bundles: brute force and exact round trips."""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import odd
from topicspark.llm import common, mixing, token_files, warc

SF = "/root/testdata/sf0.001"


# --- mixing --------------------------------------------------------------------

def python_targets(sizes: dict, weights=(3, 1, 2), share=1.5, epochs=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > epochs * sizes[s]]
        if not over:
            target.update({s: left * w[s] / total for s in open_})
            break
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def best_sum(lengths, budget):
    reach = {0}
    for x in lengths:
        reach |= {r + x for r in reach}
    return min(abs(r - budget) for r in reach)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=14), st.floats(0, 1))
def test_fit_takes_no_more_than_there_is(lengths, part):
    size, count = np.unique(lengths, return_counts=True)
    budget = round(part * sum(lengths))
    take = mixing.fit_lengths(size, count, budget)
    assert (take >= 0).all() and (take <= count).all()
    assert abs(int((take * size).sum()) - budget) <= max(lengths)


def test_fit_is_exact_where_lengths_allow():
    size, count = np.array([1, 5, 9, 400]), np.array([50, 100, 100, 3])
    for budget in (0, 1, 7, 333, 1000, int((size * count).sum())):
        assert int((mixing.fit_lengths(size, count, budget) * size).sum()) == budget
    for lengths, budget in (([7, 7, 11], 15), ([10, 10], 14), ([3, 100], 97)):
        s, c = np.unique(lengths, return_counts=True)
        assert abs(int((mixing.fit_lengths(s, c, budget) * s).sum()) - budget) == best_sum(lengths, budget)


def check_mix(df, rows):
    sizes = {}
    for r in df.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + n
    targets = python_targets(sizes)
    source_of = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.collect())
    assert sum(source_of.values()) == len(rows)
    by_size = Counter()
    for r in rows:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert any(k[0] == r.doc_id and k[2] == r.size and sizes[k[1]] == r.source_size and abs(targets[k[1]] - r.target) < 1e-6 * max(1, r.target) for k in source_of)
        by_size[r.source_size, r.target] += r.taken
    return sizes, targets, by_size


def test_mix_of_odd_rows(spark):
    df = odd.docs(spark)
    rows = mixing.mix(df).collect()
    check_mix(df, rows)
    assert Counter(rows) == Counter(mixing.mix(df.repartition(7)).collect())


def test_mix_meets_targets_on_the_small_corpus(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(df).collect()
    _, _, taken = check_mix(df, rows)
    for (size, target), words in taken.items():
        # a source has ten documents or so here: some targets lie between the sums of their lengths
        assert abs(words - target) <= max(1, 0.01 * target) or words == 2 * size
    copies = {r.doc_id: r.copies for r in rows}
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: c for i, c in copies.items() if c})


def test_mix_selects_the_right_number_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 3)
    rows = [(i, "same size here", None, "a" if i < 80 else "b", 0) for i in range(100)]
    got = mixing.mix(odd.docs(spark, rows)).collect()
    # a: 240 words, b: 60; 450 in all by 3 to 1, so a 337.5 and b 112.5
    taken = {s: sum(r.taken for r in got if r.source_size == s) for s in (240, 60)}
    assert abs(taken[240] - 337.5) <= 1.5 and abs(taken[60] - 112.5) <= 1.5


def test_apply_mix_keeps_clashing_columns(spark):
    df = odd.docs(spark)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns and {r.copies for r in out.collect()} == {"x"}


# --- token files ---------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70_000), max_size=1500))
def test_codes_give_every_token(ids):
    ids = np.array(ids, np.uint32)
    f = token_files.TokenFile(token_files.file_bytes(3, 5, [7, None], [len(ids), 0], ids) + token_files.MAGIC)
    assert (f.tokens() == ids).all() and (f.partition, f.number, f.n_docs) == (3, 5, 2)
    for i in {0, len(ids) // 2, len(ids) - 1, *range(0, len(ids), 97)} if len(ids) else ():
        assert f.token(i) == ids[i]


WORDY = st.lists(st.sampled_from(["the", " ", "  ", "\n", "\t", "É", "東京", " ", " ", "don't", "12", "<|endoftext|>", "x" * 30, "\x85", "\x1c", "😀", "_", "'s"]), max_size=25).map("".join)


@settings(max_examples=200, deadline=None)
@given(WORDY)
def test_words_encode_as_the_whole_text(text):
    encoder = token_files._encoder(token_files.vocabulary_path())
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(pa.array([text]))[0].tolist() == whole


def test_token_files_round_trip(spark, monkeypatch, scratch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 500)
    df = odd.docs(spark)
    got = [tuple(r) for r in token_files.token_documents(df, f"{scratch}/t").orderBy("start").collect()]
    tokenizer = token_files._encoder(token_files.vocabulary_path()).tokenizer
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    some = {r.doc_id: r.ids for r in token_files.find_tokens(spark, f"{scratch}/t", [rows[4][0]]).collect()}
    assert some == {rows[4][0]: [*tokenizer.encode(rows[4][1] or "", add_special_tokens=False).ids, 0]}


@functools.cache
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.vocabulary_path())


def test_added_tokens_encode_as_by_the_plain_call(spark, scratch):
    plain = plain_tokenizer()
    assert plain.encode("<|endoftext|> is text", add_special_tokens=False).ids == [50256, 318, 2420]
    texts = ["<|endoftext|> is text", "a <|endoftext|> b", "a<|endoftext|>b <|endoftext|><|endoftext|> the end", "x  <|endoftext|>  y\n<|endoftext|> ", "<|endoftext|", "plain words"]
    df = odd.docs(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    got = [tuple(r) for r in token_files.token_documents(df, f"{scratch}/t").orderBy("doc_id").collect()]
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


@settings(max_examples=200, deadline=None)
@given(WORDY)
def test_words_encode_as_by_a_fresh_tokenizer(text):
    plain = plain_tokenizer()
    got = token_files._encoder(token_files.vocabulary_path()).encode(pa.array([text]))[0].tolist()
    assert got == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=30, deadline=None)
@given(st.lists(st.none() | WORDY, max_size=20), st.integers(0, 5))
def test_columns_encode_row_by_row(texts, skip):
    column = pa.array(["left out"] * skip + texts, pa.string()).slice(skip)
    ids, bounds = token_files._encoder(token_files.vocabulary_path()).encode(column)
    assert [ids[s:e].tolist() for s, e in zip(bounds, bounds[1:])] == [plain_tokenizer().encode(t or "", add_special_tokens=False).ids for t in texts]


def test_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 8)
    encoder, plain = token_files.Encoder(token_files.vocabulary_path()), plain_tokenizer()
    for k in range(12):
        texts = [odd.prose(k % 5 + i, 9) + "\nand more " for i in range(4)]
        ids, bounds = encoder.encode(pa.array(texts))
        assert [ids[s:e].tolist() for s, e in zip(bounds, bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_no_documents_no_tokens(spark):
    assert token_files.token_documents(odd.no_docs(spark)).collect() == []
    assert mixing.mix(odd.no_docs(spark)).collect() == []


# --- WARC ----------------------------------------------------------------------

def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id bigint, url string, html string, digest string, size string").repartition(2)


def odd_pages():
    big = "<p>" + odd.prose(3, 50_000)
    same = "<html>" + "copy " * 40
    return [(1, "http://a/", None), (2, None, ""), (3, "http://a b\r\nX: y/é", "<html>\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", same), (5, "u", same), (7, "u", same),
            (4, "u", "short"), (6, "u", "short"), (8, "u", big), (10, "u", big + "!"), (8, "u", big), (None, "u", same), (None, "u", "no id " * 30)]


def python_records(rows):
    first = {}
    for i, _, t in rows:
        if len((t or "").encode()) >= 100 and i is not None:
            first[t] = min(i, first.get(t, i))
    out = []
    for i, _, t in rows:
        data = (t or "").encode()
        to = first.get(t) if first.get(t) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if to is not None else "response", to))
    return out


def test_warc_round_trip(spark, monkeypatch, scratch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 20_000)
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    rows = odd_pages()
    got = warc.archive(pages(spark, rows), f"{scratch}/w")
    assert Counter(tuple(r) for r in got.collect()) == Counter(python_records(rows))
    found = {r.record_id: r.block for r in warc.find_records(spark, f"{scratch}/w", [10, 3, 777]).collect()}
    assert set(found) == {warc.record_id(10), warc.record_id(3)}
    assert bytes(found[warc.record_id(10)]).endswith(rows[9][2].encode())
    # every bundle is one Zstandard stream to any other reader, and its records follow one another
    files = common_files(spark, f"{scratch}/w")
    assert len(files) > 1
    for data in files:
        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert stream == b"".join(f for f in map(warc.BundleReader(data).frame, range(len(warc.BundleReader(data).unpacked))))
        assert stream.startswith(b"WARC/1.1\r\n") and stream.endswith(b"\r\n\r\n")


def common_files(spark, path):
    return [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]


def test_no_pages(spark):
    assert warc.archive(pages(spark, [(1, "u", "x")]).where("false")).collect() == []


def test_a_damaged_payload_is_noticed():
    rec = warc.record(1, "u", b"payload" * 30, "0" * 64, None)
    bundle = warc.Bundle()
    bundle.add(warc.record_id(1), rec)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([bundle.close() + warc.SEEK_MAGIC], pa.binary())], ["content"])
    with pytest.raises(ValueError, match="payload"):
        list(warc._entries(pa.int64())([batch]))


def test_release_deletes_what_was_written(spark):
    path = common.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert common.release(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_every_length_combination_small():
    for lengths in itertools.product([1, 4, 6], repeat=3):
        s, c = np.unique(lengths, return_counts=True)
        for budget in range(sum(lengths) + 1):
            take = mixing.fit_lengths(s, c, budget)
            assert abs(int((take * s).sum()) - budget) == best_sum(lengths, budget), (lengths, budget, take)
