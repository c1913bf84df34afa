"""Hard negatives, tokenizer alignment and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import odd
from topicspark.llm import alignment, fingerprints, hard_negatives
from topicspark.llm.queries import op11_hard_negatives

SF = "/root/testdata/sf0.001"


# --- hard negatives --------------------------------------------------------------

def vectors():
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(12).tolist(), i % 4) for i in range(1, 260)]
    rows += [(1000 + i, rows[49][1], i % 3) for i in range(40)]  # ties
    rows += [(2000 + i, [float(rng.integers(-3, 3))] * 12, 9) for i in range(30)]
    rows += [(50, rows[49][1], 7), (50, rows[49][1], 7), (3000, rows[7][1], 3), (3000, rows[7][1], 3), (3050, [0.0] * 12, 1)]  # repeated rows and ids
    rows += [(4000, None, 1), (4050, [], 1), (4051, [], 1), (4052, [], 2), (4100, [1.0, None], 1), (4150, [math.nan] * 12, 1), (4200, [math.inf] * 12, 1), (4250, [1.0] * 12, None),
             (None, [1.0] * 12, 1), (4300, [1e30] * 12, 1), (4350, [1.0, 2.0], 1), (4351, [2.0, 1.0], 1), (4352, [1.0, 1.0], 2), (4400, [1e6] * 12, 1), (4401, [-1e6] * 12, 2), (4402, [7e5] * 12, 2)]
    return rows


def brute_negatives(rows):
    """All scores of all pairs, in whole numbers."""
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or None in v or not np.isfinite(v).all():
            continue
        whole = [math.floor(256 * x) for x in v]
        if all(abs(x) <= hard_negatives.largest(len(v)) for x in whole):
            key = (label, len(v), hard_negatives.planes(np.array([whole], np.int64).reshape(1, -1))[0])
            if i not in held or key < held[i][0]:
                held[i] = (key, label, whole)
    out = []
    for a, (_, label, x) in held.items():
        if a % 50:
            continue
        found = sorted((-sum(p * q for p, q in zip(x, y)), b, other == label) for b, (_, other, y) in held.items() if b != a and len(y) == len(x))
        for s, p, same in [f for f in found if f[2]][:5]:
            inside = [f for f in found if not f[2] and 50 * -s <= 100 * -f[0] <= 95 * -s]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside[:3], 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [16, 4096])
def test_negatives_equal_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, score string").repartition(3)
    got = hard_negatives.mine(df, block=block)
    want = brute_negatives(rows)
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) > 40
    assert dict(got.dtypes)["rank"] == "int" and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_of_moved_labels(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in op11_hard_negatives(spark, SF).collect()) == brute_negatives(rows)


def test_no_vectors_no_negatives(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine(df).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(50, [1.0], 1)], "vec_id bigint, embedding array<float>, label int")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 20), st.integers(1, 6), st.sampled_from([1, 2, 300, 2**25]), st.randoms(use_true_random=False))
def test_lookups_give_exact_inner_products(dim, n, most, rng):
    a, b = ([[rng.randint(-most, most) for _ in range(dim)] for _ in range(n)] for _ in range(2))
    whole = np.array(a, np.int64).reshape(n, dim)
    packed = hard_negatives.stacked(hard_negatives.planes(np.array(b, np.int64).reshape(n, dim)), dim)
    assert hard_negatives.unpacked(packed, dim).tolist() == b
    assert hard_negatives.scores(whole, packed).tolist() == [[sum(p * q for p, q in zip(x, y)) for y in b] for x in a]


# --- alignment -------------------------------------------------------------------

def sides():
    return alignment._aligner(alignment.public_path(alignment.VOCABULARY_A), alignment.public_path(alignment.MODEL_B))


def whole_text(text):
    """Groups and links of a text from both tokenizers' whole results; None without tokens."""
    s = sides()
    a, b = s.a.encode(" " + (text or ""), add_special_tokens=False).ids, s.b.encode(text or "")
    own_a, own_b = [s.bytes_a[i] for i in a], [s.bytes_b[i] for i in b]
    data = (" " + (text or "")).encode()
    if not text or b"".join(own_a) != data or b"".join(own_b) != data:
        return None
    spans = []
    for own in (own_a, own_b):
        ends = np.cumsum([len(x) for x in own]).tolist()
        spans.append(list(zip([0, *ends], ends)))
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups = [",".join(str(i) for i, (p, q) in zip(a, spans[0]) if s <= p and q <= e) + "|" + ",".join(str(i) for i, (p, q) in zip(b, spans[1]) if s <= p and q <= e)
              for s, e in zip([0, *cuts], cuts)]
    links = [(i, j) for i, (p, q) in zip(a, spans[0]) for j, (x, y) in zip(b, spans[1]) if p < y and x < q]
    return len(a), len(b), groups, links


def brute_alignment(rows):
    found = [(i, whole_text(t)) for i, t in rows]
    count = Counter(link for _, f in found if f for link in f[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return Counter((i, 0, 0, 0, 0, 0, 0, "") if f is None else
                   (i, f[0], f[1], len(f[2]), len(f[3]), sum(count[x] == top[x[1]] for x in f[3]), sum(count[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
                   for i, f in found)


SHORT = [None, "", " ", "\n", "\nline first", "a", "A b", "One\ttwo\n\nthree", "tail \n", "É là où ça finit — 東京 😀 end", "with ▁ inside", "<|endoftext|> is text <s> <0x41>", "é ﬁ   x",
         "don't stop  now", "x" * 300, " \t\r\n\x0b\x0c ", "nul \x00 here", "same again", "same again"]


def test_alignment_equals_brute_force(spark, monkeypatch):
    rows = [(i * 5 % 97, t) for i, t in enumerate(SHORT + [odd.prose(k, 60) for k in range(8)] + [odd.prose(3, 60)] * 20)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    df = odd.docs(spark, [(i, t, "en", "a", 0) for i, t in rows])
    want = brute_alignment(rows)
    assert Counter(tuple(r) for r in alignment.align(df).collect()) == want
    # many runs, pages and bins: workers of the session hold the figures they were started with, so the functions are called here
    monkeypatch.setattr(alignment, "PAGE", 7)
    got = local_alignment(df.collect(), bins=3)
    assert got == {k[0]: k for k in want if k[0] not in (None, 5)}


def local_alignment(rows, bins):
    """The steps of ``align`` over small flushes, without Spark."""
    s, own, documents = alignment.Aligner(alignment.public_path(alignment.VOCABULARY_A), alignment.public_path(alignment.MODEL_B)), [], []
    for at in range(0, len(rows), 4):
        part = rows[at:at + 4]
        sizes, digests, links, doc = s.align([r.text for r in part])
        documents += [(r.doc_id, *z.tolist(), d) for r, z, d in zip(part, sizes, digests)]
        if len(links):
            own += [(radix, at, pages) for radix, _, pages in alignment.runs(links << np.uint64(24) | doc.astype(np.uint64), s.width)]
    def batch(names, columns):
        return pa.RecordBatch.from_arrays(columns, names)
    runs = batch(["radix", "row", "pages"], [pa.array(x) for x in zip(*own)])
    count = Counter()
    for b in alignment._counts([runs.slice(0, 20), runs.slice(20)]):
        for pair, n in zip(*(c.to_pylist() for c in b.columns)):
            count[pair] += n
    top = Counter()
    for pair, n in count.items():
        top[pair >> 20] = max(top[pair >> 20], n)
    added = Counter()
    for radix in sorted({r for r, _, _ in own}):
        pairs = sorted(p for p in count if (p >> 20) // s.width == radix)
        for salt in range(bins):
            those = [(row, pages) for k, (r, row, pages) in enumerate(own) if r == radix and k % bins == salt]
            if those:
                held = alignment._Bin(those)
                for k in range(0, len(pairs), 5):
                    now = pairs[k:k + 5]
                    held.meet(*(np.array(x, np.int64) for x in (now, [count[p] for p in now], [count[p] == top[p >> 20] for p in now])))
                for b in held.contributions():
                    for row, best, total in zip(*(c.to_pylist() for c in b.columns)):
                        added[row, 0] += best
                        added[row, 1] += total
    return {d[0]: (*d[:5], added[k, 0], added[k, 1], d[5]) for k, d in enumerate(documents) if d[0] not in (None, 5)}


def test_alignment_of_small_corpus(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    assert Counter(tuple(r) for r in alignment.align(df).collect()) == brute_alignment([(r.doc_id, r.text) for r in df.collect()])


def test_alignment_of_odd_rows(spark):
    df = odd.docs(spark)
    got = alignment.align(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in df.collect())
    assert all(r.n_groups <= min(r.n_a, r.n_b) and r.n_links >= max(r.n_a, r.n_b) and r.n_best <= r.n_links <= r.count_sum for r in got)
    assert alignment.align(odd.no_docs(spark)).collect() == []
    assert [tuple(r) for r in alignment.align(odd.docs(spark, [(1, None, "en", "a", 0), (2, "▁", "en", "a", 0)])).orderBy("doc_id").collect()] == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]


ODD_TEXT = st.lists(st.sampled_from(["a", "b.", " ", "  ", "\n", "\t", "é", "東", "<|endoftext|>", "<s>", "'s", "1", "\x1c", " ", "word", "!", ".\n", "▁", "\x00", "😀", "\r\n", "ﬁ", "é"]), max_size=12).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(ODD_TEXT, min_size=1, max_size=12))
def test_stretches_align_as_whole_texts(texts):
    sizes, digests, links, doc = sides().align(texts)
    for k, t in enumerate(texts):
        f = whole_text(t)
        assert tuple(sizes[k].tolist()) == ((f[0], f[1], len(f[2]), len(f[3])) if f else (0,) * 4)
        assert digests[k] == (hashlib.sha256(";".join(f[2]).encode()).hexdigest() if f else "")
        assert Counter(links[doc == k].tolist()) == Counter(sides().side(b) << 20 | a for a, b in (f[3] if f else []))


def test_one_text_and_single_units_agree():
    s = sides()
    units = sorted({" " + w for w in odd.prose(3, 400).split(" ")} | {"\nOf", " é東", " 😀!", " don't"})
    groups, sizes, links = s._in_one_text(units)
    one = s._one_by_one(units)
    assert groups == one[0] and (sizes == one[1]).all() and (links == one[2]).all()
    assert s._in_one_text([" a▁b", " c"]) is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), max_size=40), min_size=1, max_size=5), st.integers(1, 6))
def test_merges_lose_nothing(runs, size):
    own = []
    for k, keys in enumerate(runs):
        count = sorted(Counter(keys).items())
        pages = []
        for s in range(0, len(count), size):
            part = count[s:s + size]
            pages.append(alignment.page(np.array([p for (p, _), _ in part], np.uint64), np.array([d for (_, d), _ in part]), np.array([n for _, n in part])))
        own.append((100 * k, pages))
    got, before = Counter(), -1
    for pair, row, times in alignment.merged(own):
        assert int(pair.min()) >= before
        before = int(pair.max())
        for p, r, t in zip(pair.tolist(), row.tolist(), times.tolist()):
            got[p, r] += t
    assert got == Counter((p, 100 * k + d) for k, keys in enumerate(runs) for p, d in keys)


# --- fingerprints ----------------------------------------------------------------

def plain_digest(text):
    """Codes of a short text, counted triplet by triplet."""
    data = bytes(4) + text.encode()
    n = [0] * 256
    for t in range(4, len(data)):
        for salt, (i, j) in enumerate(fingerprints.TRIPLETS, 1):
            x = (data[t] << 16 | data[t - i] << 8 | data[t - j]) ^ (salt * 0x9E3779B1 & 0xFFFFFFFF)
            x = x * 0x85EBCA6B & 0xFFFFFFFF
            x = (x ^ x >> 15) * 0xC2B2AE35 & 0xFFFFFFFF
            n[x >> 24] += 1
    q = [sorted(n)[k] for k in (63, 127, 191)]
    code = [sum(c > x for x in q) for c in n]
    size = min(255, int(math.log1p(len(data) - 4) / math.log(1.1)))
    share = [x * 15 // max(1, q[2]) for x in q[:2]]
    return bytes([size, share[0] << 4 | share[1], *(code[k] | code[k + 1] << 2 | code[k + 2] << 4 | code[k + 3] << 6 for k in range(0, 256, 4))]).hex()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6), st.sampled_from([3, 7, 1 << 20]))
def test_digests_equal_plain_counts(texts, size):
    held, fingerprints.SLICE_BYTES = fingerprints.SLICE_BYTES, size
    try:
        assert not texts or fingerprints.digests(texts) == [plain_digest(t) for t in texts]
    finally:
        fingerprints.SLICE_BYTES = held


def test_likeness_is_bounded_and_falls_with_edits():
    a, b = odd.prose(1, 600), odd.prose(2, 600)
    prints = fingerprints.digests([a, a, a.replace(" ", "  ", 1), a[:len(a) // 2] + b[len(b) // 2:], "東京" * 900, "", ""])
    like = fingerprints.likeness([prints[0]] * 5, prints[:5])
    assert like[0] == like[1] == 1 and 1 > like[2] > like[3] > like[4] >= 0
    assert fingerprints.likeness([prints[5]], [prints[6]])[0] == 1 and ((0 <= like) & (like <= 1)).all()
    assert fingerprints.likeness(prints[2:4], prints[3:5]).tolist() == fingerprints.likeness(prints[3:5], prints[2:4]).tolist()


def brute_edits(rows):
    """The documents in order, each compared with the next one."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2], (r[1] or "").encode()))
    out = []
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        changed = t[:len(t) - n] + after[:n]
        p, e, x = fingerprints.digests([t, changed, after])
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), p, e, *fingerprints.likeness([p, p], [e, x]).tolist()))
    return Counter(out)


def hashed(spark, df):
    from pyspark.sql import functions as F

    return [(r.doc_id, r.text, r.h) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]


def test_edits_equal_brute_force(spark):
    for df in (odd.docs(spark), spark.read.parquet(f"{SF}/documents.parquet"), odd.docs(spark, [(7, "alone and short", "en", "a", 0)]), odd.docs(spark, [(7, "first", "en", "a", 0), (9, None, "en", "a", 0)])):
        got = fingerprints.compare_edits(df)
        assert Counter(tuple(r) for r in got.collect()) == brute_edits(hashed(spark, df))
    assert fingerprints.compare_edits(odd.no_docs(spark)).collect() == []


def test_edited_texts_stand_out(spark):
    rows = fingerprints.compare_edits(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    long = [r for r in rows if r.n_chars >= 200]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.97 * len(long)


def test_columns_of_fingerprints(spark):
    df = fingerprints.fingerprint(odd.docs(spark, [(1, "some text", "en", "a", 0), (2, None, "en", "a", 0)]))
    got = {r.doc_id: r.fingerprint for r in df.collect()}
    assert got == {1: plain_digest("some text"), 2: plain_digest("")}
    pairs = spark.createDataFrame([(got[1], got[1]), (got[1], got[2]), (None, got[1])], "a string, b string")
    like = [r[0] for r in pairs.select(fingerprints.like(pairs.a, pairs.b)).collect()]
    assert like[0] == 1 and 0 <= like[1] < 1 and like[2] is None
