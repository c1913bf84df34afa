"""Exact, near and line dedup against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import odd
from topicspark.llm import exact_dedup, line_dedup, near_dedup, shingles
from topicspark.llm.components import components

WS = r"[\x20\x09-\x0D]"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def test_exact_groups_of_odd_rows(spark):
    df = odd.docs(spark)
    rows = [(r.doc_id, re.sub(WS + "+", " ", r.text or "")) for r in df.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = Counter((i, least(groups[t]), len(groups[t]), i == least(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert Counter(rows_of(exact_dedup.exact_groups(df))) == want


def test_exact_drop_keeps_columns_and_one_row_of_each(spark):
    df = odd.docs(spark)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    seen = [re.sub(WS + "+", " ", r.text or "") for r in kept.collect()]
    assert len(seen) == len(set(seen)) == len({re.sub(WS + "+", " ", r.text or "") for r in df.collect()})


def test_chunks_join_up_and_depend_on_content_alone():
    text = odd.prose(5, 40_000)
    alone = next(exact_dedup.chunked(pa.array([text]), 0))
    after = list(exact_dedup.chunked(pa.array(["something before", None, text, ""]), 0))
    assert b"".join(alone[1]) == alone[0] == text.encode()
    assert after[2] == alone and after[1][1] == [] and len(alone[1]) > 50
    # an insertion changes the chunks around it only
    changed = next(exact_dedup.chunked(pa.array([text[:100_000] + "inserted" + text[100_000:]]), 0))
    assert len(set(alone[2]) - set(changed[2])) <= 3


def test_colliding_identifiers_lead_to_another_seed(spark, monkeypatch):
    real = exact_dedup._chunks

    def colliding(seed):
        def run(batches):
            for b in real(seed)(batches):
                yield b if seed else b.set_column(0, "chunk_id", pa.array([b"same"] * b.num_rows, pa.binary()))
        return run

    monkeypatch.setattr(exact_dedup, "_chunks", colliding)
    df = odd.docs(spark, [(1, "a", None, None, 1), (2, "b", None, None, 1), (3, "a", None, None, 1)])
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(df).collect()) == [(1, 1), (2, 2), (3, 1)]


def python_lines(rows, min_chars=10, min_docs=2):
    holders = defaultdict(set)
    split = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [re.sub("[A-Z]", lambda m: m[0].lower(), x).strip(" \t\n\x0b\x0c\r") for x in lines]
        split.append((i, lines, keys))
        for k in keys:
            if len(k) >= min_chars and i is not None:
                holders[k].add(i)
    out = []
    for i, lines, keys in split:
        gone = [i is not None and len(k) >= min_chars and len(holders[k]) >= min_docs and i != min(holders[k]) for k in keys]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_of_odd_rows(spark, min_docs):
    df = odd.docs(spark)
    want = python_lines([(r.doc_id, r.text) for r in df.collect()], min_docs=min_docs)
    assert Counter(rows_of(line_dedup.dedup_lines(df, min_docs=min_docs))) == Counter(want)


def python_near(rows, percent=80):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])))
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return [(i, len(x), root(i) if x else i, i == (root(i) if x else i)) for i, x in sets]


def test_near_groups_of_odd_rows(spark):
    df = odd.docs(spark)
    want = python_near([(r.doc_id, r.text) for r in df.collect()])
    assert Counter(rows_of(near_dedup.near_groups(df))) == Counter(want)


def near_family(n):
    base = odd.prose(7, 90).split(" ")
    rows = []
    for i in range(n):
        w = list(base)
        for k in range(i % 6):
            w[(i * 13 + k * 17) % 90] = f"w{i}x{k}"
        rows.append((1000 - i, " ".join(w), None, None, 0))
    return rows + [(2000 + i, odd.prose(50 + i, 60), None, None, 0) for i in range(10)]


@pytest.mark.parametrize("members", [4, 1024])
def test_near_groups_of_a_family_in_blocks(spark, monkeypatch, members):
    """With blocks of 4 the family spans many blocks, and links across them count too."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
    rows = near_family(40)
    got = Counter(rows_of(near_dedup.near_groups(odd.docs(spark, rows))))
    assert got == Counter(python_near([r[:2] for r in rows]))


def test_shingle_sets_cut_anywhere(monkeypatch):
    texts = odd.texts()
    whole = [x.tolist() for x in shingles.shingle_sets(pa.array(texts))]
    monkeypatch.setattr(shingles, "PIECE", 50)
    monkeypatch.setattr(shingles, "_POWERS", {})
    assert [x.tolist() for x in shingles.shingle_sets(pa.array(texts))] == whole


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:3000], rng.integers(0, 1 << 63, 1000, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((shingles.signature(a) == shingles.signature(b)).mean() - true) < 0.2
    assert (shingles.signature(a[::-1].copy()) == shingles.signature(a)).all()


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(5000, 5000 + i) for i in range(1, 400)]
    edges = spark.createDataFrame(chain[::-1] + star + [(9, 9), (7000, None), (6001, 6000), (6000, 6001)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{5000 + i: 5000 for i in range(400)}, 6000: 6000, 6001: 6000}


def test_empty_tables(spark):
    df = odd.no_docs(spark)
    assert exact_dedup.exact_groups(df).collect() == []
    assert line_dedup.dedup_lines(df).collect() == []
    assert near_dedup.near_groups(df).collect() == []
    assert near_dedup.drop_near_copies(df).columns == df.columns


def test_near_drop_keeps_one_of_each_group(spark):
    df = odd.docs(spark, near_family(12))
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(df).collect()}
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))
