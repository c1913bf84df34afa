"""Language ID, personal data, embeddings, piece lattices and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tests.llm import odd
from topicspark.llm import embedding_dedup, exact_dedup, language_id, near_dedup, pieces, pii

SF = "/root/testdata/sf0.001"


# --- language ID ---------------------------------------------------------------

def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    rows = df.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= got[r.doc_id].score <= 1
    held = [r for r in rows if r.lang and got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_predictions_need_neither_labels_nor_ids(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(df)
    texts = [r.text for r in df.select("text").limit(20).collect()] + odd.texts()
    alone = [model.predict([t])[0][0] for t in texts]
    assert model.predict(texts)[0] == alone
    for t, lang in zip(texts, alone):
        assert (lang == "und") == (t is None or not any(c.isalpha() for c in t))


def test_language_of_odd_rows(spark):
    df = odd.docs(spark)
    got = language_id.identify(df).collect()
    assert len(got) == df.count()
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    kept = language_id.drop_unidentified(df)
    assert kept.columns == df.columns
    assert Counter(r.text for r in kept.collect()) == Counter(r.text for r in df.collect() if r.text and any(c.isalpha() for c in r.text))


def test_without_labels_all_is_unidentified(spark):
    rows = [(1, "some text", None, None, 1), (2, None, "en", None, 0)]
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd.docs(spark, rows)).collect()} == {("und", 0.0)}
    assert language_id.identify(odd.no_docs(spark)).collect() == []


def test_without_labels_texts_with_a_letter_stay(spark):
    rows = [(1, "some text", None, None, 1), (2, None, "en", None, 0), (3, "123 ...", None, None, 2), (4, "東京", None, None, 3), (5, "", None, None, 0)]
    kept = language_id.drop_unidentified(odd.docs(spark, rows))
    assert kept.columns == odd.docs(spark, rows).columns and {r.doc_id for r in kept.collect()} == {1, 4}
    assert {r.doc_id for r in corpus_pipeline.identified(spark, odd.docs(spark, [(2, "held out", "en", None, 1)]), SF).collect()} == {2}


def test_kernel_counts_shared_ngrams():
    a, b = "abcab", "abd"
    grams = [{x[i:i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)} for x in (a, b)]
    seen = np.zeros(language_id.N_FEATURES, bool)
    found = [language_id.ngrams(x, seen) for x in (a, b)]
    assert [len(f) for f in found] == [len(g) for g in grams] and not seen.any()
    model = language_id.fit([("x", found[0]), ("y", found[1])])
    want = len(grams[0] & grams[1]) / math.sqrt(len(grams[0]) * len(grams[1]))
    assert model.kernel([found[0]])[0] == pytest.approx([1, want])


def test_scores_equal_brute_force_kernel_ridge():
    corpus = [("en", "the cat sat on the mat"), ("en", "a dog and the sea"), ("de", "der hund und das meer"), ("de", "die katze auf der matte"), ("fr", "le chien et la mer")]
    texts = ["the dog", "das haus und der hund", "la mer", "zzz"]
    grams = lambda x: {x[i:i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)}

    def kernel(a, b):
        return len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))

    order = sorted(corpus, key=lambda c: c[0])
    names, n = ["de", "en", "fr"], len(order)
    k = np.array([[kernel(a, b) for _, b in order] for _, a in order])
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang, _ in order])
    w = np.diag([1 / sum(lang == other for other, _ in order) for lang, _ in order])
    alpha = np.linalg.solve(w @ k + language_id.RIDGE / n * np.eye(n), w @ y)
    want = np.array([[kernel(t, b) for _, b in order] for t in texts]) @ alpha
    seen = np.zeros(language_id.N_FEATURES, bool)
    model = language_id.fit([(lang, language_id.ngrams(t, seen)) for lang, t in order], landmarks=100)
    got, score = model.predict(texts)
    assert got == [names[i] for i in want.argmax(axis=1)]
    assert score == pytest.approx(np.clip((want.max(axis=1) + 1) / 2, 0, 1), abs=1e-4)


def test_repeated_ids_have_a_defined_choice(spark):
    rows = [(i, f"text number {i} of the set", "en", "a", 0) for i in range(1, 40)] + [(i, f"noch ein wort {i} im satz", "de", "a", 0) for i in range(40, 80)]
    rows += [(1, "aber doch ein anderer satz", "de", "a", 0), (1, "zuletzt", "de", "a", 0), (50, "zz other", "en", "a", 0)] * 3
    models = [language_id.train(odd.docs(spark, own, extra=False)) for own in (rows, rows[::-1])]
    assert (models[0].coefficients == models[1].coefficients).all() and (models[0].landmarks == models[1].landmarks).all()


def test_features_are_made_of_chosen_rows_only(spark, monkeypatch):
    plans = []
    write = language_id.written

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(language_id, "written", kept)
    language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(plans) == 1 and "Python" not in plans[0] and "InArrow" not in plans[0]


# --- personal data -------------------------------------------------------------

def plain_spans(t):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(int(c) * 2))) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15],
    }


def check_summary(rows, texts):
    for r in rows:
        want = plain_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.KINDS]
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted((s, i, e, k) for i, k in enumerate(pii.KINDS) for s, e in want[k]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


@settings(max_examples=300, deadline=None)
@given(st.text("ab1290.@+- _%5(", max_size=60) | st.text(max_size=30))
def test_detectors_match_the_patterns(text):
    want = plain_spans(text)
    assert {k: pii.DETECTORS[k](text) for k in pii.KINDS} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["five ", "one", " dot ", "plus ", "[at]", " at ", "а", "４", "​", "x", "1", ".", " ", "double ", "é", "@", "five-five"]), max_size=20).map("".join))
def test_tapes_map_back(text):
    tapes = pii.rewritten(text)
    at = text
    for tape in tapes:
        for i in range(len(tape.text)):
            s, e, changed = tape.back(i, i + 1)
            assert 0 <= s <= e <= len(at)
            if not changed:
                assert at[s:e] == tape.text[i]
        at = tape.text
    for _, s, e, _ in pii.find(text):
        assert 0 <= s < e <= len(text)


DISGUISES = [
    ("write to john [at] example (dot) com now", "email", "john [at] example (dot) com"),
    ("jоhn@exаmple.com!", "email", "jоhn@exаmple.com"),
    ("bob at mail dot example dot org", "email", "bob at mail dot example dot org"),
    ("call plus one five five five, one two three four five six seven ok", "phone", "plus one five five five, one two three four five six seven"),
    ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("pay ４４４４ ３３３３ ２２２２ １１１１ now", "card", "４４４４ ３３３３ ２２２２ １１１１"),
    ("x ann​@​mail.example y", "email", "ann​@​mail.example"),
    ("más uno dos tres cuatro cinco seis siete ocho nueve cero", "phone", "más uno dos tres cuatro cinco seis siete ocho nueve cero"),
]


@pytest.mark.parametrize("text,kind,what", DISGUISES)
def test_disguises_are_found_where_they_stand(text, kind, what):
    found = pii.find(text)
    assert (kind, text.index(what), text.index(what) + len(what), False) in found
    assert pii.redacted(text, [f for f in found if text[f[1]:f[2]] == what]) == text.replace(what, f"[{kind.upper()}]")


PART_DISGUISES = [
    ("ask john@example dot com today", "email", "john@example dot com"),
    ("ask john [at] example dot com today", "email", "john [at] example dot com"),
    ("ask john @ mail.example dot com today", "email", "john @ mail.example dot com"),
    ("ask john at example [dot] com today", "email", "john at example [dot] com"),
    ("host 192 dot 168 dot 1 dot 20 is up", "ip", "192 dot 168 dot 1 dot 20"),
    ("host 192.168 dot one.20 is up", "ip", "192.168 dot one.20"),
    ("host one [dot] 9 [dot] 1 [dot] 20 is up", "ip", "one [dot] 9 [dot] 1 [dot] 20"),
    ("host one 9 2 dot 1 six 8 dot 1 dot 1 is up", "ip", "one 9 2 dot 1 six 8 dot 1 dot 1"),
    ("take one 192 dot 168 dot 1 dot 20 now", "ip", "192 dot 168 dot 1 dot 20"),
    ("call +1 five five 5 0 one 2 three 4 five 6 ok", "phone", "+1 five five 5 0 one 2 three 4 five 6"),
    ("call plus 1 (five 55) 012 three 456 ok", "phone", "plus 1 (five 55) 012 three 456"),
    ("pay 4444 3333 2222 111 one now", "card", "4444 3333 2222 111 one"),
    ("pay ４４４４ ３３３３ ２２２２ １１１１ one time", "card", "４４４４ ３３３３ ２２２２ １１１１"),
]


@pytest.mark.parametrize("text,kind,what", PART_DISGUISES)
def test_part_disguises_are_found_where_they_stand(text, kind, what):
    assert (kind, text.index(what), text.index(what) + len(what), False) in pii.find(text)


def test_clean_texts_beside_numerals_stay_clean():
    for t in ["john at example.com", "3 point 5 of 10", "one of 2020, two of 2021; three", "chapter 5 dot one", "at 5 dot com", "1 " * 20_000 + "one", "1" + " " * 50_000 + "x", "a " * 30_000 + "@ dot at", "one, 2 and 3. Four"]:
        assert pii.find(t) == [], t[:50]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["five ", "one", " dot ", "plus ", "[at]", "[dot]", " at ", "а", "４", "\u200b", "x", "1", "22", ".", " ", "double ", "é", "@", "five-five", "(", ")", ", "]), max_size=20).map("".join))
def test_wide_tapes_map_back(text):
    at = text
    for tape in pii.rewritten(text, wide=True):
        for i in range(len(tape.text)):
            s, e, changed = tape.back(i, i + 1)
            assert 0 <= s < e <= len(at)
            if not changed:
                assert at[s:e] == tape.text[i]
        at = tape.text
    for _, s, e, _ in pii.find(text):
        assert 0 <= s < e <= len(text)


def test_long_runs_take_linear_time():
    n = 200_000
    blanks = ["(at" + " " * n, "(are" + "\t\n " * (n // 3), "[dot" + " " * n, "one [dot]" + " " * n + "x", " " * n + "(at", "( " * (n // 2) + "(at", "one" + " " * n + "dot", "john@a [dot" + " " * n]
    for text in blanks + [c * n for c in " \t\n([{<)]}>.,-+@10a"]:
        start = time.perf_counter()
        assert pii.find(text) == [], text[:20]
        assert time.perf_counter() - start < 5, text[:20]
    assert pii.find("john [at] example [dot] com") == [("email", 0, 27, False)]
    assert pii.find("john" + " " * n + "[at]\t[dot] example [dot] com") == []
    far = "john" + " " * n + "[at]" + " " * n + "example [dot] com"
    assert pii.find(far) == [("email", 0, len(far), False)]


def test_clean_texts_stay_clean():
    for t in ["look at example.com", "meet at five", "one two three four five six", "a dot on the i", "version 1.2.3 of 10", "Ελλάδα και Россия", "naïve café at noon", "x" * 100_000, "1" * 100_000, "+" * 1000, "a." * 50_000 + "@"]:
        assert pii.find(t) == [], t[:50]


def test_personal_data_of_small_corpus_and_odd_rows(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check_summary(pii.summary(pii.find_pii(df)).collect(), {r.doc_id: r.text for r in df.collect()})
    extra = odd.docs(spark)
    rows = pii.summary(pii.find_pii(extra)).collect()
    assert len(rows) == extra.count()
    check_summary(rows, {r.doc_id: r.text for r in extra.collect()})
    assert pii.find_pii(odd.no_docs(spark)).collect() == []


# --- embeddings ----------------------------------------------------------------

def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.standard_normal(16) * 0.05).tolist(), 1) for i in range(60)]
    rows += [(100 + i, rng.standard_normal(16).tolist(), 1) for i in range(60)]
    rows += [(200, rows[0][1], 1), (201, rows[0][1], 1), (202, rows[0][1], 2), (203, rows[0][1], None), (203, rows[0][1], None), (204, rows[70][1], 1), (204, rows[70][1], 1)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] + [1.0] * 15, 1), (304, [None] + [1.0] * 15, 1), (305, [float("inf")] * 16, 1), (306, [1.0], 1), (307, [2.0], 1), (308, [1e-30] * 16, 3), (309, [1e30] * 16, 3), (None, rows[1][1], 1)]
    return rows


def brute_links(rows, threshold=0.93):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    n, up = Counter(), {r[0]: r[0] for r in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x, p), (b, y, q) in itertools.combinations(good, 2):
        if p == q and len(x) == len(y) and np.dot(x / abs(x).max(), y / abs(y).max()) / np.linalg.norm(x / abs(x).max()) / np.linalg.norm(y / abs(y).max()) >= threshold:
            n[a] += 1
            n[b] += 1
            s, t = sorted((root(a), root(b)))
            up[t] = s
    return n, root


@pytest.mark.parametrize("block", [7, 1024])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, rep string").repartition(3)
    n, root = brute_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    got = embedding_dedup.link_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id == 204:  # repeated rows are copies of each other
            assert r.n_links == n[204] // 2 and r.component_id == root(204)
        else:
            assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id] if r.vec_id is not None else 0, root(r.vec_id), r.vec_id == root(r.vec_id) if r.vec_id is not None else True), r


@pytest.mark.parametrize("block", [2, 1024])  # by bands, whole labels
def test_recall_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    n, root = brute_links([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    got = embedding_dedup.link_vectors(df).collect()
    assert embedding_dedup.plan_for(59, block)[0] == (8 if block == 2 else 0)
    assert block == 2 or sum(r.n_links for r in got) == sum(n.values())
    assert sum(r.n_links for r in got) >= 0.99 * sum(n.values()) and all(r.n_links <= n[r.vec_id] for r in got)
    assert sum(r.component_id == root(r.vec_id) for r in got) >= 0.99 * len(got)


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(5)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 400, 64)))
    b[:100] = a[:100] * 0.97 + b[:100] * 0.2
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    code, factor = embedding_dedup.codes(a)
    upper = embedding_dedup.upper_bounds(code, factor, b)
    assert (upper >= a @ b.T).mean() > 0.9999
    margin = embedding_dedup.EPS * np.sqrt(1 - factor**2) / factor / math.sqrt(63)
    error = upper - margin[:, None] - a @ b.T
    assert abs(error.mean()) < 0.002 and abs(error.diagonal()[:100].mean()) < 0.05


def test_rough_bounds_hold_and_roundtrip():
    rng = np.random.default_rng(6)
    for dim in (1, 2, 3, 64, 129):
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 300, dim)))
        b[:100] = a[:100] * 0.97 + b[:100] * 0.2
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        u = np.concatenate([a, b])
        packed, width = embedding_dedup.quarters(u)
        corner, turned = embedding_dedup.rough(packed, width, dim)
        want = u @ embedding_dedup.rotation(dim, embedding_dedup.SEED).T
        assert np.abs(turned - want).max(axis=1).max() <= width.max() / 2 + 1e-6
        assert ((corner > 0) == (want > 0)).all()
        code, factor = embedding_dedup.codes(u)
        n = len(u)
        group = {"b1": np.zeros(n, int), "b2": np.zeros(n, int), "block": np.zeros(n, int), "factor": factor, "width": width,
                 "corner": corner, "turned": turned, "earlier": np.zeros((n, 0), "<u4")}
        near = u @ u.T >= 0.93
        np.fill_diagonal(near, False)
        likely = set(embedding_dedup._likely(group, 0.93).tolist())
        assert set(np.flatnonzero(near.any(axis=1)).tolist()) <= likely
        if dim >= 64:  # unlike vectors are told by their codes
            assert len(likely) < 2 * near.any(axis=1).sum() + 30


def test_links_of_a_label_do_not_depend_on_others(spark):
    """Pairs at the very threshold, recall as registered: a small label is compared
    whole, in two blocks too, also beside a large one."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(64).tolist(), "large") for i in range(3000)]
    pairs = []
    for label, n in (("small", 300), ("middle", 1500)):
        for k in range(n // 2):
            u, w = (x / np.linalg.norm(x) for x in rng.standard_normal((2, 64)))
            w = w - (w @ u) * u
            v = 0.931 * u + math.sqrt(1 - 0.931**2) * w / np.linalg.norm(w)
            at = 10_000 + len(pairs) * 2
            pairs.append((at, at + 1))
            rows += [(at, u.tolist(), label), (at + 1, v.tolist(), label)]
    schema = "vec_id bigint, embedding array<double>, label string"
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == len(rows)
    for a, b in pairs:
        assert got[a].component_id == got[b].component_id == a and got[a].n_links == got[b].n_links == 1
    assert all(got[i].n_links == 0 for i in range(3000))
    alone = {r.vec_id: r for r in embedding_dedup.link_vectors(spark.createDataFrame([r for r in rows if r[2] == "small"], schema)).collect()}
    assert all(alone[i] == got[i] for i in alone)


def _pairs_at(rng, count, cosine, dim=64):
    for _ in range(count):
        u, w = (x / np.linalg.norm(x) for x in rng.standard_normal((2, dim)))
        w = w - (w @ u) * u
        yield u, cosine * u + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


@pytest.mark.parametrize("block", [8, 1024])
def test_links_do_not_depend_on_the_size_of_their_label(spark, monkeypatch, block):
    """Pairs at the very threshold link in a label of 1,600 vectors and of 160: with blocks
    of 8, bands stood in for the blocks above 96 and lost some."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = [(2 * k + side, v.tolist(), 1) for k, pair in enumerate(_pairs_at(np.random.default_rng(12), 800, 0.9301)) for side, v in enumerate(pair)]
    few = {k for k in range(1600) if k // 2 % 10 == 0}
    for some in (rows, [r for r in rows if r[0] in few]):
        got = embedding_dedup.link_vectors(spark.createDataFrame(some, "vec_id bigint, embedding array<double>, label int")).collect()
        assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 1, i // 2 * 2) for i, _, _ in some}


def test_clusters_over_tiles_equal_brute_force(spark, monkeypatch):
    """Chains and clusters of near copies over several blocks and tiles, copies in them."""
    for name, value in (("BLOCK", 16), ("BLOCKS", 3), ("GROWN", 2), ("TILE", 10), ("FULL_TILE", 7)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(13)
    vecs = [rng.standard_normal(8) + rng.standard_normal(8) * 0.2 * k for k in range(30)]
    base = rng.standard_normal((4, 8))
    vecs += [base[k % 4] + rng.standard_normal(8) * 0.3 for k in range(120)]
    vecs += [np.array([math.cos(k / 4), math.sin(k / 4), 0, 0, 0, 0, 0, 0]) for k in range(12)]
    rows = [(int(i), v.tolist(), 1 + k % 2) for k, (i, v) in enumerate(zip(rng.permutation(len(vecs)), vecs))]
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(0, len(rows), 5)]
    n, root = brute_links(rows)
    got = embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, n[i], root(i)) for i, _, _ in rows}
    assert sum(n.values()) > 1000


@pytest.mark.parametrize("dim", [2, 64, 300, 1001])
def test_no_pair_at_the_threshold_falls_below_its_bounds(dim):
    for cosine in (0.93 + 1e-9, 0.95, 0.9999999):
        u = np.array([v for pair in _pairs_at(np.random.default_rng(14), 150, cosine, dim) for v in pair])
        packed, width = embedding_dedup.quarters(u)
        corner, turned = embedding_dedup.rough(packed, width, dim)
        factor = embedding_dedup.codes(u)[1].astype("<f4")
        for k in range(0, len(u), 2):
            two = slice(k, k + 2)
            group = {"b1": np.zeros(2, int), "b2": np.ones(2, int), "block": np.arange(2), "factor": factor[two], "width": width[two], "corner": corner[two], "turned": turned[two]}
            assert embedding_dedup._likely(group, 0.93).tolist() == [0, 1]


def test_groups_are_whole_over_batches():
    rows = [(1, 8, 0, 0)] * 5 + [(1, 8, 0, 1)] * 2 + [(2, 8, 0, 1)] + [(2, 16, 0, 1)] * 6
    table = pa.table([list(c) for c in zip(*rows)], names=embedding_dedup._GROUP)
    for size in (1, 2, 3, 5, 100):
        got = [t.num_rows for t in embedding_dedup._groups(iter(table.to_batches(max_chunksize=size)))]
        assert got == [5, 2, 1, 6]


def test_bands_reach_the_recall():
    for n in (1, 100, 10_000, 10**9):
        bits, bands = embedding_dedup.bands_for(n)
        agree = (1 - math.acos(0.93) / math.pi) ** bits
        assert 1 - (1 - agree) ** bands >= embedding_dedup.RECALL


def test_one_id_with_other_labels_and_lengths(spark):
    rng = np.random.default_rng(9)
    u, v, w = rng.standard_normal((3, 64)).tolist()
    short = rng.standard_normal(16).tolist()
    near = (np.array(w) + rng.standard_normal(64) * 0.01).tolist()
    rows = [(1, u, 1), (1, v, 2), (1, short, 1), (2, u, 2), (3, w, 2), (4, near, 2), (5, short, 2), (6, v, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = embedding_dedup.link_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == ((1, 3) if r.vec_id in (3, 4) else (0, r.vec_id)), r
    linked = embedding_dedup.link_vectors(df.unionByName(spark.createDataFrame([(7, (np.array(v) * 2).tolist(), 2)], df.schema))).collect()
    assert {(r.n_links, r.component_id) for r in linked if r.vec_id in (1, 7)} == {(1, 1)}


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.link_vectors(df).collect() == []


# --- pieces --------------------------------------------------------------------

@pytest.fixture(scope="module")
def segmenter():
    return pieces._segmenter(pieces.model_path())


def brute_paths(v, text):
    """All paths of a short text's lattice, by score."""
    whole = pieces.SPACE + text.replace(" ", pieces.SPACE) if text else ""
    found = {len(whole): [(0.0, ())]}
    for s in range(len(whole) - 1, -1, -1):
        found[s] = []
        for e in range(s + 1, len(whole) + 1):
            i = v.ids.get(whole[s:e])
            ids, w = ((i,), float(v.score[i])) if i is not None else (tuple(v.byte[b] for b in whole[s:e].encode()), float(v.unknown)) if e == s + 1 else ((), None)
            if w is not None:
                found[s] += [(w + x, ids + p) for x, p in found[e]]
    return sorted(found[0], key=lambda p: -p[0])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["the", "in", " ", "  ", "\n", "é", "😀", "a", "12", "er", "東"]), max_size=6).map("".join))
def test_n_best_equals_all_paths(text):
    s = pieces._segmenter(pieces.model_path())
    want = brute_paths(s.vocabulary, text)
    (ids, paths), = s.paths([text], 6)
    assert [p[0] for p in paths] == [w for w, _ in want[:6]]
    scores = dict((p, w) for w, p in want)
    spelled = [tuple(np.frombuffer(pieces.edited(ids, e), "<u4").tolist()) for _, e in paths]
    assert len(set(spelled)) == len(spelled) and [scores[p] for p in spelled] == [p[0] for p in paths]
    assert all(s.vocabulary.decode(p) == text for p in spelled)


@pytest.mark.parametrize("text", ["x" * 12, "a" * 11, "=" * 14, "ab" * 6, "a" * 7 + "=" * 6])
def test_n_best_of_runs_equals_all_paths(text, segmenter):
    want = brute_paths(segmenter.vocabulary, text)
    (_, paths), = segmenter.paths([text], 9)
    assert [p[0] for p in paths] == [w for w, _ in want[:9]]
    assert [w for w, _ in segmenter.vocabulary.n_best([pieces.SPACE + text], 9)] == [w for w, _ in want[:9]]


def test_arrays_and_single_units_agree(segmenter):
    v = segmenter.vocabulary
    rng = random.Random(2)
    for size in (1, 2, 7, 20):
        units = ["".join(rng.choice("theinrsaé▁東1") for _ in range(size)) for _ in range(60)]
        assert v.segment_many(units) == [(np.array(i, "<u4").tobytes(), w, g) for i, w, g in map(v.segment, units)]
    # a chain is searched as one lattice
    assert [s for s, _ in v.n_best(["▁the", "▁in"], 4)] == [w for w, _ in brute_paths(v, "the in")[:4]]


def test_library_agrees_on_plain_words(segmenter):
    model = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    import sentencepiece

    with open(pieces.model_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # read the pieces as a lattice
    lattice = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = random.Random(4)
    for _ in range(40):
        text = " ".join(rng.choice(["hello", "tokenization", "wörld", "the", "día", "Übergang"]) for _ in range(4))
        (ids, paths), = segmenter.paths([text], 5)
        theirs = [sum(float(segmenter.vocabulary.score[i]) for i in p) for p in lattice.nbest_encode_as_ids(text, 5)]
        assert [p[0] for p in paths] == theirs


def test_encode_and_decode_odd_rows(spark):
    df = odd.docs(spark)
    got = pieces.encode(df).withColumn("text", pieces.decoded("ids")).collect()
    assert Counter(r.text for r in got) == Counter((r.text or "").replace("▁", " ") for r in df.collect())
    for r in got:
        assert 1 <= len(r.paths) <= 4 and r.paths[0].n_pieces == len(r.ids) // 4 and r.paths[0].edits == []
        assert [p.score for p in r.paths] == sorted((p.score for p in r.paths), reverse=True)
        assert len({p.ids_crc32 for p in r.paths}) == len(r.paths)
    assert len(pieces.summary(pieces.encode(df)).collect()) == df.count()
    assert pieces.encode(odd.no_docs(spark)).collect() == []


# --- the pipeline --------------------------------------------------------------

def test_pipeline_equals_its_parts_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    identified = corpus_pipeline.identified(spark, docs, SF)
    rows = {r.doc_id: r for r in docs.collect()}
    left = {r.doc_id for r in identified.collect()}
    assert left == {i for i, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text), i)
    exact = corpus_pipeline.exact(spark, identified, SF)
    assert {r.doc_id for r in exact.collect()} == set(first.values())
    from tests.llm.test_dedup import python_near

    kept = {i for i, _, c, k in python_near([(i, rows[i].text) for i in first.values()]) if k}
    near = corpus_pipeline.near(spark, exact, SF)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == kept
    mixed = corpus_pipeline.mixed(spark, near, SF)
    ran = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in ran)
    v = pieces._segmenter(pieces.model_path()).vocabulary
    for r in ran:
        assert v.decode(np.frombuffer(r.ids, "<u4").tolist()) == rows[r.doc_id].text


def test_last_stage_decodes_what_it_encodes(spark):
    df = odd.docs(spark, [(1, "One two — 東京 😀 end", "en", "a", 0), (2, "", "en", "a", 0), (3, None, "en", "a", 0), (4, odd.prose(4, 500), "en", "a", 0)])
    want = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in df.collect()}
    got = corpus_pipeline.segmented(spark, df, SF).collect()
    assert {r.doc_id: r.pieces.decoded_sha256 for r in got} == want and all(r.pieces.paths for r in got)


def test_stages_on_odd_and_empty_rows(spark):
    for df in (odd.docs(spark), odd.no_docs(spark)):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            if stage is not corpus_pipeline.segmented:
                assert out.columns == docs.columns
                docs = spark.createDataFrame(rows, docs.schema)
        assert len(out.columns) == 3
        want = Counter((r.doc_id, hashlib.sha256((r.text or "").replace("▁", " ").encode()).hexdigest()) for r in docs.collect())
        assert Counter((r.doc_id, r.pieces.decoded_sha256) for r in rows) == want


def test_drops_use_what_the_operators_say(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in exact_dedup.drop_copies(df).collect()} == {r.doc_id for r in exact_dedup.exact_groups(df).collect() if r.kept}
    assert {r.doc_id for r in near_dedup.drop_near_copies(df).collect()} == {r.doc_id for r in near_dedup.near_groups(df).collect() if r.kept}
