"""Queries without a SQL twin, checked against plain-Python brute force on the
whole sf0.001 tables (small enough to collect in a test)."""

from __future__ import annotations

from topicspark.operators import text as X
from topicspark.plans import fixtures as fx
from topicspark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def _greedy_join(sent: list[str], phrases: set[str], lengths: list[int]) -> list[str]:
    """The phrase of longest text first, then leftmost; spans never overlap."""
    cands = []
    for n in lengths:
        for i in range(len(sent) - n + 1):
            key = " ".join(sent[i:i + n])
            if key in phrases:
                cands.append((-len(key), i, i + n, key))
    taken: list[tuple[int, int, str]] = []
    for _, s, e, key in sorted(cands):
        if all(e <= a or b <= s for a, b, _ in taken):
            taken.append((s, e, key))
    starts = {s: (e, key) for s, e, key in taken}
    out, i = [], 0
    while i < len(sent):
        if i in starts:
            e, key = starts[i]
            out.append(key.replace(" ", "_"))
            i = e
        else:
            out.append(sent[i])
            i += 1
    return out


def test_join_ngrams_query_equals_brute_force(spark):
    got = {r.doc_id: r.doc for r in QUERIES["join_ngrams"](spark, SF).collect()}

    parts = fx.table(spark, SF, "part").select("p_name")
    phrases = {r.ngram.strip() for r in X.build_ngram_list(parts.withColumnRenamed("p_name", "value")).collect()}
    phrases = {p for p in phrases if " " in p}
    lengths = sorted({len(p.split(" ")) for p in phrases})
    docs = X.filter_tokens(X.tokenize_sentences(fx.table(spark, SF, "documents")))
    want = {r.doc_id: " ".join(t for s in r.sents for t in _greedy_join(list(s), phrases, lengths))
            for r in docs.collect()}

    assert got == want


def test_join_ngrams_corpus_phrases_equal_brute_force(spark):
    """Overlapping 2- and 3-grams taken from the corpus itself, so longest-first
    and the tie rules decide many spans."""
    docs = X.filter_tokens(X.tokenize_sentences(fx.table(spark, SF, "documents")))
    rows = docs.collect()
    phrases = set()
    for r in rows[::7]:
        for s in r.sents[:1]:
            for n in (2, 3):
                phrases.update(" ".join(s[i:i + n]) for i in range(0, len(s) - n + 1, 2))
    ng = spark.createDataFrame([(p,) for p in sorted(phrases)], "ngram string")
    got = {r.doc_id: r.sents for r in X.join_ngrams(docs, ng).collect()}
    want = {r.doc_id: [_greedy_join(list(s), phrases, [2, 3]) for s in r.sents] for r in rows}
    assert {k: [list(s) for s in v] for k, v in got.items()} == want
    assert sum(t.count("_") for v in want.values() for s in v for t in s) > 100


def test_merge_labels_query_equals_brute_force(spark):
    """Registered ``merge_labels`` vs a numpy loop: label vector = mean of its
    phrase vectors, pairs with cosine >= threshold, connected components merged
    into the label with most pairs (ties: smallest label), up to 4 rounds."""
    from collections import Counter

    import numpy as np

    from topicspark.plans.catalog_compare import PAIR_THRESHOLD

    got = sorted(tuple(r) for r in QUERIES["merge_labels"](spark, SF)
                 .select("iteration", "merged_into", "label").collect())

    rows = fx.fx_vec_phrases(spark, SF).collect()
    vec = {r.phrase: np.asarray(r.vec, dtype=float) for r in rows}
    label_of = {r.phrase: r.label.lower() for r in rows}
    want = []
    for it in range(4):
        members: dict[str, list] = {}
        for p, lab in label_of.items():
            members.setdefault(lab, []).append(vec[p])
        labs = sorted(members)
        m = np.array([np.mean(members[lab], axis=0) for lab in labs])
        nrm = np.linalg.norm(m, axis=1)
        sim = (m @ m.T) / np.outer(nrm, nrm)
        pairs = [(labs[i], labs[j]) for i in range(len(labs)) for j in range(i + 1, len(labs))
                 if sim[i, j] >= PAIR_THRESHOLD]
        if not pairs:
            break
        parent = {lab: lab for pr in pairs for lab in pr}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in pairs:
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        freq = Counter(lab for pr in pairs for lab in pr)
        comps: dict[str, list] = {}
        for lab in parent:
            comps.setdefault(root(lab), []).append(lab)
        plan = {}
        for labs_c in comps.values():
            rep = min(labs_c, key=lambda x: (-freq[x], x))
            plan.update({lab: rep for lab in labs_c})
        want += [(it, rep, lab) for lab, rep in plan.items()]
        label_of = {p: plan.get(lab, lab) for p, lab in label_of.items()}

    assert got == sorted(want)
    assert len(want) > 0


def _long_vectors(spark, rows):
    return spark.createDataFrame([(k, d, float(x)) for k, v in rows.items() for d, x in enumerate(v)], "label string, dim int, v double")


def test_similar_labels_equal_all_pairs(spark):
    """Whole embeddings as label vectors, some moved near others: pairs equal those
    of all similarities at every threshold, and few are left by the bound at 0.95."""
    import numpy as np
    from pyspark.sql import functions as F

    from topicspark.operators import thesaurus as H
    from topicspark.operators.vectors import cosine_bound, paired_in_blocks, unit_vectors, with_head

    table = fx.table(spark, SF, "embeddings").filter("embedding is not null").select("vec_id", "embedding").orderBy("vec_id").collect()
    rows = {f"l{r.vec_id}": np.asarray(r.embedding, dtype=float) for r in table}
    rng = np.random.default_rng(5)
    for i, name in enumerate(sorted(rows)[:30]):
        rows[f"near{i}"] = rows[name] + rng.normal(size=len(rows[name])) * np.linalg.norm(rows[name]) / 8 * (0.1 + i / 60)
    rows["zero"] = np.zeros(64)
    lvec = _long_vectors(spark, rows).checkpoint()
    sim = H.label_pairs_similarity(lvec).checkpoint()
    for threshold in (-0.1, 0.2, 0.95):
        want = {tuple(r) for r in H.similar_label_pairs(sim, threshold).collect()}
        got = [tuple(r) for r in H.similar_labels(lvec, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    v = with_head(unit_vectors(lvec, ["label"]))
    a, b = (v.select(F.col("label").alias(f"l{i}"), F.col("head").alias(f"h{i}"), F.col("rest").alias(f"r{i}")) for i in (1, 2))
    left = paired_in_blocks(a, b, (F.col("l1") < F.col("l2")) & (cosine_bound("h1", "r1", "h2", "r2") >= 0.95)).count()
    assert left < len(rows) * (len(rows) - 1) / 2 / 100


def test_similar_labels_of_changed_ones(spark):
    """Only pairs with a changed label, each once."""
    import numpy as np

    from topicspark.operators import thesaurus as H

    rng = np.random.default_rng(9)
    rows = {f"l{i}": rng.normal(size=6) for i in range(60)}
    lvec = _long_vectors(spark, rows)
    changed = {"l3", "l17", "l40", "l41"}
    every = {tuple(r) for r in H.similar_labels(lvec, 0.3).collect()}
    got = [tuple(r) for r in H.similar_labels(lvec, 0.3, spark.createDataFrame([(x,) for x in [*changed, "l3"]], "label string")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {p for p in every if set(p) & changed}
    assert any(set(p) <= changed for p in got) or len(got) > 4


def test_merge_labels_rounds_equal_brute_force(spark):
    """Several rounds, labels of unlike numbers of phrases, phrases without a vector."""
    import numpy as np

    from topicspark.operators import thesaurus as H

    rng = np.random.default_rng(0)
    centre = rng.normal(size=(4, 5))
    vec = {f"p{i}": centre[i % 4] + rng.normal(size=5) * 0.9 for i in range(80)}
    label_of = {p: f"L{i % 23:02d}" for i, p in enumerate(vec)}
    phrases = sorted(vec)
    thes = spark.createDataFrame([(i, p, label_of[p]) for i, p in enumerate(phrases)] + [(999, "unknown", "L99")], "pos long, phrase string, label string")
    vectors = spark.createDataFrame([(p, [float(x) for x in v]) for p, v in vec.items()], "word string, vec array<float>")
    steps, final = H.merge_labels(thes, vectors, threshold=0.7, max_iterations=6)
    got = {(r.iteration, r.label, r.merged_into) for r in steps.collect()}
    cur = {p: lab.lower() for p, lab in label_of.items()}
    f32 = {p: np.asarray(v, dtype="float32").astype(float) for p, v in vec.items()}
    want, rounds = set(), 0
    for it in range(6):
        labs = sorted(set(cur.values()))
        mean = {lab: np.mean([f32[p] for p in vec if cur[p] == lab], axis=0) for lab in labs}
        pairs = [(a, b) for i, a in enumerate(labs) for b in labs[i + 1:]
                 if mean[a] @ mean[b] / np.linalg.norm(mean[a]) / np.linalg.norm(mean[b]) >= 0.7]
        if not pairs:
            break
        rounds += 1
        group = {x: {x} for p in pairs for x in p}
        for a, b in pairs:
            both = group[a] | group[b]
            for x in both:
                group[x] = both
        freq = {x: sum(x in p for p in pairs) for x in group}
        plan = {x: min(g, key=lambda y: (-freq[y], y)) for x, g in group.items()}
        want |= {(it, x, m) for x, m in plan.items()}
        cur = {p: plan.get(lab, lab) for p, lab in cur.items()}
    assert rounds > 1
    assert got == want
    assert {r.phrase: r.label for r in final.collect()} == {**cur, "unknown": "l99"}


def test_grid_report_equals_reports_of_each_run(spark):
    """One plan for all runs: every run's rows are those of its own report."""
    from pyspark.sql import functions as F

    from topicspark.plans.catalog import Ctx
    from topicspark.plans.report import grid_report, model_report

    c = Ctx(spark, SF)
    n = c.topic_term.select("topic").distinct().count()
    # another run: other topics in other steps' shares, some words missing
    other = c.topic_term.filter(F.col("word_id") % 5 != 0).withColumn("topic", (F.col("topic") + 1) % n)
    tt = {"k3_a": c.topic_term, "k3_b": other}
    grid = grid_report(*[x.unionByName(y) for x, y in (
        [t.withColumn("model", F.lit(m)) for m, t in tt.items()], [c.share.withColumn("model", F.lit(m)) for m in tt])], c.thesaurus, c.word_vec)
    differ = []
    for part in ("topics", "topic_steps"):
        rows = {tuple(sorted(r.asDict().items(), key=str)) for r in grid[part].collect()}
        want = set()
        for m, t in tt.items():
            own = {tuple(sorted(r.asDict().items(), key=str)) for r in model_report(t, c.share, c.thesaurus, c.word_vec, model=m)[part].collect()}
            assert own and not own & want
            want |= own
        assert rows == want
        differ.append(len({r.top_words for r in grid[part].collect()}) > n)
    assert any(differ)
