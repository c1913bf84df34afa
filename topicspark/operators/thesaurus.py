"""Thesaurus normalisation and label merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.functions import bounded_broadcast, ordered_index, strip_label_code
from topicspark.operators.labels import phrase_vectors
from topicspark.operators.vectors import cosine_bound, dot, paired_in_blocks, unit_vectors, with_head
from topicspark.session import ensure_checkpoint_dir

# Label correction map applied after lowercasing (and remapping).
LABEL_CORRECTIONS = {
    "6626 soft energy": "6626 renewable energy",
    "6616 oil industry": "6616 oil and gas industry",
}

# Default label remapping, applied before the corrections.
LABEL_REMAPPING = {
    "1621 economic structure": "1611 economic conditions",
    "2006 trade policy": "2016 business operations and trade",
    "2421 free movement of capital": "2016 business operations and trade",
    "2016 trade": "2016 business operations and trade",
    "4006 business organisation": "2016 business operations and trade",
    "4016 legal form of organisations": "2016 business operations and trade",
    "2426 financing and investment": "2016 business operations and trade",
    "2026 consumption": "2016 business operations and trade",
}

# Named representative of each label category for category merging.
CATEGORY_NAMES = [
    "0406 political framework", "0821 defence", "1011 European Union law", "1221 justice",
    "1606 economic policy", "2016 trade", "2426 financing and investment", "2841 health",
    "3206 education", "3606 natural and applied sciences", "4006 business organisation",
    "4406 employment", "4811 organisation of transport", "5206 environmental policy",
    "5606 agricultural policy", "6026 foodstuff", "6406 production", "6606 energy policy",
    "6621 electrical and nuclear industries", "6616 oil industry", "6626 soft energy",
    "6611 coal and mining industries", "6806 industrial structures and policy",
    "7231 economic geography", "7621 world organisations",
]


def _lookup(c: Column, mapping: dict) -> Column:
    """coalesce(mapping[c], c) with a small literal map."""
    if not mapping:
        return c
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)


def normalise_labels(thes: DataFrame, cols=("MT", "domain"), remap: bool = True,
                     remapping: dict | None = None, corrections: dict | None = None) -> DataFrame:
    """Lowercase, remap (optional), then correct labels, in that order."""
    rm = LABEL_REMAPPING if remapping is None else remapping
    cr = LABEL_CORRECTIONS if corrections is None else corrections
    out = thes
    for c in cols:
        v = F.lower(F.col(c))
        if remap:
            v = _lookup(v, rm)
        out = out.withColumn(c, _lookup(v, cr))
    return out


def read_whitelist(lines: DataFrame, col: str = "value") -> DataFrame:
    """Label list, stripped and lowercased: <label>."""
    return lines.select(F.lower(F.trim(F.col(col))).alias("label")).filter(F.col("label") != "")


def whitelist_labels(thes: DataFrame, whitelist: DataFrame, col: str = "MT", order: str = "pos",
                     check: bool = True) -> DataFrame:
    """Keep rows whose label is whitelisted, check every whitelisted label is
    present, and renumber rows (``index``) in thesaurus order."""
    wl = whitelist.select(F.col("label").alias("_wl")).distinct()
    kept = thes.join(bounded_broadcast(wl), F.lower(F.col(col)) == F.col("_wl"), "left_semi")
    if check:
        present = kept.select(F.lower(F.col(col)).alias("_wl")).distinct()
        missing = wl.join(present, "_wl", "left_anti").limit(20).collect()
        if missing:
            raise ValueError(f"whitelisted labels not in the thesaurus: {[r[0] for r in missing]}")
    return ordered_index(kept, [F.col(order)], "index")


def label_pairs_similarity(lvec: DataFrame) -> DataFrame:
    """<l1, l2, similarity> for l1 < l2 (upper triangle of the label cosine matrix).

    Pairs of blocks of labels meet once (block i <= j) and the order of the
    labels is tested inside, before any further shuffle.
    """
    v = unit_vectors(lvec, ["label"])
    pairs = paired_in_blocks(v.select(F.col("label").alias("l1"), F.col("u").alias("u1")),
                             v.select(F.col("label").alias("l2"), F.col("u").alias("u2")), F.col("l1") < F.col("l2"))
    return pairs.select("l1", "l2", dot("u1", "u2").alias("similarity"))


def similar_label_pairs(sim: DataFrame, threshold: float = 0.95) -> DataFrame:
    return sim.filter(F.col("similarity") >= threshold).select("l1", "l2")


def similar_labels(lvec: DataFrame, threshold: float = 0.95, changed: DataFrame | None = None) -> DataFrame:
    """<l1, l2> with l1 < l2 and a cosine of at least ``threshold``: the pairs of
    ``similar_label_pairs`` without the similarities of all others.

    A bound from the first dimensions and the lengths of the rest discards most
    pairs inside the join, before their dot product. With ``changed`` <label>,
    only pairs with at least one of these labels are made.
    """
    v = with_head(unit_vectors(lvec, ["label"]).filter(F.col("u").isNotNull()))
    if changed is None:
        v = v.withColumn("new", F.lit(True))
    else:
        marks = changed.select("label").distinct().withColumn("new", F.lit(True))
        v = v.join(bounded_broadcast(marks), "label", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    a, b = (v.select(F.col("label").alias(f"l{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("u", "head", "rest", "new")]) for i in (1, 2))
    # a pair of two changed labels meets twice, with another label once
    once = ~F.col("new2") | (F.col("l1") < F.col("l2"))
    near = once & (cosine_bound("head1", "rest1", "head2", "rest2") >= threshold) & (dot("u1", "u2") >= threshold)
    pairs = paired_in_blocks(a.filter("new1"), b, near)
    return pairs.select(F.least("l1", "l2").alias("l1"), F.greatest("l1", "l2").alias("l2"))


def merge_plan(pairs: DataFrame) -> DataFrame:
    """Connected components of the pair graph: <label, merged_into, group_size>.

    Each round takes the smallest component among a label's neighbours and then
    jumps to that component's own one, so rounds grow with the logarithm of the
    longest chain; they end when nothing changes. Lineage is cut by a checkpoint
    per round. The representative is the label that occurs in most pairs, ties
    by label asc (Q22).
    """
    spark = pairs.sparkSession
    ensure_checkpoint_dir(spark)
    edges = pairs.select(F.col("l1").alias("a"), F.col("l2").alias("b")).union(
        pairs.select(F.col("l2").alias("a"), F.col("l1").alias("b"))).distinct().checkpoint(eager=True)
    comp = edges.groupBy(F.col("a").alias("label")).agg(F.least("label", F.min("b")).alias("comp")).checkpoint(eager=True)
    changed = True
    while changed:
        near = edges.join(comp.withColumnRenamed("label", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        least = comp.join(near.withColumnRenamed("a", "label"), "label").select("label", "comp", F.least("comp", "near").alias("next"))
        jump = comp.select(F.col("label").alias("next"), F.col("comp").alias("jump"))
        new = least.join(jump, "next").select("label", F.col("comp").alias("old"), F.least("next", "jump").alias("comp")).checkpoint(eager=True)
        changed = not new.filter(F.col("comp") != F.col("old")).isEmpty()
        comp = new.select("label", "comp")
    freq = pairs.select(F.explode(F.array("l1", "l2")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("freq"))
    cf = comp.join(freq, "label")
    groups = cf.groupBy("comp").agg(F.min(F.struct((-F.col("freq")).alias("f"), "label")).alias("m"), F.count(F.lit(1)).alias("group_size"))
    return cf.join(groups, "comp").select("label", F.col("m.label").alias("merged_into"), "group_size")


def merge_groups(plan: DataFrame) -> DataFrame:
    """<merged_into, labels array> view of a plan."""
    return plan.groupBy("merged_into").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def merge_labels(thes: DataFrame, vectors: DataFrame, threshold: float = 0.95, max_iterations: int = 4,
                 label_col: str = "label"):
    """Repeat: label vectors -> similar pairs -> plan -> rename, until no pairs.

    Returns (steps <iteration, merged_into, label>, final thesaurus). The loop
    condition is the only driver-side value; each round is checkpointed.

    Sums and counts of a label's phrase vectors add up, so a round makes new
    ones for the merged labels only. Labels that a round leaves alone are not
    similar to each other: later rounds compare the merged ones with all.
    """
    spark = thes.sparkSession
    ensure_checkpoint_dir(spark)
    cur = thes.withColumn(label_col, F.lower(F.col(label_col))).checkpoint(eager=True)
    pvec = phrase_vectors(cur.select("pos", "phrase", F.col(label_col).alias("label")), vectors)
    sums = pvec.groupBy("label", "dim").agg(F.sum("v").alias("s"), F.count("v").alias("n")).checkpoint(eager=True)
    steps = changed = None
    for it in range(max_iterations):
        lvec = sums.select("label", "dim", (F.col("s") / F.col("n")).alias("v"))
        pairs = similar_labels(lvec, threshold, changed).checkpoint(eager=True)
        if pairs.isEmpty():
            break
        plan = merge_plan(pairs).select("label", "merged_into").checkpoint(eager=True)
        step = plan.select(F.lit(it).alias("iteration"), "merged_into", "label")
        steps = step if steps is None else steps.unionByName(step)
        merged = sums.join(plan, "label").groupBy(F.col("merged_into").alias("label"), "dim") \
            .agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        sums = sums.join(plan, "label", "left_anti").unionByName(merged).checkpoint(eager=True)
        changed = plan.select(F.col("merged_into").alias("label"))
        mp = plan.select(F.col("label").alias("_l"), F.col("merged_into").alias("_m"))
        cur = cur.join(bounded_broadcast(mp), F.col(label_col) == F.col("_l"), "left") \
            .withColumn(label_col, F.coalesce("_m", label_col)).drop("_l", "_m").checkpoint(eager=True)
    if steps is None:
        steps = spark.createDataFrame([], "iteration int, merged_into string, label string")
    return steps, cur


def apply_merge_steps(thes: DataFrame, steps: DataFrame, col: str = "MT") -> DataFrame:
    """Replay recorded steps <iteration, merged_into, label> on a thesaurus, in order."""
    its = [r[0] for r in steps.select("iteration").distinct().orderBy("iteration").collect()]  # bounded: #rounds
    out = thes
    for it in its:
        mp = steps.filter(F.col("iteration") == it).select(F.col("label").alias("_l"), F.col("merged_into").alias("_m"))
        out = out.join(bounded_broadcast(mp), F.col(col) == F.col("_l"), "left") \
            .withColumn(col, F.coalesce("_m", col)).drop("_l", "_m")
    return out


def merge_by_category(thes: DataFrame, col: str = "MT", names: list[str] | None = None,
                      skip_prefix: str = "66") -> DataFrame:
    """Group distinct labels by their 2-digit prefix; merge each category into its
    named representative, except categories starting with ``skip_prefix``.
    Returns steps <iteration=0, merged_into, label>."""
    nm = CATEGORY_NAMES if names is None else names
    labels = thes.select(F.col(col).alias("label")).distinct() \
        .withColumn("cat", F.regexp_extract("label", r"^(\d{2})", 1)).filter(F.col("cat") != "")
    # names are compared in lower case: labels may have been lowercased before
    reps = labels.filter(F.lower("label").isin([x.lower() for x in nm])).select("cat", F.col("label").alias("merged_into"))
    keep = labels.filter(~F.col("cat").startswith(skip_prefix))
    return keep.join(reps, "cat").select(F.lit(0).alias("iteration"), "merged_into", "label")


__all__ = [
    "normalise_labels", "read_whitelist", "whitelist_labels", "strip_label_code", "label_pairs_similarity",
    "similar_label_pairs", "similar_labels", "merge_plan", "merge_groups", "merge_labels", "apply_merge_steps", "merge_by_category",
]
