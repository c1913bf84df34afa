"""Fitting topic models over a run grid.

The reference shells out to an external dynamic-topic-model binary for each
grid row. Here each run is fitted by expectation maximisation over tables:
  topic_term <model, topic, word_id, word, prob> (and step, where documents have
  one), doc_topic <model, doc_id, topic, weight>.

Documents are kept as their different words' ids and counts, in the order of steps.
A round hands each task the topic matrix, a table by (step, word), broadcast in parts
of bounded size; a task finds the mixtures of its documents and adds up what each word
gives to each topic. Only a task's sums are exchanged, and kept from round to round.
With steps, a topic's shares of a word are smoothed along them (``operators.chain``):
``topic_var`` is the variance of the chain, and with 0 all steps have the static
model. Of the matrix only broadcasts pass the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions import measured_broadcast, ordered_index
from topicspark.functions.ids import BROADCAST_BYTES, measured_bytes
from topicspark.functions.runs import handed, together
from topicspark.operators import chain
from topicspark.session import ensure_checkpoint_dir, stored, tidy

#: Prior weight of each word in a topic; rounds in which a document's mixture is found.
WORD_PRIOR, DOC_ROUNDS = 0.01, 20
#: Documents' words in a processor's cache, in arrays at once, and tokens in a task of a round; rows of an Arrow batch that is returned.
BLOCK_CELLS, CHUNK_WORDS, TASK_TOKENS, OUT_ROWS = 1 << 13, 1 << 18, 1 << 24, 1 << 16


# The run keys and the directory name are the on-disk interface.
def run_name(run: dict) -> str:
    return f"k{run['topics']}_a{run['alpha']}_var{run['topic_var']}"


def _mixed(counts: np.ndarray, probs: np.ndarray, starts: np.ndarray, alpha: float, rounds: int = DOC_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """``mixtures`` by rows: ``probs`` and what words give are words x topics, weights documents x topics.

    Documents of about one length are found together, as many as the processor's cache
    holds, filled up with words that are not there."""
    size, topics = np.diff(np.append(starts, len(counts))), probs.shape[1]
    theta, given = np.empty((len(starts), topics)), np.empty(probs.shape)
    order = np.argsort(size, kind="stable")
    sizes = size[order]
    i = 0
    while i < len(order):
        # the longest of n documents is the last one
        n = max(1, int(np.searchsorted(sizes[i:i + BLOCK_CELLS] * np.arange(1, len(sizes[i:i + BLOCK_CELLS]) + 1), BLOCK_CELLS, "right")))
        docs, longest = order[i:i + n], int(sizes[i + n - 1])
        i += n
        there = np.arange(longest) < size[docs][:, None]
        at = np.minimum(starts[docs][:, None] + np.arange(longest), len(counts) - 1)
        cnt = np.where(there, counts[at], 0.0)[:, None, :]
        b = np.ascontiguousarray(probs[at].transpose(0, 2, 1))
        new, r = np.full((n, 1, topics), 1 / topics), np.empty((n, 1, longest))
        for _ in range(rounds):
            own = new
            np.matmul(own, b, out=r)
            np.maximum(r, 1e-300, out=r)
            np.divide(cnt, r, out=r)
            new = np.matmul(b, r.reshape(n, longest, 1)).reshape(n, 1, topics) * own + alpha
            new /= new.sum(axis=2, keepdims=True)
        theta[docs] = new[:, 0]
        b *= own.reshape(n, topics, 1)
        b *= r
        given[at[there]] = b.transpose(0, 2, 1)[there]
    return theta, given


def mixtures(counts: np.ndarray, probs: np.ndarray, starts: np.ndarray, alpha: float, rounds: int = DOC_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of documents (topics x documents; each one's add up to 1) and
    what each of their words gives to each topic (topics x words), for word
    ``counts`` and their probabilities (topics x words). A document's words are
    next to each other; ``starts`` has the place of its first one."""
    theta, given = _mixed(counts, np.ascontiguousarray(probs.T), starts, alpha, rounds)
    return theta.T, given.T


def mixture(counts: np.ndarray, probs: np.ndarray, alpha: float, rounds: int = DOC_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """``mixtures`` of one document, with ``probs`` and the result as words x topics."""
    theta, given = mixtures(counts, np.ascontiguousarray(probs.T), np.zeros(1, int), alpha, rounds)
    return theta[:, 0], given.T


def _documents(batches, topics: int, alpha: float):
    """(rows, starts, theta, given) for rows <_doc, cnt, b ...> of whole documents, which are next to each other."""
    for rows, starts in together(batches, "_doc"):
        probs = np.asarray(pc.list_flatten(rows.column("b"))).reshape(-1, topics)
        yield rows, starts, *_mixed(rows.column("cnt").to_numpy().astype(float), probs, starts, alpha)


def _sums(step, word_ids, sums: np.ndarray):
    """Arrow batches <step, word_id, n0 ...> of sums (topics x words)."""
    names = ["step", "word_id", *[f"n{k}" for k in range(len(sums))]]
    yield from pa.table([pa.array(step), pa.array(word_ids), *[pa.array(n) for n in sums]], names).to_batches(OUT_ROWS)


def _word_gifts(topics: int, alpha: float):
    def run(batches):
        for rows, _, _, given in _documents(batches, topics, alpha):
            yield from _sums(rows.column("step").to_numpy(), rows.column("word_id").to_numpy().astype(np.int64), np.ascontiguousarray(given.T))
    return run


def _weights(theta: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(theta) + 1) * theta.shape[1], pa.int32()), pa.array(theta.ravel()))


def _doc_weights(topics: int, alpha: float):
    def run(batches):
        for rows, starts, theta, _ in _documents(batches, topics, alpha):
            yield pa.RecordBatch.from_arrays([pa.array(rows.column("_doc").to_numpy()[starts]), _weights(theta)], ["_doc", "theta"])
    return run


def _packed(matrix: DataFrame, topics: int, first: int = 0, n_steps: int = 1) -> DataFrame:
    """One row ``m`` of a topic matrix <word_id, b (steps x topics)>, from step ``first`` on: words and probabilities, as bytes."""
    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("word_id").to_numpy().tobytes()], pa.binary()),
                                                  pa.array([np.asarray(pc.list_flatten(batch.column("b"))).tobytes()], pa.binary())], ["at", "b"])
    rows = matrix.select("word_id", F.slice("b", first * topics + 1, n_steps * topics).alias("b"))
    return rows.mapInArrow(pack, "at binary, b binary").groupBy().agg(F.collect_list(F.struct("at", "b")).alias("m"))


def _held_documents(batches, topics: int, n_words: int, alpha: float, first: int):
    """(batch, documents of one step, that step, their word ids, theta, given) for rows
    <step, word_ids, cnt, m ...>, the first of which has the topic matrix (``_packed``).
    ``first`` is the first step of the matrix; None if it has one for all steps."""
    matrix = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if matrix is None:
            for x in batch.column("m")[0].values:
                at, b = np.frombuffer(x["at"].as_py(), np.int64), np.frombuffer(x["b"].as_py())
                b = b.reshape(len(at), -1, topics).transpose(1, 0, 2)
                matrix = np.zeros((len(b), n_words, topics)) if matrix is None else matrix
                matrix[:, at] = b
            matrix = matrix.reshape(-1, topics)
        step, offsets = batch.column("step").to_numpy(), batch.column("word_ids").offsets.to_numpy()
        ids, counts = np.asarray(batch.column("word_ids").values), np.asarray(batch.column("cnt").values)
        shift = int(batch.column("cnt").offsets[0].as_py()) - int(offsets[0])
        # documents of one step, up to so many words at once
        i = 0
        while i < len(step):
            ahead = step[i:] != step[i]
            j = i + (int(ahead.argmax()) if ahead.any() else len(ahead))
            j = min(j, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_WORDS, "right")) - 1))
            own = ids[offsets[i]:offsets[j]].astype(np.int64)
            at = own if first is None else own + (int(step[i]) - first) * n_words
            theta, given = _mixed(counts[offsets[i] + shift:offsets[j] + shift].astype(float), matrix[at], offsets[i:j] - offsets[i], alpha)
            yield batch, slice(i, j), step[i], own, theta, given
            i = j


def _held_gifts(topics: int, n_words: int, alpha: float, first: int):
    """What the words of a task's documents give in a step, summed up as long as documents of that step come."""
    def run(batches):
        of, sums, seen = None, np.zeros((topics, n_words)), np.zeros(n_words, bool)

        def flush():
            own = np.flatnonzero(seen)
            yield from _sums(np.full(len(own), of, np.int32), own, sums[:, own])
            sums[:], seen[:] = 0, False
        for _, _, step, ids, _, given in _held_documents(batches, topics, n_words, alpha, first):
            if of is not None and step != of:
                yield from flush()
            of = step
            seen[ids] = True
            for k in range(topics):
                sums[k] += np.bincount(ids, given[:, k], n_words)
        if of is not None:
            yield from flush()
    return run


def _held_weights(topics: int, n_words: int, alpha: float, first: int):
    def run(batches):
        for batch, docs, _, _, theta, _ in _held_documents(batches, topics, n_words, alpha, first):
            yield pa.RecordBatch.from_arrays([batch.column("key")[docs.start:docs.stop], _weights(theta)], ["key", "theta"])
    return run


def _counts(n_words: int):
    """<_doc, key, step, word_ids, cnt> of rows <_doc, key, step, word_id>, a document's next to each other."""
    def run(batches):
        for rows, starts in together(batches, "_doc"):
            doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
            pairs = np.sort(doc * n_words + rows.column("word_id").to_numpy())
            at = np.append(0, np.flatnonzero(pairs[1:] != pairs[:-1]) + 1)
            doc, ids = np.divmod(pairs[at], n_words)
            offsets = pa.array(np.searchsorted(doc, np.arange(len(starts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, np.diff(np.append(at, len(pairs))))]
            own = rows.select(["_doc", "key", "step"]).take(starts).combine_chunks()
            yield from pa.table([*own.columns, *lists], ["_doc", "key", "step", "word_ids", "cnt"]).to_batches()
    return run


def _counted(docs: DataFrame, tokens: str, key: str, step: str | None):
    """Words <word_id, word>; steps <step, place>; documents <_doc, key, step (its place),
    word_ids, cnt>, by step; the number of words. Documents without words or step are left out."""
    spark = docs.sparkSession
    at = F.lit(0) if step is None else F.col(step)
    rows, drop = stored(docs.select(F.monotonically_increasing_id().alias("_doc"), F.col(key).alias("key"), at.alias("step"), F.col(tokens).alias("tokens")))
    words = rows.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    voc = ordered_index(words, [F.desc("n"), "word"], "word_id").select("word_id", "word", "n").checkpoint(eager=True)
    n_words, n_tokens = voc.select(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    voc = voc.select("word_id", "word")
    # one row for each step, with the number of tokens before it
    with_words = rows.where(F.col("step").isNotNull() & F.exists("tokens", lambda x: x.isNotNull()))
    steps = ordered_index(with_words.groupBy("step").agg(F.sum(F.size("tokens")).alias("n")), ["step"], "place").withColumn("place", F.col("place").cast("int"))
    steps = steps.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).checkpoint(eager=True)
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, n_tokens // 500_000), n_tokens // TASK_TOKENS)
    placed = rows.join(measured_broadcast(steps), "step")
    # where in the order of steps a document is dealt to: steps in a row, tasks of about as many tokens
    share = (F.col("before") + F.col("n") * F.pmod(F.xxhash64("_doc"), F.lit(1 << 20)) / F.lit(1 << 20)) / F.lit(max(1, n_tokens))
    task = F.least(F.floor(share * tasks), F.lit(tasks - 1)).cast("int")
    small = measured_bytes(voc) <= BROADCAST_BYTES and n_words < 1 << 31
    if small:  # documents stay as they are
        each = placed.select("_doc", "key", F.col("place").alias("step"), F.explode("tokens").alias("word")).join(F.broadcast(voc), "word")
        kind = placed.schema["key"].dataType.simpleString()
        own = each.select("_doc", "key", "step", "word_id").mapInArrow(_counts(n_words), f"_doc long, key {kind}, step int, word_ids array<int>, cnt array<int>")
    else:
        each = placed.select("_doc", F.explode("tokens").alias("word")).join(voc, "word").groupBy("_doc", "word_id").agg(F.count(F.lit(1)).cast("int").alias("cnt"))
        own = each.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("word_id", "cnt"))).alias("w"))
        own = own.join(placed.select("_doc", "key", F.col("place").alias("step")), "_doc").select("_doc", "key", "step", F.col("w.word_id").alias("word_ids"), F.col("w.cnt").alias("cnt"))
    by = steps.select(F.col("place").alias("step"), "before", "n")
    own = own.join(measured_broadcast(by), "step").withColumn("_task", task).repartitionById(tasks, "_task").sortWithinPartitions("step").select("_doc", "key", "step", "word_ids", "cnt")
    own = own.checkpoint(eager=True)
    drop()
    tidy(spark)
    return voc, steps.select("step", "place"), own, max(1, n_words)


def _asked(own: DataFrame, matrix: DataFrame, on: list[str], n_rows: int, topics: int) -> DataFrame:
    """<_doc, step, word_id, cnt, b>: documents' words with their row of ``matrix``
    (``n_rows`` at most), a document's next to each other."""
    pairs = own.select("_doc", "step", F.explode(F.arrays_zip("word_ids", "cnt")).alias("w")).select("_doc", "step", "w.word_ids", "w.cnt").withColumnRenamed("word_ids", "word_id")
    cols = ["_doc", "step", "word_id", "cnt", "b"]
    if n_rows * (8 * topics + 64) <= BROADCAST_BYTES:  # documents stay as they are
        return pairs.join(F.broadcast(matrix), on).select(*cols)
    return pairs.join(matrix, on).select(*cols).repartition("_doc").sortWithinPartitions("_doc", "word_id")


def _smoothed(topics: int, n_words: int, word_prior: float):
    """Rows <word_id, b (steps x topics)> of the words' series <word_id, at, tokens ...>; the first row has the topics' tokens and gains."""
    # the prior stands for ``word_prior`` tokens of each word beside a million, so no word is impossible
    prior = word_prior * n_words / 1e6

    def run(batches):
        tokens = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if tokens is None:
                tokens, gain, back = (np.array(batch.column(c)[0].as_py(), float).T for c in ("tokens", "gain", "back"))
            rows = max(1, CHUNK_WORDS // tokens.size)
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                series, size = part.column("at").flatten(), np.diff(part.column("at").offsets.to_numpy())
                shares = np.zeros((part.num_rows, *tokens.shape))
                shares[np.repeat(np.arange(len(size)), size), series.field("step").to_numpy()] = np.asarray(pc.list_flatten(series.field("n"))).reshape(-1, topics)
                shares = np.divide(shares, tokens, out=np.zeros_like(shares), where=tokens > 0)
                b = (np.maximum(chain.smoothed_rows(shares, gain, back), 0.0) + prior / n_words) / (1 + prior)
                yield pa.RecordBatch.from_arrays([part.column("word_id"), _weights(b.reshape(len(b), -1))], ["word_id", "b"])
    return run


def _shares(series: DataFrame, steps: DataFrame, topics: int, n_words: int, chain_var: float, word_prior: float) -> DataFrame:
    """The topic matrix <word_id, b (steps x topics)> of <word_id, at (steps and what the word gave there)>; a step is its place in ``steps``."""
    totals = series.select(F.explode("at").alias("x")).groupBy(F.col("x.step").alias("place")).agg(*[F.sum(F.col("x.n")[k]).alias(f"t{k}") for k in range(topics)])
    # one row for each step, then one for each topic with its weights, then one
    totals = steps.select("place").join(totals, "place", "left").select("place", F.posexplode(F.array(*[F.coalesce(F.col(f"t{k}"), F.lit(0.0)) for k in range(topics)])).alias("topic", "t"))
    by_topic = totals.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]).alias("tokens"))
    by_topic = by_topic.select("topic", "tokens", chain.gains(F.col("tokens"), chain_var).alias("w"))
    every = by_topic.groupBy().agg(F.array_sort(F.collect_list(F.struct("topic", "tokens", F.col("w.gain").alias("gain"), F.col("w.back").alias("back")))).alias("w"))
    rows = handed(series, every.select(*[F.col(f"w.{c}").alias(c) for c in ("tokens", "gain", "back")]))
    return rows.mapInArrow(_smoothed(topics, n_words, word_prior), "word_id long, b array<double>")


def _round(own: DataFrame, matrix: DataFrame, topics: int, alpha: float, n_words: int, n_steps: int | None):
    """What each word gives to each topic, <word_id, at: array<struct<step, n>>>, and a
    function that makes the documents' mixtures <key, theta> behind it.

    A matrix of bounded size is handed to each task whole; a larger one by parts, of as many
    steps as are of bounded size, each to the documents of its steps. Where one step's
    is larger, documents' words are joined to it. ``n_steps`` is None for a matrix without steps."""
    schema = "step int, word_id long, " + ", ".join(f"n{k} double" for k in range(topics))
    step_bytes = n_words * (8 * topics + 8)
    at_once = 0 if step_bytes > BROADCAST_BYTES else max(1, BROADCAST_BYTES // 2 // step_bytes)

    def added(given):
        # a task has added up its words: they meet by word, and stay there
        counts = given.repartition("word_id").groupBy("word_id", "step").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(topics)])
        n = F.array(*[F.col(f"n{k}") for k in range(topics)]).alias("n")
        return counts.groupBy("word_id").agg(F.collect_list(F.struct("step", n)).alias("at")).checkpoint(eager=True)

    def joined():
        if n_steps is None:
            return _asked(own, matrix, ["word_id"], n_words, topics)
        by_step = F.transform(F.sequence(F.lit(0), F.lit(n_steps - 1)), lambda i: F.slice("b", i * topics + 1, topics))
        rows = matrix.select("word_id", F.posexplode(by_step).alias("step", "b"))
        return _asked(own, rows, ["step", "word_id"], n_words * n_steps, topics)

    def joined_mixtures():
        return joined().mapInArrow(_doc_weights(topics, alpha), "_doc long, theta array<double>").join(own.select("_doc", "key"), "_doc").select("key", "theta")
    if not at_once:
        return added(joined().mapInArrow(_word_gifts(topics, alpha), schema)), joined_mixtures
    docs = own.select("key", "step", "word_ids", "cnt")
    if n_steps is None or n_steps <= at_once:
        first = None if n_steps is None else 0
        one = _packed(matrix, topics, 0, n_steps or 1)
        kind = f"key {own.schema['key'].dataType.simpleString()}, theta array<double>"
        return (added(handed(docs.drop("key"), one).mapInArrow(_held_gifts(topics, n_words, alpha, first), schema)),
                lambda: handed(docs, one).mapInArrow(_held_weights(topics, n_words, alpha, first), kind))
    matrix = matrix.checkpoint(eager=True)
    given = None
    for first in range(0, n_steps, at_once):
        part = docs.drop("key").where(F.col("step").between(first, first + at_once - 1))
        part = handed(part, _packed(matrix, topics, first, at_once)).mapInArrow(_held_gifts(topics, n_words, alpha, first), schema).checkpoint(eager=True)
        tidy(own.sparkSession)
        given = part if given is None else given.unionByName(part)
    return added(given), joined_mixtures


def fit_topics_grid(docs: DataFrame, runs: list[dict], tokens: str = "tokens", key: str = "doc_id",
                    max_iter: int = 10, seed: int = 0, step: str | None = None, word_prior: float = WORD_PRIOR):
    """Fit one model per run ({topics, alpha, topic_var}); returns (topic_term, doc_topic).

    Every word of ``docs`` is in the model: rare words are dropped before, by
    the vocabulary's frequency rule. With ``step``, a column of the documents,
    topic_term has a row for each step too, and ``topic_var`` is the variance of
    a topic's chain over the steps; without, models are static. Documents
    without words or step have no row. Each round is checkpointed.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    voc, steps, own, n_words = _counted(docs, tokens, key, step)
    n_steps = max(1, steps.count())
    words = measured_broadcast(voc)
    tts, dts = [], []
    for run in runs:
        topics, alpha, name = int(run["topics"]), float(run["alpha"]), run_name(run)
        # seeded start: about even shares, the same in all steps
        noise = F.transform(F.sequence(F.lit(0), F.lit(topics - 1)), lambda k: (1 + F.pmod(F.xxhash64(F.lit(seed), "word", k), F.lit(1000)) / 1000) / (1.5 * n_words))
        matrix, of_steps = voc.select("word_id", noise.alias("b")), None
        for _ in range(max(1, max_iter)):
            series, mixed = _round(own, matrix, topics, alpha, n_words, of_steps)
            matrix = _shares(series, steps, topics, n_words, float(run["topic_var"]) if step else 0.0, word_prior)
            of_steps = n_steps
            tidy(spark)
        tts.append(matrix.join(words, "word_id").select(F.lit(name).alias("model"), F.lit(topics).alias("topics"), "word_id", "word", "b"))
        # the mixtures behind the last round's counts, made when they are read
        dts.append(mixed().select(F.lit(name).alias("model"), F.col("key").alias(key), F.posexplode("theta").alias("topic", "weight")))
    rows, doc_topic = tts[0], dts[0]
    for t, d in zip(tts[1:], dts[1:]):
        rows, doc_topic = rows.unionByName(t), doc_topic.unionByName(d)
    # dealt by word while a word is one row: what is counted or added up by words later needs no exchange of each cell
    rows = rows.repartition("word").select("model", "topics", "word_id", "word", F.posexplode("b").alias("at", "prob"))
    rows = rows.withColumn("topic", F.col("at") % F.col("topics"))
    if step:
        rows = rows.withColumn("place", ((F.col("at") - F.col("topic")) / F.col("topics")).cast("int")).join(measured_broadcast(steps), "place")
    return rows.select("model", "topic", *(["step"] if step else []), "word_id", "word", "prob"), doc_topic
