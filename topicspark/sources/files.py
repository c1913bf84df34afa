"""Readers for corpora, word lists and topic-model output files.

Files whose line number carries meaning (vocabulary id, document order, matrix
cell) get an explicit position column from ``line_index``; nothing later
depends on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.functions import line_index, measured_broadcast


def read_corpus(spark: SparkSession, path: str, fmt: str | None = None, schema=None, multiline: bool = True) -> DataFrame:
    """Corpus by extension: ``.tsv`` (tab), ``.parquet`` (the pickle stand-in), else CSV.

    CSV text fields may hold quoted newlines; such a file is one task. Pass
    ``multiline=False`` where they don't, and large files are split. Pass a
    ``schema`` to spare the pass that infers one.
    """
    fmt = fmt or ("tsv" if path.endswith(".tsv") else "parquet" if path.endswith(".parquet") else "csv")
    if fmt == "parquet":
        return spark.read.parquet(path)
    r = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    r = r.option("sep", "\t" if fmt == "tsv" else ",")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """<file_path, line, value> for one file or a glob."""
    return line_index(spark.read.text(path), "line")


def parse_corpus(lines: DataFrame, schema: str, sep: str = ",") -> DataFrame:
    """Corpus records, one CSV record per ``value`` (quoted newlines inside), as columns."""
    rec = F.from_csv("value", schema, {"sep": sep, "escape": '"', "multiLine": "true"})
    return lines.select(rec.alias("r")).select("r.*")


def parse_whitelist(lines: DataFrame) -> DataFrame:
    """Label list, stripped and lowercased: <label>."""
    return lines.select(F.lower(F.trim("value")).alias("label")).filter(F.col("label") != "")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return parse_whitelist(spark.read.text(path))


def parse_ngrams(lines: DataFrame) -> DataFrame:
    """N-gram list, longest first (ties by text): <ngram>."""
    t = lines.select(F.trim("value").alias("ngram")).filter(F.col("ngram") != "")
    return t.orderBy(F.length("ngram").desc(), "ngram")


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    return parse_ngrams(spark.read.text(path))


def parse_vocab(lines: DataFrame) -> DataFrame:
    """``word\\tcount`` (or ``word`` only, static models, Q25); line = word_id."""
    parts = F.split(F.col("value"), "\t")
    return lines.select(F.col("line").alias("word_id"), F.trim(parts[0]).alias("word"),
                        F.get(parts, 1).try_cast("long").alias("cnt"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return parse_vocab(read_lines(spark, path))


def _filled(lines: DataFrame) -> DataFrame:
    return lines.filter(F.trim("value") != "")


def parse_doc_steps(lines: DataFrame) -> DataFrame:
    """Step of each document, by line: <doc_idx, step>."""
    return _filled(lines).select(F.col("line").alias("doc_idx"), F.trim("value").cast("int").alias("step"))


def read_doc_steps(spark: SparkSession, path: str) -> DataFrame:
    return parse_doc_steps(read_lines(spark, path))


def parse_step_counts(lines: DataFrame) -> DataFrame:
    """Header (number of steps) then documents per step: <step_idx, n_docs>."""
    return _filled(lines).filter(F.col("line") > 0).select((F.col("line") - 1).cast("int").alias("step_idx"),
                                                           F.trim("value").cast("long").alias("n_docs"))


def read_step_counts(spark: SparkSession, path: str) -> DataFrame:
    return parse_step_counts(read_lines(spark, path))


def parse_doc_topic(lines: DataFrame, n_topics: int) -> DataFrame:
    """1-D gamma file (doc-major): line i -> doc i // K, topic i % K: <doc_idx, topic, weight>."""
    return _filled(lines).select(F.floor(F.col("line") / n_topics).cast("long").alias("doc_idx"),
                                 (F.col("line") % n_topics).cast("int").alias("topic"),
                                 F.trim("value").cast("double").alias("weight"))


def read_doc_topic(spark: SparkSession, path: str, n_topics: int) -> DataFrame:
    return parse_doc_topic(read_lines(spark, path), n_topics)


TOPIC_FILE = r"topic-(\d+)-var-e-log-prob\.dat$"


def parse_topic_term(lines: DataFrame, n_steps: int, topic_pattern: str = TOPIC_FILE) -> DataFrame:
    """Topic id from the file name (Q18); line i -> word i // T, step i % T; the
    value is a log prob: <topic, word_id, step_idx, prob>."""
    topic = F.regexp_extract("file_path", topic_pattern, 1).cast("int")
    return _filled(lines).select(topic.alias("topic"), F.floor(F.col("line") / n_steps).cast("long").alias("word_id"),
                                 (F.col("line") % n_steps).cast("int").alias("step_idx"),
                                 F.exp(F.trim("value").cast("double")).alias("prob"))


def read_topic_term(spark: SparkSession, path_glob: str, n_steps: int, topic_pattern: str = TOPIC_FILE) -> DataFrame:
    """All topic files in one job."""
    return parse_topic_term(read_lines(spark, path_glob), n_steps, topic_pattern)


#: Cells of a matrix that are turned into rows at a time.
NPY_CELLS = 1 << 20
#: Files up to this size are decoded whole by one task, larger ones by ranges of it.
NPY_RANGE = 64 << 20


def read_npy(spark: SparkSession, path: str, row: str = "row", col: str = "col", value: str = "value",
             file: str = "file", range_bytes: int | None = None) -> DataFrame:
    """2-D ``.npy`` matrices (static beta / theta) as long rows <file, row, col, value>.

    ``path`` is a file or glob on any file system that Spark reads. A task
    decodes a whole file of at most ``range_bytes`` (64 MB). Larger files, of
    any size, are listed without their bytes and dealt out as ranges; each task
    reads the header and its range through ``pyarrow.fs``, which must know the
    file system then (local, hdfs, s3, gs, abfs). At most ``NPY_CELLS`` cells are
    handed out at a time, however wide the matrix is.
    """
    size = range_bytes or NPY_RANGE
    files = spark.read.format("binaryFile").load(path)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    ranges = files.filter(F.col("length") > size).select("path", starts.alias("start"))
    # a fixed number of tasks: rows this small would be coalesced into one
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    whole = files.filter(F.col("length") <= size).select("path", "content")
    return parse_npy(whole, row, col, value, file).unionByName(_npy_ranges(dealt, size, row, col, value, file))


def _npy_ranges(ranges: DataFrame, size: int, row: str, col: str, value: str, file: str) -> DataFrame:
    """Cells whose first byte lies in the ranges <path, start> of ``size`` bytes."""
    def decode(batches):
        import numpy as np
        import pandas as pd
        from pyarrow import fs
        headers = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
        for pdf in batches:
            for name, start in zip(pdf["path"], pdf["start"]):
                if name.startswith("file:"):
                    system, inner = fs.LocalFileSystem(), "/" + name[5:].lstrip("/")
                else:
                    system, inner = fs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1))
                with system.open_input_file(inner) as f:
                    shape, by_column, dtype = headers[np.lib.format.read_magic(f)](f)
                    if dtype.hasobject:
                        raise ValueError(f"a matrix of objects is not read: {name}")
                    origin = f.tell()
                    rows, cols = shape if len(shape) == 2 else (1, shape[0])
                    lo, end = (min(rows * cols, -(-max(0, int(x) - origin) // dtype.itemsize)) for x in (start, start + size))
                    f.seek(origin + lo * dtype.itemsize)
                    while lo < end:
                        n = min(end - lo, NPY_CELLS)
                        cells = np.frombuffer(f.read(n * dtype.itemsize), dtype=dtype)
                        at = np.arange(lo, lo + n, dtype="int64")
                        r, c = (at % rows, at // rows) if by_column else (at // cols, at % cols)
                        yield pd.DataFrame({file: name, row: r, col: c.astype("int32"), value: cells.astype("float64")})
                        lo += n
    return ranges.mapInPandas(decode, f"{file} string, {row} long, {col} int, {value} double")


def parse_npy(files: DataFrame, row: str = "row", col: str = "col", value: str = "value", file: str = "file") -> DataFrame:
    """Cells of the matrices in ``files`` <path, content>.

    A matrix may come as several blocks of its rows under one path: ``first_row``
    is the place of a block's first row in it (0 where the column is missing).
    """
    def decode(batches):
        import io

        import numpy as np
        import pandas as pd
        for pdf in batches:
            for name, first, content in zip(pdf["path"], pdf["first_row"], pdf["content"]):
                arr = np.load(io.BytesIO(content), allow_pickle=False)
                arr = arr.reshape(1, -1) if arr.ndim == 1 else arr
                width = min(arr.shape[1], NPY_CELLS) or 1
                height = max(1, NPY_CELLS // width)
                for lo in range(0, arr.shape[0], height):
                    for c in range(0, arr.shape[1], width):
                        block = np.asarray(arr[lo:lo + height, c:c + width], dtype="float64")
                        n, k = block.shape
                        at = np.arange(first + lo, first + lo + n, dtype="int64")
                        yield pd.DataFrame({file: name, row: np.repeat(at, k),
                                            col: np.tile(np.arange(c, c + k, dtype="int32"), n), value: block.reshape(-1)})
    if "first_row" not in files.columns:
        files = files.withColumn("first_row", F.lit(0).cast("long"))
    return files.select("path", "first_row", "content").mapInPandas(decode, f"{file} string, {row} long, {col} int, {value} double")


def read_bow(spark: SparkSession, mult_path: str, vocab: DataFrame) -> DataFrame:
    return parse_bow(read_lines(spark, mult_path), vocab)


def parse_bow(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sparse dataset back to words, each repeated count times: <doc_idx, tokens>.
    A word id that the vocabulary lacks fails the query and is named in the error."""
    lines = _filled(lines)
    # an outer explode, as the other one has its array computed once more to filter on its size
    pairs = lines.select(F.col("line").alias("doc_idx"),
                         F.posexplode_outer(F.slice(F.split(F.trim("value"), " "), 2, 1 << 30)).alias("k", "pair")).where("k is not null")
    ic = pairs.select("doc_idx", "k", F.split("pair", ":")[0].cast("long").alias("word_id"),
                      F.split("pair", ":")[1].cast("int").alias("count"))
    unknown = F.raise_error(F.concat(F.lit("word id not in the vocabulary: "), F.coalesce(F.col("word_id").cast("string"), F.lit("null"))))
    # with a vocabulary of bounded size the pairs stay where they are; in a sort-merge join a frequent word is one task's work
    j = ic.join(measured_broadcast(vocab.select("word_id", "word")), "word_id", "left").withColumn(
        "word", F.when(F.col("word").isNotNull(), F.col("word")).otherwise(unknown.cast("string")))
    return j.groupBy("doc_idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "word", "count"))),
                                                          lambda x: F.array_repeat(x["word"], x["count"]))).alias("tokens"))


def parse_word_vectors(lines: DataFrame) -> DataFrame:
    """``word v1 v2 ...`` lines: <word, vec>."""
    parts = F.split(F.trim("value"), " ")
    return _filled(lines).select(parts[0].alias("word"), F.slice(parts, 2, 1 << 20).cast("array<float>").alias("vec"))


def read_word_vectors(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """Word vectors: GloVe-style text or parquet <word, vec>."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("word", F.col("vec").cast("array<float>").alias("vec"))
    return parse_word_vectors(spark.read.text(path))


MODEL_DIR = r"k(\d+)_a(\d+\.\d+)_var(\d+\.\d+)"


def parse_run_dirs(paths: DataFrame, ks=None, alphas=None, variances=None) -> DataFrame:
    """Runs among ``paths`` <path>, filtered by the whitelisted parameters: <run, k, alpha, var>."""
    d = paths.select(F.regexp_extract("path", r"/(" + MODEL_DIR + r")/", 1).alias("run")).filter(F.col("run") != "")
    d = d.distinct().select("run", F.regexp_extract("run", MODEL_DIR, 1).cast("int").alias("k"),
                            F.regexp_extract("run", MODEL_DIR, 2).cast("double").alias("alpha"),
                            F.regexp_extract("run", MODEL_DIR, 3).cast("double").alias("var"))
    for column, wanted in (("k", ks), ("alpha", alphas), ("var", variances)):
        if wanted is not None:
            d = d.filter(F.col(column).isin(list(wanted)))
    return d


def discover_models(spark: SparkSession, root: str, ks=None, alphas=None, variances=None) -> DataFrame:
    """Run directories named ``k<K>_a<alpha>_var<var>`` below ``root`` (file
    listing only, contents not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return parse_run_dirs(files, ks, alphas, variances)
