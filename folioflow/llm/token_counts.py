"""Operator 6, token counts: separator scan over flat token files.

The files hold token ids and, between documents, an end-of-document id, and nothing else: no index. Each file is cut
into blocks; a vectorised search finds the separators of a block, whatever documents it begins or ends in. A prefix
scan over the blocks' summaries (separators, tokens before the first, tokens after the last) then stitches the
documents that cross blocks.

Writing: Spark's text writer puts its line separator behind every row; here that is the separator's bytes, so the
committed writer makes the flat files. A file of the same name in the folder beside lists the ids of its documents in
order; it is split where the tokens are, should Spark split a task's output into several files.

Defined cases: NULL and '' have no tokens, but a place. Each input row gives one row, repeated ones and those without
an id too. Only id and text are read. An empty table gives no documents.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import documents, in_arrow
from folioflow.sources.shared import new_path, remove, written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 50256
TOKEN = np.dtype("<u2")
BLOCK = 1 << 16
# Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def encoding(path: str):
    """Byte-level BPE from a file of ranks; one a Python worker."""
    if path not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """docs to path/kind=tokens and path/kind=ids, without a shuffle: a file of either kind for each input partition."""

    def run(batches):
        enc, seq = encoding(vocabulary), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens = [np.array(enc.encode_ordinary(t or ""), TOKEN).tobytes() for t in part.column(1).to_pylist()]
                ids = [b"" if i is None else str(i).encode().hex().encode() for i in part.column(0).to_pylist()]
                order = list(range(seq, seq + len(ids)))
                seq += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(["tokens"] * len(ids) + ["ids"] * len(ids)), pa.array(order * 2, pa.int64()), pa.array(tokens + ids, pa.binary())], names=["kind", "seq", "raw"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = in_arrow(given, run, "kind string, seq bigint, raw binary")
    separator = np.array([end], TOKEN).tobytes().decode("latin-1")
    out = rows.sortWithinPartitions("kind", "seq").select("kind", F.col("raw").cast("string").alias("value"))
    out.write.partitionBy("kind").option("lineSep", separator).option("encoding", "ISO-8859-1").option("compression", "gzip").text(path)


def unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def scan_block(block: np.ndarray, end: int = END) -> tuple[int, int, int, np.ndarray]:
    """(separators, tokens before the first, tokens after the last, lengths of the documents inside)."""
    at = np.flatnonzero(block == end)
    if not len(at):
        return 0, len(block), 0, np.zeros(0, np.int64)
    return len(at), int(at[0]), len(block) - 1 - int(at[-1]), np.diff(at) - 1


def scan_blocks(spark: SparkSession, path: str, block: int = BLOCK, end: int = END) -> DataFrame:
    """(file, block, n_seps, head, tail, inner) of all token files below a path."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.frombuffer(unpacked(batch.column(1)[i].as_py()), TOKEN)
                rows = [scan_block(tokens[a : a + block], end) for a in range(0, len(tokens), block)]
                for a in range(0, len(rows), 64):
                    n, head, tail, inner = zip(*rows[a : a + 64], strict=True)
                    names = pa.array([batch.column(0)[i].as_py()] * len(n), pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(range(a, a + len(n)), pa.int64()), *[pa.array(x, pa.int64()) for x in (n, head, tail)], pa.array([x.tolist() for x in inner], pa.list_(pa.int64()))], names=["file", "block", "n_seps", "head", "tail", "inner"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return in_arrow(files, run, "file string, block bigint, n_seps bigint, head bigint, tail bigint, inner array<bigint>")


def stitched(blocks: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of the documents, each of which ends with a separator; what follows a file's last
    one is a document too if it has tokens. The scan is over one row a block."""
    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.withColumn("base", F.coalesce(F.sum("n_seps").over(before), F.lit(0)))
    # tokens of blocks without a separator pile up on the tail of the last block with one
    b = b.withColumn("flat", F.when(F.col("n_seps") == 0, F.col("head")).otherwise(0)).withColumn("run", F.sum("flat").over(w))
    start = F.when(F.col("n_seps") > 0, F.struct(F.col("tail"), F.col("run")))
    b = b.withColumn("last", F.last(start, ignorenulls=True).over(before))
    carried = F.coalesce(F.col("last.tail"), F.lit(0)) + F.coalesce(F.lag("run").over(w), F.lit(0)) - F.coalesce(F.col("last.run"), F.lit(0))
    b = b.withColumn("carry", carried).withColumn("is_last", F.lead("block").over(w).isNull())
    first = F.when(F.col("n_seps") > 0, F.array(F.col("carry") + F.col("head"))).otherwise(F.array().cast("array<bigint>"))
    open_end = F.when(F.col("n_seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("head"))
    rest = F.when(F.col("is_last") & (open_end > 0), F.array(open_end)).otherwise(F.array().cast("array<bigint>"))
    lengths = F.posexplode(F.concat(first, "inner", rest)).alias("i", "n_tokens")
    return b.select("file", "base", lengths).select("file", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens")


def part_of(file: Column) -> Column:
    """A file's whole name: a task may have written several."""
    return F.element_at(F.split(file, "/"), -1)


def ids_of(spark: SparkSession, path: str, end: int = END) -> DataFrame:
    """(part, ordinal, id as string) from the lists beside the token files."""
    mark = np.array([end], TOKEN).tobytes()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                ids = unpacked(batch.column(1)[i].as_py()).split(mark)[:-1]
                for a in range(0, len(ids), 10_000):
                    some = [bytes.fromhex(x.decode()).decode() if x else None for x in ids[a : a + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(range(a, a + len(some)), pa.int64()), pa.array(some, pa.string())], names=["part", "ordinal", "id"])

    files = spark.read.format("binaryFile").load(path).select(part_of(F.col("path")).alias("part"), "content")
    return in_arrow(files, run, "part string, ordinal bigint, id string")


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, path: str | None = None) -> DataFrame:
    """(id, part, ordinal, n_tokens) of each row, by way of flat files. They stay where a path is given; else they are
    in the shared folder for as long as it takes to count."""
    spark, kept = docs.sparkSession, path
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, id_col, text_col)
    if not docs.limit(1).count():
        return spark.createDataFrame([], f"`{id_col}` {dict(docs.dtypes)[id_col]}, part string, ordinal bigint, n_tokens bigint")
    counts = stitched(scan_blocks(spark, f"{path}/kind=tokens", block)).select(part_of(F.col("file")).alias("part"), "ordinal", "n_tokens")
    ids = ids_of(spark, f"{path}/kind=ids")
    out = counts.join(ids, ["part", "ordinal"]).select(F.col("id").cast(dict(docs.dtypes)[id_col]).alias(id_col), "part", "ordinal", "n_tokens")
    if kept is None:
        out = written(out, "token_counts")
        remove(spark, path)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), f"{TOKENIZERS}/{VOCABULARY}").select("doc_id", "n_tokens")
