"""Token counts of documents from flat token files without an index."""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.scratch import new_path, written
from logweir.llm.words import small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
KIND = "<u2"
BLOCK_TOKENS = 1 << 16
# Folders of a written set: the token files, and the doc_ids in the order of their documents.
TOKENS, IDS = "tokens", "ids"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# Spark's names of files: the number of the task, and that of the file among those of the task.
_SHARD, _TURN = r"/part-(\d+)-[^/]*$", r"\.c(\d+)[^/]*$"

# Fixed value: the usual pattern that splits text before byte-level merges.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BLOCK = "stream string, block int, tokens long, ends int, head long, tail long, inner array<long>"


def _encoder(path: str):
    import tiktoken
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, object] = {}


def _encoded(batches: Iterator[pa.RecordBatch], path: str, kind: str) -> Iterator[pa.RecordBatch]:
    """Of every document a row for the token files and, in the same order, one for the lists of ids."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _encoder(path)
    encode = _ENCODERS[path].encode_ordinary
    for batch in small_batches(batches):
        tokens = [np.asarray(encode(text or ""), dtype=kind).tobytes() for text in batch.column("text").to_pylist()]
        ids = [b"" if i is None else str(i).encode() for i in batch.column("doc_id").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([TOKENS] * len(tokens) + [IDS] * len(ids)), pa.array(tokens + ids, pa.binary())],
                                         names=["part", "value"])


def _bytes(setting: str) -> int:
    """Bytes of a Spark size such as 134217728b or 16m."""
    number, unit = setting.strip().lower().rstrip("b"), ""
    if number[-1] in "kmgt":
        number, unit = number[:-1], number[-1]
    return int(number) << 10 * ("kmgt".index(unit) + 1 if unit else 0)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int = END_OF_TEXT, kind: str = KIND,
                      file_bytes: int | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as flat token files; returns (doc_id, shard, place).

    A shard is what one task read: the ids of its documents' tokens, each document followed by
    ``end``, nothing else, in one file or several that follow each other. Tokens are never shuffled:
    the task writes, beside its token files, the list of its doc_ids in the same order. Spark's text
    writer puts the raw bytes, with the bytes of ``end`` as its line separator, so any
    store that Spark writes will do. Files hold the tokens of about ``file_bytes`` of text, by default as
    much as Spark puts in one partition of a scan. Null texts are written as empty documents.
    """
    spark = docs.sparkSession
    if file_bytes is None:
        file_bytes = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    rows, total = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    records = max(1, rows * file_bytes // max(total or 0, 1))
    separator = np.array([end], kind).tobytes()
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_encoded, path=tokenizer, kind=kind), "part string, value binary")
    writers = spark.conf.get(_WRITERS)
    # Both files of a task stay open, so that rows are written as they come; else Spark would sort them by part.
    spark.conf.set(_WRITERS, "2")
    try:
        (out.select("part", F.col("value").cast("string").alias("value"))
         .write.partitionBy("part").option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records)
         .option("lineSep", separator.decode("latin-1")).text(folder))
    finally:
        spark.conf.set(_WRITERS, writers)
    names = _files(spark, folder, IDS).select("path", "content").mapInArrow(
        partial(_ids, separator=separator, records=records), "path string, place long, doc_id long")
    return names.select("doc_id", F.regexp_extract("path", _SHARD, 1).cast("int").alias("shard"), "place")


def _files(spark, folder: str, part: str | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files if part is None else files.where(F.contains("path", F.lit(f"/part={part}/")))


def _ids(batches: Iterator[pa.RecordBatch], separator: bytes, records: int) -> Iterator[pa.RecordBatch]:
    """(path, place, doc_id) of lists of ids; the k-th list of a task goes on after k * ``records`` ids."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = [int(i) if i else None for i in content.as_py().split(separator)[:-1]]
            first = int(re.search(_TURN, path)[1]) * records
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(ids)), pa.array(range(first, first + len(ids)), pa.int64()),
                                              pa.array(ids, pa.int64())], names=["path", "place", "doc_id"])


def _blocks(batches: Iterator[pa.RecordBatch], end: int, kind: str, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Per block of a file: ends found, tokens before the first, after the last, and between neighbours."""
    for batch in batches:
        for stream, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.frombuffer(content.as_buffer(), dtype=kind)
            rows = []
            for number, lo in enumerate(range(0, len(ids), block_tokens)):
                block = ids[lo: lo + block_tokens]
                at = np.flatnonzero(block == end)
                if len(at):
                    rows.append((stream, number, len(block), len(at), int(at[0]), len(block) - 1 - int(at[-1]), np.diff(at) - 1))
                else:
                    rows.append((stream, number, len(block), 0, len(block), len(block), np.zeros(0, np.int64)))
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 names=["stream", "block", "tokens", "ends", "head", "tail", "inner"])


def scan_token_files(spark, folder: str, end: int = END_OF_TEXT, kind: str = KIND, block_tokens: int = BLOCK_TOKENS,
                     part: str | None = None) -> DataFrame:
    """(stream, place, n_tokens): the documents of flat token files, by their separators.

    A stream is a folder of files that follow each other by name, cut anywhere between tokens; files
    outside of folders of their own are one stream. With ``part``, a part that ``write_token_files`` wrote,
    a stream is the files of one task. Every file is searched block by block.
    A prefix scan over the blocks of a stream, which are one short row each, stitches
    documents that go over block or file ends and numbers all of them. Tokens after the last
    separator of a stream are a last document. Empty files add nothing; no files give no rows.
    """
    blocks = written(_files(spark, folder, part).select("path", "content").mapInArrow(
        partial(_blocks, end=end, kind=kind, block_tokens=block_tokens), _BLOCK.replace("stream", "path")), "blocks")
    turn = F.lit(0) if part is None else F.regexp_extract("path", _TURN, 1).cast("int")
    blocks = blocks.withColumn("stream", F.regexp_replace("path", r"/[^/]*$" if part is None else _TURN, "")).withColumn("turn", turn)
    order = Window.partitionBy("stream").orderBy("turn", "path", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("ends").over(before), F.lit(0))
    total = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    # Where the open document began: after the last separator of an earlier block.
    opened = F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("position") + F.col("tokens") - F.col("tail"))).over(before), F.lit(0))
    scanned = blocks.withColumn("position", total).withColumn("seen", seen).withColumn("opened", opened)
    scanned = scanned.withColumn("last", F.lead("block").over(order).isNull())
    first = F.when(F.col("ends") > 0, F.array(F.col("position") + F.col("head") - F.col("opened"))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("position") + F.col("tokens") - F.col("opened"))
    final = F.when(F.col("last") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    lengths = F.concat(first, "inner", final)
    return scanned.select("stream", "seen", F.posexplode(lengths).alias("k", "n_tokens")).select(
        "stream", (F.col("seen") + F.col("k")).cast("int").alias("place"), "n_tokens")


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS, file_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs`` (doc_id, text): written as token files, counted by their scan.

    Null and empty texts have no tokens. Null ids and rows that repeat are kept as they are. No
    rows give no rows; other columns do not matter.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    places = write_token_files(docs, folder, tokenizer, file_bytes=file_bytes)
    found = scan_token_files(spark, folder, block_tokens=block_tokens, part=TOKENS)
    shard = F.regexp_extract("stream", _SHARD, 1).cast("int")
    return places.join(found.withColumn("shard", shard), ["shard", "place"]).select("doc_id", "n_tokens")
