"""Token counts of flat, unindexed token files, by a separator scan.

A file is nothing but ids of a fixed width, each document's followed by the end-of-document id. Blocks of bytes are
searched for that id in one vectorised comparison each, independent of where documents begin. A block reports the
tokens before its first separator, those after its last, and the lengths between; a prefix scan over the blocks of a
file then says what is carried into each block and how many documents came before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.llm import store
from quillmatch.llm.common import written
from quillmatch.llm.tokens import as_batches, texts_of, worker_tokenizer

#: The vocabulary's end-of-text id and the width of an id in a file.
END, WIDTH, SUFFIX = 49407, 2, ".tokens"

#: Bytes of a block.
BLOCK = 8 << 20


def write_token_files(documents: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Writes a file of ids for each partition; returns file, ordinal, doc_id of each document, in a table of its own.

    Only doc_id and text are read. Null and empty texts have no ids, only the separator. A text cannot forge one:
    the names of special ids are ordinary text here.
    """
    store.make_dir(folder)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tokenizer, end = worker_tokenizer(path, specials_as_text=True), np.array([END], "<u2").tobytes()
        name = f"part-{TaskContext.get().partitionId():06d}{SUFFIX}"

        def told():
            """Writes the file; a row of each document once it is written, so that no more than a batch is held."""
            with store.part_file(f"{folder}/{name}") as out:
                for i, (doc_id, text) in enumerate(texts_of(batches)):
                    out.write(tokenizer.ids(text).astype("<u2").tobytes() + end)
                    yield name, i, doc_id

        schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])
        yield from as_batches(told(), schema)

    slim = documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string"))
    return written(slim.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-manifest")


def scan_block(ids: np.ndarray, end: int = END) -> tuple[int, np.ndarray, int]:
    """Number of separators; for each the tokens since the one before it or the block's start; tokens after the last."""
    at = np.flatnonzero(ids == end)
    if not len(at):
        return 0, at, len(ids)
    return len(at), np.diff(at, prepend=-1) - 1, int(len(ids) - 1 - at[-1])


def count_tokens(spark: SparkSession, folder: str, end: int = END, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """file, ordinal, n_tokens (without the separator), ended of every document in the token files of a folder.

    What follows a file's last separator is a document that is not ended; nothing follows, no document. Empty files
    and an empty folder have none. A file whose size is no multiple of the width is an error. Only the file names and
    sizes pass through the driver.
    """
    found = store.files(folder, SUFFIX)
    if bad := [n for n, size in found if size % width]:
        raise ValueError(f"not a whole number of ids: {bad[:3]}")
    block -= block % width
    blocks = sum(-(-size // block) for _, size in found)
    tasks = max(1, min(blocks, 16 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame([(n, s) for n, s in found if s], "file string, size long")
    dealt = listed.select("file", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block))).alias("block")).repartition(tasks, "file", "block")

    def run(batches):
        import pyarrow as pa

        fs, path = store.resolve(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{path}/{r['file']}") as f:
                    raw = f.read_at(min(block, r["size"] - r["block"] * block), r["block"] * block)
                seps, lengths, tail = scan_block(np.frombuffer(raw, f"<u{width}"), end)
                held = pa.ListArray.from_arrays(pa.array([0, seps], pa.int32()), pa.array(lengths, pa.int64()))
                cols = [pa.array([r["file"]]), pa.array([r["block"]], pa.int64()), pa.array([seps], pa.int64()), held, pa.array([tail], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["file", "block", "seps", "lengths", "tail"])

    scanned = written(dealt.mapInArrow(run, "file string, block long, seps long, lengths array<long>, tail long"), "token-blocks")
    by_block = W.partitionBy("file").orderBy("block")
    before = by_block.rowsBetween(W.unboundedPreceding, -1)
    scan = (
        scanned.select("file", "block", "seps", "tail")
        .withColumn("run", F.sum((F.col("seps") > 0).cast("int")).over(by_block))
        .withColumn("open", F.sum("tail").over(W.partitionBy("file", "run").orderBy("block")))
        .withColumn("carry", F.coalesce(F.lag("open").over(by_block), F.lit(0)))
        .withColumn("base", F.coalesce(F.sum("seps").over(before), F.lit(0)))
        .withColumn("last", F.lead("block").over(by_block).isNull())
    )
    ended = (
        scanned.select("file", "block", "lengths")
        .join(scan.select("file", "block", "carry", "base"), ["file", "block"])
        .select("file", "base", "carry", F.posexplode("lengths").alias("i", "n"))
        .select("file", (F.col("base") + F.col("i")).alias("ordinal"), F.when(F.col("i") == 0, F.col("n") + F.col("carry")).otherwise(F.col("n")).alias("n_tokens"), F.lit(True).alias("ended"))
    )
    rest = scan.filter(F.col("last") & (F.col("open") > 0)).select("file", (F.col("base") + F.col("seps")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def count_document_tokens(documents: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, file, ordinal: documents written as flat token files, counted from the files alone.

    Every row is a document: repeated ones are counted each, null ids stay null; null and empty texts have 0 tokens. An
    empty table has no rows. Other columns are not read.
    """
    manifest = write_token_files(documents, folder, path)
    counts = count_tokens(documents.sparkSession, folder)
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
