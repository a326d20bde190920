"""Token ids in binary files: whole texts are encoded, coded by global frequency and read back.

A token file folder holds two tables. ``codebook`` has one row per id in use: its code length in a canonical
Huffman code whose lengths are limited, so that the code follows from the lengths and a table lookup decodes it.
``blocks`` holds the ids of consecutive documents in ascending doc_id order: (part, block) order the blocks, each
of which is decoded by itself; bit offsets of every 256th id let a reader start inside a block.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostvane.llm import huffman
from hostvane.llm.token_ids import WordEncoder
from hostvane.llm.workers import give_back, let_go, per_worker, slices, slices_of_bytes
from hostvane.operators.joins import join_checked
from hostvane.session import materialize, scratch_path

END_ID = 2
BLOCK_IDS = 1 << 18
MAX_BITS = 16
BYTES_AT_ONCE = 6 << 20  # of texts whose different words are looked up together

BLOCK_SCHEMA = (
    "part int, block int, n_ids long, doc_ids array<long>, lengths array<long>, checkpoints array<long>, bits binary"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode(tokenizer: str, end_id: int, dtype: str):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = per_worker(f"words {tokenizer} {dtype}", lambda: WordEncoder(tokenizer, dtype), others=0)
        end, pack = np.array([end_id], dtype=dtype).tobytes(), zstandard.ZstdCompressor(level=1).compress
        for batch in (part for whole in batches for part in slices_of_bytes(whole, 1, BYTES_AT_ONCE)):
            texts = batch.column(1).to_pylist()
            gc.disable()  # encoding makes many objects and no cycles
            try:
                packed = [pack(ids + end) for ids in encoder.encode([t or "" for t in texts])]
            finally:
                gc.enable()
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])
            del texts, packed
            give_back()  # a part takes as much as the word cache
            yield out

    return emit


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, str, int]:
    """((doc_id, packed ids), number type, size of the id space) of whole texts; null texts are empty."""
    from tokenizers import Tokenizer

    path = tokenizer or default_tokenizer()
    space = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if space <= 1 << 16 else "<u4"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_encode(path, end_id, dtype), "doc_id long, packed binary"), dtype, space


def _unpacked(column: pa.Array, dtype: str) -> list[np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(b.as_buffer()), dtype=dtype) for b in column]


def _count(dtype: str, space: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts = np.zeros(space, dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in (part for whole in batches for part in slices(whole)):
            for ids in _unpacked(batch.column(0), dtype):
                held.append(ids)
                size += len(ids)
                if size >= BLOCK_IDS:  # a pass over the vocabulary costs more than one over a short text
                    counts += np.bincount(np.concatenate(held), minlength=space)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=space)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["id", "n"])

    return emit


def _blocks(dtype: str, lengths: np.ndarray, codes: np.ndarray, block_ids: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go()
        part, block = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            bits, marks = huffman.encode(ids, lengths, codes)
            values = [[part], [block], [len(ids)], [docs], [[len(x) for x in held]], [marks.tolist()], [bits]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            names = ["part", "block", "n_ids", "doc_ids", "lengths", "checkpoints", "bits"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch in (part for whole in batches for part in slices(whole)):
            for doc, ids in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1), dtype)):
                docs.append(doc)
                held.append(ids)
                size += len(ids)
                if size >= block_ids:
                    yield row()
                    docs, held, size, block = [], [], 0, block + 1
        if docs:
            yield row()

    return emit


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    max_bits: int = MAX_BITS,
) -> None:
    """Encode ``docs`` (doc_id, text) and write them as token files at ``path`` in ascending doc_id order.

    Nulls come first in that order; rows repeating a doc_id follow each other. An empty table writes empty tables.
    A block closes at the document that reaches ``block_ids``, so it holds one long document at most besides.
    """
    spark = docs.sparkSession
    ids, dtype, space = encoded(docs, tokenizer, end_id)
    ids = materialize(ids, "token-ids")
    counted = ids.select("packed").mapInArrow(_count(dtype, space), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(space, dtype=np.int64)
    for row in counted.toLocalIterator():  # at most one row per id of the vocabulary
        counts[row["id"]] = row["n"]
    lengths = huffman.code_lengths(counts, max(max_bits, int(space - 1).bit_length()))
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    ordered = ids.repartitionByRange("doc_id", F.xxhash64("packed")).sortWithinPartitions("doc_id", F.xxhash64("packed"))
    emit = _blocks(dtype, lengths, huffman.canonical_codes(lengths), block_ids)
    written = ordered.mapInArrow(emit, BLOCK_SCHEMA)
    written.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(f"{path}/blocks")


def _decode(lengths: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        table = huffman.decode_table(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                start, n, bits = (batch.column(i)[row].as_py() for i in (0, 1, 5))
                docs, sizes, marks = (batch.column(i)[row].values for i in (2, 3, 4))
                ids = huffman.decode(bits, n, marks.to_numpy(), table).astype("<u4", copy=False)
                ends = np.cumsum(sizes.to_numpy(), dtype=np.int64)
                cuts = pa.array(np.append(0, ends) * 4).cast(pa.int32())  # raises where they pass 32 bits
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, cuts.buffers()[1], pa.py_buffer(ids)])
                at = pa.array(start + ends - sizes.to_numpy())
                yield pa.RecordBatch.from_arrays([docs, at, raw], ["doc_id", "start", "ids"])

    return emit


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): ``ids`` as little-endian unsigned 32-bit integers, ``start`` the ids of all documents before."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # bounded by the vocabulary
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, dtype=np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    sizes = materialize(blocks.select("part", "block", "n_ids"), "block-sizes")
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base")
    )
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "block", (F.col("base") + F.col("inside")).alias("start"))
    placed = join_checked(blocks, starts, ["part", "block"])
    columns = placed.select("start", "n_ids", "doc_ids", "lengths", "checkpoints", "bits")
    return columns.mapInArrow(_decode(lengths), "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write token files and describe each document as read back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_token_files(docs, path, **options)
    read = read_token_files(spark, path)
    n = (F.octet_length("ids") / 4).cast("long")
    return read.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
