"""Token ids of documents as range-coded binary blocks, written and read by Spark.

``write`` makes three tables in one folder of the shared storage:

* ``tokens``: whole documents in ascending doc_id order, cut into blocks by task, plain ids, and with
  a task's last block how often each id occurs in all of them;
* ``frequencies``: one row, the scaled frequency of every id of the vocabulary;
* ``blocks``: shard, block, start (ids before it in the order of all documents), doc_ids,
  lengths and the payload of ``cutlake.llm.rans``.

Blocks are rows, so Spark's commit protocol covers them: a lost executor's blocks are made
anew from ``tokens``. Readers need the blocks they want and the frequencies, nothing else.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutlake.llm import rans
from cutlake.llm.common import Memo, per_worker, read, text_or_empty, text_slices, tokenizer_file, write_once
from cutlake.session import scratch_dir

# Punctuation that the tokenizer always cuts off the word before it, and that is in no special token.
_TAIL = '.,;:!?%&*#$"()-'
_TAIL_BYTES = _TAIL.encode()
# Words in one call of the library.
_ASKED = 1000
_TOKENS = "shard int, block int, shard_start long, doc_ids array<long>, lengths array<long>, ids binary, counts binary"


def _byte_strings(texts: pa.StringArray) -> list[bytes]:
    """Faster than to_pylist."""
    _, offsets, held = texts.buffers()
    if not len(texts):
        return []
    bounds = np.frombuffer(offsets, "<i4", len(texts) + 1, 4 * texts.offset).tolist()
    data = held.to_pybytes() if held else b""
    return [data[i:j] for i, j in pairwise(bounds)]


class WordEncoder:
    """Encodes words between ASCII white space with the library, each different one once.

    The tokenizer drops white space and cuts at it, lower-cases character by character, and
    cuts punctuation off letters and digits, so a word that ends in one of these, as normalised,
    once its last punctuation is off, in lower case if it is ASCII, decides its ids.
    """

    def __init__(self, data: bytes, words: int = 1_390_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        # Ids of words as they stand, and of what is left of them without case and last punctuation.
        self.words: Memo = Memo(words)
        # At most one entry per code point.
        self.ends: dict[str, bool] = {}
        # Whether an id ends a run of letters, one of digits or one of signs.
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True

    def ends_in_alnum(self, char: str) -> bool:
        """Whether a character ends in a letter or digit once normalised; marks taken off it would join punctuation."""
        if char not in self.ends:
            normalised = self.library.normalizer.normalize_str(char) if not char.isascii() else char
            self.ends[char] = normalised[-1:].isalnum()
        return self.ends[char]

    def parts(self, word: bytes) -> tuple[bytes, bytes]:
        """What decides a word's ids: the word without case and last punctuation, and that punctuation."""
        head = word.rstrip(_TAIL_BYTES)
        if head.isalpha() or head.isalnum() and head.isascii():
            return head.lower(), word[len(head) :]
        if not head or b"<|" in word or not self.ends_in_alnum(head.decode()[-1]):
            head = word
        return head.lower() if head.isascii() else head, word[len(head) :]

    def ask(self, parts: list[bytes]) -> None:
        """Ask the library for each by itself."""
        for part, found in zip(parts, self.library.encode_batch_fast([part.decode() for part in parts], add_special_tokens=False), strict=True):
            self.words[part] = np.array(found.ids, "<u4").tobytes()

    def ask_together(self, parts: list[bytes]) -> None:
        """Ask the library in one call. Every word has a closing id at its end; as many as words means that none has another."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(parts).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(parts):
            held, bounds = ids.tobytes(), (4 * ends).tolist()
            self.words.update(zip(parts, (held[i:j] for i, j in pairwise([0, *bounds])), strict=True))
        elif len(parts) == 1:
            self.ask(parts)
        else:
            half = len(parts) // 2
            self.ask_together(parts[:half])
            self.ask_together(parts[half:])

    def look_up(self, parts: list[bytes]) -> None:
        """Ask the library, for words of letters alone many at a time."""
        texts = b" ".join(parts).decode().split(" ") if parts else []
        letters = [text.isalpha() for text in texts]
        self.ask([part for part, plain in zip(parts, letters, strict=True) if not plain])
        plain = list(compress(parts, letters))
        for k in range(0, len(plain), _ASKED):
            self.ask_together(plain[k : k + _ASKED])

    def learn(self, words: list[bytes]) -> None:
        cut = [self.parts(word) for word in words]
        self.look_up([part for part in set(chain.from_iterable(cut)) if part and part not in self.words])
        ids = self.words
        ids[b""] = b""
        for word, (head, tail) in zip(words, cut, strict=True):
            ids[word] = ids[head] + ids[tail] if tail else ids[head]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        split = pa.compute.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = _byte_strings(coded.dictionary)
        ids = list(map(self.words.get, words))
        places = [k for k, known in enumerate(ids) if known is None]
        # Each new word may add its parts too.
        if len(self.words) + 3 * len(places) > self.words.limit:
            self.words.clear()
            places = range(len(words))
        self.learn([words[k] for k in places])
        for k in places:
            ids[k] = self.words[words[k]]
        ids = pa.array(ids, pa.large_binary()).take(coded.indices)
        _, offsets, held = ids.buffers()
        bounds = np.frombuffer(offsets, "<i8", len(ids) + 1)[split.offsets.to_numpy()] if len(ids) else np.zeros(len(texts) + 1, int)
        held = memoryview(held or b"")
        return [bytes(held[i:j]) for i, j in pairwise(bounds.tolist())]


def _tokenize(batches: Iterator[pa.RecordBatch], data: Broadcast, size: int, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder = per_worker("token_files", data.value, WordEncoder)
    shard, block, start = TaskContext.get().partitionId(), 0, 0
    end = np.array([end_id], "<u4").tobytes()
    docs: list[int | None] = []
    parts: list[bytes] = []
    held = 0
    counts = np.zeros(size, "<i8")

    def flush(last: bool) -> pa.RecordBatch:
        nonlocal block, start, docs, parts, held, counts
        lengths = [len(part) // 4 for part in parts]
        ids = b"".join(parts)
        counts += np.bincount(np.frombuffer(ids, "<u4"), minlength=size)
        columns = [[shard], [block], [start], [docs], [lengths], [ids], [counts.tobytes() if last else None]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        row = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _names(_TOKENS))
        block, start, docs, parts, held = block + 1, start + sum(lengths), [], [], 0
        return row

    for batch in text_slices(batches, "text", 1 << 21):
        for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_column(batch.column("text")), strict=True):
            if held >= block_ids:
                yield flush(last=False)
            docs.append(doc)
            parts.append(ids + end)
            held += len(ids) // 4 + 1
    if docs:
        yield flush(last=True)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _count(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        for counts in batch.column("counts"):
            total += np.frombuffer(counts.as_buffer(), "<i8")
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


def _encode(batches: Iterator[pa.RecordBatch], freq: Broadcast) -> Iterator[pa.RecordBatch]:
    table = rans.Table(np.frombuffer(freq.value, "<u4"))
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            payload = rans.encode(np.frombuffer(row.column("ids")[0].as_buffer(), "<u4"), table)
            kept = row.drop_columns(["ids"])
            yield kept.append_column("payload", pa.array([payload], pa.binary()))


def _read(batches: Iterator[pa.RecordBatch], freq: Broadcast) -> Iterator[pa.RecordBatch]:
    table = per_worker("token_files_table", freq.value, lambda data: rans.Table(np.frombuffer(data, "<u4")))
    for batch in batches:
        for row in batch.to_pylist():
            ids = rans.decode(row["payload"], table).astype("<u4")
            ends = np.cumsum(row["lengths"])
            begins = ends - row["lengths"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + begins, pa.int64()),
                    pa.array([ids[i:j].tobytes() for i, j in zip(begins, ends, strict=True)], pa.binary()),
                ],
                ["doc_id", "start", "ids"],
            )


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, block_ids: int = 1 << 18) -> None:
    """Encode all whole texts, ``end_id`` after each, and write the tables to ``folder``.

    Documents come in ascending doc_id order, null ids first; rows that share an id are
    ordered by text. A null text counts as empty and holds the end id alone. Blocks hold
    whole documents, the last of which may take them beyond ``block_ids``. Ids that don't
    fit 64 bits or aren't integers are an error; other columns are not read.
    """
    spark = docs.sparkSession
    data = tokenizer_file(spark, tokenizer_path)
    size = max(per_worker("token_files", data.value, WordEncoder).size, end_id + 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = texts.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    write_once(ordered.mapInArrow(lambda batches: _tokenize(batches, data, size, end_id, block_ids), _TOKENS), f"{folder}/tokens")
    tokens = spark.read.schema(_TOKENS).parquet(f"{folder}/tokens")
    # One row per id of the vocabulary at most.
    tallies = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(lambda batches: _count(batches, size), "id long, n long")
    rows = tallies.groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    freq = rans.scaled(counts).astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(freq),)], "freq binary").coalesce(1).write.parquet(f"{folder}/frequencies")
    sent = spark.sparkContext.broadcast(freq)
    # One row per shard, that is per task of the write.
    shards = tokens.groupBy("shard").agg(F.max(F.expr("shard_start + aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("of_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # Sent to all: no more rows than the write above had tasks.
    blocks = tokens.join(F.broadcast(shards), F.col("shard") == F.col("of_shard")).select(
        "shard", "block", (F.col("offset") + F.col("shard_start")).alias("start"), "doc_ids", "lengths", "ids"
    )
    schema = "shard int, block int, start long, doc_ids array<long>, lengths array<long>, payload binary"
    write_once(blocks.mapInArrow(lambda batches: _encode(batches, sent), schema), f"{folder}/blocks", "none")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids (binary, little-endian 32-bit) of every document in the files."""
    freq = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{folder}/frequencies").first()["freq"]))
    blocks = spark.read.parquet(f"{folder}/blocks")
    return blocks.mapInArrow(lambda batches: _read(batches, freq), "doc_id long, start long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as range-coded blocks, read them back, and sum up each document."""
    import public_tokenizers

    folder = scratch_dir(spark, "token-files")
    write(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_back(spark, folder).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
