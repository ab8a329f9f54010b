"""SimHash near-duplicates through an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so
they share 4 bytes at least in the same places. The index lists fingerprints under small
groups of (place, byte), chosen so that any 4 places hold one of the groups whole. Pairs
that meet in a list have their shared positional bytes tallied; those with fewer than 4 are
let go, the rest are verified bit by bit. A list beyond ``LIST_LIMIT`` would pair up with the
square of its length. Its members meet instead at every value within 2 bits of them: two
fingerprints are within 4 bits exactly if such a value lies between them, and linking all
who meet there to the smallest takes one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.llm.common import read, staged, text_groups, text_or_empty
from cutlake.llm.components import components

_SEED = 42


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit numbers."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    sizes = []
    for text in texts:
        words = text.encode().lower().split()
        if not words:
            sizes.append(0)
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: max(1, len(words) - 3)].tolist()
        stops = (ends[min(3, len(words) - 1) :] - 1).tolist()
        hashes.extend([digest(joined[i:j], _SEED) for i, j in zip(starts, stops, strict=True)])
        sizes.append(len(starts))
    size = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.int64)
    used = np.flatnonzero(size)
    if not len(used):
        return out
    # Bytes of each hash from the highest bit on.
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    first = (np.cumsum(size) - size)[used]
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    mark = 2 * ones > size[used][:, None]
    out[used] = np.packbits(mark, axis=1).view(">i8").ravel()
    return out


def _blocks() -> list[tuple[int, ...]]:
    """20 groups of 3 byte places, one of which lies in any 4 of the 8 places.

    The places fall into three parts; a group takes three of one part, or two of one part
    and one of the next. Of any 4 places, two parts or one hold such three.
    """
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    groups = []
    for part, after in zip(parts, parts[1:] + parts[:1], strict=True):
        groups += list(combinations(part, 3))
        groups += [(*two, one) for two in combinations(part, 2) for one in after]
    return groups


BLOCKS = _blocks()
MAX_BITS = 4
LIST_LIMIT = 1024


def _byte(column: Column, place: int) -> Column:
    return F.shiftrightunsigned(column, 8 * place).bitwiseAND(F.lit(0xFF))


def _key(column: Column, number: int, block: tuple[int, ...]) -> Column:
    """Number of the block and its bytes in one long."""
    key = F.lit(number)
    for place in block:
        key = F.shiftleft(key.cast("long"), 8).bitwiseOR(_byte(column, place))
    return key


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_groups(batches, "text", 1 << 20):
        prints = pa.array(fingerprints_of(texts), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the 64-bit fingerprint (signed) of every whole text; null and empty texts have 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_fingerprint, f"doc_id {kind}, fp long")


def links(values: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Pairs (a, b) that connect all ``fp`` values of a table of distinct ones within 4 bits.

    Pairs from short lists are all such pairs of their values; members of long lists are
    linked through the values between them, to the same components.
    """
    index = values.select(
        "fp", F.explode(F.array(*[_key(F.col("fp"), n, block) for n, block in enumerate(BLOCKS)])).alias("gram")
    )
    long_lists = index.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > list_limit).select("gram")
    long_lists = staged(long_lists, "long-lists")
    short = index.join(long_lists, "gram", "left_anti")
    a = short.select("gram", F.col("fp").alias("a"))
    b = short.select("gram", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    same = [_byte(differ, place) == 0 for place in range(8)]
    tally = sum((place.cast("int") for place in same[1:]), same[0].cast("int"))
    # Many lists may hold a pair; the first block whose bytes agree speaks for it.
    speaker = F.coalesce(
        *[F.when(same[x] & same[y] & same[z], F.lit(n)) for n, (x, y, z) in enumerate(BLOCKS)]
    )
    near = (tally >= 8 - MAX_BITS) & (F.bit_count(differ) <= MAX_BITS)
    pairs = a.join(b, "gram").where((F.col("a") < F.col("b")) & near & (speaker == F.shiftright("gram", 24))).select("a", "b")
    # Through the values between: one row per member and value within half the bits.
    single = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    masks = [0, *single, *[x ^ y for x, y in combinations(single, 2)]]
    crowded = index.join(long_lists, "gram", "left_semi").select("fp").distinct()
    around = crowded.select("fp", F.explode(F.lit(masks)).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("between"))
    least = around.groupBy("between").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b <> most").select("between", "b")
    met = around.join(least, "between").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(met)


def near_duplicates(docs: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id it reaches) of every document.

    Documents with one fingerprint are linked, those without words (null, empty or blank
    texts) among them; fingerprints within 4 bits are linked. Repeated rows keep their own
    row. A null doc_id takes part, and is the component_id only where no other id is there.
    Other columns are not read.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    values = staged(values, "distinct-fingerprints")
    roots = components(links(values.select("fp"), list_limit))
    rooted = values.join(roots, values["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of_root")
    named = rooted.join(ids, rooted["root"] == ids["of_root"]).select(F.col("fp").alias("of_fp"), "component_id")
    return prints.join(named, prints["fp"] == named["of_fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, the smallest doc_id, with all its columns.

    Null doc_ids stay only in groups without any other id. Where the row that stays is
    repeated, one of its repetitions stays.
    """
    found = staged(near_duplicates(docs), "components")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id")).distinct()
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("twice_id"))
    left = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    once = left.join(twice, F.col("doc_id").eqNullSafe(F.col("twice_id")), "left_anti")
    return once.unionByName(left.join(twice, F.col("doc_id").eqNullSafe(F.col("twice_id")), "left_semi").dropDuplicates(["doc_id"]))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
