"""Has this key been seen before? Elias-Fano coded hash partitions, probed and merged batch by batch.

Keys become fingerprints of ``bits`` bits. Each task holds the fingerprints of one hash partition as Elias-Fano
sequences: the high bits in unary, the low bits packed, about ``2 + bits - log2(n)`` bits a key plus one bit for the
rank directory, however long the keys are. Records arrive in order within the partition; a batch is probed by successor
search and its new fingerprints are merged in. Merging is logarithmic: runs of similar size are merged, so a
fingerprint is rewritten O(log n) times.

Scale: one shuffle of (fingerprint, id). Before it, every map task settles repeats within its own rows, so a key with a
third of all rows reaches the shuffle once per ``CHUNK`` rows and its other rows spread evenly. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.session import materialize

#: Rows of a map task within which repeats are settled at once.
CHUNK = 400_000


class EliasFano:
    """A sorted sequence of distinct uint64 values below 2**bits."""

    def __init__(self, values: np.ndarray, bits: int = 64) -> None:
        self.n = n = len(values)
        self.bits = bits
        self.low_bits = max(0, bits - max(1, int(n).bit_length()))
        if not n:
            return
        width = np.uint64(self.low_bits)
        high = (values >> width).astype(np.int64)
        at = high + np.arange(n)
        self.buckets = int(high[-1]) + 1
        # ones for a bucket's values, then a zero that ends it
        ones = np.zeros(-(-(n + self.buckets) // 64) * 64, dtype=np.uint8)
        ones[at] = 1
        self.unary = np.packbits(ones, bitorder="little").view(np.uint64)
        self._direct()
        self.low = np.zeros(n * self.low_bits // 64 + 2, dtype=np.uint64)
        if self.low_bits:
            low = values & np.uint64((1 << self.low_bits) - 1)
            bit = np.arange(n, dtype=np.int64) * self.low_bits
            word, off = bit >> 6, (bit & 63).astype(np.uint64)
            np.bitwise_or.at(self.low, word, low << off)
            over = (off + width) > np.uint64(64)
            np.bitwise_or.at(self.low, word[over] + 1, low[over] >> (np.uint64(64) - off[over]))

    def _direct(self) -> None:
        """The rank directory: how many zeros, ends of buckets, stand before each word."""
        ones = np.bitwise_count(self.unary).astype(np.int64)
        zeros = np.arange(len(ones), dtype=np.int64) * 64 - (np.cumsum(ones) - ones)
        self.zeros = zeros.astype(np.uint32 if self.buckets < 2**32 - 64 else np.int64)

    def to_row(self) -> tuple[int, int, int, bytes, bytes]:
        """n, low_bits, buckets, unary, low: what an index keeps of it."""
        return (self.n, self.low_bits, self.buckets, self.unary.tobytes(), self.low.tobytes()) if self.n else (0, self.low_bits, 0, b"", b"")

    @classmethod
    def from_row(cls, bits: int, n: int, low_bits: int, buckets: int, unary: bytes, low: bytes) -> EliasFano:
        out = cls.__new__(cls)
        out.n, out.bits, out.low_bits, out.buckets = n, bits, low_bits, buckets
        if n:
            out.unary, out.low = np.frombuffer(unary, dtype=np.uint64), np.frombuffer(low, dtype=np.uint64)
            out._direct()
        return out

    @property
    def nbytes(self) -> int:
        return self.unary.nbytes + self.zeros.nbytes + self.low.nbytes if self.n else 0

    def lows(self, i: np.ndarray) -> np.ndarray:
        """The low bits of the values at positions i."""
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i * self.low_bits
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        out = self.low[word] >> off
        # a shift by 64 is undefined, hence in two steps
        out |= (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - off)
        return out & np.uint64((1 << self.low_bits) - 1)

    def _below(self, bucket: np.ndarray) -> np.ndarray:
        """The number of values in buckets before each of the given ones: a select of the zero that ends the one before."""
        out = np.zeros(len(bucket), dtype=np.int64)
        k = np.flatnonzero(bucket > 0)
        zero = bucket[k] - 1
        word = np.searchsorted(self.zeros, zero.astype(self.zeros.dtype), "right") - 1
        left = zero - self.zeros[word]
        bits = ~self.unary[word]
        at = np.zeros(len(k), dtype=np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.int64)
            go = part <= left
            left = np.where(go, left - part, left)
            at += np.where(go, step, 0)
            bits = np.where(go, bits >> np.uint64(step), bits)
        out[k] = word * 64 + at - zero
        return out

    def successor(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The position of the first value >= each probe, and whether it equals the probe."""
        if not self.n:
            return np.zeros(len(probes), dtype=np.int64), np.zeros(len(probes), dtype=bool)
        width = np.uint64(self.low_bits)
        bucket = (probes >> width).astype(np.int64)
        beyond = bucket >= self.buckets
        bucket = np.minimum(bucket, self.buckets - 1)
        lo, end = self._below(bucket), self._below(bucket + 1)
        lo = np.where(beyond, self.n, lo)
        end = np.where(beyond, self.n, end)
        low, hi = probes & np.uint64((1 << self.low_bits) - 1), end.copy()
        while True:
            k = np.flatnonzero(lo < hi)
            if not len(k):
                break
            mid = (lo[k] + hi[k]) >> 1
            less = self.lows(mid) < low[k]
            lo[k[less]] = mid[less] + 1
            hi[k[~less]] = mid[~less]
        found = np.zeros(len(probes), dtype=bool)
        k = np.flatnonzero(lo < end)
        found[k] = self.lows(lo[k]) == low[k]
        return lo, found

    def decode(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        ones = np.flatnonzero(np.unpackbits(self.unary.view(np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return ((ones - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(i)


class SeenSet:
    """Elias-Fano runs, merged when their sizes are alike."""

    def __init__(self, bits: int = 64) -> None:
        self.bits, self.runs = bits, []

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=bool)
        for run in self.runs:
            k = np.flatnonzero(~found)
            found[k] = run.successor(keys[k])[1]
        return found

    def add(self, keys: np.ndarray) -> None:
        """Adds sorted distinct keys of which none is held."""
        if not len(keys):
            return
        self.runs.append(EliasFano(keys, self.bits))
        while len(self.runs) > 1 and self.runs[-2].n <= 2 * self.runs[-1].n:
            b, a = self.runs.pop(), self.runs.pop()
            merged = np.concatenate([a.decode(), b.decode()])
            merged.sort(kind="stable")
            self.runs.append(EliasFano(merged, self.bits))


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks rows whose key has a smaller id among the same task's rows; they go anywhere, the others to their key."""

    def done(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        order = np.lexsort((pdf["id"].to_numpy(), pdf["key"].to_numpy()))
        key = pdf["key"].to_numpy()[order]
        again = np.zeros(len(pdf), dtype=bool)
        again[order[1:]] = key[1:] == key[:-1]
        return pdf.assign(part=np.where(again, pdf["id"], pdf["key"]), again=again)[["part", "key", "id", "again"]]

    held, rows = [], 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows >= CHUNK:
            yield done(held)
            held, rows = [], 0
    if rows:
        yield done(held)


def _probe(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = SeenSet(bits)
        for pdf in batches:
            again = pdf["again"].to_numpy().astype(bool)
            ident = pdf["id"].to_numpy()
            found = again.copy()
            k = np.flatnonzero(~again)
            keys = pdf["key"].to_numpy()[k].view(np.uint64)
            if bits < 64:
                keys = keys >> np.uint64(64 - bits)
            own, first = np.unique(keys, return_index=True)
            repeated = np.ones(len(k), dtype=bool)
            repeated[first] = False
            held = seen.contains(own)
            repeated[first[held]] = True
            seen.add(own[~held])
            found[k] = repeated
            # earlier keys come with negative ids and are no records
            keep = found & (ident >= 0)
            yield pd.DataFrame({"id": ident[keep]})

    return run


def seen_before(records: DataFrame, earlier: DataFrame | None, *, key: str, record_id: str, bits: int = 64) -> DataFrame:
    """The ids of the records whose non-null key is in ``earlier`` or in a record with a smaller id.

    Keys compare byte by byte through a fingerprint: two keys share one with probability 2**-bits, which can only turn
    a new key into a seen one (see ``wrong_answers``). Ids must be unique and not negative; a record with a null key is
    never seen. An empty key is a key. Empty tables give no rows; other columns are ignored. The order of the file
    doesn't count, only the ids do.
    """
    if not 8 <= bits <= 64:
        raise ValueError("bits must be from 8 to 64")
    rows = records.filter(F.col(key).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("key"), F.col(record_id).cast("long").alias("id"))
    if earlier is not None:
        old = earlier.filter(F.col(key).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("key"), F.lit(-1).cast("long").alias("id"))
        rows = rows.unionByName(old)
    settled = rows.mapInPandas(_settle, "part long, key long, id long, again boolean")
    if bits < 64:
        # keys that share a fingerprint must meet
        settled = settled.withColumn("part", F.when(F.col("again"), F.col("part")).otherwise(F.shiftrightunsigned("key", 64 - bits)))
    placed = settled.repartition("part").sortWithinPartitions("id")
    return placed.mapInPandas(_probe(bits), "id long").withColumnRenamed("id", record_id)


class SeenIndex:
    """Keys seen so far, kept on disk between batches: Elias-Fano runs of ``parts`` hash partitions in a folder.

    ``probe`` answers a batch and merges its new keys: only the batch is shuffled, and of earlier keys only the coded runs
    are read, about ``2 + bits - log2(n)`` bits a key. A batch writes a new generation; the one before it can go once the
    answers are written. A partition of the batch and one of the index meet in a task, so ``parts`` must grow with the
    keys; a million keys a part is a good size.
    """

    _RUN = "part int, n long, low_bits int, buckets long, unary binary, low binary"

    def __init__(self, spark: SparkSession, *, bits: int = 64, parts: int = 64, folder: str | None = None) -> None:
        if not 8 <= bits <= 64:
            raise ValueError("bits must be from 8 to 64")
        self.spark, self.bits, self.parts = spark, bits, parts
        self.runs = spark.read.schema(self._RUN).parquet(folder) if folder else spark.createDataFrame([], self._RUN)

    def save(self, folder: str) -> None:
        """Writes the index, to be opened with ``folder``."""
        self.runs.write.parquet(folder)

    def probe(self, batch: DataFrame, *, key: str, record_id: str) -> DataFrame:
        """The ids of the records whose non-null key is in the index or in a record of the batch with a smaller id; adds their keys."""
        bits, parts = self.bits, self.parts
        rows = batch.filter(F.col(key).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("key"), F.col(record_id).cast("long").alias("id"))
        print_of = F.col("key") if bits == 64 else F.shiftrightunsigned("key", 64 - bits)
        settled = rows.mapInPandas(_settle, "part long, key long, id long, again boolean")
        # repeats within a map task are answered there; the first of each key goes to its part
        settled = materialize(settled.select("key", "id", "again"))
        first = settled.filter("NOT again").select(F.pmod(F.xxhash64(print_of), F.lit(parts)).cast("int").alias("part"), "key", "id")

        def meet(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            seen = SeenSet(bits)
            seen.runs = [EliasFano.from_row(bits, *r) for r in old[["n", "low_bits", "buckets", "unary", "low"]].itertuples(index=False)]
            seen.runs.sort(key=lambda r: -r.n)
            part = int(old["part"].iloc[0] if len(old) else new["part"].iloc[0])
            new = new.sort_values("id")
            keys = new["key"].to_numpy(dtype=np.int64).view(np.uint64) >> np.uint64(64 - bits)
            own, at = np.unique(keys, return_index=True)
            repeated = np.ones(len(keys), dtype=bool)
            held = seen.contains(own)
            repeated[at] = held
            seen.add(own[~held])
            answers = pd.DataFrame({"id": new["id"].to_numpy()[repeated]})
            runs = pd.DataFrame([(part, *r.to_row()) for r in seen.runs if r.n], columns=["part", "n", "low_bits", "buckets", "unary", "low"])
            return pd.concat([answers, runs], ignore_index=True).reindex(columns=["id", "part", "n", "low_bits", "buckets", "unary", "low"]).astype({c: "Int64" for c in ("id", "part", "n", "low_bits", "buckets")})

        met = materialize(self.runs.groupBy("part").cogroup(first.groupBy("part")).applyInPandas(meet, f"id long, {self._RUN}"))
        self.runs = met.filter("id IS NULL").drop("id")
        return settled.filter("again").select("id").unionByName(met.filter("id IS NOT NULL").select("id")).withColumnRenamed("id", record_id)

    def size(self) -> DataFrame:
        """One row: keys held, bytes they take, and the share of new keys that would be called seen, keys / 2 ** bits."""
        return self.runs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_keys"), F.coalesce(F.sum(F.length("unary") + F.length("low")), F.lit(0)).alias("n_bytes")).withColumn("wrong_rate", F.col("n_keys") / F.lit(2.0**self.bits))


def wrong_answers(records: DataFrame, earlier: DataFrame, *, key: str, record_id: str, bits: int) -> DataFrame:
    """One row: records, new_keys (first occurrences), wrong (of those, called seen) and the measured rate of wrong answers."""
    found = seen_before(records, earlier, key=key, record_id=record_id, bits=bits)
    known = records.filter(F.col(key).isNotNull())
    first = known.groupBy(key).agg(F.min(record_id).alias(record_id))
    first = first.join(earlier.select(key).distinct(), key, "left_anti").select(record_id)
    wrong = first.join(found.withColumn("called_seen", F.lit(1)), record_id, "left")
    return wrong.agg(
        F.lit(bits).alias("bits"), F.lit(records.agg(F.count(F.lit(1)).alias("n")).scalar()).alias("records"), F.count(F.lit(1)).alias("new_keys"), F.count("called_seen").alias("wrong")
    ).withColumn("wrong_rate", F.when(F.col("records") > 0, F.col("wrong") / F.col("records")))
