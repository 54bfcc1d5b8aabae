"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers, cut into blocks of rows in the order of vec_id, and a block's components stored as bit
slices: for each component and bit, a bitmap over the rows. A query's scores over a block are sums of slices, added with
bitmap arithmetic: for each bit of the weights from the highest down, the slices of the components whose weight has that bit
are added to a running pair of sums and carries (negative weights add complements, a constant for all rows). The best
rows are then selected from the most significant slice of the scores downward; rows equal to the last score are the boundary, and of
them the smallest vec_ids are taken. Nothing is approximated, so every row is indexed and found.

The index is a table of blocks (ids, and the bitmaps themselves), which stays where it lies: queries are broadcast in blocks of at most
QUERY_BYTES, one pass over the index each, and a block of the index returns k rows a query.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, nor does a row without a
vec_id; vectors of other lengths are compared over the components that both have; rows that share the query's vec_id are the
query's own; of query rows that share one, that with the least vector asks; components of any size have as many slices
as they need, and the sums too; quantised components and scores beyond 64 bits saturate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alluvia.storage import Scratch

ROWS, QUERY_BYTES = 32_768, 2 << 20
U = np.uint64
FULL = U(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and floor(scale * x) of each vector that takes part."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).filter(usable).select("vec_id", F.transform(x, lambda e: F.floor(e * scale)).alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, filled with zeros to the longest."""
    lengths = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), -1)
    out = np.zeros((len(lengths), max(lengths, default=0)), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


class Sliced:
    """A block: ids in ascending order, and for each component its slices over the rows."""

    def __init__(self, ids: np.ndarray, lo: int, slices: np.ndarray):
        self.ids, self.n, self.lo, self.slices = ids, len(ids), lo, slices
        self.dims, self.bits, self.width = slices.shape
        self.all = np.packbits(np.arange(self.width * 64) < self.n, bitorder="little").view(U)

    @staticmethod
    def of(ids: np.ndarray, values: np.ndarray) -> Sliced:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order].astype(np.int64)
        n, dims, width = len(ids), values.shape[1], -(-len(ids) // 64)
        lo = int(values.min()) if values.size else 0
        raised = values.astype(U) - U(lo % (1 << 64))  # modulo 2**64, so exact
        bits = max(1, int(raised.max()).bit_length()) if values.size else 1
        slices = np.zeros((dims, bits, width), dtype=U)
        padded = np.zeros((width * 64, dims), dtype=U)
        padded[:n] = raised
        for b in range(bits):
            on = ((padded >> U(b)) & U(1)).astype(np.uint8)
            slices[:, b] = np.packbits(on, axis=0, bitorder="little").T.copy().view(U)
        return Sliced(ids, lo, slices)

    def scores(self, weights: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of the sum, least significant first, and the constant to add to it."""
        w = [int(x) for x in weights[: self.dims]]
        size, negative = [abs(x) for x in w], [x < 0 for x in w]
        top = (1 << self.bits) - 1
        constant = self.lo * sum(w) - top * sum(x for x, n in zip(size, negative) if n)
        height = max(1, (sum(size) * top).bit_length())
        sums, carries = np.zeros((height, self.width), dtype=U), np.zeros((height, self.width), dtype=U)
        one, two, three = (np.empty((height, self.width), dtype=U) for _ in range(3))
        for j in range(max(size, default=0).bit_length() - 1, -1, -1):
            sums[1:], carries[1:] = sums[:-1].copy(), carries[:-1].copy()
            sums[0] = carries[0] = 0
            h = min(height, max(self.bits, (sum(x >> j for x in size) * top).bit_length()))
            for d in (d for d, x in enumerate(size) if x >> j & 1):
                x = ~self.slices[d] if negative[d] else self.slices[d]
                low = min(h, self.bits)
                s, c, t, u, v = sums[:h], carries[:h], one[:h], two[:h], three[:h]
                np.bitwise_xor(s, c, out=t)  # s + c + x: sums s ^ c ^ x, carries s & c | (s ^ c) & x
                np.bitwise_and(s, c, out=u)
                np.bitwise_and(t[:low], x[:low], out=v[:low])
                u[:low] |= v[:low]
                t[:low] ^= x[:low]
                s[:] = t
                c[1:] = u[:-1]
                c[0] = 0
        carry = np.zeros(self.width, dtype=U)
        for i in range(height):
            a, b = sums[i], carries[i]
            x = a ^ b
            sums[i], carry = x ^ carry, (a & b) | (x & carry)
        return sums, constant

    def best(self, own: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, without those of id ``own``; of equal rows the smallest ids."""
        sums, constant = self.scores(weights)
        sure, open_ = np.zeros(self.width, dtype=U), self.all.copy()
        for at in range(int(np.searchsorted(self.ids, own)), int(np.searchsorted(self.ids, own, side="right"))):
            open_[at // 64] &= ~(U(1) << U(at % 64))
        for s in sums[::-1]:
            some = open_ & s
            reached = sure | some
            n = int(np.bitwise_count(reached).sum())
            if n > k:
                open_ = some
            else:
                sure = reached
                open_ = open_ & ~s
                if n == k:
                    open_ = np.zeros_like(open_)
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if len(rows) < k:
            boundary = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
            rows = np.concatenate([rows, boundary[: k - len(rows)]])
        bits = (sums[:, rows // 64] >> (rows % 64).astype(U)) & U(1)
        score = (bits.astype(object) * [[1 << i] for i in range(len(sums))]).sum(axis=0) + constant if len(sums) > 62 else (bits.astype(np.int64) << np.arange(len(sums), dtype=np.int64)[:, None]).sum(axis=0).astype(object) + constant
        return self.ids[rows], np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in score], dtype=np.int64)


def blocks(quantised_: DataFrame) -> DataFrame:
    """The index: rows packed to blocks of at most ROWS, as bitmaps."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x = Sliced.of(t.column(0).to_numpy(), matrix(t.column(1).chunk(0)))
            return pa.RecordBatch.from_arrays([pa.array([x.dims], pa.int32()), pa.array([x.bits], pa.int32()), pa.array([x.lo], pa.int64()), pa.array([x.ids.tobytes()], pa.binary()), pa.array([x.slices.tobytes()], pa.binary())], names=["dims", "bits", "lo", "ids", "slices"])

        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                part = b.slice(a, ROWS)
                if held and sum(x.num_rows for x in held) + part.num_rows > ROWS:
                    yield flush()
                held.append(part)
        if sum(x.num_rows for x in held):
            yield flush()

    return quantised_.mapInArrow(make, "dims int, bits int, lo long, ids binary, slices binary")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its k best other rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "bitsliced")
    q = quantised(vectors, scale)
    index = scratch.save(blocks(q), "index")
    asking = scratch.save(q.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q")), "asking")
    n, longest = asking.agg(F.count("*"), F.max(F.size("q"))).first()
    passes = max(1, -(-n * 8 * (longest or 1) // QUERY_BYTES))
    best = None
    for p in range(passes):
        asked = asking.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).toArrow().combine_chunks()
        ids = asked.column("vec_id").to_numpy()
        weights = matrix(asked.column("q").chunk(0)) if len(ids) else np.zeros((0, 0), dtype=np.int64)
        part = index.mapInArrow(searching(spark.sparkContext.broadcast((ids, weights)), k), "query_id long, vec_id long, score long")
        if passes > 1:
            part = scratch.save(part, f"best-{p}")
        best = part if best is None else best.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searching(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value
        for batch in batches:
            for dims, bits, lo, ids, slices in zip(*batch.columns):
                i = np.frombuffer(ids.as_buffer(), dtype=np.int64)
                block = Sliced(i, lo.as_py(), np.frombuffer(slices.as_buffer(), dtype=U).reshape(dims.as_py(), bits.as_py(), -(-len(i) // 64)))
                for a in range(0, len(own), 1024):
                    found = [(x, *block.best(x, weight, k)) for x, weight in zip(own[a : a + 1024].tolist(), w[a : a + 1024])]
                    columns = [np.full(len(f), x) for x, f, _ in found], [f for _, f, _ in found], [s for _, _, s in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return search
