"""Substring deduplication by a log-structured index of window fingerprints.

Texts arrive in batches, in the order of doc_id; a batch is dealt to chunks of consecutive doc_ids and written, packed, to the index, bucketed by chunk.
A chunk's distinct window fingerprints, cut by their leading bits into buckets and sorted, are exchanged once. In each bucket the chunks of the batch
are merged with one another, which gives the batch's run (sorted keys, and for each the chunk that was first), and with each run of earlier batches.
Runs are written bucketed, so a merge reads them where they lie and exchanges nothing of the history; the answer for each chunk is a bitmap, which
of its fingerprints stand in an earlier chunk, and which was first. What repeats within a chunk, the chunk sees by itself. When FAN runs of a level
have gathered, they are compacted to one of the next level.

A match is verified before it counts, by one rule for the batch and for the history. Maximal stretches of matching windows go, as text, each once,
to the chunk that had them first, where their words are compared with its own; matches within a chunk are compared there. Windows that fail
(equal fingerprints, other words) are spelt out, with all windows that share their fingerprints, and decided by their words alone.

Defined results: a null text has no words; a text of fewer words than a window keeps them all; rows that share a doc_id do
not repeat each other (neither has the smaller id), nor do rows with a null doc_id, which come after all others; an empty
table gives no rows; columns other than doc_id and text are ignored by ``mark`` or, with ``keep_text``, kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from alluvia.llm import words as W
from alluvia.storage import Fs, Scratch

U = np.uint64
CHUNK = 4 << 20  # bytes of text in a chunk, about
CHUNKS = 8192  # most chunks in a batch, but for those into which rows of one doc_id are split
FAN = 4
LAST = (1 << 63) - 1
BATCHES = 2  # of a call without an index of its own
WORDS = 100_000  # words of texts that a chunk keeps split
SPELT = 1_000_000  # fingerprints that are spelt out in one pass
RUN = "bucket int, keys binary, owners binary"
TEXTS = "chunk int, piece long, block binary"
ANSWER = "kind int, bucket int, chunk int, keys binary, owners binary"


class Index:
    """Runs of earlier batches and their texts: Parquet files bucketed by bucket and by chunk, listed in a manifest for each batch."""

    def __init__(self, spark: SparkSession, path: str, bits: int = 6):
        self.spark, self.path, self.bits, self.fs = spark, path.rstrip("/"), bits, Fs(spark)

    def manifest(self) -> dict:
        versions = [p for p, _, _ in self.fs.list(f"{self.path}/log") if p.endswith(".json")]
        return json.loads(self.fs.read(max(versions))) if versions else {"version": 0, "runs": [], "texts": [], "buckets": {}, "chunks": 0, "last": None}

    def commit(self, manifest: dict) -> None:
        if not self.fs.create(f"{self.path}/log/{manifest['version']:010d}.json", json.dumps(manifest)):
            raise RuntimeError(f"another writer added version {manifest['version']} of the index")

    def write(self, df: DataFrame, key: str, kinds: bool = False) -> tuple[str, int]:
        """A new table of the index, bucketed by ``key`` (and one part for each kind): its name, and the number of its buckets."""
        n, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"part-{uuid.uuid4().hex[:12]}"
        table = f"alluvia_{uuid.uuid4().hex}"
        w = df.write.bucketBy(n, key).sortBy(key).format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}")
        (w.partitionBy("kind") if kinds else w).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")
        return name, n

    def read(self, name: str, n: int, key: str, schema: str) -> DataFrame:
        """A table of the index, of which Spark knows that it is bucketed."""
        if not self.fs.exists(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        table = f"alluvia_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {n} BUCKETS LOCATION '{self.path}/{name}'")
        out = self.spark.table(table)
        out.schema  # noqa: B018  resolved before the name goes
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def add(self, run: str, texts: str, n: int, chunks: int, last: int | None) -> None:
        """List a batch's run and texts; compact where a level is full."""
        m = self.manifest()
        m = {"version": m["version"] + 1, "runs": [*m["runs"], [run, 0]], "texts": [*m["texts"], [texts, m["chunks"], m["chunks"] + chunks]], "buckets": m["buckets"] | {run: n, texts: n}, "chunks": m["chunks"] + chunks, "last": last}
        self.commit(m)
        while full := [k for k in {k for _, k in m["runs"]} if sum(x == k for _, x in m["runs"]) >= FAN]:
            level = min(full)
            old = [name for name, k in m["runs"] if k == level]
            joined = self.read(old[0], m["buckets"][old[0]], "bucket", RUN)
            for name in old[1:]:  # two by two, each where it lies
                joined = joined.groupBy("bucket").cogroup(self.read(name, m["buckets"][name], "bucket", RUN).groupBy("bucket")).applyInArrow(compacted, RUN)
            name, k = self.write(joined, "bucket")
            m = m | {"version": m["version"] + 1, "runs": [*[r for r in m["runs"] if r[0] not in old], [name, level + 1]], "buckets": m["buckets"] | {name: k}}
            self.commit(m)
            for gone in old:
                self.fs.delete(f"{self.path}/{gone}")


def coded(keys: np.ndarray) -> bytes:
    """Sorted fingerprints as differences, byte plane by byte plane, so that the high planes compress to nothing."""
    return np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def decoded(data: pa.Scalar) -> np.ndarray:
    x = np.frombuffer(data.as_buffer(), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(x.reshape(8, -1).T).view(U).ravel(), dtype=U) if len(x) else np.zeros(0, dtype=U)


def planes(owners: np.ndarray) -> bytes:
    return owners.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: pa.Scalar) -> np.ndarray:
    x = np.frombuffer(data.as_buffer(), dtype=np.uint8)
    return np.ascontiguousarray(x.reshape(4, -1).T).view(np.int32).ravel()


def run_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and owners of a bucket of a run, whatever the number of its rows."""
    keys, owners = [decoded(x) for x in table.column("keys")], [unplaned(x) for x in table.column("owners")]
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, dtype=U), np.zeros(0, dtype=np.int32))


def compacted(a: pa.Table, b: pa.Table) -> pa.Table:
    (x, ox), (y, oy) = run_of(a), run_of(b)
    keys, owners = np.concatenate([x, y]), np.concatenate([ox, oy])
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    bucket = (a if a.num_rows else b).column("bucket")[0].as_py()
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([coded(keys[new])], pa.binary()), "owners": pa.array([planes(owners[new])], pa.binary())})


def opened(table: pa.Table) -> pa.Table:
    """The rows of a chunk's blocks by doc_id, always in the same order: doc_id and text under these names, other columns by number."""
    order = np.argsort(table.column("piece").to_numpy())
    rows = pa.concat_tables([pa.ipc.open_stream(table.column("block")[int(i)].as_buffer()).read_all() for i in order])
    return rows.take(np.argsort(rows.column("doc_id").fill_null(LAST).to_numpy(), kind="stable"))


def narrowed(keys: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of ``width`` leading bits."""
    return keys if width == 64 else keys >> U(64 - width) << U(64 - width)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the first place of each, and for each place which of the distinct keys it has."""
    order = np.argsort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    which = np.empty(len(keys), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return keys[order[starts]], np.minimum.reduceat(order, starts) if len(keys) else order, which


def within(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among the known ones, which are sorted."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), dtype=bool)


class Chunk:
    """The windows of some texts: ``keys`` sorted and distinct, bucket by bucket (the leading bits of a key choose it), for each the smallest doc_id
    that has it and the first place (slice, word) where it stands there. ``only``: sorted keys beside which none counts."""

    def __init__(self, docs: pa.Table, k: int, bits: int, width: int = 64, only: np.ndarray | None = None):
        self.k, self.ids = k, docs.column("doc_id").fill_null(LAST).to_numpy()
        self.parts: list[tuple[int, W.Words, np.ndarray, np.ndarray]] = []  # first row, words, first words of windows, keys
        keys, owners, places = [], [], []
        for n, (first, data, offsets) in enumerate(W.slices(docs.column("text"))):
            w = W.find(data, offsets, W.SPACED, False)
            at, run = w.runs(w.hashes(), k)
            run = narrowed(run, width)
            self.parts.append((first, w, at, run))
            some = within(only, run) if only is not None else slice(None)
            keys.append(run[some])
            owners.append(self.ids[first + w.text_of()[at[some]]] if len(at) else np.zeros(0, dtype=np.int64))
            places.append(at[some].astype(np.int64) + (n << 32))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        f, o, p = join(keys, U), join(owners, np.int64), join(places, np.int64)
        if (self.ids[1:] < self.ids[:-1]).any():  # else the first place of a key is that in the smallest doc_id
            order = np.argsort(o, kind="stable")
            f, o, p = f[order], o[order], p[order]
        self.keys, first_, _ = distinct(f)
        self.owners, self.places = o[first_], p[first_]
        self.cuts = np.searchsorted(self.keys, np.arange(1 << bits, dtype=U) << U(64 - bits)) if bits else np.zeros(1, dtype=np.int64)
        self.cuts = np.append(self.cuts, len(self.keys))
        self.split: dict[tuple[int, int], list[bytes]] = {}
        self.held = 0

    def bucket(self, b: int) -> slice:
        return slice(self.cuts[b], self.cuts[b + 1])

    def words(self, n: int, word: int) -> tuple[list[bytes], int]:
        """All words of the text that a word of a slice belongs to, and the word's place among them."""
        w = self.parts[n][1]
        d = int(np.searchsorted(w.of, word, side="right")) - 1
        if (n, d) not in self.split:
            s, e = int(w.of[d]), int(w.of[d + 1])
            self.held += e - s
            if self.held > WORDS:
                self.split.clear()
                self.held = e - s
            self.split[n, d] = w.data[w.starts[s] : w.ends[e - 1]].tobytes().split()
        return self.split[n, d], word - int(w.of[d])

    def differing(self, words: list[bytes], start: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Of windows (at ``start`` in a text's words) whose keys are here: which of them have other words here. Stretches are compared at once."""
        place = self.places[np.searchsorted(self.keys, keys)]
        wrong = np.zeros(len(start), dtype=bool)
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(place) != 1), [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own, at = self.words(int(place[a] >> 32), int(place[a] & 0xFFFFFFFF))
            i, n = int(start[a]), b - a + self.k - 1
            if own[at : at + n] != words[i : i + n]:
                for j in range(b - a):
                    wrong[a + j] = own[at + j : at + j + self.k] != words[i + j : i + j + self.k]
        return wrong


def stretches(chunk: Chunk, n: int, flagged: np.ndarray, label: np.ndarray):
    """Maximal stretches of flagged windows of one text and one label in slice n: first window, end, words from its first to its last."""
    _, w, at, _ = chunk.parts[n]
    some = np.flatnonzero(flagged)
    if not len(some):
        return
    text = w.text_of()[at[some]]
    edges = np.flatnonzero(np.concatenate([[True], (np.diff(at[some]) != 1) | (text[1:] != text[:-1]) | (label[some][1:] != label[some][:-1]), [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        first, last = int(at[some[a]]), int(at[some[b - 1]]) + chunk.k
        yield int(some[a]), int(some[b - 1]) + 1, w.data[w.starts[first] : w.ends[last - 1]].tobytes().split()


class Deal:
    """Which chunk a row goes to: doc_ids from ``bounds[i]`` on to the chunks from ``first[i]``, of which a doc_id that has rows for more than one has several.

    Chunks that share a ``family`` hold rows of one doc_id, which do not repeat each other."""

    def __init__(self, bounds: np.ndarray, parts: np.ndarray, base: int):
        self.bounds, self.parts = bounds, parts
        self.first = base + np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(np.int64)
        self.base, self.chunks = base, int(parts.sum())
        self.family = np.repeat(self.first, parts)

    def of(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, ids, side="right")
        return (self.first[at] + np.arange(len(ids)) % self.parts[at]).astype(np.int64)


def deal(docs: DataFrame, volume: int, base: int, chunk: int) -> Deal:
    """Bounds between doc_ids such that chunks have about ``chunk`` bytes: quantiles of rows (approximate, some for each chunk), of which
    neighbours are taken together by their exact bytes. What the driver gets is bounded by the number of quantiles."""
    chunks = max(1, min(CHUNKS, -(-volume // chunk)))
    target = max(chunk, volume // CHUNKS)
    if volume <= 2 * target and chunks == 1:
        return Deal(np.zeros(0, dtype=np.int64), np.ones(1, dtype=np.int64), base)
    fine = 8 * chunks
    found = docs.agg(F.percentile_approx("doc_id", [i / fine for i in range(1, fine)], max(10_000, 4 * fine))).first()[0] if chunks > 1 else []
    edges = np.array(sorted({y for x in found or [] for y in (x, min(x + 1, LAST))} | {LAST}), dtype=np.int64)

    @W.freeing
    def count(batches):
        total = np.zeros(len(edges) + 1, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.searchsorted(edges, b.column(0).fill_null(LAST).to_numpy(), side="right"), b.column(1).to_numpy(), len(edges) + 1).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bin", "size"])

    sizes = np.zeros(len(edges) + 1, dtype=np.int64)
    for r in docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).mapInArrow(count, "bin int, size long").groupBy("bin").agg(F.sum("size").alias("size")).toLocalIterator():
        sizes[r["bin"]] = r["size"]
    lower = np.concatenate([[-LAST], edges])
    groups: list[tuple[int, int]] = []  # least doc_id, chunks
    held, closed = 0, True
    for i, size in enumerate(sizes.tolist()):  # bin i holds doc_ids from lower[i] to edges[i]
        if size > 2 * target and (i == len(edges) or edges[i] == lower[i] + 1):
            groups.append((int(lower[i]), -(-size // target)))
            closed = True
            continue
        if closed or (held and held + size > target):
            groups.append((int(lower[i]), 1))
            held, closed = 0, False
        held += size
    return Deal(np.array([x for x, _ in groups[1:]], dtype=np.int64), np.array([n for _, n in groups], dtype=np.int64), base)


def mark(docs: DataFrame, k: int = 13, index: Index | None = None, keep_text: bool = False, batch: int | None = None, chunk: int = CHUNK, width: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``keep_text``, every column of ``docs``, the text without its repeats, and n_removed.

    Up to ``batch`` bytes of text (half of it, but 32 GB at most, if not given) are one batch, by ranges of doc_id; they go through ``index`` or, where none
    is given, one of this call's own. A bucket is merged in one task, so an index for much text has more bits. Rows of a later call
    count as later than those of earlier ones, whatever their doc_ids. Fingerprints of fewer bits than 64 (``width``) collide more often, which
    changes no result."""
    own = docs if keep_text else docs.select("doc_id", "text")
    own = own.withColumn("doc_id", F.col("doc_id").cast("long"))
    volume = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passing = index is None
    index = index or Index(docs.sparkSession, Scratch(docs.sparkSession, "fingerprints").path("index"), max(7, (volume >> 23).bit_length()))
    batch = batch or min(CHUNK * CHUNKS, -(-volume // BATCHES) if passing else CHUNK * CHUNKS)
    split = deal(own, volume, 0, batch).bounds.tolist() if volume > batch else []
    ends = [None, *split, None]
    out = None
    for lo, hi in zip(ends, ends[1:]):
        some = own if lo is None else own.filter(F.col("doc_id").isNull() | (F.col("doc_id") >= lo) if hi is None else F.col("doc_id") >= lo)
        some = some if hi is None else some.filter(F.col("doc_id") < hi)
        part = _batch(some, k, index, keep_text, chunk, width, passing and hi is None)
        out = part if out is None else out.unionByName(part)
    return out


def _batch(own: DataFrame, k: int, index: Index, keep_text: bool, chunk: int, width: int, last: bool) -> DataFrame:
    spark, bits, m = own.sparkSession, index.bits, index.manifest()
    scratch = Scratch(spark, "fingerprints")
    volume, greatest = own.agg(F.sum(F.octet_length("text")), F.max("doc_id")).first()
    dealt = deal(own, volume or 0, m["chunks"], chunk)
    names = [f.name for f in own.schema.fields]
    numbered = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)]
    id_at = names.index("doc_id")
    family, base = dealt.family, dealt.base

    @W.freeing
    def pack(batches):
        piece = TaskContext.get().partitionId() << 33
        for b in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            to = dealt.of(b.column(id_at).fill_null(LAST).to_numpy())
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
            rows = pa.Table.from_batches([b]).rename_columns(numbered)
            chunks, blocks = [], []
            for i, j in zip(cuts, cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(rows.take(order[i:j]).combine_chunks())
                chunks.append(to[order[i]])
                blocks.append(sink.getvalue().to_pybytes())
            pieces_ = np.arange(piece, piece + len(chunks))
            piece += len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(pieces_, pa.int64()), pa.array(blocks, pa.binary())], names=["chunk", "piece", "block"])

    @W.releasing
    def pieces(key: tuple, table: pa.Table) -> pa.Table:
        c = Chunk(opened(table), k, bits, width)
        some = [b for b in range(1 << bits) if c.cuts[b] < c.cuts[b + 1]]
        return pa.table({"bucket": pa.array(some, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(some), pa.int32()), "keys": pa.array([coded(c.keys[c.bucket(b)]) for b in some], pa.binary())})

    def answer(table: pa.Table, seen: list[np.ndarray], owners: list[np.ndarray]) -> dict[str, list]:
        """For each chunk a bitmap of its keys that have an owner, and these owners; no row where there is none."""
        some = [i for i, s in enumerate(seen) if s.any()]
        chunks = table.column("chunk").to_pylist()
        return {"kind": [0] * len(some), "bucket": [table.column("bucket")[0].as_py()] * len(some), "chunk": [chunks[i] for i in some], "keys": [np.packbits(seen[i]).tobytes() for i in some], "owners": [planes(owners[i][seen[i]]) for i in some]}

    def as_answer(x: dict[str, list]) -> pa.Table:
        return pa.table([pa.array(x[n], t) for n, t in (("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()))], names=["kind", "bucket", "chunk", "keys", "owners"])

    @W.releasing
    def merged(table: pa.Table) -> pa.Table:
        """The chunks of the batch with one another: answers, and unless this is the last batch the run (kind 1)."""
        chunks, runs = table.column("chunk").to_numpy(), [decoded(x) for x in table.column("keys")]
        sizes = [len(r) for r in runs]
        by_chunk = np.argsort(chunks, kind="stable")  # then the first place of a key is that in its first chunk
        table, chunks, runs = table.take(by_chunk), chunks[by_chunk], [runs[i] for i in by_chunk]
        sizes = [sizes[i] for i in by_chunk]
        of = np.repeat(chunks, sizes).astype(np.int32)
        keys, first, which = distinct(np.concatenate(runs))
        owner = of[first][which]
        cuts = np.cumsum(sizes)[:-1]
        owners = np.split(owner, cuts)
        out = answer(table, [family[o - base] != family[c - base] for o, c in zip(owners, chunks)], owners)
        if not last:
            for name, x in (("kind", 1), ("bucket", table.column("bucket")[0].as_py()), ("chunk", -1), ("keys", coded(keys)), ("owners", planes(of[first]))):
                out[name].append(x)
        return as_answer(out)

    @W.releasing
    def probed(table: pa.Table, run: pa.Table) -> pa.Table:
        """The chunks of the batch with a run of the history."""
        keys, of = run_of(run)
        seen, owners = [], []
        for r in (decoded(x) for x in table.column("keys")):
            at = np.minimum(np.searchsorted(keys, r), max(0, len(keys) - 1))
            seen.append(keys[at] == r if len(keys) else np.zeros(len(r), dtype=bool))
            owners.append(of[at] if len(keys) else np.zeros(len(r), dtype=np.int32))
        return as_answer(answer(table, seen, owners) if table.num_rows else {n: [] for n in ("kind", "bucket", "chunk", "keys", "owners")})

    def owned(c: Chunk, found: pa.Table) -> np.ndarray:
        """The chunk that first had each key; -2: no earlier one."""
        none = np.iinfo(np.int64).max
        out = np.full(len(c.keys), none, dtype=np.int64)
        for b, packed, owners in zip(found.column("bucket").to_pylist(), found.column("keys"), found.column("owners")):
            if b is not None:
                own_ = c.bucket(b)
                at = np.arange(own_.start, own_.stop)[np.unpackbits(np.frombuffer(packed.as_buffer(), dtype=np.uint8), count=own_.stop - own_.start).astype(bool)]
                out[at] = np.minimum(out[at], unplaned(owners))
        return np.where(out == none, -2, out)

    @W.releasing
    def asked(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        """What is to be verified elsewhere: texts of stretches, each once, by the chunk that first had their windows. What repeats a smaller doc_id
        of this chunk is verified at once: under owner -1, keys that stand for several word sequences here. Under owner -2, a bit for each
        window of the chunk: what goes if all is verified."""
        wanted: dict[tuple[int, bytes], None] = {}
        c = Chunk(opened(table), k, bits, width)
        owner = owned(c, found)
        clashes, marks = [], []
        for n, (first, w, at, run) in enumerate(c.parts):
            if not len(at):
                continue
            place = np.searchsorted(c.keys, run)
            of = owner[place]
            for a, _, words in stretches(c, n, of >= 0, of):
                wanted[int(of[a]), b" ".join(words)] = None
            here = (of < 0) & (c.owners[place] < c.ids[first + w.text_of()[at]])
            marks.append((of >= 0) | here)
            for a, b, words in stretches(c, n, here, np.zeros(len(at), dtype=np.int64)):
                wrong = c.differing(words, np.arange(b - a), run[a:b])
                if wrong.any():
                    clashes.append(run[a:b][wrong])
        wanted[-2, np.packbits(np.concatenate(marks)).tobytes() if marks else b""] = None
        wrong_keys = np.unique(np.concatenate(clashes)).view(np.int64).tolist() if clashes else []
        owners, texts_ = [o for o, _ in wanted] + [-1] * len(wrong_keys), [t for _, t in wanted] + [None] * len(wrong_keys)
        return pa.table({
            "owner": pa.array(owners, pa.int32()), "claimant": pa.array([key[0].as_py()] * len(owners), pa.int32()),
            "claim": pa.array(texts_, pa.binary()), "key": pa.array([None] * len(wanted) + wrong_keys, pa.int64()),
        })

    def claimed(claims: pa.Table):
        """(row of claims, first words, words, keys) of each claimed stretch."""
        texts = pa.table({"doc_id": pa.array(np.arange(claims.num_rows)), "text": claims.column("claim").cast(pa.large_binary()).cast(pa.large_string())})
        q = Chunk(texts, k, bits, width)
        for n, (first, w, at, run) in enumerate(q.parts):
            for a, b, words in stretches(q, n, np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=np.int64)):
                yield first + int(np.searchsorted(w.of, at[a], side="right")) - 1, words, run[a:b]

    @W.releasing
    def compared(table: pa.Table, claims: pa.Table) -> pa.Table:
        """The keys of claimed windows that have other words here."""
        failed = []
        if claims.num_rows and table.num_rows:
            texts = pa.table({"doc_id": pa.array(np.arange(claims.num_rows)), "text": claims.column("claim").cast(pa.large_binary()).cast(pa.large_string())})
            q = Chunk(texts, k, bits, width)
            c = Chunk(opened(table), k, bits, width, q.keys)
            for n, (_, _, at, run) in enumerate(q.parts):
                for a, b, words in stretches(q, n, np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=np.int64)):
                    wrong = c.differing(words, np.arange(b - a), run[a:b])
                    if wrong.any():
                        failed.append(run[a:b][wrong])
        return pa.table({"key": pa.array(np.unique(np.concatenate(failed)).view(np.int64) if failed else np.zeros(0, dtype=np.int64))})

    def spelling(wanted, first: int | None):
        """(chunk, key, words, first) of every window whose key is wanted; ``first`` stands for its doc_id where given."""

        @W.freeing
        def spell(batches):
            for b in batches:
                for chunk_, block in zip(b.column(0).to_pylist(), b.column(2)):
                    keys, texts, ids = [], [], []
                    for w, ids_, at, run in windows(pa.ipc.open_stream(block.as_buffer()).read_all(), k, width):
                        for i in np.flatnonzero(within(wanted.value, run)).tolist():
                            keys.append(run[i])
                            texts.append(w.text(int(at[i]), k))
                            ids.append(int(ids_[i]) if first is None else first)
                    yield pa.RecordBatch.from_arrays([pa.array([chunk_] * len(keys), pa.int32()), pa.array(np.array(keys, dtype=U).view(np.int64)), pa.array(texts, pa.binary()), pa.array(ids, pa.int64())], names=["chunk", "key", "words", "first"])

        return spell

    @W.releasing
    def applied(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        """What is left of each row. A key that has failed is decided by its words alone; otherwise the marks say what goes."""
        docs_ = opened(table)
        ids = docs_.column("doc_id").fill_null(LAST).to_numpy()
        spelt, marks = {}, b""
        for x, words, first, m_ in zip(*(found.column(c).to_pylist() for c in ("key", "words", "first", "marks"))):
            if m_ is not None:
                marks = m_
            else:
                spelt[x, words] = first
        failed_ = np.sort(np.array([x for x, _ in spelt], dtype=np.int64).view(U))
        repeat_all, done = np.unpackbits(np.frombuffer(marks, dtype=np.uint8)).astype(bool), 0
        n_words, n_removed, digests, texts = [], [], [], []
        for first, data, offsets in W.slices(docs_.column("text")):
            w = W.find(data, offsets, W.SPACED, False)
            at, run = w.runs(w.hashes(), k) if spelt else (w.starts_of_runs(k), None)
            gone = np.zeros(len(w.starts) + 1, dtype=np.int32)
            if len(at):
                repeat = repeat_all[done : done + len(at)].copy()
                done += len(at)
                if spelt:
                    run = narrowed(run, width)
                    own_ids = ids[first + w.text_of()[at]]
                    for i in np.flatnonzero(within(failed_, run)).tolist():
                        repeat[i] = spelt[int(run[i : i + 1].view(np.int64)[0]), w.text(int(at[i]), k)] < own_ids[i]
                np.add.at(gone, at[repeat], 1)
                np.add.at(gone, at[repeat] + k, -1)
            kept = np.cumsum(gone[:-1]) == 0
            for d in range(len(w.of) - 1):
                s, e = int(w.of[d]), int(w.of[d + 1])
                keep = kept[s:e]
                left = int(np.count_nonzero(keep))
                n_words.append(e - s)
                n_removed.append(e - s - left)
                if keep_text:
                    texts.append(None if left == e - s else without(w, s, e, keep))
                else:
                    all_words = w.data[w.starts[s] : w.ends[e - 1]].tobytes().split() if e > s else []
                    digests.append(hashlib.sha256(b" ".join(all_words if left == e - s else compress(all_words, keep))).hexdigest())
        if keep_text:
            docs_ = docs_.rename_columns(names)
            old = docs_.column("text").combine_chunks() if docs_.column("text").num_chunks != 1 else docs_.column("text").chunk(0)
            out = docs_.set_column(names.index("text"), "text", pa.compute.coalesce(pa.array(texts, pa.string()), old.cast(pa.string())))
            return out.append_column("n_removed", pa.array(n_removed, pa.int64()))
        return pa.table({"doc_id": docs_.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = own.mapInArrow(pack, TEXTS).repartition(n, "chunk")
    texts, n = index.write(packed, "chunk")
    store = index.read(texts, n, "chunk", TEXTS)
    runs = store.groupBy("chunk").applyInArrow(pieces, "bucket int, chunk int, keys binary")
    answers = runs.groupBy("bucket").applyInArrow(merged, ANSWER)
    for name, _ in m["runs"]:
        answers = answers.unionByName(runs.groupBy("bucket").cogroup(index.read(name, m["buckets"][name], "bucket", RUN).groupBy("bucket")).applyInArrow(probed, ANSWER))
    name, n_buckets = index.write(answers, "bucket", kinds=True)
    here = f"{index.path}/{name}/kind=0"
    found = spark.read.schema("bucket int, chunk int, keys binary, owners binary").parquet(here) if index.fs.exists(here) else spark.createDataFrame([], "bucket int, chunk int, keys binary, owners binary")
    claims = scratch.save(store.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(asked, "owner int, claimant int, claim binary, key long"), "claims")
    failed = claims.filter("owner = -1").select("key")
    found = claims.filter("owner = -2").select(F.col("claimant").alias("chunk"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("words"), F.lit(None).cast("long").alias("first"), F.col("claim").alias("marks"))
    claims = claims.filter("owner >= 0").select("owner", "claim").distinct()  # a passage that many chunks have goes to its first chunk once
    for part, least, end in [*m["texts"], [texts, base, base + dealt.chunks]]:
        some = claims.filter(F.col("owner").between(least, end - 1))
        held = index.read(part, m["buckets"].get(part, n), "chunk", TEXTS)
        held = held.join(some.select(F.col("owner").alias("chunk")).distinct(), "chunk", "left_semi")
        failed = failed.unionByName(held.groupBy("chunk").cogroup(some.groupBy("owner")).applyInArrow(compared, "key long"))
    seen = Observation()
    failed = scratch.save(failed.distinct().observe(seen, F.count(F.lit(1)).alias("n")), "failed")
    if seen.get["n"]:
        parts, spelt = -(-seen.get["n"] // SPELT), None
        for p in range(parts):
            keys = failed.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == p).toArrow().column("key").to_numpy().view(U)
            wanted = spark.sparkContext.broadcast(np.sort(keys))
            rows = store.mapInArrow(spelling(wanted, None), "chunk int, key long, words binary, first long")
            for part, _, _ in m["texts"]:
                rows = rows.unionByName(index.read(part, m["buckets"][part], "chunk", TEXTS).mapInArrow(spelling(wanted, -LAST), "chunk int, key long, words binary, first long"))
            spelt = rows if spelt is None else spelt.unionByName(rows)
        spelt = scratch.save(spelt, "spelt")
        first = spelt.groupBy("key", "words").agg(F.min("first").alias("first"))
        found = found.unionByName(spelt.filter(F.col("chunk") >= base).select("chunk", "key", "words").distinct().join(first, ["key", "words"]), allowMissingColumns=True)
    if not last:
        index.add(f"{name}/kind=1", texts, n, dealt.chunks, greatest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields) + ", n_removed long" if keep_text else "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return store.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(applied, schema)


def windows(docs: pa.Table, k: int, width: int):
    """Words, doc_id of each window, first words, keys, slice by slice."""
    ids = docs.column("doc_id").fill_null(LAST).to_numpy()
    for first, data, offsets in W.slices(docs.column("text")):
        w = W.find(data, offsets, W.SPACED, False)
        at, run = w.runs(w.hashes(), k)
        run = narrowed(run, width)
        yield w, ids[first + w.text_of()[at]] if len(at) else np.zeros(0, dtype=np.int64), at, run


def without(w: W.Words, s: int, e: int, keep: np.ndarray) -> str:
    """The text of words s to e but for those not kept, and the white space after each of these."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
    parts = [w.data[w.starts[s + a] : (w.starts[s + b] if s + b < e else w.ends[e - 1])].tobytes() for a, b in zip(edges[::2], edges[1::2])]
    return b"".join(parts).decode("utf-8").rstrip()
