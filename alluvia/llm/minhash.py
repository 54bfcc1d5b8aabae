"""Near-duplicates by MinHash: many universal hash minima, bands, verification, connected components.

1. Each text's set of word shingles is hashed; ``bands * rows`` multiply-add hashes give minima. Texts with the same words in the same
   order form a class (128-bit cryptographic digest of the words) and go on as one node, so copies cost nothing further.
2. Nodes that share a band are candidates; the least node of a bucket is its centre. Each node is first tried against the centres of its
   buckets (stars, linear in the number of nodes). Then the pairs of nodes in one bucket but still in different components are compared by
   4-bit sketches of their signatures inside the join itself, so that only likely pairs (see 3) are ever emitted; buckets with the very
   same members count once. No pair of a bucket is left out unless its ends are already connected. More than WAVE likely pairs a
   node are verified in waves, each of which skips what earlier ones have connected.
3. A candidate is rejected by size, or by its sketch if that differs in more places than a pair just at the threshold does but with the
   probability by which the bands miss it (1e-7, the exact binomial tail beyond 68 of 200), and is confirmed on the full sets of the texts' own shingles.
4. Components come from alternating large-star and small-star.

A pair at the threshold 0.8 is missed by all of 40 bands of 5 with probability 1.3e-7, and less as it is more alike; so it is lost with 2.3e-7 in all.
More than some 10**9 distinct texts want more rows a band (fewer chance candidates) and more bands.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a text with fewer words
than a shingle has one shingle, the whole sequence; rows that repeat a doc_id are kept by ``groups``, each with its own class; a null doc_id
is never the least of a component unless all are null; an empty table gives no rows; other columns are ignored by ``groups`` and kept by
``deduplicated``, which judges rows, not doc_ids: of rows that share both doc_id and words one stays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from alluvia.llm import bloom
from alluvia.llm import words as W
from alluvia.llm.components import components
from alluvia.storage import Scratch

U = np.uint64
WAVE, LEAST = 16, 4_000_000  # likely pairs a node, or in all, that are verified before components are formed anew
CELL, CELL_BYTES, HELD = 256, 32 << 20, 600_000  # nodes and bytes of a centre's that are verified together; shingles that a verifying task keeps


def digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def shingles(text: bytes, k: int) -> set[bytes]:
    """The set of a text: runs of k words, lower-cased, joined by a space."""
    w = W.split(text, lower=True)
    return {b" ".join(w)} if 0 < len(w) < k else set(map(b" ".join, zip(*[w[i:] for i in range(k)])))


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(20240229)
    return g.integers(0, 1 << 64, n, dtype=U) | U(1), g.integers(0, 1 << 64, n, dtype=U)


def sets(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another, and where each text's begin."""
    h = w.hashes()
    at, run = w.runs(h, k)
    text = w.text_of()[at] if len(at) else at
    lengths = np.diff(w.of)
    few = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(few):
        run = np.concatenate([run, np.array([W.combine(h, w.of[d : d + 1], int(lengths[d]))[0] for d in few], dtype=U)])
        text = np.concatenate([text, few])
    order = np.lexsort((run, text))
    run, text = run[order], text[order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    run, text = run[new], text[new]
    return run, np.searchsorted(text, np.arange(len(lengths) + 1))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, bytes (of the words), digest (of the words, null if there are none), bands (one long each), sketch (4 bits of each minimum, 16 to a long)."""
    schema = "doc_id long, n_shingles long, bytes long, digest binary, bands array<long>, sketch array<long>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.forget()
        a, b = multipliers(bands * rows)
        salt = W.mix(np.arange(1, bands + 1, dtype=U))
        for batch in batches:
            for first, data, offsets in W.slices(batch.column(1)):
                w = W.find(data, offsets, W.SPACED, True)
                run, of = sets(w, k)
                n, full = np.diff(of), np.flatnonzero(np.diff(of))
                digests: list[bytes | None] = [None] * len(n)
                size = np.zeros(len(n), dtype=np.int64)
                for d in full.tolist():
                    text = w.joined(d)
                    digests[d], size[d] = digest(text), len(text)
                minima = np.empty((bands * rows, len(full)), dtype=U)
                if len(full):
                    for j in range(bands * rows):
                        minima[j] = np.minimum.reduceat(run * a[j] + b[j], of[full])
                mixed = W.mix(minima >> U(16))
                keys = np.zeros((bands, len(full)), dtype=U)
                for r in range(rows):
                    keys = W.mix(keys * U(31) + mixed[r::rows][:bands] + salt[:, None])
                band: list = [None] * len(n)
                sketch: list = [None] * len(n)
                low = np.zeros((len(full), -(-bands * rows // 16) * 16), dtype=np.uint8)
                low[:, : bands * rows] = (mixed & U(15)).astype(np.uint8).T
                low = (low[:, ::2] | low[:, 1::2] << 4).view(np.int64)
                for i, d in enumerate(full):
                    band[d], sketch[d] = keys[:, i].view(np.int64), low[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(size), pa.array(digests, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "bytes", "digest", "bands", "sketch"],
                )
        W.release()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(make, schema)


def named(docs: DataFrame, name: str) -> DataFrame:
    """The documents with the digest of their words."""
    columns = [f.name for f in docs.schema.fields]

    @W.freeing
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(b" ".join(w)) if x.is_valid and (w := W.split(x.as_buffer().to_pybytes(), lower=True)) else None for x in batch.column(columns.index("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*columns, name])

    return docs.mapInArrow(make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` binary")


def packed(docs: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and compressed words of each known node. Only documents whose doc_id may be that of a node are read on (``wanted``, a Bloom filter)."""

    @W.freeing
    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            digests, texts = [], []
            for x in batch.column(0):
                words = W.split(x.as_buffer().to_pybytes(), lower=True)
                if words:
                    joined = b" ".join(words)
                    digests.append(digest(joined))
                    texts.append(z.compress(joined))
                if sum(map(len, texts[-64:])) > 4 << 20 or len(texts) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], names=["digest", "packed"])
                    digests, texts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], names=["digest", "packed"])

    own = docs.select(docs["doc_id"].cast("long").alias("least"), docs["text"].alias("text")).filter(F.col("text").isNotNull())
    found = bloom.sifted(own, wanted, "least").select("text").mapInArrow(press, "digest binary, packed binary")
    return found.groupBy("digest").agg(F.first("packed").alias("packed")).join(known.select("node", "digest"), "digest").select("node", "packed")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are at least ``percent`` alike, each looked at where it has its ``meeting``.

    A text goes to a meeting once, however many pairs it has there. So texts are not copied for each pair, and no task holds more than two cells."""
    ends = pairs.select("meeting", F.col("u").alias("node")).unionByName(pairs.select("meeting", F.col("v").alias("node"))).distinct()
    there = ends.join(texts, "node").select(F.col("meeting").alias("place"), "node", "packed")

    @W.releasing
    def check(own: pa.Table, found: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        column = found.column("packed")
        place = {node: i for i, node in enumerate(found.column("node").to_pylist())}
        known: dict[int, set] = {}
        held = 0

        def of(node: int) -> set:
            nonlocal held
            if node not in known:
                if held > HELD:
                    known.clear()
                    held = 0
                known[node] = shingles(open_(column[place[node]].as_buffer()), k)
                held += len(known[node])
            return known[node]

        keep = []
        order = sorted(zip(own.column("v").to_pylist(), own.column("u").to_pylist(), range(own.num_rows)))
        for v, u, i in order:
            x, y = of(u), of(v)
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append(i)
        return own.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return pairs.groupBy("meeting").cogroup(there.groupBy("place")).applyInArrow(check, "u long, v long")


def meeting(a: str, b: str) -> Column:
    return F.xxhash64(F.least(a, b), F.greatest(a, b)).alias("meeting")


def classes(docs: DataFrame, k: int = 2, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, digest, component_id (the least doc_id of the component) and first (its class is the component's first) of every row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    most = most_differing(bands, rows, percent)
    signed = scratch.save(signatures(docs, k, bands, rows), "signed")
    nodes = signed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "bytes", "bands", "sketch")))
    # From here a node goes by a number, given when the table is written, so that edges are small.
    numbered = nodes.withColumns({"node": F.monotonically_increasing_id(), "n": F.col("n_shingles").cast("int")}).drop("n_shingles")
    nodes, n_nodes = saved(numbered, scratch, "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = scratch.save(banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("size")).filter("size > 1").select("band", "centre"), "shared")
    some = bloom.sifted(banded, scratch.save(bloom.of(shared, "band"), "shared-bands"), "band")
    members = scratch.save(some.join(shared, "band").select("band", "node", "n", "centre"), "members")
    # A node belongs to the least centre that it meets; a centre's nodes are dealt to cells, in which they are verified.
    centres = members.groupBy("node").agg(F.min("centre").alias("centre"))
    centres = scratch.save(nodes.select("node", "digest", "least", "n", "bytes", "sketch").join(centres, "node"), "centres")
    sizes = centres.groupBy("centre").agg(F.ceil(F.greatest(F.count("*") / CELL, F.sum("bytes") / CELL_BYTES)).alias("cells"))
    known = centres.join(sizes, "centre").withColumn("cell", F.xxhash64("centre", F.pmod(F.xxhash64("node"), F.col("cells")))).drop("cells", "bytes")
    known = scratch.save(known, "known")
    texts = scratch.save(packed(docs, known, scratch.save(bloom.of(known, "least"), "wanted")), "texts")
    star = members.filter(F.col("node") != F.col("centre")).select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
    star = scratch.save(likely(star, known, bands * rows, most, percent), "star")
    labels = components(scratch.save(confirm(star, texts, k, percent), "links"), scratch, "star")
    pairs, left = saved(across(members, known, labels, bands * rows, most, percent), scratch, "pairs")
    wave = 0
    while left:
        parts = -(-left // max(LEAST, WAVE * n_nodes))
        own = F.pmod(F.xxhash64("u", "v", F.lit(wave)), F.lit(parts)) == 0
        links = scratch.save(confirm(pairs.filter(own), texts, k, percent), f"links-{wave}")
        labels = components(labels.unionByName(links), scratch, f"wave-{wave}")
        if parts == 1:
            break
        wave += 1
        pairs, left = saved(apart(pairs.filter(~own), labels), scratch, f"pairs-{wave}")
    scratch.drop("texts", "members", "pairs", "star", "centres", "shared")
    joined = labels.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(labels.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    own = scratch.save(nodes.select("node", "digest", "least").join(joined, "node", "left").drop("node"), "own")
    several = own.filter(F.col("root").isNotNull())
    best = several.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("least"), F.col("digest").alias("digest"))).alias("best"))
    several = several.join(best, "root").select("digest", F.col("best.least").alias("component_id"), (F.col("digest") == F.col("best.digest")).alias("first"))
    alone = own.filter(F.col("root").isNull()).select("digest", F.col("least").alias("component_id"), F.lit(True).alias("first"))
    out = signed.select("doc_id", "n_shingles", "digest").join(several.unionByName(alone), "digest", "left")
    return out.select("doc_id", "n_shingles", "digest", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def groups(docs: DataFrame, k: int = 2, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the component) of every row."""
    return classes(docs, k, percent, bands, rows).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """One row of each component and every row without words, with all columns; the row with the least doc_id stays.

    What is to go is decided by doc_id and words. Only rows whose doc_id may be among the decisions (a Bloom filter) are exchanged for the exact
    answer; the others stay where they are."""
    scratch = Scratch(docs.sparkSession, "deduplicated")
    found = classes(docs, k, percent).filter(F.col("digest").isNotNull())
    decided = found.groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.first(F.col("first") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).filter(~(F.col("stays") & (F.col("n") == 1)))
    decided = scratch.save(decided.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__words"), F.col("stays").alias("__stays")), "decided")
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # so that none clashes with those added
    marked = docs.toDF(*names).withColumn("__id", F.col(names[docs.columns.index("doc_id")]).cast("long"))
    marked = bloom.flagged(marked, scratch.save(bloom.of(decided, "__id"), "filter"), "__id")
    sure = marked.filter(~F.col("__maybe")).select(*names)
    judged = named(marked.filter("__maybe").drop("__maybe").withColumnRenamed("__id", "__own"), "__digest")
    judged = judged.join(decided, judged["__own"].eqNullSafe(decided["__id"]) & judged["__digest"].eqNullSafe(decided["__words"]), "left")
    out = sure.unionByName(judged.filter(F.col("__stays").isNull()).select(*names))
    if decided.filter("__stays").limit(1).count():  # rows that share doc_id and words: the first in the order of their columns
        one = judged.filter(F.col("__stays")).groupBy("__own", "__digest").agg(F.min(F.struct(*names)).alias("one"))
        out = out.unionByName(one.select("one.*"))
    return out.toDF(*docs.columns)


def saved(df: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """The written table and its number of rows, observed while it is written."""
    seen = Observation()
    return scratch.save(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def alike(n, m, percent: int):
    """Sets of these sizes can be that much alike."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def differing(a: str, b: str, longs: int):
    """In how many places two sketches differ: a 4-bit field of their exclusive or with any bit set."""
    total = F.lit(0)
    for i in range(longs):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def most_differing(bands: int, rows: int, percent: int) -> int:
    """The least number of places such that a pair just ``percent`` alike differs in more with no greater probability than it shares no band."""
    n, p = bands * rows, (1 - percent / 100) * 15 / 16
    missed, beyond = (1 - (percent / 100) ** rows) ** bands, 0.0
    for places in range(n, 0, -1):
        beyond += math.comb(n, places) * p**places * (1 - p) ** (n - places)
        if beyond > missed:
            return places
    return 0


def likely(pairs: DataFrame, known: DataFrame, hashes: int, most: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes and sketches allow a link, and where they meet."""
    side = lambda x: known.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", "cell")))
    near = alike(F.col("n_u"), F.col("n_v"), percent) & (differing("sketch_u", "sketch_v", -(-hashes // 16)) <= most)
    return pairs.join(side("u"), "u").join(side("v"), "v").filter(near).select("u", "v", meeting("cell_u", "cell_v"))


def across(members: DataFrame, known: DataFrame, labels: DataFrame, hashes: int, most: int, percent: int) -> DataFrame:
    """Likely pairs (u > v) of nodes that share a bucket but no component, and where they meet; without those with the bucket's centre."""
    of = labels.select(F.col("u").alias("node"), F.col("v").alias("root"))
    named_ = members.select("band", "node", "centre").join(of, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    h, g = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    several = named_.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.bit_xor(h).alias("h"), F.bit_xor(g).alias("g")).filter("lo != hi")
    several = several.groupBy("size", "h", "g").agg(F.min("band").alias("band")).select("band")  # of buckets with the same members one
    left = named_.join(several, "band", "left_semi").join(known.select("node", "n", "sketch", "cell"), "node")
    side = lambda x: left.select("band", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "label", "sketch", "cell", "centre")))
    a, b = side("u"), side("v")
    near = differing("sketch_u", "sketch_v", -(-hashes // 16)) <= most
    both = a.join(b, (a["band"] == b["band"]) & (F.col("u") > F.col("v")) & (F.col("label_u") != F.col("label_v")) & (F.col("v") != F.col("centre_u")) & alike(F.col("n_u"), F.col("n_v"), percent) & near)
    return both.select("u", "v", meeting("cell_u", "cell_v")).distinct()


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    of = labels.withColumnRenamed("v", "root")
    out = pairs.join(of.select("u", F.col("root").alias("ru")), "u", "left").join(of.select(F.col("u").alias("v"), F.col("root").alias("rv")), "v", "left")
    return out.filter(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v", "meeting")
