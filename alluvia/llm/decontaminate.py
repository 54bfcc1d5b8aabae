"""Benchmark decontamination by a prefix-filtered join of document words with item windows.

A window is ``k`` consecutive words of an item (all of a shorter item). Containment of a window is exact, so of its words in
the order of rarity a prefix of one, its rarest word in the corpus, is necessary: only where that word stands in a document
can the window stand. The place of the word in the window then fixes where the window must begin (positional bound), which must
lie within the document together with the window's length (length bound); a fingerprint of the item-sized run and lastly its
very words decide. Rarity is counted over all documents (only words of items are counted).

The windows go to the executors in blocks of at most ``block`` distinct windows (some 100 bytes each, so a block's size is
bounded whatever the benchmark's); each further block is a further pass over the documents, written between passes.

Defined results: a null text or item has no words; an item without words has no window and is never found; items that repeat,
or share an item_id, count once by item_id; the words of an item whose item_id is null are hit in ``find``, which lists no id for
them, while ``report``, like its SQL, leaves such items out; rows that repeat a doc_id each get a result; empty tables
give no rows or no hits; ``find`` keeps every column of the documents and adds its own under the names that it is given.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alluvia.llm import words as W
from alluvia.storage import Scratch

U = np.uint64
BLOCK = 200_000


def item_windows(items: DataFrame, k: int) -> DataFrame:
    """(words, item_id) of every window; words joined by a space."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), []
            for first, data, offsets in W.slices(batch.column(1)):
                w = W.find(data, offsets, W.ALNUM, True)
                for d in range(len(w.of) - 1):
                    own = [w.word(i) for i in range(w.of[d], w.of[d + 1])]
                    n = min(k, len(own))
                    texts += [(b" ".join(own[j : j + n]), ids[first + d]) for j in range(len(own) - n + 1 if n else 0)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in texts], pa.binary()), pa.array([i for _, i in texts], pa.int64())], names=["words", "item_id"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return own.mapInArrow(make, "words binary, item_id long")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Fingerprints of single words, as Words.hashes() gives them."""
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in words])
    return W.Words(data, ends - [len(x) for x in words], ends, np.array([0, len(words)])).hashes()


def counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of a sorted array of fingerprints stands in all documents."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        member = bloom(vocabulary)
        for batch in batches:
            for _, data, offsets in W.slices(batch.column(0)):
                h = W.find(data, offsets, W.ALNUM, True).hashes()
                h = h[member[h & U(MASK)]]
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["at", "n"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    if len(vocabulary):
        for r in docs.select("text").mapInArrow(make, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r["at"]] = r["n"]
    return out


MASK = (1 << 20) - 1


def bloom(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(MASK + 1, dtype=bool)
    out[hashes & U(MASK)] = True
    return out


class Block:
    """Some windows, each under its rarest word."""

    def __init__(self, windows: list[list[bytes]], items: list[list[int]], rarity: dict[bytes, int]):
        self.items = items
        self.words = [b" ".join(w) for w in windows]
        self.length = np.array([len(w) for w in windows], dtype=np.int64)
        self.place = np.array([min(range(len(w)), key=lambda i: (rarity.get(w[i], 0), w[i], i)) for w in windows], dtype=np.int64)
        prefix = word_hashes([w[p] for w, p in zip(windows, self.place)])
        self.hash = np.array([W.combine(word_hashes(w), np.array([0]), len(w))[0] for w in windows], dtype=U)
        order = np.argsort(prefix, kind="stable")
        self.length, self.place, self.hash = self.length[order], self.place[order], self.hash[order]
        self.items, self.words = [items[i] for i in order], [self.words[i] for i in order]
        self.prefix, self.begin = np.unique(prefix[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))

    def search(self, w: W.Words, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence."""
        h = w.hashes()
        some = np.flatnonzero(member[h & U(MASK)])
        at = np.minimum(np.searchsorted(self.prefix, h[some]), len(self.prefix) - 1)
        ok = self.prefix[at] == h[some]
        some, at = some[ok], at[ok]
        n = self.end[at] - self.begin[at]
        window = np.repeat(self.begin[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)
        start = np.repeat(some, n) - self.place[window]
        text = w.text_of()
        own = np.repeat(text[some], n)
        ok = (start >= w.of[own]) & (start + self.length[window] <= w.of[own + 1])
        start, window = start[ok], window[ok]
        found = np.zeros(len(start), dtype=bool)
        for size in np.unique(self.length[window]):
            same = np.flatnonzero(self.length[window] == size)
            found[same] = W.combine(h, start[same], int(size)) == self.hash[window[same]]
        start, window = start[found], window[found]
        sure = [b" ".join([w.word(s + i) for i in range(self.length[x])]) == self.words[x] for s, x in zip(start, window)]
        return start[sure], window[sure]


def find(docs: DataFrame, items: DataFrame, k: int = 8, block: int = BLOCK, words: str = "n_words", hits: str = "hit_bits", found: str = "found_items") -> DataFrame:
    """The documents with the number of words, a bitmap of those that are hit, and the sorted item_ids whose windows occur."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    windows = item_windows(items, k).groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    windows = scratch.save(windows, "windows")
    total = windows.count()
    blocks = max(1, -(-total // block))
    out = docs.withColumns({words: F.lit(None).cast("long"), hits: F.lit(None).cast("binary"), found: F.lit(None).cast("array<long>")})
    for n in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == n).collect() if total else []
        split = [r["words"].split(b" ") for r in rows]
        vocabulary = sorted({x for w in split for x in w})
        hashes = word_hashes(vocabulary) if vocabulary else np.zeros(0, dtype=U)
        order = np.sort(hashes)
        seen = dict(zip(order.tolist(), counts(docs, order).tolist()))
        rarity = {w: seen[h] for w, h in zip(vocabulary, hashes.tolist())}
        shared = spark.sparkContext.broadcast(Block(split, [list(r["items"]) for r in rows], rarity) if rows else None)
        out = out.mapInArrow(searcher(shared, [f.name for f in out.schema.fields], words, hits, found), out.schema)
        if n + 1 < blocks:
            out = scratch.save(out, f"pass-{n}")
            scratch.drop(f"pass-{n - 1}")
    return out


def searcher(shared, names: list[str], words: str, hits: str, found: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = shared.value
        member = bloom(block.prefix) if block else None
        text_at, words_at, hits_at, found_at = (names.index(x) for x in ("text", words, hits, found))
        for batch in batches:
            before, listed = batch.column(hits_at), batch.column(found_at)
            n_words, bits, items = [], [], []
            for first, data, offsets in W.slices(batch.column(text_at)):
                w = W.find(data, offsets, W.ALNUM, True)
                gone = np.zeros(len(w.starts) + 1, dtype=np.int32)
                by_text: dict[int, set[int]] = defaultdict(set)
                if block and len(w.starts):
                    start, window = block.search(w, member)
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + block.length[window], -1)
                    for d, x in set(zip((np.searchsorted(w.of, start, side="right") - 1).tolist(), window.tolist())):
                        by_text[d].update(block.items[x])
                hit = np.cumsum(gone[:-1]) > 0
                for d in range(len(w.of) - 1):
                    own, old = hit[w.of[d] : w.of[d + 1]], before[first + d].as_py()
                    own = own | np.unpackbits(np.frombuffer(old, dtype=np.uint8), count=len(own)).astype(bool) if old else own
                    n_words.append(len(own))
                    bits.append(np.packbits(own).tobytes() if own.any() else None)
                    items.append(sorted(by_text[d] | set(listed[first + d].as_py() or ())) if d in by_text or listed[first + d].is_valid else None)
            columns = list(batch.columns)
            columns[words_at], columns[hits_at], columns[found_at] = pa.array(n_words, pa.int64()), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return make


def report(docs: DataFrame, items: DataFrame, k: int = 8, least: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    named_items = items.filter(F.col("item_id").isNotNull())
    hit = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), named_items, k, block)
    found = F.coalesce("found_items", F.array().cast("array<long>"))
    named = F.array_join(F.array_sort(found.cast("array<string>")), ",")
    return hit.select("doc_id", "n_words", bits_set(F.col("hit_bits")).alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(named.cast("binary"), 256).alias("items_sha256"), (F.size(found) >= least).alias("contaminated"))


def bits_set(bits):
    """Set bits of a binary column: those of each hexadecimal digit, counted by digit."""
    digits = F.hex(bits)
    count = F.lit(0)
    for weight in range(1, 5):
        of_weight = "".join(f"{x:X}" for x in range(16) if x.bit_count() == weight)
        count = count + (F.length(digits) - F.length(F.translate(digits, of_weight, ""))) * weight
    return F.coalesce(count, F.lit(0)).cast("long")
