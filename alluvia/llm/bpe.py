"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked list of symbols, and decoding.

The tables are read from the vocabulary file of a public tokenizer (its JSON: model, added tokens, normaliser, split pattern);
no library encodes anything here. Text is cut at the special tokens, normalised (NFC, lower case character by character),
split into words by the file's pattern; each word's bytes are merged. Words recur, so each Python worker keeps the results
of the words that it has last met, up to CACHE of them, each as one string: its ids, a line feed, its tokens.

Defined results: a null text is empty; an empty text, or one of white space, has no ids and decodes to the empty string;
repeated rows are encoded alike; an empty table gives none; columns other than doc_id and the text are ignored by ``encode``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from alluvia.llm import words as W

CACHE = 300_000  # words, and half as many runs between white space (which cost little once their words are known), kept by each Python worker
LONGEST = 64  # characters of a word or run that is kept
#: Letters, digits and lower-case forms of the Unicode version that the tokenizers library uses, beyond those of Python's own tables.
LATER = {
    "L": r"\U00001c89-\U00001c8a\U0000a7cb-\U0000a7cd\U0000a7d2\U0000a7d4\U0000a7da-\U0000a7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0",
    "N": r"\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa",
}
FORMS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
FORMS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)} | {ord("Σ"): ord("σ")}
#: Marks that came after the Unicode version of the library's NFC, which so neither moves nor composes them.
NEWER = re.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e"
    "\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])"
)
SEPARATORS = re.compile("[\x1c-\x1f]")
LATE = re.compile("[" + "".join(map(chr, FORMS)) + "]")
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def letter_class(kind: str) -> str:
    """The characters of a general category, as ranges for a set of a pattern."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out) + LATER[kind]


WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Kept(dict):
    """Results by word or run, made on first use, up to CACHE // ``share`` of them. When half of that are new, those not met since the last time
    go, so that what recurs stays and the size is bounded."""

    def __init__(self, make, share: int = 1):
        super().__init__()
        self.make, self.share = make, share
        self.old: dict[str, str] = {}
        W.HELD.append(self)

    def __missing__(self, key: str) -> str:
        found = self.old.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(key) > LONGEST:
            return found
        if len(self) >= CACHE // self.share // 2:
            self.old = dict(self)
            super().clear()
        self[key] = found
        return found

    def clear(self) -> None:
        super().clear()
        self.old = {}


class Bpe:
    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            j = json.load(f)
        vocab = j["model"]["vocab"]
        self.end = j["model"]["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in j["added_tokens"]}
        if any("\n" in t for t in self.tokens.values()):
            raise ValueError(f"{file}: a token holds a line feed")
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        as_sets = lambda l, n, s: re.compile(pattern.replace("\\p{L}", l).replace("\\p{N}", n).replace("\\s", s))
        self.pattern = as_sets(letter_class("L"), letter_class("N"), WHITE)
        self.ascii = as_sets("a-z", "0-9", r"\t-\r ")
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in j["model"]["merges"]):
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.words, self.runs = Kept(self.word), Kept(self.run, 2)

    def merge(self, word: str) -> list[int]:
        """Ids of one word. The queue holds (rank, place, left, right, merged); an entry whose symbols have since changed is stale and skipped."""
        raw = word.encode("utf-8")
        n = len(raw)
        ids = [self.first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if n == 1:
            return ids
        ranks, get = self.ranks, self.ranks.get
        queue = [(r[0], i, a, b, r[1]) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get((a, b)))]
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, a, b, new = pop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := get((new, ids[k])):
                    push(queue, (r[0], i, new, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := get((ids[h], new))):
                push(queue, (r[0], h, ids[h], new, r[1]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> str:
        ids = self.merge(word)
        return " ".join(map(str, ids)) + "\n" + " ".join(map(self.tokens.__getitem__, ids))

    def run(self, run: str) -> str:
        """Ids and tokens of a run of text: normalised, then cut into words. Empty if there are none."""
        pattern = self.ascii
        if not run.isascii():
            run, pattern = "".join(unicodedata.normalize("NFC", x) for x in NEWER.split(run)), self.pattern
            if LATE.search(run):  # forms that lower() lacks, or chooses by what stands around a letter
                run = run.translate(FORMS)
        words = [self.words[w] for w in pattern.findall(run.lower())]
        return words[0] if len(words) == 1 else "\n".join(joined(words)) if words else ""

    def symbols(self, text: str) -> tuple[str, str]:
        """The ids of a text and its tokens, each joined by a space."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else (text,)):
            if k % 2:
                out.append(f"{self.special[part]}\n{part}")
            elif SEPARATORS.search(part):  # str.split() also divides at these, the pattern does not
                out.append(self.run(part))
            else:
                out.extend(map(self.runs.__getitem__, part.split()))
        return joined([x for x in out if x] if "" in out else out)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.symbols(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings in order; this vocabulary declares no decoder, so a space stands between them."""
        return " ".join(map(self.tokens.__getitem__, ids))


def joined(results: list[str]) -> tuple[str, str]:
    """All ids and all tokens of some results."""
    parts = "\n".join(results).split("\n")
    return " ".join(parts[::2]), " ".join(parts[1::2])


LOADED: dict[str, Bpe] = {}


def loaded(file: str) -> Bpe:
    if file not in LOADED:
        LOADED[file] = Bpe(file)
    return LOADED[file]


def encode(docs: DataFrame, file: str, text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, the number of ids and digests of the ids and of the decoded text; with ``ids``, also the ids themselves as an array.

    ``file`` is a path that each executor can open, such as that of an installed package's data."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file)
        W.release()  # what loading has freed
        for b in batches:
            out: list[list] = [[], [], [], []]
            for x in b.column(1):
                numbers, tokens = bpe.symbols(x.as_py() or "")
                out[0].append(numbers.count(" ") + 1 if numbers else 0)
                out[1].append(hashlib.sha256(numbers.encode("ascii")).hexdigest())
                out[2].append(hashlib.sha256(tokens.encode("utf-8")).hexdigest())
                out[3].append([int(i) for i in numbers.split(" ")] if ids and numbers else [])
            columns = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns, names = [*columns, pa.array(out[3], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        W.release()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(rows, ENCODED + (", ids array<int>" if ids else ""))
