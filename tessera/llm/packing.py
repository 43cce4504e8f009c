"""Best-fit packing of tokenised documents into fixed-length sequences, online, with a fixed number of open bins."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces

CAPACITY, OPEN_BINS = 2048, 256
#: Documents that one packing task takes; tasks grow in number with the table, and each leaves OPEN_BINS bins at most partly empty.
DOCS_PER_TASK = 100_000
#: Texts with a longer run of spaces, or of other characters, go to the tokenizer's own library, whose merging stays near-linear.
_LONGEST_RUN = 300

# Alphabet in which the byte-level pre-tokenizer's classes are fixed in every Unicode version; other texts go to the tokenizer's own library.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]")
_SPACES = re.compile(f"\\s{{{_LONGEST_RUN}}}")
# A special token that isn't in the alphabet: with none at all, the library would look for the empty one at every character.
_NEVER = "\0\1"
# The byte-level pre-tokenizer's fixed pattern.
_SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(path: str):
    """The file's vocabulary as a rank-ordered byte-pair encoding, or None if its ids don't follow from ranks alone."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
    if not plain or model.get("type", "BPE") != "BPE" or any(model.get(x) for x in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    vocab, byte_of = model["vocab"], _byte_of()
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = [vocab[m] for m in made]
    base = {c: vocab.get(c, -1) for c in byte_of}
    if min(base.values()) < 0 or any(x >= y for x, y in zip(order, order[1:], strict=False)) or order and max(base.values()) >= order[0]:
        return None
    ranks = {bytes(byte_of[c] for c in word): vocab[word] for word in [*base, *made]}
    return tiktoken.Encoding("from-file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={_NEVER: max(ranks.values()) + 1})


def _long_run(text: str) -> bool:
    """Whether a run reaches _LONGEST_RUN. Such a run fills one of the blocks of half its length, so others are ruled out by these."""
    half = _LONGEST_RUN // 2
    blocks = range(0, len(text) - half + 1, half)
    if any(text.find(" ", p, p + half) < 0 for p in blocks) and max(map(len, text.split()), default=0) >= _LONGEST_RUN:
        return True
    return any(text[p : p + half].isspace() for p in blocks) and bool(_SPACES.search(text))


class Encoder:
    """Token ids as little-endian 32-bit words, by the tokenizer file at `path`.

    Ids of a byte-level vocabulary whose ids are ordered as its merges follow from that order, so such texts are encoded
    by rank; texts outside the alphabet above, with very long runs or with an added token's content, and all other files
    by the tokenizer's library. special_tokens: whether the file's special tokens are found in texts, as the library does
    unless told otherwise, or read as plain text.
    """

    def __init__(self, path: str, special_tokens: bool = False):
        self.path, self.special, self.ranked = path, special_tokens, _ranked(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        self.added = [t["content"] for t in added if special_tokens or not t["special"]]

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = not self.special
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.ranked is None or any(t in text for t in self.added) or _OTHER.search(text) or _long_run(text):
            return self.whole(text)
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=1)
def encoder(path: str, special_tokens: bool) -> Encoder:
    """One encoder per Python worker, which serves many tasks."""
    return Encoder(path, special_tokens)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces behind a first that may be shorter."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


class Packer:
    """Online best fit. Open bins lie in stacks by free space; bit f of a bitset tells that some bin has f free."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.limit, self.next = capacity, open_bins, first
        self.bits, self.bins, self.open = 0, [[] for _ in range(capacity + 1)], 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item: the fullest open bin that it fits, else a new bin, for which the fullest closes if all are open."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.next
            self.next += 1
        if left := free - length:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def _tokenise(path: str, capacity: int, special_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special_tokens)
        for b in pieces(batches):
            at, number, starts, lens, crcs = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = encode.ids(text or "") + bytes(4)
                for n, (s, x) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(i)
                    number.append(n)
                    starts.append(s)
                    lens.append(x)
                    crcs.append(zlib.crc32(ids[4 * s : 4 * (s + x)]))
            rows = b.drop_columns(["text"]).take(pa.array(at, pa.int64()))
            extra = [pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lens, crcs))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *extra], names=[*rows.schema.names, "piece", "start", "length", "ids_crc32"])

    return run


def _pack(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for b in batches:
            places = [packer.place(x) for x in b.column("length").to_pylist()]
            extra = [pa.array([p[i] for p in places], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, docs_per_task: int = DOCS_PER_TASK, special_tokens: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document in a sequence.

    docs: doc_id, text (further columns are ignored). A document is its tokens and a closing id 0; null texts count as
    empty, so they are one token. Only documents over `capacity` tokens are cut. Rows repeating a doc_id are packed one
    by one, null ids too. An empty table gives no rows. Whole texts are tokenised where they are read; only the pieces'
    numbers are dealt out, by hash, to a number of packing tasks in proportion to the documents.
    tokenizer: path of the tokenizer file, readable on every executor. special_tokens: whether its special tokens are
    found in texts (the library's default, which the queries use) or read as plain text.
    """
    base = pick(docs, "doc_id", "text").select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    cols = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    tasks = max(1, -(-base.count() // docs_per_task))
    rows = base.mapInArrow(_tokenise(tokenizer, capacity, special_tokens), cols)
    return rows.repartition(tasks, "doc_id", "piece").mapInArrow(_pack(capacity, open_bins), f"{cols}, sequence_id long, offset long")
