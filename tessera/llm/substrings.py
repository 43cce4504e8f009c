"""Removal of repeated byte strings: shards' sorted suffixes and Burrows-Wheeler transforms, merged by interleave refinement."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces, stored, texts_of

#: Bytes of a string that is removed if repeated, of a shorter one that is told of, and of the grams whose minimum names
#: a window of the latter.
LENGTH, NEAR, GRAM = 400, 300, 64
#: Starts that one slice covers at most, bytes of slices that one merging task takes, and of one shard.
SLICE_STARTS, TASK_BYTES, SHARD_BYTES = 2048, 512 << 10, 256 << 10
#: Bytes of different slices that meet under one key at most; those of other keys are cut into ever finer cells of starts.
KEY_BYTES, CELLS = 256 << 10, (16, 1)
#: Bytes that a symbol of the transforms has at most.
STEP = 50
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 21)
        with np.errstate(over="ignore"):
            for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, x, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bytes before each place, weighted with the base's powers, and the inverse powers."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return total, down


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the `gram` bytes from each place that has as many."""
    total, down = _sums(data)
    with np.errstate(over="ignore"):
        return _mixed((total[gram:] - total[:-gram]) * down[: len(total) - gram])


def window_minima(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every `length` bytes the least hash of the grams within (equal strings have equal minima); and the grams' hashes."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = gram_hashes(data, gram)
    w = length - gram + 1
    count = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[w - 1 : w - 1 + count]), h


_SLICES = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("mins", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("multi", pa.list_(pa.bool_()))])


def _slices(length: int, near: int, gram: int):
    """Per document: runs of neighbouring windows with one minimum, cut at SLICE_STARTS, with a hash of their bytes.

    Windows are of `near` bytes, slices reach as far as strings of `length` bytes from their starts do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=512 << 10):
            texts = texts_of(b.column("text"))
            data = b"".join(texts)
            lens = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(lens)
            m, grams = window_minima(np.frombuffer(data, np.uint8), near, gram)
            doc = np.repeat(np.arange(len(texts)), lens)[: len(m)]
            p = np.arange(len(m))
            valid = p + near <= ends[doc] if len(m) else np.zeros(0, bool)
            fresh = valid.copy()
            fresh[1:] &= ~valid[:-1] | (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(fresh)
            # a run ends before the next run's first window or at the first window that crosses its document's end
            stop = np.minimum(np.append(first[1:], len(m)), ends[doc[first]] - near + 1)
            parts = -(-(stop - first) // SLICE_STARTS)
            at = np.repeat(first, parts) + SLICE_STARTS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            size = np.minimum(SLICE_STARTS, np.repeat(stop, parts) - at)
            reach = np.minimum(size + length - 1, ends[doc[at]] - at)
            view = memoryview(data)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(view[i : i + n], seed=k) for i, n, k in zip(at.tolist(), reach.tolist(), size.tolist(), strict=True)), np.uint64, len(at))
            # a string can repeat within a slice only if the slice's minimum does
            span = near - gram
            multi = np.fromiter((np.count_nonzero(grams[i : i + n + span] == v) > 1 for i, n, v in zip(at.tolist(), size.tolist(), m[at], strict=True)), bool, len(at))
            of = doc[at]
            offsets = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32))
            cols = (m[at].view(np.int64), hashes.view(np.int64), (at - (ends - lens)[of]).astype(np.int32), reach.astype(np.int32), size.astype(np.int32), multi)
            yield pa.RecordBatch.from_arrays([b.column("ka"), b.column("kb"), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in cols)], names=_SLICES.names)

    return run


class Shard(NamedTuple):
    """Suffixes in order, with their transform. A symbol is `step` bytes, so the symbols of a suffix are `step` places apart.

    order: the suffixes' places; common: how many symbols a suffix shares with the one before it, as far as strings are
    compared; keys: the transform, (symbol before a suffix) * wide + (that suffix's rank), in order; short: how many
    suffixes, the first ones, are shorter than a symbol.
    """

    order: np.ndarray
    common: np.ndarray
    keys: np.ndarray
    short: int


def _symbols(data: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
    """By place: the number (from 1) of the `step` bytes there among all such, 0 where fewer are left in the string."""
    out = np.zeros(len(data), np.int64)
    whole = np.flatnonzero(left >= step)
    if len(whole):
        out[whole] = np.unique(gram_hashes(data, step)[whole], return_inverse=True)[1] + 1
    return out


def shard_of(lo: int, hi: int, symbols: np.ndarray, left: np.ndarray, step: int, rounds: int) -> Shard:
    """A shard of its own: the suffixes of whole strings, at places from lo up to hi, in order of their first `rounds` symbols."""
    n, wide = hi - lo, len(symbols) + 1
    rank, k = symbols[lo:hi], 1
    while k < rounds:  # twice as many symbols each time
        far = min(k, rounds - k) * step
        beyond = np.zeros(n, np.int64)
        beyond[: max(0, n - far)] = np.where(left[lo : max(lo, hi - far)] >= far, rank[far:], 0)
        rank = np.unique(rank * wide + beyond, return_inverse=True)[1]
        k = min(2 * k, rounds)
    order = np.argsort(rank, kind="stable")
    order += lo
    common = np.concatenate([np.zeros(min(n, 1), np.int64), common_symbols(order[:-1], order[1:], symbols, left, step, rounds)])
    after, symbol = _after(order, symbols, left, step)
    return Shard(order, common, np.sort(symbol * wide + after), n - len(after))


def _after(order: np.ndarray, symbols: np.ndarray, left: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix of a symbol or more, in order: the rank of the suffix one symbol on, and its first symbol."""
    low = order.min() if len(order) else 0
    ranks = np.zeros((order.max() - low + 1) if len(order) else 0, np.int64)
    ranks[order - low] = np.arange(len(order))
    whole = order[left[order] >= step]
    return ranks[whole - low + step], symbols[whole]


def merge(a: Shard, b: Shard, symbols: np.ndarray, left: np.ndarray, step: int, rounds: int) -> Shard:
    """Both shards as one; their suffixes are interleaved, not sorted.

    The interleave is known by symbols: after r rounds, `lo` of b's suffixes are less than a suffix of a in r symbols. A
    round takes a suffix's bound from that of the suffix one symbol on: as many of b's suffixes are less as b's
    transform has smaller symbols, or the same symbol before a suffix below the bound, until the interleave is stable or
    known as far as strings are compared. Common prefixes stay within a shard's neighbours and are read off the symbols
    where suffixes of both meet.
    """
    wide = len(symbols) + 1
    after, symbol = _after(a.order, symbols, left, step)
    base = symbol * wide
    lo = np.zeros(len(a.order), np.int64)
    for _ in range(rounds):
        was, lo = lo, np.concatenate([np.zeros(a.short, np.int64), b.short + np.searchsorted(b.keys, base + lo[after])])
        if np.array_equal(lo, was):
            break
    n = len(a.order) + len(b.order)
    at_a = np.arange(len(a.order)) + lo
    of_b = np.ones(n, bool)
    of_b[at_a] = False
    at_b = np.flatnonzero(of_b)
    order, common = np.empty(n, np.int64), np.empty(n, np.int64)
    order[at_a], order[at_b], common[at_a], common[at_b] = a.order, b.order, a.common, b.common
    meet = np.flatnonzero(of_b[1:] != of_b[:-1])
    common[meet + 1] = common_symbols(order[meet], order[meet + 1], symbols, left, step, rounds)
    # both transforms stay in order under their new ranks: two runs to merge
    keys = np.sort(np.concatenate([x.keys - x.keys % wide + at[x.keys % wide] for x, at in ((a, at_a), (b, at_b))]), kind="stable")
    return Shard(order, common, keys, a.short + b.short)


def common_symbols(a: np.ndarray, b: np.ndarray, symbols: np.ndarray, left: np.ndarray, step: int, rounds: int) -> np.ndarray:
    """How many symbols, up to `rounds`, the suffixes at a's and b's places have in common."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for r in range(rounds):
        live = live[np.minimum(left[a[live]], left[b[live]]) >= (r + 1) * step]
        live = live[symbols[a[live] + r * step] == symbols[b[live] + r * step]]
        out[live] = r + 1
    return out


def step_of(length: int, near: int) -> int:
    """Bytes of a symbol: the largest divisor of both lengths up to STEP."""
    return max(d for d in range(1, min(STEP, near) + 1) if length % d == 0 and near % d == 0)


def merged_shard(strings: list[bytes], length: int, step: int, shard_bytes: int) -> tuple[Shard, np.ndarray]:
    """All strings' suffixes by a tree of merges of shards of about `shard_bytes`; and the strings' first places."""
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    lens = np.array([len(s) for s in strings], np.int64)
    first = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    left = np.repeat(first + lens, lens + 1) - np.arange(len(data))
    rounds, symbols = length // step, _symbols(data, left, step)
    cuts = [0, *np.flatnonzero(np.diff(first // shard_bytes)) + 1]
    bounds = [*first[cuts].tolist(), len(data)]
    shards = [shard_of(lo, hi, symbols, left, step, rounds) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    while len(shards) > 1:
        shards = [merge(*sorted(shards[i : i + 2], key=lambda s: len(s.order)), symbols, left, step, rounds) if i + 1 < len(shards) else shards[i] for i in range(0, len(shards), 2)]
    return shards[0], first


def repeated_starts(strings: list[bytes], weights: list[int], counts: list[int], lengths: tuple[int, ...], shard_bytes: int = SHARD_BYTES) -> list[list[np.ndarray]]:
    """Per length and string: whether the bytes from each of its first `count` places occur more than once among these.

    A string counts `weight` times; places with fewer bytes left have no mark. The last length is the largest.
    """
    step = step_of(lengths[-1], lengths[0])
    shard, first = merged_shard(strings, lengths[-1], step, shard_bytes)
    lens, weight = np.array([len(s) for s in strings], np.int64), np.array(weights, np.float64)
    out = []
    for length in lengths:
        n = np.maximum(np.minimum(np.array(counts), lens - length + 1), 0)
        starts = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        block = np.empty(len(shard.order), np.int64)
        block[shard.order] = np.cumsum(shard.common < length // step)
        # an interval is repeated if the strings that its starts lie in weigh two or more
        total = np.bincount(block[starts], np.repeat(weight, n), block.max() + 1)
        out.append(np.split(total[block[starts]] > 1.5, np.cumsum(n)[:-1]))
    return out


def _runs(mask: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the marked starts cover."""
    at = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return [(int(a), int(b) + length - 1) for a, b in zip(at[::2], at[1::2], strict=True)]


_MARK = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("long", pa.bool_())])
_DECIDED = pa.schema([("g", pa.int64()), ("h", pa.int64()), ("spans", pa.list_(_MARK))])
_SPANS = "array<struct<start:int,end:int,long:boolean>>"


def _decide(length: int, near: int):
    def run(table: pa.Table) -> pa.Table:
        rows = {(r["g"], r["h"]): r for r in table.select(["g", "h", "n", "count", "data"]).to_pylist()}  # a repeated row gives a slice twice
        rows = [rows[k] for k in sorted(rows)]
        some, whole = repeated_starts([r["data"] for r in rows], [r["n"] for r in rows], [r["count"] for r in rows], (near, length))
        out = []
        for r, x, y in zip(rows, some, whole, strict=True):
            if spans := [{"start": a, "end": b, "long": n == length} for mask, n in ((x, near), (y, length)) for a, b in _runs(mask, n)]:
                out.append({"g": r["g"], "h": r["h"], "spans": spans})
        return pa.Table.from_pylist(out, _DECIDED)

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


_CUT = pa.schema([("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("count", pa.int32()), ("hot", pa.bool_()), ("m", pa.int64()), ("data", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        rows = []
        for text, slices in zip(texts_of(b.column("text")), b.column("slices").to_pylist(), strict=True):
            rows += [{**s, "data": text[s["start"] : s["start"] + s["len"]]} for s in slices]
        yield pa.RecordBatch.from_pylist(rows, _CUT)


#: A piece's key and hash, its slice's key and hash (ka, kb), and its place there.
_PIECES = pa.schema([(c, pa.int64()) for c in ("g", "h", "n", "m", "ka", "kb")] + [("start", pa.int32()), ("len", pa.int32()), ("count", pa.int32())])


def _finer(length: int, near: int, gram: int, cell: int):
    """Slices cut where the place of the window's minimum, counted in cells of starts, changes.

    Equal windows have their minimum (its first occurrence) at the same place, so they fall in the same cell, and all of
    a cell's windows share near - cell + 1 bytes around the minimum: the piece's key is a hash of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=256 << 10):
            out = []
            for x, of_g, of_h, n, count, m in zip(texts_of(b.column("text")), *(b.column(c).to_pylist() for c in ("g", "h", "n", "count", "m")), strict=True):
                data = np.frombuffer(x, np.uint8)
                p = np.arange(count)
                at = np.flatnonzero(gram_hashes(data, gram) == np.int64(m).view(np.uint64))
                f = at[np.searchsorted(at, p)]
                a = (f - p) // cell * cell
                first = np.flatnonzero(np.concatenate([[True], (np.diff(f) != 0) | (np.diff(a) != 0)]))
                total, down = _sums(data)
                core = (f - a)[first]
                with np.errstate(over="ignore"):
                    key = _mixed((total[core + near - cell + 1] - total[core]) * down[core] + a[first].astype(np.uint64) * np.uint64(_BASE)).view(np.int64)
                for i, e, g in zip(first.tolist(), [*first[1:].tolist(), len(p)], key.tolist(), strict=True):
                    piece = x[i : e + length - 1]
                    h = xxhash.xxh3_64_intdigest(piece, seed=e - i)
                    out.append((g, h - (h >> 63 << 64), n, m, of_g, of_h, i, len(piece), e - i))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(_PIECES), _PIECES.types, strict=True)], schema=_PIECES)

    return run


def _joined(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _by_length(spans: list[dict] | None) -> dict[bool, list[list[int]]]:
    """The marks of the removed and of the shorter strings, overlapping and touching ones joined."""
    return {long: _joined((x["start"], x["end"]) for x in spans or () if x["long"] == long) for long in (True, False)}


def _merge_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[{"start": s, "end": e, "long": long} for long, joined in _by_length(x).items() for s, e in joined] for x in b.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("g"), b.column("h"), pa.array(spans, _DECIDED.field("spans").type)], schema=_DECIDED)


def _settle(kinds: DataFrame, texts: DataFrame, length: int, near: int, gram: int, level: int = 0) -> DataFrame:
    """(g, h, spans) of the kinds of slices that hold repeated strings.

    kinds: g (key), h (hash), n (weight), multi, at (m, ka, kb, start, len, count); texts: ka, kb, text, in which kinds lie.
    """
    shared = kinds.groupBy("g").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.max("multi").alias("any"), F.sum("at.len").alias("bytes")).filter("all > 1 or any").drop("any", "all")
    kinds = stored(kinds.join(shared, "g").select("g", "h", "n", "at", "kinds", "bytes"), "shared")
    # equal slices: all of their strings are repeated
    span = lambda n, end: F.struct(F.lit(0).alias("start"), (end + (n - 1)).cast("int").alias("end"), F.lit(n == length).alias("long"))
    reach = F.least(F.col("at.count"), F.col("at.len") - (length - 1))
    some, whole = F.array(span(near, F.col("at.count"))), F.when((F.col("n") > 1) & (reach > 0), F.array(span(length, reach))).otherwise(F.array().cast(_SPANS))
    if level == len(CELLS):  # a key is one string of `near` bytes
        return stored(kinds.select("g", "h", F.concat(some, whole).cast(_SPANS).alias("spans")), "decided")
    decided = kinds.filter("kinds = 1 and n > 1").select("g", "h", F.concat(some, whole).cast(_SPANS).alias("spans"))
    several = kinds.filter("kinds > 1 or n = 1")
    hot = F.col("bytes") > KEY_BYTES
    size, crowded = several.agg(F.sum(F.when(~hot, F.col("at.len"))), F.count(F.when(hot, 1))).first()

    if not size and not crowded:
        return stored(decided, "decided")
    each = F.struct("g", "h", "n", hot.alias("hot"), *[F.col(f"at.{c}").alias(c) for c in ("m", "start", "len", "count")])
    cut = texts.join(several.groupBy("at.ka", "at.kb").agg(F.collect_list(each).alias("slices")), ["ka", "kb"]).select("text", "slices").mapInArrow(_cut, _ddl(_CUT))
    cut = stored(cut, "cut") if crowded else cut
    if size:
        tasks = max(1, -(-size // TASK_BYTES))
        merged = cut.filter(~F.col("hot")).withColumn("task", F.pmod(F.xxhash64("g"), F.lit(tasks))).select("task", "g", "h", "n", "count", "data").groupBy("task").applyInArrow(_decide(length, near), f"g long, h long, spans {_SPANS}")
        decided = decided.unionAll(merged)
    if crowded:
        slices = cut.filter("hot")
        parts = stored(slices.select("g", "h", "n", "count", "m", F.col("data").alias("text")).mapInArrow(_finer(length, near, gram, CELLS[level]), _ddl(_PIECES)), "pieces")
        finer = parts.groupBy("g", "h").agg(F.sum("n").alias("n"), F.lit(False).alias("multi"), F.min(F.struct("m", "ka", "kb", "start", "len", "count")).alias("at"))
        found = _settle(stored(finer, "kinds"), slices.select(F.col("g").alias("ka"), F.col("h").alias("kb"), F.col("data").alias("text")), length, near, gram, level + 1)
        back = parts.select("ka", "kb", "start", "g", "h").join(found, ["g", "h"]).select(F.col("ka").alias("g"), F.col("kb").alias("h"), F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).cast("int").alias("start"), (s["end"] + F.col("start")).cast("int").alias("end"), s["long"].alias("long"))).alias("spans"))
        back = back.groupBy("g", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        decided = decided.unionAll(back.mapInArrow(_merge_marks, f"g long, h long, spans {_SPANS}"))
    return stored(decided, "decided")


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_REMOVED = pa.schema([("n_bytes", pa.int64()), ("spans", pa.list_(_SPAN)), ("near_spans", pa.list_(_SPAN)), ("kept", pa.binary())])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        rows = []
        for text, spans in zip(texts_of(b.column("text")), b.column("spans").to_pylist(), strict=True):
            gone, near = _by_length(spans).values()
            edges = [0, *(x for m in gone for x in m), len(text)]
            named = [[{"start": s, "end": e} for s, e in x] for x in (gone, near)]
            rows.append({"n_bytes": len(text), "spans": named[0], "near_spans": named[1], "kept": b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))})
        extra = pa.RecordBatch.from_pylist(rows, _REMOVED)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *extra.columns], names=["doc_id", *_REMOVED.names])


def remove_repeats(docs: DataFrame, length: int = LENGTH, near: int = NEAR, gram: int = GRAM) -> DataFrame:
    """Per document row: doc_id, n_bytes, spans (maximal removed byte ranges), near_spans, kept (the remaining bytes).

    docs: doc_id, text; further columns are ignored. Texts are UTF-8 bytes; null counts as empty. A byte goes if a
    string of `length` bytes that covers it also starts anywhere else in the table, the same text included; strings
    never cross documents. near_spans tells of strings of `near` bytes in the same way; none of these bytes goes for it. All copies of a text lose the same bytes; rows that repeat an id, also with the same text,
    are separate documents, null ids too. An empty table gives no rows.

    The minimum gram hash of a window of `near` bytes is the same wherever its bytes occur, so windows meet by it and
    nothing is missed, longer strings by their first window.
    Neighbouring windows with one minimum form a slice; equal slices collapse to one with a weight; a slice whose
    minimum occurs nowhere else has no repeats. The other slices are dealt out by their minimum. A task splits its
    slices into shards, builds each shard's order and Burrows-Wheeler transform, and merges them by twos, refining the
    interleave from the transforms round by round, up to `length` bytes. Slices of a minimum that has more than
    KEY_BYTES of different ones are first cut into cells of CELLS starts and meet by the bytes that a cell's windows
    share; a key of a cell of one start is one string, whose kinds are only counted. So no key gathers more than KEY_BYTES.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = pick(docs, "doc_id", "text").select("doc_id", text.alias("text")).select(F.xxhash64("text", "doc_id").alias("ka"), F.xxhash64("doc_id", F.lit(7), "text").alias("kb"), "doc_id", "text")
    sliced = stored(base.select("ka", "kb", "text").mapInArrow(_slices(length, near, gram), "ka long, kb long, mins array<long>, hashes array<long>, starts array<int>, lens array<int>, counts array<int>, multi array<boolean>").filter(F.size("mins") > 0), "slices")
    each = sliced.select("ka", "kb", F.explode(F.arrays_zip("mins", "hashes", "starts", "lens", "counts", "multi")).alias("s")).select("ka", "kb", F.col("s.mins").alias("m"), F.col("s.hashes").alias("h"), F.col("s.starts").alias("start"), F.col("s.lens").alias("len"), F.col("s.counts").alias("count"), F.col("s.multi").alias("multi"))

    kinds = each.groupBy(F.col("m").alias("g"), "h").agg(F.count("*").alias("n"), F.max("multi").alias("multi"), F.min(F.struct("m", "ka", "kb", "start", "len", "count")).alias("at"))
    decided = _settle(stored(kinds, "kinds"), base.select("ka", "kb", "text"), length, near, gram).withColumnRenamed("g", "m")

    spans = each.join(decided, ["m", "h"]).select("ka", "kb", F.explode("spans").alias("s"), "start").select("ka", "kb", F.struct((F.col("s.start") + F.col("start")).cast("long").alias("start"), (F.col("s.end") + F.col("start")).cast("long").alias("end"), F.col("s.long").alias("long")).alias("s"))
    spans = spans.groupBy("ka", "kb").agg(F.collect_set("s").alias("spans"))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.join(spans, ["ka", "kb"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, near_spans array<struct<start:long,end:long>>, kept binary")
