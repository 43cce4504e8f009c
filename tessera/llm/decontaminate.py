"""Benchmark decontamination by winnowing: minimum k-gram hash per window, fingerprint join, extension of hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces, small, stored, texts_of

#: Words of a window that counts as shared, and of a fingerprinted gram; a window of WINDOW words holds
#: WINDOW - GRAM + 1 grams, the minimum of which is its fingerprint, so no shared window can be missed.
WINDOW, GRAM = 10, 5
#: Fingerprints of a benchmark that go to the tasks as a sorted array (8 bytes each); more meet the documents' by a shuffle.
PRINTS_SENT = 2_000_000
_WORDS_KEPT = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


class _Hashes(dict):
    """64-bit hash of a word, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < _WORDS_KEPT:
            self[word] = h
        return h


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of 0-9, a-z and code points from U+0080."""
    return text.translate(_LOWER).split()


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of the k words from each position."""
    n = len(words) - k + 1
    out = words[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out *= _MIX
            out ^= out >> np.uint64(29)
            out += words[i : i + n]
        out *= _MIX
        out ^= out >> np.uint64(32)
    return out


def _minima(words: np.ndarray, size: int) -> np.ndarray:
    """Per window of `size` words: the least hash of its k-grams."""
    g = _grams(words, min(GRAM, size))
    n = len(words) - size + 1
    out = g[:n].copy()
    for i in range(1, len(g) - n + 1):
        np.minimum(out, g[i : i + n], out=out)
    return out


def _windows(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each of some places."""
    out = words[at] + np.uint64(size)
    with np.errstate(over="ignore"):
        for i in range(1, size):
            out *= _MIX
            out ^= out >> np.uint64(29)
            out += words[at + i]
        out *= _MIX
        out ^= out >> np.uint64(32)
    return out


_ITEM = pa.schema([("item_id", pa.string()), ("size", pa.int32()), ("prints", pa.list_(pa.int64())), ("windows", pa.list_(pa.int64()))])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per item: its window length, and each window's fingerprint and hash."""
    hashes = _Hashes()
    for b in pieces(batches):
        rows = []
        for item, text in zip(b.column("item_id").to_pylist(), texts_of(b.column("text")), strict=True):
            w = np.array([hashes[x] for x in words_of(text)], np.uint64)
            if size := min(WINDOW, len(w)):
                windows = _windows(w, np.arange(len(w) - size + 1), size)
                rows.append({"item_id": item, "size": size, "prints": _minima(w, size).view(np.int64), "windows": windows.view(np.int64)})
        yield pa.RecordBatch.from_pylist(rows, _ITEM)


_RUN = pa.struct([("size", pa.int32()), ("print", pa.int64()), ("pos", pa.int64()), ("windows", pa.list_(pa.int64()))])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _scan(sizes: list[int], sent):
    """Per text: n_words, and the runs of neighbouring windows with one fingerprint, if it is among those sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in pieces(batches):
            split = [words_of(t) for t in texts_of(b.column("text"))]
            lens = np.array([len(x) for x in split], np.int64)
            w = np.fromiter((hashes[x] for ws in split for x in ws), np.uint64, int(lens.sum()))
            del split
            ends = np.cumsum(lens)
            doc = np.repeat(np.arange(len(lens)), lens)
            runs: list[list[dict]] = [[] for _ in lens]
            for size in sizes:
                if len(w) < size:
                    continue
                m = _minima(w, size)
                of = doc[: len(m)]
                whole = np.arange(size, len(m) + size) <= ends[of]
                first = np.flatnonzero(whole & np.concatenate([[True], (m[1:] != m[:-1]) | (of[1:] != of[:-1])]))
                if sent is not None:
                    prints = sent.value[size]
                    first = first[prints[np.minimum(np.searchsorted(prints, m[first]), len(prints) - 1)] == m[first]]
                change = np.flatnonzero(np.concatenate([(m[1:] != m[:-1]) | ~whole[1:] | (of[1:] != of[:-1]), [True]])) + 1
                last = change[np.searchsorted(change, first, side="right")]
                count = last - first
                places = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                windows = np.split(_windows(w, places, size).view(np.int64), np.cumsum(count)[:-1])
                for p, h in zip(first.tolist(), windows, strict=False):
                    d = of[p]
                    runs[d].append({"size": size, "print": int(m[p].view(np.int64)), "pos": int(p - ends[d] + lens[d]), "windows": h})
            extra = [pa.array(lens, pa.int64()), pa.array(runs, pa.list_(_RUN))]
            cols = b.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*cols.columns, *extra], names=[*cols.schema.names, "n_words", "runs"])

    return run


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit windows, extended to the longest runs of hit words."""
    for b in batches:
        spans = []
        for hits in b.column("hits"):
            at = np.array(hits.values.flatten()[0]), np.array(hits.values.flatten()[1])
            order = np.argsort(at[0], kind="stable")
            start, end = at[0][order], np.maximum.accumulate((at[0] + at[1])[order])
            cut = np.concatenate([[True], start[1:] > end[:-1]])
            spans.append([{"start": s, "end": e} for s, e in zip(start[cut].tolist(), end[np.append(cut[1:], True)].tolist(), strict=True)])
        cols = b.drop_columns(["hits"])
        yield pa.RecordBatch.from_arrays([*cols.columns, pa.array(spans, pa.list_(_SPAN))], names=[*cols.schema.names, "spans"])


_RUNS = "array<struct<size:int,print:long,pos:long,windows:array<long>>>"
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _rows(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns as k0, k1, ..., the text's hash, and the text."""
    text = F.col("text").cast("string")
    base = pick(docs, *keep, *([] if "text" in keep else ["text"]))
    return base.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.xxhash64(text).alias("ka"), F.xxhash64(F.lit(7), text).alias("kb"), text.alias("text"))


def _hits(rows: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows without text, with n_words; ka, kb, spans and items of the texts that hit; the latter's number), both stored."""
    spark = rows.sparkSession
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    marks = items.mapInArrow(_fingerprint, "item_id string, size int, prints array<long>, windows array<long>")
    marks = stored(marks.select("item_id", "size", F.explode(F.arrays_zip("prints", "windows")).alias("x")).select("item_id", "size", F.col("x.prints").alias("print"), F.col("x.windows").alias("window")), "benchmark")
    prints = stored(marks.select("size", "print").distinct(), "prints")
    sizes, sent = sorted(r[0] for r in prints.select("size").distinct().collect()), None
    if prints.count() <= PRINTS_SENT:
        got = prints.toArrow()
        size, value = got.column("size").to_numpy(), got.column("print").to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast({s: np.sort(value[size == s]) for s in sizes})

    kind = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    scanned = stored(rows.mapInArrow(_scan(sizes, sent), f"{kind}, n_words long, runs {_RUNS}"), "scanned")
    runs = scanned.filter(F.size("runs") > 0).select("ka", "kb", F.explode("runs").alias("r")).select("ka", "kb", "r.*")
    if sent is None:
        runs = runs.join(prints, ["size", "print"], "left_semi")
    places = runs.select("ka", "kb", "size", "pos", F.posexplode("windows").alias("i", "window")).select("ka", "kb", "size", (F.col("pos") + F.col("i")).alias("pos"), "window")
    # windows of the same items are one class, so that a text meets an item once and not once a window
    windows = marks.groupBy("size", "window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    windows = stored(windows.withColumns({"ca": F.xxhash64("items"), "cb": F.xxhash64(F.lit(7), "items")}), "windows")
    hit = stored(places.join(small(windows.select("size", "window", "ca", "cb"), windows.count()), ["size", "window"]).select("ka", "kb", "pos", "size", "ca", "cb").distinct(), "hits")
    spans = hit.groupBy("ka", "kb").agg(F.collect_set(F.struct("pos", F.col("size").cast("long").alias("size"))).alias("hits")).mapInArrow(_join_spans, f"ka long, kb long, spans {_SPANS}")
    classes = stored(windows.groupBy("ca", "cb").agg(F.first("items").alias("items")), "classes")
    named = hit.select("ka", "kb", "ca", "cb").distinct().join(small(classes, classes.count()), ["ca", "cb"])
    named = named.select("ka", "kb", F.explode("items").alias("item")).groupBy("ka", "kb").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = stored(spans.join(named, ["ka", "kb"], "left"), "contaminated")
    return scanned.drop("runs"), found, found.count()


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document row: `keep` columns, n_words, spans (merged hit word ranges), items (sorted ids), hit.

    docs: text and the `keep` columns; benchmark: item_id, text; further columns are ignored. A benchmark window is
    WINDOW consecutive words of an item, or all words of a shorter one; a document word inside any occurrence is hit.
    Null and empty texts have no words and hit nothing. Items with a null id hit words but are not listed. Repeated
    documents are judged one by one; repeated items count once by id. Empty tables give no rows, or rows without hits.

    A window's fingerprint is its least gram hash; neighbouring windows with one fingerprint form a run. Documents' runs
    meet the benchmark's fingerprints, which go to the tasks as a sorted array, or, if there are more than PRINTS_SENT,
    by a shuffled join. The windows that met fingerprints stand for are then joined by a hash of their words, and hit
    windows extend to the longest runs of words. All work is in proportion to words, however often they repeat; equal
    texts are joined once; texts aren't shuffled.
    """
    scanned, found, n = _hits(_rows(docs, *keep), benchmark)
    out = scanned.join(small(found, n), ["ka", "kb"], "left")
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*names, "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("spans").isNotNull().alias("hit"))


def without_contamination(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """`columns` (text among them) of the rows that find_contamination finds no hit in."""
    _, found, n = _hits(_rows(docs), benchmark)
    rows = pick(docs, *columns)
    key = rows.select("*", F.xxhash64(F.col("text").cast("string")).alias("_ka"), F.xxhash64(F.lit(7), F.col("text").cast("string")).alias("_kb"))
    keys = found.select(F.col("ka").alias("_ka"), F.col("kb").alias("_kb"))
    return key.join(small(keys, n), ["_ka", "_kb"], "left_anti").select(*columns)
