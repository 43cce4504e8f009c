"""MinHash near-duplicate detection: universal hash minima, banding, verification on full sets, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, pieces, stored, texts_of
from .components import components

#: Minima per band, and the chance that a pair at the threshold is missed: half of it by sharing no band, half by having
#: fewer equal minima than a pair is checked from.
ROWS_PER_BAND, MISS = 4, 1e-6
#: Documents of one side of a block comparison within a bucket: of signatures, and of texts.
SIGNATURES, BLOCK = 2048, 256
_WORDS_KEPT = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS / 2) / math.log(1 - similarity**ROWS_PER_BAND))


def least_equal(similarity: float, n: int) -> int:
    """The most equal minima, out of n, that a pair at the threshold falls short of with a chance of MISS / 2 at most."""
    below, k = 0.0, 0
    while k < n:
        below += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if below > MISS / 2:
            break
        k += 1
    return k


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < _WORDS_KEPT:
            self[word] = h
        return h


def shingles(text: bytes, k: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; of fewer words, the whole sequence as one."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(w))
    n = len(w) - k + 1
    with np.errstate(over="ignore"):
        out = w[:n] + np.uint64(k)
        for i in range(1, k):
            out *= _MIX
            out ^= out >> np.uint64(29)
            out += w[i : i + n]
        out *= _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


_SIGNED = pa.schema([("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("minima", pa.binary())])


def _sign(k: int, bands: int):
    n = bands * ROWS_PER_BAND
    rng = np.random.default_rng(42)
    factors, terms = rng.integers(1, 2**63, n, np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in pieces(batches, limit=2 << 20):
            sets = [shingles(t, k, hashes) for t in texts_of(b.column("text"))]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            minima = np.zeros((len(sets), n), np.uint32)
            keys = np.zeros((2, len(sets)), np.uint64)
            if len(full):
                flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                with np.errstate(over="ignore"):
                    for i in range(n):
                        h = flat * factors[i]
                        h += terms[i]
                        h >>= np.uint64(32)
                        minima[full, i] = np.minimum.reduceat(h, starts)
                    mixed = (flat ^ (flat >> np.uint64(31))) * _MIX
                    keys[0, full] = np.add.reduceat(mixed, starts)
                    keys[1, full] = np.add.reduceat((mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB), starts)
            with np.errstate(over="ignore"):
                rows = minima.astype(np.uint64).reshape(len(sets), bands, ROWS_PER_BAND)
                buckets = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _MIX, (len(sets), bands)).copy()
                for i in range(ROWS_PER_BAND):
                    buckets = (buckets ^ rows[:, :, i]) * _MIX
                    buckets ^= buckets >> np.uint64(32)
            offsets = pa.array(np.arange(0, bands * len(sets) + 1, bands, dtype=np.int32))
            extra = [pa.array(sizes), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(buckets.view(np.int64).ravel())), pa.array([m.tobytes() for m in minima], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ka"), b.column("kb"), *extra], names=["doc_id", "ka", "kb", *_SIGNED.names])

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, of sorted distinct hashes."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(k: int, percent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, star, star_set = _Hashes(), None, None
        for b in pieces(batches, "text_a"):
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            near = [(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum() >= least for x, y in zip(b.column("minima_a").to_pylist(), b.column("minima_b").to_pylist(), strict=True)]
            links = []
            for i in np.flatnonzero(near).tolist():
                other = b.column("text_b")[i].as_py() or ""
                if star != other:  # rows come sorted by the star
                    star, star_set = other, shingles(other.encode(), k, hashes)
                if _similar(shingles((b.column("text_a")[i].as_py() or "").encode(), k, hashes), star_set, percent):
                    links.append({"a": a[i], "b": c[i]})
            yield pa.RecordBatch.from_pylist(links, _LINK)

    return run


def _compare(k: int, percent: int, least: int):
    """Links between two blocks of a bucket (or within one), of documents not yet connected, as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        hashes, rows = _Hashes(), table.select(["rep", "component", "own", "text", "minima"]).to_pylist()
        parent = {r["component"]: r["component"] for r in rows}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        minima = np.stack([np.frombuffer(r["minima"], np.uint32) for r in rows])
        sets: dict[int, np.ndarray] = {}

        def full(i):
            if i not in sets:
                sets[i] = shingles((rows[i]["text"] or "").encode(), k, hashes)
            return sets[i]

        links = []
        for i in [i for i, r in enumerate(rows) if r["own"]]:
            equal = (minima == minima[i]).sum(1)
            near = np.flatnonzero(equal >= least)
            for j in near[np.argsort(-equal[near], kind="stable")].tolist():
                x, y = find(rows[i]["component"]), find(rows[j]["component"])
                if x != y and _similar(full(i), full(j), percent):
                    parent[max(x, y)] = min(x, y)
                    links.append({"a": rows[i]["rep"], "b": rows[j]["rep"]})
        return pa.Table.from_pylist(links, _LINK)

    return run


def _partnered(least: int):
    """Members of a block pair that have enough equal minima with one of another component."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["bucket", "rep", "component", "own", "minima"])
        component, own = rows.column("component").to_numpy(), rows.column("own").to_numpy()
        minima = np.stack([np.frombuffer(m, np.uint32) for m in rows.column("minima").to_pylist()])
        found = np.zeros(len(minima), bool)
        for i in np.flatnonzero(own):
            near = ((minima == minima[i]).sum(1) >= least) & (component != component[i])
            found |= near
            found[i] |= near.any()
        return rows.select(["bucket", "rep", "component"]).filter(pa.array(found))

    return run


def _meetings(members: DataFrame, block: int) -> DataFrame:
    """(bucket, i, j, rep, component, own): the block pairs that a member of a bucket in several components is in.

    In each such bucket the largest component's members needn't meet each other; all others meet every block of the
    bucket. Buckets with the same members are compared once.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h"))
    open_ = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("many"), F.sum("n").alias("all"), F.sum("h").alias("h"), F.count("*").alias("parts")).filter("parts > 1")
    open_ = open_.groupBy("h", "all").agg(F.min_by(F.struct("bucket", "largest", "many"), "bucket").alias("x")).select("x.*", "all")
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    rows = members.join(open_, "bucket").select("bucket", "rep", "component", (F.col("component") != F.col("largest")).alias("other"), blocks(F.col("many")).alias("ng"), blocks(F.col("all") - F.col("many")).alias("no"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("rep", "bucket"), F.when(F.col("other"), F.col("no")).otherwise(F.col("ng"))).cast("int"))
    # the compared block of others, the met block (of the largest component: from -1 down), and whether a row is on the compared side
    task = lambda i, j, own: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(own).alias("own"))
    at, others = F.col("at"), F.sequence(F.lit(0), F.col("no") - 1)
    asks = F.concat(F.transform(F.sequence(F.lit(0), F.col("ng") - 1), lambda g: task(at, -1 - g, True)), F.transform(F.filter(others, lambda o: o >= at), lambda o: task(at, o, True)))
    answers = F.when(F.col("other"), F.transform(F.filter(others, lambda o: o < at), lambda o: task(o, at, False))).otherwise(F.transform(others, lambda o: task(o, -1 - at, False)))
    return rows.select("bucket", "rep", "component", F.explode(F.when(F.col("other"), F.concat(asks, answers)).otherwise(answers)).alias("t")).select("bucket", "rep", "component", "t.*")


def _left_pairs(members: DataFrame, signatures: DataFrame, texts: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """Links within buckets whose members aren't all connected yet. members: bucket, rep, component.

    First signatures meet, in large blocks; only members with a likely partner in another component send their texts.
    """
    near = _meetings(members, SIGNATURES).join(signatures, "rep").groupBy("bucket", "i", "j").applyInArrow(_partnered(least), "bucket long, rep long, component long")
    near = stored(near.distinct(), "near")
    return _meetings(near, BLOCK).join(texts, "rep").groupBy("bucket", "i", "j").applyInArrow(_compare(k, percent, least), "a long, b long")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the text's hash."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("ka"), F.xxhash64(F.lit(7), "text").alias("kb"))


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block tasks send Python at most so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, with_keys: bool = False) -> DataFrame:
    """Per document row: doc_id, n_shingles (set size), component_id (least doc_id reachable), kept.

    docs: doc_id (integer), text; further columns are ignored. Words are runs of other than space and U+0009-U+000D,
    A-Z lower-cased; a document's set holds its distinct k-word shingles, or its whole sequence if shorter. Documents
    link at 100 * intersection >= percent * union, confirmed on full sets. Null, empty and wordless texts have empty
    sets and link with nothing. Rows with a null id have no component and are kept. Rows repeating an id are judged by
    their own texts; a component goes by its least id, and all of its rows with this id are kept. With with_keys the
    text's hash (ka, kb) and is_first follow: whether the row is the component's first by doc_id, ka and kb, which rows
    without component always are; rows equal in all three are first together. An empty table gives no rows. A pair at
    the threshold is missed with chance MISS at most.

    Equal sets collapse first, so groups of copies count once: a node of the graph is a set, whatever its rows' ids.
    In each band bucket all members meet the least one
    (star), so a bucket gives as many pairs as members; where a bucket's members are then in several components, those
    outside the largest meet the rest, first by signature in blocks of SIGNATURES, then, if they have a likely partner,
    by text in blocks of BLOCK documents, each task returning a spanning forest only.
    """
    bands = bands_for(percent / 100)
    least = least_equal(percent / 100, bands * ROWS_PER_BAND)
    signed = stored(_rows(docs).mapInArrow(_sign(k, bands), "doc_id long, ka long, kb long, n_shingles long, set_a long, set_b long, bands array<long>, minima binary"), "signed")
    live = signed.filter("n_shingles > 0 and doc_id is not null")
    # numbered as they are written, so that the numbers hold from then on
    reps = live.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "ka", "kb")).alias("x"), F.first("bands").alias("bands"), F.first("minima").alias("minima"))
    reps = stored(reps.select("set_a", "set_b", "x.*", "bands", "minima").withColumn("rep", F.monotonically_increasing_id()), "representatives")

    buckets = reps.select("rep", F.explode(F.array_distinct("bands")).alias("bucket"))
    stars = buckets.groupBy("bucket").agg(F.min("rep").alias("star"), F.count("*").alias("n")).filter("n > 1").select("bucket", "star")
    members = stored(buckets.join(stars, "bucket").select("bucket", "rep", "star"), "members")
    wanted = stored(reps.join(members.select("rep").distinct(), "rep").select("doc_id", "ka", "kb", "rep", "minima"), "wanted")
    texts = stored(_rows(docs).join(wanted, ["doc_id", "ka", "kb"]).select("rep", "text", "minima"), "texts")
    if texts.count() > wanted.count():  # rows repeat an id and a text
        texts = stored(texts.groupBy("rep").agg(F.first("text").alias("text"), F.first("minima").alias("minima")), "texts")
    pairs = members.filter("rep <> star").select(F.col("rep").alias("a"), F.col("star").alias("b")).distinct()
    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"), F.col("minima").alias(f"minima_{x}"))
    with _batches_of(docs.sparkSession, BLOCK):  # rows hold two texts
        links = stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify(k, percent, least), "a long, b long"), "links")

    parts = components(links)
    where = members.select("bucket", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = stored(_left_pairs(stored(where, "where"), reps.select("rep", "minima"), texts, k, percent, least), "links")
    parts = stored(components(links.unionAll(more)).withColumnRenamed("node", "rep"), "components")

    # a component goes by the least id of its sets
    placed = stored(reps.select("set_a", "set_b", "rep", F.struct("doc_id", "ka", "kb").alias("row")).join(parts, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"), "row"), "placed")
    names = placed.join(parts.select("component").distinct(), "component").groupBy("component").agg(F.min("row").alias("first"))
    found = placed.join(names, "component", "left").select("set_a", "set_b", F.coalesce("first", "row").alias("first"))
    row = F.struct("doc_id", "ka", "kb")
    out = live.select(row.alias("row"), "n_shingles", "set_a", "set_b").join(found, ["set_a", "set_b"]).select("row", "n_shingles", "first")
    rest = signed.filter("n_shingles = 0 or doc_id is null").select(row.alias("row"), "n_shingles", row.alias("first"))
    out = out.unionAll(rest).select("row.doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), F.col("row.ka").alias("ka"), F.col("row.kb").alias("kb"), (F.col("row") == F.col("first")).alias("is_first"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept, *(("ka", "kb", "is_first") if with_keys else ()))
