"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces, stored

#: Labelled rows, about, that the classifier is fitted on; more are thinned by a hash of the id.
SAMPLE_ROWS = 20_000
#: A lexicon term is in this many toxic sample texts at least, and in this share; and exp(LOG_ODDS) times as often in toxic as in other texts.
MIN_TEXTS, MIN_SHARE, LOG_ODDS = 3, 0.004, 3.0
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 64
#: Parts of the sample: a row's features come from a lexicon, and its calibrating margin from trees, that never saw its part.
FOLDS = 5
_WORDS_KEPT = 150_000

#: Second-person pronouns of the corpus's languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
#: Characters that stand for letters in obfuscated words.
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_INNER = re.compile(r"[\W_]+")

FEATURES = ("lexicon_weight", "lexicon_density", "lexicon_count", "lexicon_distinct", "lexicon_most", "near_second_person", "second_person", "obfuscated", "capitals", "exclamation", "question", "symbols", "log_words", "word_length")


def terms_of(token: str) -> tuple[str, bool]:
    """(the word behind a token, whether it was obfuscated): edges stripped, lower case, letters behind digits and signs."""
    if token.isalpha():
        return token.lower(), False
    word = _EDGE.sub("", token)
    if not word:
        return "", False
    if word.isalpha():
        return word.lower(), False
    plain = _INNER.sub("", word.translate(_LEET)).lower()
    return plain, any(c.isalpha() for c in word) and "@" not in word[1:-1] and plain.isalpha()


def _stems(word: str) -> Iterator[str]:
    yield word
    for n in (4, 5, 6):
        if len(word) > n:
            yield f"{word[:n]}-"


def _terms(batches: Iterator[pa.RecordBatch], wanted: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("term", pa.string()), ("fold", pa.int32()), ("n", pa.int64())])
    for b in pieces(batches):
        seen: Counter = Counter()
        for text, fold in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True):
            words = {terms_of(t)[0] for t in set((text or "").split())}
            terms = {t for w in words if len(w) > 2 for t in _stems(w)}
            seen.update((t, fold) for t in (terms if wanted is None else terms & wanted))
        cols = [t for t, _ in seen], [f for _, f in seen], list(seen.values())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _parts_left_out() -> list[frozenset[int]]:
    """The parts that some lexicon must not see: none, each, and each two."""
    return [frozenset(), *(frozenset({j, k}) for j in range(FOLDS) for k in range(j, FOLDS))]


def _lexicons(sample: DataFrame) -> dict[frozenset[int], dict[str, float]]:
    """By parts left out: weights of words and stems (marked by a closing `-`) that tell toxic texts, from texts' counts by label."""
    n = np.zeros((2, FOLDS))
    for r in sample.groupBy("toxic", "fold").count().collect():
        n[r.toxic, r.fold] = r["count"]

    def counts(toxic: int, wanted: frozenset[str] | None, least: int) -> dict[str, np.ndarray]:
        rows = sample.filter(F.col("toxic") == toxic).select("text", "fold").mapInArrow(lambda it: _terms(it, wanted), "term string, fold int, n long")
        by_fold = [F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)]
        rows = rows.groupBy("term").agg(F.sum("n").alias("n"), *by_fold).filter(F.col("n") >= least)
        return {r[0]: np.array(r[2:], np.float64) for r in rows.collect()}

    bad = counts(1, None, MIN_TEXTS) if n.sum(1).all() else {}
    good = counts(0, frozenset(bad), 1) if bad else {}
    none, out = np.zeros(FOLDS), {}
    for left_out in _parts_left_out():
        use = np.array([k not in left_out for k in range(FOLDS)])
        clean, toxic = n[:, use].sum(1)
        least, weights = max(MIN_TEXTS, math.ceil(MIN_SHARE * toxic)), {}
        for t, c in bad.items():
            if (here := c[use].sum()) >= least:
                w = math.log((here + 0.5) / (toxic + 1)) - math.log((good.get(t, none)[use].sum() + 0.5) / (clean + 1))
                if w >= LOG_ODDS:
                    weights[t] = w
        out[left_out] = weights
    return out


class Featuriser:
    """Dense features of texts under one or more lexicons; what a token contributes is remembered for frequent tokens."""

    def __init__(self, *lexicons: dict[str, float]):
        self.n = len(lexicons)
        self.weights = {t: np.array([x.get(t, 0.0) for x in lexicons]) for t in set().union(*lexicons)}
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.table = np.zeros((4096, 4 + self.n))

    def _learn(self, tokens: set[str]) -> None:
        if len(self.codes) > _WORDS_KEPT:
            self._forget()
        rows, hits = [], []
        for t in tokens - self.codes.keys():
            word, hidden = terms_of(t)
            found = [self.weights[x] for x in _stems(word) if x in self.weights]
            if found:
                hits.append((len(self.codes), np.max(found, axis=0)))
            self.codes[t] = len(self.codes)
            rows.append((word in SECOND_PERSON, hidden, len(t) > 2 and t.isupper(), len(word)))
        if rows:
            end = len(self.codes)
            if end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(end, len(self.table)), 4 + self.n))])
            self.table[end - len(rows) : end, :4] = rows
            for at, weights in hits:
                self.table[at, 4:] = weights

    def __call__(self, texts: list[str]) -> np.ndarray:
        """By text, lexicon and feature."""
        split = [t.split() for t in texts]
        self._learn(set().union(*split) if split else set())
        n = np.array([len(s) for s in split], np.int64)
        codes = np.fromiter((self.codes[t] for s in split for t in s), np.int64, int(n.sum()))
        out = np.zeros((len(texts), self.n, len(FEATURES)))
        out[:, :, 12] = np.log1p(n)[:, None]
        size = np.maximum(n, 1)
        chars = np.maximum([len(t) for t in texts], 1) if texts else size
        out[:, :, 9] = (np.array([t.count("!") for t in texts]) / chars)[:, None]
        out[:, :, 10] = (np.array([t.count("?") for t in texts]) / chars)[:, None]
        out[:, :, 11] = (np.array([sum(map(t.count, "#$%&*@|")) for t in texts]) / chars)[:, None]
        if not len(codes):
            return out
        second, hidden, upper, length = (self.table[codes, i] for i in range(4))
        doc = np.repeat(np.arange(len(texts)), n)
        total = lambda x: np.bincount(doc, x, len(texts))
        for i, x in ((6, second), (7, hidden), (8, upper), (13, length)):
            out[:, :, i] = (total(x) / size)[:, None]
        for i in range(self.n):
            self._by_lexicon(out[:, i], self.table[codes, 4 + i], second, codes, doc, size)
        return out

    @staticmethod
    def _by_lexicon(out: np.ndarray, weight: np.ndarray, second: np.ndarray, codes: np.ndarray, doc: np.ndarray, size: np.ndarray) -> None:
        at = np.flatnonzero(weight)
        near = np.zeros(len(at))
        for s in (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5):
            other = np.clip(at + s, 0, len(codes) - 1)
            near = np.maximum(near, (second[other] > 0) & (doc[other] == doc[at]))
        total = lambda x: np.bincount(doc[at], x, len(size))
        out[:, 2] = np.bincount(doc[at], minlength=len(size))
        out[:, 0], out[:, 1], out[:, 5] = total(weight[at]) / size, out[:, 2] / size, total(near) / size
        out[:, 3] = np.bincount(np.unique(np.stack([doc[at], codes[at]]), axis=1)[0], minlength=len(size))
        np.maximum.at(out[:, 4], doc[at], weight[at])


class Boosted:
    """Trees on binned features for logistic loss; scores through an isotonic map of margins."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.base = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        self.cuts = [np.unique(np.quantile(c[c > c.min()] if (c > c.min()).any() else c, np.linspace(0, 1, BINS - 1))) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        self.trees, f = [], np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree, where = self._tree(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            f += tree[1][where]
        return self

    def calibrate(self, margin: np.ndarray, y: np.ndarray) -> Boosted:
        self.x, self.y = _isotonic(margin, y)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Splits by node of a full tree, leaf values, and the rows' leaves."""
        where, splits = np.zeros(len(b), np.int64), []
        for depth in range(DEPTH):
            for node in range(2**depth):
                rows = np.flatnonzero(where == node + 2**depth - 1)
                best, gs, hs = (0.0, 0, BINS), g[rows].sum(), h[rows].sum()
                for j in range(b.shape[1]) if len(rows) > 20 else ():
                    gl, hl = np.cumsum(np.bincount(b[rows, j], g[rows], BINS)), np.cumsum(np.bincount(b[rows, j], h[rows], BINS))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    if gain.max() > best[0] + 1e-9:
                        best = (float(gain.max()), j, int(gain.argmax()))
                splits.append(best[1:])
                where[rows] = 2 * where[rows] + 1 + (b[rows, best[1]] > best[2])
        where -= 2**DEPTH - 1
        value = RATE * np.bincount(where, g, 2**DEPTH) / (np.bincount(where, h, 2**DEPTH) + 1)
        return (splits, value), where

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        out = np.full(len(x), self.base)
        for splits, value in self.trees:
            s, where = np.array(splits), np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                where = 2 * where + 1 + (bins[np.arange(len(x)), s[where, 0]] > s[where, 1])
            out += value[where - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a thousandth of the raw one keeps the order within a step."""
        m = self.margin(x)
        return np.clip(0.999 * np.interp(m, self.x, self.y) + 0.001 / (1 + np.exp(-m)), 0.0, 1.0)


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: steps' mean margins and mean labels, rising."""
    blocks: list[list[float]] = []
    for m, t in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        blocks.append([m, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            m, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + m, blocks[-1][1] + t, blocks[-1][2] + n]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(featuriser, model) from labelled rows that aren't held out; the model is the share of toxic rows if only one class is there.

    Null labels and null ids teach nothing; of repeated labels of an id the highest counts. The lexicon that gives a
    row's features when trees are fitted was mined from other parts of the sample than the row's; the margins that
    calibrate come from trees, and features, that were fitted without the row's part. Lexicon and trees in use come from
    all parts.
    """
    marks = pick(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = stored(marks, "labels")
    share = min(1.0, sample_rows / max(1, marks.count()))
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    fold = (F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % FOLDS).cast("int")
    # the sample's ids are about sample_rows, so they may go to every reader of the texts
    sample = stored(pick(docs, "doc_id", "text").join(F.broadcast(marks), "doc_id").select(F.col("text").cast("string").alias("text"), "toxic", fold.alias("fold")), "sample")
    lexicons = _lexicons(sample)
    featurisers = [Featuriser(*[lexicons[frozenset({j, k})] for k in range(FOLDS)]) for j in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts, folds = [t or "" for t in b.column("text").to_pylist()], b.column("fold").to_numpy()
            x = np.zeros((len(texts), FOLDS, len(FEATURES)))
            for j in np.unique(folds).tolist():
                at = np.flatnonzero(folds == j)
                x[at] = featurisers[j]([texts[i] for i in at])
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("fold"), pa.array([r.tobytes() for r in x], pa.binary())], names=["toxic", "fold", "x"])

    rows = sample.mapInArrow(run, "toxic int, fold int, x binary").collect()
    y, folds = np.array([r.toxic for r in rows], np.float64), np.array([r.fold for r in rows], np.int64)
    featurise = Featuriser(lexicons[frozenset()])
    if len(np.unique(y)) < 2:
        return featurise, float(y.mean()) if len(y) else 0.0
    x = np.stack([np.frombuffer(r.x).reshape(FOLDS, -1) for r in rows])
    order = np.lexsort((*x.reshape(len(x), -1).T, folds, y))  # rows come in any order; sums of floats must not depend on it
    x, y, folds = x[order], y[order], folds[order]
    margin = np.zeros(len(y))
    for k in np.unique(folds):
        at = folds == k
        margin[at] = Boosted().fit(x[~at, k], y[~at]).margin(x[at, k]) if not at.all() else 0.0
    return featurise, Boosted().fit(x[np.arange(len(y)), folds], y).calibrate(margin, y)


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), and the further columns in `carry`.

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored. Only the text gives features. Null texts
    count as empty, and empty ones are scored. Rows repeating an id are scored one by one; null ids are scored and not
    held out. An empty table gives no rows; without labels of both classes every row gets the share of toxic labels.
    Texts aren't shuffled, but for the sample of about sample_rows labelled rows.
    """
    featurise, model = fit(docs, labels, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            x = featurise([t or "" for t in b.column("_text").to_pylist()])[:, 0]
            s = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["_text"]).columns, pa.array(s)], names=[*b.schema.names[:-1], "score"])

    cols = ["doc_id", *carry]
    base = pick(docs, *cols, "text").toDF(*[f"_{i}" for i in range(len(cols))], "_text").withColumn("_text", F.col("_text").cast("string"))
    base = base.select(*base.columns[:-1], held_out(F.col("_0")).alias("held_out"), "_text")
    kinds = ", ".join(f"`{n}` {t}" for n, t in base.dtypes[:-1])
    out = base.mapInArrow(run, f"{kinds}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.toDF("doc_id", *carry, "held_out", "score", "predicted")
