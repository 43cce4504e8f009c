"""Personal data: fixed patterns, and bootstrapped contextual extraction seeded by what they find. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, small, stored

KINDS = ("email", "ip", "card", "phone")

#: Leftmost non-overlapping matches, written so that Java's matcher neither recurses nor rescans a run from each of its
#: characters: possessive repeats, and a start only where a run starts or the last match ended (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word that may be an identifier: it has a digit or an @.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

#: A pattern is the CONTEXT words before or after an entity. It needs this many different known entities, and this
#: confidence to name others. An entity is known from this score on, if this share of its places, on one side, is beside
#: such patterns. Patterns and entities take turns at most ROUNDS times.
CONTEXT, MIN_KNOWN, MIN_CONFIDENCE, MIN_SCORE, MIN_SHARE, ROUNDS = 2, 3, 0.6, 0.6, 0.25, 5

#: Patterns' word runs that go into the plan as a set; more are joined.
RUNS_SENT = 20_000

#: Code points beside a place in which its context is looked for, before the whole text is.
_WIDTHS = (80, 1000, 20_000)

_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of every match of a pattern, in code points, end exclusive."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def add(acc, x):
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["value"].alias("value")))).cast(_SPANS).alias("out"))

    pairs = F.zip_with(found, between, lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out"))
    return F.aggregate(F.filter(pairs, lambda x: x["value"].isNotNull()), first, add)["out"]


def _ip(value: Column) -> Column:
    part = lambda x: F.regexp_replace(x, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.when(F.length(part(x)) <= 3, F.coalesce(part(x).try_cast("int"), F.lit(0))).otherwise(999) <= 255))


def _card(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    worth = lambda c, i: F.when((F.length(digits) - i) % 2 == 1, c).otherwise(F.when(c > 4, 2 * c - 9).otherwise(2 * c))
    luhn = F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: worth(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(12, 19), luhn % 10 == 0).otherwise(False)


def _phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


_CHECKS = {"ip": _ip, "card": _card, "phone": _phone}
_MARKS = {"email": lambda t: F.instr(t, "@") > 0, "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: F.instr(t, "+") > 0}


def _check(kind: str):
    return lambda s: _CHECKS[kind](s["value"])


def _tagged(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def _context(text: Column, place: Column, after: bool) -> Column:
    """The CONTEXT whitespace-separated words before or after a place, lower-cased, or null if there are fewer.

    Read from the nearest code points; from ever more, up to the whole text, while a word may be cut or missing.
    """
    have = F.char_length(text) - place if after else place

    def words(width: Column) -> Column:
        near = F.substring(text, (place + 1).cast("int"), width.cast("int")) if after else F.substring(text, F.greatest(place - width, F.lit(0)).cast("int") + 1, F.least(place, width).cast("int"))
        # the punctuation that closes the entity belongs to no word
        return F.filter(F.split(F.lower(F.regexp_replace(near, r"^\p{Punct}+", "") if after else near), r"\s+"), lambda w: w != "")

    def taken(found: Column) -> Column:
        return F.array_join(F.slice(found, 1, CONTEXT) if after else F.slice(found, -CONTEXT, CONTEXT), " ")

    found = words(have)
    out = F.when(F.size(found) >= CONTEXT, taken(found))
    for width in reversed(_WIDTHS):
        found = words(F.lit(width))
        out = F.when(have <= width, F.when(F.size(found) >= CONTEXT, taken(found))).when(F.size(found) > CONTEXT, taken(found)).otherwise(out)
    return F.when(out.isNotNull(), F.concat(F.lit("> " if after else "< "), out))


def base_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns, text, and base: array of (start, kind number, end, value), sorted."""
    text = F.col("text")
    none = F.array().cast(_SPANS)
    rows = pick(docs, *keep, "text").select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *[F.when(_MARKS[k](text), matches(text, p)).otherwise(none).alias(f"_m_{k}") for k, p in PATTERNS.items()])
    valid = {k: F.filter(f"_m_{k}", _check(k)) if k in _CHECKS else F.col(f"_m_{k}") for k in KINDS}
    return rows.select(*keep, "text", F.array_sort(F.concat(*[_tagged(k, valid[k]) for k in KINDS])).alias("base"))


def _key() -> list[Column]:
    """128 bits of an id and a text: rows with both equal have the same spans."""
    return [F.xxhash64("text", "doc_id").alias("ka"), F.xxhash64("doc_id", F.lit(7), "text").alias("kb")]


_ADDED = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, base, added; both arrays of (start, kind number in KINDS, end, value), sorted.

    docs: doc_id, text; further columns are ignored. Null texts count as empty and give no spans. Rows repeating an id
    are searched one by one, null ids too. An empty table gives no rows. Whole texts are searched, and never shuffled.

    base: matches of PATTERNS that pass their kind's check. added: candidates (words with a digit or an @, closing
    punctuation cut) that overlap no base span and stand beside a pattern of high confidence.

    Seeds are the base spans. Patterns are the CONTEXT words before or after an entity, instances the seeds and the
    candidates; both form a graph with the number of places as weight. In turns, patterns of MIN_KNOWN different known
    entities get a confidence, the summed scores of their entities in proportion to all places of the pattern's words in
    the corpus, whatever is beside (one more counted, against chance); then instances get a score, the chance that one
    of the confident patterns beside them is right (1 for seeds). Those of MIN_SCORE are known from then on, unless most
    of their places, by MIN_SHARE, are elsewhere; so their other contexts become patterns in the next round. Rounds end
    when nothing more gets known. A pattern names its entities' commonest kind.
    """
    held, new, n = _bootstrap(docs)
    return held.join(small(new, n), ["ka", "kb"], "left").select("doc_id", "base", F.coalesce("added", F.array().cast(_ADDED)).alias("added"))


def redact(docs: DataFrame, *keep: str) -> DataFrame:
    """The `keep` columns (doc_id and text among them) of every row, each span of find_pii in text replaced by its kind."""
    _, new, n = _bootstrap(docs)
    others = [c for c in keep if c not in ("doc_id", "text")]
    rows = base_spans(docs, "doc_id", *others).withColumns(dict(zip(("ka", "kb"), _key(), strict=True)))
    rows = rows.join(small(new, n), ["ka", "kb"], "left").withColumn("text", masked(F.col("text"), F.concat("base", F.coalesce("added", F.array().cast(_ADDED)))))
    return rows.select(*keep)


def _run(words: Column, at: Column) -> Column:
    """A hash of CONTEXT words from a place on."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(CONTEXT)])


def _places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, places): where a pattern's words stand in the corpus, whatever is beside them. patterns: pattern, beside, run.

    All runs of words are looked up in the set of the patterns' runs before any is counted, or, if the set is of more
    than RUNS_SENT, counted first; runs are neither shuffled nor joined one by one.
    """
    wanted = patterns.select("run").distinct()
    if not (n := wanted.count()):
        return patterns.select("pattern", F.col("beside").alias("places"))
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"\s+"), lambda w: w != "")
    runs = pick(docs, "text").select(words.alias("w")).filter(F.size("w") >= CONTEXT)
    runs = runs.select(F.explode(F.transform(F.slice("w", 1, F.size("w") - CONTEXT + 1), lambda x, i: F.xxhash64(x, *[F.get("w", i + j) for j in range(1, CONTEXT)]))).alias("run"))
    if n <= RUNS_SENT:
        runs = runs.filter(F.expr(f"run in ({', '.join(str(r.run) + 'L' for r in wanted.collect())})"))
    counted = runs.groupBy("run").agg(F.count("*").alias("all"))
    counted = stored(counted if n <= RUNS_SENT else counted.join(wanted, "run"), "places")
    return stored(patterns.join(small(counted, n), "run", "left").select("pattern", F.greatest("beside", F.coalesce("all", F.lit(0))).alias("places")), "often")


def _bootstrap(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows with key, doc_id and base; added spans by key; the latter's number), all stored."""
    found = base_spans(docs, "doc_id")
    text = F.col("text")
    plain = F.when(F.col("has"), matches(text, CANDIDATE)).otherwise(F.array().cast(_SPANS))
    near = found.withColumn("has", text.rlike("[0-9@]")).withColumn("all", plain)
    cut = lambda s: F.regexp_replace(s["value"], r"[\p{Punct}]+$", "")
    apart = lambda s, base: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    sides = lambda s: F.filter(F.array(_context(text, s["start"], False), _context(text, s["end"], True)), lambda p: p.isNotNull()).alias("patterns")
    others = F.transform(F.filter("all", lambda s: apart(s, F.col("base"))), lambda s: F.struct(sides(s), s["start"].alias("start"), (s["start"] + F.char_length(cut(s))).alias("end"), cut(s).alias("value")))
    seeds = F.transform("base", lambda s: F.struct(sides(s), s["kind"].alias("kind"), s["value"].alias("value")))
    held = stored(near.select(*_key(), "doc_id", "base", others.alias("others"), seeds.alias("seeds")), "spans")

    # the graph: places of each instance beside each pattern; a seed's value is one wherever it stands
    seen = held.select(F.explode("seeds").alias("s")).select("s.patterns", "s.value", "s.kind").unionAll(held.select(F.explode("others").alias("s")).filter("s.end > s.start").select("s.patterns", "s.value", F.lit(None).cast("int").alias("kind")))
    edges = stored(seen.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("kind").alias("kind")), "edges")
    # a pattern of fewer different instances never gets known; its places count with its instances all the same
    often = edges.groupBy("pattern").agg(F.count("*").alias("different"), F.sum("n").alias("beside")).filter(F.col("different") >= MIN_KNOWN).select("pattern", "beside")
    often = _places(docs, stored(often.withColumn("run", _run(F.split(F.substring("pattern", 3, 2**31 - 1), " "), F.lit(0))), "often"))
    live = stored(edges.join(small(often, often.count()), "pattern").withColumn("side", F.substring("pattern", 1, 1)), "live")
    whole = edges.groupBy("value", F.substring("pattern", 1, 1).alias("side")).agg(F.sum("n").alias("all"))
    seeds = edges.filter("kind is not null").groupBy("value").agg(F.max("kind").alias("kind")).select("value", "kind", F.lit(1.0).alias("score"))
    known, now = stored(seeds, "known"), None
    seeds = known
    for _ in range(ROUNDS):
        beside = live.select("pattern", "places", "value", "n").join(known, "value")
        by_kind = beside.groupBy("pattern", "places", "kind").agg(F.count("*").alias("different"), F.sum(F.col("n") * F.col("score")).alias("good"))
        sure = by_kind.groupBy("pattern", "places").agg(F.sum("different").alias("different"), F.sum("good").alias("good"), F.max_by("kind", F.struct("good", -F.col("kind"))).alias("kind"))
        sure = stored(sure.filter(F.col("different") >= MIN_KNOWN).select("pattern", "kind", (F.col("good") / (F.col("places") + 1)).alias("confidence")).filter(F.col("confidence") >= MIN_CONFIDENCE), "patterns")
        count = sure.count()
        scored = live.select("pattern", "value", "side", "n").join(small(sure, count), "pattern").groupBy("value", "side").agg(F.sum("n").alias("n"), F.sum(F.log(1 - F.col("confidence"))).alias("wrong"), F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
        scored = scored.join(whole, ["value", "side"]).join(seeds, "value", "left_anti")
        fresh = scored.groupBy("value").agg(F.max_by("kind", F.struct(-F.col("wrong"), -F.col("kind"))).alias("kind"), (1 - F.exp(F.sum("wrong"))).alias("score"), F.max(F.col("n") / F.col("all")).alias("share"))
        fresh = fresh.filter((F.col("score") >= MIN_SCORE) & (F.col("share") >= MIN_SHARE)).select("value", "kind", "score")
        known = stored(seeds.unionAll(fresh), "known")
        was, now = now, (count, known.count(), round(sure.agg(F.sum("confidence")).first()[0] or 0.0, 2))
        if now == was:
            break

    new = held.select("ka", "kb", F.explode("others").alias("s")).select("ka", "kb", "s.start", "s.end", "s.value", F.explode("s.patterns").alias("pattern")).filter("end > start").join(small(sure, count), "pattern")
    new = new.groupBy("ka", "kb", "start", "end", "value").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    new = stored(new.groupBy("ka", "kb").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "value"))).alias("added")), "added")
    return held, new, new.count()


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def add(acc, s):
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        # array of pieces: joined once at the end
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(between, F.get(names, s["kind"]))).alias("out")))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.array_sort(spans), first, add)
    return F.concat(F.array_join(done["out"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))
