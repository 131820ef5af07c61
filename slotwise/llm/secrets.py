"""Secret scans: fixed patterns, and Markov models that tell random strings from ordinary ones.

Two character models, one of random strings and one of ordinary identifiers, are counted from labelled
samples; a candidate string is reported if the mean log-likelihood ratio of its transitions is high.
All work on texts is DataFrame code; only the transition counts (at most one row per label and pair of
characters) reach the driver, which turns them into one literal array.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import text_of

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Order of the kinds in results.
KINDS = ("assign", "access", "hex", "markov")
#: Characters the models know; all others share class 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
CLASSES = len(ALPHABET) + 1
#: Documents whose strings label the samples, and mean log-likelihood ratio (nats) of a transition that reports.
SAMPLE_DOCUMENTS, THRESHOLD = 2000, 0.6
SMOOTHING = 10
#: Matches whose offsets are summed up in one inner fold; keeps the work linear in the number of matches.
_BLOCK = 256
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """All leftmost non-overlapping matches, and the stretches between them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is referred to."""
    return F.get(F.transform(F.array(value), use), 0)


def spans(hits: Column, gaps: Column, kind: int, good: Column | None = None) -> Column:
    """(start, kind, end) of every match in code points, end exclusive; only those with ``good``, an array of booleans, true."""
    empty = F.array().cast(_SPANS)

    def folded(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(p["gaps"], i))
            end = start + F.length(F.get(p["hits"], i))
            own = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            kept = own if good is None else F.when(F.get(p["good"], i), own).otherwise(empty)
            return F.struct(end.alias("at"), F.concat(acc["out"], kept).alias("out"))

        def block(acc: Column, first: Column) -> Column:
            inside = F.sequence(first, F.least(first + _BLOCK, F.size(p["hits"])) - 1)
            part = F.aggregate(inside, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
            return _bound(part, lambda q: F.struct(q["at"].alias("at"), F.concat(acc["out"], F.array(q["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
        blocks = F.sequence(F.lit(0), F.size(p["hits"]) - 1, F.lit(_BLOCK))
        return F.when(F.size(p["hits"]) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))).otherwise(empty)

    parts = [hits.alias("hits"), gaps.alias("gaps")] + ([] if good is None else [good.alias("good")])
    return _bound(F.struct(*parts), folded)


def _class_of(char: Column) -> Column:
    """Place of a character in the alphabet, 0 for others."""
    return F.position(char, F.lit(ALPHABET))


def _classes(value: Column) -> Column:
    return F.transform(F.split(value, ""), _class_of)


def transition_counts(samples: DataFrame) -> DataFrame:
    """(label, pair, n) from labelled strings (value, label): how often one character class follows another."""
    rows = samples.where("value IS NOT NULL AND label IS NOT NULL").select("label", _classes(F.col("value")).alias("c"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * CLASSES + F.get("c", i))
    return rows.where(F.size("c") > 1).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def train(samples: DataFrame) -> np.ndarray:
    """Log-likelihood ratio, random to ordinary, of every pair of character classes.

    ``samples`` has ``value`` and ``label`` (1 random, 0 ordinary); other labels are left out.  A character's
    followers are smoothed by ``SMOOTHING`` times the share of each in all strings of the label, so that what
    ordinary strings never hold counts against them.  Without samples all ratios are zero and nothing is reported.
    """
    counts = np.zeros((2, CLASSES, CLASSES))
    for label, pair, n in transition_counts(samples.where("label IN (0, 1)")).collect():
        counts[label].flat[pair] += n
    alone = counts.sum(axis=1, keepdims=True) + 0.5
    alone /= alone.sum(axis=2, keepdims=True)
    share = np.log((counts + SMOOTHING * alone) / (counts.sum(axis=2, keepdims=True) + SMOOTHING))
    return (share[1] - share[0]).ravel()


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct rows of (doc_id, text): those with the smallest hashes.

    Only ids and hashes are sorted, and only those below four times the hash that is expected to be the
    last one taken; the texts are then picked by a join with at most ``most`` keys.
    """
    mark, span = F.xxhash64("doc_id", "text"), 1 << 30
    keys = rows.select(F.pmod(mark, F.lit(span)).alias("place"), mark.alias("mark"))
    count = rows.count()
    if count > 4 * most:
        keys = keys.where(F.col("place") < span * 4 * most // count + 1)
    taken = keys.distinct().orderBy("place", "mark").limit(most).select("mark")
    found = rows.withColumn("mark", mark).join(F.broadcast(taken), "mark")
    return found.groupBy("mark").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text")


def labelled_samples(docs: DataFrame, most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Labelled strings (value, label) from a bounded sample of ``docs`` (doc_id, text).

    The ``most`` documents with the smallest hash of the id are taken.  Their words of letters, digits
    and joints label ordinary strings (0), without the matches of the fixed patterns.  These matches' values,
    and strings made from digests of the words in three alphabets, label random ones (1).
    """
    some = _sampled(docs.select("doc_id", text_of("text").alias("text")), most)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = some.select(F.explode(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9_/-]{4,}"), F.lit(0))).alias("value"))
    known = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 1), (ACCESS, 0), (HEX, 0))])
    found = some.select(F.explode(known).alias("value")).where(F.length("value") >= 12)
    digest = F.sha2(F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("random")), 256)
    made = some.select(F.explode(F.array(digest, F.base64(F.unhex(digest)), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)))).alias("value"))
    return words.select("value", F.lit(0).alias("label")).union(found.union(made).select("value", F.lit(1)))


def _ratio(value: Column, ratios: np.ndarray) -> Column:
    """Mean log-likelihood ratio of a string's transitions."""
    table = F.lit(ratios)

    def summed(c: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(c) - 1)
        return F.aggregate(places, F.lit(0.0), lambda acc, i: acc + F.get(table, F.get(c, i - 1) * CLASSES + F.get(c, i)))

    return _bound(_classes(value), summed) / (F.length(value) - 1)


def find_secrets(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", out: str = "secrets", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one more column: all secrets as (start, kind, end), sorted, in code points, end exclusive.

    ``kind`` numbers ``KINDS``.  The fixed patterns are searched apart from each other and may overlap;
    the models' spans (kind 3) are candidates that touch none of them.  Null and empty texts have none.
    """
    names = [f"{out}_{x}" for x in ("t", "h0", "g0", "h1", "g1", "h2", "g2", "h3", "g3", "base", "extra")]
    t, (h0, g0, h1, g1, h2, g2, h3, g3), (base, extra) = names[0], names[1:9], names[9:]
    rows = docs.withColumn(t, text_of(text_col))
    none = F.array().cast("array<string>")
    for pattern, h, g in ((ASSIGN, h0, g0), (ACCESS, h1, g1), (HEX, h2, g2), (CANDIDATE, h3, g3)):
        hits, gaps = matches(F.col(t), pattern)
        seen = F.col(t).rlike(pattern)
        rows = rows.withColumn(h, F.when(seen, hits).otherwise(none)).withColumn(g, F.when(F.size(h) > 0, gaps).otherwise(none))
    long_value = F.transform(F.col(h0), lambda x: F.length(F.regexp_extract(x, ASSIGN, 1)) >= 12)
    fixed = F.concat(spans(F.col(h0), F.col(g0), 0, long_value), spans(F.col(h1), F.col(g1), 1), spans(F.col(h2), F.col(g2), 2))
    rows = rows.withColumn(base, F.sort_array(fixed))
    random = F.transform(F.col(h3), lambda x: _ratio(x, ratios) > threshold)
    rows = rows.withColumn(extra, F.when(F.size(h3) > 0, spans(F.col(h3), F.col(g3), 3, random)).otherwise(F.array().cast(_SPANS)))
    touches = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    whole = _bound(
        F.struct(F.col(base).alias("base"), F.col(extra).alias("extra")),
        lambda p: F.concat(p["base"], F.filter(p["extra"], lambda s: ~F.exists(p["base"], lambda b: touches(s, b)))),
    )
    return rows.withColumn(out, F.sort_array(whole)).drop(*names)


def joined(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    def step(acc: Column, s: Column) -> Column:
        before = F.when(s["start"] > acc["at"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise(F.lit(""))
        fresh = (s["start"] >= acc["at"]) | (acc["at"] == 0)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(before, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, first: Column) -> Column:
        """Texts and marks of some spans: arrays that grow are short ones."""
        begun = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out"))
        inner = F.aggregate(F.slice(found, first + 1, F.lit(_BLOCK)), begun, step)
        return _bound(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(x["out"], ""))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1))
    blocks = F.sequence(F.lit(0), F.size(found) - 1, F.lit(_BLOCK))
    return F.when(F.size(found) > 0, F.aggregate(blocks, start, block, done)).otherwise(text)
