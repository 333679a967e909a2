"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Texts are folded (case, accents, homoglyphs, digits that stand for letters); the automaton finds
lexicon words at word bounds and stems (written with ``*``) where words begin, but not inside
exception phrases; the summed weights over the number of words, plus LENGTH, give the score. The
lexicon, the exceptions and the scale are learned from labels.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold_of, labelled_sample, small_batches, table

#: Labelled rows from which lexicon and scale are learned, at most.
LEARN_ROWS = 20_000
#: Lexicon words and exception phrases, at most; the strongest are kept.
LEXICON, EXCEPTIONS = 20_000, 5_000
#: A lexicon word follows this many different words in toxic texts, and is so many times likelier there.
CONTEXTS, ODDS = 4, 20.0
#: A stem has so many letters, begins so many words of toxic texts, goes on with so many different letters there, and is so much denser there.
STEM_LETTERS, STEM_WORDS, STEM_NEXT, STEM_ODDS = range(4, 11), 8, 4, 8.0
#: Words added to every text's number of words, so that one match in a short text isn't a high rate.
LENGTH = 20
#: Rows with this score or more are toxic.
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, and characters that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t",
    "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "Х": "x", "І": "i", "Ј": "j", "Ѕ": "s",
    "α": "a", "ο": "o", "ε": "e", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "ρ": "p", "υ": "u",
    "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x",
    "ß": "s", "ø": "o", "ł": "l", "đ": "d", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """A table for str.translate that folds characters as they come."""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        plain = HOMOGLYPHS.get(char) or DIGITS.get(char)
        if plain is None and unicodedata.category(char) == "Cf":
            plain = ""  # such as zero-width blanks
        if plain is None:
            parts = unicodedata.normalize("NFKD", char)
            plain = "".join(HOMOGLYPHS.get(c, c) for c in parts if not unicodedata.combining(c)).lower()
        self[point] = plain
        return plain


_FOLD = _Fold()
_TOKEN = re.compile(r"\w+")


def fold(text: str) -> str:
    return text.translate(_FOLD)


def tokens(folded: str) -> list[str]:
    return _TOKEN.findall(folded)


class Lexicon:
    """Weights of words and stems (``stem*``, which longer words begin with) and phrases that excuse them; scores folded text."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], scale: float):
        import ahocorasick

        self.scale = scale
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for word, weight in weights.items():
            found.setdefault(word.rstrip("*"), [None, None])[word.endswith("*")] = float(weight)
        for phrase in exceptions:
            found.setdefault(phrase, [None, None])[0] = 0.0
        for word, (whole, stem) in found.items():
            if word:
                self.automaton.add_word(word, (len(word), whole, stem))
        if len(self.automaton):
            self.automaton.make_automaton()

    def rate(self, text: str | None) -> float:
        """Weights of matched words over the number of words; of overlapping matches the first counts, of those the longest.

        Words and phrases are matched in the text's words, joined by blanks, whatever stood between them.
        """
        if not text or not len(self.automaton):
            return 0.0
        own = tokens(fold(text))
        line = " ".join(own)
        total, taken, hits = 0.0, -1, []
        for end, (size, whole, stem) in self.automaton.iter(line):
            start = end - size + 1
            weight = whole if end + 1 == len(line) or line[end + 1] == " " else stem
            if weight is not None and (start == 0 or line[start - 1] == " "):
                hits.append((start, -size, weight))
        for start, size, weight in sorted(hits):
            if start > taken:
                total += weight
                taken = start - size - 1
        return total / (len(own) + LENGTH)

    def score(self, text: str | None) -> float:
        return 1.0 - math.exp(-self.scale * self.rate(text))


def _words_of(batches):
    """(word, previous word, toxic) of every text, once for each text."""
    for batch in batches:
        found = []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = tokens(fold(text or ""))
            found += [(w, p, label) for w, p in set(zip(own, ["", *own]))]
        w, p, y = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(p, pa.string()), pa.array(y, pa.int32())], ["word", "previous", "toxic"])


def learn_stems(words: DataFrame) -> dict[str, float]:
    """Stems and their log odds from rows (word, bad, good), how often a word stands in toxic and in other texts.

    Of stems that extend each other the most telling stays: words in toxic texts times log odds, then the longest.
    """
    whole = words.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    starts = F.filter(F.array(*[F.struct(F.substring("word", 1, n).alias("stem"), F.substring("word", n + 1, 1).alias("next")) for n in STEM_LETTERS]), lambda x: x["next"] != "")
    counts = words.select(F.explode(starts).alias("start"), "bad", "good").groupBy("start").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = counts.groupBy("start.stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.when(F.col("bad") > 0, 1)).alias("letters"))
    odds = F.log((F.col("bad") + 0.5) / (whole["bad"] + 1)) - F.log((F.col("good") + 0.5) / (whole["good"] + 1))
    found = counts.where((F.col("bad") >= STEM_WORDS) & (F.col("letters") >= STEM_NEXT)).withColumn("odds", odds).where(F.col("odds") >= math.log(STEM_ODDS))
    found = found.orderBy(F.desc(F.col("bad") * F.col("odds")), F.desc(F.length("stem")), "stem").limit(LEXICON).collect()
    chosen: dict[str, float] = {}
    within: set[str] = set()  # the chosen stems' own beginnings
    for row in found:
        stem = row["stem"]
        if stem not in within and not any(stem[:n] in chosen for n in STEM_LETTERS):
            chosen[stem] = row["odds"]
            within.update(stem[:n] for n in range(len(stem) + 1))
    return chosen


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], list[str], float]:
    """Lexicon weights (0 to 1) of words and stems, exception phrases and scale from rows (text, toxic)."""
    sample = sample.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).distinct().persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        bad, good = sizes.get(1, 0), sizes.get(0, 0)
        if not bad or not good:
            return {}, [], 1.0
        pairs = sample.mapInArrow(_words_of, "word string, previous string, toxic int")
        one = F.col("toxic") == 1
        by_context = [F.count(F.when(one, 1)).alias("bad"), F.count(F.when(~one, 1)).alias("good")]
        seen = pairs.groupBy("word", "previous").agg(*by_context).groupBy("word").agg(F.count(F.when(F.col("bad") > 0, 1)).alias("contexts"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).persist()
        odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
        found = seen.where(F.col("contexts") >= CONTEXTS).withColumn("odds", odds).where(F.col("odds") >= math.log(ODDS))
        found = found.orderBy(F.desc("odds"), "word").limit(LEXICON).collect()
        stems = learn_stems(seen)
        seen.unpersist()
        found = {r["word"]: r["odds"] for r in found if not any(r["word"][:n] in stems for n in STEM_LETTERS if n < len(r["word"]))}
        found |= {f"{stem}*": odds for stem, odds in stems.items()}
        if not found:
            return {}, [], 1.0
        top = max(found.values())
        weights = {word: odds / top for word, odds in found.items()}
        # Pairs of a lexicon word and the word before it that clean texts have as often are no sign of toxicity.
        known = sample.sparkSession.createDataFrame([(w,) for w in weights], "word string")
        excused = pairs.join(F.broadcast(known), "word").groupBy("word", "previous").agg(*by_context).where("previous <> '' AND good >= 3")
        excused = excused.where((F.col("good") + 0.5) / (good + 1) >= (F.col("bad") + 0.5) / (bad + 1))
        excused = [f"{r['previous']} {r['word']}" for r in excused.orderBy(F.desc("good"), "word", "previous").limit(EXCEPTIONS).collect()]
        return weights, excused, _scale(sample, weights, excused)
    finally:
        sample.unpersist()


def _scale(sample: DataFrame, weights: dict, exceptions: list) -> float:
    """The scale at which the best cut between the labels' rates scores THRESHOLD."""
    rates = _scored(sample.select("text", "toxic"), (weights, exceptions, 1.0), "rate").toPandas()
    x, y = rates["value"].to_numpy(), rates["toxic"].to_numpy() == 1
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    # Cutting before place k calls k.. toxic; the middle of the best gap is the cut.
    right = np.r_[0, np.cumsum(~y)] + np.r_[np.cumsum(y[::-1])[::-1], 0]
    usable = np.r_[True, x[1:] > x[:-1], True]
    k = int(np.argmax(np.where(usable, right, -1.0)))
    low, high = (x[k - 1] if k else 0.0), (x[k] if k < len(x) else x[-1] * 2 + 1e-6)
    cut_at = (low + high) / 2
    return -math.log(1 - THRESHOLD) / max(cut_at, 1e-9)


def _scored(docs: DataFrame, model: tuple, what: str) -> DataFrame:
    """``docs`` (text first) with value, the rate or score of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon = Lexicon(*shared.value)
        measure = lexicon.rate if what == "rate" else lexicon.score
        for batch in batches:
            values = [measure(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values, pa.float64())], [*batch.schema.names[1:], "value"])

    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select("text", *[f.name for f in rest]).mapInArrow(run, f"{schema}, value double")


def learn_from(documents: DataFrame, labels: DataFrame) -> tuple:
    """A model from the labelled documents that aren't held out (LEARN_ROWS of them, at most)."""
    small_batches(documents.sparkSession)
    sample = labelled_sample(documents, labels.where(F.col("toxic").isin(0, 1)), "toxic", fold_of(F.col("doc_id"), 3) != 1, LEARN_ROWS)
    return learn_lexicon(sample)


def score_toxicity(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null or empty texts score 0, and so does any text under an empty lexicon.

    Repeated rows are scored each; columns besides doc_id and text are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return _scored(docs.select("text", "doc_id"), model, "score").select("doc_id", F.col("value").alias("score"))


def drop_toxic(docs: DataFrame, model: tuple) -> DataFrame:
    """All columns of the rows that score below THRESHOLD."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon = Lexicon(*shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([lexicon.score(t) < THRESHOLD for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score_toxicity(documents, learn_from(documents, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": query}
ORACLE_SQL: dict[str, str] = {}
