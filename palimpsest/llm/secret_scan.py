"""Secret scans: patterns, and Markov models of characters.

Besides three kinds of patterns, runs of key characters are judged by two character models, one
of random strings and one of ordinary identifiers and words, both trained from labelled samples:
strings made at random are labelled random; words of documents outside the patterns' matches, and
identifiers composed of such words and of programmers' words, are labelled ordinary. A run is a
secret where the log-likelihood ratio for each character exceeds a cut, which is chosen on samples
kept out of the training.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import WORD, small_batches, table

# The kinds and their patterns.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CLASS = np.full(128, -1, np.int64)
_CLASS[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

#: Documents whose words are samples of ordinary identifiers, words and strings of each label in training, and the seed of those made.
LEARN_ROWS, LEARN_WORDS, MADE, SEED = 2_000, 100_000, 20_000, 4242
#: Observations that a character's own frequency counts for, and the share of ordinary samples kept out that may lie above the cut.
BACKED, ABOVE = 8.0, 0.002
#: The least cut, in log-likelihood ratio a character.
LEAST_CUT = 0.2

#: Words that identifiers are made of, besides those of the documents.
PROGRAMMERS = """
account action address agent api app application apply archive array async auth batch block buffer build by bytes cache call
catalog channel check class client close cluster code collection column command commit config connection constructor container
content context control controller convert count create current cursor data database date debug default define delete device
dictionary directory disk dispatch document domain driver edit element enable encode endpoint engine entity entry environment
error event example exception execute export factory field file filter find first flag folder format frame from function
generate get global graph group handle handler hash header height hidden history host http id identifier image import index
info init input instance integer interface internal item java job join json key label language last layer layout length level
library limit line link list listener load local location lock log login main manager map match max memory merge message
method min mode model module monitor move name network next node notification null number object office offset open operation
option order org output package page parameter parent parse password path pattern payload permission plan platform pool port
position prefix print private process product profile project property provider proxy public query queue random range read
record reference region register remote remove render replace report request reset resource response result retry role root
route row rule run save schedule schema scope screen script search select send sequence server service session set setting
shape size socket sort source spark split src stack start state static status step stop storage store stream string style
sync system table tag target task template test text thread time timeout token total trace transaction transform tree trigger
type unit update upload url user util valid value variable vector version view visible wait width window worker wrapper write
xml zone
""".split()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the patterns, in code points, end exclusive."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def _transitions(samples: list[str]) -> np.ndarray:
    """Log probabilities of a character after another; a pair that is seldom seen leans on the second's own frequency."""
    n = len(ALPHABET)
    counts, single = np.zeros((n, n)), np.ones(n)
    for s in samples:
        c = _CLASS[np.frombuffer(s.encode(), np.uint8)]
        np.add.at(counts, (c[:-1], c[1:]), 1)
        np.add.at(single, c, 1)
    return np.log((counts + BACKED * single / single.sum()) / (counts.sum(1, keepdims=True) + BACKED))


def random_strings(count: int = MADE, seed: int = SEED) -> list[str]:
    """Labelled samples of secrets: strings over the alphabets that keys use."""
    rng = np.random.default_rng(seed)
    kinds = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_lowercase + string.digits]
    return ["".join(rng.choice(list(kinds[i % len(kinds)]), int(rng.integers(20, 48)))) for i in range(count)]


def made_identifiers(words: list[str], count: int = MADE, seed: int = SEED) -> list[str]:
    """Labelled samples of ordinary identifiers: two to six words in the ways that programmers join them."""
    rng, out = np.random.default_rng(seed + 1), []
    own = [w.lower() for w in words if w.isascii() and w.isalpha() and len(w) < 16] or PROGRAMMERS
    for i in range(count):
        pool = own if i % 4 == 0 else PROGRAMMERS
        parts = [pool[k] for k in rng.integers(0, len(pool), int(rng.integers(2, 7)))]
        title = [p.capitalize() for p in parts]
        style = (i // 4) % 7
        if style == 0:
            joined = parts[0] + "".join(title[1:])
        elif style == 1:
            joined = "".join(t.upper() if rng.random() < 0.15 and len(t) < 5 else t for t in title)
        elif style == 6:
            joined = "/".join(parts[:-2]) + "/" + "".join(title[-2:])
        else:
            joined = ("_", "_", "-", "/")[style - 2].join(p.upper() if style == 3 else p for p in parts)
        out.append(joined + (str(int(rng.integers(0, 1000))) if rng.random() < 0.1 else ""))
    return out


def learn_ratio(ordinary: list[str], random: list[str]) -> np.ndarray:
    """The log-likelihood ratio of each pair of characters, from the two labelled samples."""
    return _transitions(random) - _transitions(ordinary)


def learn_models(words: list[str]) -> tuple[np.ndarray, float]:
    """The ratio of each pair of characters, and the cut that leaves ABOVE of the ordinary samples kept out above it."""
    made = made_identifiers(words)
    held = made_identifiers(words, MADE // 2, SEED + 100)
    ratio = learn_ratio(words + made, random_strings())
    scores = [ratio_of(w, ratio) for w in held + words if len(w) >= SHORTEST]
    return ratio, max(LEAST_CUT, float(np.quantile(scores, 1 - ABOVE))) if scores else LEAST_CUT


def ratio_of(run: str, ratio: np.ndarray) -> float:
    c = _CLASS[np.frombuffer(run.encode(), np.uint8)]
    return float(ratio[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0


def all_spans(text: str, ratio: np.ndarray, cut: float) -> list[tuple[str, int, int]]:
    """Base spans, and runs that the models call random and no base span touches; by start, then kind."""
    spans = base_spans(text)
    starts, ends = [], []  # of the text that base spans cover, in order and apart
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for m in RUN.finditer(text):
        a, b = m.span()
        k = bisect_left(starts, b) - 1  # the last that begins before the run ends
        if (k < 0 or ends[k] <= a) and ratio_of(m[0], ratio) > cut:
            spans.append(("markov", a, b))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def learn_from(documents: DataFrame) -> tuple[np.ndarray, float]:
    """Models and cut. Ordinary identifiers are, besides those made, the words, without patterns' matches, of LEARN_ROWS documents at most, with the lowest hash of their id."""
    small_batches(documents.sparkSession)

    def ordinary(batches):
        for batch in batches:
            found = set()
            for text in batch.column(0).to_pylist():
                for word in WORD.findall(text or ""):
                    word = "".join(c for c in word if c in ALPHABET)
                    if 1 < len(word) < 64 and not base_spans(word) and (word.isdigit() or sum(c.isdigit() for c in word) * 4 < len(word)):
                        found.add(word)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    ids = documents.where("text IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARN_ROWS)
    picked = documents.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(ordinary, "word string").distinct()
    words = [r[0] for r in picked.orderBy(F.xxhash64("word"), "word").limit(LEARN_WORDS).collect()]
    return learn_models(words)


def scan_secrets(docs: DataFrame, models: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row's whole text.

    Null and empty texts have no spans; repeated rows are each scanned; other columns are
    ignored; an empty table gives no rows. Spans of one kind never overlap; a ``markov`` span
    overlaps no other.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in all_spans(t or "", *shared.value)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = scan_secrets(documents, learn_from(documents))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


QUERIES = {"op8_secret_scan": query}
ORACLE_SQL: dict[str, str] = {}
