"""Term extraction: domains, n-grams, scores, filter."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.texts import CAMEL_PART, TERM_PATTERNS, TERM_STOPWORDS, WORD_PATTERN, case_pattern, term_kind
from .checkpoints import short_batches, spread

# The core terms of each domain, in the domains' order, which decides ties. Fuller lists of keywords are a parameter.
CORE = {
    "database": ["postgres", "postgresql", "mysql", "mongodb", "redis", "wal", "mvcc", "acid", "checkpoint", "vacuum", "pg_dump", "pg_restore", "libpq", "psql"],
    "ai": ["transformer", "bert", "gpt", "llama", "claude", "llm", "rag", "fine-tuning", "pytorch", "tensorflow"],
    "medical": ["mri", "ct", "pet", "icd", "snomed", "diagnosis", "pathology", "clinical trial"],
    "legal": ["gdpr", "ccpa", "contract", "tort", "liability", "jurisdiction", "injunction"],
    "finance": ["roi", "ebitda", "ipo", "derivative", "gaap", "sec", "portfolio"],
    "devops": ["docker", "kubernetes", "terraform", "prometheus", "grafana", "cicd", "gitops"],
}
# Words of SQL, which are no terms.
SQL_WORDS = [
    "SELECT", "FROM", "WHERE", "ORDER", "GROUP", "HAVING", "LIMIT",
    "OFFSET", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER",
    "JOIN", "LEFT", "RIGHT", "INNER", "OUTER", "CROSS", "NATURAL",
    "UNION", "EXCEPT", "INTERSECT", "WITH", "AS", "ON", "USING",
    "AND", "OR", "NOT", "IN", "IS", "LIKE", "BETWEEN", "EXISTS",
    "NULL", "TRUE", "FALSE", "CASE", "WHEN", "THEN", "ELSE", "END",
    "CAST", "COALESCE", "NULLIF", "DISTINCT", "ALL", "ANY", "SOME",
]
# What a type is called.
LABELS = {"component": "组件", "parameter": "参数", "algorithm": "算法", "tool": "工具", "concept": "概念", "protocol": "协议", "api": "API", "metric": "指标", "entity": "实体"}


def merge_settings(primary: dict, secondary: dict) -> dict:
    """Settings of two domains: lists one after the other, all else the first's, or the second's where that has none."""
    both = {k: [*primary.get(k, []), *secondary.get(k, [])] for k in ("whitelist", "blacklist", "roots", "patterns")}
    return {**secondary, **{k: v for k, v in primary.items() if v not in (None, "")}, **both}


def domain_scores(docs: DataFrame, domains: dict[str, list[str]] = CORE, core: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id and scores (domain, score, place), best first (H16): a point for each keyword that a text contains, two more for each core one.

    The dictionaries are literals of one projection, so that no text is joined or moved, and a row is answered by itself.
    """
    text, core = F.lower(F.coalesce("text", F.lit(""))), CORE if core is None else core
    held = lambda words, points: [F.when(F.contains(text, F.lit(w)), points).otherwise(0) for w in words]
    total = lambda parts: sum(parts, F.lit(0))
    scores = [F.struct((-total(held(sorted(set(w)), 1) + held(core.get(d, []), 2))).alias("minus"), F.lit(k).alias("place"), F.lit(d).alias("domain")) for k, (d, w) in enumerate(domains.items())]
    ordered = F.transform(F.array_sort(F.array(*scores)), lambda s: F.struct(s["domain"].alias("domain"), (-s["minus"]).alias("score"), s["place"].alias("place")))
    return docs.select("doc_id", ordered.alias("scores"))


def detect_domain(scores: DataFrame, least: float = 0.3) -> DataFrame:
    """The domain of the best score, with the lead over the second as confidence; general if that is low."""
    first, second = F.col("scores")[0]["score"], F.coalesce(F.get("scores", F.lit(1))["score"], F.lit(0))
    confidence = (first - second) / (first + 1)
    good = (first > 0) & (confidence >= least)
    return scores.select("doc_id", F.when(good, F.col("scores")[0]["domain"]).otherwise("general").alias("domain"), confidence.cast("double").alias("confidence"))


def fallback_domains(scores: DataFrame, most: int = 3) -> DataFrame:
    """Up to three domains with a score, best first."""
    some = F.filter("scores", lambda s: s["score"] > 0)
    return scores.select("doc_id", F.slice(F.transform(some, lambda s: s["domain"]), 1, most).alias("domains"))


def effective_domain(doc_domain: Column, doc_confidence: Column, block_domain: Column, block_confidence: Column) -> Column:
    """A block's domain if it is sure, and surer by a fifth than its document's."""
    return F.when((block_confidence >= 0.5) & (block_confidence > 1.2 * doc_confidence), block_domain).otherwise(doc_domain)


def block_domains(docs: DataFrame, blocks: DataFrame, domains: dict[str, list[str]] = CORE, core: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, block and domain of rows (doc_id, block, text): a block's own where it is sure enough, else its document's."""
    whole = detect_domain(domain_scores(docs, domains, core)).select("doc_id", F.col("domain").alias("doc_domain"), F.col("confidence").alias("doc_confidence"))
    keyed = blocks.select(F.struct("doc_id", "block").alias("doc_id"), "text")
    part = detect_domain(domain_scores(keyed, domains, core)).select("doc_id.*", "domain", "confidence")
    return part.join(whole, "doc_id").select("doc_id", "block", effective_domain(F.col("doc_domain"), F.col("doc_confidence"), F.col("domain"), F.col("confidence")).alias("domain"))


_SPECIAL = [re.compile(p, re.ASCII) for p in TERM_PATTERNS]
_WORD, _CAMEL = re.compile(WORD_PATTERN), re.compile(CAMEL_PART)
_STOP = frozenset(TERM_STOPWORDS)


def _is_special(token: str) -> bool:
    return token.startswith("pg_") or "-" in token or (len(token) <= 8 and token.upper() == token) or _CAMEL.search(token) is not None


def grams(text: str, most: int = 3, least: int = 3) -> Counter:
    """Special tokens of a text, and runs of 2 to ``most`` of its plain words of eight characters or more, with their numbers."""
    special: list[str] = []
    plain: list[str] = []
    for pattern in _SPECIAL:
        for token in pattern.findall(text):
            (special if _is_special(token) else plain).append(token)
    plain += [w for w in _WORD.findall(text) if len(w) >= least and w.lower() not in _STOP]
    held = Counter(t for t in special if len(t) >= least)
    for n in range(2, most + 1):
        held.update(g for g in map(" ".join, zip(*(plain[k:] for k in range(n)))) if len(g) >= 8)
    return held


def _shape(term: str) -> float:
    if term[:3].lower() == "pg_":
        return 3.0
    if " " in term:  # runs hold plain words only, without hyphens and inner capitals
        return 2.0 if len(term) <= 8 and term.upper() == term else 1.0
    if "-" in term:
        return 1.5
    return 2.0 if (len(term) <= 8 and term.upper() == term) or _CAMEL.search(term) else 1.0


#: Rows of a batch that leaves a task, after which it holds at most one text's more.
TOLD = 20_000


def _told(batches, make: Callable, fields: list[tuple[str, pa.DataType]]):
    """Batches of doc_id and the rows that ``make`` gives for each text: some texts' at a time, as terms are many times larger than their text."""
    ids, rows, kind = [], [], None

    def batch_of():
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c, t) for c, (_, t) in zip(columns, fields)]], ["doc_id", *[n for n, _ in fields]])

    for batch in batches:
        kind = batch.schema.field(0).type
        for doc, text in zip(*batch.columns):
            made = make(text.as_py() or "")
            ids += [doc.as_py()] * len(made)
            rows += made
            if len(rows) >= TOLD:
                yield batch_of()
                ids, rows = [], []
    if rows:
        yield batch_of()


def term_counts(docs: DataFrame, most: int = 3, least: int = 3) -> DataFrame:
    """doc_id, term and freq of each row's n-grams (H3, D10), counted where the text is, so that only different terms leave the row."""

    def run(batches):
        yield from _told(batches, lambda text: list(grams(text, most, least).items()), [("term", pa.string()), ("freq", pa.int64())])

    short_batches(docs.sparkSession)
    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, freq long")


#: Weights of the measures in a term's score.
WEIGHTS = {"tfidf": 1.0, "cvalue": 1.0, "freq": 0.5, "length": 0.5}


def measured(held: Counter, most: int = 3, weights: dict[str, float] = WEIGHTS) -> list[tuple[str, int, int, float, float, float]]:
    """(term, freq, len, tfidf, cvalue, score) of a text's n-grams.

    tfidf is the share of the text's n-grams, times a factor for the term's shape (H4). cvalue is log2(words) times
    the frequency, less the mean frequency of the longer terms that hold it: a term of two words is held by one of three that has both in this order (H5, C15).
    The score is their weighted sum with the logarithm of the frequency and the length, 0 at least (H8).
    """
    terms, freq, _, size, tfidf, cvalue, score = _measures(held, most, weights)
    return list(zip(terms, freq.tolist(), size.tolist(), tfidf.tolist(), cvalue.tolist(), score.tolist()))


def _measures(held: Counter, most: int, weights: dict[str, float]) -> tuple:
    """Terms, and arrays of their freq, length in characters, len, tfidf, cvalue and score."""
    terms, freq = list(held), np.fromiter(held.values(), np.int64, len(held))
    size = np.fromiter((t.count(" ") + 1 for t in terms), np.int64, len(terms))
    nested: dict[str, list[int]] = {}
    for k in np.flatnonzero(size == 3).tolist():
        a, b, c = terms[k].split(" ")
        for pair in {f"{a} {b}", f"{a} {c}", f"{b} {c}"}:
            if pair in held:
                nested.setdefault(pair, []).append(int(freq[k]))
    shape = np.fromiter(map(_shape, terms), np.float64, len(terms))
    tfidf = freq / max(1, int(freq.sum())) * shape
    mean = np.zeros(len(terms))
    if nested:
        own = np.flatnonzero(size == 2)
        mean[own] = [sum(n) / len(n) if (n := nested.get(terms[k])) else 0.0 for k in own.tolist()]
    cvalue = np.log2(size) * (freq - mean)
    cvalue = np.where(mean > 0, np.maximum(0.0, cvalue), cvalue)
    score = weights["tfidf"] * tfidf + weights["cvalue"] * cvalue + weights["freq"] * np.log2(1 + freq) + weights["length"] * size / most
    return terms, freq, np.fromiter(map(len, terms), np.int64, len(terms)), size, tfidf, cvalue, np.maximum(0.0, score)


def best_terms(held: Counter, most: int = 3, weights: dict[str, float] = WEIGHTS, least_freq: int = 1, shortest: int = 0, longest: int | None = None, best: int | None = None) -> list[tuple]:
    """As ``measured``, the frequent ones of fit length, the best first, ``best`` of them at most; scores count to nine digits, ties go by the term."""
    if not held:
        return []
    terms, freq, letters, size, tfidf, cvalue, score = _measures(held, most, weights)
    fit = np.flatnonzero((freq >= least_freq) & (letters >= shortest) & (letters <= (longest or letters.max())))
    rounded = np.round(score, 9)
    if best is not None and len(fit) > best:
        fit = fit[rounded[fit] >= -np.partition(-rounded[fit], best - 1)[best - 1]]
    order = sorted(fit.tolist(), key=lambda k: (-rounded[k], terms[k]))[:best]
    return [(terms[k], int(freq[k]), int(size[k]), float(tfidf[k]), float(cvalue[k]), float(score[k])) for k in order]


def scored_terms(docs: DataFrame, most: int = 3, least: int = 3, weights: dict[str, float] = WEIGHTS, least_freq: int = 1, shortest: int = 0, longest: int | None = None, best: int | None = None) -> DataFrame:
    """doc_id, term, freq, len, tfidf, cvalue, score and rank of each row's terms, the best first.

    A row is read, counted and measured in one task, and only the terms that are frequent and of fit length, ``best``
    of them at most, leave it: nothing is shuffled. Scores are compared to nine digits, ties go by the term. Rows of one doc_id are texts of their own; null texts have no terms.
    """
    types = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
    fields = list(zip(["term", "freq", "len", "tfidf", "cvalue", "score", "rank"], types))

    def ranked(text):
        kept = best_terms(grams(text, most, least), most, weights, least_freq, shortest, longest, best)
        return [(*r, k) for k, r in enumerate(kept, 1)]

    def run(batches):
        yield from _told(batches, ranked, fields)

    short_batches(docs.sparkSession)
    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, freq long, len int, tfidf double, cvalue double, score double, rank int")


def extract(docs: DataFrame, least_freq: int = 2, shortest: int = 3, longest: int = 50, most: int = 3, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Scored terms of every row that are frequent and of fit length (H9): doc_id, term, freq, len, tfidf, cvalue, score."""
    return scored_terms(docs, most, 3, weights, least_freq, shortest, longest).drop("rank")


def inferred_type(term: Column) -> Column:
    """What a whitelisted term is, by its look."""
    low = F.lower(term)
    return (
        F.when(low.contains("_") & ~low.startswith("pg_"), "parameter").when(low.startswith("pg_") & (F.length(low) <= 20), "tool")
        .when((low.contains("-") & low.contains("join")) | low.contains("tree"), "algorithm").when(low.startswith("lib") | (low == "ecpg"), "protocol").otherwise("concept")
    )


def type_label(kind: Column) -> Column:
    """(H12)"""
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.concat(F.lit("T/"), F.coalesce(names[kind], F.lit(LABELS["concept"])))


def _holds(words: Column | list[str], term: Column) -> Column:
    """Whether a list of words, a literal one or a column, has the term."""
    return F.array_contains(words, term) if isinstance(words, Column) else term.isin(*words) if words else F.lit(False)


def filter_terms(terms: DataFrame, domain: str | Column, roots: list[str] | Column, white: list[str] | Column = (), black: list[str] | Column = ()) -> DataFrame:
    """Rules in order: lists, words of SQL, prefixes, compounds, hyphens, acronyms, n-grams, each with its confidence.

    Adds confidence, namespace, kind, type, label, source and case_pattern. Domain and lists are those of all rows, or columns.
    """
    low, domain = F.lower("term"), F.lit(domain) if isinstance(domain, str) else domain
    kind = term_kind(F.col("term"))
    parts = F.split(low, "[- ]")
    has_root = F.arrays_overlap(parts, roots if isinstance(roots, Column) else F.array(*map(F.lit, roots)).cast("array<string>"))
    listed = _holds(white, low)
    letters = F.exists(F.split(low, "-"), lambda p: F.length(p) <= 1)
    camel = F.regexp_extract_all("term", F.lit("[A-Z][a-z]+"), 0)
    noise = (F.size(camel) >= 3) & (F.size(F.array_distinct(camel)) == 1)
    confidence = (
        F.when(_holds(black, low), None)
        .when(F.upper("term").isin(*SQL_WORDS), None)
        .when(listed, 1.0)
        .when(kind == "pg_prefix", 0.95)
        .when(kind == "camelcase", F.when(~noise, 0.85))
        .when(kind == "hyphenated", F.when(letters, None).when(has_root, 0.75).when(domain == "general", 0.6))
        .when(kind == "acronym", F.when(F.col("score") > 2, 0.7))
        .otherwise(F.when((F.col("score") > 3) & has_root, 0.6))
    )
    what = F.when(listed, inferred_type(F.col("term"))).when(kind == "pg_prefix", "tool").when(kind == "camelcase", "component").when(kind == "acronym", "entity").otherwise("concept")
    source = F.when(listed, "whitelist").when(kind.isin("pg_prefix", "camelcase"), "regex").otherwise("statistical")
    kept = terms.withColumn("confidence", confidence.cast("double")).where(F.col("confidence").isNotNull())
    kept = kept.withColumn("namespace", F.concat_ws(".", domain, low)).withColumn("kind", kind)
    return kept.withColumn("type", what).withColumn("label", type_label(what)).withColumn("source", source).withColumn("case_pattern", case_pattern(F.col("term")))


def term_cooccurrence(terms: DataFrame, least: int = 3, weight: float = 0.1) -> DataFrame:
    """Pairs of terms in ``least`` documents or more, by the rarer one's documents."""
    own = terms.select("doc_id", "term").distinct()
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.term") < F.col("b.term")))
    counts = pairs.groupBy(F.col("a.term").alias("in"), F.col("b.term").alias("out")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    f = own.groupBy("term").agg(F.count(F.lit(1)).alias("f"))
    both = counts.join(f.select(F.col("term").alias("in"), F.col("f").alias("fi")), "in").join(f.select(F.col("term").alias("out"), F.col("f").alias("fo")), "out")
    scored = both.select("in", "out", "n", (F.col("n") / F.least("fi", "fo")).alias("weight"))
    return scored.where(F.col("weight") >= weight)
