"""Import of documents' terms as one job: blocks are read once, and terms, relations and counts come from what that stored.

A block is a text of a document. Its domain, its terms' scores and the best of them are found in one
Arrow stage; the filter's rules and the cache are columns and a join. The rows are materialised, and
every output is an aggregate of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import graph as G, terms as X
from .checkpoints import cut, spread

#: Terms of a block that are judged, and kept; what a term must have to become a seed.
BEST, LEAST_FREQ, SEED_CONFIDENCE, SEED_FREQ = 200, 2, 0.95, 50
#: What is known of a domain; lists that are missing are empty.
GENERAL = "general"

Settings = dict[str, dict]

#: The domains of ``terms.CORE``, whose core terms are also keywords and sure terms.
SETTINGS: Settings = {d: {"keywords": w, "core": w, "whitelist": w} for d, w in X.CORE.items()}


def load_settings(path: str) -> Settings:
    """Domains from a JSON file: name to keywords, core, whitelist, blacklist, roots and weights; their order decides ties."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Domains:
    """Finds all keywords of all domains in one pass over a text."""

    def __init__(self, settings: Settings):
        self.names, points = [d for d in settings if d != GENERAL], {}
        for place, d in enumerate(self.names):
            core = set(settings[d].get("core", ()))
            for w in sorted(set(settings[d].get("keywords", ())) | core):
                points.setdefault(w.lower(), []).append((place, (w in settings[d].get("keywords", ())) + 2 * (w in core)))
        self.automaton = ahocorasick.Automaton()
        for w, p in points.items():
            if w:
                self.automaton.add_word(w, (w, p))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scores(self, text: str) -> list[tuple[str, int]]:
        """Domains and their points, the best first: one for each keyword that the text contains, two more for a core one."""
        found = {w: p for _, (w, p) in self.automaton.iter(text.lower())} if len(self.automaton) else {}
        total = [0] * len(self.names)
        for points in found.values():
            for place, n in points:
                total[place] += n
        return sorted(zip(self.names, total), key=lambda s: -s[1])

    def detect(self, text: str, least: float = 0.3, most: int = 3) -> tuple[str, float, list[str]]:
        """The domain and its confidence, and the domains whose lists hold: of a general text those with points, three at most."""
        scores = self.scores(text)
        first, second = (scores[0][1] if scores else 0), (scores[1][1] if len(scores) > 1 else 0)
        confidence = (first - second) / (first + 1)
        if first > 0 and confidence >= least:
            return scores[0][0], confidence, [scores[0][0]]
        return GENERAL, confidence, [GENERAL, *[d for d, n in scores if n > 0][:most]]


def candidates(blocks: DataFrame, settings: Settings, best: int = BEST, least_freq: int = LEAST_FREQ) -> DataFrame:
    """For each row (doc, block, text) one with a null term, that tells its domain or its error, and one for each candidate term."""
    kinds = [blocks.schema[c].dataType.simpleString() for c in ("doc", "block")]
    schema = f"doc {kinds[0]}, block {kinds[1]}, domain string, confidence double, domains array<string>, term string, freq long, len int, score double, error string"
    names = ["doc", "block", "domain", "confidence", "domains", "term", "freq", "len", "score", "error"]

    def of(text: str | None, domains: Domains) -> list[tuple]:
        if not text:
            return [(GENERAL, 0.0, [GENERAL], None, None, None, None, "no text")]
        domain, confidence, lists = domains.detect(text)
        weights = {**X.WEIGHTS, **settings.get(domain, {}).get("weights", {})}
        kept = X.best_terms(X.grams(text), weights=weights, least_freq=least_freq, shortest=3, longest=50, best=best)
        return [(domain, confidence, lists, None, None, None, None, None)] + [(domain, confidence, lists, m[0], m[1], m[2], m[5], None) for m in kept]

    def run(batches):
        domains = Domains(settings)
        types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.string()]
        for batch in batches:
            take, rows = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                try:
                    found = of(text, domains)
                except Exception as e:  # a block that can't be read is a row that says so, and the others go on
                    found = [(GENERAL, 0.0, [GENERAL], None, None, None, None, f"{type(e).__name__}: {e}")]
                take += [k] * len(found)
                rows += found
            took = pa.array(take, pa.int64())
            columns = zip(*rows) if rows else ((),) * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    return spread(blocks.select("doc", "block", "text")).mapInArrow(run, schema)


def judged(found: DataFrame, settings: Settings, cache: DataFrame | None = None) -> DataFrame:
    """The candidates that the rules keep, as terms of their block's domain; what the cache knows of a statistical one replaces it.

    ``cache`` is that of ``operators.cache``, whose size is bounded.
    """

    def lists(name):
        held = [(d, s[name]) for d, s in settings.items() if s.get(name)]
        if not held:
            return F.array().cast("array<string>")
        table = F.create_map(*[x for d, words in held for x in (F.lit(d), F.array(*[F.lit(w.lower()) for w in words]))])
        return F.flatten(F.transform("domains", lambda d: F.coalesce(F.try_element_at(table, d), F.array().cast("array<string>"))))

    rows = found.where("term IS NOT NULL").withColumns({n: lists(n) for n in ("whitelist", "blacklist", "roots")})
    kept = X.filter_terms(rows.drop("confidence"), F.col("domain"), F.col("roots"), F.col("whitelist"), F.col("blacklist"))
    kept = kept.withColumn("normalized", F.lower("term")).drop("domains", "whitelist", "blacklist", "roots")
    if cache is None:
        return kept
    known = F.broadcast(cache.select("domain", "normalized", *[F.col(c).alias(f"c_{c}") for c in ("term", "type", "label", "confidence")]))
    joined = kept.join(known, ["domain", "normalized"], "left")
    hit = (F.col("source") == "statistical") & F.col("c_term").isNotNull()
    put = {c: F.when(hit, F.col(f"c_{c}")).otherwise(F.col(c)) for c in ("term", "type", "label", "confidence")}
    put |= {"freq": F.when(hit, F.lit(0).cast("long")).otherwise(F.col("freq")), "score": F.when(hit, F.col("c_confidence") * 10).otherwise(F.col("score")), "source": F.when(hit, "whitelist").otherwise(F.col("source"))}
    return joined.withColumns(put).select(*kept.columns)


class Imported:
    """What an import found, over its materialised ``rows``: those with a term, and one without for each block."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.terms = rows.where("term IS NOT NULL")
        self.blocks = rows.where("term IS NULL")

    def errors(self) -> DataFrame:
        """doc, block and error of the blocks that failed."""
        return self.blocks.where("error IS NOT NULL").select("doc", "block", "error")

    def stored(self) -> DataFrame:
        """One row a term of a domain: name, type, label, frequency, confidence, documents and blocks that hold it; and the targets of rules, which no block names."""
        one = self.terms.groupBy("namespace").agg(
            F.first("normalized").alias("normalized"), F.first("domain").alias("domain"), F.min("term").alias("name"), F.max_by("type", F.struct("confidence", "type")).alias("type"),
            F.max_by("label", F.struct("confidence", "type")).alias("label"), F.sum("freq").alias("frequency"), F.max("confidence").alias("confidence"),
            F.count_distinct("doc").alias("documents"), F.count(F.lit(1)).alias("blocks"),
        )
        rules = G.structural_relations(one.select(F.col("namespace").alias("id"), "normalized")).select(F.concat(F.lit(f"{GENERAL}."), "target").alias("namespace"), F.col("target").alias("normalized"), "confidence").distinct()
        made = rules.join(one.select("namespace"), "namespace", "left_anti").select(
            "namespace", "normalized", F.lit(GENERAL).alias("domain"), F.col("normalized").alias("name"), F.lit("concept").alias("type"), F.lit(X.LABELS["concept"]).alias("label"),
            F.lit(0).cast("long").alias("frequency"), "confidence", F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("blocks"),
        )
        return one.unionByName(made)

    def vectors(self, encoder: Callable, known: DataFrame | None = None) -> DataFrame:
        """Vectors of the terms, by ``encoder``; those that ``known`` (id, embedding) has are not asked for again."""
        from ..sources.models import embed

        own = self.terms.select(F.col("namespace").alias("id"), "normalized").distinct()
        new = own if known is None else own.join(known.select("id"), "id", "left_anti")
        made = embed(new, "id", "normalized", encoder)
        return made if known is None else made.unionByName(known.join(own.select("id"), "id", "left_semi").select("id", "embedding"))

    def relations(self, vectors: DataFrame | None = None, least: int = 3, weight: float = 0.1) -> DataFrame:
        """in, out, type, weight, confidence and method of all relations: terms of one block, names that follow rules, and alike vectors if these are given."""
        both = X.term_cooccurrence(self.terms.select(F.struct("doc", "block").alias("doc_id"), F.col("namespace").alias("term")), least, weight)
        found = both.select("in", "out", F.lit("co_occurs").alias("type"), F.least("weight", F.lit(1.0)).alias("weight"), F.lit(0.5).alias("confidence"), F.lit("co_occurrence").alias("method"))
        rules = G.structural_relations(self.terms.select(F.col("namespace").alias("id"), "normalized").distinct())
        found = found.unionByName(rules.select(F.col("id").alias("in"), F.concat(F.lit(f"{GENERAL}."), "target").alias("out"), "type", "weight", "confidence", "method"))
        if vectors is not None:
            found = found.unionByName(G.semantic_pairs(vectors).select("in", "out", "type", "weight", F.lit(0.75).alias("confidence"), F.lit("embedding").alias("method")))
        return found

    def counts(self) -> DataFrame:
        """doc with total_blocks, processed_blocks, total_terms, unique_terms and promoted: different terms sure and frequent enough for a seed, of a domain."""
        n = F.count(F.lit(1))
        blocks = self.blocks.groupBy("doc").agg(n.alias("total_blocks"), F.count(F.when(F.col("error").isNull(), 1)).alias("processed_blocks"))
        unique = self.terms.groupBy("doc", "namespace").agg(F.first("domain").alias("domain"), F.max("confidence").alias("confidence"), F.sum("freq").alias("freq"), n.alias("n"))
        due = (F.col("confidence") >= SEED_CONFIDENCE) & (F.col("freq") >= SEED_FREQ) & (F.col("domain") != GENERAL)
        own = unique.groupBy(F.col("doc").alias("d")).agg(F.sum("n").alias("total_terms"), n.alias("unique_terms"), F.count(F.when(due, 1)).alias("promoted"))
        joined = blocks.join(own, F.col("doc").eqNullSafe(F.col("d")), "left")
        return joined.select("doc", "total_blocks", "processed_blocks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_terms", "unique_terms", "promoted")])

    def by_domain(self) -> DataFrame:
        """Terms of each document by domain."""
        return self.terms.groupBy("doc", "domain").agg(F.count(F.lit(1)).alias("terms"))


def import_terms(blocks: DataFrame, settings: Settings = SETTINGS, cache: DataFrame | None = None, best: int = BEST, least_freq: int = LEAST_FREQ) -> Imported:
    """Terms of all blocks (doc, block, text), found and stored once.

    A text that is null or empty, or can't be read, is a failed block. Equal blocks are each counted; an empty table gives nothing.
    """
    found = cut(candidates(blocks, settings, best, least_freq))
    terms = judged(found, settings, cache).withColumn("error", F.lit(None).cast("string"))
    columns = ["doc", "block", "domain", "term", "normalized", "namespace", "type", "label", "source", "kind", "freq", "score", "confidence", "error"]
    none = {c: F.lit(None).cast(terms.schema[c].dataType) for c in columns if c not in found.columns}
    blocks_ = found.where("term IS NULL").withColumns(none)
    return Imported(cut(terms.select(*columns).unionByName(blocks_.select(*columns))))
