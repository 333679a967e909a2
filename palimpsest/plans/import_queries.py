"""Queries of the import of terms, similarity joins, components, co-occurrence by batches, BM25 and retrieval over two steps, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import components as K, graph as G, ranking as T, search as R, similar, store as M, term_import as I, terms as X
from ..operators.checkpoints import cut
from .queries import DOMAIN, EDGES, PAIRS, Q, SCORED, SIM, TONGUES, cooccurring, edges, first_vector, query, read, vectors

# Words of the driver's texts that stand in for the lists of a domain.
LISTS = {
    "english": {"whitelist": ["the", "and", "with", "that"], "blacklist": ["was"], "roots": ["anea", "erin", "thing", "ndnd", "onre"]},
    "german": {"whitelist": ["und"], "roots": ["der", "nicht", "sch"]},
    "french": {"whitelist": ["que", "une"], "roots": ["elle", "les", "des", "ment"]},
    "spanish": {"blacklist": ["que"], "roots": ["mente", "los"]},
}
SETTINGS = {d: {"keywords": w, **LISTS[d]} for d, w in TONGUES.items()}


def _imported(spark, d):
    return I.import_terms(read(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("block"), "text"), SETTINGS)


def _list(name):
    rows = " ".join(f"WHEN '{d}' THEN {s.get(name, [])}::VARCHAR[]" for d, s in SETTINGS.items())
    return f"flatten(list_transform(lists, lambda d: CASE d {rows} ELSE []::VARCHAR[] END))"


_SQL_WORDS = ", ".join(f"'{w}'" for w in X.SQL_WORDS)
JUDGED = f"""{SCORED}, {DOMAIN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k FROM points),
tops AS (SELECT doc_id, max(CASE WHEN k = 1 THEN domain END) AS d, max(CASE WHEN k = 1 THEN score END) AS a, max(CASE WHEN k = 2 THEN score END) AS b,
  list_slice(coalesce(list(domain ORDER BY score DESC, place) FILTER (WHERE score > 0), []), 1, 3) AS held FROM ranked GROUP BY 1),
doms AS (SELECT doc_id, CASE WHEN a > 0 AND (a - b) / (a + 1)::DOUBLE >= 0.3 THEN d ELSE 'general' END AS domain, CASE WHEN a > 0 AND (a - b) / (a + 1)::DOUBLE >= 0.3 THEN [d] ELSE held END AS lists FROM tops),
measured AS (SELECT *, greatest(0, tfidf + cvalue + 0.5 * log2(1 + freq) + 0.5 * len / 3) AS score FROM scored WHERE freq >= 2 AND length(term) BETWEEN 3 AND 50),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS k FROM measured),
looks AS (SELECT p.*, m.domain, lower(term) AS low, {_list('whitelist')} AS white, {_list('blacklist')} AS black, {_list('roots')} AS roots,
  CASE WHEN regexp_matches(term, '(?i)^pg_') THEN 'pg_prefix' WHEN contains(term, '-') THEN 'hyphenated' WHEN regexp_matches(term, '[A-Z][a-z]+[A-Z]') THEN 'camelcase' WHEN upper(term) = term AND length(term) <= 8 THEN 'acronym' ELSE 'word' END AS kind
  FROM placed p JOIN doms m USING (doc_id) WHERE k <= 200),
sure AS (SELECT *, list_contains(white, low) AS listed, list_has_any(string_split_regex(low, '[- ]'), roots) AS rooted FROM looks),
told AS (SELECT *, (CASE WHEN list_contains(black, low) OR upper(term) IN ({_SQL_WORDS}) THEN NULL WHEN listed THEN 1.0 WHEN kind = 'pg_prefix' THEN 0.95 WHEN kind = 'camelcase' THEN 0.85
  WHEN kind = 'hyphenated' THEN CASE WHEN regexp_matches(low, '(^|-).?(-|$)') THEN NULL WHEN rooted THEN 0.75 WHEN domain = 'general' THEN 0.6 END
  WHEN kind = 'acronym' THEN CASE WHEN score > 2 THEN 0.7 END WHEN score > 3 AND rooted THEN 0.6 END)::DOUBLE AS confidence,
  CASE WHEN listed THEN CASE WHEN contains(low, '_') AND NOT starts_with(low, 'pg_') THEN 'parameter' WHEN starts_with(low, 'pg_') AND length(low) <= 20 THEN 'tool' WHEN contains(low, '-') AND contains(low, 'join') OR contains(low, 'tree') THEN 'algorithm' WHEN starts_with(low, 'lib') THEN 'protocol' ELSE 'concept' END
    WHEN kind = 'pg_prefix' THEN 'tool' WHEN kind = 'camelcase' THEN 'component' WHEN kind = 'acronym' THEN 'entity' ELSE 'concept' END AS type FROM sure),
kept AS (SELECT t.*, d.source, domain || '.' || low AS namespace FROM told t JOIN documents d USING (doc_id) WHERE confidence IS NOT NULL)"""


@query(f"""WITH {JUDGED} SELECT namespace, min(term) AS name, max_by(type, (confidence, type)) AS type, sum(freq)::BIGINT AS frequency, max(confidence) AS confidence, count(DISTINCT source) AS documents, count(*) AS blocks FROM kept GROUP BY 1""")
def term_import(spark, d):
    return _imported(spark, d).stored().select("namespace", "name", "type", "frequency", "confidence", "documents", "blocks")


@query(f"""WITH {JUDGED}, own AS (SELECT DISTINCT doc_id, namespace FROM kept), f AS (SELECT namespace, count(*) AS f FROM own GROUP BY 1),
p AS (SELECT a.namespace AS "in", b.namespace AS "out", count(*) AS n FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.namespace < b.namespace GROUP BY ALL HAVING count(*) >= 3)
SELECT "in", "out", 'co_occurs' AS type, round(n / least(x.f, y.f), 6) AS weight FROM p JOIN f x ON x.namespace = "in" JOIN f y ON y.namespace = "out" WHERE n / least(x.f, y.f) >= 0.1""")
def term_import_relations(spark, d):
    return _imported(spark, d).relations().select("in", "out", "type", F.round("weight", 6).alias("weight"))


@query(f"""WITH {JUDGED}, u AS (SELECT source, namespace, domain, max(confidence) AS c, sum(freq) AS f, count(*) AS n FROM kept GROUP BY ALL),
own AS (SELECT source, sum(n)::BIGINT AS total_terms, count(*) AS unique_terms, count(*) FILTER (WHERE c >= 0.95 AND f >= 50 AND domain <> 'general') AS promoted FROM u GROUP BY 1)
SELECT d.source AS doc, count(*) AS total_blocks, count(*) FILTER (WHERE text <> '') AS processed_blocks, coalesce(any_value(total_terms), 0) AS total_terms, coalesce(any_value(unique_terms), 0) AS unique_terms, coalesce(any_value(promoted), 0) AS promoted
FROM documents d LEFT JOIN own ON own.source IS NOT DISTINCT FROM d.source GROUP BY 1""")
def term_import_counts(spark, d):
    return _imported(spark, d).counts()


# Each vector stands twice: as it is, and with a little added that depends on the place, as a near copy of another id.
def _copied(spark, d):
    v = vectors(spark, d)
    moved = F.transform("embedding", lambda x, i: x + ((i * 7 + F.col("id")) % 5 - 2) * 0.01)
    return v.select("id", "embedding").union(v.select((F.col("id") + 1_000_000).alias("id"), moved.cast("array<float>").alias("embedding")))


COPIED = """copied AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x, i: (x::DOUBLE + (((i - 1) * 7 + vec_id) % 5 - 2) * 0.01::DOUBLE)::FLOAT)::DOUBLE[] FROM embeddings)"""


@query(f"WITH {COPIED}, p AS (SELECT b.id, a.id AS other, list_cosine_similarity(a.v, b.v) AS s FROM copied a JOIN copied b ON a.id < b.id) SELECT id, max_by(other, (s, -other)) AS other, round(max(s), 6) AS similarity FROM p WHERE s >= 0.95 GROUP BY 1")
def near_dup_copies(spark, d):
    return M.near_duplicates(_copied(spark, d), 0.95, None).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {COPIED} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM copied a JOIN copied b ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.6")
def similar_pairs(spark, d):
    return similar.pairs(_copied(spark, d), 0.6).withColumn("similarity", F.round("similarity", 6))


# Links come in three batches, so that a memory's later links meet its earlier ones; some pairs have a type that was refined by hand.
@query("""WITH e AS (SELECT DISTINCT l_orderkey AS memory, l_partkey % 200 AS entity FROM lineitem), m AS (SELECT entity, count(*) AS m FROM e GROUP BY 1),
p AS (SELECT a.entity AS "in", b.entity AS "out", count(*) AS n FROM e a JOIN e b ON a.memory = b.memory AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= 3)
SELECT "in", "out", n, round(n / sqrt(x.m * y.m), 6) AS weight, CASE WHEN ("in" + "out") % 5 = 0 THEN 'supplies' ELSE 'co_occurs' END AS type FROM p JOIN m x ON x.entity = "in" JOIN m y ON y.entity = "out" """)
def cooccurrence_merge(spark, d):
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("memory"), (F.col("l_partkey") % 200).alias("entity"), F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(3)).alias("batch"))
    links = lines.select("memory", "entity").limit(0)
    counts, held = spark.createDataFrame([], "`in` long, `out` long, n long"), spark.createDataFrame([], "entity long, m long")
    for batch in range(3):
        pairs, fresh = G.added_pairs(links, lines.where(F.col("batch") == batch).select("memory", "entity"))
        counts, held = cut(G.merged_counts(counts, pairs, "in", "out")), cut(G.merged_counts(held, fresh, "entity"))
        links = cut(links.unionByName(fresh))
    refined = counts.where((F.col("in") + F.col("out")) % 5 == 0).select("in", "out", F.lit("supplies").alias("type"))
    return G.weighted(counts, held, 3, refined).withColumn("weight", F.round("weight", 6))


@query(f"""WITH RECURSIVE p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4),
e AS (SELECT u, v FROM p UNION SELECT v, u FROM p), reach AS (SELECT u AS node, u AS r FROM e UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.node),
roots AS (SELECT vec_id AS id, label + 1 AS frequency, 't' || vec_id AS name, coalesce(m, vec_id) AS root FROM embeddings LEFT JOIN (SELECT node, min(r) AS m FROM reach GROUP BY 1) ON node = vec_id),
classes AS (SELECT root, arg_min(id, (-frequency, id)) AS primary_id, sum(frequency)::BIGINT AS total, list(name ORDER BY name) AS names FROM roots GROUP BY 1)
SELECT id, primary_id, id = primary_id AS is_primary, CASE WHEN id = primary_id THEN total ELSE frequency END AS frequency, CASE WHEN id = primary_id THEN array_to_string(list_filter(names, lambda x: x <> name), ' ') ELSE '' END AS aliases FROM roots JOIN classes USING (root)""")
def synonym_classes(spark, d):
    v = vectors(spark, d)
    # Links of classes are enough, and theirs are above 0.4, as they connect pairs of the next larger number or more.
    relations = similar.links(v, math.nextafter(0.4, 1)).select(F.col("a").alias("in"), F.col("b").alias("out"), F.lit("synonym").alias("type"), F.lit(1.0).alias("weight"))
    terms = v.select("id", F.concat(F.lit("t"), "id").alias("name"), (F.col("type") + 1).cast("long").alias("frequency"))
    return K.synonym_classes(relations, terms, 0.4).select("id", "primary_id", "is_primary", "frequency", F.array_join("aliases", " ").alias("aliases"))


@query(f"""WITH RECURSIVE {COPIED}, e AS (SELECT a.id AS u, b.id AS v FROM copied a JOIN copied b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.45),
reach AS (SELECT u AS node, u AS r FROM e UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.node) SELECT min(r) AS cluster, node AS memory FROM reach GROUP BY node""")
def similar_clusters(spark, d):
    return K.similar_clusters(_copied(spark, d), 0.45)


ASKED = "the thing of anea nothere the"
RANKED = f"""w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents), sizes AS (SELECT id, count(*) AS size FROM w GROUP BY 1),
total AS (SELECT count(*) AS docs, avg(size)::DOUBLE AS mean FROM sizes), n AS (SELECT id, word, count(*) AS n FROM w WHERE word IN ({", ".join(f"'{x}'" for x in sorted(set(ASKED.split())))}) GROUP BY ALL),
d AS (SELECT word, count(*) AS d FROM n GROUP BY 1),
ranked AS (SELECT id, sum(ln(1 + (docs - d + 0.5) / (d + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean)))::DOUBLE AS score FROM n JOIN d USING (word) JOIN sizes USING (id), total GROUP BY 1)"""


@query(f"WITH {RANKED} SELECT id, round(score, 6) AS score FROM ranked ORDER BY round(score, 9) DESC, id LIMIT 20")
def bm25_topk(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return T.bm25(docs, ASKED, 20).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {RANKED} SELECT id, round(score, 6) AS score FROM ranked ORDER BY round(score, 9) DESC, id LIMIT 20")
def bm25_postings(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return T.bm25(docs, ASKED, 20, T.postings(docs)).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {RANKED}, q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id AS id, {SIM} AS similarity FROM embeddings e, q),
said AS (SELECT id, score AS bm25 FROM ranked ORDER BY round(score, 9) DESC, id LIMIT 100), near AS (SELECT * FROM s ORDER BY similarity DESC, id LIMIT 100),
found AS (SELECT id, coalesce(bm25, 0) AS bm25 FROM said FULL JOIN near USING (id)), told AS (SELECT id, 0.5::DOUBLE * coalesce(similarity, 0) + 0.5::DOUBLE * bm25 / (SELECT max(bm25) FROM found) AS score FROM found LEFT JOIN s USING (id))
SELECT id, round(score, 6) AS score FROM told ORDER BY score DESC, id LIMIT 10""")
def hybrid_bm25(spark, d):
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    memories = texts.join(vectors(spark, d).select("id", "embedding"), "id", "left")
    return T.hybrid_bm25(memories, ASKED, first_vector(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {EDGES}, {PAIRS.format(least=1)}, {Q}, v AS (SELECT vec_id AS id, {SIM} AS v FROM embeddings e, q ORDER BY v DESC, id LIMIT 20),
gr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, memory) AS gk FROM edges WHERE entity IN (3, 5, 7)), g0 AS (SELECT memory AS id, max(weight) AS g FROM gr WHERE gk <= 20 GROUP BY 1),
seeds AS (SELECT memory AS seed FROM edges WHERE entity = 3 ORDER BY weight DESC, memory LIMIT 3), mine AS (SELECT DISTINCT seed, entity AS i FROM edges JOIN seeds ON memory = seed),
reach AS (SELECT DISTINCT seed, "out" AS entity FROM rel JOIN mine ON i = "in" WHERE weight >= 0.1), met AS (SELECT seed, memory, max(weight) AS weight FROM edges JOIN reach USING (entity) WHERE memory <> seed GROUP BY ALL),
sp AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, memory) AS k FROM met), g AS (SELECT * FROM g0 UNION ALL SELECT memory, max(weight) FROM sp WHERE k <= 20 AND memory NOT IN (SELECT id FROM g0) GROUP BY 1),
mg AS (SELECT id, greatest(v, g) AS score FROM v FULL JOIN g USING (id) ORDER BY score DESC, id LIMIT 30),
h AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w) > 3)) AS w, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM mg JOIN documents ON doc_id = id),
p AS (SELECT b.id, b.r, count(a.id) FILTER (WHERE len(list_intersect(a.w, b.w)) > 0.5 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))) AS alike FROM h b LEFT JOIN h a ON a.r < b.r AND a.r < 5 GROUP BY ALL),
s AS (SELECT id, r AS rank, greatest(0, 1 - 0.05 * r - 0.15 * alike) AS score FROM p) SELECT id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM s WHERE score >= 0.6 ORDER BY score DESC, rank LIMIT 5""")
def multi_degree_retrieve(spark, d):
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    found = R.retrieve_multi_degree(vectors(spark, d), edges(spark, d), cooccurring(spark, d), texts, first_vector(spark, d), [3, 5, 7])
    return found.withColumn("score", F.round("score", 6))


def _longest_first(prompts):
    """A model that orders the numbered lines of a prompt by their length, the first of equals first."""
    rows = [[line for line in p.split("\n") if line.startswith("[")] for p in prompts]
    return [" ".join(str(k) for k in sorted(range(len(r)), key=lambda k: (-len(r[k].split("] ", 1)[1]), k))) for r in rows]


@query(r"""WITH h AS (SELECT doc_id AS id, n_chars, least(length(regexp_extract(text, '^[^\n]*', 0)), 200) AS size, list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]+'), lambda w: length(w) > 3)) AS w FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30),
o AS (SELECT *, row_number() OVER (ORDER BY size DESC, n_chars DESC, id) - 1 AS r FROM h),
p AS (SELECT b.id, b.r, count(a.id) FILTER (WHERE len(list_intersect(a.w, b.w)) > 0.5 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))) AS alike FROM o b LEFT JOIN o a ON a.r < b.r AND a.r < 5 GROUP BY ALL)
SELECT id, round(greatest(0, 1 - 0.05 * r - 0.15 * alike), 6) AS score, CAST(r AS INTEGER) AS rank FROM p""")
def model_rerank(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("score"), F.lit(None).cast("string").alias("cluster"))
    return R.rerank(docs, order=R.said_order(docs, "the longest first line", _longest_first)).select("id", F.round("score", 6).alias("score"), "rank")
