"""Queries of indexing, caches, duplicates on store, two-step retrieval, documents' structure and state, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S, texts as T
from ..operators import cache as C, documents as D, indexing as I, search as R, store as M, terms as X
from ..streaming import messages as stream
from .queries import EDGES, NOW, PAIRS, SCORED, cooccurring, edges, query, read, topic_tables, vectors

COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""WITH p AS (SELECT b.vec_id AS id, a.vec_id AS other, {COSINE} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COSINE} >= 0.3)
SELECT id, max_by(other, (s, -other)) AS other, round(max(s), 6) AS similarity FROM p GROUP BY 1""")
def near_dup_in_session(spark, d):
    rows = vectors(spark, d).withColumnRenamed("type", "session_id")
    return M.near_duplicates(rows, 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT DISTINCT a.vec_id AS id FROM embeddings a, embeddings b WHERE a.vec_id % 3 = 0 AND b.vec_id % 3 > 0 AND {COSINE} >= 0.35")
def near_dup_stored(spark, d):
    v = vectors(spark, d)
    return M.known_before(v.where("id % 3 = 0"), v.where("id % 3 > 0"), 0.35)


@query("SELECT event_id, user_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 24 HOURS) AS n FROM events a")
def mentions_24h(spark, d):
    return I.recent_mentions(read(spark, d, "events"), "user_id").select("event_id", "user_id", "n")


@query("SELECT c_custkey AS id, coalesce((SELECT min(n_nationkey) FROM nation WHERE n_name = CASE WHEN c_custkey % 4 = 0 THEN 'nobody' ELSE x.name END), 0)::BIGINT AS entity FROM customer JOIN (SELECT n_nationkey AS k, n_name AS name FROM nation) x ON x.k = c_nationkey")
def entity_by_name(spark, d):
    nation = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    asked = read(spark, d, "customer").join(nation.select(F.col("id").alias("c_nationkey"), F.col("name").alias("own")), "c_nationkey")
    asked = asked.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "nobody").otherwise(F.col("own")).alias("name"))
    return I.entity_ids(asked, nation).select(F.col("c_custkey").alias("id"), "entity")


FREQ = """recent AS (SELECT lower('Part' || l_partkey) AS name, count(*) AS recent FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
held AS (SELECT 'part' || p_partkey AS name, p_size % 5 AS stored FROM part),
freq AS (SELECT name, greatest(coalesce(recent, 0), coalesce(stored, 0))::BIGINT AS frequency FROM recent FULL JOIN held USING (name))"""


def _entities(spark, d):
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("Part"), F.col("p_partkey")).alias("name"), (F.col("p_size") % 5).cast("long").alias("mention_count"),
        (F.col("p_partkey") % 10 == 0).alias("is_frozen"), F.when(F.col("p_partkey") % 10 == 0, "old").alias("freeze_reason"),
        F.lit(None).cast("timestamp").alias("frozen_at"), (F.col("p_size") * 12).alias("relation_count"),
    )


def _named(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("memory"), F.concat(F.lit("Part"), F.col("l_partkey")).alias("name"), F.col("l_discount").alias("confidence"), "l_linenumber")


@query(f"WITH {FREQ} SELECT name, frequency FROM freq")
def entity_frequency(spark, d):
    return I.frequencies(_named(spark, d).where("l_linenumber = 1").select("name"), _entities(spark, d))


@query(f"""WITH {FREQ}, closed AS (SELECT 'part' || p_partkey AS name FROM part WHERE p_partkey % 10 = 0 OR p_size * 12 >= 500)
SELECT l_orderkey AS memory, 'Part' || l_partkey AS name, max(l_discount) AS weight FROM lineitem LEFT JOIN freq ON freq.name = 'part' || l_partkey
WHERE (coalesce(frequency, 0) = 0 OR frequency >= 3) AND 'part' || l_partkey NOT IN (SELECT name FROM closed) GROUP BY ALL""")
def frequency_gate(spark, d):
    frequency = I.frequencies(_named(spark, d).where("l_linenumber = 1").select("name"), _entities(spark, d))
    return I.indexable(_named(spark, d), frequency, _entities(spark, d))


@query(f"WITH {EDGES}, due AS (SELECT entity FROM edges GROUP BY 1 HAVING count(*) >= 35) SELECT p_partkey AS id, p_partkey % 10 = 0 OR p_partkey IN (SELECT entity FROM due) AS is_frozen, CASE WHEN p_partkey % 10 = 0 THEN 'old' WHEN p_partkey IN (SELECT entity FROM due) THEN 'links' END AS freeze_reason FROM part")
def freeze_entities(spark, d):
    due = edges(spark, d).groupBy(F.col("entity").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 35")
    return I.freeze(_entities(spark, d), due, "links", F.expr(NOW)).select("id", "is_frozen", "freeze_reason")


@query("""WITH p AS (SELECT event_id, least(1, greatest(0, (user_id % 300 - 100) / 100.0, (value / 1000 - 0.8) / 0.2, (event_id % 100 / 100.0 - 0.7) / 0.3)) AS p FROM events)
SELECT event_id, round(5000 + 55000 * p, 3)::DOUBLE AS ms FROM p""")
def backpressure(spark, d):
    ms = I.interval(F.col("user_id") % 300, F.col("value") / 1000, (F.col("event_id") % 100) / 100.0)
    return read(spark, d, "events").select("event_id", F.round(ms, 3).alias("ms"))


@query("SELECT o_orderkey AS entity, o_orderpriority AS priority FROM orders ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 7")
def next_tasks(spark, d):
    tasks = read(spark, d, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("added_at"))
    return I.next_tasks(tasks, 7).select("entity", "priority")


def _relations(spark, d):
    first = read(spark, d, "lineitem").where("l_linenumber = 1")
    return first.select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("in"), F.col("l_suppkey").alias("out"), F.when(F.col("l_orderkey") % 2 == 0, "co_occurs").otherwise("causes").alias("relation_type"),
        (F.col("l_orderkey") % 3 == 0).alias("is_manual_refined"), F.col("l_shipdate").alias("created_at"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("reasoning"),
        F.lit(None).cast("string").alias("source"), F.array(F.col("l_orderkey")).alias("evidence_memory_ids"),
    ).dropDuplicates(["in", "out"])


RELS = """firsts AS (SELECT l_partkey AS "in", l_suppkey AS "out", count(*) AS held, min(l_orderkey) AS id, min(l_shipdate) AS created_at FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL HAVING count(*) = 1),
rels AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'co_occurs' ELSE 'causes' END AS relation_type, id % 3 = 0 AS is_manual_refined FROM firsts)"""


def _lone_relations(spark, d):
    rows = read(spark, d, "lineitem").where("l_linenumber = 1").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("held")).where("held = 1").select(F.col("l_partkey").alias("in"), F.col("l_suppkey").alias("out"))
    return _relations(spark, d).join(rows, ["in", "out"])


@query(f"""WITH {RELS} SELECT "in", "out", relation_type FROM rels WHERE relation_type = 'co_occurs' OR NOT is_manual_refined ORDER BY created_at, "in", "out" LIMIT 100""")
def unlabelled_relations(spark, d):
    return I.unlabelled(_lone_relations(spark, d)).select("in", "out", "relation_type")


def _labeller(prompts: list[str]) -> list[str]:
    """A plain function in the place of a model: 'used_for'; turned round where the first name ends in 1, by source where it ends in 2."""
    out = []
    for p in prompts:
        _, a, b, *_ = p.split("\n")
        source = f', "source": "{b.upper()}"' if a.endswith("2") else ""
        out.append(f'{{"relation_type": "used_for", "confidence": 0.8, "reverse_direction": {str(a.endswith("1")).lower()}{source}}}')
    return out


@query(f"""WITH {RELS}, due AS (SELECT "in", "out" FROM rels WHERE relation_type = 'co_occurs' OR NOT is_manual_refined ORDER BY created_at, "in", "out" LIMIT 100),
t AS (SELECT r.*, due."in" IS NOT NULL AS told, due."in" IS NOT NULL AND r."in" % 10 IN (1, 2) AS turn FROM rels r LEFT JOIN due ON due."in" = r."in" AND due."out" = r."out")
SELECT CASE WHEN turn THEN "out" ELSE "in" END AS "in", CASE WHEN turn THEN "in" ELSE "out" END AS "out", CASE WHEN told THEN 'used_for' ELSE relation_type END AS relation_type,
  CASE WHEN told THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence, is_manual_refined OR told AS is_manual_refined FROM t""")
def labelled_relations(spark, d):
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("n"), F.col("p_partkey")).alias("name"))
    memories = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"), F.col("o_orderdate").alias("created_at"))
    done = I.classify_relations(_lone_relations(spark, d), parts, memories, _labeller)
    return done.select("in", "out", "relation_type", "confidence", "is_manual_refined")


@query(f"WITH {EDGES}, t AS (SELECT p_brand, min(p_size)::BIGINT AS parent FROM part GROUP BY 1) SELECT p_partkey AS entity, (SELECT count(*) FROM edges WHERE entity = p_partkey) AS links, (SELECT count(*) FROM t WHERE parent = p_partkey) AS topics FROM part")
def entity_stats(spark, d):
    return M.entity_stats(read(spark, d, "part").select(F.col("p_partkey").alias("entity")), edges(spark, d), topic_tables(spark, d)[0])


@query(f"""WITH {EDGES}, {PAIRS.format(least=1)}, seeds AS (SELECT memory AS seed FROM edges WHERE entity = 7 ORDER BY weight DESC, memory LIMIT 3),
mine AS (SELECT DISTINCT seed, entity AS i FROM edges JOIN seeds ON memory = seed),
reach AS (SELECT DISTINCT seed, "out" AS entity FROM rel JOIN mine ON i = "in" WHERE weight >= 0.1),
met AS (SELECT seed, memory, max(weight) AS weight FROM edges JOIN reach USING (entity) WHERE memory <> seed GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, memory) AS k FROM met)
SELECT memory AS id, max(weight) AS score FROM r WHERE k <= 20 GROUP BY 1""")
def two_step_memories(spark, d):
    e = edges(spark, d)
    seeds = R.top(e.where("entity = 7"), 3, F.desc("weight"), F.asc("memory")).select(F.col("memory").alias("seed"))
    return R.spread(e, cooccurring(spark, d), seeds, 20)


ASKED = "asked AS (SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'ai' ELSE 'general' END AS domain, 't' || user_id % 40 AS normalized FROM events)"
CACHED = "cached AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'ai' ELSE 'general' END AS domain, 't' || p_partkey AS normalized, 'T' || p_partkey AS term, p_size / 50.0::DOUBLE AS confidence, p_size AS size FROM part WHERE p_partkey <= 100)"


def _asked(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("CASE user_id % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'ai' ELSE 'general' END").alias("domain"), F.expr("concat('t', user_id % 40)").alias("normalized"))


def _cached(spark, d, most=100):
    return read(spark, d, "part").where(f"p_partkey <= {most}").select(
        F.expr("concat('T', p_partkey)").alias("term"), F.expr("concat('t', p_partkey)").alias("normalized"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'ai' ELSE 'general' END").alias("domain"),
        F.lit("concept").alias("type"), F.lit("T/concept").alias("label"), (F.col("p_size") / 50.0).alias("confidence"), F.expr("timestamp_seconds(p_size)").alias("created_at"), F.lit(0).cast("long").alias("hit_count"),
    )


@query(f"WITH {ASKED}, {CACHED} SELECT id, term IS NOT NULL AS hit, term, confidence FROM asked LEFT JOIN cached USING (domain, normalized)")
def term_cache_lookup(spark, d):
    return C.lookup(_cached(spark, d), _asked(spark, d)).select("id", "hit", "term", "confidence")


@query(f"WITH {ASKED}, {CACHED}, f AS (SELECT term IS NOT NULL AS hit FROM asked LEFT JOIN cached USING (domain, normalized)) SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (hit) / count(*)::DOUBLE AS rate FROM f")
def term_cache_stats(spark, d):
    return C.stats(C.lookup(_cached(spark, d), _asked(spark, d)))


@query(f"WITH {CACHED} SELECT domain, count(*) AS terms FROM cached GROUP BY 1")
def term_cache_domains(spark, d):
    return C.domain_stats(_cached(spark, d))


@query(f"WITH {ASKED}, {CACHED} SELECT term, domain || '.' || normalized AS namespace, 'whitelist' AS source, 0::BIGINT AS freq, confidence * 10 AS score FROM asked JOIN cached USING (domain, normalized)")
def cached_terms(spark, d):
    return C.extracted(_cached(spark, d), _asked(spark, d)).select("term", "namespace", "source", "freq", "score")


@query("WITH c AS (SELECT 'T' || p_partkey AS term, p_size AS s, CASE p_partkey % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'ai' ELSE 'general' END AS domain, 't' || p_partkey AS n FROM part WHERE p_partkey <= 150) SELECT term FROM c ORDER BY s DESC, domain, n LIMIT 60")
def term_cache_store(spark, d):
    return C.put(_cached(spark, d), _cached(spark, d, 150), 60).select("term")


@query(f"""WITH {CACHED}, x AS (SELECT 't' || l_partkey AS normalized, CASE l_partkey % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'ai' ELSE 'general' END AS domain, l_discount + 0.9 AS confidence, l_quantity AS freq FROM lineitem)
SELECT DISTINCT domain, normalized, 1.0::DOUBLE AS confidence FROM x WHERE confidence >= 0.95 AND freq >= 40 AND domain <> 'general' AND (domain, normalized) NOT IN (SELECT (domain, normalized) FROM cached WHERE size >= 50 AND domain <> 'general')""")
def seed_promotion(spark, d):
    terms = read(spark, d, "lineitem").select(
        F.expr("concat('T', l_partkey)").alias("term"), F.expr("concat('t', l_partkey)").alias("normalized"), F.expr("CASE l_partkey % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'ai' ELSE 'general' END").alias("domain"),
        F.lit("concept").alias("type"), F.lit("T/concept").alias("label"), (F.col("l_discount") + 0.9).alias("confidence"), F.col("l_quantity").alias("freq"),
    )
    return C.promoted(_cached(spark, d), terms, 0.95, 40).select("domain", "normalized", "confidence")


@query("SELECT p_name AS term, lower(p_name) AS normalized, 'database' AS domain, 1.0::DOUBLE AS confidence FROM part")
def seed_terms(spark, d):
    rows = read(spark, d, "part").select(F.col("p_name").alias("term"), F.lit("concept").alias("type"))
    return C.seed_terms(C.seeds(rows, "database", F.expr(NOW))).select("term", "normalized", "domain", "confidence")


@query("SELECT c_name AS alias FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING' ORDER BY c_nationkey DESC, c_name LIMIT 50")
def alias_warmup(spark, d):
    aliases = read(spark, d, "customer").select(F.col("c_name").alias("alias"), (F.col("c_acctbal") > 5000).alias("verified"), F.when(F.col("c_mktsegment") == "BUILDING", "manual").otherwise("model").alias("source"), F.col("c_nationkey").alias("created_at"))
    return C.warm_aliases(aliases, 50).select("alias")


@query("WITH u AS (SELECT user_id::VARCHAR AS alias, max(ts) AS last FROM events GROUP BY 1) SELECT alias FROM u ORDER BY last DESC, alias LIMIT 20")
def alias_evict(spark, d):
    used = read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("alias")).agg(F.max("ts").alias("last_accessed"))
    return C.evict(used, 20).select("alias")


PAPER = "concat(CASE WHEN doc_id % 3 = 0 THEN 'Table of Contents' ELSE 'x' END, chr(10), CASE WHEN doc_id % 5 = 0 THEN 'Chapter 12' ELSE 'y' END, chr(10), CASE WHEN doc_id % 2 = 0 THEN 'ab 17' ELSE 'z.' END, chr(10), chr(10), repeat(concat('a long paragraph of words that says little but goes on.', chr(10), chr(10)), (doc_id % 14)::INT))"


@query(f"""WITH p AS (SELECT doc_id, doc_id % 3 = 0 AS toc, doc_id % 5 = 0 AS chapters, doc_id % 2 = 0 OR doc_id % 5 = 0 AS pages, (doc_id % 14)::INT AS paragraphs FROM documents)
SELECT doc_id, toc, chapters, pages, paragraphs, round(CASE WHEN toc THEN 0.4 ELSE 0 END + CASE WHEN chapters THEN 0.3 ELSE 0 END + CASE WHEN pages THEN 0.1 ELSE 0 END + CASE WHEN paragraphs > 10 THEN 0.2 ELSE 0 END, 3)::DOUBLE AS score FROM p""")
def pdf_structure(spark, d):
    f = D.pdf_features(F.expr(PAPER.replace("(doc_id % 14)::INT", "int(doc_id % 14)")))
    docs = read(spark, d, "documents").select("doc_id", f.alias("f"))
    return docs.select("doc_id", "f.*", F.round(D.pdf_structure(F.col("f")), 3).alias("score"))


LETTER = "concat(repeat(concat('GENERAL TERMS', chr(10)), (doc_id % 4)::INT), repeat(concat('3. of things', chr(10)), (doc_id % 3)::INT), 'the rest in plain words', repeat(concat(chr(10), chr(10), 'one more paragraph of it'), (doc_id % 8)::INT))"


@query("""WITH p AS (SELECT doc_id, (doc_id % 4 + doc_id % 3)::INT AS headings, (doc_id % 8 + 1)::INT AS paragraphs FROM documents)
SELECT doc_id, headings, paragraphs, round(CASE WHEN headings > 2 THEN 0.5 ELSE 0 END + CASE WHEN headings > 3 THEN 0.3 ELSE 0 END + CASE WHEN paragraphs > 5 THEN 0.2 ELSE 0 END, 3)::DOUBLE AS score FROM p""")
def word_structure(spark, d):
    sql = LETTER
    for n in (4, 3, 8):
        sql = sql.replace(f"(doc_id % {n})::INT", f"int(doc_id % {n})")
    docs = read(spark, d, "documents").select("doc_id", D.word_features(F.expr(sql)).alias("f"))
    return docs.select("doc_id", "f.*", F.round(D.word_structure(F.col("f")), 3).alias("score"))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 0.4 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 0.3 ELSE 0 END + 0.1 + CASE WHEN doc_id % 14 > 10 THEN 0.2 ELSE 0 END WHEN 1 THEN CASE WHEN doc_id % 14 + (doc_id % 3 = 0)::INT > 5 THEN 0.2 ELSE 0 END ELSE -1 END AS s FROM documents)
SELECT doc_id, round(s, 3)::DOUBLE AS score, CASE WHEN s >= 0.7 THEN 'structured' WHEN s >= 0.4 THEN 'semi' ELSE 'unstructured' END AS class, CASE WHEN s >= 0.5 THEN 'smart' ELSE 'simple' END AS split FROM s WHERE s >= 0""")
def structure_by_extension(spark, d):
    path = F.expr("CASE doc_id % 4 WHEN 0 THEN '/a/b.PDF' WHEN 1 THEN 'c.docx' ELSE 'd.md' END")
    text = F.expr(PAPER.replace("(doc_id % 14)::INT", "int(doc_id % 14)"))
    docs = read(spark, d, "documents").where("doc_id % 4 < 2")
    return docs.select("doc_id", D.structure(path, text).alias("s")).select("doc_id", "s.*")


@query("""WITH l AS (SELECT doc_id, unnest(string_split('# ' || source || chr(10) || text, chr(10))) AS line, generate_subscripts(string_split('# ' || source || chr(10) || text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
a AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1)::BIGINT AS start FROM l)
SELECT doc_id, trim(regexp_extract(line, '^(#{1,6})[ \t]+(.+)$', 2), ' ') AS title, length(regexp_extract(line, '^#+'))::INT AS level, start, start + length(line) AS end FROM a WHERE regexp_full_match(line, '#{1,6}[ \t]+.+')""")
def section_offsets(spark, d):
    import pyarrow as pa

    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.col("text")).alias("text"))
    return D._each_text(docs, D.sections_of, "title string, level int, start long, end long", [pa.string(), pa.int32(), pa.int64(), pa.int64()])


CORE_SCORES = "points AS (SELECT doc_id, domain, place, score FROM (SELECT doc_id, unnest([{rows}], recursive := true) FROM texts))".format(
    rows=", ".join("{{'domain': '{d}', 'place': {k}, 'score': 3 * ({s})}}".format(d=d, k=k, s=" + ".join(f"contains(lower(text), '{w}')::INT" for w in ws)) for k, (d, ws) in enumerate(X.CORE.items()))
)
DETECTED = """r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k FROM points),
t AS (SELECT doc_id, max(CASE WHEN k = 1 THEN domain END) AS d, max(CASE WHEN k = 1 THEN score END) AS a, max(CASE WHEN k = 2 THEN score END) AS b FROM r GROUP BY 1),
found AS (SELECT doc_id, CASE WHEN a > 0 AND (a - b) / (a + 1)::DOUBLE >= 0.3 THEN d ELSE 'general' END AS domain, (a - b) / (a + 1)::DOUBLE AS confidence FROM t)"""
TECHNICAL = "concat(coalesce(text, ''), CASE doc_id % 5 WHEN 0 THEN ' Postgres WAL and vacuum' WHEN 1 THEN ' a Clinical Trial' WHEN 2 THEN ' docker' ELSE '' END)"


@query(f"WITH texts AS (SELECT doc_id, {TECHNICAL} AS text FROM documents), {CORE_SCORES}, {DETECTED} SELECT doc_id, domain, round(confidence, 6) AS confidence FROM found")
def domain_core(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.expr(TECHNICAL).alias("text"))
    return X.detect_domain(X.domain_scores(docs)).withColumn("confidence", F.round("confidence", 6))


BLOCK = "concat('block ', p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' kubernetes and grafana' WHEN 1 THEN ' mysql' ELSE '' END)"
WHOLE = "concat('document ', p_partkey % 20, CASE p_partkey % 20 WHEN 1 THEN ' mysql redis' WHEN 3 THEN ' docker mri' WHEN 6 THEN ' gdpr ccpa tort injunction' ELSE '' END)"


@query(f"""WITH texts AS (SELECT p_partkey AS doc_id, {BLOCK} AS text FROM part), {CORE_SCORES}, {DETECTED}, blocks AS (SELECT * FROM found),
whole AS (WITH texts AS (SELECT DISTINCT p_partkey % 20 AS doc_id, {WHOLE} AS text FROM part), {CORE_SCORES}, {DETECTED} SELECT * FROM found)
SELECT b.doc_id % 20 AS doc_id, b.doc_id AS block, CASE WHEN b.confidence >= 0.5 AND b.confidence > 1.2 * w.confidence THEN b.domain ELSE w.domain END AS domain FROM blocks b JOIN whole w ON w.doc_id = b.doc_id % 20""")
def block_domain_override(spark, d):
    part = read(spark, d, "part")
    docs = part.select((F.col("p_partkey") % 20).alias("doc_id"), F.expr(WHOLE).alias("text")).distinct()
    blocks = part.select((F.col("p_partkey") % 20).alias("doc_id"), F.col("p_partkey").alias("block"), F.expr(BLOCK).alias("text"))
    return X.block_domains(docs, blocks)


@query(f"WITH {SCORED} SELECT doc_id, count(*) AS terms, round(sum(tfidf), 4) AS total, round(max(tfidf), 6) AS most FROM scored GROUP BY 1")
def term_tfidf(spark, d):
    t = X.scored_terms(read(spark, d, "documents"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("tfidf"), 4).alias("total"), F.round(F.max("tfidf"), 6).alias("most"))


@query(f"WITH {SCORED} SELECT doc_id, round(sum(cvalue), 4) AS total, round(max(cvalue), 6) AS most FROM scored GROUP BY 1")
def term_cvalue(spark, d):
    t = X.scored_terms(read(spark, d, "documents"))
    return t.groupBy("doc_id").agg(F.round(F.sum("cvalue"), 4).alias("total"), F.round(F.max("cvalue"), 6).alias("most"))


@query(f"WITH {SCORED}, t AS (SELECT *, greatest(0, tfidf + cvalue + 0.5 * log2(1 + freq) + 0.5 * len / 3) AS score FROM scored) SELECT doc_id, term, freq, round(score, 6) AS score FROM t WHERE freq >= 3 AND length(term) BETWEEN 3 AND 50")
def extracted_terms(spark, d):
    return X.extract(read(spark, d, "documents"), 3).select("doc_id", "term", "freq", F.round("score", 6).alias("score"))


@query("SELECT p_name AS term, CASE WHEN p_name = upper(p_name) THEN 'UPPER' WHEN p_name = lower(p_name) THEN 'LOWER' WHEN p_name = upper(left(p_name, 1)) || lower(substr(p_name, 2)) THEN 'CAPITALIZED' ELSE 'MIXED' END AS pattern FROM (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN lower(p_name) WHEN 2 THEN upper(left(p_name, 1)) || lower(substr(p_name, 2)) ELSE 'x' || upper(p_name) END AS p_name FROM part)")
def case_patterns(spark, d):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN lower(p_name) WHEN 2 THEN concat(upper(left(p_name, 1)), lower(substr(p_name, 2))) ELSE concat('x', upper(p_name)) END")
    return read(spark, d, "part").select(name.alias("term")).distinct().select("term", T.case_pattern(F.col("term")).alias("pattern"))


@query("SELECT event_id FROM events WHERE user_id <> 7")
def clear_session(spark, d):
    events = read(spark, d, "events").withColumn("session_id", F.col("user_id"))
    return M.without_session(events, 7).select("event_id")


@query("SELECT o_orderkey AS id, o_totalprice AS payload FROM orders WHERE o_orderkey = 33")
def point_lookup(spark, d):
    return M.lookup(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("payload")), "id", 33)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS number, CASE c_custkey % 3 WHEN 0 THEN 'k' || c_custkey ELSE c_custkey::VARCHAR END AS key FROM customer")
def record_ids(spark, d):
    record = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('memory:⟨k', c_custkey, '⟩') ELSE concat('entity:', c_custkey) END")
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), M.record_id(record).alias("number"), M.record_key(record).alias("key"))


@query("WITH n AS (SELECT vec_id AS id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, embedding FROM embeddings) SELECT id, round(embedding[1] / n, 6) AS first, round(embedding[64] / n, 6) AS last FROM n")
def unit_vectors(spark, d):
    u = S.unit(F.transform("embedding", lambda x: x * 3.0))
    return vectors(spark, d).select("id", F.round(u[0], 6).alias("first"), F.round(u[63], 6).alias("last"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey")
def pending_documents(spark, d):
    state = read(spark, d, "orders").select(F.col("o_orderkey").alias("file_path"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("importing").alias("status"), F.col("o_orderdate").alias("imported_at"))
    return M.pending(state).select(F.col("file_path").alias("id"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderkey % 3 = 0")
def processed_documents(spark, d):
    state = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("importing").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("entities_extracted"), (F.col("o_orderkey") % 3 == 0).alias("relations_extracted"))
    return M.processed(state).select("id")


@query("SELECT page_id AS path FROM pages WHERE page_id % 4 = 0 OR page_id % 4 = 1 OR page_id % 4 = 2 AND page_id % 3 = 0")
def changed_files(spark, d):
    pages = read(spark, d, "pages")
    files = pages.select(F.col("page_id").alias("path"), F.md5("html").alias("file_hash"))
    state = pages.where("page_id % 4 <> 0").select(F.col("page_id").alias("file_path"), F.when(F.col("page_id") % 4 == 1, "old").otherwise(F.md5("html")).alias("file_hash"), F.when((F.col("page_id") % 4 == 2) & (F.col("page_id") % 3 == 0), "error").otherwise("completed").alias("status"))
    return M.changed_files(files, state).select("path")


@query("SELECT event_id AS id, value AS importance FROM events WHERE event_type = 'click' ORDER BY value DESC, event_id LIMIT 20")
def important_memories(spark, d):
    memories = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("value").alias("importance"), F.lit(None).cast("boolean").alias("is_active"))
    return M.by_importance(memories, "click", 20).select("id", "importance")


@query("SELECT event_id AS id FROM events WHERE event_type = 'view' AND user_id = 3 AND event_id % 2 = 0")
def fitting_memories(spark, d):
    memories = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").alias("session_id"), (F.col("event_id") % 2 == 0).alias("is_active"))
    return M.fitting(memories, "view", 3).select("id")


@query(f"""WITH s AS (SELECT event_id, 0.5 * 0.8 + pow(0.98, greatest(0, (epoch_us({NOW}) - epoch_us(ts)) / 86400000000.0::DOUBLE)) * 0.8 + value / 100 * 0.7 AS s FROM events)
SELECT event_id, round(s, 6) AS score FROM s ORDER BY round(s, 9) DESC, event_id LIMIT 10""")
def memories_by_score(spark, d):
    e = read(spark, d, "events").withColumn("days", S.days_between(F.col("ts"), F.expr(NOW)))
    score = S.memory_score(F.lit("episodic"), F.lit("semantic"), F.lit(False), F.col("days"), F.col("value") / 100)
    return R.by_score(e.withColumn("id", F.col("event_id")), score, True).select("event_id", F.round("score", 6).alias("score"))


@query("SELECT user_id, max(ts) AS last, count(*) >= 50 AND count(*) % 50 = 0 AS reflect FROM events GROUP BY 1")
def session_activity(spark, d):
    return stream.activity(read(spark, d, "events"), "user_id")
