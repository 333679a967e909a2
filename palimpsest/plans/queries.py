"""The engine's queries over the driver's tables, and the SQL they must agree with.

Roles: orders are memories, parts entities, lineitem their edges, brands topics; embeddings are
memories with a type (label); events are a log of users' messages; documents and pages are texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scores as S, texts as T
from ..operators import documents as D, graph as G, indexing as I, search as R, store as M, terms as X
from ..streaming import messages as stream

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("type"))


def first_vector(spark, d) -> list[float]:
    return list(M.lookup(vectors(spark, d), "id", 0).first()["embedding"])


def edges(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("memory"), F.col("l_partkey").alias("entity")).agg((F.max("l_quantity") / 50.0).alias("weight"))


def topic_tables(spark, d):
    part = read(spark, d, "part")
    topics = part.groupBy(F.col("p_brand").alias("topic")).agg(F.min("p_size").cast("long").alias("parent"), F.lit(0).cast("timestamp").alias("created_at"))
    links = edges(spark, d).join(part.select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("topic")), "entity").groupBy("topic", "memory").agg(F.max("weight").alias("weight"))
    return topics, links


EDGES = "edges AS (SELECT l_orderkey AS memory, l_partkey AS entity, max(l_quantity) / 50.0 AS weight FROM lineitem GROUP BY ALL)"
SIM = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
Q = "q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query(f"WITH {Q} SELECT vec_id AS id, round({SIM}, 6) AS similarity FROM embeddings e, q ORDER BY {SIM} DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return R.vector_search(vectors(spark, d), first_vector(spark, d), 10).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {Q}, n AS (SELECT vec_id AS id, {SIM} AS s FROM embeddings e, q ORDER BY s DESC, id LIMIT 20) SELECT id, round(s, 6) AS similarity FROM n WHERE s > 0.2 ORDER BY s DESC, id LIMIT 10")
def vector_search_threshold(spark, d):
    return R.vector_search(vectors(spark, d), first_vector(spark, d), 10, 0.2).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {Q}, n AS (SELECT vec_id AS id, label AS type, {SIM} AS s, row_number() OVER (PARTITION BY label ORDER BY {SIM} DESC, vec_id) AS r FROM embeddings e, q WHERE label IN (0, 1, 2))
SELECT id, type, round(s, 6) AS similarity FROM n WHERE r <= CASE type WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 10 END""")
def vector_topk_by_type(spark, d):
    return R.typed_search(vectors(spark, d), first_vector(spark, d), {0: 3, 1: 5, 2: 10}).select("id", "type", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {Q}, n AS (SELECT vec_id AS id, 0.5 * {SIM} + 0.25 AS s FROM embeddings e JOIN documents ON doc_id = vec_id, q WHERE contains(lower(text), 'the'))
SELECT id, round(s, 6) AS score FROM n ORDER BY s DESC, id LIMIT 10""")
def hybrid_keyword_vector(spark, d):
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    both = vectors(spark, d).join(texts, "id")
    return R.keyword_vector_search(both, first_vector(spark, d), "the", 10).select("id", F.round("score", 6).alias("score"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100")
def scroll_filtered(spark, d):
    events = read(spark, d, "events")
    return M.scroll(events, F.col("event_type") == "error", 100, F.col("ts"), F.col("event_id")).select("event_id", "user_id", "value")


@query("""SELECT event_id AS id, event_type AS type, CASE WHEN value IS NULL OR floor(value / 10) = 0 THEN 0.5 ELSE floor(value / 10) END AS importance,
  user_id AS access_count, true AS is_active FROM events""")
def payload_shaping(spark, d):
    events = read(spark, d, "events")
    shaped = events.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.floor(F.col("value") / 10).cast("double").alias("importance"), F.col("user_id").alias("access_count"), F.lit(None).cast("boolean").alias("is_active"))
    return M.payload(shaped)


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY GROUPING SETS ((), (event_type))")
def type_counts(spark, d):
    return M.type_counts(read(spark, d, "events").select(F.col("event_type").alias("type")))


@query(f"WITH {EDGES} SELECT entity, count(*) AS links, count(*) >= 400 AS split, count(*) >= 500 AS frozen FROM edges GROUP BY entity")
def super_nodes(spark, d):
    return G.degrees(edges(spark, d))


@query(f"WITH {EDGES}, c AS (SELECT entity, count(*) AS n FROM edges GROUP BY 1) SELECT p_type AS type, count(*) AS entities, CAST(sum(coalesce(n, 0)) AS BIGINT) AS links FROM part LEFT JOIN c ON entity = p_partkey GROUP BY 1")
def global_entity_stats(spark, d):
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_type").alias("type"))
    return M.entity_type_stats(parts, edges(spark, d))


@query("WITH o AS (SELECT l_orderkey, list(l_linenumber) AS t FROM lineitem GROUP BY 1) SELECT o_orderstatus AS version, count(*) AS blocks, CAST(sum(len(t)) AS BIGINT) AS triples FROM orders JOIN o ON l_orderkey = o_orderkey GROUP BY 1")
def triple_stats(spark, d):
    nested = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("triples"))
    both = read(spark, d, "orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"))
    return M.compiled_stats(both.withColumn("doc_version", F.col("o_orderstatus"))).withColumnRenamed("doc_version", "version")


@query(f"WITH {EDGES}, n AS (SELECT * FROM edges WHERE entity = 7 ORDER BY weight DESC, memory LIMIT 10) SELECT memory, entity, weight, o_orderpriority AS content FROM n LEFT JOIN orders ON o_orderkey = memory")
def search_by_entity(spark, d):
    memories = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"))
    return R.search_by_entity(edges(spark, d), memories, 7)


ASSOC = f"WITH {EDGES}, mine AS (SELECT DISTINCT entity FROM edges WHERE memory = 1)"


@query(f"{ASSOC} SELECT memory, entity, weight FROM edges WHERE memory <> 1 AND entity IN (SELECT entity FROM mine) ORDER BY weight DESC, memory, entity LIMIT 10")
def search_by_association(spark, d):
    return R.search_by_association(edges(spark, d), 1).select("memory", "entity", "weight")


@query(f"{ASSOC} SELECT memory, max(weight) AS weight FROM edges WHERE memory <> 1 AND entity IN (SELECT entity FROM mine) GROUP BY 1 ORDER BY weight DESC, memory LIMIT 20")
def multi_degree_1(spark, d):
    return R.multi_degree_search(edges(spark, d), cooccurring(spark, d), 1, 1)


PAIRS = """own AS (SELECT DISTINCT l_orderkey AS memory, l_partkey AS entity FROM lineitem),
pairs AS (SELECT a.entity AS "in", b.entity AS "out", count(*) AS n FROM own a JOIN own b ON a.memory = b.memory AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= {least}),
m AS (SELECT entity, count(*) AS m FROM own GROUP BY 1),
rel AS (SELECT "in", "out", n, n / sqrt(a.m * b.m) AS weight FROM pairs JOIN m a ON a.entity = "in" JOIN m b ON b.entity = "out")"""


def cooccurring(spark, d, least=1):
    return G.cooccurrence(edges(spark, d), least)


@query(f"{ASSOC}, {PAIRS.format(least=1)}, reach AS (SELECT DISTINCT \"out\" AS entity FROM rel WHERE weight >= 0.05 AND \"in\" IN (SELECT entity FROM mine)) SELECT memory, max(weight) AS weight FROM edges WHERE memory <> 1 AND entity IN (SELECT entity FROM reach) GROUP BY 1 ORDER BY weight DESC, memory LIMIT 20")
def multi_degree_2(spark, d):
    return R.multi_degree_search(edges(spark, d), cooccurring(spark, d), 1, 2, 0.05)


@query(f"WITH {PAIRS.format(least=1)} SELECT \"in\", \"out\", n, round(weight, 6) AS weight FROM rel")
def entity_cooccurrence(spark, d):
    return cooccurring(spark, d).withColumn("weight", F.round("weight", 6))


@query(f"WITH {PAIRS.format(least=1)} SELECT \"in\", \"out\", n FROM rel WHERE weight >= 0.05")
def prune_edges(spark, d):
    return G.prune(cooccurring(spark, d), 0.05).select("in", "out", "n")


@query(f"WITH {PAIRS.format(least=1)} SELECT n AS kind, count(*) AS n, round(avg(weight), 6) AS mean, round(max(weight), 6) AS greatest, round(min(weight), 6) AS least FROM rel GROUP BY GROUPING SETS ((), (n))")
def relation_stats(spark, d):
    stats = G.relation_stats(cooccurring(spark, d).withColumnRenamed("n", "kind"), "kind")
    return stats.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("mean", "greatest", "least")])


GRAPH = f"WITH {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, memory) AS k FROM edges WHERE entity IN (3, 5, 7))"


@query(f"{GRAPH} SELECT memory, max(weight) AS weight FROM r WHERE k <= 20 GROUP BY 1")
def graph_search(spark, d):
    return R.graph_search(edges(spark, d), [3, 5, 7])


TOPICS = f"""WITH {EDGES}, topics AS (SELECT p_brand AS topic, min(p_size)::BIGINT AS parent FROM part GROUP BY 1),
links AS (SELECT p_brand AS topic, memory, max(weight) AS weight FROM edges JOIN part ON p_partkey = entity GROUP BY ALL),
r AS (SELECT topic, memory, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, memory) AS k FROM links JOIN topics USING (topic) WHERE parent IN (1, 2, 3))"""


@query(f"{TOPICS}, o AS (SELECT *, row_number() OVER (PARTITION BY memory ORDER BY weight DESC, topic) AS f FROM r WHERE k <= 10) SELECT memory, topic, weight FROM o WHERE f = 1")
def topic_search(spark, d):
    topics, links = topic_tables(spark, d)
    return R.topic_search(topics, links, [1, 2, 3])


def paths(spark, d):
    lines = read(spark, d, "lineitem")
    pick = lambda n, c: lines.where(F.col("l_linenumber") == n).groupBy(F.col("l_orderkey").alias("id")).agg(F.max(c).alias("score"))
    return pick(1, F.col("l_discount") * 10), pick(2, F.col("l_discount") * 10), pick(3, F.col("l_tax") * 10)


PATHS = "WITH " + ", ".join(f"{n} AS (SELECT l_orderkey AS id, max({c} * 10) AS {n} FROM lineitem WHERE l_linenumber = {k} GROUP BY 1)" for n, k, c in (("v", 1, "l_discount"), ("g", 2, "l_discount"), ("t", 3, "l_tax")))


@query(f"{PATHS} SELECT id, round(greatest(v, g), 6) AS score, CASE WHEN v IS NULL THEN 'graph' WHEN g IS NULL THEN 'vector' ELSE 'hybrid' END AS source FROM v FULL JOIN g USING (id)")
def merge_two_paths(spark, d):
    v, g, _ = paths(spark, d)
    return R.merge_two(v, g).withColumn("score", F.round("score", 6))


@query(f"""{PATHS}, j AS (SELECT id, v, g, t, v IS NOT NULL AND g IS NOT NULL AND g > v AS two FROM v FULL JOIN g USING (id) FULL JOIN t USING (id)),
b AS (SELECT *, CASE WHEN coalesce(two, false) THEN g ELSE coalesce(v, g) END AS base FROM j),
l AS (SELECT *, coalesce(base IS NOT NULL AND t IS NOT NULL AND NOT two AND t / 0.7::DOUBLE > base, false) AS late FROM b)
SELECT id, round(CASE WHEN late THEN t ELSE coalesce(base, t * 0.7::DOUBLE) END, 6) AS score,
  CASE WHEN two OR late THEN 'hybrid' WHEN v IS NOT NULL THEN 'vector' WHEN g IS NOT NULL THEN 'graph' ELSE 'topic' END AS source FROM l""")
def merge_three_paths(spark, d):
    return R.merge_three(*paths(spark, d)).withColumn("score", F.round("score", 6))


@query(r"""WITH h AS (SELECT doc_id AS id, n_chars, list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]+'), lambda w: length(w) > 3)) AS w, source AS cluster,
  row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30),
p AS (SELECT b.id, b.r, count(a.id) FILTER (WHERE len(list_intersect(a.w, b.w)) > 0.5 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))) AS alike FROM h b LEFT JOIN h a ON a.r < b.r AND a.r < 5 GROUP BY ALL),
c AS (SELECT id, row_number() OVER (PARTITION BY cluster ORDER BY r) > 1 AS again FROM h)
SELECT id, round(greatest(0, 1 - 0.05 * r - 0.15 * alike - CASE WHEN again THEN 0.2 ELSE 0 END), 6) AS score, CAST(r AS INTEGER) AS rank FROM p JOIN c USING (id)""")
def diversity_rerank(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("score"), F.col("source").alias("cluster"))
    return R.rerank(docs).select("id", F.round("score", 6).alias("score"), "rank")


RETRIEVED = f"""{TOPICS}, {Q},
v AS (SELECT vec_id AS id, {SIM} AS v FROM embeddings e, q ORDER BY v DESC, id LIMIT 20),
gr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, memory) AS gk FROM edges WHERE entity IN (3, 5, 7)),
g AS (SELECT memory AS id, max(weight) AS g FROM gr WHERE gk <= 20 GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY memory ORDER BY weight DESC, topic) AS f FROM r WHERE k <= 10),
t AS (SELECT memory AS id, weight AS t FROM o WHERE f = 1),
j AS (SELECT id, v, g, t, v IS NOT NULL AND g IS NOT NULL AND g > v AS two FROM v FULL JOIN g USING (id) FULL JOIN t USING (id)),
b AS (SELECT *, CASE WHEN coalesce(two, false) THEN g ELSE coalesce(v, g) END AS base FROM j),
l AS (SELECT *, coalesce(base IS NOT NULL AND t IS NOT NULL AND NOT two AND t / 0.7::DOUBLE > base, false) AS late FROM b),
m AS (SELECT id, CASE WHEN late THEN t ELSE coalesce(base, t * 0.7::DOUBLE) END AS score FROM l ORDER BY score DESC, id LIMIT 30),
h AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w) > 3)) AS w, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM m JOIN documents ON doc_id = id),
p AS (SELECT b.id, b.r, count(a.id) FILTER (WHERE len(list_intersect(a.w, b.w)) > 0.5 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))) AS alike FROM h b LEFT JOIN h a ON a.r < b.r AND a.r < 5 GROUP BY ALL),
s AS (SELECT id, r AS rank, greatest(0, 1 - 0.05 * r - 0.15 * alike) AS score FROM p)"""


@query(f"{RETRIEVED} SELECT id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM s WHERE score >= 0.6 ORDER BY score DESC, rank LIMIT 5")
def hybrid_retrieve(spark, d):
    topics, links = topic_tables(spark, d)
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    found = R.retrieve(vectors(spark, d), edges(spark, d), links, topics, texts, first_vector(spark, d), "what do we know of part seven", [3, 5, 7], [1, 2, 3])
    return found.withColumn("score", F.round("score", 6))


@query("""WITH RECURSIVE a AS (SELECT n_nationkey::BIGINT AS alias, (n_regionkey * 5)::BIGINT AS target FROM nation WHERE n_nationkey <> n_regionkey * 5),
s AS (SELECT alias, target, [alias, target] AS path, 0 AS circle FROM a UNION ALL SELECT s.alias, a.target, list_append(path, a.target), CASE WHEN list_contains(path, a.target) THEN 1 ELSE 0 END FROM s JOIN a ON a.alias = s.target WHERE circle = 0)
SELECT alias, max(CASE WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.alias = s.target) THEN target END) AS canonical FROM s GROUP BY 1""")
def alias_resolution(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("alias"), (F.col("n_regionkey") * 5).cast("long").alias("target"))
    return G.resolve_aliases(n.where(F.col("alias") != F.col("target")))


@query("SELECT n_regionkey AS entity, list_sort(list(DISTINCT n_name)) AS aliases FROM nation GROUP BY 1")
def alias_groups(spark, d):
    return G.aliases_of(read(spark, d, "nation").select(F.col("n_regionkey").alias("entity"), F.col("n_name").alias("alias")))


@query("""WITH p AS (SELECT a.vec_id AS "in", b.vec_id AS "out", list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS w FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT "in", "out", round(w, 6) AS weight, CASE WHEN w > 0.4 THEN 'synonym' ELSE 'related_to' END AS type FROM p WHERE w >= 0.3""")
def semantic_pairs(spark, d):
    return G.semantic_pairs(vectors(spark, d), 0.3, 0.4).withColumn("weight", F.round("weight", 6))


@query("""WITH p AS (SELECT a.vec_id AS i, b.vec_id AS o, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS w FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
s AS (SELECT i, o, a.label + 1 AS fi, b.label + 1 AS fo FROM p JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = o WHERE w > 0.4)
SELECT CASE WHEN fi >= fo THEN i ELSE o END AS "primary", CASE WHEN fi >= fo THEN o ELSE i END AS merged, fi + fo AS frequency FROM s""")
def synonym_merge(spark, d):
    v = vectors(spark, d)
    return G.merge_synonyms(G.semantic_pairs(v, 0.4, 0.4), v.select("id", (F.col("type") + 1).alias("frequency")), 0.4)


def relation_rows(spark, d):
    lines = read(spark, d, "lineitem")
    method = F.element_at(F.array(*map(F.lit, ("rule", "llm", "embedding", "co_occurrence"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return lines.select(F.col("l_suppkey").alias("in"), F.col("l_partkey").alias("out"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("weight"), F.col("l_tax").alias("confidence"), method.alias("method"))


REL = """rel AS (SELECT l_suppkey AS "in", l_partkey AS "out", l_returnflag AS type, l_discount AS weight, l_tax AS confidence, ['rule', 'llm', 'embedding', 'co_occurrence'][l_linenumber % 4 + 1] AS method FROM lineitem)"""


@query(f"""WITH {REL}, r AS (SELECT *, row_number() OVER (PARTITION BY "in", "out" ORDER BY CASE method WHEN 'rule' THEN 4 WHEN 'llm' THEN 3 WHEN 'embedding' THEN 2 ELSE 1 END DESC, confidence DESC, type) AS k FROM rel)
SELECT "in", "out", method, confidence, type FROM r WHERE k = 1""")
def relation_conflicts(spark, d):
    return G.winning_relations(relation_rows(spark, d)).select("in", "out", "method", "confidence", "type")


@query(f"""WITH {REL} SELECT "in", "out", type, max(weight) AS weight, max(confidence) AS confidence, max_by(method, (confidence, method)) AS method FROM rel GROUP BY ALL""")
def relation_upsert(spark, d):
    rows = relation_rows(spark, d)
    return G.upsert_relations(rows.where("type = 'A'"), rows.where("type <> 'A'"))


HASH = r"sha256(trim(regexp_replace(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'), '[^A-Za-z0-9_ \x{4e00}-\x{9fff}]', '', 'g')))"


@query(f"SELECT {HASH} AS content_hash, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")
def content_hash_dedup(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT {HASH} AS content_hash, list_sort(list(DISTINCT source)) AS versions, count(*) AS ref_count FROM documents GROUP BY 1")
def version_references(spark, d):
    return M.references(read(spark, d, "documents").select(T.content_hash(F.col("text")).alias("content_hash"), F.col("source").alias("version")))


KEYWORDS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^A-Za-z0-9_ \\t\\n\\r\\f\\v]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w) > 3 AND NOT list_contains([{words}], w))[1:20])".format(words=", ".join(f"'{w}'" for w in T.KEYWORD_STOPWORDS))


@query(f"""WITH k AS (SELECT conv_id, turn, {KEYWORDS} AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM k)
SELECT conv_id, turn, round(CASE WHEN len(w) > 0 AND len(b) > 0 THEN len(list_intersect(w, b)) / greatest(len(w), len(b))::DOUBLE ELSE 0 END, 6) AS overlap FROM p WHERE b IS NOT NULL""")
def keyword_overlap(spark, d):
    from pyspark.sql import Window

    talk = read(spark, d, "conversations").select("conv_id", "turn", T.keywords(F.col("text")).alias("w"))
    before = F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    both = talk.withColumn("b", before).where(F.col("b").isNotNull())
    return both.select("conv_id", "turn", F.round(T.overlap(F.col("w"), F.col("b")), 6).alias("overlap"))


@query(f"WITH {EDGES} SELECT entity, count(*) AS mentions, round(least(0.95, 0.7 + 0.05 * count(*)), 6) AS confidence FROM edges GROUP BY 1 ORDER BY mentions DESC, entity LIMIT 10000")
def known_entities(spark, d):
    return I.known_entities(edges(spark, d)).withColumn("confidence", F.round("confidence", 6))


DAYS = f"(epoch_us({NOW}) - epoch_us(ts)) / 86400000000.0::DOUBLE"


def aged(spark, d):
    return read(spark, d, "events").withColumn("days", S.days_between(F.col("ts"), F.expr(NOW)))


KIND = "CASE event_type WHEN 'view' THEN 'episodic' WHEN 'click' THEN 'semantic' WHEN 'signup' THEN 'reflection' ELSE event_type END"


@query(f"""WITH e AS (SELECT event_id, {KIND} AS k, {DAYS} AS days, value / 100 AS sim FROM events),
s AS (SELECT event_id, CASE WHEN k = 'semantic' THEN 1.0 ELSE 0.5 END * CASE k WHEN 'reflection' THEN 1.2 WHEN 'semantic' THEN 1.0 ELSE 0.8 END + pow(0.98, greatest(0, days)) * 0.8 + sim * 0.7 AS s FROM e)
SELECT event_id, round(s, 6) AS score FROM s""")
def memory_score_sort(spark, d):
    e = aged(spark, d)
    kind = F.expr(KIND)
    score = S.memory_score(kind, F.lit("semantic"), F.lit(False), F.col("days"), F.col("value") / 100)
    return e.select("event_id", F.round(score, 6).alias("score"))


@query(f"SELECT event_id, round(greatest(0, least(1, 0.5 * (value / 1000) + 0.3 * ln(user_id % 20 + 1) + 0.2 * exp(-({DAYS}) / 30))), 6) AS importance, round(exp(-({DAYS}) / 30), 6) AS recency FROM events")
def importance_dynamic(spark, d):
    e = aged(spark, d)
    return e.select("event_id", F.round(S.importance(F.col("value") / 1000, F.col("user_id") % 20, F.col("days")), 6).alias("importance"), F.round(S.recency(F.col("days")), 6).alias("recency"))


@query(f"""WITH e AS (SELECT event_id, value / 200 AS v, {DAYS} AS days FROM events), c AS (SELECT *, greatest(0.1, v * exp(-ln(2.0) / 30 * days)) AS x FROM e)
SELECT event_id, round(CASE WHEN days >= 1 AND abs(v - x) > 0.05 THEN x ELSE v END, 6) AS importance FROM c""")
def importance_halflife_decay(spark, d):
    return aged(spark, d).select("event_id", F.round(S.half_life(F.col("value") / 200, F.col("days")), 6).alias("importance"))


@query(f"SELECT event_type AS type, count(*) AS decayed, round(sum(greatest(0.01, value / 200 * 0.98)), 4) AS total FROM events WHERE {DAYS} > 7 GROUP BY 1")
def daily_decay(spark, d):
    old = aged(spark, d).where(F.col("days") > 7)
    return old.groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("decayed"), F.round(F.sum(S.daily_decay(F.col("value") / 200)), 4).alias("total"))


@query(f"SELECT o_orderkey AS id, round(exp(-0.01 * ((epoch_us({NOW}) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE) / 30), 6) AS factor FROM orders")
def relation_decay(spark, d):
    days = S.days_between(F.col("o_orderdate"), F.expr(NOW))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(S.relation_decay(days), 6).alias("factor"))


@query(f"SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) >= {NOW} - INTERVAL 2 DAYS")
def ttl_prune(spark, d):
    last = read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return M.expire(last, "last", NOW, 2)


@query("SELECT user_id AS id, count(*) AS access_count, CASE WHEN count(*) >= 10 THEN 'semantic' ELSE 'episodic' END AS type FROM events GROUP BY 1")
def promote_memories(spark, d):
    used = read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("access_count"))
    return M.promote(used.withColumn("type", F.lit("episodic"))).select("id", "access_count", "type")


HTML = "html"
for _p, _r in ((r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), ("<[^>]*>", " ")):
    HTML = f"regexp_replace({HTML}, '{_p}', '{_r}', 'g')"
for _e, _c in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
    HTML = f"replace({HTML}, '{_e}', '{_c}')"
HTML = rf"trim(regexp_replace({HTML}, '[ \t\n\r\f\v]+', ' ', 'g'))"


@query(f"SELECT page_id, sha256({HTML}) AS text_sha256, length({HTML}) AS n_chars FROM pages")
def html_to_text(spark, d):
    text = T.html_to_text(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.sha2(text, 256).alias("text_sha256"), F.length(text).cast("long").alias("n_chars"))


def _has(tags):
    return f"CASE WHEN regexp_matches(html, '(?i)<({tags})[\\s>]') THEN 1.0 ELSE 0.0 END"


@query(f"""WITH s AS (SELECT page_id, 0.3 * {_has('article|section|main|nav|header|footer')} + 0.2 * {_has('h1')} + 0.2 * {_has('h2|h3')} + 0.1 * {_has('table')} + 0.1 * {_has('ul|ol')} + 0.1 * {_has('pre|code')} AS s FROM pages)
SELECT page_id, round(s::DOUBLE, 3) AS score, CASE WHEN round(s, 3) >= 0.7 THEN 'structured' WHEN round(s, 3) >= 0.4 THEN 'semi' ELSE 'unstructured' END AS class FROM s""")
def html_structure(spark, d):
    score = F.round(D.html_structure(F.col("html")), 3)
    return read(spark, d, "pages").select("page_id", score.alias("score"), D.structure_class(score).alias("class"))


@query(r"""WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents),
h AS (SELECT doc_id, text, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(x, '^(#{1,6} |[0-9]+[.)] |[A-Z][A-Z ]{3,}$)'))) AS h FROM l)
SELECT doc_id, round((CASE WHEN h > 2 THEN 0.4 ELSE 0 END + CASE WHEN h > 0 THEN 0.3 ELSE 0 END + CASE WHEN n > 5 THEN 0.2 ELSE 0 END + CASE WHEN length(text) > 500 THEN 0.1 ELSE 0 END)::DOUBLE, 3) AS score FROM h""")
def text_structure(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(D.text_structure(F.col("text")), 3).alias("score"))


# Words of the driver's texts that stand in for a domain's vocabulary.
TONGUES = {"english": ["the", "thing", "ing"], "german": ["und", "heit", "keit"], "french": ["eau", "tre", "ê"], "spanish": ["ción", "mente", "ñ"]}
DOMAIN = "points AS (SELECT doc_id, domain, place, score FROM (SELECT doc_id, unnest([{rows}], recursive := true) FROM documents))".format(
    rows=", ".join("{{'domain': '{d}', 'place': {k}, 'score': {s}}}".format(d=d, k=k, s=" + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in ws)) for k, (d, ws) in enumerate(TONGUES.items()))
)


@query(f"""WITH {DOMAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k FROM points),
t AS (SELECT doc_id, max(CASE WHEN k = 1 THEN domain END) AS d, max(CASE WHEN k = 1 THEN score END) AS a, max(CASE WHEN k = 2 THEN score END) AS b FROM r GROUP BY 1)
SELECT doc_id, CASE WHEN a > 0 AND (a - b) / (a + 1)::DOUBLE >= 0.3 THEN d ELSE 'general' END AS domain, round((a - b) / (a + 1)::DOUBLE, 6) AS confidence FROM t""")
def domain_detect(spark, d):
    found = X.detect_domain(X.domain_scores(read(spark, d, "documents"), TONGUES, {}))
    return found.withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {DOMAIN} SELECT doc_id, coalesce(list_slice(list(domain ORDER BY score DESC, place) FILTER (WHERE score > 0), 1, 3), []) AS domains FROM points GROUP BY 1")
def domain_fallback(spark, d):
    return X.fallback_domains(X.domain_scores(read(spark, d, "documents"), TONGUES, {}))


def _tokens():
    ascii_bounds = [p.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b") for p in T.TERM_PATTERNS]
    special = ", ".join(f"regexp_extract_all(text, '{p}')" for p in ascii_bounds)
    stop = ", ".join(f"'{w}'" for w in T.TERM_STOPWORDS)
    return f"list_concat({special}, list_filter(regexp_extract_all(text, '{T.WORD_PATTERN}'), lambda w: length(w) >= 3 AND NOT list_contains([{stop}], lower(w))))"


SPECIAL = f"(starts_with(t, 'pg_') OR contains(t, '-') OR regexp_matches(t, '{T.CAMEL_PART}') OR (upper(t) = t AND length(t) <= 8))"
GRAMS = f"""toks AS (SELECT doc_id, {_tokens()} AS t FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, list_filter(t, lambda t: {SPECIAL} AND length(t) >= 3) AS s, list_filter(t, lambda t: NOT {SPECIAL}) AS p FROM toks),
grams AS (SELECT doc_id, unnest(s) AS term FROM split
  UNION ALL SELECT doc_id, unnest(list_filter([p[i] || ' ' || p[i + 1] FOR i IN range(1, len(p))], lambda g: length(g) >= 8)) FROM split
  UNION ALL SELECT doc_id, unnest(list_filter([p[i] || ' ' || p[i + 1] || ' ' || p[i + 2] FOR i IN range(1, len(p) - 1)], lambda g: length(g) >= 8)) FROM split),
counts AS (SELECT doc_id, term, count(*) AS freq FROM grams GROUP BY ALL)"""


@query(f"WITH {GRAMS} SELECT doc_id, CAST(count(*) AS BIGINT) AS terms, CAST(sum(freq) AS BIGINT) AS grams, CAST(max(freq) AS BIGINT) AS most FROM counts GROUP BY 1")
def ngram_freq(spark, d):
    counts = X.term_counts(read(spark, d, "documents"))
    return counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("freq").alias("grams"), F.max("freq").alias("most"))


SCORED = f"""{GRAMS}, sized AS (SELECT *, len(string_split(term, ' ')) AS len, sum(freq) OVER (PARTITION BY doc_id) AS total FROM counts),
three AS (SELECT doc_id, freq, string_split(term, ' ') AS w FROM sized WHERE len = 3),
holds AS (SELECT doc_id, freq, unnest(list_distinct([w[1] || ' ' || w[2], w[1] || ' ' || w[3], w[2] || ' ' || w[3]])) AS term FROM three),
held AS (SELECT doc_id, term, avg(freq) AS nested FROM holds GROUP BY ALL),
kinds AS (SELECT s.*, nested, CASE WHEN regexp_matches(term, '(?i)^pg_') THEN 3.0 WHEN contains(term, '-') THEN 1.5 WHEN regexp_matches(term, '{T.CAMEL_PART}') THEN 2.0 WHEN upper(term) = term AND length(term) <= 8 THEN 2.0 ELSE 1.0 END AS shape FROM sized s LEFT JOIN held USING (doc_id, term)),
scored AS (SELECT doc_id, term, freq, freq / total::DOUBLE * shape AS tfidf, CASE WHEN nested IS NULL THEN log2(len) * freq ELSE greatest(0, log2(len) * (freq - nested)) END AS cvalue, len FROM kinds)"""


@query(f"""WITH {SCORED}, t AS (SELECT *, greatest(0, tfidf + cvalue + 0.5 * log2(1 + freq) + 0.5 * len / 3) AS score FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS k FROM t)
SELECT doc_id, term, freq, round(tfidf, 6) AS tfidf, round(cvalue, 6) AS cvalue, round(score, 6) AS score FROM r WHERE k <= 20""")
def term_scores(spark, d):
    terms = X.scored_terms(read(spark, d, "documents"), best=20)
    return terms.select("doc_id", "term", "freq", *[F.round(c, 6).alias(c) for c in ("tfidf", "cvalue", "score")])


@query(r"""WITH m AS (SELECT conv_id, turn, lower(text) AS t, length(trim(text, ' ')) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^(你好|您好|hello|hi|hey|早上好|晚上好)') OR regexp_matches(t, '^(谢谢|感谢|好的|ok|okay|yes|no)') OR n < 3 THEN 'TRIVIAL'
  WHEN regexp_matches(t, '[？?]|^(什么|怎么|为什么|谁|哪里|何时|多少|what|how|why|who|where|when)') THEN 'QUESTION' WHEN regexp_matches(t, '^(我喜欢|我爱|我讨厌|prefer|like|love|hate)') THEN 'PREFERENCE'
  WHEN regexp_matches(t, '^(我是|我在|我用|我做|我工作|我住|i am|i use|i work)') THEN 'FACT' ELSE 'EVENT' END AS category FROM m""")
def message_classify(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.classify(F.col("text"))["category"].alias("category"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id FROM r WHERE k <= 50")
def session_last_n(spark, d):
    return M.last_n(read(spark, d, "events"), "user_id", 50, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("WITH r AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS batch FROM events) SELECT user_id, CAST(batch AS BIGINT) AS batch, count(*) AS n, min(event_id) AS first FROM r GROUP BY ALL")
def batch_by_10(spark, d):
    b = M.batches(read(spark, d, "events"), "user_id", 10, F.col("ts"), F.col("event_id"))
    return b.groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, count(*) AS events, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, s""")
def idle_sessions(spark, d):
    return M.sessions(read(spark, d, "events"), "user_id", "ts")


@query("SELECT conv_id, left(text, 50) AS prefix FROM conversations WHERE trim(text, ' ') <> '' GROUP BY ALL")
def message_dedup(spark, d):
    return stream.first_messages(read(spark, d, "conversations"), "conv_id", "text").select("conv_id", "prefix")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id, count(*) AS n FROM events GROUP BY ALL")
def mentions_by_hour(spark, d):
    return stream.mention_counts(read(spark, d, "events"), "user_id")


@query("""WITH f AS (SELECT vec_id, label AS topic, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
p AS (SELECT topic, unnest(e) AS x, unnest(range(len(e))) AS pos FROM f WHERE k <= 50), m AS (SELECT topic, pos, avg(x) AS x FROM p GROUP BY ALL)
SELECT topic, round(sqrt(sum(x * x)), 6) AS norm, round(max(x), 6) AS most FROM m GROUP BY 1""")
def centroids(spark, d):
    v = vectors(spark, d)
    c = G.centroids(v.select(F.col("type").alias("topic"), F.col("id").alias("memory")), v)
    return c.select("topic", F.round(S.norm(F.col("centroid")), 6).alias("norm"), F.round(F.array_max("centroid"), 6).alias("most"))


@query("""WITH f AS (SELECT vec_id, label AS topic, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
p AS (SELECT topic, unnest(e) AS x, unnest(range(len(e))) AS pos FROM f WHERE k <= 50), m AS (SELECT topic, pos, avg(x) AS x FROM p GROUP BY ALL), c AS (SELECT topic, list(x ORDER BY pos) AS c FROM m GROUP BY 1),
s AS (SELECT vec_id AS id, c.topic, list_cosine_similarity(e, c) AS s FROM f, c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, topic) AS k FROM s)
SELECT id, CAST(topic AS BIGINT) AS topic, round(s, 6) AS similarity FROM r WHERE k = 1 AND s > 0.2""")
def mount_nearest(spark, d):
    v = vectors(spark, d)
    c = G.centroids(v.select(F.col("type").alias("topic"), F.col("id").alias("memory")), v)
    return G.mount(v, c, 0.2).withColumn("similarity", F.round("similarity", 6))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT *, greatest(1, n // 3) AS step FROM r) SELECT source, doc_id FROM s WHERE place % step = 0 AND place // step < 3""")
def diverse_sample(spark, d):
    return D.diverse_sample(read(spark, d, "documents"), "source").select("source", "doc_id")


@query("""WITH s AS (SELECT doc_id, length(text) AS n, string_split_regex(text, '(?i)idiot|stupid|license') AS p, regexp_extract_all(text, '(?i)idiot|stupid|license') AS m FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM s),
places AS (SELECT doc_id, n, k, list_sum(list_transform(list_slice(p, 1, k), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, k - 1), lambda x: length(x))), 0) AS spot, length(m[k]) AS size FROM u),
spans AS (SELECT doc_id, n, k, greatest(0, spot - 100) AS lo, spot + size + 100 AS hi FROM places),
opened AS (SELECT *, CASE WHEN lo <= lag(hi) OVER (PARTITION BY doc_id ORDER BY k) THEN 0 ELSE 1 END AS new FROM spans),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM opened)
SELECT doc_id, island::BIGINT AS island, min(lo)::BIGINT AS start, least(max(hi), any_value(n))::BIGINT AS "end" FROM islands WHERE island <= 3 GROUP BY ALL
UNION ALL SELECT doc_id, 1, 0, least(200, n) FROM s WHERE len(m) = 0""")
def context_windows(spark, d):
    return D.context_windows(read(spark, d, "documents"), ["idiot", "stupid", "license"])


@query(None)
def leader_clusters(spark, d):
    return D.leader_clusters(vectors(spark, d).withColumnRenamed("type", "group"), "group", 0.25, 10, 0.1)


@query(None)
def chunk_documents(spark, d):
    return D.chunks(read(spark, d, "documents"), 500, r"\n+").select("doc_id", "chunk", F.length("content").alias("n_chars"))


@query(None)
def repetition_flags(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.repetitive(F.col("text")).alias("repetitive"), F.length(T.without_repetition(F.col("text"))).alias("n_chars"))
