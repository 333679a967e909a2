"""Queries of models' answers, questions, markdown, upkeep of the store and naming rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A, intents as I, scores as S
from ..operators import documents as D, graph as G, store as M, terms as X
from ..sources import files, models
from .queries import EDGES, edges, query, read

SAID = "concat('Ranking: ', l_linenumber, ', ', l_suppkey, ' > ', l_partkey % 12, '; ', l_linenumber)"


@query(f"""WITH n AS (SELECT l_orderkey, l_linenumber, list_transform(regexp_extract_all({SAID}, '[0-9]+'), lambda x: x::BIGINT) AS n FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, list_concat(list_filter(n, lambda x: x < 10), range(10)) AS v FROM n)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ' ') AS ranking FROM v""")
def parse_ranking(spark, d):
    lines = read(spark, d, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.array_join(A.ranking(F.expr(SAID), 10).cast("array<string>"), " ").alias("ranking"))


LABEL = """concat('Sure: {"relation_type": "', CASE event_type WHEN 'view' THEN 'causes' WHEN 'click' THEN 'used_for' ELSE event_type END, '", "confidence": ', user_id % 3, ', "reverse_direction": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN event_id % 5 = 0 THEN '' ELSE '} done' END)"""


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_type = 'view' THEN 'causes' WHEN event_id % 5 <> 0 AND event_type = 'click' THEN 'used_for' ELSE 'related_to' END AS relation_type,
CASE WHEN event_id % 5 = 0 THEN 0.5::DOUBLE ELSE least(1, user_id % 3)::DOUBLE END AS confidence, event_id % 5 <> 0 AND event_id % 2 = 0 AS reverse FROM events""")
def parse_relation_label(spark, d):
    label = A.relation_label(F.expr(LABEL))
    return read(spark, d, "events").select("event_id", label["relation_type"].alias("relation_type"), label["confidence"].alias("confidence"), label["reverse"].alias("reverse"))


ANSWER = """concat('```json\n{"id": ', event_id, ', "tags": ["a", "b",], "kind": "', event_type, '",\n}\n```')"""


@query("SELECT event_id, event_id AS id, event_type AS kind, CAST(2 AS INTEGER) AS tags FROM events")
def repair_json(spark, d):
    said = files.model_json(F.expr(ANSWER.replace("\n", "\\n")), "id long, tags array<string>, kind string")
    return read(spark, d, "events").select("event_id", said["id"].alias("id"), said["kind"].alias("kind"), F.size(said["tags"]).alias("tags"))


@query("SELECT o_orderkey, 1 AS triples, concat('of order ', o_orderkey) AS summary, 'orders' AS topic FROM orders")
def parse_sections(spark, d):
    answer = F.concat(F.lit("---TRIPLES---\n"), F.col("o_orderpriority"), F.lit(" | has status | "), F.col("o_orderstatus"), F.lit("x\nno triple\n---SUMMARY---\nof order "), F.col("o_orderkey"), F.lit("\n---TOPIC---\norders"))
    said = A.sectioned(answer)
    return read(spark, d, "orders").select("o_orderkey", F.size(said["triples"]).alias("triples"), said["summary"].alias("summary"), said["topic"].alias("topic"))


QUESTION = "concat(text, CASE turn % 6 WHEN 0 THEN ' 上次 ' WHEN 1 THEN '我喜欢' WHEN 2 THEN ' 总结去年' WHEN 3 THEN '还记得' ELSE '' END)"


@query(f"""WITH q AS (SELECT conv_id, turn, {QUESTION} AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(q, '上次') OR contains(q, '记得') THEN 'episodic' WHEN contains(q, '我喜欢') THEN 'semantic' WHEN contains(q, '总结') THEN 'reflection' ELSE 'default' END AS intent,
  contains(q, '上次 ') OR contains(q, '还记得') AS detail, contains(q, '去年') AS historical,
  CASE WHEN contains(q, '去年') THEN 730 WHEN contains(q, '上次') OR contains(q, '记得') THEN 7 ELSE 30 END AS days FROM q""")
def detect_intent(spark, d):
    q = read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.expr(QUESTION), F.lit("")).alias("q"))
    kind, old = I.intent(F.col("q")), I.historical(F.col("q"))
    return q.select("conv_id", "turn", kind.alias("intent"), I.asks_details(F.col("q")).alias("detail"), old.alias("historical"), S.time_window(kind, old).alias("days"))


@query("""SELECT event_id, printf('[%s] (sim: %.3f, imp: %s) event %d', upper(event_type), floor(value) / 100, CASE WHEN event_id % 4 = 0 THEN 'N/A' ELSE '0.50' END, event_id) AS line FROM events""")
def memory_lines(spark, d):
    weight = F.when(F.col("event_id") % 4 != 0, 0.5)
    line = I.memory_line(F.col("event_type"), F.floor("value") / 100, weight, F.concat(F.lit("event "), F.col("event_id")))
    return read(spark, d, "events").select("event_id", line.alias("line"))


def _markdown(newline: str) -> str:
    return (
        f"concat('# One{newline}## Two{newline}{newline}', CASE WHEN doc_id % 2 = 0 THEN '- item{newline}{newline}' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN '```py{newline}x{newline}```{newline}{newline}' ELSE '' END, "
        f"CASE WHEN doc_id % 5 = 0 THEN '|a|b|{newline}|-|-|{newline}{newline}### Three{newline}' ELSE '' END, replace(coalesce(text, ''), '{newline}', '{newline}{newline}'))"
    )


MARKDOWN = _markdown("\n")


@query(rf"""WITH m AS (SELECT doc_id, {MARKDOWN} AS m FROM documents),
f AS (SELECT doc_id, m, regexp_extract_all(m, '(?m)^#{{1,6}}\s+[^\n]+') AS h, list_filter(string_split_regex(m, '\n\n+'), lambda p: length(trim(p, E' \t\n\r\f' || chr(11))) > 20) AS p FROM m),
s AS (SELECT doc_id, len(h) AS headings, len(list_distinct(list_transform(h, lambda x: length(regexp_extract(x, '^#+'))))) AS levels, len(p) AS paragraphs,
  regexp_matches(m, '(?s)```\w*\n.*?```') AS code, regexp_matches(m, '\|[^\n]+\|[\r\n]+\|[-:| ]+\|') AS tab, regexp_matches(m, '(?m)^\s*[-*+]\s+') OR regexp_matches(m, '(?m)^\s*[0-9]+\.\s+') AS list FROM f)
SELECT doc_id, CAST(headings AS INTEGER) AS headings, CAST(levels AS INTEGER) AS levels, CAST(paragraphs AS INTEGER) AS paragraphs, round((CASE WHEN headings >= 3 THEN 0.4 ELSE 0 END + CASE WHEN levels >= 2 THEN 0.2 ELSE 0 END
  + CASE WHEN code THEN 0.1 ELSE 0 END + CASE WHEN tab THEN 0.1 ELSE 0 END + CASE WHEN list THEN 0.1 ELSE 0 END + CASE WHEN paragraphs > 5 THEN 0.1 ELSE 0 END)::DOUBLE, 3) AS score FROM s""")
def markdown_structure(spark, d):
    f = read(spark, d, "documents").select("doc_id", D.markdown_features(F.expr(_markdown("\\n"))).alias("f"))
    return f.select("doc_id", "f.headings", "f.levels", "f.paragraphs", F.round(D.markdown_structure(F.col("f")), 3).alias("score"))


@query(rf"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace({MARKDOWN}, '(?m)^(#{{1,6}}[ \t]+[^ \t\n\r\f\v])', chr(1) || '\1', 'g'), chr(1))) AS p FROM documents)
SELECT doc_id, trim(regexp_extract(p, '^#{{1,6}}[ \t]+([^\n]*)', 1), ' ') AS title, count(*) AS n, CAST(sum(length(p)) AS BIGINT) AS n_chars FROM p WHERE starts_with(p, '#') GROUP BY ALL""")
def markdown_sections(spark, d):
    parts = D.sections(read(spark, d, "documents").select("doc_id", F.expr(_markdown("\\n")).alias("text")))
    return parts.where("title IS NOT NULL").groupBy("doc_id", "title").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"))


@query(r"""WITH p AS (SELECT doc_id, unnest(range((length(text) + 1999) // 2000)) AS piece, text FROM documents), c AS (SELECT doc_id, piece, trim(substring(text, piece * 2000 + 1, 2000), E' \t\n\r\f' || chr(11)) AS c FROM p)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, length(c)::INTEGER AS n_chars, md5(c) AS hash FROM c WHERE length(c) >= 100""")
def fixed_pieces(spark, d):
    return D.fixed_pieces(read(spark, d, "documents")).select("doc_id", "piece", F.length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("hash"))


TERM = "CASE p_partkey % 6 WHEN 0 THEN 'pg_' || lower(p_type) WHEN 1 THEN lower(p_brand) || 'Index' WHEN 2 THEN 'max_buffer' WHEN 3 THEN lower(p_brand) || '_backup' WHEN 4 THEN 'pg_dump_index' ELSE lower(p_type) END"


@query(f"""WITH t AS (SELECT p_partkey AS id, {TERM} AS t FROM part), r AS (SELECT id, unnest([CASE WHEN starts_with(t, 'pg_') THEN 'system_object is_a' END, CASE WHEN ends_with(lower(t), 'index') THEN 'index part_of' END,
  CASE WHEN ends_with(t, 'buffer') THEN 'memory part_of' END, CASE WHEN regexp_matches(t, '^(shared|max|min|default)_') THEN 'configuration is_a' END, CASE WHEN regexp_matches(t, 'dump|restore|backup|import|export$') THEN 'tool is_a' END]) AS r FROM t)
SELECT id, split_part(r, ' ', 1) AS target, split_part(r, ' ', 2) AS type, 0.8::DOUBLE AS weight FROM r WHERE r IS NOT NULL""")
def structural_relations(spark, d):
    return G.structural_relations(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(TERM).alias("normalized"))).select("id", "target", "type", "weight")


CANDIDATE = "CASE p_partkey % 10 WHEN 8 THEN 'Distinct' WHEN 9 THEN 'max_wal_size' WHEN 0 THEN 'pg_stat' WHEN 1 THEN 'PgPgPg' WHEN 2 THEN 'BufferPool' WHEN 3 THEN 'hash-join' WHEN 4 THEN 'x-ray' WHEN 5 THEN 'WAL' WHEN 6 THEN 'nested hash' ELSE 'plain words' END"


@query(f"""WITH t AS (SELECT p_partkey AS id, {CANDIDATE} AS term, p_size / 10.0 AS score FROM part)
SELECT id, term, CASE term WHEN 'pg_stat' THEN 'tool' WHEN 'BufferPool' THEN 'component' WHEN 'WAL' THEN 'entity' WHEN 'max_wal_size' THEN 'parameter' ELSE 'concept' END AS type,
  CASE term WHEN 'max_wal_size' THEN 'whitelist' WHEN 'pg_stat' THEN 'regex' WHEN 'BufferPool' THEN 'regex' ELSE 'statistical' END AS source, 'database.' || lower(term) AS namespace,
  CASE term WHEN 'max_wal_size' THEN 1.0 WHEN 'pg_stat' THEN 0.95 WHEN 'BufferPool' THEN 0.85 WHEN 'hash-join' THEN 0.75 WHEN 'WAL' THEN CASE WHEN score > 2 THEN 0.7 END WHEN 'nested hash' THEN CASE WHEN score > 3 THEN 0.6 END END::DOUBLE AS confidence
FROM t WHERE term IN ('pg_stat', 'BufferPool', 'hash-join', 'max_wal_size') OR (term = 'WAL' AND score > 2) OR (term = 'nested hash' AND score > 3)""")
def filter_candidates(spark, d):
    terms = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(CANDIDATE).alias("term"), (F.col("p_size") / 10.0).alias("score"))
    return X.filter_terms(terms, "database", ["hash", "index"], ["max_wal_size", "distinct"]).select("id", "term", "type", "source", "namespace", "confidence")


@query("""WITH m AS (SELECT concat(event_type, '-', user_id % 50) AS name, event_type AS type, ts FROM events)
SELECT name, type, count(*) AS mention_count, min(ts) AS first_seen_at, max(ts) AS last_mentioned_at FROM m GROUP BY ALL""")
def entity_upsert(spark, d):
    mentions = read(spark, d, "events").select(F.expr("concat(event_type, '-', user_id % 50)").alias("name"), F.col("event_type").alias("type"), "ts")
    return M.count_entities(mentions)


def _orders(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_totalprice").alias("weight"), (F.col("o_custkey") % 7).alias("access_count"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS type, CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE ELSE o_totalprice END AS weight, o_custkey % 7 AS access_count FROM orders")
def memory_upsert(spark, d):
    old = _orders(spark, d)
    return M.upsert(old, old.where("id % 3 = 0").withColumn("type", F.lit("new")).withColumn("weight", F.lit(0.5)), "id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'patched' ELSE o_orderstatus END AS type, CASE WHEN o_orderkey % 4 = 0 THEN 0.25::DOUBLE ELSE o_totalprice END AS weight, o_custkey % 7 AS access_count FROM orders")
def memory_patch(spark, d):
    old = _orders(spark, d)
    return M.patch(old, old.where("id % 2 = 0").select("id", F.lit("patched").alias("type"), F.when(F.col("id") % 4 == 0, 0.25).alias("weight")), "id")


@query("SELECT o_orderkey AS id, o_orderstatus AS type, o_totalprice AS weight, o_custkey % 7 AS access_count FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def memory_delete(spark, d):
    gone = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "inner")
    return M.delete(_orders(spark, d), gone.select(F.col("o_orderkey").alias("id")), "id")


@query("WITH u AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, o_custkey % 7 + coalesce(n, 0) AS access_count FROM orders LEFT JOIN u ON l_orderkey = o_orderkey")
def access_increment(spark, d):
    return M.increment(_orders(spark, d), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")), "id").select("id", "access_count")


@query("SELECT o_orderkey AS id, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS is_active FROM orders")
def memory_supersede(spark, d):
    old = _orders(spark, d).withColumn("is_active", F.lit(True))
    return M.supersede(old, read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), "id").select("id", "is_active")


@query("""SELECT p_brand AS normalized, p_type AS domain, CAST(sum(p_size) AS BIGINT) AS frequency, array_to_string(list_sort(list(DISTINCT 'd' || p_partkey % 3)), ' ') AS docs, max(p_retailprice) AS confidence FROM part GROUP BY ALL""")
def term_store(spark, d):
    mentions = read(spark, d, "part").select(F.col("p_brand").alias("normalized"), F.col("p_type").alias("domain"), F.col("p_size").alias("frequency"), F.expr("'d' || p_partkey % 3").alias("doc"), F.col("p_retailprice").alias("confidence"))
    return M.store_terms(mentions).withColumn("docs", F.array_join("docs", " "))


@query(f"""WITH {EDGES}, m AS (SELECT memory, CASE WHEN entity % 4 = 3 THEN entity - 1 ELSE entity END AS entity, CASE WHEN entity % 4 = 3 THEN 0.9 ELSE weight END::DOUBLE AS weight FROM edges)
SELECT memory, entity, max(weight) AS weight FROM m GROUP BY ALL""")
def merge_entities(spark, d):
    aliases = read(spark, d, "part").where("p_partkey % 4 = 3").select(F.col("p_partkey").alias("alias"), (F.col("p_partkey") - 1).alias("canonical"))
    return G.repoint(edges(spark, d), aliases)


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS doc_id, 't' || l_suppkey % 40 AS term FROM lineitem), f AS (SELECT term, count(*) AS f FROM t GROUP BY 1),
p AS (SELECT a.term AS "in", b.term AS "out", count(*) AS n FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY ALL HAVING count(*) >= 3)
SELECT "in", "out", n, round(n / least(x.f, y.f), 6) AS weight FROM p JOIN f x ON x.term = "in" JOIN f y ON y.term = "out" WHERE n / least(x.f, y.f) >= 0.1""")
def term_cooccurrence(spark, d):
    terms = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("'t' || l_suppkey % 40").alias("term"))
    return X.term_cooccurrence(terms).withColumn("weight", F.round("weight", 6))


@query(r"""WITH w AS (SELECT conv_id, turn, length(text) AS n, length(text) // 2 AS m FROM conversations)
SELECT conv_id, turn, CAST(ceil(n / 4) AS BIGINT) AS tokens, CASE WHEN ceil(n / 4) = 0 THEN 'over' WHEN ceil(m / 4) / ceil(n / 4) < 0.1 THEN 'over' WHEN ceil(m / 4) / ceil(n / 4) > 0.9 THEN 'under' ELSE 'fine' END AS verdict FROM w WHERE n IS NOT NULL""")
def compression_ratio(spark, d):
    talk = read(spark, d, "conversations").where("text IS NOT NULL")
    full, short = S.token_estimate(F.col("text")), S.token_estimate(F.expr("substring(text, 1, CAST(floor(length(text) / 2) AS INT))"))
    return talk.select("conv_id", "turn", full.alias("tokens"), S.compression(full, short)["verdict"].alias("verdict"))


@query(None)
def embed_texts(spark, d):
    found = models.embed(read(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn")), "key", "text", models.hashed_encoder(), "document")
    return found.select("key.conv_id", "key.turn", F.size("embedding").alias("size"), F.round(S.norm(F.col("embedding")), 6).alias("norm"))
