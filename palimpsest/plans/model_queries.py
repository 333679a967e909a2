"""Queries of entities, of models' answers and of the steps around models, with their SQL.

The models here are plain functions of their prompts, so that SQL can say what they answer.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import answers as A, entities as E
from ..operators import memories as P
from ..sources.models import hashed_encoder
from .queries import query, read

NAMED = """concat(coalesce(text, ''), CASE doc_id % 5 WHEN 0 THEN ' Postgres and TS with github, postgres' WHEN 1 THEN ' python; Py k8s on AWS' WHEN 2 THEN ' hugging face LLM ci/cd c++x C# y' WHEN 3 THEN ' machine learning with MySQL,go' ELSE '' END)"""
_ALIASES = ", ".join(f"('{a}', '{n}')" for a, n in E.ALIASES.items())
_KINDS = ", ".join(f"({i}, '{k}', '(?i)\\b({p})\\b')" for i, (k, p) in enumerate(E.KINDS.items()))


@query(f"""WITH alias(a, n) AS (VALUES {_ALIASES}), kind(i, entity_type, p) AS (VALUES {_KINDS}), d AS (SELECT doc_id, {NAMED} AS t FROM documents),
m AS (SELECT doc_id, i, entity_type, unnest(regexp_extract_all(t, p)) AS original, generate_subscripts(regexp_extract_all(t, p), 1) AS place FROM d, kind),
e AS (SELECT m.*, coalesce(n, upper(original[1]) || original[2:]) AS name FROM m LEFT JOIN alias ON a = lower(original))
SELECT doc_id, name, entity_type, original, CASE lower(name) WHEN 'postgresql' THEN 0.95 WHEN 'python' THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence, CASE WHEN lower(name) IN ('postgresql', 'python') THEN 'cache' ELSE 'regex' END AS source
FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY i, place) = 1""")
def entity_patterns(spark, d):
    known = spark.createDataFrame([("postgres", 0.95), ("Python", 0.6), ("Oslo", 0.9)], "name string, confidence double")
    return E.extract_entities(read(spark, d, "documents").select("doc_id", F.expr(NAMED).alias("t")), "doc_id", "t", known)


LISTED = """CASE event_id % 4 WHEN 0 THEN concat('Here: {"entities": [{"name": "ts", "confidence": 0.5}, {"name": "', event_type, '"}]} done') WHEN 1 THEN '{"entities": 5}' WHEN 2 THEN concat('"k8s": 0.9
the
"', event_type, '"') ELSE '{broken' END"""


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('TypeScript=0.5;', upper(event_type[1]) || event_type[2:], '=0.7') WHEN 1 THEN '' WHEN 2 THEN concat('Kubernetes=0.9;', upper(event_type[1]) || event_type[2:], '=0.7') ELSE '{broken=0.7' END AS entities FROM events""")
def answered_entities(spark, d):
    found = E.answered_entities(F.expr(LISTED.replace("\n", "\\n")))
    return read(spark, d, "events").select("event_id", F.array_join(F.transform(found, lambda e: F.concat(e["name"], F.lit("="), e["confidence"].cast("string"))), ";").alias("entities"))


TECHNICAL = "concat(coalesce(text, ''), CASE doc_id % 3 WHEN 0 THEN ' MAX_SIZE in app.py, UserService; /api/v1/users' WHEN 1 THEN ' std::vec main.ts MAX_SIZE main.ts' ELSE '' END)"
_TECHNICAL = ", ".join(f"({i}, '{p}')" for i, p in enumerate(E.TECHNICAL))


@query(f"""WITH p(i, p) AS (VALUES {_TECHNICAL}), d AS (SELECT doc_id, {TECHNICAL} AS t FROM documents),
m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, p)) AS name FROM d, p)
SELECT doc_id, count(*) AS names, string_agg(name, ' ' ORDER BY name) AS list FROM m GROUP BY doc_id""")
def technical_names(spark, d):
    names = E.technical_names(F.expr(TECHNICAL))
    return read(spark, d, "documents").select("doc_id", names.alias("n")).where("size(n) > 0").select("doc_id", F.size("n").cast("long").alias("names"), F.array_join(F.array_sort("n"), " ").alias("list"))


@query("""SELECT o_orderkey, 2 AS triples, concat(o_orderpriority, '/has/', o_orderstatus) AS first_triple, concat('of order ', o_orderkey, ' in two lines') AS summary, 'last' AS topic FROM orders""")
def parse_block(spark, d):
    said = F.concat(F.lit("---TRIPLES---\n"), F.col("o_orderpriority"), F.lit(" | has | "), F.col("o_orderstatus"), F.lit("\n===\na|b\na|b|c|d\n---SUMMARY---\nof order "), F.col("o_orderkey"), F.lit("\n\n in two lines\n---TOPIC---\nfirst\nlast"))
    rows = read(spark, d, "orders").select("o_orderkey", A.block(said).alias("b"))
    first = F.concat_ws("/", F.col("b.triples")[0]["subject"], F.col("b.triples")[0]["relation"], F.col("b.triples")[0]["obj"])
    return rows.select("o_orderkey", F.size("b.triples").alias("triples"), first.alias("first_triple"), "b.summary", "b.topic")


@query("""SELECT o_orderkey, unnest([0, 1, 2]) AS block, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END, 0, 0]) AS triples, unnest([CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, '', '']) AS summary FROM orders""")
def parse_batch(spark, d):
    said = F.concat(F.lit('Yes: [{"triples": [{"subject": "a", "relation": "b", "obj": "c"}], "summary": "'), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, '"').otherwise('"}, {"summary": "x"}]'))
    rows = read(spark, d, "orders").select("o_orderkey", F.posexplode(A.batch(said, F.lit(3))).alias("block", "b"))
    return rows.select("o_orderkey", "block", F.size("b.triples").alias("triples"), "b.summary")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Unknown theme' ELSE o_orderpriority END AS theme, 2 AS members FROM orders WHERE o_orderkey % 5 <> 0""")
def parse_clusters(spark, d):
    theme = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority"))
    said = F.concat(F.lit('{"clusters": [{"theme": "'), theme, F.when(F.col("o_orderkey") % 5 != 0, '", "memory_indices": [0, 2]}, {"theme": "one", "memory_indices": [1]}]}').otherwise('"'))
    rows = read(spark, d, "orders").select("o_orderkey", F.explode(A.clusters(said)).alias("c"))
    return rows.select("o_orderkey", "c.theme", F.size("c.places").alias("members"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS content, CASE WHEN o_orderkey % 3 <> 0 THEN 0.75 ELSE 0 END::DOUBLE AS confidence,
CASE WHEN o_orderkey % 3 <> 0 THEN 'No reason provided' ELSE 'Failed to parse JSON output' END AS reason FROM orders""")
def parse_merge(spark, d):
    said = F.concat(F.lit('So {"merged_content": "'), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 != 0, '", "confidence": 0.75}').otherwise('",'))
    return read(spark, d, "orders").select("o_orderkey", A.merged(said).alias("m")).select("o_orderkey", "m.content", "m.confidence", "m.reason")


def _typed(double: str) -> list[str]:
    kind = "CASE turn % 3 WHEN 0 THEN 'reflection' WHEN 1 THEN 'semantic' ELSE 'episodic' END AS type"
    return ["conv_id * 1000 + turn AS id", kind, "text AS content", f"0.5{double} AS importance", f"(70 + (conv_id + turn) % 30) / 100.0{double} AS similarity"]


@query(f"""WITH m AS (SELECT {', '.join(_typed('::DOUBLE'))} FROM conversations), h AS (SELECT *, CASE WHEN type = 'episodic' AND similarity >= 0.7 THEN 1 WHEN type = 'semantic' AND similarity >= 0.8 THEN 2 WHEN type = 'reflection' AND similarity >= 0.85 THEN 3 END AS level,
  list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: length(x) > 3)) AS w FROM m),
c AS (SELECT a.id, count(*) AS n, string_agg(b.id::VARCHAR, ',' ORDER BY b.id) AS children FROM h a JOIN h b ON a.level = 3 AND b.level = 2 AND a.content <> b.content AND list_has_any(a.w, b.w) AND len(list_intersect(a.w, b.w)) > 0.5 * len(list_distinct(list_concat(a.w, b.w))) GROUP BY a.id)
SELECT level, h.id, coalesce(n, 0) AS n_children, coalesce(children, '') AS children FROM h LEFT JOIN c ON c.id = h.id WHERE level IS NOT NULL""")
def memory_hierarchy(spark, d):
    typed = read(spark, d, "conversations").selectExpr(*_typed("D"))
    ids = F.array_join(F.transform("children", lambda c: c["id"].cast("string")), ",")
    return P.hierarchy(typed).select("level", "id", F.coalesce(F.size("children"), F.lit(0)).cast("long").alias("n_children"), F.coalesce(ids, F.lit("")).alias("children"))


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), s AS (SELECT DISTINCT conv_id FROM c),
part AS (SELECT conv_id, 1 AS k, concat('## Reflections', chr(10), string_agg('- ' || text, chr(10) ORDER BY turn), chr(10)) AS t FROM (SELECT * FROM c WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5) GROUP BY conv_id
UNION ALL SELECT conv_id, 2, concat('## User Preferences', chr(10), string_agg('- ' || role || ': ' || turn, chr(10) ORDER BY turn), chr(10)) FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 25) GROUP BY conv_id
UNION ALL SELECT conv_id, 3, concat('## Relevant Memories', chr(10), string_agg('- [' || role || '] ' || text, chr(10) ORDER BY turn), chr(10)) FROM (SELECT * FROM c WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 15) GROUP BY conv_id
UNION ALL SELECT conv_id, 4, concat('## Recent Conversation', chr(10), array_to_string(list_transform(range(1, 76), lambda x: 'line ' || x), chr(10)), chr(10), '... (', conv_id % 7 + 1, ' more lines)', chr(10)) FROM s)
SELECT conv_id::VARCHAR AS session_id, concat('# Memory Context for Session: ', conv_id, chr(10), string_agg(t, chr(10) ORDER BY k)) AS context FROM part GROUP BY conv_id""")
def session_context(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("conv_id"), F.col("turn").alias("place"), "role", F.coalesce("text", F.lit("")).alias("content"))
    lines = F.array_join(F.transform(F.sequence(F.lit(1), (75 + F.col("conv_id") % 7 + 1).cast("int")), lambda x: F.concat(F.lit("line "), x)), "\n")
    said = c.select("session_id", "conv_id").distinct().select("session_id", lines.alias("text"))
    reflections = c.where("role = 'user'").withColumnRenamed("content", "summary")
    preferences = c.select("session_id", "place", F.col("role").alias("category"), F.col("place").cast("string").alias("item"))
    return P.context(c, c.where("role = 'assistant'").withColumnRenamed("role", "type"), reflections, preferences, said)


def _summarise(prompts: list[str]) -> list[str]:
    return ["No significant content." if len(p) % 3 == 0 else p[:30] for p in prompts]


@query("""WITH t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM (SELECT * FROM conversations WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20) GROUP BY conv_id),
a AS (SELECT conv_id, t, length(t) % 3 = 0 AS is_empty, CASE WHEN length(t) % 3 = 0 THEN 'No significant content.' ELSE t[1:30] END AS a FROM t)
SELECT conv_id, CASE WHEN is_empty THEN '' ELSE a END AS summary, is_empty, CASE WHEN a <> '' THEN ceil(length(a) / 4) / ceil(length(t) / 4) END AS ratio FROM a""")
def session_summaries(spark, d):
    return P.summaries(read(spark, d, "conversations"), "conv_id", "text", _summarise, "turn")


def _profile(prompts: list[str]) -> list[str]:
    return ["none" if len(p) % 4 == 0 else "Sure: " + json.dumps({"likes": [str(len(p)), "b"], "facts": {"n": len(p)}}) for p in prompts]


@query("""WITH t AS (SELECT conv_id, length(string_agg(text, chr(10) ORDER BY turn)) AS n FROM (SELECT * FROM conversations WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20) GROUP BY conv_id)
SELECT conv_id, CASE WHEN n % 4 = 0 THEN '' ELSE n || ',b' END AS likes, CASE WHEN n % 4 <> 0 THEN n::VARCHAR END AS fact, 0 AS habits FROM t""")
def session_profiles(spark, d):
    found = P.profiles(read(spark, d, "conversations"), "conv_id", "text", _profile, "turn")
    return found.select("conv_id", F.array_join("likes", ",").alias("likes"), F.try_element_at("facts", F.lit("n")).alias("fact"), F.size("habits").alias("habits"))


def _topic(prompts: list[str]) -> list[str]:
    return ["?" if len(p) % 2 else json.dumps({"name": f" t{len(p)}", "description": "of memories"}) for p in prompts]


def _clustered(spark, d):
    clusters = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("cluster"), F.col("vec_id").alias("memory"))
    return clusters, read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@query("""WITH f AS (SELECT label::BIGINT AS cluster, vec_id, text FROM (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5) JOIN documents ON doc_id = vec_id WHERE text <> ''),
p AS (SELECT cluster, length(string_agg(concat('[', k, '] ', text[1:200]), chr(10))) AS n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY vec_id) AS k FROM f) GROUP BY cluster), s AS (SELECT label::BIGINT AS cluster, count(*) AS memories FROM embeddings GROUP BY label)
SELECT s.cluster, CASE WHEN n % 2 = 0 THEN 't' || n ELSE 'Topic-' || s.cluster END AS name, CASE WHEN n % 2 = 0 THEN 'of memories' ELSE concat('Auto-generated topic for ', memories, ' memories') END AS description, memories FROM s LEFT JOIN p ON p.cluster = s.cluster""")
def topic_names(spark, d):
    return P.name_topics(*_clustered(spark, d), _topic)


def _merge(prompts: list[str]) -> list[str]:
    return [json.dumps({"merged_content": f"merged {p.count('[0] ')}", "confidence": 0.9}) for p in prompts]


@query("""WITH h AS (SELECT label::BIGINT AS cluster, count(*) AS memories FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY label)
SELECT cluster, memories, memories > 1 AS merged, CASE WHEN memories > 1 THEN 0.9 ELSE 1 END::DOUBLE AS confidence FROM h""")
def merged_clusters(spark, d):
    found = P.merge_clusters(*_clustered(spark, d), _merge)
    return found.select("cluster", "memories", (F.col("content").startswith("merged ") & F.col("accepted")).alias("merged"), "confidence")


def _relate(prompts: list[str]) -> list[str]:
    out = []
    for p in prompts:
        names = [line[2:].rsplit(" (", 1)[0] for line in p.split("\n\n")[0].split("\n")]
        out.append("\n".join(["Relations:", *[f"{a} | {b} | uses | next" for a, b in zip(names, names[1:])], "x | y | uses", "no | such | is_a | term"]))
    return out


@query("""WITH t AS (SELECT p_size AS doc_id, p_partkey AS id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 10 <> 0)
SELECT a.doc_id::BIGINT AS doc_id, a.id AS "in", b.id AS "out", 'uses' AS relation_type, 0.85::DOUBLE AS weight, 0.9::DOUBLE AS confidence FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.k = a.k + 1 AND b.k <= 20""")
def model_relations(spark, d):
    part = read(spark, d, "part")
    name = F.concat(F.lit("Term"), F.col("p_partkey"))
    terms = part.select(F.col("p_size").cast("long").alias("doc_id"), F.col("p_partkey").alias("id"), name.alias("term"), F.lower(name).alias("normalized"), F.lit("concept").alias("type"), F.lit("database").alias("domain"), F.when(F.col("p_partkey") % 10 == 0, 0.5).otherwise(0.9).alias("confidence"))
    texts = part.select(F.col("p_size").cast("long").alias("doc_id"), F.lit("a text").alias("text")).distinct()
    return P.model_relations(terms, texts, _relate).select("doc_id", "in", "out", "relation_type", "weight", "confidence")


def _extract(prompts: list[str]) -> list[str]:
    return ["nothing" if "5" in p else f"---TRIPLES---\nblock | is | {p}\n---SUMMARY---\nabout {p}\n---TOPIC---\nblocks" for p in prompts]


@query("""WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS block_id, concat('Part ', l_suppkey) AS text, l_returnflag AS v, l_suppkey AS k FROM lineitem), f AS (SELECT k, min(block_id) AS block_id FROM b GROUP BY k),
r AS (SELECT k, count(*) AS ref_count, string_agg(DISTINCT v, '' ORDER BY v) AS versions FROM b WHERE k % 3 = 0 OR NOT contains(text, '5') GROUP BY k)
SELECT 'memory' AS kind, block_id AS n, concat('about Part ', k) AS said FROM f WHERE k % 3 <> 0 AND NOT contains(k::VARCHAR, '5') UNION ALL SELECT 'reference', ref_count, versions FROM r""")
def compile_blocks(spark, d):
    lines = read(spark, d, "lineitem")
    blocks = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block_id"), F.concat(F.lit("Part "), "l_suppkey").alias("text"), F.col("l_returnflag").alias("doc_version"), "l_suppkey")
    known = blocks.where("l_suppkey % 3 = 0").select(P.T.content_hash(F.col("text")).alias("content_hash")).distinct()
    stored, references = P.compile_blocks(blocks, known, _extract, hashed_encoder(16))
    return stored.select(F.lit("memory").alias("kind"), F.col("block_id").alias("n"), F.col("content").alias("said")).union(references.select(F.lit("reference"), "ref_count", F.array_join("doc_versions", "")))


@query("""SELECT vec_id AS id, CASE WHEN vec_id = 7 THEN 'Bob works at Acme' ELSE concat('memory ', vec_id) END AS content, vec_id <> 7 AS is_active FROM embeddings UNION ALL SELECT -1, 'Bob works at Globex', true""")
def checked_store(spark, d):
    memories = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") == 7, "Bob works at Acme").otherwise(F.concat(F.lit("memory "), "vec_id")).alias("content"), "embedding", F.lit(True).alias("is_active"))
    vector = list(memories.where("id = 7").first()["embedding"])
    new = spark.createDataFrame([(-1, "Bob works at Globex")], "id long, content string")
    return P.store_checked(memories, new, "Bob works at Globex", vector).select("id", "content", "is_active")
