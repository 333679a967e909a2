"""Reading models' answers: rankings, labels, triples, clusters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .texts import repetitive, without_repetition

# Kinds of relation that a label may name.
RELATIONS = ["causes", "used_for", "member_of", "located_in", "created_by", "related_to", "no_logical_relation"]
# Headings of an answer's sections.
SECTIONS = {"triples": ["---TRIPLES---", "---三元组---"], "summary": ["---SUMMARY---", "---摘要---"], "topic": ["---TOPIC---", "---主题---"]}
BLANKS = " \t\n\r\f\x0b"


def ranking(answer: Column, n: int) -> Column:
    """The numbers below ``n`>= 1 in the order said, each once, then the rest; without any, or for null, all in order."""
    said = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("bigint"))
    rest = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    return F.array_union(F.filter(said, lambda x: (x >= 0) & (x < n)), rest)


def relation_label(answer: Column) -> Column:
    """Kind, confidence within 0 and 1 and direction; ``related_to`` at 0.5 for what can't be read."""
    said = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "relation_type string, confidence double, reasoning string, reverse_direction boolean, source string")
    kind = F.when(said["relation_type"].isin(*RELATIONS), said["relation_type"]).otherwise("related_to")
    return F.struct(
        kind.alias("relation_type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(said["confidence"], F.lit(0.5)))).alias("confidence"),
        F.coalesce(said["reasoning"], F.lit("")).alias("reasoning"), F.coalesce(said["reverse_direction"], F.lit(False)).alias("reverse"), said["source"].alias("source"),
    )


def _trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def _placed(answer: Column, sections: dict[str, list[str]]) -> Column:
    """The trimmed lines of an answer with the section that each is in."""
    empty = F.struct(F.lit("").alias("at"), F.lit("").alias("line"))

    def follow(state, raw):
        x = _trimmed(raw)
        at = state["at"]
        for name, heads in sections.items():
            at = F.when(x.isin(*heads), name).otherwise(at)
        return F.struct(at.alias("at"), x.alias("line"))

    return F.aggregate(
        F.split(F.coalesce(answer, F.lit("")), "\n"), F.struct(empty.alias("last"), F.array().cast("array<struct<at:string,line:string>>").alias("all")),
        lambda s, x: F.struct(follow(s["last"], x).alias("last"), F.concat(s["all"], F.array(follow(s["last"], x))).alias("all")), lambda s: s["all"],
    )


def sectioned(answer: Column, triples: int = 15, summary: int = 200, topic: int = 50) -> Column:
    """Triples, summary and topic of an answer in sections of ``a | b | c`` lines and text.

    Triples with a blank, long or repetitive part are left out. Null gives empty values.
    """
    line, placed = _trimmed, _placed(answer, SECTIONS)
    said = F.filter(placed, lambda p: (p["line"] != "") & ~p["line"].startswith("---"))
    of = lambda name: F.transform(F.filter(said, lambda p: p["at"] == name), lambda p: p["line"])

    def triple(x):
        parts = F.split(x, r"\|", 3)
        return F.struct(line(parts[0]).alias("subject"), line(parts[1]).alias("relation"), line(parts[2]).alias("obj"))

    fine = lambda x: (x != "") & (F.length(x) < 100) & ~repetitive(x)
    whole = F.transform(F.filter(of("triples"), lambda x: F.size(F.split(x, r"\|")) >= 3), triple)
    whole = F.filter(whole, lambda t: fine(t["subject"]) & fine(t["relation"]) & fine(t["obj"]))
    first = lambda names: F.coalesce(F.get(names, 0), F.lit(""))
    text = first(F.filter(of("summary"), lambda x: (F.length(x) > 5) & ~x.contains("---")))
    return F.struct(
        F.slice(whole, 1, triples).alias("triples"), F.substring(without_repetition(text), 1, summary).alias("summary"), F.substring(first(of("topic")), 1, topic).alias("topic")
    )


def block(answer: Column, triples: int = 20, summary: int = 300, topic: int = 50) -> Column:
    """As ``sectioned``, with English headings only, all triples, all lines of the summary and the last of the topic."""
    said = F.filter(_placed(answer, {k: v[:1] for k, v in SECTIONS.items()}), lambda p: (p["line"] != "") & ~p["line"].startswith("===") & ~p["line"].isin(*[v[0] for v in SECTIONS.values()]))
    of = lambda name: F.transform(F.filter(said, lambda p: p["at"] == name), lambda p: p["line"])
    parts = F.filter(F.transform(of("triples"), lambda x: F.split(x, r"\|")), lambda p: F.size(p) >= 3)
    whole = F.transform(parts, lambda p: F.struct(_trimmed(p[0]).alias("subject"), _trimmed(p[1]).alias("relation"), _trimmed(p[2]).alias("obj")))
    last = F.coalesce(F.try_element_at(of("topic"), F.lit(-1)), F.lit(""))
    return F.struct(F.slice(whole, 1, triples).alias("triples"), F.substring(F.array_join(of("summary"), " "), 1, summary).alias("summary"), F.substring(last, 1, topic).alias("topic"))


def batch(answer: Column, n: Column, triples: int = 20, part: int = 100, summary: int = 300) -> Column:
    """Triples and summary of each of ``n`` blocks of one answer, a JSON array; empty ones for what can't be read."""
    said = F.from_json(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\[.*\]", 0), "array<struct<triples: array<struct<subject: string, relation: string, obj: string>>, summary: string>>")
    text = lambda x, most: F.substring(F.coalesce(x, F.lit("")), 1, most)
    none = F.array().cast("array<struct<subject: string, relation: string, obj: string>>")

    def one(i):
        own = F.get(said, i)
        clipped = F.transform(F.slice(own["triples"], 1, triples), lambda t: F.struct(text(t["subject"], part).alias("subject"), text(t["relation"], part).alias("relation"), text(t["obj"], part).alias("obj")))
        fine = own["triples"].isNotNull()
        return F.struct(F.when(fine, clipped).otherwise(none).alias("triples"), F.when(fine, text(own["summary"], summary)).otherwise("").alias("summary"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), one))


def clusters(answer: Column) -> Column:
    """Theme and positions of the clusters of two or more that an answer's JSON lists; none where it can't be read."""
    said = F.from_json(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0), "clusters array<struct<theme: string, memory_indices: array<int>>>")["clusters"]
    theme = lambda c: F.when(F.coalesce(c["theme"], F.lit("")) != "", c["theme"]).otherwise("Unknown theme")
    several = F.transform(F.filter(said, lambda c: F.size(c["memory_indices"]) > 1), lambda c: F.struct(theme(c).alias("theme"), c["memory_indices"].alias("places")))
    return F.coalesce(several, F.array().cast("array<struct<theme: string, places: array<int>>>"))


def merged(answer: Column) -> Column:
    """Content, entities, confidence and reason of a merge; null content and 0 where it can't be read."""
    text = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    said = F.from_json(text, "merged_content string, entities array<string>, confidence double, reason string")
    reason = F.when(F.coalesce(said["reason"], F.lit("")) != "", said["reason"]).otherwise("No reason provided")
    return F.struct(
        said["merged_content"].alias("content"), F.coalesce(said["entities"], F.array().cast("array<string>")).alias("entities"), F.coalesce(said["confidence"], F.lit(0.0)).alias("confidence"),
        F.when(F.try_parse_json(text).isNull(), "Failed to parse JSON output").otherwise(reason).alias("reason"),
    )


def profile(answer: Column) -> Column:
    """Likes, dislikes, facts and habits; empty ones for what can't be read."""
    said = F.from_json(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0), "likes array<string>, dislikes array<string>, facts map<string, string>, habits array<string>")
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(said["likes"], none).alias("likes"), F.coalesce(said["dislikes"], none).alias("dislikes"),
        F.coalesce(said["facts"], F.create_map().cast("map<string, string>")).alias("facts"), F.coalesce(said["habits"], none).alias("habits"),
    )
