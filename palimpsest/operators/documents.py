"""Documents: chunks, structure, context windows, samples."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.texts import KEYWORD_STOPWORDS

_STOP = frozenset(KEYWORD_STOPWORDS)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def chunk_text(text: str, size: int = 500, paragraph: str = r"\n\n+") -> list[str]:
    """Chunks of whole paragraphs up to ``size`` characters, or 1.5 times that; larger paragraphs by sentences; small ones joined.

    No text is lost: the chunks' words are the text's.
    """
    pieces: list[str] = []
    for p in filter(None, (x.strip() for x in re.split(paragraph, text))):
        if len(p) <= 1.5 * size:
            pieces.append(p)
            continue
        held = ""
        for s in filter(None, (x.strip() for x in _SENTENCE.split(p))):
            if held and len(held) + 1 + len(s) > size:
                pieces.append(held)
                held = s
            else:
                held = f"{held} {s}" if held else s
        pieces += [held] if held else []
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) < 0.3 * size and len(out[-1]) + 2 + len(p) <= 1.5 * size:
            out[-1] = f"{out[-1]}\n\n{p}"
        else:
            out.append(p)
    return out


def chunks(docs: DataFrame, size: int = 500, paragraph: str = r"\n\n+") -> DataFrame:
    """doc_id, chunk number and content of every document's chunks (H31, H75); null texts have none."""

    def run(batches):
        for batch in batches:
            rows = [(d, k, c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, c in enumerate(chunk_text(t or "", size, paragraph))]
            ids, places, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "chunk", "content"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, chunk int, content string")


#: Words that say too little to tell a topic by are those of ``functions.texts``.
def topic_words(paragraph: str) -> set[str]:
    """The first twenty words over three letters that are no stopwords (as the expression ``keywords`` has them)."""
    own = re.split(r"[ \t\n\r\f\v]+", re.sub(r"[^A-Za-z0-9_ \t\n\r\f\v]", " ", paragraph.lower()))
    return set([w for w in own if len(w) > 3 and w not in _STOP][:20])


def shifts(before: str, after: str, least: float = 0.2) -> bool:
    """Whether two paragraphs share too few words to be of one topic."""
    a, b = topic_words(before), topic_words(after)
    return (len(a & b) / max(len(a), len(b)) if a and b else 0.0) < least


def topic_groups(paragraphs: list[str], most: int) -> list[list[str]]:
    """Runs of paragraphs of one topic, ``most`` characters at most unless one paragraph has more."""
    groups: list[list[str]] = []
    size = 0
    for k, p in enumerate(paragraphs):
        if k == 0 or size + len(p) > most or shifts(paragraphs[k - 1], p):
            groups.append([])
            size = 0
        groups[-1].append(p)
        size += len(p)
    return groups


def packed(parts: list[str], size: int, between: str) -> list[str]:
    """Parts joined while they stay within ``size`` characters; a longer part stands alone."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(between) + len(p) <= size:
            out[-1] += between + p
        else:
            out.append(p)
    return out


def topic_chunks(text: str, size: int = 500) -> list[tuple[str, str]]:
    """(content, kind) of a document's chunks (H31, H35, H36): paragraphs by topic; too long groups by sentences; small ones joined.

    All words are kept, in order. A chunk of over 1.8 times ``size`` is divided once more, by paragraphs if it has some.
    """
    sentences = lambda t: packed([x for x in (s.strip() for s in _SENTENCE.split(t)) if x], size, " ")
    paragraphs = [p for p in (x.strip() for x in re.split(r"\n\n+", text)) if p]
    first: list[tuple[str, str]] = []
    for group in topic_groups(paragraphs, int(1.5 * size)):
        whole = "\n\n".join(group)
        first += [(s, "sentence") for s in sentences(whole)] if len(whole) > int(1.5 * size) else [(whole, "semantic")]
    joined: list[tuple[str, str]] = []
    for content, kind in first:
        if joined and len(joined[-1][0]) < int(0.3 * size) and len(joined[-1][0]) + len(content) <= size:
            joined[-1] = f"{joined[-1][0]}\n\n{content}", joined[-1][1]
        else:
            joined.append((content, kind))
    out: list[tuple[str, str]] = []
    for content, kind in joined:
        parts = [p for p in re.split(r"\n\n+", content) if p.strip()]
        if len(content) <= int(1.5 * size) * 1.2:
            out.append((content, kind))
        elif len(parts) > 1:
            out += [(p, "paragraph") for p in packed(parts, size, "\n\n")]
        else:
            out += [(s, "sentence") for s in sentences(content)]
    return out


def _each_text(docs: DataFrame, rows_of, schema: str, types: list) -> DataFrame:
    """doc_id and what ``rows_of`` makes of each text that isn't null."""

    def run(batches):
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None for r in rows_of(t)]
            columns = zip(*rows) if rows else ((),) * (len(types) + 1)
            names = [c.split()[0] for c in f"doc_id long, {schema}".split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *types])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {schema}")


def split_by_topic(docs: DataFrame, size: int = 500) -> DataFrame:
    """doc_id, chunk, total, content and kind of every document's chunks (H31); null texts have none."""

    def rows(text):
        parts = topic_chunks(text, size)
        return [(k, len(parts), c, kind) for k, (c, kind) in enumerate(parts)]

    return _each_text(docs, rows, "chunk int, total int, content string, kind string", [pa.int32(), pa.int32(), pa.string(), pa.string()])


# Words that tell what a paragraph is, in the order they are looked for.
UNIT_WORDS = [("procedure", ["步骤", "首先"]), ("example", ["例如", "示例"]), ("reference", ["参考", "参见"])]
UNIT_KINDS = ["concept", "procedure", "example", "reference", "overview"]
_HEADING = re.compile(r"(#{1,6})\s+(.+)")


def semantic_units(text: str, most: int = 2000, least: int = 100) -> list[tuple[str | None, str, str]]:
    """(section title, kind, content) of runs of paragraphs between headings.

    A run ends at a heading or once it has ``most`` characters; those under ``least`` aren't given. A
    paragraph with one of the words, or a number first, gives its run that kind, which lasts until a full run ends.
    """
    out: list[tuple[str | None, str, str]] = []
    title, kind, held = None, "concept", ""

    def end() -> str:
        if len(held) >= least:
            out.append((title, kind, held.strip()))
        return ""

    for p in re.split(r"\n\n+", text):
        heading = _HEADING.fullmatch(p)
        if heading:
            held = end()
            title = heading[2].strip()
            continue
        said = next((k for k, words in UNIT_WORDS if any(w in p for w in words) or (k == "procedure" and re.match(r"[0-9]+\.", p))), None)
        kind = said or kind
        held += p + "\n\n"
        if len(held) >= most:
            held, kind = end(), "concept"
    end()
    return out


def sections_of(text: str) -> list[tuple[str, int, int, int]]:
    """(title, level, start, end) of every heading's line, in characters."""
    out, at = [], 0
    for line in text.split("\n"):
        heading = _HEADING.fullmatch(line)
        if heading:
            out.append((heading[2].strip(), len(heading[1]), at, at + len(line)))
        at += len(line) + 1
    return out


def section_blocks(text: str, most: int = 2000, least: int = 100) -> list[tuple[str | None, str, str]]:
    """(section title, kind, content) of what follows each heading up to the next; long ones by paragraphs."""
    heads = sections_of(text)
    ends = [h[2] for h in heads[1:]] + [len(text)]
    out: list[tuple[str | None, str, str]] = []
    for (title, _, _, begin), end in zip(heads, ends):
        body = text[begin:end].strip()
        parts = [body] if len(body) <= most else packed(re.split(r"\n\n+", body), most, "\n\n")
        out += [(title, "concept", p.strip()) for p in parts if len(p) >= least]
    return out


def said_structure(answer: str, text: str) -> dict:
    """What a model's answer names: doc_type, sections (title, level) and units (kind, note); headings of the text where it names no section."""
    part, kind, heads, units = "", "unknown", [], []
    for line in map(str.strip, answer.split("\n")):
        mark = re.fullmatch("---(DOCTYPE|SECTIONS|SEMANTIC)---", line)
        cells = [c.strip() for c in line.split("|")]
        if mark:
            part = mark[1]
        elif part == "DOCTYPE" and line:
            kind = line
        elif part == "SECTIONS" and len(cells) > 1:
            level = re.match(r"\s*[0-9]+", cells[1])
            heads.append((cells[0], int(level[0]) if level and int(level[0]) else 1))
        elif part == "SEMANTIC" and len(cells) > 1 and cells[0] in UNIT_KINDS:
            units.append((cells[0], cells[1]))
    if not heads and len(text) > 500:
        heads = [(t, level) for t, level, _, _ in sections_of(text)]
    return {"doc_type": kind, "sections": heads, "units": units}


def smart_blocks(text: str, answer: str | None = None, most: int = 2000, least: int = 100) -> list[tuple[str | None, str, str]]:
    """(section title, kind, content): by units if the model names some, else by headings, else by pieces of fixed size."""
    said = said_structure(answer or "", text)
    if said["units"]:
        return semantic_units(text, most, least)
    if sections_of(text) and said["sections"]:
        return section_blocks(text, most, least)
    pieces = (text[i : i + most].strip() for i in range(0, len(text), most))
    return [(None, "concept", p) for p in pieces if len(p) >= least]


def smart_split(docs: DataFrame, most: int = 2000, least: int = 100) -> DataFrame:
    """doc_id, block, title, kind and content of every document (H68), without a model."""
    return _each_text(docs, lambda t: [(k, *b) for k, b in enumerate(smart_blocks(t, None, most, least))], "block int, title string, kind string, content string", [pa.int32(), pa.string(), pa.string(), pa.string()])


def paragraphs_over(text: Column, least: int) -> Column:
    """Paragraphs of more than so many characters, blanks at their ends aside."""
    return F.filter(F.split(text, r"\n\n+"), lambda p: F.length(F.btrim(p, F.lit(" \t\n\r\f\x0b"))) > least)


def pdf_features(text: Column) -> Column:
    """Contents, chapters, page numbers and paragraphs in the first hundred lines of a PDF's text."""
    head = F.lower(F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 100), "\n"))
    long = paragraphs_over(head, 50)
    chapters = r"chapter\s+[0-9]+|第[一二三四五六七八九十0-9]+[章节]|part\s+[0-9]+|section\s+[0-9]+"
    return F.struct(
        head.rlike("contents|目录|目次").alias("toc"), head.rlike(chapters).alias("chapters"),
        head.rlike(r"(?m)\b[0-9]+\s*$|\bpage\s+[0-9]+").alias("pages"), F.size(long).alias("paragraphs"),
    )


def pdf_structure(features: Column) -> Column:
    """(H62)"""
    f, point = features, lambda holds, x: F.when(holds, x).otherwise(0.0)
    return point(f["toc"], 0.4) + point(f["chapters"], 0.3) + point(f["pages"], 0.1) + point(f["paragraphs"] > 10, 0.2)


def word_features(text: Column) -> Column:
    """Short lines like headings, and paragraphs, of a Word file's text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\r\f\x0b")))
    like = lambda x: (F.length(x) < 50) & (F.length(x) > 3) & x.rlike(r"^[A-Z\s]+$|^第[一二三四五六七八九十0-9]+|^[0-9]+[.\s]")
    return F.struct(F.size(F.filter(lines, like)).alias("headings"), F.size(paragraphs_over(text, 20)).alias("paragraphs"))


def word_structure(features: Column) -> Column:
    """(H65)"""
    f, point = features, lambda holds, x: F.when(holds, x).otherwise(0.0)
    return point(f["headings"] > 2, 0.5) + point(f["headings"] > 3, 0.3) + point(f["paragraphs"] > 5, 0.2)


def structure(path: Column, text: Column, quick: bool = False) -> Column:
    """Score and class of a document by the rules for its extension (H56); ``quick`` looks at 5,000 characters of text files."""
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    seen = F.left(text, F.lit(5000)) if quick else text
    score = (
        F.when(kind == "pdf", pdf_structure(pdf_features(text))).when(kind.isin("md", "markdown"), markdown_structure(markdown_features(seen)))
        .when(kind.isin("html", "htm"), html_structure(seen)).when(kind.isin("docx", "doc"), word_structure(word_features(text))).otherwise(text_structure(seen))
    )
    score = F.round(score, 3)
    return F.struct(score.alias("score"), structure_class(score).alias("class"), F.when(score >= 0.5, "smart").otherwise("simple").alias("split"))


def text_structure(text: Column) -> Column:
    """Score of plain text by headings, paragraphs and lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    heads = F.size(F.filter(lines, lambda x: x.rlike("^(#{1,6} |[0-9]+[.)] |[A-Z][A-Z ]{3,}$)")))
    return F.when(heads > 2, 0.4).otherwise(0.0) + F.when(heads > 0, 0.3).otherwise(0.0) + F.when(F.size(lines) > 5, 0.2).otherwise(0.0) + F.when(F.length(text) > 500, 0.1).otherwise(0.0)


def html_structure(html: Column) -> Column:
    """Score of a page by its semantic tags, headings, lists, tables and code."""
    has = lambda tags: F.when(html.rlike(rf"(?i)<({tags})[\s>]"), 1.0).otherwise(0.0)
    return 0.3 * has("article|section|main|nav|header|footer") + 0.2 * has("h1") + 0.2 * has("h2|h3") + 0.1 * has("table") + 0.1 * has("ul|ol") + 0.1 * has("pre|code")


def structure_class(score: Column) -> Column:
    """(H56)"""
    return F.when(score >= 0.7, "structured").when(score >= 0.4, "semi").otherwise("unstructured")


def context_windows(docs: DataFrame, words: str | list[str], around: int = 100, most: int = 3) -> DataFrame:
    """The first stretches of text around any of the words, in any case, those that touch joined (E5); without one, the text's start.

    A row is answered by itself: the places of the words, then one fold that joins their stretches. Of words that begin at one place the first named counts.
    """
    blank = "array<struct<a: int, b: int>>"
    said = F.lit("(?iu)" + "|".join(rf"\Q{w}\E" for w in ([words] if isinstance(words, str) else words)))
    # The fold's state: the end of the text before the next place, the stretches that are done, and the one in hand.
    start = F.struct(F.lit(0).alias("at"), F.array().cast(blank).alias("done"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))

    def step(s, n):
        at = s["at"] + n["before"]
        lo, hi = F.greatest(F.lit(0), at - around), at + n["size"] + around
        joined = (s["a"] >= 0) & (lo <= s["b"])
        done = F.when(joined | (s["a"] < 0) | (F.size(s["done"]) >= most), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))
        return F.struct((at + n["size"]).alias("at"), done.alias("done"), F.when(joined, s["a"]).otherwise(lo).alias("a"), hi.alias("b"))

    pieces = F.transform(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.length)
    places = F.zip_with(pieces, F.transform("m", F.length), lambda before, size: F.struct(before.alias("before"), size.alias("size")))
    folded = F.aggregate(places, start, step, lambda s: F.when(s["a"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))))
    held = docs.where("text IS NOT NULL").select("doc_id", F.length("text").alias("n"), F.split("text", said, -1).alias("p"), F.regexp_extract_all("text", said, F.lit(0)).alias("m"))
    found = held.select("doc_id", "n", folded.alias("s"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(2 * around).alias("b")))
    rows = found.select("doc_id", "n", F.posexplode(F.slice(F.when(F.size("s") > 0, F.col("s")).otherwise(whole), 1, most)).alias("k", "s"))
    return rows.select("doc_id", (F.col("k") + 1).cast("long").alias("island"), F.col("s.a").cast("long").alias("start"), F.least("s.b", "n").cast("long").alias("end"))


def diverse_sample(docs: DataFrame, group: str, k: int = 3) -> DataFrame:
    """k rows of each group, evenly spread over its order."""
    order = Window.partitionBy(group).orderBy("doc_id")
    ranked = docs.withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    return ranked.where((F.col("place") % step == 0) & (F.col("place") / step < k)).drop("place", "n")


def leader_clusters(vectors: DataFrame, group: str, near: float = 0.7, most: int = 10, left: float = 0.5, rows: int = 200, order: str = "id") -> DataFrame:
    """Greedy clusters of a group's first ``rows`` by ``order``: a row joins the first leader that is near, or leads.

    The limit is the feature: it bounds a group's work. Rows beyond ``most`` leaders join the nearest one, if it is nearer than ``left``; else they are noise (-1).
    """
    import numpy as np

    few = vectors.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order, "id"))).where(F.col("place") <= rows)

    def run(key, frame):
        frame = frame.sort_values("place")
        x = np.array(frame["embedding"].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        leaders, out = [], []
        for v in x:
            sims = [float(v @ x[j]) for j in leaders]
            hit = next((i for i, s in enumerate(sims) if s > near), None)
            if hit is None and len(leaders) < most:
                leaders.append(len(out))
                hit = len(leaders) - 1
            elif hit is None:
                best = int(np.argmax(sims))
                hit = best if sims[best] >= left else -1
            out.append(hit)
        return frame[["id"]].assign(group=key[0], cluster=out)

    return few.select(group, "id", "embedding", "place").groupBy(group).applyInPandas(run, f"id long, group {vectors.schema[group].dataType.simpleString()}, cluster int")


def markdown_features(text: Column) -> Column:
    """Headings, their levels, code, tables, lists and paragraphs over 20 characters (H57); null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}\s+[^\n]+"), F.lit(0))
    blanks = F.lit(" \t\n\r\f\x0b")
    paragraphs = F.filter(F.split(text, r"\n\n+"), lambda p: F.length(F.btrim(p, blanks)) > 20)
    return F.struct(
        F.size(heads).alias("headings"), F.size(F.array_distinct(F.transform(heads, lambda h: F.length(F.regexp_extract(h, "^#+", 0))))).alias("levels"),
        text.rlike(r"(?s)```\w*\n.*?```").alias("code"), text.rlike(r"\|[^\n]+\|[\r\n]+\|[-:| ]+\|").alias("table"),
        (text.rlike(r"(?m)^\s*[-*+]\s+") | text.rlike(r"(?m)^\s*[0-9]+\.\s+")).alias("list"), F.size(paragraphs).alias("paragraphs"),
        F.when(F.size(paragraphs) > 0, F.aggregate(paragraphs, F.lit(0), lambda s, p: s + F.length(p)) / F.size(paragraphs)).otherwise(0.0).alias("mean"),
    )


def markdown_structure(features: Column) -> Column:
    """Score of ``markdown_features``."""
    point = lambda holds, x: F.when(holds, x).otherwise(0.0)
    f = features
    return point(f["headings"] >= 3, 0.4) + point(f["levels"] >= 2, 0.2) + point(f["code"], 0.1) + point(f["table"], 0.1) + point(f["list"], 0.1) + point(f["paragraphs"] > 5, 0.1)


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, number, title and content of every stretch that begins with a heading; what precedes the first has no title."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"(?m)(?=^#{1,6}[ \t]+\S)")).alias("section", "content"))
    title = F.regexp_extract("content", r"\A#{1,6}[ \t]+([^\n]*)", 1)
    return parts.where("content <> ''").select("doc_id", "section", F.when(title != "", F.btrim(title)).alias("title"), "content")


def fixed_pieces(docs: DataFrame, size: int = 2000, least: int = 100) -> DataFrame:
    """doc_id, piece number and content of pieces of ``size`` characters, blanks at their ends left out; those under ``least`` are not given."""
    blanks = F.lit(" \t\n\r\f\x0b")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / size).cast("int") - 1))
    pieces = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.transform(starts, lambda i: F.btrim(F.substring(F.col("text"), i * size + 1, F.lit(size)), blanks))).alias("piece", "content"))
    return pieces.where(F.length("content") >= least)
