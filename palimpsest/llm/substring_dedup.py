"""Substring dedup by suffix automata of reference passages.

``remove_reference_spans`` is the plain form for a reference of its own: automata of its shards
are broadcast, documents are streamed through them for matching statistics, and maximal spans of
the least length or more go.

``dedup_substrings`` removes what the corpus itself repeats. There the reference is the corpus, so
that broadcasts of all its shards would grow with it, and streaming every document through every
shard would grow with its square. Hashes therefore choose the shard that a passage must be
streamed through, and say nothing about what is equal; the shards' automata decide on the words:

1. Of the k-grams in a window, that of the least hash is the window's anchor; consecutive windows
   with one anchor are a run. Equal windows have equal anchors, so that only runs whose anchor
   occurs twice can repeat. Only anchors' hashes and places are shuffled to find them.
2. The words of these runs travel to the shard of their anchor. A shard's automaton is built from
   the distinct passages that meet there, each passage is streamed through it, and every window is
   judged by the first place at which the automaton's state for it was seen.
3. Anchors found hot (at most KEPT_APART are known to all tasks), and those that turn out to have
   many distinct passages, send single windows instead, each to a shard of its own; a task sends
   equal passages once. So no key holds more than a row for each task and a bounded group.

Texts are shuffled once, however often they are read, to meet what was found out about them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import WORD, hashed_words, mix, small_batches, table, text_chunks, window_hashes, word_places

#: Words in a window, and in the k-grams among which it has its anchor.
WIDTH, ANCHOR = 20, 8
#: An anchor is hot if some task's tile holds it so often; at most so many are kept apart (8 bytes each, broadcast).
HOT, KEPT_APART = 16, 65_536
#: Runs that are counted together, and passages (and bytes of them) that a task holds at once, equal ones once.
TILE_RUNS, TILE_PASSAGES, TILE_BYTES = 1_000_000, 200_000, 32 << 20
#: Words in an automaton, and distinct passages of one anchor beyond which it counts as hot.
SHARD_WORDS, CROWD = 20_000, 4_000


class SuffixAutomaton:
    """All runs of words of some passages; a run's first place in them is kept."""

    def __init__(self, passages):
        self.next: list[dict] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        at = 0
        for passage in passages:
            last = 0
            for word in passage:
                last = self._extend(last, word, at)
                at += 1

    def _state(self, length: int, moves: dict, link: int, end: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        return len(self.next) - 1

    def _split(self, p: int, word) -> int:
        """The state of the longest run that ends as p's and goes on with the word, made if it shares one."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.end[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word, at: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0, at)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def states(self, words, least: int) -> list[tuple[int, int]]:
        """(start, state) of every run of ``least`` words that the passages hold; equal runs have one state."""
        found, state, size = [], 0, 0
        moves, link, length = self.next, self.link, self.length
        for i, word in enumerate(words):
            while state and word not in moves[state]:
                state = link[state]
                size = length[state]
            if word in moves[state]:
                state = moves[state][word]
                size += 1
            if size >= least:
                s = state
                while length[link[s]] >= least:
                    s = link[s]
                found.append((i - least + 1, s))
        return found

    def matches(self, words, least: int) -> list[tuple[int, int]]:
        """(start, place) of every run of ``least`` words that the passages hold: where it starts here and, first, there."""
        return [(i, self.end[s] - least + 1) for i, s in self.states(words, least)]


def covered(starts, width: int, n: int) -> np.ndarray:
    """Which of n words lie in windows of ``width`` words from ``starts`` on."""
    change = np.zeros(n + 1, np.int64)
    starts = np.asarray(starts, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:-1]) > 0


# --- runs of windows with one anchor ---------------------------------------------------------------


def _first_least(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every m consecutive values, and where it first is."""
    at, size = np.arange(len(x)), 1
    while size < m:
        step = min(size, m - size)
        later = x[step:] < x[:-step]
        at = np.where(later, at[step:], at[:-step])
        x = np.minimum(x[step:], x[:-step])
        size += step
    return x, at


class Runs:
    """Runs of windows of consecutive texts that share their anchor."""

    def __init__(self, h: np.ndarray, first: np.ndarray, width: int):
        none = np.zeros(0, np.int64)
        self.width, self.first = width, first
        self.anchor, self.start, self.count, self.row = np.zeros(0, np.uint64), none, none, none
        if len(h) < width:
            return
        k = min(ANCHOR, width)
        least, place = _first_least(window_hashes(h, k, seed=7), width - k + 1)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = np.flatnonzero(owner[: len(least)] == owner[width - 1 :])
        if not len(inside):
            return
        new = np.r_[True, (place[inside[1:]] != place[inside[:-1]]) | (owner[inside[1:]] != owner[inside[:-1]])]
        begin = np.flatnonzero(new)
        #: Anchors' hashes, first windows (words of the chunk), windows, and texts of the chunk.
        self.start = inside[begin]
        self.count = np.diff(np.r_[begin, len(inside)])
        self.anchor, self.row = least[self.start], owner[self.start]

    def place(self, which=slice(None)) -> np.ndarray:
        """The first window of each run as a word of its text."""
        return self.start[which] - self.first[self.row[which]]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(x):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def _hot_anchors(rows: DataFrame, width: int) -> np.ndarray:
    """Hashes, sorted, of the anchors that some tile holds often: those with the most runs, KEPT_APART at most."""

    def tally(parts):
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        often = counts >= HOT
        return pa.RecordBatch.from_arrays([_signed(values[often]), _signed(counts[often])], ["anchor", "n"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0)):
                parts.append(Runs(*hashed_words(data, offsets), width).anchor)
                held += len(parts[-1])
            if held >= TILE_RUNS:
                yield tally(parts)
                parts, held = [], 0
        if parts:
            yield tally(parts)

    counts = rows.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "anchor").limit(KEPT_APART).toPandas()["anchor"]
    return np.sort(top.to_numpy(np.int64).astype(np.uint64))


#: How rows are told apart, and in which order their places count: rows without id last.
_KEY = ["late", "doc_id", "tag"]
_PLACES = "late int, doc_id long, tag long, a int, b int"


def _repeated_runs(rows: DataFrame, width: int, hot) -> DataFrame:
    """Spans (first window, past the last) by row, of the runs whose anchor occurs twice, hot ones aside."""

    def run(batches):
        for batch in batches:
            late, ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for row, data, offsets in text_chunks(batch.column(3)):
                runs = Runs(*hashed_words(data, offsets), width)
                cold = np.flatnonzero(~_among(runs.anchor, hot.value))
                at, a = runs.row[cold] + row, runs.place(cold).astype(np.int32)
                columns = [_signed(runs.anchor[cold]), late[at], ids[at], tags[at], a, a + runs.count[cold].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["anchor", *_KEY, "a", "b"])

    posts = rows.select(*_KEY, "text").mapInArrow(run, f"anchor long, {_PLACES}")
    often = posts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where("n > 1")
    return often.groupBy(*_KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans"))


_SENT = ["route", *_KEY, "a", "b", "words"]
_SENT_SQL = f"route long, {_PLACES}, words binary"
_SENT_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _span_ends(spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, past the last) of all spans of an Arrow column of lists."""
    flat = spans.flatten()
    sizes = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(spans)), sizes), *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))


def _equal_words(a: bytes, b: bytes) -> bool:
    """Whether two passages are the same words, whatever blanks stand between them."""
    return a == b or a.split() == b.split()


class _Tile:
    """Passages of a task that wait to be sent; of equal ones only the first is, the others are known to repeat it."""

    def __init__(self):
        self.columns, self.words, self.bytes = [], [], 0

    def add(self, route, same, late, ids, tags, a, b, words: list[bytes]) -> None:
        self.columns.append((route, same, late, ids, tags, a, b))
        self.words += words
        self.bytes += sum(map(len, words))

    def full(self, share: float = 1.0) -> bool:
        return len(self.words) >= share * TILE_PASSAGES or self.bytes >= share * TILE_BYTES

    def collapse(self) -> pa.RecordBatch:
        """Keeps the first of equal passages; rows without words for the others, whose windows all repeat it."""
        route, same, late, ids, tags, a, b = columns = [np.concatenate(c) for c in zip(*self.columns)]
        order = np.lexsort((tags, a, ids, late, same, route))
        last, now = order[:-1], order[1:]
        alike = np.r_[False, (route[now] == route[last]) & (same[now] == same[last])]
        head = order[np.maximum.accumulate(np.where(alike, 0, np.arange(len(order))))]
        # hashes only bring passages together; that they are equal is told by their words
        for k in np.flatnonzero(alike).tolist():
            alike[k] = _equal_words(self.words[order[k]], self.words[head[k]])
        here = (late[order] == late[head]) & (ids[order] == ids[head]) & (a[order] == a[head])
        twice = np.r_[False, alike[1:] & here[1:] & (tags[now] == tags[last])]
        again = alike & ~here
        kept, known = order[~twice & ~again], order[again]
        self.columns, self.words = [tuple(c[kept] for c in columns)], [self.words[i] for i in kept.tolist()]
        self.bytes = sum(map(len, self.words))
        # Such windows need no shard: they are joined to spans, which go by the hash of their row.
        known = known[np.lexsort((a[known], tags[known], ids[known], late[known]))]
        last, now = known[:-1], known[1:]
        new = np.r_[True, (late[now] != late[last]) | (ids[now] != ids[last]) | (tags[now] != tags[last]) | (a[now] > b[last]), True]
        begin, end = known[np.flatnonzero(new[:-1][: len(known)])], known[np.flatnonzero(new[1:][: len(known)])]
        return _sent(tags[begin] ^ ids[begin], late[begin], ids[begin], tags[begin], a[begin], b[end], [None] * len(begin))

    def send(self) -> pa.RecordBatch:
        """The passages kept, to be judged; the tile is empty then."""
        (route, _, late, ids, tags, a, b), words = self.columns[0], self.words
        self.__init__()
        return _sent(route.astype(np.int64), late, ids, tags, a, b, words)


def _sent(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SENT_TYPES)], _SENT)


def _passages(joined: DataFrame, width: int, hot) -> DataFrame:
    """Passages with the shard that each must be streamed through; rows: late, doc_id, tag, text, spans."""

    def run(batches):
        tile = _Tile()
        for batch in batches:
            late, ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at, begin, end = _span_ends(batch.column(4))
            for row, data, offsets in text_chunks(batch.column(3)):
                h, first, starts, ends = hashed_words(data, offsets, places=True)
                runs, windows = Runs(h, first, width), window_hashes(h, width)
                mine = (at >= row) & (at < row + len(offsets) - 1)
                a = begin[mine] + first[at[mine] - row]
                count = end[mine] - begin[mine]
                whole = runs.anchor[np.searchsorted(runs.start, a)] if len(a) else np.zeros(0, np.uint64)
                crowd = np.flatnonzero(_among(runs.anchor, hot.value))
                single = np.repeat(runs.start[crowd], runs.count[crowd])
                single += np.arange(len(single)) - np.repeat(np.cumsum(runs.count[crowd]) - runs.count[crowd], runs.count[crowd])
                route = np.r_[whole, mix(windows[single])]
                a, count = np.r_[a, single], np.r_[count, np.ones(len(single), np.int64)]
                same = windows[a] + np.uint64(0x9E3779B97F4A7C15) * mix(windows[a + count - 1] + count.astype(np.uint64))
                text = np.searchsorted(first, a, "right") - 1
                place = (a - first[text]).astype(np.int32)
                lo, hi = starts[a].tolist(), ends[a + count + width - 2].tolist()
                raw = data.tobytes()
                tile.add(route, same, late[text + row], ids[text + row], tags[text + row], place, place + count.astype(np.int32), [raw[x:y] for x, y in zip(lo, hi)])
                if tile.full():
                    yield tile.collapse()
                    if tile.full(0.5):
                        yield tile.send()
        if tile.words:
            yield tile.collapse()
            yield tile.send()

    return joined.select(*_KEY, "text", "spans").mapInArrow(run, _SENT_SQL)


# --- judging passages in their shards ---------------------------------------------------------------


class _Shard:
    """Passages of some anchors: the distinct ones make an automaton, and all are streamed through it."""

    def __init__(self, width: int, crowd: int | None):
        self.width, self.crowd = width, crowd
        self.out: list[tuple] = []
        self.route, self.seen, self.crowded = None, {}, False
        self.groups: list[dict] = []
        self.words = 0

    def take(self, route: int, late: int, doc: int, tag: int, a: int, b: int, words: bytes | None) -> None:
        if words is None:
            self.out.append((route, late, doc, tag, a, b, None))
            return
        if route != self.route:
            self._close()
            self.route = route
        if self.crowded:
            self._scatter(words, [(late, doc, tag, a, b)])
            return
        key = (b - a, words)
        held = self.seen.get(key)
        if held is None:
            if self.crowd is not None and len(self.seen) >= self.crowd:
                self.crowded = True
                for (_, w), rows in self.seen.items():
                    self._scatter(w, rows)
                self.seen = {}
                self._scatter(words, [(late, doc, tag, a, b)])
            else:
                self.seen[key] = [(late, doc, tag, a, b)]
        elif held[0][:2] == (late, doc) and held[0][3] == a:
            if held[-1][2] != tag:
                held.append((late, doc, tag, a, b))
        else:  # rows come by place, so that an equal passage at the first place is known
            self.out.append((tag ^ doc, late, doc, tag, a, b, None))

    def _scatter(self, words: bytes, rows: list[tuple]) -> None:
        """Single windows, each to a shard of its own."""
        own = words.split()
        for late, doc, tag, a, b in rows:
            for k in range(b - a):
                window = b" ".join(own[k : k + self.width])
                self.out.append((_route_of(window), late, doc, tag, a + k, a + k + 1, window))

    def _close(self) -> None:
        if self.seen:
            self.groups.append(self.seen)
            self.words += sum(n + self.width - 1 for n, _ in self.seen)
        self.seen, self.crowded = {}, False
        if self.words >= SHARD_WORDS:
            self.judge()

    def judge(self) -> None:
        """Windows of the passages held that start earlier in another passage of their group."""
        passages = [(w.split(), rows) for group in self.groups for (_, w), rows in group.items()]
        self.groups, self.words = [], 0
        automaton = SuffixAutomaton(w for w, _ in passages)
        found, first = [], {}
        for words, rows in passages:
            late, doc, _, a, _ = rows[0]
            states = automaton.states(words, self.width)
            found.append(states)
            for i, s in states:
                here = (late, doc, a + i)
                if s not in first or here < first[s]:
                    first[s] = here
        for (_, rows), states in zip(passages, found):
            for late, doc, tag, a, _ in rows:
                begin = None
                for i, s in states:
                    if first[s] < (late, doc, a + i):
                        begin = i if begin is None else begin
                    elif begin is not None:
                        self.out.append((tag ^ doc, late, doc, tag, a + begin, a + i, None))
                        begin = None
                if begin is not None:
                    self.out.append((tag ^ doc, late, doc, tag, a + begin, a + len(states), None))

    def flush(self):
        if self.out:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.out), _SENT_TYPES)]
            self.out = []
            yield pa.RecordBatch.from_arrays(columns, _SENT)


def _route_of(window: bytes) -> int:
    h, _ = hashed_words(np.frombuffer(window, np.uint8), np.array([0, len(window)]))
    return int(mix(window_hashes(h, len(h))).astype(np.int64)[0])


def _judged(sent: DataFrame, width: int, crowd: int | None) -> DataFrame:
    """Rows without words: spans of windows that start earlier too. Rows with words: windows of crowded anchors."""

    def run(batches):
        shard = _Shard(width, crowd)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                shard.take(*row)
            yield from shard.flush()
        shard._close()
        shard.judge()
        yield from shard.flush()

    return sent.repartition("route").sortWithinPartitions("route", "late", "doc_id", "a", "tag").select(*_SENT).mapInArrow(run, _SENT_SQL)


# --- removing -----------------------------------------------------------------------------------------


def _kept_texts(data: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> list[str]:
    """The kept words of each text, joined by single blanks."""
    at = np.flatnonzero(keep)
    text = np.searchsorted(first, at, "right") - 1
    size = ends[at] - starts[at]
    joined = size + np.r_[text[1:] == text[:-1], False][: len(at)]
    dest = np.r_[0, np.cumsum(joined)]
    out = np.full(int(dest[-1]), 32, np.uint8)
    for lo in range(0, len(at), 1 << 18):
        s, n, d = starts[at[lo : lo + (1 << 18)]], size[lo : lo + (1 << 18)], dest[lo : min(len(at), lo + (1 << 18))]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(d, n) + inner] = data[np.repeat(s, n) + inner]
    ends_at = dest[np.searchsorted(text, np.arange(len(first) - 1), "right")]
    begin_at = dest[np.searchsorted(text, np.arange(len(first) - 1), "left")]
    raw = out.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin_at.tolist(), ends_at.tolist())]


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Removes every word in a window of ``width`` words that also starts earlier in the corpus.

    Earlier is a smaller doc_id, or an earlier start in the same document. Returns doc_id,
    n_words, n_removed and kept (the words left, joined by blanks) for every row. Null, empty and
    short texts have no windows; texts of null are no words and keep an empty text; rows with one
    doc_id count as the same document, in which a window is judged by its place alone; null doc_ids
    come after all others and are one document; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.isNull().cast("int").alias("late"), F.coalesce(doc, F.lit(0).cast("long")).alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    hot = spark.sparkContext.broadcast(_hot_anchors(rows, width))
    known = rows.join(_repeated_runs(rows, width, hot).hint("shuffle_hash"), _KEY, "left")
    judged = _judged(_judged(_passages(known, width, hot), width, CROWD), width, None)
    later = judged.groupBy(*_KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def run(batches):
        for batch in batches:
            at, begin, end = _span_ends(batch.column(3))
            for row, data, offsets in text_chunks(batch.column(2)):
                first, starts, ends = word_places(data, offsets)
                mine = (at >= row) & (at < row + len(offsets) - 1)
                base = first[at[mine] - row]
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, begin[mine] + base, 1)
                np.add.at(change, end[mine] + (width - 1) + base, -1)
                gone = np.cumsum(change[:-1]) > 0
                total = np.r_[0, np.cumsum(gone)]
                n = len(offsets) - 1
                late, ids = (batch.column(k).slice(row, n).to_numpy(zero_copy_only=False) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=late == 1), pa.array(np.diff(first)), pa.array(np.diff(total[first])), pa.array(_kept_texts(data, first, starts, ends, ~gone), pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    joined = rows.join(later.hint("shuffle_hash"), _KEY, "left").select("late", "doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _texts_of(batch_column):
    """Word hashes of each text."""
    for _, data, offsets in text_chunks(batch_column):
        h, first = hashed_words(data, offsets)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield h[a:b].tolist()


def remove_reference_spans(docs: DataFrame, reference: DataFrame, width: int = WIDTH) -> DataFrame:
    """Removes every maximal run of ``width`` words or more that occurs in a text of the reference.

    The reference is read in blocks of SHARD_WORDS words, whose automata are broadcast in turn.
    Returns doc_id, n_words, n_removed and kept for every row; null texts are no words, an empty
    reference removes nothing, repeated rows are answered each, and other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards, shard, held = [], [], 0
    for (text,) in reference.select("text").where("text IS NOT NULL").toLocalIterator():
        shard.append(text)
        held += len(WORD.findall(text))
        if held >= SHARD_WORDS:
            shards.append(spark.sparkContext.broadcast(shard))
            shard, held = [], 0
    shards += [spark.sparkContext.broadcast(shard)] if shard else []
    schema = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}

    def run(batches):
        automata = [SuffixAutomaton(_texts_of(pa.array(s.value, pa.string()))) for s in shards]
        for batch in batches:
            out = []
            for doc, text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts_of(batch.column(1))):
                starts = [i for a in automata for i, _ in a.states(h, width)]
                gone = covered(starts, width, len(h)) if starts else np.zeros(len(h), bool)
                words = [w for w, g in zip(WORD.findall(text or ""), gone.tolist()) if not g]
                out.append((doc, len(h), int(gone.sum()), " ".join(words)))
            columns = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], list(schema))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_substring_dedup": query}
ORACLE_SQL: dict[str, str] = {}
