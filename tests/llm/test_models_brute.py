"""The trained operators' scores against naive versions of their methods, and their ties."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import language_id, quality, secret_scan, toxicity
from palimpsest.llm.common import WORD, hashed_words, mix


def naive_rate(text, weights, exceptions):
    """Every entry is looked for at every word, whole or as a beginning; of what overlaps the first counts, then the longest."""
    own = re.findall(r"\w+", toxicity.fold(text or ""))
    line = " ".join(own)
    hits = []
    whole = {**{w: x for w, x in weights.items() if not w.endswith("*")}, **dict.fromkeys(exceptions, 0.0)}
    stems = {w[:-1]: x for w, x in weights.items() if w.endswith("*")}
    starts = [0] + [k + 1 for k, c in enumerate(line) if c == " "]
    for start in starts if line else []:
        for entry in {*whole, *stems}:
            if line.startswith(entry, start):
                end = start + len(entry)
                weight = whole.get(entry) if end == len(line) or line[end] == " " else stems.get(entry)
                if weight is not None:
                    hits.append((start, -len(entry), weight))
    total, taken = 0.0, -1
    for start, size, weight in sorted(hits):
        if start > taken:
            total, taken = total + weight, start - size - 1
    return total / (len(own) + toxicity.LENGTH)


def test_rates_are_those_of_a_naive_matcher():
    rng = random.Random(41)
    letters = ["aб"[0], "b", "ä", "0", "é"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    for _ in range(40):
        weights = {toxicity.fold(w) + ("*" if rng.random() < 0.4 else ""): rng.random() for w in rng.sample(made, 12)}
        exceptions = [toxicity.fold(f"{rng.choice(made)} {rng.choice(made)}") for _ in range(5)]
        lexicon = toxicity.Lexicon(weights, exceptions, 3.0)
        for _ in range(20):
            text = rng.choice((" ", "-", ". ")).join(rng.choice(made) for _ in range(rng.randrange(0, 30)))
            assert math.isclose(lexicon.rate(text), naive_rate(text, weights, exceptions), abs_tol=1e-12)
            assert lexicon.score(text) == 1 - math.exp(-3.0 * lexicon.rate(text))


def toxic_rows(n=400, seed=42):
    rng = random.Random(seed)
    clean = [f"word{k}" for k in range(80)]
    bad = ["grubling", "grublish", "grubber", "grubs", "grubnut", "scumly"]
    rows = []
    for i in range(n):
        text = [rng.choice(clean) for _ in range(rng.randrange(8, 30))]
        if i % 4 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text) + 1), rng.choice(bad))
        if i % 4 == 1 and rng.random() < 0.5:
            text += ["honest", "scumly"]
        rows.append((" ".join(text), int(i % 4 == 0)))
    return rows


def naive_lexicon(rows):
    """Weights and exceptions by counting in dictionaries, one text after another."""
    rows = sorted(set(rows))
    bad, good = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    pairs = defaultdict(lambda: [0, 0])
    for text, y in rows:
        own = toxicity.tokens(toxicity.fold(text))
        for w, p in set(zip(own, ["", *own])):
            pairs[w, p][1 - y] += 1
    words = defaultdict(lambda: [0, 0, 0])  # bad, good, contexts
    for (w, _), (b, g) in pairs.items():
        words[w][0] += b
        words[w][1] += g
        words[w][2] += b > 0
    odds = lambda b, g, nb, ng: math.log((b + 0.5) / (nb + 1)) - math.log((g + 0.5) / (ng + 1))
    all_bad, all_good = sum(v[0] for v in words.values()), sum(v[1] for v in words.values())
    stems = defaultdict(lambda: [0, 0, set()])
    for w, (b, g, _) in words.items():
        for n in toxicity.STEM_LETTERS:
            if len(w) > n:
                stems[w[:n]][0] += b
                stems[w[:n]][1] += g
                if b:
                    stems[w[:n]][2].add(w[n])
    able = [(s, b, odds(b, g, all_bad, all_good)) for s, (b, g, letters) in stems.items() if b >= toxicity.STEM_WORDS and len(letters) >= toxicity.STEM_NEXT]
    chosen = {}
    for s, b, o in sorted((x for x in able if x[2] >= math.log(toxicity.STEM_ODDS)), key=lambda x: (-x[1] * x[2], -len(x[0]), x[0])):
        if not any(c.startswith(s) or s.startswith(c) for c in chosen):
            chosen[s] = o
    found = {w: odds(b, g, bad, good) for w, (b, g, c) in words.items() if c >= toxicity.CONTEXTS and odds(b, g, bad, good) >= math.log(toxicity.ODDS)}
    found = {w: o for w, o in found.items() if not any(w.startswith(s) and w != s for s in chosen)} | {f"{s}*": o for s, o in chosen.items()}
    weights = {w: o / max(found.values()) for w, o in found.items()}
    excused = {f"{p} {w}" for (w, p), (b, g) in pairs.items() if w in weights and p and g >= 3 and (g + 0.5) / (good + 1) >= (b + 0.5) / (bad + 1)}
    return weights, excused


def test_the_lexicon_is_that_of_naive_counts(spark):
    rows = toxic_rows()
    weights, exceptions, scale = toxicity.learn_lexicon(spark.createDataFrame(rows + rows[:9], "text string, toxic int"))
    want, excused = naive_lexicon(rows)
    assert weights.keys() == want.keys() and any(w.endswith("*") for w in want) and all(math.isclose(weights[w], want[w]) for w in want)
    assert set(exceptions) == excused and scale > 0


def naive_vector(text, letters):
    """The sum of the bound vectors of all runs of three symbols, one at a time."""
    out = np.zeros(letters.shape[1])
    ids, counts = language_id.grams_of(text)
    for i, c in zip(ids.tolist(), counts.tolist()):
        bound = np.ones(letters.shape[1])
        for k in range(language_id.GRAM):
            bound = bound * np.roll(letters[i // language_id.SYMBOLS**k % language_id.SYMBOLS], k)
        out += c * bound
    return out


def test_languages_are_those_of_naive_sums(spark):
    rng = random.Random(43)
    alphabets = {"aa": "abcde ", "bb": "cdefg ", "cc": "xyzéß "}
    make = lambda lang, n: "".join(rng.choice(alphabets[lang]) for _ in range(n))
    learned = [(make(lang, 60), lang) for lang in alphabets for _ in range(5)]
    model = language_id.learn_prototypes(spark.createDataFrame(learned, "text string, lang string"))
    letters = language_id.Space().letters.astype(float)
    prototypes = {lang: sum(naive_vector(t, letters) for t, y in learned if y == lang) for lang in sorted(alphabets)}
    prototypes = {lang: v / np.linalg.norm(v) for lang, v in prototypes.items()}
    rows = [(i, make(rng.choice(list(alphabets)), rng.randrange(1, 80))) for i in range(60)] + [(99, "123 -"), (100, None)]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        v = naive_vector(text, letters)
        if not v.any():
            assert found[i] == ("und", 0.0)
            continue
        cosines = {lang: float(p @ v / np.linalg.norm(v)) for lang, p in prototypes.items()}
        best = max(cosines, key=cosines.get)
        assert math.isclose(found[i][1], max(0.0, cosines[best]), abs_tol=1e-5) and math.isclose(cosines[found[i][0]], cosines[best], abs_tol=1e-5)


def test_languages_of_equal_prototypes_go_to_the_first_in_order(spark):
    learned = [("abc abc", "zz"), ("abc abc", "mm")]
    model = language_id.learn_prototypes(spark.createDataFrame(learned, "text string, lang string"))
    found = language_id.identify_language(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in found] == ["mm"]


def naive_features(text):
    """Weight of every bucket, one word and n-gram at a time."""
    words, out = WORD.findall(text or ""), Counter()
    place = lambda x: int(x % np.uint64(quality.BUCKETS - quality._MARKS)) + quality._MARKS
    held = [int(h) for w in words for h in hashed_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0]]
    out[min(quality._REPEATED - 1, len(words).bit_length())] += 0.1
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    if repeats:
        out[quality._REPEATED] += repeats / len(words)
    for word, h in zip(words, held):
        marked = [1, *[ord(c) + 3 for c in word], 2]
        grams = [marked[k : k + n] for n in range(quality.SHORTEST, quality.LONGEST + 1) for k in range(len(marked) - n + 1)]
        share = 1 / (1 + len(grams)) / len(words)
        out[place(np.uint64(h))] += share
        for g in grams:
            run = 0
            for c in g:
                run = (run * 0x9E3779B97F4A7C15 + c) % (1 << 64)
            out[place(mix(np.array([(run + len(g)) % (1 << 64)], np.uint64))[0])] += share
    return out


def test_features_and_scores_are_those_of_naive_counts(spark):
    rng = random.Random(44)
    texts = ["", None, "one", "a a a b", "é ünï ß"] + [" ".join(rng.choice(["ab", "ab", "über", "x", "longerword", "日本語"]) for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    for (row, buckets, weights), text in zip(quality.features_of(pa.array(texts)), texts):
        own = Counter()
        for b, w in zip(buckets.tolist(), weights.tolist()):
            own[b] += w
        want = naive_features(text)
        assert own.keys() == want.keys() and all(math.isclose(own[k], want[k], rel_tol=1e-4) for k in want)
    dense = [quality._dense(b, w) for _, b, w in quality.features_of(pa.array(texts))]
    model = quality.train(dense, [i % 2 for i in range(len(texts))])
    found = {r["doc_id"]: r["score"] for r in quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        hidden = sum((w * model.vectors[b].astype(float) for b, w in naive_features(text).items()), np.zeros(quality.DIMENSIONS))
        z = hidden @ model.output + model.bias
        assert math.isclose(found[i], 1 / (1 + math.exp(z[0] - z[1])), abs_tol=1e-4)


def naive_transitions(samples):
    n = len(secret_scan.ALPHABET)
    pairs, single, after = Counter(), Counter(), Counter()
    for s in samples:
        pairs.update(zip(s, s[1:]))
        after.update(s[:-1])
        single.update(s)
    total = sum(single.values()) + n
    return lambda a, b: math.log((pairs[a, b] + secret_scan.BACKED * (single[b] + 1) / total) / (after[a] + secret_scan.BACKED))


def test_markov_spans_are_those_of_naive_chains(spark):
    rng = random.Random(45)
    ordinary = secret_scan.made_identifiers(["house", "river", "green"], 400)
    keys = secret_scan.random_strings(400)
    ratio = secret_scan.learn_ratio(ordinary, keys)
    secret, plain = naive_transitions(keys), naive_transitions(ordinary)
    score = lambda s: sum(secret(a, b) - plain(a, b) for a, b in zip(s, s[1:])) / (len(s) - 1)
    pool = ordinary[:50] + keys[:50] + ["word", "token=abcdef12", "AKIA" + "A" * 16, "0a" * 14]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 20))) for _ in range(40)]
    for text in texts:
        base = secret_scan.base_spans(text)
        want = [("markov", *m.span()) for m in secret_scan.RUN.finditer(text) if not any(s < m.end() and e > m.start() for _, s, e in base) and score(m[0]) > 0.3]
        assert [x for x in secret_scan.all_spans(text, ratio, 0.3) if x[0] == "markov"] == want
        assert all(math.isclose(secret_scan.ratio_of(m[0], ratio), score(m[0]), abs_tol=1e-9) for m in secret_scan.RUN.finditer(text))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("key", F.lit(1))
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.scan_secrets(frame, (ratio, 0.3)).collect()}
    assert found == {i: secret_scan.all_spans(t, ratio, 0.3) for i, t in enumerate(texts)}
