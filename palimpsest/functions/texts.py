"""Text expressions: HTML, hashes, keywords, rules for messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that the term tokenizer drops, and those that keywords drop.
TERM_STOPWORDS = """
the a an this that it if for of to is are was were have has had does did and but not only own same than too very
can will may must should would could might be do so no yes up down out off on
user data example note section chapter page file code value result output input param method system process
operation action step part version feature option setting config
""".split()
KEYWORD_STOPWORDS = """
the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would
could should may might must shall can need it its this that these those i you he she we they what which who whom whose
where when why how all each every both few more most other some such no not only same so than too very just also now
here there then once
""".split()
# Patterns of term tokens, in their order; words end at ASCII letters, digits and underscores.
TERM_PATTERNS = [r"(?i)pg_[a-z0-9_]+", r"[A-Z][a-z]+(?:[A-Z][a-z]+)+", r"[A-Za-z]+(?:-[A-Za-z]+)+", r"(?<![A-Za-z0-9_])[A-Z]{2,8}(?![A-Za-z0-9_])"]
WORD_PATTERN = r"[A-Za-z][a-z]+"
CAMEL_PART = r"[A-Z][a-z]+[A-Z]"


def html_to_text(html: Column) -> Column:
    """Scripts, styles and tags become blanks, six entities are decoded in order, blanks collapse."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case, blanks collapsed, without marks."""
    plain = F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " ")
    return F.sha2(F.trim(F.regexp_replace(plain, r"[^A-Za-z0-9_ \x{4e00}-\x{9fff}]", "")), 256)


def words_over_three(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda w: F.length(w) > 3))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words, 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def keywords(text: Column, most: int = 20) -> Column:
    """The distinct ones of the first ``most`` words over three letters that are no stopwords."""
    plain = F.split(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_ \t\n\r\f\x0B]", " "), r"[ \t\n\r\f\x0B]+")
    return F.array_distinct(F.slice(F.filter(plain, lambda w: (F.length(w) > 3) & ~w.isin(*KEYWORD_STOPWORDS)), 1, most))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger set, 0 if either is empty."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / larger).otherwise(0.0)


def term_kind(term: Column) -> Column:
    """(H7)"""
    return (
        F.when(term.rlike("(?i)^pg_"), "pg_prefix").when(term.contains("-"), "hyphenated").when(term.rlike(CAMEL_PART), "camelcase")
        .when((F.upper(term) == term) & (F.length(term) <= 8), "acronym").otherwise("word")
    )


def case_pattern(term: Column) -> Column:
    """(H6)"""
    capital = F.concat(F.upper(F.left(term, F.lit(1))), F.lower(F.right(term, F.length(term) - 1)))
    return F.when(F.upper(term) == term, "UPPER").when(F.lower(term) == term, "LOWER").when(capital == term, "CAPITALIZED").otherwise("MIXED")


def classify(message: Column) -> Column:
    """Category and importance of a message by rules, the first that holds."""
    text, size = F.lower(message), F.length(F.trim(message))
    said = lambda category, weight: F.struct(F.lit(category).alias("category"), F.lit(weight).alias("importance"))
    # The rules' words; blanks within the alternatives are left out.
    return (
        F.when(text.rlike("^(你好|您好|hello|hi|hey|早上好|晚上好)"), said("TRIVIAL", 0.1))
        .when(text.rlike("^(谢谢|感谢|好的|ok|okay|yes|no)"), said("TRIVIAL", 0.1))
        .when(size < 3, said("TRIVIAL", 0.1))
        .when(text.rlike("[？?]|^(什么|怎么|为什么|谁|哪里|何时|多少|what|how|why|who|where|when)"), said("QUESTION", 0.3))
        .when(text.rlike("^(我喜欢|我爱|我讨厌|prefer|like|love|hate)"), said("PREFERENCE", 0.7))
        .when(text.rlike("^(我是|我在|我用|我做|我工作|我住|i am|i use|i work)"), said("FACT", 0.7))
        .when(text.rlike("^(今天|昨天|前天|上周|刚才|刚|yesterday|today|just)"), said("EVENT", 0.6))
        .otherwise(said("EVENT", 0.5))
    )


def conflicting(old: Column, new: Column) -> Column:
    """Whether two statements name different employers, or different things of one group after one verb."""
    work, like = r"works?\s*(?:at|for)\s+([a-z][\w.]*)", r"(prefers?|likes?)\s+([a-z][\w.]*)"
    a, b = F.lower(old), F.lower(new)
    at = lambda x: F.regexp_extract(x, work, 1)
    verb, thing = (lambda x: F.regexp_extract(x, like, 1)), (lambda x: F.regexp_extract(x, like, 2))
    # Groups of things that exclude each other.
    groups = [["react", "vue", "angular", "svelte"], ["red", "blue", "green", "black", "white", "yellow", "purple"], ["typescript", "javascript", "python", "rust", "go", "java"]]
    both = F.lit(False)
    for g in groups:
        both = both | (thing(a).isin(*g) & thing(b).isin(*g))
    works = (at(a) != "") & (at(b) != "") & (at(a) != at(b))
    return works | ((verb(a) != "") & (verb(a) == verb(b)) & (thing(a) != thing(b)) & both)


def repetitive(text: Column) -> Column:
    """Fewer than two characters, a piece three times in a row, or over three words of which most are the same."""
    words = F.split(F.trim(text), r"\s+")
    few = (F.size(words) > 3) & (F.size(F.array_distinct(words)) < F.size(words) * 0.5)
    return (F.length(text) < 2) | text.rlike(r"(.{2,}?)\1{2,}") | few


def without_repetition(text: Column) -> Column:
    """A word or piece said several times in a row is said once."""
    return F.regexp_replace(F.regexp_replace(text, r"\b(\w+)(?:\s+\1\b)+", "$1"), r"(.{3,}?)\1{2,}", "$1")
