"""Entities named in texts, by patterns or in models' answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .answers import BLANKS

# Names under which aliases are known.
ALIASES = {
    "ts": "TypeScript", "typescript": "TypeScript", "js": "JavaScript", "javascript": "JavaScript", "py": "Python", "python": "Python", "rb": "Ruby", "ruby": "Ruby",
    "go": "Go", "golang": "Go", "rs": "Rust", "rust": "Rust", "java": "Java", "kt": "Kotlin", "kotlin": "Kotlin", "swift": "Swift", "cs": "C#", "c#": "C#", "cpp": "C++", "c++": "C++", "c": "C",
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "mongo": "MongoDB", "mongodb": "MongoDB", "redis": "Redis", "mysql": "MySQL", "mariadb": "MariaDB", "sqlite": "SQLite",
    "dynamo": "DynamoDB", "dynamodb": "DynamoDB",
    "react": "React", "reactjs": "React", "react.js": "React", "vue": "Vue.js", "vuejs": "Vue.js", "vue.js": "Vue.js", "angular": "Angular", "angularjs": "AngularJS", "angular.js": "AngularJS",
    "svelte": "Svelte", "next": "Next.js", "nextjs": "Next.js", "next.js": "Next.js", "nuxt": "Nuxt.js", "nuxtjs": "Nuxt.js", "nuxt.js": "Nuxt.js",
    "vscode": "VSCode", "visual studio code": "VSCode", "git": "Git", "github": "GitHub", "gitlab": "GitLab", "docker": "Docker", "k8s": "Kubernetes", "kubernetes": "Kubernetes",
    "aws": "AWS", "amazon web services": "AWS", "gcp": "GCP", "google cloud platform": "GCP", "azure": "Azure", "vercel": "Vercel", "netlify": "Netlify", "heroku": "Heroku",
    "npm": "npm", "yarn": "Yarn", "pnpm": "pnpm", "bun": "Bun", "cargo": "Cargo",
    "macos": "macOS", "mac os": "macOS", "osx": "macOS", "linux": "Linux", "ubuntu": "Ubuntu", "debian": "Debian", "arch": "Arch Linux", "windows": "Windows", "win": "Windows",
    "ml": "Machine Learning", "machine learning": "Machine Learning", "dl": "Deep Learning", "deep learning": "Deep Learning", "llm": "LLM", "large language model": "LLM",
    "transformer": "Transformer", "pytorch": "PyTorch", "tensorflow": "TensorFlow", "hugging face": "Hugging Face", "huggingface": "Hugging Face",
    "api": "API", "rest": "REST", "graphql": "GraphQL", "grpc": "gRPC", "json": "JSON", "yaml": "YAML", "toml": "TOML", "xml": "XML", "html": "HTML", "css": "CSS", "scss": "SCSS", "sass": "Sass",
    "tailwind": "Tailwind CSS", "tailwindcss": "Tailwind CSS", "webpack": "Webpack", "vite": "Vite", "rollup": "Rollup", "esbuild": "esbuild", "babel": "Babel", "eslint": "ESLint", "prettier": "Prettier",
    "jest": "Jest", "vitest": "Vitest", "cypress": "Cypress", "playwright": "Playwright", "ci": "CI/CD", "cd": "CI/CD", "cicd": "CI/CD", "terraform": "Terraform", "ansible": "Ansible",
    "prometheus": "Prometheus", "grafana": "Grafana", "elk": "ELK Stack", "elasticsearch": "Elasticsearch", "logstash": "Logstash", "kibana": "Kibana",
    "llama": "Llama", "llama2": "Llama 2", "llama3": "Llama 3", "claude": "Claude", "gpt": "GPT", "gpt4": "GPT-4", "gpt-4": "GPT-4", "gpt3": "GPT-3", "gpt-3": "GPT-3", "gpt3.5": "GPT-3.5", "gpt-3.5": "GPT-3.5",
}
# Kinds of entities and what names them, between bounds of ASCII words, in either case.
KINDS = {
    "language": r"typescript|ts|javascript|js|python|py|rust|rs|golang|go|ruby|rb|swift|kotlin|java|cpp|c\+\+|c#|cs",
    "database": "postgresql|postgres|mongodb|mongo|redis|mysql|mariadb|sqlite|dynamodb|dynamo",
    "framework": r"react|reactjs|vue|vuejs|angular|svelte|nextjs|next\.js|nuxt|nuxtjs",
    "tool": "vscode|visual studio code|git|github|gitlab|docker|kubernetes|k8s",
    "platform": "aws|gcp|azure|vercel|netlify|heroku",
    "package_manager": "npm|yarn|pnpm|bun|cargo",
    "ai_ml": "machine learning|ml|deep learning|dl|llm|pytorch|tensorflow|hugging ?face",
    "devops": "git|github|gitlab|ci ?/? cd|cicd|terraform|ansible",
    "linter": "eslint|prettier|stylelint",
    "testing": "jest|vitest|cypress|playwright|mocha|chai",
    "build": "webpack|vite|rollup|esbuild|babel|tsc",
}
# Patterns of technical names that a merged memory keeps.
TECHNICAL = [
    r"\b[A-Z_]{3,}\b", r"\b[\w.-]+\.(ts|js|py|go|rs|java|tsx|jsx)\b", r"\b[A-Z][a-zA-Z]*(Service|Controller|Repository|Manager|Factory|Builder|Config|Configurator)\b",
    r"/api/[\w/-]+", r"\b[a-z][a-z0-9.-]*::[a-z][a-z0-9-]*\b",
]
# Words of an answer that name no entity.
STOPWORDS = """
the a an is are was were be been have has had do does did will would could should may might must shall and or but if
then else when where who which what whose whom how this that these those it its for to from by with in on at of as so
than too very i you he she we they them his her my your our their mine yours ours theirs yes no ok okay json format
array object found extracted entities entity name confidence
""".split()

_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with ``\b`` between ASCII letters, digits and underscores and all else, whatever the JVM."""
    return pattern.replace(r"\b", _EDGE)


def whole_words(pattern: str) -> str:
    """Alternatives that begin with letters, between such bounds, in either case; their first letters are looked for first."""
    heads = "".join(sorted({p[0] for p in pattern.split("|")}))
    return f"(?i)(?=[{heads}])(?<![A-Za-z0-9_])({pattern}){_EDGE}"


def normal_name(name: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The name that an alias stands for, or the name with a capital first letter."""
    plain = F.btrim(name, F.lit(BLANKS))
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(plain)), F.concat(F.upper(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2))))


def pattern_entities(text: Column) -> Column:
    """Entities that patterns find, each name once: of the first kind, at its first place.

    The kinds name finitely many entities, so the array of distinct names stays short for any text.
    """
    kind = lambda k, p: F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(whole_words(p)), F.lit(0)),
        lambda m: F.struct(normal_name(m).alias("name"), F.lit(k).alias("entity_type"), m.alias("original")),
    )
    found = F.concat(*[kind(k, p) for k, p in KINDS.items()])
    first = lambda all_, names: F.transform(F.array_distinct(names), lambda n: F.element_at(all_, F.array_position(names, n).cast("int")))
    # One field holds the matches, so that they are looked for once.
    held = F.transform(F.array(found), lambda f: first(f, F.transform(f, lambda e: F.lower(e["name"]))))
    return F.element_at(held, 1)


def extract_entities(docs: DataFrame, key: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """Rows (key, name, entity_type, original, confidence, source) of the entities that patterns find.

    ``known`` has name and confidence: a known entity has its confidence (the highest, of several),
    any other 0.8. Of ``known``, only names that a pattern can find are read, no more than the
    patterns' words, so that it is broadcast.
    """
    found = docs.select(key, F.explode(pattern_entities(F.col(text))).alias("e")).select(key, "e.*")
    if known is None:
        return found.withColumn("confidence", F.lit(0.8)).withColumn("source", F.lit("regex"))
    named = known.select(F.lower(normal_name(F.col("name"))).alias("__known"), F.col("confidence").cast("double").alias("__confidence"))
    whole = "(?i)^(" + "|".join(KINDS.values()) + ")$"
    able = F.col("__known").isin(*sorted({v.lower() for v in ALIASES.values()})) | F.col("__known").rlike(whole)
    few = F.broadcast(named.where(able).groupBy("__known").agg(F.max("__confidence").alias("__confidence")))
    joined = found.join(few, F.lower("name") == F.col("__known"), "left")
    return joined.select(
        key, "name", "entity_type", "original", F.coalesce("__confidence", F.lit(0.8)).alias("confidence"),
        F.when(F.col("__confidence") != 0, "cache").otherwise("regex").alias("source"),
    )


def is_stopword(word: Column) -> Column:
    """(H29)"""
    return F.lower(F.btrim(word, F.lit(BLANKS))).isin(*STOPWORDS)


def answered_entities(answer: Column) -> Column:
    """Names and confidences (0.7 unless said) of an answer: its JSON's entities, else a name on each line.

    Lines that hold stopwords or blanks alone name nothing; null gives none.
    """
    said = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    entity = lambda name, sure: F.struct(normal_name(name).alias("name"), F.coalesce(sure, F.lit(0.7)).alias("confidence"))
    listed = F.from_json(said, "entities array<struct<name: string, confidence: double>>")["entities"]
    listed = F.transform(F.filter(listed, lambda e: F.coalesce(e["name"], F.lit("")) != ""), lambda e: entity(e["name"], e["confidence"]))
    line = r'"?([^"]+)"?\s*[:\-]?\s*([0-9]\.?[0-9]*)?'
    part = lambda x, k: F.btrim(F.regexp_extract(x, line, k), F.lit(BLANKS))
    lines = F.filter(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: (part(x, 1) != "") & ~is_stopword(part(x, 1)))
    lines = F.transform(lines, lambda x: entity(part(x, 1), part(x, 2).try_cast("double")))
    none = F.array().cast("array<struct<name: string, confidence: double>>")
    return F.when(F.try_parse_json(said).isNull(), lines).otherwise(F.coalesce(listed, none))


def technical_names(text: Column) -> Column:
    """Constants, files, classes, endpoints and packages, each once."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ascii_bounds(p)), F.lit(0)) for p in TECHNICAL]))
