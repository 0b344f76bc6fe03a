"""Column functions over source text: tokens, lines, bodies, measures, labels, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern, decision patterns (one hit a pattern and line), danger patterns, languages by extension (of files and,
# in GRAMMARS, of grammars), model names, the weights of rerank_score and snippet_score.
TOKEN = r"[a-z]+|[A-Z][a-z]*|[0-9]+"
DECISIONS = (
    r"\bif\b", r"\belif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcatch\b", r"\bexcept\b", r"\bcase\b",
    r"\b\?\?", r"\?\s*\.", r"\band\b", r"\bor\b", r"&&", r"\|\|",
)
DANGERS = (
    r"\bos\.system\s*\(", r"subprocess\..*shell\s*=\s*True", r"\brm\s+-rf\s+/", r"\beval\s*\(", r"\bexec\s*\(", r"\b__import__\s*\(",
    r"DROP\s+TABLE|DROP\s+DATABASE", r"TRUNCATE\s+TABLE", r"\.\./\.\./",
    r"""(?:password|secret|api_key|token)\s*=\s*["'][^"']{8,}["']""",
    r"innerHTML\s*=", r"document\.write\s*\(", r"\bMD5\s*\(|\bmd5\s*\(", r"\bSHA1\s*\(|\bsha1\s*\(",
    r"http://(?!localhost|127\.0\.0\.1)", r"verify\s*=\s*False",
)
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".go": "go",
    ".rs": "rust", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala", ".sh": "shell", ".bash": "shell", ".sql": "sql", ".r": "r", ".lua": "lua", ".dart": "dart",
    ".ex": "elixir", ".exs": "elixir",
}

GRAMMARS = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust",
    ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".h": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php",
}
MODELS = {
    "minilm": "all-MiniLM-L6-v2", "bge-small": "BAAI/bge-small-en-v1.5", "nomic": "nomic-ai/nomic-embed-text-v1.5",
    "jina-code": "jinaai/jina-embeddings-v2-base-code", "mxbai-xsmall": "mixedbread-ai/mxbai-embed-xsmall-v1",
}
PROFILES = ((1.5, "precise"), (0.5, "balanced"), (0.0, "fast"))
RERANK = {"score": 0.6, "overlap": 0.25, "exact": 0.15, "brief": 0.05}


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# tokens and lines
def tokens(text) -> Column:
    return F.regexp_extract_all(c(text), F.lit(TOKEN), 0)


def lower_tokens(text) -> Column:
    return F.transform(tokens(text), lambda x: F.lower(x))


BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BLANKS = " \t\n\r\x0b\x0c"


def lines(text) -> Column:
    """Lines by any line break; one at the very end opens no further line, and an empty text has none."""
    t = c(text)
    rare = reduce(lambda a, b: a | b, [F.contains(t, F.lit(ch)) for ch in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"])
    any_break = F.split(F.regexp_replace(t, rf"(?:{BREAK})\z", ""), BREAK)
    # by far most texts hold no other break than this one, and a plain split costs a tenth of a pattern
    plain = F.split(F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t), "\n")
    return F.when(t == "", F.array().cast("array<string>")).when(rare, any_break).otherwise(plain)


def stripped(x) -> Column:
    return F.btrim(c(x), F.lit(BLANKS))


def line_kind(line) -> Column:
    s = stripped(line)
    return F.when(s == "", "blank").when(s.rlike(r"^(#|//|/\*|\*)"), "comment").otherwise("code")


def line_range(text, start: int, end: int) -> Column:
    return F.array_join(F.slice(F.split(c(text), "\n"), start, end - start + 1), "\n")


def last_lines(text, n: int) -> Column:
    full = F.filter(lines(text), lambda x: stripped(x) != "")
    return F.array_join(F.when(F.size(full) > n, F.slice(full, -n, n)).otherwise(full), "\n")


# bodies and similarity
def normal_body(body) -> Column:
    kept = F.filter(F.transform(lines(body), lambda x: stripped(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("//"))
    return F.array_join(kept, "\n")


def trigrams(text) -> Column:
    t = c(text)
    n = F.length(t)
    # characters side by side with those one and two further on: linear in the text, as a substring at each place is not
    one = F.split(t, "")
    two = F.zip_with(one, F.slice(one, F.lit(2), n), lambda a, b: F.concat(a, b))
    many = F.array_distinct(F.filter(F.zip_with(two, F.slice(one, F.lit(3), n), lambda a, b: F.concat(a, b)), lambda x: x.isNotNull()))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(t)).otherwise(many)


def jaccard(a, b) -> Column:
    a, b = c(a), c(b)
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


# measures
def complexity(body) -> Column:
    def of(line):
        s = stripped(line)
        hits = reduce(lambda x, p: x + line.rlike(p).cast("int"), DECISIONS, F.lit(0))
        return F.when((s == "") | s.startswith("#") | s.startswith("//"), 0).otherwise(hits)

    return F.aggregate(lines(body), F.lit(1), lambda acc, line: acc + of(line))


def complexity_band(score) -> Column:
    s = c(score)
    return F.when(s <= 5, "low").when(s <= 10, "moderate").when(s <= 20, "high").otherwise("very_high")


def risk_band(score) -> Column:
    s = c(score)
    return F.when(s < 25, "low").when(s < 50, "medium").when(s < 75, "high").otherwise("critical")


def maintainability(loc, cc, comments) -> Column:
    loc, cc, comments = c(loc), c(cc), c(comments)
    volume = F.greatest(loc * F.greatest(cc, F.lit(1.0)), F.lit(1.0))
    raw = 171 - 5.2 * F.ln(volume) - 0.23 * cc - 16.2 * F.ln(F.greatest(loc, F.lit(1.0))) + 50 * F.sin(F.sqrt(2.4 * comments))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171))


def normalised(value, most) -> Column:
    v, m = c(value), c(most)
    return F.when(m <= 0, F.lit(0.0)).otherwise(F.least(v / m, F.lit(1.0)))


def token_estimate(text) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c(text)) / 4)).cast("long")


def keyword_overlap(text, query: str) -> Column:
    words = [w.lower() for w in query.split() if len(w) > 2]
    if not words:
        return F.lit(0.0)
    return reduce(lambda x, w: x + F.contains(F.lower(c(text)), F.lit(w)).cast("int"), words, F.lit(0)) / len(words)


def rerank_score(score, text, query: str) -> Column:
    exact = F.contains(F.lower(c(text)), F.lit(query.lower())).cast("double")
    brief = F.greatest(F.lit(0.0), 1.0 - F.length(c(text)) / 5000)
    parts = {"score": c(score), "overlap": keyword_overlap(text, query), "exact": exact, "brief": brief}
    return F.round(sum((w * parts[k] for k, w in RERANK.items()), F.lit(0.0)), 4)


def snippet_score(score, text, query: str) -> Column:
    return F.round(c(score) + 0.1 * keyword_overlap(text, query), 4)


# names, keys and labels
def chunk_key(file, start, end) -> Column:
    return F.concat_ws(":", c(file), c(start), c(end))


def content_hash(text) -> Column:
    return F.sha2(c(text), 256)


def request_key(*parts) -> Column:
    return F.sha2(F.concat_ws("\n", *[c(p).cast("string") for p in parts]), 256)


def qualified_name(parent, name) -> Column:
    return F.concat_ws(".", F.nullif(c(parent), F.lit("")), c(name))


def semantic_label(language, kind, parent, name, parameters) -> Column:
    args = F.concat(F.lit("("), F.array_join(c(parameters), ", "), F.lit(")"))
    return F.concat_ws(" ", F.concat(F.lit("["), c(language), F.lit("]")), c(kind), qualified_name(parent, name), F.when(F.size(c(parameters)) > 0, args))


def signature(body) -> Column:
    return stripped(F.substring_index(c(body), "\n", 1))


def language_of(path) -> Column:
    ext = F.lower(F.regexp_extract(c(path), r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[ext], F.lit("unknown"))


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def grammar_of(path) -> Column:
    """The parser's language of a file; null where it has none."""
    return _mapped(F.regexp_extract(c(path), r"(\.[^./]+)$", 1), GRAMMARS)


def model_of(name) -> Column:
    """A model's full name from a short one; other names stay."""
    return F.coalesce(_mapped(F.lower(c(name)), MODELS), c(name))


def profile_for_memory(gigabytes) -> Column:
    return F.coalesce(*[F.when(c(gigabytes) >= least, name) for least, name in PROFILES], F.lit("fast"))


def node_id(text) -> Column:
    tail = F.element_at(F.split(c(text), ":"), -1)
    stem = F.when(F.contains(tail, F.lit("/")), F.regexp_replace(F.element_at(F.split(tail, "/"), -1), r"\.[^.]*$", "")).otherwise(tail)
    clean = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, 60), F.lit("")), F.lit("node"))


def short_label(text) -> Column:
    return F.element_at(F.split(c(text), "/"), -1)


def citation(ident, path, start, end) -> Column:
    return F.format_string("[%d] %s:%d-%d", c(ident), short_label(path), c(start), c(end))


def model_folder(name) -> Column:
    return F.replace(c(name), F.lit("/"), F.lit("--"))


def path_of_uri(uri) -> Column:
    return F.url_decode(F.regexp_replace(c(uri), "^file://", ""))


def word_at(line, character: int) -> Column:
    left = F.regexp_extract(F.substring(c(line), 1, character), r"[A-Za-z0-9_]*$", 0)
    right = F.regexp_extract(F.substr(c(line), F.lit(character + 1)), r"^[A-Za-z0-9_]*", 0)
    return F.concat(left, right)


def truncated(text, most: int, mark: str = "\n... [truncated]") -> Column:
    return F.when(F.length(c(text)) > most, F.concat(F.substring(c(text), 1, most), F.lit(mark))).otherwise(c(text))


def for_embedding(text, label=None) -> Column:
    t = F.regexp_replace(F.regexp_replace(c(text), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    t = F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))
    return t if label is None else F.concat_ws("\n", F.nullif(c(label), F.lit("")), t)


# diffs
def diff_block(text) -> Column:
    fenced = F.regexp_extract(c(text), r"(?s)```(?:diff|patch)?\n(.*?)```", 1)
    raw = F.regexp_extract(c(text), r"(?s)(--- .*)", 1)
    return F.when(fenced != "", fenced).otherwise(raw)


def diff_files(diff) -> Column:
    found = F.regexp_extract_all(c(diff), F.lit(r"(?m)^\+\+\+ b/(\S+)"), 1)
    return F.array_distinct(F.filter(found, lambda x: x != "/dev/null"))


def diff_line_count(diff) -> Column:
    return F.regexp_count(c(diff), F.lit(r"(?m)^(\+(?!\+\+)|-(?!--))"))


def bad_patterns(text) -> Column:
    """Indexes of the danger patterns that a line meets."""
    return F.filter(F.array(*[F.when(c(text).rlike(f"(?i){p}"), i) for i, p in enumerate(DANGERS)]), lambda x: x.isNotNull())


def calls(body) -> Column:
    """Names that are called in a body."""
    return F.array_distinct(F.regexp_extract_all(c(body), F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*[(.]"), 1))


def sse(*cols) -> Column:
    return F.format_string("data: %s\n\n", F.to_json(F.struct(*cols)))
