"""Column functions over paths, URLs, type names and claims. Null in, null out, unless it says otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that are scanned and their languages.
LANGUAGES = {
    "java": "java", "vue": "vue", "js": "javascript", "ts": "typescript", "go": "go", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp",
    "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "py": "python", "rs": "rust", "sql": "sql", "yml": "yaml", "yaml": "yaml", "xml": "xml",
}
# Directories that are never scanned, and the largest file.
IGNORED = (".git", ".idea", ".vscode", "node_modules", "target", "dist", "build", "coverage", ".gradle", ".mvn", "vendor", "__pycache__")
MAX_BYTES = 524_288
# Path parts of tests and examples.
TEST_PARTS = ("test", "tests", "fixture", "fixtures", "example", "examples", "demo")
# The five levels, highest first.
CRITICAL, MEDIUM, MINOR, SUGGESTION, MANUAL = "严重 Bug", "中等 Bug", "轻度 Bug", "优化建议", "需人工确认"
RANKS = {CRITICAL: 4, MEDIUM: 3, MINOR: 2, SUGGESTION: 1, MANUAL: 0}
SEVERITY_ALIASES = {
    CRITICAL: ("严重 bug", "严重", "critical", "p0"),
    MEDIUM: ("中等 bug", "中等", "high", "medium", "p1", "p2"),
    MINOR: ("轻度 bug", "轻度", "low", "warning", "p3"),
    SUGGESTION: ("优化建议", "优化", "optimization", "info"),
}


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def language(path: Column | str) -> Column:
    """Language of a path's suffix, lower-cased; null if the suffix is unknown. A bare ``.java`` has no suffix."""
    # No pattern: filters and columns each ask for the language again, of all files.
    name = F.substring_index(as_column(path), "/", -1)
    suffix = F.substring_index(name, ".", -1)
    # Looked up once: a chain of conditions would cut the suffix again for each language.
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.lower(suffix))
    return F.when(F.length(suffix) + 1 < F.length(name), known)


def is_scannable(path: Column | str, size: Column | str) -> Column:
    ignored = as_column(path).rlike("(?:^|/)(?:" + "|".join(map(re.escape, IGNORED)) + r")(?:/|\z)")
    return ~ignored & (as_column(size) <= MAX_BYTES)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(content: Column | str) -> Column:
    content = as_column(content)
    return F.when(content == "", 0).otherwise(newlines(content) + 1).cast("int")


def is_test_or_example(path: Column | str) -> Column:
    parts = F.split(F.lower(as_column(path)), "/")
    return F.exists(parts, lambda p: p.isin(*TEST_PARTS) | p.startswith("test_") | p.endswith("_test"))


def module_scope(path: Column | str) -> Column:
    path = as_column(path)
    return F.when(path.contains("/src/"), F.substring_index(path, "/src/", 1)).otherwise(F.substring_index(path, "/", 1))


def normalize_url(url: Column | str) -> Column:
    """Path of a URL with its variables as {}, one slash between parts, none at the end but for the root."""
    out = F.substring_index(F.trim(as_column(url)), "?", 1)
    for pattern, new in ((r"^https?://[^/]+", ""), (r"\$\{[^}]+\}", "{}"), (r"\{[^}]+\}", "{}"), (r"/:[^/]+", "/{}"), ("/+", "/")):
        out = F.regexp_replace(out, pattern, new)
    out = F.when((out != "") & ~out.startswith("/"), F.concat(F.lit("/"), out)).otherwise(out)
    out = F.regexp_replace(out, "/+$", "")
    return F.when(out == "", "/").otherwise(out)


def join_url(prefix: Column | str, suffix: Column | str) -> Column:
    prefix, suffix = as_column(prefix), as_column(suffix)
    both = F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(suffix, "^/+", ""))
    return normalize_url(F.when(prefix == "", suffix).when(suffix == "", prefix).otherwise(both))


def normalize_type(name: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(as_column(name), "<.*>", ""), r"\[\]|\?", "")
    return F.trim(F.substring_index(bare, ".", -1))


def snake_case(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(as_column(name), "(?<!^)(?=[A-Z])", "_"))


def stable_id(kind: str, path: Column | str, line: Column | str, name: Column | str) -> Column:
    return F.concat_ws(":", F.lit(kind), as_column(path), as_column(line).cast("string"), F.regexp_replace(as_column(name), r"\s+", ""))


def squeezed(text: Column | str) -> Column:
    """White space squeezed."""
    return F.trim(F.regexp_replace(as_column(text), r"\s+", " "))


def compact(text: Column | str) -> Column:
    """White space squeezed, at most 500 characters."""
    return F.substring(squeezed(text), 1, 500)


def contains_any(text: Column | str, words: Iterable[str]) -> Column:
    text = as_column(text)
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def has_sql_injection_sink(content: Column | str) -> Column:
    content = as_column(content)
    return content.contains("${") | content.rlike(r"""(?is)\b(select|update|delete|insert)\b.{0,240}?["']\s*\+\s*[A-Za-z_(]""")


def has_expiry(content: Column | str) -> Column:
    content = as_column(content)
    low = F.lower(content)
    ttl = contains_any(low, ("expireafter", "time-to-live", "ttl", "setex", "expire("))
    scheduled = contains_any(low, ("thread.sleep", "@scheduled", "timer", "scheduleatfixedrate"))
    return ttl | (contains_any(content, (".clear(", ".remove(")) & scheduled)


def normalize_severity(value: Column | str) -> Column:
    low = F.lower(F.trim(as_column(value)))
    out = F.lit(MANUAL)
    for level, names in SEVERITY_ALIASES.items():
        out = F.when(low.isin(*names), level).otherwise(out)
    return out


def as_bool(value: Column | str) -> Column:
    """Whether a text says yes; null is no."""
    return F.coalesce(F.lower(F.trim(as_column(value))).isin("true", "1", "yes", "是"), F.lit(False))


def severity_rank(severity: Column | str) -> Column:
    severity = as_column(severity)
    out = F.lit(0)
    for level, rank in RANKS.items():
        out = F.when(severity == level, rank).otherwise(out)
    return out


def ratio(part: Column | str, whole: Column | str) -> Column:
    """Rounded to four digits; 1 if there is nothing to share."""
    return F.when(as_column(whole) == 0, 1.0).otherwise(F.round(as_column(part) / as_column(whole), 4))
