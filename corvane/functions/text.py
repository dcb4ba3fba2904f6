"""Column functions on paths, text and hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that a scan never enters, at any depth.
SKIPPED_DIRS = ("node_modules", "__pycache__", ".venv", "venv", ".env", "target", "dist", "build", ".git", ".obsidian", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".next", ".nuxt", ".cache", "coverage", ".coverage")
# What makes a file a document rather than code.
DOC_LANGUAGES = ("markdown", "md", "rst", "asciidoc")
DOC_DIRS = ("/docs/", "/doc/", "/spec/", "/specs/", "/standards/", "/vault/", "/playbooks/", "/decisions/", "/episodes/")
DOC_EXTENSIONS = (".md", ".mdx", ".rst", ".adoc", ".txt")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_path(path: Column | str) -> Column:
    return F.regexp_replace(F.translate(col(path), "\\", "/"), "^(?:\\./)+", "")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(col(path), "/+$", ""), "/"), -1)


def stem(path: Column | str) -> Column:
    """The last part without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), "(?<=.)\\.[^.]+$", "")


def is_skipped(path: Column | str) -> Column:
    return F.arrays_overlap(F.split(F.translate(col(path), "\\", "/"), "/"), F.array(*map(F.lit, SKIPPED_DIRS)))


def has_extension(path: Column | str, *extensions: str) -> Column:
    low = F.lower(col(path))
    out = F.lit(False)
    for e in extensions:
        out = out | low.endswith(e.lower())
    return out


def is_document(path: Column | str, language: Column | str) -> Column:
    """Routes a file to the document store (true) or the code store."""
    low = F.lower(F.translate(col(path), "\\", "/"))
    marked = F.concat(F.lit("/"), low).rlike("|".join(map(re.escape, DOC_DIRS)))
    return F.lower(col(language)).isin(*DOC_LANGUAGES) | marked | has_extension(path, *DOC_EXTENSIONS)


def content_hash(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(text), 256))


def slug(text: Column | str, keep: str = "a-z0-9") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), f"[^{keep}]+", "-"), "^-+|-+$", "")


def glob_regex(pattern: str) -> str:
    """A Java regex for a path glob. With `**` a star stays inside one segment; without it, a star crosses them."""
    pattern = pattern.replace("\\", "/")
    crossing = "**" not in pattern
    parts = {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": ".*" if crossing else "[^/]*", "?": "." if crossing else "[^/]"}
    token = re.compile(r"\[[!]?\]?[^\]]*\]|." if crossing else r"\*\*/|/\*\*|\*\*|.", re.DOTALL)

    def one(m: re.Match) -> str:
        t = m[0]
        if len(t) > 1 and t[0] == "[":
            body = t[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            return f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]"
        return parts.get(t) or re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", t)

    return "(?s)^" + token.sub(one, pattern) + "$"


def glob_match(path: Column | str, pattern: str) -> Column:
    return F.translate(col(path), "\\", "/").rlike(glob_regex(pattern))


def path_selected(path: Column | str, include: list[str], exclude: list[str]) -> Column:
    """Any include (none means all) and no exclude."""
    chosen = F.lit(not include)
    for p in include:
        chosen = chosen | glob_match(path, p)
    for p in exclude:
        chosen = chosen & ~glob_match(path, p)
    return chosen


def lines(text: Column | str) -> Column:
    """Lines without their ends; a final line end begins no line. Empty text has none."""
    parts = F.split(F.regexp_replace(col(text), "\\r\\n|[\\r\\x0B\\f\\x1C-\\x1E\\u0085\\u2028\\u2029]", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def slice_lines(lines_: Column, start: Column, end: Column) -> Column:
    s = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines_, s, F.greatest(F.least(end, F.size(lines_)) - s + 1, F.lit(0))), "\n")


def looks_binary(content: Column | str) -> Column:
    """A NUL byte in the first 8192."""
    return F.instr(F.substring(col(content), 1, 8192).cast("string"), "\x00") > 0


def readable_text(content: Column | str) -> Column:
    """UTF-8 with replacement; null for binary content."""
    return F.when(~looks_binary(content), F.expr("make_valid_utf8(cast({} as string))".format(content)) if isinstance(content, str) else F.make_valid_utf8(content.cast("string")))


def all_matches(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def first_json_object(text: Column | str) -> Column:
    """From the first brace to the last."""
    return F.nullif(F.regexp_extract(col(text), "(?s)(\\{.*\\})", 1), F.lit(""))


def query_parameter(url: Column | str, name: str) -> Column:
    return F.parse_url(col(url), F.lit("QUERY"), F.lit(name))


def label_for(kind: Column | str, labels: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.element_at(F.create_map(*pairs), col(kind)) if pairs else F.lit(None).cast("string")


def contains_any(text: Column, *needles: str) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out
