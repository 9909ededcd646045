"""Text expressions: names, pointers, visible text, previews, cells and excerpts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of secrets by shape.
SECRET_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("cloud_key", r"\b(AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("bearer", r"(?i)\bbearer\s+[a-z0-9._\-]{16,}"),
    ("assigned", r"(?i)\b(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*\S{8,}"),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\."),
    ("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)
CELL_LIMIT = 32767


def normalised_name(name: Column) -> Column:
    """camelCase and any punctuation become lower_snake."""
    snake = F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", "_"))
    return F.regexp_replace(F.regexp_replace(snake, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def pointer_part(name: Column) -> Column:
    """A name as part of a JSON pointer."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def decoded_entities(text: Column) -> Column:
    pairs = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def chunks_text(html: Column) -> Column:
    """Every text between tags, scripts too, trimmed and joined by newlines."""
    parts = F.transform(
        F.split(F.regexp_replace(html, "(?s)<!--.*?-->", "<>"), "<[^>]*>"), lambda p: F.trim(F.regexp_replace(decoded_entities(p), r"\s+", " "))
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def without_hidden(html: Column) -> Column:
    bare = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    return reduce(lambda h, t: F.regexp_replace(h, f"(?is)<{t}\\b.*?</{t}>", ""), ("script", "style", "noscript"), bare)


def visible_text(html: Column) -> Column:
    """Text without scripts and styles, as one line."""
    return F.trim(F.regexp_replace(decoded_entities(F.regexp_replace(without_hidden(html), "<[^>]*>", " ")), r"\s+", " "))


def block_text(html: Column) -> Column:
    """Text without scripts and styles; block tags end lines, blank lines go."""
    lined = F.regexp_replace(without_hidden(html), r"(?i)</?(p|div|li|ul|ol|tr|table|h[1-6]|article|nav|footer|header|section|br|title)\b[^>]*>", "\n")
    plain = decoded_entities(F.regexp_replace(lined, "<[^>]*>", ""))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def folded_words(text: Column) -> Column:
    """Lower-case letters and digits, words set apart by one space, with one at both ends: phrases are found as ' a b '."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def has_phrase(text: Column, phrase: Column) -> Column:
    return F.contains(folded_words(text), folded_words(phrase))


def like_any(columns: list[Column], needle: str) -> Column:
    """Whether any column holds needle, letters of any case, wildcards taken as they are."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(Column.__or__, [F.coalesce(c.cast("string").ilike(f"%{escaped}%"), F.lit(False)) for c in columns])


def preview(text: Column, limit: int) -> tuple[Column, Column]:
    """The first characters, and whether any are missing."""
    return F.when(F.length(text) > limit, F.substring(text, 1, limit)).otherwise(text), F.coalesce(F.length(text) > limit, F.lit(False))


def slice_of(text: Column, offset: Column | int, size: int) -> Column:
    start = offset if isinstance(offset, Column) else F.lit(offset)
    return F.substring(text, start + 1, F.lit(size))


def safe_cell(text: Column, limit: int = CELL_LIMIT) -> Column:
    """A cell that no spreadsheet takes for a formula or a number, cut to the limit."""
    guarded = F.when(F.rlike(text, F.lit(r"^[=+\-@\t\r]")) | F.rlike(text, F.lit(r"^0\d+$|^\d{16,}$")), F.concat(F.lit("'"), text)).otherwise(text)
    return F.substring(guarded, 1, limit)


def excerpt(text: Column, needle: str, before: int = 120, after: int = 260, limit: int = 500) -> Column:
    """What stands around the first place of needle, white space made one; null without a hit."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.locate(needle.lower(), F.lower(flat))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(F.substring(flat, start, at - start + len(needle) + after), F.lit(1), F.lit(limit)))


def human_bytes(size: Column) -> Column:
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    case = F.format_string("%d B", size.cast("long"))
    for k, unit in enumerate(units[1:], 1):
        case = F.when(size >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(size / float(1024**k), 1))).otherwise(case)
    return case


def line_safe(json: Column) -> Column:
    """JSON whose line separators cannot be taken for line ends."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("\u0085", "\\u0085"), (" ", "\\u2028"), (" ", "\\u2029")), json)


def safe_relative(path: Column) -> Column:
    """A path as it may stand in a package: slashes only, no drive, no root, no step up; null if it is none."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", "."))
    unsafe = plain.startswith("/") | F.rlike(plain, F.lit("^[A-Za-z]:")) | F.exists(parts, lambda p: p == "..") | (F.size(parts) == 0) | plain.contains("\0")
    return F.when(~unsafe, F.array_join(parts, "/"))


def resolved_inside(root: str, path: Column) -> Column:
    """The path below root that a relative or absolute path names; null if it leads out of it."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    relative = F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 20)).otherwise(plain)
    return F.concat(F.lit(base), safe_relative(relative))


def denied_terms(line: Column, terms: tuple[str, ...]) -> Column:
    """Terms that must not stand in a line, whatever their case, in the order given."""
    return F.array_join(F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.lower(line).contains(F.lower(t))), ",")
