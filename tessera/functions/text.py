"""Column functions on text: tokens, sanitising, line measures, formatting. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_tokens(text: Column) -> Column:
    """Lower-case tokens of code or prose: camel case and underscores split, single characters dropped."""
    # two letters beyond ASCII (dotted I, Kelvin sign) have lower cases in it: they go before the text is lowered
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "(?<=[a-z])(?=[A-Z])|[\u0130\u212a]", " ")
    return F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]{2,}"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("long")


def sanitized(text: Column, most: int = 8000, printable: bool = False) -> Column:
    """Text fit for an embedding model: control characters out, blanks and empty lines collapsed, cut, trimmed.

    ``printable`` keeps all that isn't a control or unassigned character; else
    tab, newline, return, printable ASCII and what lies above U+00A0.
    """
    bad = r"[\p{C}&&[^\n\t\r]]" if printable else r"[^\n\t\r\x20-\x7E\x{A0}-\x{10FFFF}]"
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, bad, ""), "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(F.substring(clean, 1, most), r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def line_metrics(text: Column) -> Column:
    """Struct of total, blank, comment (# after blanks) and code lines, and the share of comments among lines that aren't blank."""
    lines = F.split(text, "\n")
    blank = F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t\r]*$")))
    comment = F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t]*#")))
    code = F.size(lines) - blank - comment
    ratio = F.when(code + comment > 0, comment / (code + comment)).otherwise(F.lit(0.0))
    longs = [c.cast("long").alias(n) for c, n in ((F.size(lines), "total_lines"), (blank, "blank_lines"), (comment, "comment_lines"), (code, "code_lines"))]
    return F.struct(*longs, F.round(ratio, 6).alias("comment_ratio"))


def style_lint(text: Column, longest: int = 120, most: int = 10) -> Column:
    """Struct of long, trailing-blank and mixed-indent line counts, the longest line, and the first issues."""
    lines = F.split(text, "\n")
    checks = (("long_lines", lambda x: F.length(x) > longest), ("trailing_blanks", lambda x: x.rlike(r"[ \t]$")), ("mixed_indent", lambda x: x.contains("\t") & x.contains("    ")))
    counts = [F.size(F.filter(lines, f)).cast("long").alias(n) for n, f in checks]
    found = F.flatten(F.transform(lines, lambda x, i: F.array_compact(F.array(*[F.when(f(x), F.concat_ws(":", (i + 1).cast("string"), F.lit(n))) for n, f in checks]))))
    width = F.coalesce(F.array_max(F.transform(lines, lambda x: F.length(x))), F.lit(0)).cast("long")
    return F.struct(*counts, width.alias("longest_line"), F.slice(found, 1, most).alias("issues"))


def format_duration(seconds: Column) -> Column:
    """``0h 2m 5.50s``; negative is zero."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    return F.format_string("%dh %dm %.2fs", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def retry_delay(attempt: Column, initial: float = 1.0, base: float = 2.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Exponential back-off; ``jitter`` from 0 to 1 scales it to between a half and the whole."""
    delay = F.least(F.lit(initial) * F.pow(F.lit(base), attempt), F.lit(most))
    return delay if jitter is None else delay * (F.lit(0.5) + jitter * 0.5)


def error_category(message: Column) -> Column:
    """Category of an exception name or message; time-outs first."""
    low = F.lower(message)
    rules = (("timeout", "TIMEOUT"), ("connection", "NETWORK"), ("network", "NETWORK"), ("permission", "AUTHORIZATION"), ("auth", "AUTHENTICATION"), ("database", "DATABASE"), ("sqlite", "DATABASE"), ("memory", "RESOURCE"), ("valid", "VALIDATION"), ("value", "VALIDATION"), ("notfound", "FILE_SYSTEM"), ("file", "FILE_SYSTEM"))
    out = F.lit("UNKNOWN")
    for part, name in reversed(rules):
        out = F.when(low.contains(part), name).otherwise(out)
    return out


def http_status(code: Column) -> Column:
    """Status of an error code; 500 for an unknown one."""
    table = {"VALIDATION_ERROR": 400, "AUTHENTICATION_ERROR": 401, "AUTHORIZATION_ERROR": 403, "NOT_FOUND": 404, "TIMEOUT": 408, "CONFLICT": 409, "RATE_LIMITED": 429, "NOT_IMPLEMENTED": 501, "SERVICE_UNAVAILABLE": 503}
    out = F.lit(500)
    for name, status in table.items():
        out = F.when(code == name, status).otherwise(out)
    return out


def resource_status(percent: Column) -> Column:
    """Over 90 unhealthy, over 80 degraded."""
    return F.when(percent > 90, "unhealthy").when(percent > 80, "degraded").otherwise("healthy")


def glob_regex(glob: str) -> str:
    """A glob as a regular expression anchored on path components."""
    out = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "/_-" else "\\" + c for c in glob.rstrip("/"))
    return f"(^|/){out}(/|$)"
