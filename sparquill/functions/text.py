"""Column expressions over text: hygiene, quality, tokens, features. All are JVM built-ins."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "([A-Za-z0-9]+|[\\u4e00-\\u9fff])"
NOT_DEDUP = "[^0-9a-z\\u4e00-\\u9fff]"


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(text, "\\s+", " ")


def normalized(text: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.lower(F.trim(collapsed(text)))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, and single CJK characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def sanitized(text: Column) -> Column:
    """Line ends unified, tabs as blanks, control characters dropped, blanks collapsed in lines, at most one empty line."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\t", " ")
    t = F.regexp_replace(t, "[\\p{C}&&[^\n]]", "")
    t = F.regexp_replace(t, "[ \\u00a0]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "^\\s+|\\s+$", ""))


def readable(text: Column) -> Column:
    """Letters and digits of a text: what is left when runs of anything else go, which costs a step a run."""
    return F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", ""))


def quality(text: Column) -> Column:
    """binary_like, empty, garbled, too_short or valid."""
    controls = F.length(text) - F.length(F.regexp_replace(text, "[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]+", ""))
    visible = F.length(F.regexp_replace(text, "\\s+", ""))
    alnum = readable(text)
    return (
        F.when(F.contains(text, F.lit("\0")), F.lit("binary_like"))
        .when(text.isNull() | (visible == 0), F.lit("empty"))
        .when(controls > 0.02 * F.length(text), F.lit("garbled"))
        .when((visible >= 12) & (alnum < 0.35 * visible), F.lit("garbled"))
        .when(alnum < 4, F.lit("too_short"))
        .otherwise(F.lit("valid"))
    )


def markdown_inline(text: Column) -> Column:
    """Text without quote marks, list markers, links, code ticks, bold, strike and italics."""
    for pattern, to in (("(?m)^\\s*>+\\s?", ""), ("(?m)^\\s*(?:[-*+]|\\d+[.)])\\s+", ""), ("!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), ("`+([^`]*)`+", "$1"), ("\\*\\*([^*]+)\\*\\*", "$1"), ("~~([^~]+)~~", "$1"), ("\\*([^*\n]+)\\*", "$1")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def shortened(text: Column, limit: int) -> Column:
    """Collapsed text of at most limit characters, cut ones with an ellipsis."""
    t = F.trim(collapsed(text))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)


def line_role(line: Column) -> Column:
    """list_item, field or null, of one line."""
    return F.when(line.rlike("^\\s*([-*+]|[0-9]+[.)])\\s+[^\\s]"), F.lit("list_item")).when(line.rlike("^[^\\s:.|]([^:.|\\n]{0,38}[^\\s:.|])?:\\s*[^\\s]"), F.lit("field"))


def dedup_text(text: Column) -> Column:
    """What near-duplicate checks compare: letters and digits of the text, the first 320 of them."""
    return F.substring(F.regexp_replace(F.lower(text), NOT_DEDUP, ""), 1, 320)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    return F.when(F.length(text) < 2, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 1)), lambda i: F.substr(text, i, F.lit(2)))))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def hash_bucket(token: Column, dimension: int) -> Column:
    """Bucket of a token: the first 32 bits of its SHA-256 modulo dimension."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dimension


def hash_sign(token: Column) -> Column:
    """1 if byte 4 of the token's SHA-256 is even, else -1."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
