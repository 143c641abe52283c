"""Scalar text functions as native column expressions.

Offsets are 0-based and count code points. `\\b` of the rules is ASCII: Java's own is Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundary for Java regular expressions.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Stop words of the two scoring functions and the prefixes of handles.
ROUTER_STOP = ("the", "a", "an", "on", "in", "to", "for", "my", "me", "and", "of", "with", "please", "click", "press", "tap", "hit", "go", "then", "button", "link", "this", "that")
PLANNER_STOP = ("the", "a", "an", "to", "on", "in", "my", "and", "of", "for", "please", "button")
HANDLE_PREFIXES = ("SECRET", "OTP", "EMAIL", "PHONE", "PERSON", "ADDR", "CARD", "AADHAAR", "PAN", "IFSC", "UPI", "DOB", "FACE", "IDDOC", "DOC", "SCREEN", "SIGN", "PII")

HANDLE = f"(?:{'|'.join(HANDLE_PREFIXES)})_[0-9]+"


def bounded(pattern: str) -> str:
    return EDGE + pattern + EDGE


def clean(text: Column, most: int = 120) -> Column:
    """White space collapsed, trimmed, cut."""
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(most))


def norm(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def clamp(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def round2(x: Column) -> Column:
    return F.floor(x.cast("double") * 100 + 0.5) / F.lit(100.0)


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, bits per character; 0 for empty text."""
    letters, n = chars(text), F.length(text)
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / n
    total = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda h, c: h - share(c) * F.log2(share(c)))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, eight hex digits in lower case."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.lpad(F.lower(F.hex(F.aggregate(chars(text), F.lit(2166136261).cast("long"), step))), 8, "0")


def snap8(x: Column) -> Column:
    return (F.floor(x.cast("double") / 8 + 0.5) * 8).cast("int")


def signature(tag: Column, role: Column, name: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return fnv1a(F.concat_ws("|", tag, role, name, *(snap8(v).cast("string") for v in (x, y, w, h))))


def url_class(url: Column) -> Column:
    """Host and path with id-like segments replaced."""
    host, path = F.parse_url(url, F.lit("HOST")), F.parse_url(url, F.lit("PATH"))
    return F.concat(host, F.regexp_replace(path, r"(?i)/[0-9a-f-]{6,}(?=/|$)", "/:id"))


def tokens(text: Column, stop: tuple[str, ...] = ROUTER_STOP) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def _cover(task: Column, name: Column, stop: tuple[str, ...]) -> Column:
    t, n = tokens(task, stop), tokens(name, stop)
    return F.when(F.size(n) > 0, F.size(F.filter(n, lambda w: F.array_contains(t, w))) / F.size(n)).otherwise(F.lit(0.0))


def name_score(task: Column, name: Column) -> Column:
    """Share of a control's name tokens that the task has; short names verbatim in the task score 0.95 at least."""
    n = F.lower(F.trim(name))
    cover = _cover(task, n, ROUTER_STOP)
    whole = (F.length(n) <= 24) & F.contains(F.lower(task), n) & (F.size(tokens(n)) > 0)
    return F.when(F.length(n) < 2, F.lit(0.0)).when(whole, F.greatest(cover, F.lit(0.95))).otherwise(cover)


def planner_score(task: Column, name: Column) -> Column:
    n = F.lower(F.trim(name))
    return F.when(F.length(n) < 2, F.lit(0.0)).when((F.length(n) >= 3) & F.contains(task, n), F.lit(1.0)).otherwise(_cover(task, n, PLANNER_STOP))


def is_handle(text: Column) -> Column:
    return F.trim(text).rlike(f"^{HANDLE}$")


def strip_handles(text: Column) -> Column:
    return F.regexp_replace(text, bounded(HANDLE), " ")


def looks_like_pii(text: Column) -> Column:
    return text.rlike(r"@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}") | F.regexp_replace(text, r"[\s-]", "").rlike(bounded("[0-9]{10,}"))


#: Literals that the reply guard blocks.
GUARD = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    bounded(r"[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}"),
    bounded(r"(?:[0-9][ -]?){13,19}"),
    bounded(r"[6-9][0-9]{9}"),
)


def guarded(reply: Column) -> Column:
    """True where a reply holds a literal that looks personal once handles are taken out."""
    bare = strip_handles(reply)
    found = F.lit(False)
    for pattern in GUARD:
        found = found | bare.rlike(pattern)
    return found


def compare_ingestion(actual: Column, expected: Column) -> Column:
    """struct(verified, expected_len, actual_len, reason)."""
    bare = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    reason = (
        F.when(actual == expected, "exact match").when(F.length(actual) == 0, "field is empty").when(bare(actual) == bare(expected), "match after formatting")
        .when(F.startswith(expected, actual), F.concat(F.lit("truncated to "), F.length(actual).cast("string"), F.lit(" of "), F.length(expected).cast("string"))).otherwise("different")
    )
    return F.struct(reason.isin("exact match", "match after formatting").alias("verified"), F.length(expected).alias("expected_len"), F.length(actual).alias("actual_len"), reason.alias("reason"))


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.format_string("%.1f KB", n.cast("double") / 1024)).otherwise(F.format_string("%.2f MB", n.cast("double") / 1048576))


def short_url(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def passphrase_strength(p: Column) -> Column:
    """Band 0 to 3 of alphabet size bits times length."""
    size = sum((F.when(p.rlike(r), n).otherwise(0) for r, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^a-zA-Z0-9]", 32))), F.lit(0))
    bits = F.length(p) * F.log2(F.greatest(size, F.lit(2)).cast("double"))
    return F.when((F.length(p) < 8) | (bits < 40), 0).when(bits < 60, 1).when(bits < 80, 2).otherwise(3)


def confirm_text(url: Column) -> Column:
    return F.concat(F.lit("Navigate to "), F.try_parse_url(url, F.lit("HOST")), F.lit("?"))
