"""Text cleaning, tokens, stems and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control, bidirectional and zero-width characters that texts must not hold. Tab, LF, CR and NEL may stay.
UNSAFE = r"[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F-\u0084\u0086-\u009F\u200B-\u200F\u202A-\u202E\u2066-\u2069\uFEFF\uFFF9-\uFFFC\uFFFE]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize(c) -> Column:
    """Without unsafe characters and outer white space."""
    return F.regexp_replace(F.regexp_replace(_col(c), UNSAFE, ""), r"^\s+|\s+$", "")


def display_name(c, limit: int) -> Column:
    """Sanitised, white space collapsed, at most ``limit`` characters; null if nothing is left."""
    return F.nullif(F.left(F.regexp_replace(sanitize(c), r"\s+", " "), F.lit(limit)), F.lit(""))


def filename(c, fallback) -> Column:
    """Without path separators and parent references, at most 255 characters; ``fallback`` if nothing is left."""
    clean = F.left(F.replace(F.regexp_replace(sanitize(c), r"[/\\]", ""), F.lit(".."), F.lit("")), F.lit(255))
    return F.coalesce(F.nullif(clean, F.lit("")), _col(fallback))


def is_relative_path(c) -> Column:
    """Whether a path stays below its root."""
    p = F.replace(_col(c), F.lit("\\"), F.lit("/"))
    return (p != "") & ~p.startswith("/") & ~p.rlike(r"^[A-Za-z]:") & ~p.rlike(r"(^|/)\.\.(/|$)") & ~p.contains("\u0000")


def normalise_tag(c) -> Column:
    """Lower case and sanitised; null unless 1 to 100 bytes long."""
    t = F.lower(sanitize(c))
    return F.when(F.octet_length(t).between(1, 100), t)


def tag(kind: str, label) -> Column:
    """``kind:label``, with Unknown for a missing label."""
    return F.concat(F.lit(f"{kind}:"), F.coalesce(F.nullif(_col(label), F.lit("")), F.lit("Unknown")))


def slug(c) -> Column:
    return F.lower(F.replace(_col(c), F.lit(" "), F.lit("-")))


def query_tokens(query: str) -> list[str]:
    return query.lower().split()


def stems(token: str) -> list[str]:
    """The token and what common English endings leave of it."""
    out = [token]
    if len(token.encode()) > 4:
        for ending, tail in (("ing", ""), ("ed", ""), ("es", ""), ("s", ""), ("tion", "t"), ("ly", "")):
            if not token.endswith(ending) or (ending == "s" and token.endswith("es")):
                continue
            stem = token[: -len(ending)] + tail
            out.append(stem)
            if ending == "ing" and len(stem) > 2 and stem[-1] == stem[-2]:
                out.append(stem[:-1])
    return list(dict.fromkeys(out))


def matches_all(text, query: str) -> Column:
    """Every token of the query, or a stem of it, occurs in the lower-cased text."""
    low = F.lower(_col(text))
    hit = F.lit(True)
    for token in query_tokens(query):
        any_of = F.lit(False)
        for s in stems(token):
            any_of = any_of | low.contains(s)
        hit = hit & any_of
    return hit


def _begins(token: str):
    return lambda w: (F.length(w) >= 3) & F.startswith(F.lit(token), w)


def _one_edit_from(token: str):
    return lambda w: w.startswith(token[0]) & (F.levenshtein(w, F.lit(token), 1) >= 0)


def fuzzy_matches(text, query: str) -> Column:
    """As matches_all, or a word shares a prefix of 3 with the token's stem, or is one edit from a long token."""
    low = F.lower(_col(text))
    words = F.split(low, r"[^\p{L}\p{N}]+")
    hit = F.lit(True)
    for token in query_tokens(query):
        any_of = F.lit(False)
        for s in stems(token):
            any_of = any_of | low.contains(s)
        if len(token) >= 3:
            any_of = any_of | F.exists(words, _begins(token))
        if len(token) >= 7:
            any_of = any_of | F.exists(words, _one_edit_from(token))
        hit = hit & any_of
    return hit


def original_of_edited(name) -> Column:
    """The name without an "-edited" ending before its extension; null if it has none."""
    found = F.regexp_extract(_col(name), r"(?is)^(.*)-edited(\.[^.]*)$", 1)
    whole = F.concat(found, F.regexp_extract(_col(name), r"(?is)^(.*)-edited(\.[^.]*)$", 2))
    return F.when(_col(name).rlike(r"(?is)^.*-edited\.[^.]*$"), whole)


def bytes_label(n) -> Column:
    """A size in B, KB, MB or GB with one decimal; null for null."""
    c = _col(n).cast("double")
    return F.when(c.isNull(), F.lit(None)).when(c < 1024, F.format_string("%.0f B", c)).when(c < 1024**2, F.format_string("%.1f KB", F.round(c / 1024, 1))).when(c < 1024**3, F.format_string("%.1f MB", F.round(c / 1024**2, 1))).otherwise(F.format_string("%.1f GB", F.round(c / 1024**3, 1)))


def content_hash(c) -> Column:
    """The first 12 hex digits of SHA-256."""
    return F.substring(F.sha2(_col(c), 256), 1, 12)
