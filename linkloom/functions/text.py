"""Text expressions. Everything here is a native column expression."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_CHARS = 100
SCRAPE_BYTES = 50_000
MODEL_BYTES = 10_000
EMBED_BYTES = 30_000

TOKEN_GAP = r"[^\p{L}\p{N}\p{Co}]+"


def trim_ws(c: Column) -> Column:
    """Trim Unicode white space; the built-in ``trim`` only knows U+0020.

    The look-behind keeps the trailing branch linear on long inner runs of white space.
    """
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++\z", "")


def stable_id(url: Column) -> Column:
    """First 8 bytes of SHA-256 of the url, as 16 hex characters."""
    return F.substring(F.sha2(url, 256), 1, 16)


def title_from_content(content: Column, fallback: Column) -> Column:
    """First line of the first 100 characters, minus a leading ``title:`` marker."""
    line = F.substring_index(F.left(F.coalesce(content, F.lit("")), F.lit(TITLE_CHARS)), "\n", 1)
    trimmed = trim_ws(line)
    rest = trim_ws(F.substring(trimmed, 7, TITLE_CHARS))
    marked = F.lower(F.left(trimmed, F.lit(6))) == "title:"
    return (
        F.when(line == "", fallback)
        .when(marked & (rest != ""), rest)
        .when(marked & (fallback != ""), fallback)
        .otherwise(line)
    )


def is_url_only_title(title: Column) -> Column:
    """Blank, or one single word starting with ``http://`` or ``https://``."""
    t = trim_ws(F.coalesce(title, F.lit("")))
    return (t == "") | t.rlike(r"(?U)^https?://\S*\z")


def byte_cap(c: Column, n: int) -> Column:
    """At most ``n`` bytes of UTF-8, never ending inside a character."""
    raw = c.cast("binary")
    cut = F.make_valid_utf8(F.substring(raw, 1, n).cast("string"))
    inside_character = F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")
    return F.when(F.octet_length(c) <= n, c).otherwise(
        F.when(inside_character, F.regexp_replace(cut, r"\x{FFFD}\z", "")).otherwise(cut)
    )


def snippet(c: Column, limit: int, keep: int | None = None) -> Column:
    """``c`` unless longer than ``limit`` bytes, else its first ``keep`` bytes and ``...``."""
    cut = F.concat(byte_cap(c, limit if keep is None else keep), F.lit("..."))
    return F.when(F.octet_length(c) > limit, cut).otherwise(c)


def sanitize_line(c: Column) -> Column:
    """One display line: line breaks to spaces, runs of spaces collapsed, trimmed."""
    return trim_ws(F.regexp_replace(F.regexp_replace(c, r"[\n\r]", " "), " {2,}", " "))


def text_to_embed(title: Column, summary: Column, keywords: Column) -> Column:
    """Title, summary and keywords joined by single spaces; also the filter haystack."""
    blank = F.lit("")
    return F.concat(
        F.coalesce(title, blank),
        F.lit(" "),
        F.coalesce(summary, blank),
        F.lit(" "),
        F.coalesce(keywords, blank),
    )


# --- tokens ---------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Accented lower-case letters and their base letters.

    Built from the Unicode decomposition rule: a letter that decomposes into one base letter
    followed only by combining marks maps to that base letter.
    """
    src, dst = [], []
    for code in range(0xC0, 0x2000):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) < 2 or not unicodedata.category(ch).startswith("L") or ch != ch.lower():
            continue
        if all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            src.append(ch)
            dst.append(parts[0])
    return "".join(src), "".join(dst)


def fold(c: Column) -> Column:
    """Lower-case without combining marks and accents. Plain ASCII takes the short way."""
    low = F.lower(c)
    src, dst = accent_table()
    folded = F.translate(F.regexp_replace(low, r"\p{Mn}+", ""), src, dst)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(folded)


def token_text(c: Column) -> Column:
    """The tokens of ``c`` separated by single spaces, with no space at either end."""
    return F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), TOKEN_GAP, " "))


def token_count(tokens: Column) -> Column:
    """Number of tokens in a ``token_text`` value."""
    gaps = F.octet_length(tokens) - F.octet_length(F.replace(tokens, F.lit(" "), F.lit("")))
    return F.when(tokens == "", F.lit(0)).otherwise(gaps + 1)


def prefix_count(tokens: Column, term: str) -> Column:
    """How many tokens of a ``token_text`` value start with ``term``."""
    probe = " " + term
    padded = F.concat(F.lit(" "), tokens)
    removed = F.octet_length(padded) - F.octet_length(F.replace(padded, F.lit(probe), F.lit("")))
    return (removed / F.lit(len(probe.encode("utf-8")))).cast("int")


class _TokenChars(dict):
    """Character map of the token rules for ``str.translate``, filled as characters turn up."""

    def __init__(self):
        super().__init__(str.maketrans(*accent_table()))

    def __missing__(self, code: int) -> str:
        kind = unicodedata.category(chr(code))
        kept = chr(code) if kind[0] in "LN" or kind == "Co" else " "
        self[code] = "" if kind == "Mn" else kept
        return self[code]


@lru_cache(maxsize=1)
def _token_chars() -> _TokenChars:
    return _TokenChars()


def query_tokens(text: str) -> list[str]:
    """Tokens of one string, by the same rules as ``token_text``."""
    return [t for t in text.lower().translate(_token_chars()).split(" ") if t]
