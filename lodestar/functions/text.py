"""String expressions: tokenising, templates, quotes, names, mark-up, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a word separator; Java's class lacks the four information separators.
WHITE = r"(?U)[\s\x1c-\x1f]+"
NOT_TERM = r"[^\p{L}\p{N}]+"

# Markup, personal data and injected instructions, valid in Java and RE2 alike.
MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]+>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
ADDRESS = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
INJECTION = (
    r"(?i)(ignore|disregard|forget)\s+(all\s+|any\s+)?(previous|prior|above)\s+(instructions|rules|prompts)"
    r"|you\s+are\s+now\s+|system\s+prompt|reveal\s+your\s+(instructions|prompt)"
)


def words(text: Column) -> Column:
    """Non-empty tokens between Unicode white space."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, for lexical search."""
    return F.array_remove(F.split(F.lower(text), NOT_TERM), "")


def suffix(name: Column) -> Column:
    """Lower-cased file suffix; leading dots alone, and a dot at the end, make none."""
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))


def fill_template(template: Column, question: Column, context: Column) -> Column:
    """Question first, then context, so a question that holds the context mark is expanded too."""
    asked = F.replace(template, F.lit("{question}"), question)
    return F.replace(asked, F.lit("{context}"), context)


def quote(text: Column, size: int = 280) -> Column:
    return F.substring(text, 1, size)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^" + WHITE, ""), WHITE + "$", "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def join_blocks(blocks: Column) -> Column:
    """The texts of an array of (type, text) blocks of type text, joined and stripped."""
    return strip(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), ""))


def or_default(value: Column, default) -> Column:
    """The default replaces null and the empty string alike."""
    return F.coalesce(F.nullif(value, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def safe_name(value: Column) -> Column:
    return F.translate(or_default(value, "default"), "/:", "_-")


def without_trailing_slashes(value: Column) -> Column:
    return F.regexp_replace(value, "/+$", "")


def truthy(value: Column) -> Column:
    return F.coalesce(F.length(value) > 0, F.lit(False))


def html_to_text(html: Column) -> Column:
    text = F.regexp_replace(html, MARKUP, " ")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def redact(text: Column) -> Column:
    text = F.regexp_replace(text, EMAIL, "[email]")
    text = F.regexp_replace(text, ADDRESS, "[ip]")
    return F.regexp_replace(text, PHONE, "[phone]")


def injected(text: Column) -> Column:
    return F.coalesce(text.rlike(INJECTION), F.lit(False))


def sentences(text: Column) -> Column:
    """Pieces that end in a stop, question or exclamation mark, or a line end."""
    cut = F.split(F.regexp_replace(text, r"([.!?])[ \n]+", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")
