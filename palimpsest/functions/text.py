"""Text measures as column expressions; all stay inside the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word (fixed pattern).
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"
#: Adverbs without the usual ending (fixed values).
ADVERBS = ("very", "quite", "rather", "too", "just", "really", "almost", "often", "never", "always", "sometimes", "perhaps", "maybe")


def tokens(text: Column) -> Column:
    """Words of letters and digits, one inner apostrophe allowed."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Runs between blanks, tabs and line ends."""
    return F.size(F.filter(F.split(text, "[ \t\r\n]+"), lambda w: w != "")).cast("long")


def count_tokens(text: Column) -> Column:
    """Token estimate: a quarter of the bytes and one, none of an empty text."""
    return F.when(text == "", F.lit(0)).otherwise(F.floor(F.octet_length(text) / 4) + 1).cast("long")


def byte_prefix(text: Column, most: Column) -> Column:
    """The longest run of whole characters from the start that takes ``most`` bytes at most."""
    head = F.encode(text, "UTF-8")
    # a cut within a character leaves no valid text; one of four neighbouring places is between characters
    some = [F.when(most >= k, F.try_validate_utf8(F.substring(head, F.lit(1), (most - k).cast("int")).cast("string"))) for k in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*some, F.lit("")))


def longest_prefix(text: Column, tokens: int) -> Column:
    """The longest run of whole characters from the start that costs no more than so many tokens."""
    return byte_prefix(text, F.lit(4 * (tokens - 1) + 3)) if tokens > 0 else F.lit("")


def snippet(text: Column, at: Column, size: int = 240, before: int = 80) -> Column:
    """``size`` characters from ``before`` the hit at 0-based ``at``."""
    return F.substring(text, F.greatest(at - before, F.lit(0)) + 1, F.lit(size))


def truncate(text: Column, n: int) -> Column:
    """Text of more than n bytes cut to whole characters of n - 1 bytes and closed with an ellipsis; below 4 only cut."""
    cut = byte_prefix(text, F.lit(n)) if n < 4 else F.concat(byte_prefix(text, F.lit(n - 1)), F.lit("…"))
    return F.when(F.octet_length(text) > n, cut).otherwise(text)


def short_title(text: Column) -> Column:
    """Up to the first clause end within 90 characters, else the last blank within 80."""
    ends = [F.when(F.instr(text, e) > 0, F.instr(text, e)) for e in (". ", "; ", ": ", ", ")]
    clause = F.least(*ends)
    head = F.substring(text, 1, 80)
    # the end itself, since $ also lies before a line feed that ends the text
    cut = F.regexp_replace(head, r"[ \t\n\f\r]+[^ \t\n\f\r]*\z", "")
    return F.when(F.char_length(text) <= 80, text).when(clause <= 90, F.substring(text, F.lit(1), clause - 1)).otherwise(cut)


def sentence_lengths(text: Column) -> Column:
    """Words of each segment between sentence ends that has any."""
    return F.filter(F.transform(F.split(text, "[.!?]"), lambda s: F.size(tokens(s))), lambda n: n > 0)


def adverbs(words: Column) -> Column:
    low = lambda w: F.lower(w)
    return F.size(F.filter(words, lambda w: (low(w).endswith("ly") & (F.char_length(w) > 3)) | low(w).isin(*ADVERBS)))


def quoted_words(text: Column) -> Column:
    """Words between quotation marks that open and close in turn; an unclosed one does not count."""
    parts = F.split(text, '["“”]')
    inside = F.filter(parts, lambda x, i: (i % 2 == 1) & (i < F.size(parts) - 1))
    return F.aggregate(inside, F.lit(0), lambda n, x: n + F.size(tokens(x)))


def strip_markup(html: Column) -> Column:
    """Tags become blanks, five usual entities are decoded, ends trimmed."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(out)


#: Character references by name; those that may lack the semicolon, the longest first; and what the numbers 128 to 159 mean.
NAMED = {name[:-1]: sign for name, sign in html5.items() if name.endswith(";")}
LOOSE = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}


def decode_references(text: Column) -> Column:
    """Character references of HTML, by number or name, once and from left to right; what is none stays, a number that is no character becomes U+FFFD."""
    lookup = lambda d: F.from_json(F.lit(json.dumps(d)), "map<string,string>")  # noqa: E731 (a constant, parsed once)

    def character(digits: Column, base: int) -> Column:
        short = F.regexp_replace(digits, "^0+", "")
        n = F.when(F.char_length(short) <= 7, F.conv(short, base, 10).cast("int")).otherwise(F.lit(0))
        valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        coded = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(lookup(WINDOWS), n.cast("string")), coded)

    def read(piece: Column) -> Column:
        number, digits = F.regexp_extract(piece, "^#([0-9]+);?", 0), F.regexp_extract(piece, "^#([0-9]+)", 1)
        hexed, hexes = F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+);?", 0), F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+)", 1)
        name, loose = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1), F.regexp_extract(piece, f"^({'|'.join(LOOSE)})", 1)
        after = lambda c, more=0: F.substring(piece, F.char_length(c) + 1 + more, F.char_length(piece))
        named = F.try_element_at(lookup(NAMED), F.when(name != "", name))
        return (
            F.when(number != "", F.concat(character(digits, 10), after(number))).when(hexed != "", F.concat(character(hexes, 16), after(hexed)))
            .when(named.isNotNull(), F.concat(named, after(name, 1))).when(loose != "", F.concat(F.try_element_at(lookup({n: html5[n] for n in LOOSE}), loose), after(loose)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    parts = F.split(text, "&")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(read(p))), "")


def stylometry(text: Column) -> dict[str, Column]:
    """Sums of a text from which every measure follows."""
    words = tokens(text)
    return {
        "n_words": F.size(words).cast("long"), "n_sentences": F.size(sentence_lengths(text)).cast("long"),
        "n_adverbs": adverbs(words).cast("long"), "n_quoted": quoted_words(text).cast("long"),
        "n_distinct": F.size(F.array_distinct(F.transform(words, F.lower))).cast("long"),
    }


def share(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale * a / b to six places; 0 of nothing."""
    return F.when(b > 0, F.round(scale * a / b, 6)).otherwise(F.lit(0.0))
