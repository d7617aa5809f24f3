"""Text functions from column to column; all are built-in expressions.

Patterns carry (?d) so that only a line feed ends a line, and \\z for the end of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width letters and digits, and what they become.
FULL_WIDTH = "".join(chr(c) for a, b in ((0xFF21, 26), (0xFF41, 26), (0xFF10, 10)) for c in range(a, a + b))
HALF_WIDTH = "".join(chr(c) for a, b in ((0x41, 26), (0x61, 26), (0x30, 10)) for c in range(a, a + b))
#: Punctuation and particles that a cache key leaves out.
KEY_PUNCTUATION = "，。！？；：\"\"''（）《》【】、—…"
KEY_PARTICLES = "的了吗呢啊吧和与及或在是有被把对从到让给为以也就都而但却所者之仍便则虽即"
#: Markers of a hand-over to another assistant; other text of that form stays.
TRANSFER = ("[TRANSFER:qa]", "[TRANSFER:course_recommend]", "[TRANSFER:customer_service]")
#: White space as Unicode has it: regular expressions' \\s, next line, no-break and ideographic spaces, and all other separators.
SPACE = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def trimmed(x: Column) -> Column:
    """Without white space at both ends (F.trim takes blanks alone)."""
    return F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def collapsed(x: Column) -> Column:
    return trimmed(F.regexp_replace(x, f"[{SPACE}]+", " "))


def half_width(x: Column) -> Column:
    return F.translate(x, FULL_WIDTH, HALF_WIDTH)


def clean_markdown(x: Column) -> Column:
    """Images out, links and emphasis to their text, at most one blank line, half-width letters; headings stay."""
    x = F.regexp_replace(x, "[\\x00\\x0C\\uFFFD]", "")
    for pattern, to in ((r"(?d)!\[.*?\]\(.*?\)", ""), (r"(?d)\[(.+?)\]\(.+?\)", "$1"), (r"(?d)\*\*(.+?)\*\*", "$1"), (r"(?d)~~(.+?)~~", "$1"), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, to)
    return trimmed(half_width(x))


def lines(x: Column) -> Column:
    return F.split(x, "\n")


def without_repeating_lines(x: Column, least: int = 3, shorter: int = 50, blank_too: bool = False) -> Column:
    """Lines go that, trimmed, are shorter than so many characters and occur so often; blank ones only with blank_too."""
    own = F.transform(lines(x), trimmed)
    often = F.filter(F.array_distinct(own), lambda v: (F.length(v) < shorter) & (F.size(F.filter(own, lambda o: o == v)) >= least) & (F.lit(blank_too) | (v != "")))
    return F.array_join(F.filter(lines(x), lambda v: ~F.array_contains(often, trimmed(v))), "\n")


def without_page_numbers(x: Column) -> Column:
    return F.array_join(F.filter(lines(x), lambda v: ~trimmed(v).rlike(r"^[\s\-]*\d{1,5}[\s\-]*\z")), "\n")


def without_contents_lines(x: Column) -> Column:
    return F.array_join(F.filter(lines(x), lambda v: ~(v.contains(".....") | v.contains("……"))), "\n")


def breaks_mid_sentence(x: Column) -> Column:
    return x.rlike(r"[a-z一-鿿]\z")


def merged_lines(x: Column) -> Column:
    """A line that ends mid-sentence takes the next one, if neither is blank."""
    fold = lambda acc, v: F.when((F.size(acc) > 0) & breaks_mid_sentence(trimmed(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")))) & (trimmed(v) != ""), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.get(acc, F.size(acc) - 1), v)))).otherwise(F.concat(acc, F.array(v)))
    return F.array_join(F.aggregate(lines(x), F.array().cast("array<string>"), fold), "\n")


def clean_pdf(x: Column) -> Column:
    return without_contents_lines(merged_lines(without_page_numbers(without_repeating_lines(x))))


def clean_docx(x: Column) -> Column:
    return without_page_numbers(without_repeating_lines(F.regexp_replace(x, "[\\u2500-\\u257F]", "")))


def bigrams(x: Column) -> Column:
    return F.when(F.length(x) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cut(x: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(mark))).otherwise(x)


def cleaned_answer(x: Column, n: int) -> Column:
    """Without transfer markers, white space collapsed, cut."""
    for marker in TRANSFER:
        x = F.replace(x, F.lit(marker), F.lit(""))
    return cut(collapsed(x), n)


def cache_key(x: Column) -> Column:
    return collapsed(F.translate(x, KEY_PUNCTUATION + KEY_PARTICLES, " " * len(KEY_PUNCTUATION + KEY_PARTICLES)))


def text_to_markdown(x: Column) -> Column:
    """Paragraphs at two line feeds, trimmed, empty ones dropped; inner line feeds become hard breaks."""
    parts = F.filter(F.transform(F.split(trimmed(x), r"\n\n"), trimmed), lambda p: p != "")
    return trimmed(F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\n"), F.lit("  \n"))), "\n\n"))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"(?d)^(#{1,6})\s+(.+)\z", 1))


def heading_title(line: Column) -> Column:
    return trimmed(F.regexp_extract(line, r"(?d)^(#{1,6})\s+(.+)\z", 2))


def resolved(href: Column, base: Column) -> Column:
    host = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(base, r"[^/]*\z", "")
    return F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))


def readable(x: Column) -> Column:
    """At least 50 characters, over 70 % of them letters, digits, CJK, blanks or common punctuation, under 10 % odd ones."""
    n = F.length(x)
    normal = F.length(F.regexp_replace(x, "[^a-zA-Z0-9\\u4e00-\\u9fff\\s.,;:!?()，。；：！？（）、-]", ""))
    odd = n - F.length(F.regexp_replace(x, "[\\uFFFD\\x00-\\x08\\x0B\\x0E-\\x1F]", ""))  # the few go, not the many
    return (n >= 50) & (normal / n > 0.7) & (odd / n < 0.1)


def pieces(x: Column, n: int = 3) -> Column:
    """Pieces of n characters, the last one shorter."""
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)), F.lit(n)), lambda i: F.substring(x, i, F.lit(n))))


def without_fence(x: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(x), r"^```(json)?", ""), r"```\z", ""))


def fixed_chunks(x: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of size characters, each overlap into the one before; the last window ends the text."""
    step = size - overlap if size > overlap else size
    n = F.length(x)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step) * step).cast("int")
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.substring(x, i + 1, F.lit(size)))
