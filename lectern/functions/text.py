"""Scalar text functions: Column in, Column out.

Lengths and offsets count code points. White space is the Unicode class of SPACE, which neither
``\\s`` nor trim() covers by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes as regular-expression text.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
DIGITS = r"[0-9\x{FF10}-\x{FF19}\x{2460}-\x{249B}\x{24EA}\x{24F5}-\x{24FE}\x{3280}-\x{3289}]"
LATIN = r"[A-Za-z\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]"
WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
HALF, FULL = ",;:!?()", "，；：！？（）"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"))
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
HAN_DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "百": 100, "千": 1000}


@dataclass(frozen=True)
class Normalization:
    """What normalize() removes besides surrounding white space."""

    whitespace: bool = True
    punctuation: bool = False
    digits: bool = False
    latin: bool = False
    footnotes: bool = False


#: Citations are compared without digits, Latin letters and note marks; punctuation stays.
CITATION = Normalization(digits=True, latin=True, footnotes=True)


def replaced(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def trimmed(text: Column) -> Column:
    return replaced(text, rf"^{SPACE}+|{SPACE}+$")


def line_endings(text: Column) -> Column:
    return replaced(text, r"\r\n?", "\n")


def normalize(text: Column, options: Normalization = Normalization()) -> Column:
    text = trimmed(text)
    if options.footnotes:
        text = replaced(replaced(text, r"\[\^[^\]]*\]"), r"\^[^^]+\^")
    for wanted, pattern in ((options.whitespace, SPACE), (options.punctuation, r"\p{P}"), (options.digits, DIGITS), (options.latin, LATIN)):
        if wanted:
            text = replaced(text, pattern)
    return text


def without_ellipsis(text: Column) -> Column:
    return replaced(text, r"…+|\.{2,}")


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body or its lambdas name it."""
    return F.transform(F.array(value), body)[0]


def substrings(text: Column, n: int) -> Column:
    """Every run of n characters, in order; none for a shorter text."""
    # Characters are cut once and indexed: substring() would walk the text from its start each time.
    each = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*(c[i + k] for k in range(n))))
    return bound(F.split(text, ""), lambda c: F.when((F.size(c) >= n) & (c[0] != ""), each(c)).otherwise(F.array().cast("array<string>")))


def ngrams(text: Column, n: int) -> Column:
    """The distinct character n-grams; a shorter text is its own and only gram."""
    return bound(text, lambda t: F.when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(substrings(t, n))))


def word_ngrams(tokens: Column, n: int) -> Column:
    few = lambda w: F.when(F.size(w) == 0, F.array(F.lit(""))).otherwise(F.array(F.array_join(w, "|")))
    each = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), "|")))
    return bound(tokens, lambda w: F.when(F.size(w) < n, few(w)).otherwise(each(w)))


def jaccard_of(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def jaccard(a: Column, b: Column, n: int) -> Column:
    """0 if either text is empty, 1 if they are equal, else shared over all n-grams."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(jaccard_of(ngrams(a, n), ngrams(b, n)))


def removed_length(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(replaced(text, pattern))


def token_estimate(text: Column) -> Column:
    """1.5 for a wide character, 0.15 for white space, 0.25 for any other, rounded up after rounding to 6 places."""
    wide = removed_length(text, WIDE)
    space = removed_length(replaced(text, WIDE), SPACE)
    rest = F.length(text) - wide - space
    return F.ceil(F.round(wide * 1.5 + space * 0.15 + rest * 0.25, 6))


def to_full_width(text: Column) -> Column:
    return F.translate(text, HALF, FULL)


def to_half_width(text: Column) -> Column:
    return F.translate(text, FULL, HALF)


def squeeze_han_spaces(text: Column, most: int = 1) -> Column:
    """Drop runs of at most ``most`` spaces that touch a Han character and stand inside a line."""
    return replaced(text, rf"(?<=\p{{IsHan}}) {{1,{most}}}(?=[^ \n])|(?<=[^ \n]) {{1,{most}}}(?=\p{{IsHan}})")


def strip_heading(line: Column) -> Column:
    return F.trim(replaced(line, r"^#{1,6}\s+"))


def control_free(text: Column) -> Column:
    return replaced(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def html_to_text(html: Column) -> Column:
    out = replaced(html, r"(?i)<\s*script[^>]*>[\s\S]*?<\s*/\s*script\s*>|<\s*style[^>]*>[\s\S]*?<\s*/\s*style\s*>")
    out = replaced(out, r"(?i)<\s*br\s*/?\s*>|<\s*/\s*p\s*>|<\s*/\s*div\s*>", "\n")
    out = replaced(out, r"<[^>]+>", " ")
    for name, char in ENTITIES:
        out = replaced(out, f"(?i){name}", char)
    out = replaced(line_endings(out), r"[ \t\f\x0B]+", " ")
    out = replaced(replaced(out, r"(?m)^[ ]+|[ ]+$"), r"\n{3,}", "\n\n")
    return trimmed(control_free(out))


def digest(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)


def clipped(text: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def unquoted(text: Column) -> Column:
    """Blockquote marks at the line starts removed; line breaks stay."""
    return replaced(text, r"(?m)^[ \t>]+")


def search_token(token: Column) -> Column:
    """Lower case; null for blanks, pure punctuation and single characters other than letters and digits."""
    t = F.lower(trimmed(token))
    drop = (t == "") | t.rlike(r"^[\s\p{P}\p{S}]+$") | ((F.length(t) == 1) & ~t.rlike("[a-z0-9]"))
    return F.when(~drop, t)


def strip_fence(text: Column) -> Column:
    return F.trim(replaced(replaced(F.trim(text), r"(?i)^```(?:json)?\s*"), r"\s*```$"))


def confidence(text: Column) -> Column:
    """0 to 1 from a fraction, a number up to 100 or a percentage."""
    n = F.expr("1") * replaced(F.trim(text.cast("string")), r"%$").try_cast("double")
    out = F.when(text.cast("string").rlike(r"%\s*$") | (n > 1), n / 100).otherwise(n)
    return F.when((out >= 0) & (out <= 1), out)


def multi_line_as_spaces(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(parts, "  ")


def multi_level(number: Column) -> Column:
    """1.2.3 as one comparable number in base 10,000."""
    return F.aggregate(F.split(number, r"\."), F.lit(0).cast("long"), lambda a, x: a * 10000 + x.cast("long"))


def _digits(text: Column, values: dict[str, int]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.filter(F.transform(F.split(text, ""), lambda c: F.try_element_at(table, c)), lambda v: v.isNotNull())


def roman_number(text: Column) -> Column:
    """A smaller digit before a larger one is subtracted."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("last"))
    step = lambda a, v: F.struct((a.n + F.when(v < a["last"], -v).otherwise(v)).alias("n"), v.alias("last"))
    return F.aggregate(F.reverse(_digits(F.upper(text), ROMAN)), state, step, lambda a: a.n)


def han_number(text: Column) -> Column:
    """Digits and the units ten, hundred and thousand; a bare unit counts as one of it."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("held"))
    step = lambda a, v: F.when(
        v >= 10, F.struct((a.n + F.when(a.held == 0, 1).otherwise(a.held) * v).alias("n"), F.lit(0).alias("held"))
    ).otherwise(F.struct(a.n.alias("n"), (a.held * 10 + v).alias("held")))
    return F.aggregate(_digits(text, HAN_DIGITS), state, step, lambda a: a.n + a.held)


def letter_number(text: Column) -> Column:
    """A is 1, Z is 26, AA is 27."""
    return F.aggregate(F.split(F.upper(text), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))


def circled_number(text: Column) -> Column:
    code = F.expr("0") + F.ascii(text)
    ranges = ((0x2460, 0x2473, 1), (0x3251, 0x325F, 21), (0x32B1, 0x32BF, 36), (0x2474, 0x2487, 1), (0x2488, 0x249B, 1), (0x3220, 0x3229, 1))
    out = F.lit(0)
    for low, high, first in ranges:
        out = F.when((code >= low) & (code <= high), code - low + first).otherwise(out)
    return out


def raw_index(raw: Column, at: Column) -> Column:
    """The offset in a text with CRLF line ends of an offset in the same text with LF ones."""
    marked = replaced(raw, r"\r\n", "\u0001")
    before = F.substring(marked, F.lit(1), at)
    return at + F.length(before) - F.length(F.replace(before, F.lit("\u0001"), F.lit("")))


def tooltip(html: Column, most: int = 200) -> Column:
    """Notes without tags, cut at ``most`` characters."""
    plain = F.trim(replaced(html, r"<[^>]+>"))
    return F.when(F.length(plain) > most, F.concat(F.left(plain, F.lit(most)), F.lit("… 详见说明"))).otherwise(plain)


def expanded_classes(pattern: str) -> str:
    """A rule's pattern with \\c written out as the class of Han characters."""
    return pattern.replace(r"\c", "[一-鿿]")


def same_target(stored: Column, current: Column) -> Column:
    """Whether two targets agree but for white space; one that is not stored agrees with any."""
    squeezed = lambda t: F.trim(replaced(t, r"\s+", " "))
    return stored.isNull() | (F.trim(stored) == "") | (squeezed(stored) == squeezed(current))


def reference_block(kind: str, title: Column, body: Column, digest_of: Column, mark: str) -> Column:
    """A block of evidence between machine comments, under a header; kind is dict or grep."""
    # The words of header and comments.
    header, tag = {"dict": ("【本地词典】", "localDictEntry"), "grep": ("【文献摘录】", "grepHit")}[kind]
    begin = F.concat(F.lit(f"<!-- {mark}:{tag} begin sha1="), digest_of, F.lit(" -->"))
    return F.concat_ws("\n", begin, F.concat(F.lit(header), title), F.lit(""), body, F.lit(f"<!-- {mark}:{tag} end -->"))


def literature_text(block: Column, snippet: Column) -> Column:
    """What a block says below its source headers, or else its snippet."""
    # How header lines begin.
    lines = F.split(F.coalesce(block, F.lit("")), "\n")
    header = lambda x: (F.trim(x) == "") | F.trim(x).rlike("^【(?:文献摘录|本地词典|维基百科)") | F.trim(x).rlike("(?i)^(?:URL|Wikidata):")
    first = lambda xs: F.array_position(F.transform(xs, lambda x: ~header(x)), F.lit(True)).cast("int")
    rest = bound(lines, lambda xs: F.when(first(xs) > 0, F.trim(F.array_join(F.slice(xs, first(xs), F.size(xs)), "\n"))).otherwise(F.lit("")))
    body = F.trim(replaced(rest, "^摘录："))
    return F.when(body != "", body).otherwise(F.trim(F.coalesce(snippet, F.lit(""))))


# Lines of dictionary pages that say nothing.
_NOISE = (r"(?i)^(?:版权所有|Copyright|All rights reserved)", r"(?i)^(?:返回目录|目录|首页|上一页|下一页)$")
_LINK = r"(?i)^https?://\S+$"
#: Dictionaries, and tags of dictionaries, whose pages also hold remains of audio players and of navigation.
STYLED_IDS, STYLED_TAGS = ("cihai", "cihai-7", "cihai7", "ci_hai"), ("辞海", "cihai")


def plain_entry(text: Column) -> Column:
    """A dictionary entry without page headers, footers and bare links; blank lines squeezed."""
    noise = lambda x: F.trim(x).rlike(_NOISE[0]) | F.trim(x).rlike(_NOISE[1]) | (F.trim(x).rlike(_LINK) & (F.length(F.trim(x)) < 80))
    return F.trim(replaced(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~noise(x)), "\n"), r"\n{3,}", "\n\n"))


def styled_entry(text: Column) -> Column:
    out = plain_entry(text)
    for pattern, by in (
        (r"(?i)您的浏览器不支持\s*audio\s*标签", ""), (r"(?i)</?audio\b[^>]*>", ""), (r"(?i)\baudio\s*标签", ""), (r"(?m)^(李\s*白[^\n]*)\n\1\n", "$1\n"), (r"(?m)^[【\[]参见[】\]][^\n]*\n+", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
    ):
        out = replaced(out, pattern, by)
    return F.trim(out)


def cleaned_entry(text: Column, dict_id: Column, tags: Column) -> Column:
    """An entry cleaned as its dictionary's id, else its tags, ask for."""
    tagged = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t).contains(STYLED_TAGS[0]) | F.lower(t).contains(STYLED_TAGS[1]))
    return F.when(F.lower(F.coalesce(dict_id, F.lit(""))).isin(*STYLED_IDS) | tagged, styled_entry(text)).otherwise(plain_entry(text))
