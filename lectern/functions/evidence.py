"""Scalar functions that judge retrieved snippets, terms, years and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HAN_DIGITS, SPACE, bound, replaced, trimmed

# Lines of a snippet that are no text, and keywords of two readings of a name.
TIME_CODE = r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"
CONTENTS_LINE = r"^(#{1,6}\s*)?[0-9]*\s*(目录|作品原文|词句注释|白话译文|创作背景|作品鉴赏|作者简介|后世影响|作品影响|历代评价)[:：]?$"
CARD_LINE = r"^(作品名称|出\s*处|作\s*者|创作年代|创作时间|作品体裁)\s*\S"
SHORT_HEADING = r"^#{1,6}\s+\S{1,24}$"
#: What a time code, contents line, card line or short heading can begin with.
NOISE_STARTS = r"[#0-9\s目作词白创后历出]"
#: No test asks whether more characters than these are left.
MOST_BARE = 160
MEDIA_WORDS = "朗诵|配乐|音频|视频"
FULL_STOPS = "[。！？；]"
MODERN = "情报 特工 烈士 电台 电波 地下党 共产党 国民党 红军 延安 牺牲 刑讯 裘慧英 永不消逝 密战 毛人凤 潘汉年".split()
CLASSICAL = "唐诗 诗人 太白 青莲 蜀道 盛唐 乐府 诗仙 杜甫 天宝 开元 长安 词句注释 作品原文 创作背景".split()
BRACKETED = (r"（[^）]*）", r"\([^)]*\)", r"\[[^\]]*\]", r"【[^】]*】")
YEARS = r"\b(1[5-9][0-9]{2}|20[0-9]{2})\b"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _bare_length(text: Column) -> Column:
    return F.length(replaced(text, SPACE))


def _edge_trimmed(text: Column) -> Column:
    """trimmed(), whose pattern walks the whole text, only where an end is white space."""
    return bound(text, lambda t: F.when(F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(SPACE), trimmed(t)).otherwise(t))


def _size(text: Column) -> Column:
    """The characters besides white space, exact up to MOST_BARE; more count as MOST_BARE."""
    count = lambda x: F.least(_bare_length(x), F.lit(MOST_BARE))
    start = lambda t: count(F.left(t, F.lit(2 * MOST_BARE)))
    return bound(text, lambda t: bound(start(t), lambda n: F.when((n == MOST_BARE) | (F.length(t) <= 2 * MOST_BARE), n).otherwise(count(t))))


def _is_noise(l: Column) -> Column:
    """is_noise_line for a trimmed line; where its first character begins no noise line and it is too long for media words, no pattern is tried."""
    stops = lambda: l.rlike(FULL_STOPS)
    media = (F.length(l) <= 40) & l.rlike(MEDIA_WORDS) & ~stops()
    heading = l.rlike(SHORT_HEADING) & ~stops() & (F.length(replaced(l, r"^#+\s*")) <= 20)
    led = F.left(l, F.lit(1)).rlike(NOISE_STARTS) & (l.rlike(TIME_CODE) | l.rlike(CONTENTS_LINE) | l.rlike(CARD_LINE) | heading)
    return (l == "") | led | media


def is_noise_line(line: Column) -> Column:
    return bound(_edge_trimmed(line), _is_noise)


def _judged(snippet: Column) -> Column:
    """Struct (raw, n, noise, coded, kept): the trimmed snippet, its lines that are not empty, the noise among them,
    whether one is a time code, and what is left without noise. Every line is judged once."""
    line = lambda x: bound(_edge_trimmed(x), lambda l: F.struct(x.alias("line"), (l == "").alias("empty"), _is_noise(l).alias("noise"), ((F.length(l) <= 9) & l.rlike(TIME_CODE)).alias("coded")))

    def summed(raw: Column, lines: Column) -> Column:
        count = lambda test: F.size(F.filter(lines, test))
        kept = F.transform(F.filter(lines, lambda x: ~x.noise), lambda x: x.line)
        return F.struct(
            raw.alias("raw"),
            count(lambda x: ~x.empty).alias("n"),
            count(lambda x: x.noise & ~x.empty).alias("noise"),
            F.exists(lines, lambda x: x.coded).alias("coded"),
            _edge_trimmed(F.array_join(kept, "\n")).alias("kept"),
        )

    return bound(_edge_trimmed(F.coalesce(snippet, F.lit(""))), lambda raw: bound(F.transform(F.split(raw, "\n"), line), lambda lines: summed(raw, lines)))


def _is_heading(s: Column) -> Column:
    return s.startswith("#") & s.rlike(SHORT_HEADING) & ~s.rlike(FULL_STOPS)


def _noisy(j: Column, all_of: Column, left: Column, heading_path: Column | None) -> Column:
    n, noise = j["n"], j["noise"]
    out = (all_of < 12) | ((n <= 4) & (noise == n)) | ((j["coded"] | (noise >= 2)) & (left < 48)) | ((n >= 2) & (noise * 2 >= n) & (all_of < 160)) | (left < 12)
    if heading_path is not None:
        out = out | (F.coalesce(heading_path, F.lit("")).contains("目录") & (left < 40))
    return out | _is_heading(j["raw"])


def without_noise(snippet: Column) -> Column:
    """The snippet without time codes, contents lines and empty lines; years of birth and death stay."""
    return _judged(snippet)["kept"]


def is_noisy(snippet: Column, heading_path: Column | None = None) -> Column:
    """Whether too little text is left besides the noise: under 12 characters, under 48 beside a time code or two
    noise lines, or under 160 where half the lines are noise."""
    return bound(_judged(snippet), lambda j: bound(_size(j["raw"]), lambda a: bound(_size(j["kept"]), lambda left: _noisy(j, a, left, heading_path))))


def clean_snippet(snippet: Column, heading_path: Column | None = None) -> Column:
    """The snippet without noise lines, or empty where too little would be left.

    What is left holds no noise line, so is_noisy() of it comes down to its size, the heading path and its being a heading.
    """

    def cleaned(j: Column, all_of: Column, left: Column) -> Column:
        drop = (left < 12) | ((left < 48) & (j["coded"] | _noisy(j, all_of, left, heading_path))) | _is_heading(j["kept"])
        if heading_path is not None:
            drop = drop | (F.coalesce(heading_path, F.lit("")).contains("目录") & (left < 40))
        return F.when(drop, "").otherwise(j["kept"])

    return bound(_judged(snippet), lambda j: bound(_size(j["raw"]), lambda a: bound(_size(j["kept"]), lambda left: cleaned(j, a, left))))


def sense_signals(text: Column) -> Column:
    """Struct of years, modern and classical: the years named and how many keywords of each list occur."""
    t = F.coalesce(text, F.lit(""))
    count = lambda words: sum((t.contains(w).cast("int") for w in words), F.lit(0))
    return F.struct(F.transform(_matches(t, YEARS, 1), lambda y: y.cast("int")).alias("years"), count(MODERN).alias("modern"), count(CLASSICAL).alias("classical"))


def sense_fit(target: Column, hit: Column) -> Column:
    """0 to 1: whether a hit speaks of the same sense as the target; 0.55 where the target gives no sign.

    Years named before 1500 give no signal, so an early year neither helps nor harms.
    """
    a, b = sense_signals(target), sense_signals(hit)
    late = lambda x: F.exists(x["years"], lambda y: y >= 1900)
    modern_target = (a["modern"] > a["classical"]) | late(a)
    modern = F.when(late(b) | (b["modern"] > 0), 0.35).otherwise(0.0) - F.when((b["classical"] > b["modern"]) & (b["modern"] == 0), 0.25).otherwise(0.0)
    classical = F.when(b["classical"] > 0, 0.35).otherwise(0.0) - F.when(late(b) & (b["classical"] == 0), 0.45).otherwise(0.0) - F.when((b["modern"] > b["classical"]) & (b["classical"] == 0), 0.25).otherwise(0.0)
    shared = (F.least(a["modern"], b["modern"]) + F.least(a["classical"], b["classical"])) * 0.05
    score = F.lit(0.5) + F.when(modern_target, modern).when(a["classical"] > a["modern"], classical).otherwise(0.0) + F.least(F.lit(0.15), shared)
    unclear = (a["modern"] == 0) & (a["classical"] == 0) & (F.size(a["years"]) == 0)
    return F.when(unclear, 0.55).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def bare_term(term: Column) -> Column:
    """The term without bracketed notes."""
    for pattern in BRACKETED:
        term = replaced(term, pattern)
    return trimmed(term)


def lookup_term(term: Column) -> Column:
    """Trimmed, without white space next to a Han character."""
    return replaced(replaced(trimmed(term), rf"(\p{{IsHan}}){SPACE}+", "$1"), rf"{SPACE}+(\p{{IsHan}})", "$1")


def dictionary_candidate(term: Column) -> Column:
    return lookup_term(bare_term(lookup_term(term)))


def lookup_key(term: Column) -> Column:
    """The lookup term without zero-width characters, for equality of headwords; compatibility forms are not folded."""
    return replaced(lookup_term(term), r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]")


def anchor_terms(terms: Column) -> Column:
    """Whole terms of 2 to 12 characters and their parts of 2 to 8, each once."""
    bare = F.transform(terms, bare_term)
    parts = F.flatten(F.transform(bare, lambda t: F.filter(F.split(t, r"[\s　/|、，,]+"), lambda p: F.length(p).between(2, 8))))
    return F.array_distinct(F.concat(F.filter(bare, lambda t: F.length(t).between(2, 12)), parts))


def query_signature(intent: Column, **terms: Column) -> Column:
    """The intent and the sorted trimmed terms of each source as one string."""
    parts = (F.when(F.size(t) > 0, F.concat(F.lit(name + ":"), F.array_join(F.array_sort(F.transform(t, trimmed)), "|"))) for name, t in terms.items())
    return F.concat_ws(";;", intent, *parts)


def quoted_patterns(target: Column, most: int = 4) -> Column:
    """Quoted phrases, then book titles, of 2 to 40 characters, each once."""
    quotes = F.transform(_matches(target, r"[「『][^」』]{2,40}[」』]|[“‘][^\"']{2,40}[”’]"), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    books = _matches(target, r"《([^》]{2,30})》", 1)
    return F.slice(F.array_distinct(F.filter(F.transform(F.concat(quotes, books), trimmed), lambda x: F.length(x).between(2, 40))), 1, most)


def match_tokens(text: Column) -> Column:
    t = F.lower(text)
    return F.array_distinct(F.concat(_matches(t, r"[\x{4e00}-\x{9fff}]{2,}"), _matches(t, "[a-z]{3,}")))


def contained_share(tokens: Column, hay: Column) -> Column:
    """The share of tokens that the text holds; 0 without tokens."""
    found = F.size(F.filter(tokens, lambda t: F.lower(hay).contains(t)))
    return F.when(F.size(tokens) > 0, found / F.size(tokens)).otherwise(0.0)


def relevance(target: Column, headword: Column, body: Column, candidates: Column) -> Column:
    """Share of candidate and target tokens in an entry, and 0.25 more where headword and a candidate contain each other."""
    t = F.lower(target)
    tokens = F.array_distinct(F.concat(
        F.filter(F.transform(candidates, lambda c: F.lower(trimmed(c))), lambda c: c != ""),
        F.slice(_matches(t, r"[\x{4e00}-\x{9fff}]{2,}"), 1, 12), F.slice(_matches(t, "[a-z]{3,}"), 1, 8)))
    bonus = F.when(F.exists(candidates, lambda c: headword.contains(c) | c.contains(headword)), 0.25).otherwise(0.0)
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.least(F.lit(1.0), contained_share(tokens, F.concat_ws("\n", headword, F.left(body, F.lit(800)))) + bonus))


def year(token: Column) -> Column:
    """A year as a number, negative after 前; null for unknown or doubtful ones."""
    t = trimmed(token)
    return F.when(t.rlike("^前?[0-9]+$"), F.when(t.startswith("前"), -1).otherwise(1) * replaced(t, "^前").try_cast("int"))


def span(raw: Column) -> Column:
    """Struct of start and end; a single year is both."""
    parts = F.split(trimmed(raw), "—")
    return F.struct(year(parts[0]).alias("start"), year(F.when(F.size(parts) > 1, F.get(parts, 1)).otherwise(parts[0])).alias("end"))


def in_span(at: Column, raw: Column) -> Column:
    """Whether a year lies in a span whose open ends hold every year."""
    s = span(raw)
    low, high = F.least(s["start"], s["end"]), F.greatest(s["start"], s["end"])
    both = s["start"].isNotNull() & s["end"].isNotNull()
    return F.when(both, at.between(low, high)).when(s["start"].isNotNull(), at >= s["start"]).when(s["end"].isNotNull(), at <= s["end"]).otherwise(True)


def era_year(text: Column) -> Column:
    """元 is 1; Han numbers up to 99; null for anything else."""
    t = trimmed(text)
    table = F.create_map(*(F.lit(x) for k, v in HAN_DIGITS.items() if v < 10 for x in (k, v)))
    tens = F.when(t.startswith("十"), 1).otherwise(F.try_element_at(table, F.left(t, F.lit(1))))
    ones = F.when(t.endswith("十"), 0).otherwise(F.try_element_at(table, F.right(t, F.lit(1))))
    return F.when(t == "元", 1).when(t.rlike("^[一二三四五六七八九]$"), F.try_element_at(table, t)).when(t.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$"), tens * 10 + ones)


def fingerprint(**parts: Column) -> Column:
    """24 hex digits of SHA-1 over the parts as JSON with sorted names; the order of arrays' values must not matter to
    the caller's key, so arrays are to be passed sorted."""
    return F.left(F.sha1(F.to_json(F.struct(*(parts[name].alias(name) for name in sorted(parts))))), F.lit(24))
