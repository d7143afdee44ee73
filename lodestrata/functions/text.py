"""Column functions on text. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that keyword search ignores.
STOPWORDS = ("a", "an", "the", "is", "are", "was", "were", "of", "to", "in", "on", "for", "and", "or")

#: What is masked, by category, in this order, and the text put in its place.
MASKS = (
    ("id_card", r"(?<!\d)\d{17}[\dXx](?!\d)", "〔身份证号〕"),
    ("bank_card", r"(?<!\d)(?:62\d{14,17}|\d{16,19})(?!\d)", "〔银行卡号〕"),
    ("phone", r"(?<!\d)1[3-9]\d{9}(?!\d)", "〔手机号〕"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "〔邮箱〕"),
    ("money", r"(?:[¥￥]\s?\d+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?\s*元)", "〔金额〕"),
)


#: Chinese characters.
HAN = "[\\u4e00-\\u9fff]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def terms(text: Column | str) -> Column:
    """Words for keyword search: lower-cased runs of two or more letters or digits, without stop words, and the pairs of characters of longer Chinese runs, which have no spaces."""
    found = F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1))
    words = F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda w: ~w.isin(*STOPWORDS))
    pairs = F.when(col(text).rlike(HAN), F.regexp_extract_all(col(text), F.lit(rf"(?=({HAN}{{2}}))(?:(?<={HAN})|(?={HAN}{{3}}))"), F.lit(1)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def term_set(text: Column | str) -> Column:
    """Distinct words, or distinct character pairs where there are none."""
    words = F.array_distinct(terms(text))
    packed = F.lower(F.regexp_replace(col(text), r"\s+", ""))
    pairs = F.when(F.length(packed) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(packed) - 1), lambda i: F.substr(packed, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) > 0, words).otherwise(pairs)


def sentences(text: Column | str) -> Column:
    """Sentences with their end marks, trimmed, without empty ones."""
    parts = F.split(col(text), r"(?<=[。！？!?.;；])|\n", -1)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def newlines(text: Column | str) -> Column:
    """Windows and old Mac line ends as newlines."""
    return F.regexp_replace(F.regexp_replace(col(text), "\r\n", "\n"), "\r", "\n")


def compact_blank_lines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "\n{3,}", "\n\n")


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


#: Marks of citation, lines that only say "picture", marks before and around a rewritten question, ends of names of places.
CITATIONS = r"(?U)(?:\s*【(?:第\d+块|\d+)】)+"
PICTURE_LINE = r"(?mdU)^\s*【?图片】?\s*$"
NUMBERING = r"(?U)^\s*(?:\d+[.、)]|[-*•])\s*"
QUOTES = "\"'“”‘’《》 "
PLACE_ENDS = "(?:自治区|自治州|自治县|地区|省|市|县|区|盟|旗)+$"


def clean_answer(text: Column | str) -> Column:
    """Answer text without citation marks and lone picture lines, lines right-trimmed, blank lines compacted."""
    x = F.regexp_replace(F.regexp_replace(col(text), CITATIONS, ""), PICTURE_LINE, "")
    return stripped(compact_blank_lines(F.regexp_replace(x, r"(?mdU)[^\S\n]+$", "")))


def clean_rewrite(text: Column | str, most: int = 100) -> Column:
    """One rewritten question: numbering, bullets and quotes stripped, at most ``most`` characters; empty for null."""
    x = F.regexp_replace(stripped(F.coalesce(col(text), F.lit(""))), NUMBERING, "")
    return F.substring(stripped(F.regexp_replace(x, f"^[{QUOTES}]+|[{QUOTES}]+$", "")), 1, most)


def masked(text: Column | str, words: tuple[str, ...] = ()) -> tuple[Column, dict[str, Column]]:
    """The text with sensitive parts replaced, and the number of hits per category.

    Categories follow one another on the text as masked so far; dictionary
    words come first, the longest first.
    """
    out, hits = col(text), {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        pattern = re.escape(w)
        hits["dict_word"] = hits.get("dict_word", F.lit(0)) + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, "〔敏感词〕")
    for name, pattern, place in MASKS:
        hits[name] = F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, place)
    return out, hits


def masked_rows(rows: DataFrame, column: str, words: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``column`` masked and the number of hits of each category as ``n_<category>``.

    As ``masked``, with a step for each category, so that a text is searched
    and replaced once for each, not anew for all that follow.
    """
    steps = [("dict_word", re.escape(w), "〔敏感词〕") for w in sorted(set(words), key=lambda w: (-len(w), w))] + list(MASKS)
    names = list(dict.fromkeys(name for name, _, _ in steps))
    out = rows.withColumns({f"n_{name}": F.lit(0) for name in names})
    for name, pattern, place in steps:
        own = F.col(f"n_{name}") + F.coalesce(F.regexp_count(column, F.lit(pattern)), F.lit(0))
        out = out.withColumns({column: F.regexp_replace(column, pattern, place), f"n_{name}": own})
    return out


def masked_parts(parts: Column | str, words: tuple[str, ...] = ()) -> Column:
    """The parts ``(type, text)`` of a message with the text ones masked; pictures and others as they are."""
    return F.transform(col(parts), lambda p: F.when((p["type"] == "text") & p["text"].isNotNull(), p.withField("text", masked(p["text"], words)[0])).otherwise(p))


def image_contexts(text: Column | str, around: int = 100) -> Column:
    """Markdown images as ``(target, before, after)``, with up to ``around`` characters on either side."""
    image = r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"
    found = F.regexp_extract_all(col(text), F.lit(rf"(?s)({image})"), F.lit(1))
    pieces = F.split(col(text), image, -1)
    one = lambda m, i: F.struct(F.regexp_extract(m, image, 1).alias("target"), F.right(F.get(pieces, i), F.lit(around)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(around)).alias("after"))
    return F.transform(found, one)


def image_references(text: Column | str) -> Column:
    """Targets of Markdown images, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1)))


def image_urls(text: Column | str) -> Column:
    """Links to picture files, bare or in Markdown, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"(?i)(https?://[^\s()\"'<>]+\.(?:png|jpe?g|gif|webp|bmp|svg))"), F.lit(1)))


def file_kind(path: Column | str) -> Column:
    """Lower-cased extension; empty without one."""
    return F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))


def route(path: Column | str) -> Column:
    """What reads a file: Markdown and PDF by exact case, tables and texts by any, or an error."""
    p, kind = col(path), file_kind(path)
    return F.when(p.endswith(".md"), "markdown").when(p.endswith(".pdf"), "pdf").when(kind.isin("csv", "xlsx", "xls"), "table").when(kind.isin("txt", "json", "html", "htm", "docx"), "text").otherwise("error")


def host(url: Column | str) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("HOST")), F.lit("")))


def host_allowed(name: Column | str, allowed: list[str]) -> Column:
    """Whether a host is on the list; ``*.x`` allows x and everything below it."""
    h, rule = col(name), F.lit(False)
    for a in allowed:
        rule = rule | ((h == a[2:]) | h.endswith(a[1:]) if a.startswith("*.") else h == a)
    return rule


def fingerprint(text: Column | str, whole: int = 262_144, part: int = 131_072) -> Column:
    """First 8 hex digits of SHA-256: of everything up to ``whole`` bytes, else of both ends."""
    b = F.encode(col(text), "utf-8")
    ends = F.concat(F.substring(b, 1, part), F.substring(b, -part, part))
    return F.substring(F.sha2(F.when(F.octet_length(b) <= whole, b).otherwise(ends), 256), 1, 8)


def cache_key(*parts: Column | str) -> Column:
    """MD5 of the parts that are not null, joined by a double pipe."""
    return F.md5(F.concat_ws("||", *(col(p).cast("string") for p in parts)))


def embedding_text(item: Column | str, kind: Column | str, content: Column | str) -> Column:
    """What is embedded for a chunk: its text after the names it has."""
    i, k, c = col(item), col(kind), col(content)
    has = lambda x: x.isNotNull() & (x != "")
    return F.when(has(i) & has(k), F.concat(i, F.lit(" "), k, F.lit("\n"), c)).when(has(i), F.concat(i, F.lit("\n"), c)).otherwise(c)


def json_object(text: Column | str) -> Column:
    """A model's JSON answer: code fences stripped, parsed, null if it does not parse."""
    bare = F.regexp_replace(F.trim(col(text)), r"^```(?:json)?\s*|\s*```$", "")
    return F.try_parse_json(bare)


def place_tokens(*names: Column | str) -> Column:
    """The parts of place names and the parts without their administrative ends, each of two characters or more, distinct, in order."""
    parts = F.flatten(F.array(*(F.split(F.coalesce(col(n), F.lit("")), r"(?U)[\s，,、]+", -1) for n in names)))
    bare = lambda x: F.coalesce(F.nullif(F.regexp_replace(x, PLACE_ENDS, ""), F.lit("")), x)
    long = F.filter(parts, lambda x: F.length(x) >= 2)
    return F.array_distinct(F.filter(F.flatten(F.transform(long, lambda x: F.array(x, bare(x)))), lambda x: F.length(x) >= 2))


def chinese_number(text: Column | str) -> Column:
    """Digits, or Chinese numerals up to 99, as an integer; null otherwise."""
    t = col(text)
    digit = lambda c: F.instr(F.lit("一二三四五六七八九"), c)
    tens = F.when(t.startswith("十"), F.lit(1)).otherwise(digit(F.substring(t, 1, 1)))
    last = F.when(t.endswith("十"), F.lit(0)).otherwise(digit(F.substring(t, -1, 1)))
    value = F.when(t.contains("十"), tens * 10 + last).otherwise(digit(F.translate(t, "两", "二")))
    return F.when(t.rlike(r"^\d+$"), t.cast("int")).when(t.rlike("^(?:[一二三四五六七八九两]|[一二三四五六七八九]?十[一二三四五六七八九]?)$"), value)


def replaced_images(text: Column | str, links: Column | str) -> Column:
    """Markdown images with their targets and captions replaced: ``links`` is ``map<target, struct<url, summary>>``; others stay."""
    return F.aggregate(
        F.map_entries(col(links)), col(text),
        lambda t, e: F.regexp_replace(t, F.concat(F.lit(r"!\[[^\]]*\]\(\Q"), e["key"], F.lit(r"\E[^)]*\)")), F.concat(F.lit("!["), e["value"]["summary"], F.lit("]("), e["value"]["url"], F.lit(")"))),
    )


def has_material(title: Column | str, text: Column | str, tokens: Column | str, least: int = 2) -> Column:
    """Whether a chunk is about a place: a token in its title, or ``least`` times in its text."""
    return F.exists(col(tokens), lambda k: F.coalesce(col(title), F.lit("")).contains(k) | (F.size(F.split(F.coalesce(col(text), F.lit("")), F.concat(F.lit(r"\Q"), k, F.lit(r"\E")), -1)) > least))


def preference(question: Column | str, ways: dict[str, str], hints: str, near: int = 12) -> Column:
    """The way that a question asks for: the first of ``ways`` (name to pattern) within ``near`` characters from a hint, else null."""
    q = F.coalesce(col(question), F.lit(""))
    after = F.substring(F.regexp_extract(q, f"((?:{hints}).*)", 1), 1, near)
    rule = F.lit(None).cast("string")
    for name, pattern in reversed(ways.items()):
        rule = F.when(after.rlike(pattern), name).otherwise(rule)
    return rule


def repeated(terms: Column, text: Column | str, least: int = 2) -> Column:
    """The terms that occur ``least`` times or more in a text, in their order; empty ones go."""
    t = col(text)
    times = lambda w: (F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)
    return F.filter(terms, lambda w: (w != "") & (times(w) >= least))


def again(text: Column | str, run: str) -> Column:
    """The greatest runs of a kind of character that a text has twice or more, be it within other runs, sorted and distinct.

    ``run`` matches greatest runs, so whatever equals one lies within one: a run
    comes again if it is there twice, or is part of a longer one. Only those
    there once are looked for, and only among the distinct runs.
    """
    runs = F.array_sort(F.regexp_extract_all(col(text), F.lit(f"({run})"), F.lit(1)))
    return _let(runs, lambda r: _let(F.array_join(F.array_distinct(r), " "), lambda every: F.array_distinct(F.filter(r, lambda w, i: (F.get(r, i + 1) == w) | (F.get(r, i - 1) == w) | (F.length(every) - F.length(F.replace(every, w, F.lit(""))) >= 2 * F.length(w))))))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)
