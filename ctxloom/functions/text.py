"""Column functions on text: cleaning, masking, detection, counting.  All stay in the JVM but nfc(), unescape(), redact()
and repetition(), which send only the texts that they may concern to Python."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are removed on normalising; CJK ranges that count as wide.
INVISIBLE = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}\x{200B}-\x{200F}\x{2028}\x{2029}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{FFF9}-\x{FFFB}]"
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"

# Injection patterns by level.
INJECTION = {
    "basic": [
        ("override", r"(?i)\b(?:ignore|disregard|forget|override)\s+(?:previous|above|all|any|the|your)\s+(?:instructions?|rules?|prompts?|commands?|directives?)"),
        ("role", r"(?i)\b(?:you are)\s+(?:now\s+)?(?:a|an)?\s*(?:different|new|evil|malicious|unrestricted|unfiltered)\s+(?:assistant|ai|model|system)"),
        ("leak", r"(?i)\b(?:show|print|output|reveal|display|tell me)\s+(?:your|the)?\s*(?:system|initial|original|full)?\s*(?:prompt|instructions?|rules?|configuration)"),
        ("jailbreak", r"(?i)\b(?:jailbreak|dan mode|developer mode|god mode|unrestricted mode)\b"),
    ],
    "standard": [
        ("zero_width", r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]"),
        ("delimiter", r"(?i)(?:---|===|\*\*\*|###)\s*(?:system|user|assistant|instruction|new prompt)"),
        ("meta", r"(?i)\b(?:start|begin|initiate)\s+(?:new|different|alternative)\s+(?:session|conversation|context|mode)"),
        ("priority", r"(?i)\b(?:highest|maximum|top|critical)\s+priority\b"),
    ],
    "strict": [
        ("repeat", r"(?i)(.{10,}?)\1{3,}"),
        ("encoded", r"(?U)\b[A-Za-z0-9+/]{20,}={0,2}\b"),
        ("special", r"(?U)[^\p{L}\p{N}_\s\x{4E00}-\x{9FFF}]{10,}"),
    ],
}
LEVELS = {"basic": ["basic"], "standard": ["basic", "standard"], "strict": ["basic", "standard", "strict"]}

# Patterns of masked data.
PHONE = r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)"
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
ID_CARD = r"(?<!\d)([1-9]\d{5})(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(\d{3}[\dXx])(?!\d)"
BANK_CARD = r"(?<!\d)\d{13,19}(?!\d)"
IPV4 = r"\b(\d{1,3})(?:\.\d{1,3}){3}\b"
URL = r"\bhttps?://(?:[a-zA-Z0-9-]+\.)*[a-zA-Z0-9-]+(?:\.[a-zA-Z]{2,})?(?::\d+)?(?:/[^\s]*)?\b"
MASKED = {"phone": PHONE, "email": EMAIL, "id_card": ID_CARD, "bank_card": BANK_CARD, "ip": IPV4, "url": URL}


def token_count(text: Column, chars_per_token: float | None = None) -> Column:
    """Estimated tokens: one per 4 characters, down to 1.5 as the share of CJK characters grows; empty is 0."""
    size = F.length(text)
    ratio = F.lit(chars_per_token) if chars_per_token else F.lit(4.0) - F.regexp_count(text, F.lit(CJK)) / size * 2.5
    return F.when(F.coalesce(size, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / ratio))).cast("int")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def is_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)^\s*$"), F.lit(True))


def nfc(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form.  It runs in Python, for texts with a character that the form may change: no form changes
    ASCII, and NFC none before the first combining mark, U+0300."""
    may = r"[\x{300}-\x{10FFFF}]" if form == "NFC" else r"[^\x{0}-\x{7F}]"

    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    return F.coalesce(normal(F.when(text.rlike(may), text)), text)


def normalise_unicode(text: Column, form: str = "NFC", control: bool = True, zero_width: bool = True) -> Column:
    out = nfc(text, form)
    out = F.regexp_replace(out, r"[\p{Cc}&&[^\n\r\t]]", "") if control else out
    return F.regexp_replace(out, r"[\x{200B}-\x{200D}\x{FEFF}]", "") if zero_width else out


def unescape(text: Column) -> Column:
    """HTML's entities, in Python, for texts with an ampersand."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return F.coalesce(plain(F.when(text.contains("&"), text)), text)


def indented(value: Column) -> Column:
    """JSON, laid out with two spaces a level."""

    @F.pandas_udf("string")
    def laid_out(values: pd.Series) -> pd.Series:
        return values.map(lambda v: json.dumps(json.loads(v), ensure_ascii=False, indent=2), na_action="ignore")

    return laid_out(value)


def strip_html(text: Column, spaced: bool = True, entities: dict[str, str] | None = None) -> Column:
    """Script and style blocks, comments and tags go, entities are read, white space collapses.  With `entities` given
    only those are read, in the JVM; else all, in Python."""
    # What is taken out, in this order.
    out = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"<[^>]+>", " " if spaced else "")
    out = F.when(text.contains("<"), out).otherwise(text)
    if entities is None:
        out = unescape(out)
    else:
        for name, value in sorted(entities.items(), key=lambda kv: kv[0] == "&amp;"):
            out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def escape_html(text: Column) -> Column:
    out = text
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def strip_markdown(text: Column, keep_code: bool = True) -> Column:
    """Marks go in a fixed order; links come before images, so an image leaves its exclamation mark."""
    # The marks and their order.
    steps = [
        (r"(?s)```[^\n]*\n(.*?)```", "$1" if keep_code else ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
        (r"(?m)^#+\s*", ""), (r"(\*\*|__)(.*?)\1|\*|_", "$2"), (r"`([^`]+)`", "$1"), (r"(?m)^>\s*", ""),
        (r"(?m)^\s*[-*+]\s+|^\s*\d+\.\s+", ""), (r"(?m)^(-{3,}|\*{3,}|_{3,})$", ""), (r"\n{3,}", "\n\n"), (r" {2,}", " "),
    ]
    out = text
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def mask_phone(text: Column, mark: str = "*") -> Column:
    return F.regexp_replace(text, PHONE, f"$1{mark * 4}$2")


def mask_id_card(text: Column, mark: str = "*") -> Column:
    return F.regexp_replace(text, ID_CARD, f"$1{mark * 8}$2")


def mask_bank_card(text: Column, mark: str = "*") -> Column:
    """First six and last four digits stay; one pass per length."""
    out = text
    for n in range(13, 20):
        out = F.regexp_replace(out, rf"(?<!\d)(\d{{6}})\d{{{n - 10}}}(\d{{4}})(?!\d)", f"$1{mark * (n - 10)}$2")
    return out


def mask_ip(text: Column) -> Column:
    return F.regexp_replace(text, IPV4, "$1.*.*.*")


def mask_url(text: Column) -> Column:
    return F.regexp_replace(text, URL, "[REDACTED_URL]")


def mask_emails(text: Column, mark: str = "*") -> Column:
    """The local part keeps its first and last character; of two or fewer none."""
    found = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    rest = F.split(text, EMAIL, -1)

    def masked(mail: Column) -> Column:
        local, domain = F.substring_index(mail, "@", 1), F.substring_index(mail, "@", -1)
        n = F.length(local)
        stars = F.when(n <= 2, F.repeat(F.lit(mark), n)).otherwise(F.concat(F.substring(local, 1, 1), F.repeat(F.lit(mark), n - 2), F.right(local, F.lit(1))))
        return F.concat(stars, F.lit("@"), domain)

    out = F.array_join(F.flatten(F.zip_with(rest, F.transform(found, masked), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(text.contains("@"), out).otherwise(text)


def masked_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(p)) for k, p in MASKED.items()}


def _mask_of(kind: str, found: str, mark: str) -> str:
    n = len(found)
    if kind == "phone":
        return found[:3] + mark * 4 + found[-4:]
    if kind in ("id_card", "bank_card"):
        return found[:6] + mark * (n - 10) + found[-4:]
    if kind == "ip":
        return ".".join([found.split(".")[0], *[mark] * 3])
    if kind == "url":
        return "[REDACTED_URL]"
    local, _, domain = found.partition("@")
    return (mark * len(local) if len(local) < 3 else local[0] + mark * (len(local) - 2) + local[-1]) + "@" + domain


def redact(text: Column, kinds: tuple[str, ...] = tuple(MASKED), mark: str = "*") -> Column:
    """struct(content, counts): all matches of all kinds masked from the last to the first by where they start, each in
    the text as it is by then, so of two that overlap the earlier one's mask is written over the later's; of two that
    start together the kind listed later wins.  Counts are by kind, without those of 0."""
    patterns = [(k, re.compile(MASKED[k])) for k in MASKED if k in kinds]

    @F.pandas_udf("content string, counts map<string,int>")
    def masked(values: pd.Series) -> pd.DataFrame:
        texts, counts = [], []
        for value in values:
            own: dict[str, int] = {}
            if value is not None:
                hits = [(m.start(), m.end(), k, m[0]) for k, p in patterns for m in p.finditer(value)]
                for start, end, kind, found in sorted(hits, key=lambda h: -h[0]):
                    value = value[:start] + _mask_of(kind, found, mark) + value[end:]
                    own[kind] = own.get(kind, 0) + 1
            texts.append(value)
            counts.append(own)
        return pd.DataFrame({"content": texts, "counts": counts})

    may = text.rlike(r"[0-9]{11}|[0-9]\.[0-9]|@|https?://|[^\x00-\x7F][0-9]|[0-9][^\x00-\x7F]")
    found = masked(F.when(may, text))
    return F.struct(F.coalesce(found["content"], text).alias("content"), found["counts"].alias("counts"))


def injection_hits(text: Column, level: str = "standard") -> Column:
    """Names of the rules that text meets.  The rule for repeats is asked by fourfold(), as its pattern costs the square of
    a line's length."""
    found = [F.when(fourfold(text) if name == "repeat" else text.rlike(p), F.lit(name)) for part in LEVELS[level] for name, p in INJECTION[part]]
    return F.array_compact(F.array(*found))


#: Code points of texts, and places in them, that are compared at once.
_TOGETHER, _PLACES = 1 << 18, 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fourfold_lines(codes: np.ndarray, line: np.ndarray, lines: int, longest: int, least: int) -> np.ndarray:
    """Which of the lines in codes hold something of `least` codes or more four times in a row; each line ends in a code
    of its own.  Something of p codes four times fills three places in a row of the grid of p, so for each p the places
    that equal the next two are sought by hashes, and compared code by code with what is around them."""
    n, found = len(codes), np.zeros(lines, dtype=bool)
    powers = np.r_[np.uint64(1), np.cumprod(np.full(n, _BASE))]
    sums = np.r_[np.uint64(0), np.cumsum(codes * powers[:-1])]
    at = least
    while at <= longest // 4 and not found.all():
        periods = np.arange(at, min(longest // 4, at + max(1, _PLACES * at // n)) + 1)
        at = int(periods[-1]) + 1
        count = np.maximum(n // periods - 2, 0)
        period = np.repeat(periods, count)
        place = (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * period
        for k in (1, 2):
            same = codes[place] == codes[place + k * period]
            place, period = place[same], period[same]
        first, second, third = (sums[place + (k + 1) * period] - sums[place + k * period] for k in range(3))
        same = (first * powers[period] == second) & (second * powers[period] == third) & ~found[line[place]]
        for i, p in zip(place[same].tolist(), period[same].tolist()):
            if not found[line[i]]:
                low, high = max(0, i - p), min(i + 3 * p, n - p)
                other = np.flatnonzero(codes[low:high] != codes[low + p : high + p])
                found[line[i]] = np.diff(np.r_[-1, other, high - low]).max() > 3 * p
    return found


def _fourfold(texts: list[str], least: int) -> np.ndarray:
    """Whether each text has such a line.  Lines are taken together by the powers of two of their lengths."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[(codes >= 65) & (codes <= 90)] += np.uint64(32)
    ends = np.r_[np.flatnonzero(np.isin(codes, [0x0A, 0x0D, 0x85, 0x2028, 0x2029])), len(codes)]
    starts = np.r_[0, ends[:-1] + 1]
    long = ends - starts >= 4 * least
    starts, sizes = starts[long], (ends - starts)[long]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    out = np.zeros(len(texts), dtype=bool)
    power = np.frexp(sizes)[1]
    for k in np.unique(power):
        own = np.flatnonzero(power == k)
        size = sizes[own] + 1
        line = np.repeat(np.arange(len(own)), size)
        inside = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        last = inside == sizes[own][line]
        part = np.where(last, line.astype(np.uint64) + np.uint64(1 << 32), codes[np.minimum(starts[own][line] + inside, len(codes) - 1)])
        out[text[own[_fourfold_lines(part, line, len(own), int(sizes[own].max()), least)]]] = True
    return out


def fourfold(text: Column, least: int = 10) -> Column:
    """Whether a line of text holds `least` or more characters four times in a row, ASCII letters of either case alike:
    the pattern (?i)(.{10,}?)\\1{3,}, in n log n of a line's length n."""

    @F.pandas_udf("boolean")
    def holds(values: pd.Series) -> pd.Series:
        texts, out, low, held = values.fillna("").tolist(), [], 0, 0
        for i, t in enumerate(texts):
            if i > low and held + len(t) > _TOGETHER:
                out.append(_fourfold(texts[low:i], least))
                low, held = i, 0
            held += len(t)
        return pd.Series(np.concatenate([*out, _fourfold(texts[low:], least)]) if texts else [], dtype=bool)

    return F.coalesce(holds(F.when(F.length(text) >= 4 * least, text)), F.lit(False))


def _repeated(text: str, window: int) -> float:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n = len(codes) - window + 1
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[k : k + n]
    return window * (n - len(np.unique(hashed))) / len(codes)


def repetition(text: Column, window: int = 50, least: int = 100) -> Column:
    """Share of characters in sliding windows seen before, counted each time; may exceed 1.  0 under `least` characters.
    Windows are told by 64-bit hashes in numpy, in time and memory linear in the text: substrings by place would each be
    sought from the text's beginning."""

    @F.pandas_udf("double")
    def share(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _repeated(v, window), na_action="ignore")

    return F.coalesce(share(F.when(F.length(text) >= max(least, window), text)), F.lit(0.0))


def length_checks(text: Column, chars: int = 100_000, lines: int = 10_000, line: int = 10_000, repeated: float | None = 0.8) -> Column:
    split = F.split(text, "\n", -1)
    checks = [F.when(F.length(text) > chars, "chars"), F.when(F.size(split) > lines, "lines"), F.when(F.array_max(F.transform(split, F.length)) > line, "line_length")]
    if repeated is not None:
        checks.append(F.when(repetition(text) > repeated, "repetition"))
    return F.array_compact(F.array(*checks))


def truncate(text: Column, chars: int = 100_000, lines: int = 10_000, line: int = 10_000) -> Column:
    cut = F.transform(F.slice(F.split(text, "\n", -1), 1, lines), lambda x: F.substring(x, 1, line))
    return F.substring(F.array_join(cut, "\n"), 1, chars)


def char_grams(text: Column, n: int = 3) -> Column:
    size = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(text)).otherwise(F.array_distinct(grams))


def word_grams(text: Column, n: int = 2) -> Column:
    """Distinct n-grams of white-space words; none under n words.  Shifted copies of the words are zipped, as a lambda
    that sliced them would split the text anew for each gram."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    size = F.greatest(F.size(words) - n + 1, F.lit(0))
    grams = F.slice(words, F.lit(1), size)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(words, F.lit(k + 1), size), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(grams)


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)
