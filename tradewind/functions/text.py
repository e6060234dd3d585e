"""Text normalisation and lexicon matching as Column functions. All are built from JVM-side functions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import ARABIC_DIGITS, ASCII_DIGITS, PERSIAN_DIGITS

#: White space as Python sees it (Java's \s is ASCII only, and trim strips only spaces).
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LATIN_OR_PERSIAN = "A-Za-zآ-ی"

#: Told first of a character, as most of a text is of them: none is white space. White space but the plain space.
_DENSE = r"(?![!-~\x{600}-\x{6ff}])"
_ODD_BLANK = BLANK.replace(r"\s", r"\t\n\x0b\f\r")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def keep(value: Column, condition) -> Column:
    """The value if it meets the condition, else null; computed once."""
    return F.get(F.filter(F.array(value), condition), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"{_DENSE}(?:^{BLANK}++|{BLANK}++$)", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{_DENSE}(?:{_ODD_BLANK}{BLANK}*+| {BLANK}++)", " "))  # a lone space stays


def _class(chars: str) -> str:
    """A character class of few ranges, which is searched faster than one of many characters."""
    runs: list[list[int]] = []
    for n in sorted(map(ord, set(chars))):
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


def _changed(c: Column, source: str, target: str) -> Column:
    """c translated; texts without any of the characters are only searched, which is faster."""
    return let(c, lambda t: F.when(t.rlike(_class(source)), F.translate(t, source, target)).otherwise(t))


def normalize_digits(c: Column, arabic: bool = True) -> Column:
    digits = PERSIAN_DIGITS + (ARABIC_DIGITS if arabic else "")
    return _changed(F.coalesce(c, F.lit("")), digits, ASCII_DIGITS * (len(digits) // 10))


_DIGITS = PERSIAN_DIGITS + ARABIC_DIGITS

#: Vowel marks, which normalised texts are without.
MARKS = "".join(map(chr, range(0x64B, 0x660)))


def _folded(c: Column) -> Column:
    """In one pass: digits and Arabic letter forms folded, joiners as spaces, vowel marks dropped (they have no counterpart)."""
    source = PERSIAN_DIGITS + ARABIC_DIGITS + "كيىةۀؤإأٱ" + "\u200c\u200f\ufeff"
    target = ASCII_DIGITS * 2 + "کییههواا" + "ا" + "   "
    return _changed(F.coalesce(c, F.lit("")), source + MARKS, target)


def normalize_text(c: Column) -> Column:
    """Digits and Arabic letter forms folded, joiners as spaces, vowel marks dropped, white space squeezed."""
    return squeeze(_folded(c))


_PLAIN = str.maketrans(_DIGITS + "كيىةۀؤإأٱ" + "\u200c\u200f\ufeff", ASCII_DIGITS * 2 + "کییههواا" + "ا" + "   ", MARKS)
_NOT_PLAIN = re.compile("[" + "".join(map(chr, _PLAIN)) + "]+")


def _plain_text(text: str) -> str:
    if not text.isascii() and _NOT_PLAIN.search(text):
        text = _NOT_PLAIN.sub(lambda m: m[0].translate(_PLAIN), text)
    return " ".join(text.split())


_plain_word = lru_cache(1 << 14)(_plain_text)


def plain_text(text: str) -> str:
    """What normalize_text does, for texts that a task holds. Short ones, which are read again and again, are remembered."""
    return _plain_word(text) if len(text) <= 60 else _plain_text(text)


_NAMED = re.compile("[0-9a-zآ-ی]+")


def plain_compact(text: str) -> str:
    """What compact_text does, for texts that a task holds, normalised ones."""
    return " ".join(_NAMED.findall(text.lower()))


def compact_text(c: Column) -> Column:
    other = "[^0-9a-zآ-ی]"
    return F.trim(F.regexp_replace(F.lower(_folded(c)), f"[^0-9a-zآ-ی ]{other}*+| {other}++", " "))


def normalize_match(c: Column) -> Column:
    """Lower case, letter forms folded, letters and digits parted, punctuation as spaces."""
    t = _changed(F.lower(F.coalesce(c, F.lit(""))), _DIGITS + "‌‏‎يكۀة", ASCII_DIGITS * 2 + "   یکهه")
    t = F.regexp_replace(t, f"([{LATIN_OR_PERSIAN}](?=[0-9])|[0-9](?=[{LATIN_OR_PERSIAN}]))", "$1 ")
    return _spaced(t, r"_/\\|,:;؛،!?؟()\[\]{}")


def normalize_match_any(c: Column) -> Column:
    """As normalize_match, for letters of any script, with dashes unified."""
    t = _changed(F.lower(F.coalesce(c, F.lit(""))), _DIGITS + "يكۀة_/\\|–—", ASCII_DIGITS * 2 + "یکهه    --")
    t = F.regexp_replace(t, r"(\p{L}(?=[0-9])|[0-9](?=\p{L}))", "$1 ")
    return _spaced(t, r"()\[\]{}:؛;،,!?؟")


def _spaced(c: Column, marks: str) -> Column:
    """Runs of white space and of these marks as one space, none at the ends."""
    run = BLANK[:-1] + marks + "]"
    return F.trim(F.regexp_replace(c, f"(?![0-9a-z\\x{{620}}-\\x{{6ff}}])(?:{_ODD_BLANK[:-1]}{marks}]{run}*+| {run}++)", " "))


def first_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """The first phrase of the list (in its order) that the text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases], F.lit(None).cast("string"))


_EDGE = {True: r"(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])", False: "(?<![a-z0-9])(?=[a-z0-9])|(?<=[a-z0-9])(?![a-z0-9])"}


def _edges(phrase: str, bounded: bool) -> str:
    word = r"\w" if bounded else "[a-z0-9]"
    return re.sub(rf"(?<!{word})(?={word})|(?<={word})(?!{word})", "\x02", phrase)


def longest_alias(text: Column, aliases: Mapping[str, object], bounded: bool = False) -> Column:
    """What the longest alias in the text stands for; on ties, the earliest of the list.

    Aliases of Latin letters and digits need borders, others none unless ``bounded``. Values may be tuples, joined by a tab.
    Borders are marked once in the text, and the list is one array literal, so that its length doesn't grow the generated code.
    """
    value = lambda v: "\t".join(v) if isinstance(v, tuple) else v
    needs = lambda a: bounded or bool(re.fullmatch("[a-z0-9 ]+", a))
    rows = [F.struct(F.lit(len(a)).alias("n"), F.lit(-k).alias("o"), F.lit(value(v)).alias("v"), F.lit(needs(a)).alias("e"), F.lit(_edges(a, bounded) if needs(a) else a).alias("a")) for k, (a, v) in enumerate(aliases.items())]
    both = F.transform(F.array(text), lambda t: F.struct(t.alias("plain"), F.regexp_replace(t, _EDGE[bounded], "\x02").alias("marked")))
    hit = lambda h: F.array_max(F.filter(F.array(*rows), lambda r: F.contains(F.when(r["e"], h["marked"]).otherwise(h["plain"]), r["a"])))
    return F.get(F.transform(both, hit), 0)["v"]


def earliest_alias(text: Column, aliases: Sequence[str], fallback: str = "unknown") -> Column:
    """The alias that starts first (the longest of those at one place) and a Latin token of 2 to 9 characters after it; else the
    start of the first line, at most 60 characters; else the fallback."""
    # One search: alternatives are tried longest first at each place, and the first place with any of them wins.
    word = r"[\p{L}\p{N}_]"
    names = "|".join(re.escape(a) for a in sorted(aliases, key=len, reverse=True))
    pattern = rf"(?<!{word})({names})(?!{word})(?:{BLANK}+([A-Za-z][A-Za-z0-9\-]{{1,8}})(?!{word}))?"
    name, trim = (F.regexp_extract(text, pattern, k) for k in (1, 2))
    line = strip(F.substring(strip(F.element_at(F.split(text, "\n"), 1)), 1, 60))
    return F.when(name != "", F.concat_ws(" ", name, F.nullif(trim, F.lit("")))).otherwise(F.coalesce(F.nullif(line, F.lit("")), F.lit(fallback)))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no trailing slash, query or fragment; without a scheme, only stripped."""
    u = strip(F.coalesce(url, F.lit("")))
    scheme = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    host = F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"^[^:/?#]+:(?://[^/?#]*)?([^?#]*)", 1)
    path = F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))
    return F.when(scheme == "", u).otherwise(F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path))


def id_from_url(url: Column) -> Column:
    """The last part of the path; without one, the first 24 digits of the URL's sha256."""
    path = F.regexp_extract(url, r"^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1)
    last = F.regexp_extract(path, "([^/]+)/*$", 1)
    return F.coalesce(F.nullif(last, F.lit("")), F.substring(F.sha2(F.coalesce(url, F.lit("")).cast("binary"), 256), 1, 24))


def strip_signature(c: Column) -> Column:
    """Without a trailing @name."""
    signed = F.regexp_replace(c, rf"(?![!-?A-~\x{{600}}-\x{{6ff}}]){BLANK}*+@[A-Za-z0-9_]++{BLANK}*+$", "")
    return strip(F.when(F.contains(c, F.lit("@")), signed).otherwise(c))


def remove_phrases(c: Column, phrases: Sequence[str]) -> Column:
    return squeeze(reduce(lambda t, p: F.replace(t, F.lit(p), F.lit(" ")), phrases, c))


#: Offers that one source adds to every card.
SOURCE_PHRASES = {
    "hamrah_mechanic": ("قابل معاوضه", "امکان خرید اقساطی", "اقساط 1 تا 60 ماه", "اقساط ۱ تا ۶۰ ماه", "کارشناسی شده", "گارانتی 7 روزه", "گارانتی ۷ روزه", "درحال کارشناسی")
}


def source_text(source: Column, c: Column, phrases: Mapping[str, Sequence[str]] = SOURCE_PHRASES) -> Column:
    """The text without the phrases of its source; as it is for other sources."""
    out = c
    for name, own in phrases.items():
        out = F.when(source == name, remove_phrases(c, own)).otherwise(out)
    return out


def html_clean_text(html: Column) -> Column:
    """Line breaks kept as newlines, tags dropped, six entities decoded (the ampersand first), ends stripped."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>", "\n"), "<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return strip(t)
