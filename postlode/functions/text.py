"""Normalising text, as column expressions. All map null to null unless they say otherwise."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlode.functions import urls

#: Words that end company names.
LEGAL_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "company", "co", "gmbh", "plc", "pvt", "private")
TITLE_NOISE = ("job", "opening", "position", "vacancy")


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def key_text(c: Column) -> Column:
    """A key column: text, null as the empty string, stripped.

    The pattern is left to texts that begin with a space or less, or end with what it takes for a space or a line's end.
    """
    x = c.cast("string")
    ends = reduce(or_, (F.endswith(x, F.lit(end)) for end in " \t\n\x0b\f\r\x85\u2028\u2029"))
    return F.coalesce(F.when((x < "!") | ends, strip(x)).otherwise(x), F.lit(""))


def match_text(c: Column) -> Column:
    """Lower case; & as and; slashes and bars as spaces; other marks but + # . - dropped."""
    x = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    x = F.regexp_replace(x, r"[/|]+", " ")
    return collapse(F.regexp_replace(x, r"[^a-z0-9+#.\s-]", " "))


def company_key(c: Column) -> Column:
    """Letters and digits only; null as the empty string."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]", "")


def company_words(c: Column) -> Column:
    """Lower case without legal suffixes, other marks as spaces."""
    words = F.split(collapse(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*LEGAL_SUFFIXES)), " ")


def title_words(c: Column) -> Column:
    x = F.regexp_replace(F.lower(c), r"\b(" + "|".join(TITLE_NOISE) + r")\b", " ")
    return collapse(F.regexp_replace(x, r"[^a-z0-9+#/&.\s-]", " "))


def place_text(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(c), r"[^a-z0-9,\-/ ]", " "))


def identifier_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def title_core(c: Column) -> Column:
    """Lower case; of two or more groups in brackets the last goes if it ends the title."""
    groups = F.size(F.regexp_extract_all(c, F.lit(r"\([^()]*\)"), F.lit(0)))
    cut = F.when(groups >= 2, F.regexp_replace(c, r"\s*\([^()]*\)\s*$", "")).otherwise(c)
    return collapse(F.lower(cut))


def tokens(c: Column) -> Column:
    """Distinct words of letters and digits, in order."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct tokens; 0 where both are empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ > 0, both / all_).otherwise(F.lit(0.0))


def containment(part: Column, whole: Column) -> Column:
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(F.lit(0.0))


def has_repeated_word(c: Column) -> Column:
    w = F.split(collapse(F.lower(c)), " ")
    return F.exists(F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.size(w)).alias("b")), lambda p: p["a"] == p["b"])


def query_text(c: Column) -> Column:
    """A search query: dashes alike, marks dropped, neighbouring equal words once."""
    x = collapse(F.regexp_replace(F.regexp_replace(F.lower(c), "[–—]", "-"), r"[^a-z0-9+#.\s-]", " "))
    x = F.regexp_replace(x, r"\bentrylevel\b", "entry level")
    words = F.split(x, " ")
    kept = F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1)))
    return F.array_join(kept, " ")


def result_title(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+-\s+(Google Search|Bing)\s*$", "")


def html_text(c: Column) -> Column:
    """Tags as spaces, without scripts and styles, character references decoded."""
    x = F.regexp_replace(c, r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    return collapse(F.replace(unescape(x), F.lit("\xa0"), F.lit(" ")))


def html_title(c: Column) -> Column:
    return F.nullif(collapse(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_links(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r'(?i)href="([^"]*)"'), F.lit(1)))


def matching(c: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that match, in order."""
    each = F.array(*(F.when(c.rlike(p), F.lit(name)) for name, p in patterns.items()))
    return F.filter(each, lambda x: x.isNotNull())


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(w.lower())), F.lit(False))
    return out


def company_stem(c: Column) -> Column:
    """company words without the legal suffixes and without technologies or technology."""
    return F.array_join(F.filter(F.split(company_words(c), " "), lambda w: ~w.isin("technologies", "technology")), " ")


def plain_words(c: Column) -> Column:
    """Lower case; & as and; slashes, dashes and underscores as spaces; other marks as spaces."""
    return collapse(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " "))


def compact(c: Column) -> Column:
    return F.replace(plain_words(c), F.lit(" "), F.lit(""))


#: Named references, by the standard library's table of HTML 4, and what browsers take numbers 128 to 159 for.
NAMED = {name: chr(point) for name, point in name2codepoint.items()} | {"apos": "'"}
_OLD = {n: bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}


def _character(point: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    old = F.create_map(*(F.lit(x) for item in _OLD.items() for x in item))
    none = (point == 0) | point.between(0xD800, 0xDFFF) | (point > 0x10FFFF)
    made = F.decode(F.unhex(F.lpad(F.hex(F.when(~none, point)), 8, "0")), "UTF-32")
    return F.when(none, "\ufffd").when(point.between(128, 159), F.try_element_at(old, point.cast("int"))).otherwise(made)


def _reference(part: Column) -> Column:
    """What stands behind an ampersand, with the reference at its start decoded; the ampersand stays if there is none."""
    found = F.regexp_extract(part, r"^(#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]*;)", 1)
    digits = F.regexp_replace(found, r"^#[xX]?|;$", "")
    point = F.when(found.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
    named = F.try_element_at(F.create_map(*(F.lit(x) for item in NAMED.items() for x in item)), F.regexp_replace(found, ";$", ""))
    character = F.when(F.startswith(found, F.lit("#")), _character(point)).otherwise(named)
    return F.coalesce(F.concat(character, F.substr(part, F.length(found) + 1)), F.concat(F.lit("&"), part))


def unescape(c: Column) -> Column:
    """Character references decoded once: decimal, hexadecimal and the named ones of HTML 4."""
    parts = F.split(c, "&")
    decoded = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(_reference(part)))
    return F.when(F.contains(c, F.lit("&")), F.array_join(decoded, "")).otherwise(c)


def double_encoded_text(c: Column) -> Column:
    """The text of HTML that was escaped as a whole before it was stored."""
    return html_text(unescape(c))


def absolute_links(c: Column, page: Column) -> Column:
    """The addresses that a page links to, each once, in order: absolute, canonical, http and https only."""
    found = F.regexp_extract_all(c, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)", 0)
    scheme = F.regexp_extract(root, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)

    def whole(link: Column) -> Column:
        return F.when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(root, link)).otherwise(link)

    links = F.transform(found, lambda x: urls.canonical(whole(strip(unescape(x)))))
    return F.array_distinct(F.filter(links, lambda u: u.rlike(r"(?i)^https?://[^/?#]")))


def apply_links(c: Column, page: Column) -> Column:
    """Of these the links to an application, by their address."""
    return F.filter(absolute_links(c, page), lambda u: F.lower(u).rlike(r"/apply|apply\?|/application|candidate"))


def apply_link(c: Column, page: Column, boards: tuple[str, ...]) -> Column:
    """Where to apply: a link to an applicant system, else to the page's own domain, else to a careers page; "" if none."""
    links = apply_links(c, page)
    on = lambda u: urls.base_domain(u)
    known = lambda u: F.coalesce(on(u).isin(*boards), F.lit(False))
    pick = lambda test: F.get(F.filter(links, test), 0)
    return F.coalesce(pick(known), pick(lambda u: F.coalesce(on(u) == on(page), F.lit(False))), pick(urls.is_career_path), F.lit(""))
