"""Texts and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TURNED = "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"


def one_slash(path: Column) -> Column:
    """Backslashes become slashes, NUL characters go."""
    return F.replace(F.translate(path, "\\", "/"), F.lit("\0"), F.lit(""))


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.substring_index(one_slash(path), "/", -1)


def folder(path: Column) -> Column:
    """What precedes the last slash or backslash; '' without one."""
    p = one_slash(path)
    return F.regexp_replace(F.when(p.contains("/"), p).otherwise(F.when(p.isNotNull(), "/")), r"/[^/]*$", "")


def extension(name: Column) -> Column:
    """Without the dot and as written; '' if there is none or the name starts with its only dot."""
    return F.regexp_extract(name, r"[^./]\.([^./]*)$", 1)


def rot13(text: Column) -> Column:
    return F.translate(text, _PLAIN, _TURNED)


def guid(hexed: Column) -> Column:
    """32 hex digits of a GUID in memory order -> its written form (the first three groups are little endian)."""
    pair = lambda i: F.substring(hexed, 2 * i + 1, 2)
    run = lambda *order: F.concat(*(pair(i) for i in order))
    return F.lower(F.concat_ws("-", run(3, 2, 1, 0), run(5, 4), run(7, 6), run(8, 9), run(*range(10, 16))))


def reversed_bytes(hexed: Column) -> Column:
    """Hex digits with their bytes in reverse order."""
    return F.array_join(F.reverse(F.regexp_extract_all(hexed, F.lit("(?i)[0-9a-f]{2}"), F.lit(0))), "")


def little_endian(hexed: Column) -> Column:
    """The number that little-endian hex digits (up to 15) hold."""
    return F.conv(reversed_bytes(hexed), 16, 10).try_cast("bigint")


def masked(text: Column, first: int, length: int) -> Column:
    """Only the characters from ``first`` (1-based) on, ``length`` of them."""
    return F.substring(text, first, length)


def masked_digits(text: Column) -> Column:
    """The middle group of a number with three groups is hidden."""
    return F.regexp_replace(text, r"(\d{2,4})([-. ])\d{3,4}([-. ])(\d{4})", r"$1$2****$3$4")


def within(text: Column, label: str) -> Column:
    """What stands between ``label">`` and the last ``<`` of the line; null without a match."""
    return F.nullif(F.regexp_extract(text, label + r'"?>(.*)<', 1), F.lit(""))


def rooted(parent: Column) -> Column:
    """A parent folder under the image's root; null stays null."""
    return F.concat(F.lit("root"), parent)


def unescaped(xml: Column) -> Column:
    """The five named entities of XML as characters (the ampersand last, so that nothing is read twice); NUL characters go."""
    out = F.replace(xml, F.lit("\0"), F.lit(""))
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return out


def app_name(file_name: Column, names: dict[str, str]) -> Column:
    """The program of a jump list by its id, which is the file's name without extension; null for unknown ids."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return known[F.lower(F.substring_index(base_name(file_name), ".", 1))]


def provenance(root: Column, browser: str, profile: Column) -> Column:
    """Where a browser's record comes from: root, browser and profile; the profile is left out where there is none."""
    return F.concat_ws("/", root, F.lit(browser), F.when(F.trim(profile) != "", F.trim(profile)))


# Kinds of the activities that a system's own timeline records.
ACTIVITIES = {2: "Notification", 3: "Mobile Backup", 5: "Open App/File/Page", 6: "App In Use/Focus", 10: "Clipboard", 16: "Copy/Paste", 11: "System", 12: "System", 15: "System"}


def activity_type(code: Column) -> Column:
    """The kind of an activity; null for codes that mean nothing."""
    out = F.lit(None).cast("string")
    for k, name in ACTIVITIES.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def activity_app(json: Column) -> Column:
    """The application of an activity from a JSON array of platforms: the second if the first is the platform-independent one, else the first."""
    first, second = (F.get_json_object(json, f"$[{i}].application") for i in (0, 1))
    return F.when(F.get_json_object(json, "$[0].platform") == "afs_crossplatform", second).otherwise(first)


def like_ci(text: Column, pattern: str) -> Column:
    """LIKE regardless of case; a pattern without wildcards is equality."""
    if "%" not in pattern and "_" not in pattern:
        return F.lower(text) == pattern.lower()
    return text.ilike(pattern)


# Hosts of search pages and the names that reports use for them.
SEARCH_SITES = (("google.", "Google"), ("naver.com", "Naver"), ("daum.net", "Daum"), ("bing.com", "Bing"), ("yahoo.", "Yahoo"), ("youtube.com", "YouTube"), ("duckduckgo.", "DuckDuckGo"))


def search_site(url: Column) -> Column:
    """The site's name, else ''."""
    found = F.lit("")
    for part, name in reversed(SEARCH_SITES):
        found = F.when(url.contains(part), name).otherwise(found)
    return F.when(url.isNotNull(), found)


def bare_words(text: Column) -> Column:
    """Lower case without quotes, brackets and digits."""
    return F.lower(F.regexp_replace(text, r"[\"'\[\]()0-9]", ""))


def annotated(value: Column) -> Column:
    """(value, name, format) of an app's ``value(name:format)``; name and format are null without an annotation."""
    pattern = r"^(.*)\(([A-Za-z0-9_]+):([A-Za-z0-9_]+)\)$"
    has = value.rlike(pattern)
    part = lambda k: F.when(has, F.regexp_extract(value, pattern, k))
    return F.struct(F.coalesce(part(1), value).alias("value"), part(2).alias("name"), part(3).alias("format"))


def without_nulls(text: Column) -> Column:
    """The several spellings of nothing (blank, NULL, None, N/A) as null."""
    return F.when(F.upper(F.trim(text)).isin("", "NULL", "NONE", "N/A"), F.lit(None)).otherwise(text)
