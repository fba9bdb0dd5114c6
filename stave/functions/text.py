"""Text matching, URL and log expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stave.functions import vocabulary as V


def tokens(value: Column) -> Column:
    """Lower-case alphanumeric tokens of a title, without filler words."""
    joined = F.regexp_replace(F.lower(value), "['’‘ʼ]", "")
    parts = F.split(joined, r"[^\p{IsAlphabetic}\p{N}]+")
    cut = F.transform(parts, lambda t: F.left(t, F.lit(64)))
    return F.slice(F.filter(cut, lambda t: (t != "") & ~t.isin(*V.TITLE_STOP_TOKENS)), 1, 32)


def similarity(left: Column, right: Column) -> Column:
    """1 when equal, else edit similarity if both are long and close enough, else 0."""
    longest = F.greatest(F.char_length(left), F.char_length(right))
    near = F.lit(1.0) - F.levenshtein(left, right) / longest
    return F.when(left == right, 1.0).when(longest < 4, 0.0).when(near >= 0.72, near).otherwise(0.0)


def recall(expected: Column, actual: Column) -> Column:
    """Mean over expected tokens of the best similarity to an actual token."""
    best = F.transform(
        expected,
        lambda e: F.coalesce(F.array_max(F.transform(actual, lambda a: similarity(e, a))), F.lit(0.0)),
    )
    total = F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(expected) > 0, total / F.size(expected)).otherwise(F.lit(0.0))


def artist_and_title(query: Column) -> tuple[Column, Column]:
    """Both halves of an ``artist - title`` query; null when it is not one."""
    artist, title = F.lit(None).cast("string"), F.lit(None).cast("string")
    for separator in reversed(V.ARTIST_SEPARATORS):
        at = F.instr(query, separator)
        left = F.substring(query, F.lit(1), at - 1)
        right = F.substring(query, at + len(separator), F.length(query))
        artist = F.when(at > 0, left).otherwise(artist)
        title = F.when(at > 0, right).otherwise(title)
    usable = (F.trim(artist) != "") & (F.trim(title) != "")
    return F.when(usable, artist), F.when(usable, title)


def host_of(url: Column) -> Column:
    rest = F.regexp_replace(url, "^.*?://", "")
    authority = F.regexp_extract(rest, "^([^/?#]*)", 1)
    bare = F.regexp_replace(authority, "^.*@", "")
    return F.lower(F.regexp_extract(bare, "^([^:]*)", 1))


def provider_of(url: Column) -> Column:
    host = host_of(url)
    result = F.lit("Web")
    for suffix, name in reversed(list(V.PROVIDERS.items())):
        hit = host == suffix
        if suffix not in V.EXACT_HOSTS:
            hit = hit | host.endswith("." + suffix)
        result = F.when(hit, name).otherwise(result)
    return result


def _decoded(text: Column) -> Column:
    """Percent-decoding that keeps ``+`` and falls back to the text itself."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _parameter(query: Column, name: str) -> Column:
    found = F.regexp_extract(query, rf"[?&]{name}=([^&]*)", 1)
    return F.when(found != "", _decoded(F.replace(found, F.lit("+"), F.lit(" "))))


def candidate_key(kind: Column, value: Column) -> Column:
    """The key under which two pasted sources are the same source."""
    path = F.regexp_replace(value, r"(?i)^file://(?:localhost)?", "")
    file_key = F.concat(F.lit("file:"), F.lower(_decoded(F.regexp_extract(path, r"([^\\/]*)$", 1))))
    squashed = F.lower(F.regexp_replace(F.trim(value), r"\s+", " "))
    host = host_of(value)
    url_path = F.regexp_extract(value, _URL, 3)
    query = F.regexp_extract(value, _URL, 4)
    scheme = F.lower(F.regexp_extract(value, _URL, 1))
    authority = F.lower(F.regexp_extract(value, _URL, 2))
    authority = F.when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(
        F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(authority)
    )
    trimmed = F.regexp_replace(url_path, "/$", "")
    shown_path = F.when(trimmed == "", "/").otherwise(trimmed)
    plain = F.concat(F.lit("url:"), scheme, F.lit("://"), authority, shown_path, query)
    listed, video = _parameter(query, "list"), _parameter(query, "v")
    url_key = (
        F.when(~value.rlike(_URL), F.concat(F.lit("url:"), F.trim(value)))
        .when(
            host == "youtu.be",
            F.concat(F.lit("youtube-video:"), F.regexp_extract(url_path, "^/*([^/]*)", 1)),
        )
        .when(host.isin(*V.VIDEO_HOSTS) & listed.isNotNull(), F.concat(F.lit("youtube-playlist:"), listed))
        .when(host.isin(*V.VIDEO_HOSTS) & video.isNotNull(), F.concat(F.lit("youtube-video:"), video))
        .otherwise(plain)
    )
    return (
        F.when(kind == "local", file_key).when(kind == "search", F.concat(F.lit("search:"), squashed)).otherwise(url_key)
    )


def is_playlist(url: Column) -> Column:
    return url.contains("list=") | url.contains("/playlist") | url.contains("/sets/") | url.contains("/album/")


def error_class(log: Column) -> tuple[Column, Column]:
    """Class and hint of a failure log; the first rule that matches wins."""
    low = F.lower(log)
    name, hint = F.lit(V.OTHER_ERROR[0]), F.lit(V.OTHER_ERROR[1])
    for rule, advice, alternatives in reversed(V.ERROR_RULES):
        hit = F.lit(False)
        for needles in alternatives:
            every = F.lit(True)
            for needle in needles:
                every = every & low.contains(needle)
            hit = hit | every
        name, hint = F.when(hit, rule).otherwise(name), F.when(hit, advice).otherwise(hint)
    return name, hint


def extension(path: Column) -> Column:
    """Lower-case extension, ignoring anything from ``?`` or ``#`` on."""
    clean = F.regexp_extract(path, r"^([^?#]*)", 1)
    return F.lower(F.regexp_extract(clean, r"\.([^.]*)$", 1))


def log_level(line: Column) -> Column:
    upper = F.upper(line)
    return (
        F.when(upper.contains(" ERROR "), "error")
        .when(upper.contains(" WARN "), "warn")
        .when(upper.contains(" DEBUG ") | upper.contains(" TRACE "), "debug")
        .otherwise("info")
    )


def level_rank(level: Column) -> Column:
    return F.when(level == "debug", 0).when(level == "warn", 2).when(level == "error", 3).otherwise(1)


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def lyrics_queries(title: Column) -> Column:
    """Up to three searches for a title: all words, then one and two fewer."""
    bare = F.regexp_replace(title, r"\([^)]*\)|\[[^\]]*\]", " ")
    spaced = F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    made = F.transform(
        F.array(F.lit(0), F.lit(1), F.lit(2)),
        lambda drop: F.when(
            F.size(words) - drop > 0, F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - drop, F.lit(0))), " ")
        ),
    )
    return F.filter(made, lambda q: q.isNotNull())
