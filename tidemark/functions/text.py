"""Text normalisation and title similarity as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from html.entities import html5
from urllib.parse import uses_netloc
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = r"[\p{Z}\x09-\x0D\x1C-\x1F\x85]"
ZERO_WIDTH = "[​‌‍﻿]"
#: Similarity at which titles match, and token overlap from which their order is compared.
THRESHOLD, OVERLAP = 0.92, 0.75

#: How a bearer token looks in a text, and a field with a secret value.
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+"
SECRET_FIELD = r"(?i)(api[_-]?key|apikey|token|authorization|x-api-key|x-finnhub-token)(?:[\"']?\s*[=:]\s*[\"']?)([^\s,&;\"'}]+)"
#: A URL: its scheme, what may stand before the host, host and path, and the rest that goes.
_URL = r"(?i)(https?://)(?:[^\s\"'<>/?#@]*@)?([^\s\"'<>?#]*)[^\s\"'<>]*"


#: A numeric or named reference behind its ampersand.
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: What references to control characters stand for: the characters of the Windows code page.
_CONTROLS = {0: "\ufffd", 13: "\r"} | {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160)}


#: Maps that the names of references are dealt to.
NAMES = 256


def _map(pairs: dict) -> Column:
    """A map literal: one constant, however many pairs it has."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def _numbered(body: Column) -> Column:
    """The character of a numeric reference."""
    hexed = F.lower(F.substring(body, 2, 1)) == "x"
    digits = F.regexp_replace(F.regexp_extract(body, "^#[xX]?([0-9a-fA-F]+)", 1), "^0+", "")
    n = F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(F.when(hexed, F.conv(F.concat(F.lit("0"), digits), 16, 10)).otherwise(F.concat(F.lit("0"), digits)).cast("int"))
    letter = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    missing = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 65534)
    told = F.try_element_at(_map(_CONTROLS), n.cast("string"))
    return F.coalesce(told, F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd")).when(missing, F.lit("")).otherwise(letter))


@lru_cache(maxsize=1)
def _names(_: int) -> Column:
    """The names of references, dealt to small maps by their checksum, since maps are searched one by one."""
    return F.array(*[_map({n: v for n, v in html5.items() if crc32(n.encode()) % NAMES == i}) for i in range(NAMES)])


def _name(name: Column) -> Column:
    """What a named reference stands for."""
    maps = _names(id(SparkContext._active_spark_context))  # made once a context, as it has 2,000 names
    return F.try_element_at(F.element_at(maps, (F.crc32(F.encode(name, "UTF-8")) % NAMES + 1).cast("int")), name)


def _referred(part: Column, body: Column) -> Column:
    """A text behind an ampersand, with the reference at its start (``body``) decoded; as it was, ampersand included, without one."""
    short = F.regexp_extract(body, f"^({'|'.join(sorted((n for n in html5 if n[-1] != ';'), key=len, reverse=True))})", 1)  # the longest name that needs no semicolon
    cut = F.when(short != "", F.concat(_name(short), F.substring(body, F.length(short) + 1, F.length(body))))
    read = F.when(body == "", "&").when(F.startswith(body, F.lit("#")), _numbered(body)).otherwise(F.coalesce(_name(body), cut, F.concat(F.lit("&"), body)))
    return F.concat(read, F.substring(part, F.length(body) + 1, F.length(part)))


def unescaped(value: Column) -> Column:
    """Character references decoded as HTML has them: named ones, with the longest known name where the semicolon is missing,
    and numeric ones, those of control characters by the Windows code page. One pass: what is decoded is not read again."""
    rest = F.transform(F.slice(F.split(value, "&"), 2, F.length(value)), lambda p: F.struct(p.alias("part"), F.regexp_extract(p, _REFERENCE, 1).alias("body")))
    decoded = F.array_join(F.transform(rest, lambda x: _referred(x["part"], x["body"])), "")
    return F.when(F.contains(value, F.lit("&")), F.concat(F.substring_index(value, "&", 1), decoded)).otherwise(value)


def clean_text(value: Column, empty: str | None = None) -> Column:
    """References decoded, zero-width characters dropped, white space collapsed; ``empty`` if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(unescaped(value), ZERO_WIDTH, ""), WHITE + "+", " ")
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(empty))


def normalize_title(title: Column) -> Column:
    """Lower case, runs of other characters than letters, digits and underscores as one space."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_]+", " "))


def title_tokens(normalized: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda t: t != ""))


def title_numbers(normalized: Column) -> Column:
    """The sorted distinct numbers of a normalised title, joined: equal sets have equal strings."""
    return F.array_join(F.array_sort(F.filter(title_tokens(normalized), lambda t: t.rlike(r"^\p{Nd}+$"))), " ")


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two arrays of distinct tokens; 0 for two empty ones."""
    common = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def ratio_bound(left: Column, right: Column) -> Column:
    """No less than sequence_ratio: as if all common characters, counted with repeats, matched in order."""
    count = lambda text, letter: F.length(text) - F.length(F.replace(text, letter, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split(left, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(left, c), count(right, c))))
    return F.when(F.length(left) + F.length(right) > 0, 2 * common / (F.length(left) + F.length(right))).otherwise(F.lit(1.0))


#: Cells of the table of common runs that a step of ratios fills at a time.
CELLS = 1 << 15


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Ratcliff-Obershelp ratios of pairs: twice the matched characters by all of both.

    The longest common run of a pair, the one that starts first in the left text and then in the right one, matches, and
    then in the same way what is before it and what is behind it. All pairs take each step together: the table of runs
    that end at a character of the left text is filled row by row for many pairs at once.
    """
    codes = [[np.frombuffer(t.encode("utf-32-le"), np.int32) for t in side] for side in (left, right)]
    matched = np.zeros(len(left), np.int64)
    todo = [(i, 0, len(a), 0, len(b)) for i, (a, b) in enumerate(zip(*codes)) if len(a) and len(b)]
    while todo:
        todo.sort(key=lambda t: (t[4] - t[3], t[2] - t[1]))
        at, rest = 0, []
        while at < len(todo):
            end, width = at + 1, todo[at][4] - todo[at][3]
            while end < len(todo) and (end - at + 1) * max(width, todo[end][4] - todo[end][3]) <= CELLS:
                width = max(width, todo[end][4] - todo[end][3])
                end += 1
            own, at = todo[at:end], end
            width, height = max(t[4] - t[3] for t in own), max(t[2] - t[1] for t in own)
            a, b = np.full((height, len(own)), -1, np.int32), np.full((len(own), width), -2, np.int32)
            for k, (i, low, high, start, stop) in enumerate(own):
                a[: high - low, k], b[k, : stop - start] = codes[0][i][low:high], codes[1][i][start:stop]
            runs, best = np.zeros((len(own), width + 1), np.int32), np.zeros((3, len(own)), np.int64)  # size, ends in a and b
            for row in range(height):
                runs[:, 1:] = np.where(b == a[row][:, None], runs[:, :-1] + 1, 0)
                where = runs.argmax(axis=1)
                size = runs[np.arange(len(own)), where]
                more = size > best[0]
                best[0, more], best[1, more], best[2, more] = size[more], row + 1, where[more]
            for (i, low, high, start, stop), (size, x, y) in zip(own, best.T.tolist()):
                if size:
                    matched[i] += size
                    if x > size and y > size:
                        rest.append((i, low, low + x - size, start, start + y - size))
                    if low + x < high and start + y < stop:
                        rest.append((i, low + x, high, start + y, stop))
        todo = rest
    sizes = np.array([len(a) + len(b) for a, b in zip(*codes)])
    return np.where(sizes > 0, 2 * matched / np.maximum(sizes, 1), 1.0)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; not symmetric, the newer title comes first. Null where a title is."""
    known = left.notna() & right.notna()
    out = pd.Series(np.nan, index=left.index)
    out[known] = ratios(left[known].tolist(), right[known].tolist())
    return out


def normalize_ticker(value: Column) -> Column:
    """Trimmed upper case without leading dollar signs; empty if it is no public ticker."""
    ticker = F.regexp_replace(F.upper(F.trim(F.coalesce(value, F.lit("")))), r"^\$+", "")
    return F.when(ticker.rlike(r"^[A-Z0-9][A-Z0-9.^/_-]{0,19}$"), ticker).otherwise(F.lit(""))


def ticker_list(values: Column, most: int = 100) -> Column:
    """Normalised tickers in order of first appearance, ``most`` at most; null lists are empty."""
    named = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), normalize_ticker), lambda t: t != "")
    return F.slice(F.array_distinct(named), 1, most)


def read_tickers(json: Column) -> Column:
    """The string elements of a JSON list; an empty list for anything else."""
    items = F.from_json(json, "array<string>")
    return F.coalesce(F.filter(items, lambda t: t.isNotNull()), F.array().cast("array<string>"))


def merge_tickers(first: Column, second: Column) -> Column:
    """``first``, then what is new in ``second``, 100 at most."""
    return F.slice(F.array_distinct(F.concat(first, second)), 1, 100)


def safe_url(value: Column) -> Column:
    """A URL without credentials, query and fragment, scheme and host in lower case; its path if it has no host.

    ``<invalid-url>`` where brackets do not hold an address, ``<invalid-host>`` in place of the host where the port is no
    number up to 65535, ``<unknown-endpoint>`` where nothing is left.
    """
    part = lambda text, pattern: F.regexp_extract(text, pattern, 1)
    text = F.regexp_replace(F.regexp_replace(value, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def split(x: Column) -> Column:
        rest = F.substring(x["text"], F.when(x["scheme"] == "", 1).otherwise(F.length(x["scheme"]) + 2), F.length(x["text"]))
        return F.struct(F.lower(x["scheme"]).alias("scheme"), part(rest, r"^//([^/?#]*)").alias("netloc"), part(rest, r"^(?://[^/?#]*)?([^?#]*)").alias("path"))

    def placed(x: Column) -> Column:
        place, open_ = part(x["netloc"], r"([^@]*)$"), F.contains(x["netloc"], F.lit("["))
        boxed = part(place, r"^\[([^\[\]]*)\](?::.*)?$")
        port = F.when(open_, part(place, r"\]:(.*)$")).otherwise(part(place, r"^[^:]*:(.*)$"))
        address = boxed.rlike(r"^(?=.*:.*:)[0-9A-Fa-f:.]+(%.*)?$") | boxed.rlike(r"^v[0-9A-Fa-f]+\..+$")
        wrong = (open_ != F.contains(x["netloc"], F.lit("]"))) | (open_ & ~address)
        return F.struct(x["scheme"].alias("scheme"), x["netloc"].alias("netloc"), x["path"].alias("path"), F.when(open_, boxed).otherwise(part(place, r"^([^:]*)")).alias("name"), port.alias("port"), wrong.alias("wrong"))

    def written(x: Column) -> Column:
        name = F.concat(F.lower(part(x["name"], r"^([^%]*)")), part(x["name"], r"(%.*)$"))
        number = F.when(x["port"].rlike(r"^0*[0-9]{1,5}$"), x["port"].cast("bigint"))
        host = F.concat(F.when(F.contains(x["name"], F.lit(":")), F.concat(F.lit("["), name, F.lit("]"))).otherwise(name), F.when(F.coalesce(number, F.lit(0)) > 0, F.concat(F.lit(":"), number.cast("string"))).otherwise(""))
        host = F.when((x["port"] != "") & (number.isNull() | (number > 65_535)), "<invalid-host>").otherwise(host)
        slashes = F.when((x["name"] != "") | (x["port"] != "") | x["scheme"].isin(*uses_netloc) | F.startswith(x["path"], F.lit("//")), "://").otherwise(":")
        whole = F.when((x["scheme"] != "") & (x["netloc"] != ""), F.concat(x["scheme"], slashes, host, x["path"])).otherwise(F.coalesce(F.nullif(x["path"], F.lit("")), F.lit("<unknown-endpoint>")))
        return F.when(x["wrong"], "<invalid-url>").otherwise(whole)

    first = F.struct(text.alias("text"), part(text, r"^([A-Za-z][A-Za-z0-9+.-]*):").alias("scheme"))
    return F.when(value.isNotNull(), let(let(let(first, split), placed), written))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def redact(value: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Literal secrets, URL queries and credentials, bearer tokens and key=value secrets taken out of a text."""
    for secret in filter(None, secrets):
        value = F.replace(value, F.lit(secret), F.lit("[REDACTED]"))
    bare = F.regexp_replace(value, _URL, "$1$2")
    return F.regexp_replace(F.regexp_replace(bare, BEARER, "Bearer [REDACTED]"), SECRET_FIELD, "$1=[REDACTED]")


def safe_message(kind: Column, message: Column, status: Column, url: Column, secrets: tuple[str, ...] = ()) -> Column:
    """What may be shown of an error: the HTTP status or the kind of error with the bare endpoint where a request failed,
    else kind and message, redacted."""
    endpoint = safe_url(url)
    return F.when(status.isNotNull(), F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" at "), endpoint)).when(url.isNotNull(), F.concat(kind, F.lit(" at "), endpoint)).otherwise(redact(F.concat(kind, F.lit(": "), message), secrets))
