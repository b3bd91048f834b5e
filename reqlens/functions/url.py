"""Tolerant URL splitting and decoding as column expressions.

``parse_url`` raises on attack-like targets and ``try_parse_url`` returns null
for them, so the parts are cut with regular expressions that accept any text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reqlens.functions.binding import let

SCHEME_AND_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"


def cleaned(uri: Column) -> Column:
    """The target as a tolerant parser takes it: leading blanks and controls go, and tabs and line ends anywhere."""
    return F.regexp_replace(F.regexp_replace(uri, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def without_authority(uri: Column) -> Column:
    """Drop ``scheme:`` and ``//authority``; an origin-form target is unchanged."""
    return F.regexp_replace(uri, SCHEME_AND_AUTHORITY, "")


def path_of(uri: Column, drop_params: bool = True) -> Column:
    """Path part; ``;params`` of the last segment are cut unless told otherwise."""
    path = F.regexp_extract(without_authority(uri), r"^[^?#]*", 0)
    return F.regexp_replace(path, r";[^/]*$", "") if drop_params else path


def query_of(uri: Column) -> Column:
    """Raw query part, without the fragment; empty when there is none."""
    return F.regexp_extract(without_authority(uri), r"^[^?#]*\?([^#]*)", 1)


def authority_of(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def decode(text: Column) -> Column:
    """Percent-decode with ``+`` as space; malformed escapes stay as they are."""
    return F.url_decode(F.regexp_replace(text, BAD_ESCAPE, "%25"))


def decode_path(text: Column) -> Column:
    """Percent-decode where ``+`` is an ordinary character."""
    return decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def pieces_of(query: Column) -> Column:
    """The form pairs as they stand, without empty ones."""
    return F.filter(F.split(query, "&"), lambda p: p != "")


def key_of(piece: Column) -> Column:
    return decode(F.substring_index(piece, "=", 1))


def value_of(piece: Column) -> Column:
    return decode(F.when(piece.contains("="), F.regexp_replace(piece, r"^[^=]*=", "")).otherwise(""))


def param_pairs(query: Column, keep_blank: bool = True) -> Column:
    """``ARRAY<STRUCT<k,v>>`` of decoded form pairs, in order of appearance."""
    pieces = pieces_of(query)
    if not keep_blank:
        pieces = F.filter(pieces, lambda p: p.rlike(r"(?s)^[^=]*=."))
    return F.transform(pieces, lambda p: F.struct(key_of(p).alias("k"), value_of(p).alias("v")))


def first_values(pairs: Column) -> Column:
    """Pairs reduced to the first value of each key, order kept."""

    def firsts(ps: Column) -> Column:
        return let(
            F.transform(ps, lambda p: p["k"]),
            lambda keys: F.filter(ps, lambda p, i: F.array_position(keys, p["k"]) == i + 1),
        )

    return let(pairs, firsts)


def strict_pairs(query: Column) -> Column:
    """Pairs without those a strict parser rejects (bad escapes, semicolons)."""
    pieces = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~p.contains(";") & ~p.rlike(BAD_ESCAPE),
    )
    return param_pairs(F.array_join(pieces, "&"))


def is_strict_query(query: Column) -> Column:
    return ~query.contains(";") & ~query.rlike(BAD_ESCAPE)


def is_strict_uri(uri: Column) -> Column:
    """Whether a strict URL parser accepts the target: no control characters, no bad path escape."""
    return ~uri.rlike(r"[\x00-\x1f\x7f]") & ~path_of(uri, drop_params=False).rlike(BAD_ESCAPE)
