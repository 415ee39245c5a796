"""URL validity, normal form and host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalsieve.functions.numbers import _col

# http or https, then a host part: a bracketed IPv6 literal or anything up to / ? #.
_VALID = r"(?i)^https?://(\[[0-9a-f:.]+\]|[^/?#\[\]]+)[^/?#\[\]]*([/?#]|$)"
# The common case, without blanks, brackets or anything beyond ASCII.
_PLAIN = r"^https?://[A-Za-z0-9][A-Za-z0-9.:-]*([/?#][!-~]*)?$"
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
# Query parameters that say where a visitor came from, not which page is shown.
_TRACKING = r"(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*"


def trim_url(url: Column | str) -> Column:
    return F.regexp_replace(
        F.coalesce(_col(url), F.lit("")), f"^{_BLANK}+|{_BLANK}+$", ""
    )


def has_valid_url(url: Column | str) -> Column:
    """True for an http(s) URL with a host; never NULL."""
    raw = F.coalesce(_col(url), F.lit(""))
    return raw.rlike(_PLAIN) | F.translate(trim_url(raw), "\t\r\n", "").rlike(_VALID)


def safe_url(url: Column | str) -> Column:
    """The trimmed URL if valid, else ``#``."""
    return F.when(has_valid_url(url), trim_url(url)).otherwise(F.lit("#"))


def url_host(url: Column | str) -> Column:
    """Lower-case host without port, user part, ``www.`` or ``m.``; NULL for an invalid URL.

    A first label stays where only one other would be left: ``m.com`` is a host of its own.
    """
    authority = F.regexp_extract(F.lower(trim_url(url)), r"^https?://([^/?#]*)", 1)
    no_user = F.regexp_replace(authority, r"^.*@", "")
    no_port = F.regexp_replace(no_user, r":[0-9]*$", "")
    return F.when(has_valid_url(url), F.regexp_replace(no_port, r"^(www|m)\.(?=[^.]+\.)", ""))


def url_key(url: Column | str) -> Column:
    """Identity of the page behind a URL; NULL for an invalid URL.

    Scheme, ``www.``/``m.``, fragment, tracking parameters and a trailing slash do not
    count. Path case and all other parameters do.
    """
    trimmed = trim_url(url)
    rest = F.regexp_extract(trimmed, r"(?i)^https?://[^/?#]*([^#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), r"^&+", "")
    return F.when(
        has_valid_url(url),
        F.concat(
            url_host(url), path, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))
        ),
    )
