"""The original behind a page: what pages declare about themselves, followed to its end.

A page may name its original (a canonical link) or send readers on (a refresh). Such pointers form chains and,
where pages are wrong, cycles. They are followed by pointer jumping: every round each page takes over
the pointer of the page it points to, so a chain of any length ends after the logarithm of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.functions.numbers import once
from signalsieve.functions.urls import url_key
from signalsieve.operators.columns import compute_once
from signalsieve.operators.skew import stable

# An attribute's value with or without quotes.
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_COMMENTS = r"(?s)<!--.*?-->|<script\b.*?</script\s*>"
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
ROUNDS = 60


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?i)\s{name}{_VALUE}"
    found = once(tag, lambda t: F.concat(*(F.coalesce(F.regexp_extract(t, pattern, k), F.lit("")) for k in (1, 2, 3))))
    for entity, character in _ENTITIES:
        found = F.replace(found, F.lit(entity), F.lit(character))
    return F.trim(found)


def resolved_url(link: Column, base: Column) -> Column:
    """The absolute URL of a link on the page ``base``; NULL for an empty one.

    Absolute, host-relative, path-relative, query and fragment links are known; ``.`` and ``..`` are not folded.
    """
    scheme = F.regexp_extract(base, r"(?i)^(https?:)", 1)
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    directory = F.when(F.length(page) > F.length(root), F.regexp_replace(page, r"[^/]*$", "")).otherwise(F.concat(root, F.lit("/")))
    return once(
        link,
        lambda to: F.when(to == "", F.lit(None))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), to)
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?") | to.startswith("#"), F.concat(page, to))
        .otherwise(F.concat(directory, to)),
    )


def declared_original(html: Column | str, url: Column | str) -> Column:
    """The URL a page names as its original: its canonical link, else where its refresh leads; NULL for none."""
    html = F.col(html) if isinstance(html, str) else html
    url = F.col(url) if isinstance(url, str) else url

    def found(plain: Column) -> Column:
        links = F.filter(F.regexp_extract_all(plain, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: F.lower(_attribute(t, "rel")) == "canonical")
        metas = F.regexp_extract_all(plain, F.lit(r"(?is)<meta\b[^>]*>"), 0)
        refresh = F.filter(metas, lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
        ahead = F.regexp_extract(_attribute(F.get(refresh, 0), "content"), r"""(?i)^[\d.]*\s*[;,]\s*url\s*=\s*['"]?([^'"]*)""", 1)
        return F.coalesce(resolved_url(_attribute(F.get(links, 0), "href"), url), resolved_url(ahead, url))

    # Most pages have neither tag; a search for the words spares them the patterns.
    hinted = once(F.lower(html), lambda low: low.contains("canonical") | low.contains("refresh"))
    return F.when(hinted, once(F.regexp_replace(html, _COMMENTS, ""), found))


def follow_pointers(pointers: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(page, original, cyclic) for ``pointers`` (page, target), one per page; targets are pages as well.

    A page without a pointer, or with one to itself, is its own original. Pages on a cycle and those that lead
    into one have its least page. Pages that have arrived take no part in later rounds, so a root
    to which a third of all pages lead is joined once.
    """
    first, second = pointers.columns[:2]
    named = pointers.select(F.col(first).alias("page"), F.col(second).alias("ptr")).filter("page is not null")
    given = named.filter("ptr is not null").groupBy("page").agg(F.min("ptr").alias("ptr"))
    pages = named.select("page").unionByName(given.select(F.col("ptr").alias("page"))).distinct()
    known = pages.join(given, "page", "left").select("page", F.coalesce("ptr", "page").alias("ptr"))
    state = stable(known.select("page", "ptr", F.least("page", "ptr").alias("least"), (F.col("page") == F.col("ptr")).alias("done")))
    for step in range(rounds):
        open_ = state.filter("NOT done").count()
        # After 2^step steps over fewer open pages, all that are still open have reached a cycle.
        if not open_ or 2**step > 2 * open_:
            break
        ahead = state.select(F.col("page").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("least").alias("_least"), F.col("done").alias("_done"))
        moved = state.filter("NOT done").join(ahead, "ptr").select("page", F.col("_ptr").alias("ptr"), F.least("least", "_least").alias("least"), F.col("_done").alias("done"))
        state = stable(state.filter("done").unionByName(moved))
    else:
        raise RuntimeError(f"pointers did not settle in {rounds} rounds")
    arrived = state.filter("done").select("page", F.col("ptr").alias("original"), F.lit(False).alias("cyclic"))
    # A page's own steps may begin outside the cycle; those of the page it has reached lie on it.
    on_cycle = state.filter("NOT done").select(F.col("page").alias("ptr"), F.col("least").alias("original"))
    circling = state.filter("NOT done").select("page", "ptr").join(on_cycle, "ptr").select("page", "original", F.lit(True).alias("cyclic"))
    return arrived.unionByName(circling)


def page_originals(pages: DataFrame, url: str = "source_url", html: str = "text") -> DataFrame:
    """(page, original, cyclic) by URL keys for all ``pages`` with a valid URL and all pages they name."""
    declared = compute_once(pages.select(url, html), _declared=declared_original(html, url))
    # Pointers are read several times, pages once.
    return follow_pointers(stable(declared.select(url_key(url).alias("page"), url_key("_declared").alias("target"))))


def with_original(signals: DataFrame, originals: DataFrame, url: str = "source_url") -> DataFrame:
    """``signals`` with ``original``, the key of the page behind each URL; of an unknown page its own."""
    looked_up = originals.select(F.col("page").alias("_page"), F.col("original"))
    keyed = signals.withColumn("_page", url_key(url))
    return keyed.join(looked_up, "_page", "left").withColumn("original", F.coalesce("original", "_page")).drop("_page")
