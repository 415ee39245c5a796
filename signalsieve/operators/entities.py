"""One company or person under different names, sites and handles.

Profiles are brought together by several keys: site, handle, name, a name that is another profile's handle
or site, and names within one edit. Pairs that share a key are scored field by field, and pairs
that score high enough are merged transitively. Equal profiles are one before any pair is made.

A key that more than ``block`` different profiles share (a platform's site, "Admin") tells no two of
them apart from the rest. Such a hot block is split by the profiles' other hot keys, all subsets of
them, and a pair in it is looked at where all it shares is rare enough. So no block gives more
than ``block`` pairs a profile, and a pair left out shares nothing that few others have.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.operators.graph import connected
from signalsieve.operators.skew import heavy_first_join, salted_join, stable

# --- Fixed values: words of a name that only state a legal form ---

LEGAL_FORMS = (
    "ab", "ag", "as", "bv", "co", "company", "corp", "corporation", "gmbh", "inc", "incorporated", "kg", "limited", "llc", "llp",
    "ltd", "nv", "oy", "plc", "sa", "sarl", "spa", "srl", "the",
)

# --- End of fixed values ---

FIELDS = ["name", "handle", "site"]
#: Weight of each field's agreement in a pair's score.
NAME, HANDLE, SITE, ALIAS = 0.5, 0.3, 0.2, 0.4
#: Least score of a merged pair.
THRESHOLD = 0.65
#: Most different profiles of a key that tells them apart.
BLOCK = 50
#: Shortest name that one edit may change.
EDITABLE = 8


def name_words(name: Column | str) -> Column:
    """A name's words of letters and digits in lower case, without legal forms."""
    words = F.split(F.lower(F.col(name) if isinstance(name, str) else name), r"[^\p{L}\p{N}]+")
    telling = F.filter(words, lambda w: (w != "") & ~w.isin(*LEGAL_FORMS))
    # A name of nothing but legal forms keeps them.
    return F.when(F.size(telling) > 0, telling).otherwise(F.array_remove(words, ""))


def plain_name(name: Column | str) -> Column:
    """The letters and digits of a name's words in their order; NULL for none."""
    return F.nullif(F.array_join(name_words(name), ""), F.lit(""))


def sorted_name(name: Column | str) -> Column:
    """The same with the words in order of the alphabet."""
    return F.nullif(F.array_join(F.array_sort(name_words(name)), ""), F.lit(""))


def plain_handle(handle: Column | str) -> Column:
    """Letters and digits of a handle; NULL for none."""
    value = F.lower(F.col(handle) if isinstance(handle, str) else handle)
    return F.nullif(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""), F.lit(""))


def site_of(host: Column | str, shared_sites: Sequence[str] = ()) -> Column:
    """The site of a host: its last two labels, three below a country's second level such as co.uk.

    NULL for no host and for ``shared_sites``, platforms that many entities use.
    """
    value = F.lower(F.trim(F.col(host) if isinstance(host, str) else host))
    site = F.regexp_extract(value, r"([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]+))\.?$", 1)
    return F.when(~site.isin("", *shared_sites), site)


def _normal_forms(profiles: DataFrame, shared_sites: Sequence[str]) -> DataFrame:
    """Profiles in plain form, and a text that equal ones share."""
    columns = set(profiles.columns)
    of = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    return (
        profiles.select(
            F.col("profile_id").cast("long").alias("profile_id"),
            plain_name(of("name")).alias("name"),
            sorted_name(of("name")).alias("sorted"),
            plain_handle(of("handle")).alias("handle"),
            site_of(of("host"), shared_sites).alias("site"),
        )
        .withColumn("label", plain_handle(F.substring_index("site", ".", 1)))
        .withColumn("same", F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in (*FIELDS, "sorted"))))
    )


def _keys() -> tuple[Column, Column]:
    """Exact keys of a form and keys of its name within one edit, as hashes."""

    def key(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.xxhash64(F.lit(kind), value))

    name = F.col("name")
    # A name, a handle and a site's label meet in one space, so that one profile's name finds another's handle.
    exact = [key("site", F.col("site")), *(key("word", F.col(c)) for c in ("name", "sorted", "handle", "label"))]

    def edited(value: Column) -> Column:
        shorter = F.transform(
            F.sequence(F.lit(1), F.length(value)),
            lambda i: F.concat(F.substring(value, F.lit(1), i - 1), F.substring(value, i + 1, F.length(value))),
        )
        return F.transform(F.array_append(shorter, value), lambda v: F.xxhash64(F.lit("edit"), v))

    edits = F.array_distinct(F.concat(edited(name), edited(F.col("sorted"))))
    near = F.when(F.length(name) >= EDITABLE, edits).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.array_compact(F.array(*exact))), near


def _members(keyed: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (form, key) of keys with 2 to ``block`` forms, and those of hotter keys."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    sized = salted_join(keyed, sizes, ["key"])
    return sized.filter(F.col("size") <= block), sized.filter(F.col("size") > block)


def _subsets(keys: Column) -> Column:
    """A hash of every subset of two or more of at most five keys."""
    chosen = []
    for n in (2, 3, 4, 5):
        for places in combinations(range(5), n):
            picked = [F.get(keys, F.lit(i)) for i in places]
            chosen.append(F.when(F.size(keys) > places[-1], F.xxhash64(*picked)))
    return F.array_compact(F.array(*chosen))


def candidate_pairs(forms: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of forms, a below b, that share a key or keys which at most ``block`` forms have."""
    exact, near = _keys()
    keyed = stable(
        forms.select("form", exact.alias("_exact"), near.alias("_near")).select(
            "form", F.explode(F.concat("_exact", "_near")).alias("key"), F.array_contains("_exact", F.col("key")).alias("exact")
        )
    )
    small, hot = _members(keyed, block)
    together = hot.filter("exact").groupBy("form").agg(F.array_sort(F.collect_set("key")).alias("_keys"))
    subsets = together.select("form", F.explode(_subsets(F.col("_keys"))).alias("key"))
    split, _ = _members(stable(subsets), block)
    rows = stable(small.select("form", "key").unionByName(split.select("form", "key")))
    left, right = rows.withColumnRenamed("form", "a"), rows.withColumnRenamed("form", "b")
    return left.join(right, "key").filter("a < b").select("a", "b").distinct()


def pair_score() -> Column:
    """Weighted share of the fields that agree among those that both profiles have.

    Names count by their edit distance, in their own order or sorted, whichever is nearer, and not at all where their digits differ. An alias (a name that is
    the other's handle or site) only speaks for a pair.
    """
    agree = lambda c: F.when(F.col(f"x.{c}").isNotNull() & F.col(f"y.{c}").isNotNull(), (F.col(f"x.{c}") == F.col(f"y.{c}")).cast("double"))
    x, y = F.col("x.name"), F.col("y.name")
    digits = lambda c: F.regexp_replace(c, r"[^\p{N}]", "")
    alike = lambda p, q: 1 - F.levenshtein(p, q) / F.greatest(F.length(p), F.length(q))
    near = F.greatest(alike(x, y), alike(F.col("x.sorted"), F.col("y.sorted")))
    names = F.when(x.isNotNull() & y.isNotNull(), F.when(digits(x) == digits(y), near).otherwise(0.0))
    crossed = [("name", "handle"), ("name", "label"), ("handle", "label")]
    alias = F.lit(False)
    for one, other in crossed:
        for p, q in ((one, other), (other, one)):
            alias = alias | F.coalesce(F.col(f"x.{p}") == F.col(f"y.{q}"), F.lit(False))
    parts = [(NAME, names), (HANDLE, agree("handle")), (SITE, agree("site")), (ALIAS, F.when(alias, 1.0))]
    total = sum((F.coalesce(value * weight, F.lit(0.0)) for weight, value in parts), F.lit(0.0))
    seen = sum((F.when(value.isNotNull(), weight).otherwise(0.0) for weight, value in parts), F.lit(0.0))
    return F.when(seen > 0, total / seen).otherwise(0.0)


def linked_profiles(forms: DataFrame, block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, score) of forms that score ``threshold`` or more."""
    fields = forms.select("form", *FIELDS, "sorted", "label")
    pairs = candidate_pairs(forms, block)
    scored = (
        pairs.join(fields.alias("x"), pairs.a == F.col("x.form"))
        .join(fields.alias("y"), F.col("b") == F.col("y.form"))
        .select("a", "b", pair_score().alias("score"))
    )
    return scored.filter(F.col("score") >= threshold)


def resolve_profiles(
    profiles: DataFrame, shared_sites: Sequence[str] = (), block: int = BLOCK, threshold: float = THRESHOLD
) -> DataFrame:
    """``profile_id`` and ``entity_id``, the least id of the profiles that are one entity.

    ``profiles`` has profile_id and any of name, host and handle; each may be null, and a profile
    without any of them is an entity of its own, as is one that links to no other. Repeated rows
    give a row each.
    """
    plain = stable(_normal_forms(profiles, shared_sites))
    some = plain.filter(F.coalesce(*FIELDS).isNotNull())
    forms = stable(some.groupBy("same", *FIELDS, "sorted", "label").agg(F.min("profile_id").alias("form"), F.count("*").alias("weight")))
    groups = connected(linked_profiles(forms, block, threshold))
    entities = forms.join(groups, forms.form == groups.node, "left").select(
        "same", "weight", F.coalesce("component", "form").alias("entity_id")
    )
    # Equal profiles may be a third of all: the most common ones are looked up, never gathered.
    found = heavy_first_join(plain.select("profile_id", "same"), stable(entities), "same", "entity_id", "weight", "profile_id")
    return found.select("profile_id", F.coalesce("entity_id", "profile_id").alias("entity_id"))


def merge_entities(signals: DataFrame, profiles: DataFrame, **options) -> DataFrame:
    """``signals`` (entity_key of a profile) with the key of the resolved entity, the old one as ``profile_id``."""
    entities = resolve_profiles(profiles, **options)
    keyed = signals.withColumn("profile_id", F.col("entity_key").cast("long")).drop("entity_key")
    joined = keyed.join(entities, "profile_id", "left")
    return joined.withColumn("entity_key", F.coalesce("entity_id", "profile_id")).drop("entity_id")
