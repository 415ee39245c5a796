"""Licence scans with a positional rare-token index.

The index holds, for every licence template, the places of its rarest words, rarest by document
frequency over the whole corpus. Of each file the highest-IDF licence words are looked up; a hit at
file place i on template place p votes for the alignment i - p, and votes of one template meet
where their relative places agree. Aligned templates count once their mandatory key phrases stand
word for word where the alignment puts them. Templates are few, so index and templates are
literals in the plan: apart from the frequencies the scan is one pass without shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.common import full_text, let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """A notice in lower case and the phrases of it that must not be missing."""

    label: str
    text: str
    mandatory: tuple[str, ...]


# --- Fixed values: phrases and labels of the base scan, and licence notices ---

BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

TEMPLATES = (
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("bsd-2", "licensed under the bsd 2 clause license", ("bsd 2 clause",)),
    Template("bsd-3", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("isc", "released under the isc license", ("the isc license",)),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license version 2",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

# --- End of fixed values ---


def license_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all other characters above 7F; A-Z in lower case.

    ``lower`` also folds letters beyond ASCII, which no phrase contains; the two of them whose
    lower case is an ASCII letter are taken out first.
    """
    folded = F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ſ")), F.lit("İ"), F.lit("ſ")))
    return F.array_remove(F.split(folded, SEPARATORS, -1), "")


def _array(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def document_frequency(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many texts each word of ``vocabulary`` occurs; as many rows as it has words."""
    found = docs.select(F.explode(F.array_intersect(_array(sorted(vocabulary)), license_words(full_text()))).alias("word"))
    counts = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def _starts(words: Column, phrase: str) -> Column:
    """Word numbers at which the words of ``phrase`` stand one after the other."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == part)
        return out

    places = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))
    return F.filter(places, lambda i: F.coalesce(here(i), F.lit(False)))


def _start(label: str):
    return lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))


def _index(templates: Sequence[Template], frequency: dict[str, int], anchors: int) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, place) of the ``anchors`` rarest words of each template, among those of
    its mandatory phrases: a file without them is none of its files."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        rare = sorted({w for phrase in template.mandatory for w in phrase.split()}, key=lambda w: (frequency[w], w))[:anchors]
        for place, word in enumerate(template.text.split()):
            if word in rare:
                postings.setdefault(word, []).append((t, place))
    return dict(sorted(postings.items(), key=lambda item: (frequency[item[0]], item[0])))


def _found(words: Column, templates: Sequence[Template], postings: dict[str, list[tuple[int, int]]], agree: int) -> Column:
    """Verified templates in ``words``: array of (label, share of the template's words in place)."""
    index = F.create_map(
        *(
            x
            for word, places in postings.items()
            for x in (F.lit(word), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in places)))
        )
    )
    table = F.array(
        *(
            F.struct(
                F.lit(x.label).alias("label"),
                _array(x.text.split()).alias("words"),
                F.array(
                    *(
                        F.struct(F.lit(_place(x.text, phrase)).alias("p"), _array(phrase.split()).alias("words"))
                        for phrase in x.mandatory
                    )
                ).alias("mandatory"),
            )
            for x in templates
        )
    )
    numbered = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.map_contains_key(index, x["w"])
    )
    votes = F.flatten(
        F.transform(
            numbered,
            lambda x: F.transform(
                index[x["w"]], lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["p"]).alias("at"), p["p"].alias("p"))
            ),
        )
    )

    def agreed(ordered: Column) -> Column:
        def alike(vote: Column, k: Column) -> Column:
            other = F.get(ordered, k)
            return F.coalesce((other["t"] == vote["t"]) & (other["at"] == vote["at"]), F.lit(False))

        # The first vote of each group that is large enough; array_distinct compares all pairs of structs.
        firsts = F.filter(ordered, lambda v, k: alike(v, k + (agree - 1)) & ~alike(v, k - 1))
        return F.transform(firsts, lambda v: F.struct(v["t"].alias("t"), v["at"].alias("at")))

    def verified(hit: Column) -> Column:
        def stands(phrase: Column) -> Column:
            start = hit["at"] + phrase["p"] + 1
            return F.when(start >= 1, F.slice(words, start, F.size(phrase["words"])) == phrase["words"]).otherwise(False)

        return F.forall(F.get(table, hit["t"])["mandatory"], stands)

    def scored(hit: Column) -> Column:
        template = F.get(table, hit["t"])
        in_place = F.filter(template["words"], lambda w, k: F.coalesce(F.get(words, hit["at"] + k) == w, F.lit(False)))
        return F.struct(template["label"].alias("label"), (F.size(in_place) / F.size(template["words"])).alias("share"))

    return let(F.array_sort(votes), lambda ordered: F.transform(F.filter(agreed(ordered), verified), scored))


def _place(text: str, phrase: str) -> int:
    words, part = text.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def scan(
    docs: DataFrame,
    base: Sequence[tuple[str, str]] = BASE_PHRASES,
    templates: Sequence[Template] = TEMPLATES,
    anchors: int = 3,
    agree: int = 2,
) -> DataFrame:
    """Licences named in each text of ``docs`` (doc_id, text).

    Returns doc_id, n_words, base_starts (array of (start, label) of base phrases), found (array
    of (label, share) by the index), base_labels, labels (sorted arrays), score (1 with a base
    label, else the best share). ``anchors`` rare words per template are indexed and ``agree`` of
    them must agree on a place. A null text is empty; an empty text or a table without rows gives
    no labels; repeated rows and places count each. Other columns are not read.
    """
    if not templates or not base:
        raise ValueError("at least one base phrase and one template are needed")
    if agree > anchors or any(len({w for p in t.mandatory for w in p.split()}) < agree for t in templates):
        raise ValueError("a template needs as many rare words as have to agree")
    vocabulary = {w for t in templates for w in t.text.split()}
    frequency = document_frequency(docs, sorted(vocabulary))
    postings = _index(templates, frequency, anchors)
    wanted = _array(list(dict.fromkeys([*postings, *(max(p.split(), key=lambda w: (-frequency.get(w, 0), w)) for p, _ in base)])))
    nothing = F.array()
    labels = lambda *arrays: F.array_sort(F.array_distinct(F.concat(*arrays)))
    names = lambda column: F.transform(column, lambda x: x["label"])

    def read(words: Column) -> Column:
        # Most files have none of the rare words; one hashed test per file spares them the rest.
        near = F.arrays_overlap(words, wanted)
        starts = F.array_sort(F.concat(*(F.transform(_starts(words, phrase), _start(label)) for phrase, label in base)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.when(near, starts).otherwise(nothing.cast("array<struct<start:bigint,label:string>>")).alias("base_starts"),
            F.when(near, _found(words, templates, postings, agree))
            .otherwise(nothing.cast("array<struct<label:string,share:double>>"))
            .alias("found"),
        )

    # The words are bound once, in a generator: a filter on any column of the result stays above it,
    # where it would otherwise put the split into every lambda and do it once per word.
    return (
        docs.select("doc_id", F.inline_outer(F.transform(F.array(license_words(full_text())), read)))
        .withColumn("base_labels", labels(names("base_starts")))
        .withColumn("labels", labels(names("base_starts"), names("found")))
        .withColumn(
            "score",
            F.when(F.size("base_starts") > 0, 1.0).otherwise(
                F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
            ),
        )
    )
