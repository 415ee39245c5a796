"""Whole-word phrase matching, text folding, contact redaction and opener checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalsieve.config import OPENER_WORD_LIMIT
from signalsieve.functions.numbers import _col, once

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
# Whole numbers only: a part of a longer run of digits is no phone number.
PHONE = (
    r"\+[0-9]{1,3}([ .-]?\(?[0-9]{2,5}\)?){2,5}\b"
    r"|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}\b"
    r"|\b[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}\b"
    r"|\b[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{4}\b"
    r"|\b[0-9]{3}-[0-9]{4}\b"
)
ADDRESS = (
    r"\b[0-9]{1,5} (([A-Z][A-Za-z]+ ){1,4}"
    r"(Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|St|Ave|Rd|Ln|Dr|Blvd)"
    r"|[A-Za-z]+ (street|avenue|road|lane|boulevard))\b\.?"
)
CONTACT_PATTERNS = (("email", EMAIL), ("phone", PHONE), ("address", ADDRESS))
_SENT_CLAIM = (
    r"(?i)(message|email|e-mail|opener|dm) (was|has been|is) sent"
    r"|(i|we) (have |already )*(sent|messaged|emailed|contacted) (you|them|him|her)"
)


def _words_of_lower(lowered: Column) -> Column:
    dotted = F.regexp_replace(lowered, r"[^\p{L}\p{M}\p{N}\p{Z}\s_-]+", " . ")
    return F.regexp_replace(F.concat(F.lit(" "), dotted, F.lit(" ")), r"[\p{Z}\s_-]+", " ")


def words_of(text: Column | str) -> Column:
    """Lower-cased words joined by single spaces, with a space at both ends.

    Letters and digits of any script make words. White space, hyphens and underscores
    separate them; every other run of characters becomes a lone ``.`` word, so a phrase
    cannot match across the end of a sentence.
    """
    return _words_of_lower(F.lower(F.coalesce(_col(text), F.lit(""))))


def words_if(text: Column | str, worth_it: Callable[[Column], Column]) -> Column:
    """:func:`words_of`, or a lone space when ``worth_it(lower-cased text)`` is false.

    Splitting into words costs far more than a substring test. Words are parts of the
    lower-cased text, so a text without the letters of a phrase cannot contain the phrase.
    """
    return once(
        F.lower(F.coalesce(_col(text), F.lit(""))),
        lambda low: F.when(worth_it(low), _words_of_lower(low)).otherwise(F.lit(" ")),
    )


def phrase_words(phrase: str) -> list[str]:
    """Pieces of a phrase that have to occur in a lower-cased text with that phrase.

    ASCII pieces only: their lower case is the same in Python and in Spark.
    """
    return [piece for piece in re.findall(r"[^\W_]+", phrase.lower()) if piece.isascii()]


def may_have_any(phrases: Iterable[str]) -> Callable[[Column], Column]:
    """Necessary substring test for any of ``phrases``, to use with :func:`words_if`."""
    needed = dict.fromkeys(tuple(phrase_words(p)) for p in phrases)

    def test(low: Column) -> Column:
        found = F.lit(False)
        for pieces in needed:
            all_in = F.lit(True)
            for piece in pieces:
                all_in = all_in & F.contains(low, F.lit(piece))
            found = found | all_in
        return found

    return test


def has_phrase(words: Column, phrase: Column | str) -> Column:
    """Whole-word containment of ``phrase`` in the result of :func:`words_of`."""
    wanted = words_of(F.lit(phrase) if isinstance(phrase, str) else phrase)
    return (F.length(F.trim(wanted)) > 0) & F.contains(words, wanted)


def has_any_phrase(text: Column | str, phrases: Sequence[str]) -> Column:
    """Whole-word containment of at least one of ``phrases`` in a text."""

    def any_of(words: Column) -> Column:
        found = F.lit(False)
        for phrase in phrases:
            found = found | has_phrase(words, phrase)
        return found

    return once(words_if(text, may_have_any(phrases)), any_of)


# White space as RE2 has it: a vertical tab is none.
_NOT_BLANK = r"[^\t\n\f\r\p{Z}]"


def is_blank(text: Column | str) -> Column:
    """True without a visible character; never NULL. Stops at the first one."""
    return ~F.coalesce(_col(text).rlike(_NOT_BLANK), F.lit(False))


def fold_text(text: Column | str) -> Column:
    """Text with white space collapsed and case folded, letter by letter; NULL when nothing is left."""
    raw = _col(text)
    # The two letters that Spark lowers to two letters, or by what stands around them.
    alone = F.replace(F.replace(raw, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ"))
    alone = F.when(F.contains(raw, F.lit("İ")) | F.contains(raw, F.lit("Σ")), alone).otherwise(raw)
    return F.when(
        raw.rlike(_NOT_BLANK), F.trim(F.regexp_replace(F.lower(alone), r"[\t\n\f\r\p{Z}]+", " "))
    )


def text_key(text: Column | str) -> Column:
    return F.sha2(fold_text(text), 256)


def name_key(name: Column | str) -> Column:
    """Normal form of a displayed company or person name; NULL when empty."""
    folded = F.trim(F.regexp_replace(F.lower(_col(name)), r"[^\p{L}\p{M}\p{N}]+", " "))
    return once(folded, lambda f: F.when(f != "", f))


def _may_hold(kind: str, text: Column) -> Column:
    """Cheap test that spares texts without the needed characters the full pattern."""
    return F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9]")


def contact_flags(text: Column | str) -> Column:
    """Kinds of private contact data found in ``text``, as an array of names."""
    raw = _col(text)
    flags = [
        F.when(_may_hold(kind, raw) & raw.rlike(pattern), F.lit(kind))
        for kind, pattern in CONTACT_PATTERNS
    ]
    return F.array_compact(F.array(*flags))


def redact_contacts(text: Column | str) -> Column:
    """``text`` with e-mail addresses, phone numbers and street addresses masked."""
    raw = _col(text)
    no_email = F.when(_may_hold("email", raw), F.regexp_replace(raw, EMAIL, "[email]")).otherwise(
        raw
    )
    no_digits_left = F.regexp_replace(
        F.regexp_replace(no_email, PHONE, "[phone]"), ADDRESS, "[address]"
    )
    return F.when(_may_hold("phone", raw), no_digits_left).otherwise(no_email)


def word_count(text: Column | str) -> Column:
    parts = F.split(F.coalesce(_col(text), F.lit("")), r"[\s\p{Z}]+")
    return F.size(F.filter(parts, lambda w: w != ""))


def question_count(text: Column | str) -> Column:
    raw = F.coalesce(_col(text), F.lit(""))
    return F.length(raw) - F.length(F.replace(raw, F.lit("?"), F.lit("")))


def opener_problems(text: Column | str) -> Column:
    """Names of the opener rules ``text`` breaks, as an array."""
    raw = F.coalesce(_col(text), F.lit(""))
    checks = [
        F.when(word_count(raw) >= OPENER_WORD_LIMIT, F.lit("too_long")),
        F.when(F.size(contact_flags(raw)) > 0, F.lit("contact_data")),
        F.when(raw.rlike(_SENT_CLAIM), F.lit("claims_sent")),
        F.when(question_count(raw) != 1, F.lit("not_one_question")),
    ]
    return F.array_compact(F.array(*checks))
