"""Words of byte-level vocabularies: normalisation and pre-tokenization."""

from __future__ import annotations

import re
import unicodedata

import regex

# --- Fixed values: the patterns of the vocabulary's pre-tokenizer and of white space ---

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"{_ENDINGS}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")

# --- End of fixed values ---

# The same for texts of the first 256 characters.
_LETTERS, _NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
WORDS_LATIN = re.compile(rf"{_ENDINGS}|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable in Latin-1,
    else the next free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def has_known_patterns(spec: dict) -> bool:
    """Whether a parsed vocabulary file splits and folds texts as this module does."""
    splitter = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    return (
        spec["model"]["type"] == "BPE"
        and not spec["model"].get("byte_fallback")
        and splitter.get("pattern") == {"Regex": PATTERN}
        and kinds == ["NFC", "Replace", "Lowercase"]
    )


def split_words(text: str) -> list[str]:
    """Words of a text without special tokens: composed, in lower case, without white space."""
    try:
        text.encode("latin-1")
        return WORDS_LATIN.findall(text.lower())
    except UnicodeEncodeError:
        # Case is folded character by character: a sigma at a word's end is like any other.
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
