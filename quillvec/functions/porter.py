"""The suffix stripper published by M. F. Porter in 1980."""

from __future__ import annotations

# Suffixes and what replaces them, in the order of the published steps.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _is_consonant(word: str, i: int) -> bool:
    c = word[i]
    if c in "aeiou":
        return False
    return c != "y" or i == 0 or not _is_consonant(word, i - 1)


def _measure(part: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [_is_consonant(part, i) for i in range(len(part))]
    return sum(b and not a for a, b in zip(kinds, kinds[1:]))


def _has_vowel(part: str) -> bool:
    return any(not _is_consonant(part, i) for i in range(len(part)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _is_consonant(word, len(word) - 1)


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last one no w, x or y."""
    n = len(word)
    return n > 2 and _is_consonant(word, n - 3) and not _is_consonant(word, n - 2) and _is_consonant(word, n - 1) and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            return left + table[suffix] if _measure(left) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((len(s) for s in ("ed", "ing") if word.endswith(s)), 0)
        if cut and _has_vowel(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP_2)
    word = _replace(word, STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            if _measure(left) > 1 and (suffix != "ion" or left.endswith(("s", "t"))):
                word = left
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
