"""Joining of text lines: words that a hyphen cuts, scripts without spaces.

Which hyphens belong to a word is a table of pairs, by language: what stands before the
hyphen, and what follows it. Everything else is a word that was cut.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .rows import changed, mapped

_LETTER, _END = r"[\p{L}\p{M}]", r"(?![\p{L}\p{M}])"
#: Portuguese pronouns after a verb, after a verb that lost its last consonant, and after a gerund.
PRONOUNS, AFTER_VOWEL, AFTER_GERUND = "se me te lhe nos".split(), "lo la los las".split(), "os as o a".split()
#: Portuguese prefixes with a hyphen, and those with one only before h or their own last vowel.
PREFIXES, VOWEL_PREFIXES = "guarda pós pré vice recém".split(), "auto anti".split()
#: Words that may follow a suspended hyphen.
SUSPENDED = "ou nem ni and or et und oder или".split()
#: Russian question words and their first parts before -то, -либо and -нибудь; words before -таки; ends before -ка.
RU_QUESTIONS, RU_STEMS = "кто что где куда откуда как когда почему зачем чей чья чьё чьи сколько кого кому кем ком чего чему чем".split(), "как чь".split()
RU_INDEFINITE, RU_STILL, RU_IMPERATIVE = "то либо нибудь".split(), "всё все так опять довольно верно".split(), "й и ите йте".split()
#: Ends of Russian words after по-, and words after из-.
RU_MANNER, RU_FROM = "ски цки ому ему ьи".split(), "за под".split()
#: Scripts that are written without spaces, with their punctuation and full-width forms.
WIDE = r"[\p{Han}\p{Hiragana}\p{Katakana}　-〿＀-￯]"


def _any(words: list[str]) -> str:
    return f"(?:{'|'.join(words)})"


def _table(*pairs: tuple[str, str]) -> regex.Pattern:
    single = (_LETTER, "")  # hyphenation leaves two letters at least before the break
    return regex.compile("|".join(f"(?:{before})-(?:{after})" for before, after in (single, *pairs)))


_ACCENT = "[áâéêíóô]"
BELONGS = {
    "": _table(),
    "pt": _table(
        (f"(?={_LETTER}{{3}}|{_LETTER}*{_ACCENT}){_LETTER}+", _any(PRONOUNS) + _END), (f"{_LETTER}*(?:{_ACCENT}|i|mo)", _any(AFTER_VOWEL) + _END), (f"{_LETTER}*ndo", _any(AFTER_GERUND) + _END),
        (_any(PREFIXES), ""), *((x, f"[h{x[-1]}]") for x in VOWEL_PREFIXES),
    ),
    "ru": _table(
        (_any([*RU_QUESTIONS, *(f"{x}{_LETTER}+" for x in RU_STEMS)]), _any(RU_INDEFINITE) + _END), (_any(RU_STILL), "таки" + _END), (f"{_LETTER}+{_any(RU_IMPERATIVE)}", "ка" + _END),
        ("по", rf"\p{{L}}*{_any(RU_MANNER)}{_END}"), ("из", _any(RU_FROM) + _END),
    ),
}
#: From the right: the letters that end somewhere.
_LETTERS_BEFORE = regex.compile(rf"(?r){_LETTER}+")
_WORD_AND_ONE = regex.compile(rf"(?s){_LETTER}*+.?")
_BETWEEN_WIDE = regex.compile(rf"{WIDE}\n{WIDE}")
_CUT_INSIDE = regex.compile(rf"-[ \t]++(?!{_any(SUSPENDED)}{_END})(?=\p{{Ll}}[\p{{Ll}}\p{{M}}]|[oa]{_END})")
_ONE_VOWEL = regex.compile(f"[oa]{_END}")


def belongs(word: str, after: str, lang: str) -> bool:
    """Whether the hyphen between a word and the text after it is part of the word."""
    return BELONGS.get(lang, BELONGS[""]).match(f"{word.lower()}-{after}") is not None


def _cut_word(line: str, end: int) -> str:
    """The letters of ``line`` that end at ``end``."""
    found = _LETTERS_BEFORE.match(line, 0, end)
    return found[0] if found else ""


def join_two(before: str, after: str, lang: str) -> str:
    """Two lines of one paragraph on one line."""
    if _BETWEEN_WIDE.fullmatch(f"{before[-1:]}\n{after[:1]}"):
        return before + after
    cut, first = before.endswith("-") and _cut_word(before, len(before) - 1), after[:1]
    if not cut or not (first.isupper() or first.islower()):
        return f"{before} {after}"
    return (before if first.isupper() or belongs(cut, after, lang) else before[:-1]) + after


def mend(line: str, lang: str) -> str:
    """Words that a hyphen and a space cut within a line are joined; suspended hyphens stay.

    Of what stands behind a hyphen only the next word is read, so that a long line takes no more for each hyphen than a short one.
    """
    if "- " not in line and "-\t" not in line:
        return line
    out, at = [], 0
    for m in _CUT_INSIDE.finditer(line):
        word = _cut_word(line, m.start())
        if not word or (_ONE_VOWEL.match(line, m.end()) and not (lang == "pt" and word.endswith("ndo"))):
            continue
        after = _WORD_AND_ONE.match(line, m.end())[0]
        out += [line[at : m.start()], "-" * belongs(word, after, lang)]
        at = m.end()
    return "".join([*out, line[at:]])


@F.arrow_udf(StringType())
def join_lines(before: pa.Array, after: pa.Array, lang: pa.Array) -> pa.Array:
    """Column of joined lines; null where one of them is null."""
    return mapped(lambda a, b, c: None if a is None or b is None else join_two(a, b, c or ""), before, after, lang)


def _mended(line: str | None, lang: str | None) -> str | None:
    return None if line is None else mend(line, lang or "")


@F.arrow_udf(StringType())
def join_cut_words(line: pa.Array, lang: pa.Array) -> pa.Array:
    """Column of lines with the words joined that a hyphen cuts inside them."""
    return mapped(_mended, line, lang)


def with_cut_words_joined(texts: DataFrame) -> DataFrame:
    """Texts (text, lang) with ``join_cut_words`` done; for long texts, since results go back slice by slice and not as a batch of 10,000 rows."""
    return changed(texts, "text", ["text", "lang"], _mended)
