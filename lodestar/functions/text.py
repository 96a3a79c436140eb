"""Text normalisation and key extraction as column expressions.

ASCII text stays in built-in functions; text beyond ASCII goes through one Arrow UDF for what Spark's
functions don't have (compatibility forms, case folding, transliteration). Null counts as empty.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The normalisation rules' tables.
PUNCTUATION = "!\"#$%'()*+,-./:;<=>?@[\\]^_`{|}~"
LEGAL_SUFFIXES = [
    ("corp", "corporation"), ("corporation", "corporation"), ("inc", "incorporated"), ("incorporated", "incorporated"), ("ltd", "limited"), ("limited", "limited"),
    ("pvt", "private"), ("private", "private"), ("llc", "limited liability company"), ("llp", "limited liability partnership"), ("plc", "public limited company"),
    ("co", "company"), ("company", "company"), ("gmbh", "gmbh"), ("sarl", "sarl"), ("sa", "sa"), ("sas", "sas"), ("ste", "societe"), ("soc", "societe"),
]
INDIC_SUFFIXES = [(r"प्राइवेट\s+लिमिटेड", "private limited"), (r"प्रा[\.\s]+लि[\.]?", "private limited"), (r"लिमिटेड", "limited"), (r"एलएलपी", "llp"), (r"कंपनी", "company")]
ADDRESS_WORDS = [
    ("rd", "road"), ("st", "street"), ("ave", "avenue"), ("blvd", "boulevard"), ("dr", "drive"), ("ln", "lane"), ("ct", "court"), ("pl", "place"), ("apt", "apartment"),
    ("ste", "suite"), ("fl", "floor"), ("no", "number"), (r"p\s*o\s*box", "pobox"), ("pobox", "pobox"), ("rue", "rue"), ("av", "avenue"), ("bd", "boulevard"),
]
NAME_STOP_WORDS = (
    "the and of in for at by from with co company corp corporation inc incorporated ltd limited pvt private llc llp plc "
    "gmbh sa sarl sas ste soc services enterprises solutions group holdings technologies international india usa us"
).split()
COUNTRIES = {
    "US": "US", "USA": "US", "UNITED STATES": "US", "UNITED STATES OF AMERICA": "US", "IN": "IN", "IND": "IN", "INDIA": "IN", "FR": "FR", "FRA": "FR", "FRANCE": "FR",
    "DE": "DE", "DEU": "DE", "GERMANY": "DE", "GB": "GB", "GBR": "GB", "UK": "GB", "UNITED KINGDOM": "GB", "CA": "CA", "CAN": "CA", "CANADA": "CA",
}
SOUND_CODES = {"bfpv": "1", "cgjkqsxz": "2", "dt": "3", "l": "4", "mn": "5", "r": "6"}

# word characters are letters, numbers and underscore, as marks of other scripts don't bind words here
_AHEAD, _BEHIND = r"(?![\p{L}\p{N}_])", r"(?<![\p{L}\p{N}_])"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


# Devanagari by position in its block: independent vowels, consonants with their vowel, vowel signs.
_VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "r", 0x0F: "e", 0x10: "ai", 0x13: "o", 0x14: "au"}
_CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh ng c ch j jh ny tt tth dd ddh nn t th d dh n nnn p ph b bh m y r rr l ll lll v sh ss s h".split(), strict=True))
_SIGNS = {0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "r", 0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au"}


def transliterate_text(x: str) -> str:
    """Latin diacritics dropped, Devanagari spelt out; other letters without an ASCII form go."""
    out = []
    chars = unicodedata.normalize("NFC", x)
    for i, ch in enumerate(chars):
        at = ord(ch) - 0x900
        if 0 <= at < 0x80:
            if at in _CONSONANTS:
                after = ord(chars[i + 1]) - 0x900 if i + 1 < len(chars) else -1
                out.append(_CONSONANTS[at] + ("" if after in _SIGNS or after in (0x4D, -1) or not 0 <= after < 0x80 else "a"))
            elif 0x66 <= at <= 0x6F:
                out.append(str(at - 0x66))
            else:
                out.append(_VOWELS.get(at) or _SIGNS.get(at) or ("n" if at in (1, 2) else ""))
        else:
            out.append({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l"}.get(ch.lower()) or unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode())
    return "".join(out)


@F.pandas_udf(StringType())
def _transliterate(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x.isascii() else transliterate_text(x))


def clean_ascii(c) -> Column:
    """Compatibility decomposition with everything beyond ASCII dropped; case kept."""
    return _ascii(text(c))


def transliterate(c) -> Column:
    return F.lower(_transliterate(text(c)))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c, unicode_text: bool = True) -> Column:
    """Folded text with ` and ` for `&`, punctuation as spaces and single spaces.

    unicode_text=False skips the Arrow UDF for sources known to be ASCII (lower case only).
    """
    folded = F.lower(_fold(text(c)) if unicode_text else text(c))
    spaced = F.translate(F.replace(folded, F.lit("&"), F.lit(" and ")), PUNCTUATION, " " * len(PUNCTUATION))
    return _squeeze(spaced)


def alnum(norm) -> Column:
    return F.regexp_replace(text(norm), r"[^\p{L}\p{N}]", "")


def compact_words(norm) -> Column:
    return _squeeze(F.regexp_replace(text(norm), r"[^\p{L}\p{N} ]", ""))


def tokens(norm) -> Column:
    return F.filter(F.split(text(norm), " "), lambda t: t != "")


def signature(norm) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens(norm))), " ")


def _replace_words(c: Column, rules: list[tuple[str, str]]) -> Column:
    for word, full in rules:
        c = F.regexp_replace(c, f"{_BEHIND}{word}{_AHEAD}", full)
    return c


def expand_legal(norm) -> Column:
    c = _replace_words(text(norm), LEGAL_SUFFIXES)
    for pattern, full in INDIC_SUFFIXES:
        c = F.regexp_replace(c, pattern, full)
    return _squeeze(c)


def expand_address(norm) -> Column:
    return _squeeze(_replace_words(text(norm), ADDRESS_WORDS))


def country(c) -> Column:
    return F.upper(F.trim(text(c)))


def country_code(c) -> Column:
    table = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    return F.coalesce(F.element_at(table, country(c)), country(c))


def numbers(raw) -> Column:
    return F.regexp_extract_all(text(raw), F.lit(rf"{_BEHIND}(\p{{Nd}}+){_AHEAD}"), F.lit(1))


def postal_codes(raw) -> Column:
    return F.regexp_extract_all(text(raw), F.lit(rf"{_BEHIND}(\p{{Nd}}{{5,6}}){_AHEAD}"), F.lit(1))


def building(raw) -> Column:
    """Leading number with at most one letter, lower case; null without one."""
    return F.lower(F.nullif(F.regexp_extract(text(raw), rf"^\s*(\p{{Nd}}+[a-zA-Z]?){_AHEAD}", 1), F.lit("")))


def core_name(norm) -> Column:
    stop = F.array(*[F.lit(x) for x in NAME_STOP_WORDS])
    kept = F.filter(tokens(norm), lambda w: (~F.array_contains(stop, w)) & (F.length(w) > 1))
    return F.when(F.size(kept) == 0, text(norm)).otherwise(F.array_join(kept, " "))


def compact(norm) -> Column:
    return F.regexp_replace(F.lower(text(norm)), "[^a-z0-9]", "")


def _grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))


def char_ngrams(norm, low: int = 3, high: int = 5) -> Column:
    """Distinct character grams of the text without spaces; none if it is too short."""
    c = F.replace(text(norm), F.lit(" "), F.lit(""))
    return F.array_distinct(F.flatten(F.array(*[_grams(c, n) for n in range(low, high + 1)])))


def key_ngrams(norm, n: int) -> Column:
    """Grams of the compact text with repeats; a shorter text is its own gram."""
    c = compact(norm)
    return F.when(c == "", F.array().cast("array<string>")).when(F.length(c) < n, F.array(c)).otherwise(_grams(c, n))


def word_bigrams(norm) -> Column:
    t = tokens(norm)
    return F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.concat(F.get(t, i - 1), F.lit("_"), F.get(t, i))))


def street_token(norm, number) -> Column:
    """First address word of three letters or more that is neither all digits nor the building number."""
    t = F.filter(tokens(norm), lambda w: (F.length(w) >= 3) & (~w.rlike(r"^\p{Nd}+$")) & (w != text(number)))
    return F.get(t, F.lit(0))


def soundex(word) -> Column:
    """Four places: first letter, then codes; a letter without a code lets the same code come again."""
    w = F.lower(text(word))
    def code_of(ch: Column) -> Column:
        out = F.lit("0")
        for letters, digit in SOUND_CODES.items():
            out = F.when(F.lit(letters).contains(ch) & (ch != ""), digit).otherwise(out)
        return out
    chars = F.split(w, "")
    start = F.struct(F.substring(w, 1, 1).alias("out"), code_of(F.substring(w, 1, 1)).alias("last"))
    def step(acc: Column, ch: Column) -> Column:
        c = code_of(ch)
        return F.struct(F.when((c != "0") & (c != acc["last"]), F.concat(acc["out"], c)).otherwise(acc["out"]).alias("out"), c.alias("last"))
    got = F.aggregate(F.slice(chars, 2, 64), start, step, lambda acc: F.rpad(F.substring(acc["out"], 1, 4), 4, "0"))
    return F.when(w == "", F.lit("")).otherwise(got)


def phonetic_key(core) -> Column:
    stop = F.array(*[F.lit(x) for x in NAME_STOP_WORDS])
    words = F.filter(tokens(core), lambda w: (F.length(w) > 2) & (~F.array_contains(stop, w)))
    words = F.when(F.size(words) == 0, tokens(core)).otherwise(words)
    return F.array_join(F.transform(F.slice(words, 1, 3), soundex), "_")


def ocr_fold(c) -> Column:
    return F.translate(text(c), "015", "ois")


def initials(norm) -> Column:
    return F.array_join(F.transform(tokens(norm), lambda w: F.substring(w, 1, 1)), "")
