"""Text keys as column expressions: normal forms, stems, tokens, grams and hashes."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and words that the normal forms treat alike everywhere.
INVISIBLE = r"[\u200B\u200E\u200F\u061C\u202A-\u202E\u2066-\u2069\uFEFF\u00AD]"
MARKS = r"[\u0610-\u061A\u064B-\u0670\u06D6-\u06ED\u08D3-\u08FF]"
MARKS_NOT_DIGITS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED\u08D3-\u08FF]"
ALIF = r"[\u0622\u0623\u0625\u0671\u0672\u0673]"
#: Letters and their unified forms; the last one has none.
UNIFIED = ("ىةؤئیکـ", "يهوييك")
LIGATURES = r"[\uFDFA\uFDFB\uFD40-\uFD4F]"
NOT_LETTER = r"[^\u0621-\u064A\u0660-\u0669\s]"
HONORIFICS = [
    "صلي الله عليه وسلم", "رضي الله عنهما", "رضي الله عنهم", "رضي الله عنها", "رضي الله عنه", "عليه الصلاه والسلام", "عليه السلام",
]
PREFIXES = ["وال", "فال", "بال", "كال", "لل", "ال"]
SUFFIXES = ["ها", "ان", "ات", "ون", "ين", "وا", "يه", "هم", "هن", "كم", "نا", "ه", "ي"]
LATIN_STOP = (
    "the and of to a in is that he for it with was as his on be at by i this had not are but from or have an they which you were her all she there would "
    "their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do "
    "first any my now such like our over man me even most made after also did many before must through back years where much your way well down should "
    "because each just those people how too little state good very make world still own see men work long get here between both life being under never day "
    "same another know while last might us great old year off come since against go came right used take three yang dan di ke dari ini itu dengan untuk "
    "tidak ada pada adalah akan juga atau oleh karena sebagai dalam kami kamu mereka saya kita bahwa telah sudah bisa"
).split()
# Substitutions that fold spellings of a name, in order.
SPELLINGS = [
    ("sy|sh", "s"), ("dz|dh", "d"), ("ts|th", "t"), ("kh", "k"), ("gh", "g"), ("q", "k"), ("o", "a"), ("e", "i"), ("w", "u"), ("y", "i"),
    ("^a[lnstdrz](?=.{3})", ""), (r"(.)\1+", "$1"), ("h$", ""),
]
INDONESIAN_WORDS = "yang dan itu dengan ini tidak kita dari untuk adalah".split()
ENGLISH_WORDS = "the and of to is that with for this are".split()


def _normal_form(form: str):
    @F.pandas_udf("string")
    def normalised(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normalised


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no built-in for it."""
    return _normal_form("NFC")(text)


def nfkd(text: Column) -> Column:
    return _normal_form("NFKD")(text)


def ascii_folded(text: Column) -> Column:
    """ASCII letters of the decomposed text in lower case; what has none is left out."""
    return F.lower(F.regexp_replace(nfkd(text), r"[^\x00-\x7F]", ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def squeeze(text: Column) -> Column:
    return F.array_join(words_of(text), " ")


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def _unified(text: Column, marks: str) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, marks, ""), ALIF, "ا")
    return F.translate(text, *UNIFIED)


_LEFT_OUT, _ALIF = re.compile(f"{INVISIBLE}|{MARKS_NOT_DIGITS}|{LIGATURES}"), re.compile(ALIF)
_UNIFIED = str.maketrans(UNIFIED[0][: len(UNIFIED[1])], UNIFIED[1], UNIFIED[0][len(UNIFIED[1]) :])


def word_key(word: str | None) -> str:
    """Key of one word for walking along words: the letters of `linkage_norm`, and Latin letters and digits without accents in lower case."""
    word = _ALIF.sub("ا", _LEFT_OUT.sub("", word or "")).translate(_UNIFIED)
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9ء-ي٠-٩]", "", word.lower())


def norm(text: Column, composed: bool = False) -> Column:
    """Retrieval key of Arabic text: unified letters alone, single spaces, no honorific phrase that stands between spaces.

    Vocatives are separated, long vowels in Quranic spelling are written out, and digits go with the marks. `composed`
    says that the text is in composed form already.
    """
    text = F.coalesce(text, F.lit(""))
    text = text if composed else nfc(text)
    text = _chain(
        text, (INVISIBLE, ""), (r"\[\^\d+\]", " "), (LIGATURES, " "), (r"(?<!\S)ي\u064E?\u0670\u0653?", "يا "), (r"\u0648\u0670", "ا"),
        (rf"\u0649\u0670(?={MARKS_NOT_DIGITS}*[\u0621-\u064A])", "ا"),
    )
    text = F.regexp_replace(_unified(text, MARKS), NOT_LETTER, " ")
    text = F.concat(F.lit(" "), squeeze(text), F.lit(" "))
    text = F.replace(text, F.lit("ءا"), F.lit("ا"))
    for h in sorted(HONORIFICS, key=len, reverse=True):
        text = F.replace(text, F.lit(f" {h} "), F.lit(" "))
    return squeeze(text)


def linkage_norm(text: Column, composed: bool = False) -> Column:
    """Linkage key: as `norm`, but digits stay, vocatives are left alone and honorifics go wherever they stand."""
    text = F.coalesce(text, F.lit(""))
    text = text if composed else nfc(text)
    text = _chain(text, (INVISIBLE, ""), (r"\[\^\d+\]", " "), (LIGATURES, " "))
    text = squeeze(F.regexp_replace(_unified(text, MARKS_NOT_DIGITS), NOT_LETTER, " "))
    for h in sorted(HONORIFICS, key=len, reverse=True):
        text = F.replace(text, F.lit(h), F.lit(" "))
    return squeeze(text)


def skeleton(word: Column) -> Column:
    """The word without any alif after its first letter."""
    return F.concat(F.substring(word, 1, 1), F.replace(F.substring(word, 2, 1 << 20), F.lit("ا"), F.lit("")))


def stem(word: Column) -> Column:
    """Light stem: one conjunction, the first prefix and the first suffix that leave two letters, then the skeleton."""
    word = F.when((F.length(word) >= 4) & word.rlike("^[وف]") & ~word.rlike("^[وف]ال"), F.substring(word, 2, 1 << 20)).otherwise(word)
    word = F.regexp_replace(word, f"^(?:{'|'.join(f'{p}(?=..)' for p in PREFIXES)})", "")
    return skeleton(_without_suffix(word))


def _without_suffix(word: Column) -> Column:
    e = word
    for s in reversed(SUFFIXES):
        fits = F.endswith(word, F.lit(s)) & (F.length(word) - len(s) >= 2)
        e = F.when(fits, F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(e)
    return e


def stems(normal: Column) -> Column:
    return F.transform(words_of(normal), stem)


def trigrams(normal: Column) -> Column:
    """Character trigrams of each word's skeleton; skeletons of three letters or fewer stay whole."""
    def of(word: Column) -> Column:
        return F.transform(F.array(skeleton(word)), lambda k: F.when(F.length(k) <= 3, F.array(k)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(k) - 2, F.lit(1))), lambda i: F.substring(k, i, F.lit(3)))))[0]

    return F.flatten(F.transform(words_of(normal), of))


def latin_words(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; every other character separates."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def latin_tokens(text: Column, most: int | None = None, decompose: bool = False) -> Column:
    """Distinct words of three characters and more that are no stop words, in order, all or the first `most`. `decompose` splits accents off first."""
    tokens = F.filter(F.array_distinct(latin_words(nfkd(text) if decompose else text)), lambda w: (F.length(w) >= 3) & ~w.isin(LATIN_STOP))
    return F.slice(tokens, 1, most) if most else tokens


def bound(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def word_grams(words: Column, n: int = 4) -> Column:
    """Distinct word n-grams; a shorter text gives itself whole."""
    def grams(ws: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))
        return F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(all_))

    return bound(words, grams)


def clean(text: Column) -> Column:
    """Invisible characters out, single spaces, none before punctuation."""
    return F.trim(_chain(text, (INVISIBLE, ""), (r"[ \t]+", " "), (r" +([.,،؛:])", "$1")))


def plain(text: Column) -> Column:
    """`clean` text without light markdown: emphasis, escapes and footnote marks."""
    return clean(F.replace(_chain(text, (r"\\([\\`*_{}\[\]()#+\-.!|~>])", "$1"), (r"\[\^\d+\]", "")), F.lit("*"), F.lit("")))


def strip_tags(text: Column) -> Column:
    return clean(F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " "))


def arabic_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[ء-ي]"))


def latin_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def script_share(text: Column) -> Column:
    """Share of Arabic among the Arabic and Latin letters."""
    a, b = arabic_letters(text), latin_letters(text)
    return a / F.greatest(F.lit(1), a + b)


def guess_language(text: Column) -> Column:
    """`ar` by script, else `id` or `en` by which common words occur more often in the whole text."""
    hits = lambda ws: F.regexp_count(text, F.lit(rf"(?i)\b({'|'.join(ws)})\b"))
    return F.when(arabic_letters(text) > latin_letters(text), "ar").when(hits(INDONESIAN_WORDS) > hits(ENGLISH_WORDS), "id").otherwise("en")


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the size of the smaller set."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return total(a, b) / (F.sqrt(total(a, a)) * F.sqrt(total(b, b)))


def content_id(text: Column) -> Column:
    """First 32 hexadecimal digits of the SHA-256 of the trimmed text."""
    return F.substring(F.sha2(F.trim(text), 256), 1, 32)


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def clock(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(whole / 60), (whole % 60))


def arabic_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", "٠١٢٣٤٥٦٧٨٩")


def alias_key(name: Column) -> Column:
    """Letters a-z of a name without accents, in lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(nfkd(name), r"\p{Mn}", "")), "[^a-z]", "")


def spelling_key(letters: Column) -> Column:
    """Letters of a name folded by sound, so that spellings of one name meet."""
    for pattern, new in SPELLINGS:
        letters = F.regexp_replace(letters, pattern, new)
    return letters


def chapter_key(name: Column) -> Column:
    return spelling_key(alias_key(name))


def json_or(text: Column, schema: str, default: Column) -> Column:
    """Parsed JSON, or `default` where it is missing or malformed."""
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)), default)
