"""Column expressions for normalising, tokenising and keying text. All are JVM-side; none needs a shuffle."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning of their own in corpus text.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "in", "to", "for", "is", "it", "that", "with", "on", "at", "by", "as", "be",
    "are", "was", "were", "been", "has", "have", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "must", "shall", "can", "not", "no", "so", "if", "but", "than", "then", "there", "this", "he", "she", "we",
    "they", "them", "his", "her", "its", "whom", "which", "what", "when", "where", "why", "how",
)
#: Words that say little in transliterated text, English ones and particles.
TRANSLIT_STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "in", "to", "for", "is", "it", "that", "with", "on", "at", "by", "from", "as",
    "be", "are", "was", "were", "been", "has", "have", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "must", "shall", "can", "not", "no", "yes", "so", "if", "but", "than", "then", "there", "their",
    "they", "them", "this", "these", "those", "he", "she", "we", "you", "your", "our", "his", "her", "its", "who",
    "whom", "which", "what", "when", "where", "why", "how", "all", "any", "each", "few", "more", "most", "other",
    "some", "such", "only", "own", "same", "too", "very", "just", "also", "now", "here", "wa", "fa", "la", "li", "bi",
    "fi", "min", "ila", "inna", "anna", "alla", "allahu", "allah", "huwa", "hiya", "hum", "hunna", "antum", "antunna",
    "ana", "nahnu",
)
#: Words that only wrap a question.
QUERY_WORDS = (
    "verse", "verses", "ayah", "ayat", "surah", "sura", "chapter", "about", "regarding", "concerning", "mentioning",
    "mentions", "mentioned", "says", "said", "saying", "tells", "told", "describes", "describing", "talks", "talking",
    "quran", "allah",
)
#: Ordered substring replacements that bring paraphrases together.
PARAPHRASES = (
    ("ask permission", "seek exemption"),
    ("ask", "seek"),
    ("permission", "exemption"),
    ("of you", "from you"),
    ("upon", "on"),
    ("cause for blame", "blame"),
    ("moving like", "pass as"),
    ("move like", "pass as"),
    ("moving", "pass"),
    ("move", "pass"),
    ("like the", "as the"),
    ("like a", "as a"),
    ("swears by", "swear by"),
    ("swore by", "swear by"),
    ("task a soul", "burden a soul"),
    ("charge a soul", "burden a soul"),
)
#: Fixed value: question wrappers at the start of a query.
WRAPPER = (
    r"(?i)^(?:(?:the\s+)?(?:verse|ayah|ayat|surah|sura|chapter)s?\s+(?:about|regarding|concerning|where|that|which|on|mentioning)\s+)"
    r"|^(?:where\s+(?:allah|god|quran)\s+(?:says?|mentions?|describes?|tells?|talks?\s+about)\s+(?:about\s+)?)"
    r"|^(?:(?:quran|quranic)\s+(?:verse|ayah|ayat)s?\s+(?:about|on|regarding|concerning)\s+)"
)
#: Ordered replacements of transliterated text, the last seven at its start.
LATIN_RULES = (
    ("ph", "f"), ("kh", "h"), ("gh", "g"), ("sh", "s"), ("th", "t"), ("dh", "d"), ("aa", "a"), ("ee", "i"), ("oo", "u"),
    ("ou", "u"), ("ei", "i"), ("ai", "a"), ("al-", "al "), ("^al ", ""), ("^an ", ""), ("^ar ", ""), ("^as ", ""),
    ("^at ", ""), ("^ad ", ""), ("^az ", ""),
)
#: Ordered replacements of the Latin sound key.
SOUND_DIGRAPHS = (
    ("ph", "f"), ("kh", "x"), ("gh", "g"), ("sh", "s"), ("th", "t"), ("dh", "d"), ("aa", "a"), ("ee", "i"), ("oo", "u"),
    ("ou", "u"), ("ei", "i"), ("ai", "a"), ("al-", "al "), ("el-", "al "), ("ul-", "al "),
)
#: Arabic marks, punctuation, letter folding, opening formula, sound letters and Latin spellings.
MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
ARABIC_PUNCTUATION = "[،؛؟٪-٭۔.,;:!?\"'()\\[\\]{}«»_/\\\\|-]+"
FOLD_FROM, FOLD_TO, FOLD_DROP = "آأإٱؤئةىیکھ", "ااااويهييكه", "ءـ"
FORMULA = "بسم الله الرحمن الرحيم"
#: The formula's letters with any marks after each, alefs optional and in any form.
FORMULA_IN_MARKS = "^" + "\\s*".join("".join(("[ٱا]?" if x == "ا" else x) + ("" if x == "ا" else "[\u064b-\u0652\u0670]*") for x in w) for w in FORMULA.split()) + "\\s*"
SOUNDS_FROM, SOUNDS_TO = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي", "oaa'w'ibpthjhkhdrzss'dt'g'fqklmnhwyy"
LATIN_PAIRS = (("ث", "th"), ("خ", "kh"), ("ذ", "dh"), ("ش", "sh"), ("غ", "gh"))
LATIN_FROM, LATIN_TO = "آأؤإئابةتجحدرزسصضطظعفقكلمنهوىيٱ", "aauaaabhtjhdrzssdtzafqklmnhwaya"
PREFIXES = ("و", "ف", "ب", "ك", "ل", "ال")
SUFFIXES = ("ها", "هم", "هن", "كم", "كن", "نا", "ني", "ه", "ة", "ات", "ون", "ين", "ان")


def accents() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, by the decomposition rule."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, "".join(x for x in d if not unicodedata.combining(x)).lower()) for a, d in pairs]
    pairs = [(a, d) for a, d in pairs if len(d) == 1 and d.isascii() and d.isalpha() and a.lower() == a]
    return "".join(a for a, _ in pairs), "".join(d for _, d in pairs)


ACCENTS_FROM, ACCENTS_TO = accents()


def presentation_forms() -> tuple[str, str]:
    """Single-letter Arabic presentation forms and the letters they stand for, by the compatibility rule."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD))]
    pairs = [(a, d) for a, d in pairs if len(d) == 1 and a != d]
    return "".join(a for a, _ in pairs), "".join(d for _, d in pairs)


FORMS_FROM, FORMS_TO = presentation_forms()


def joined_forms() -> dict[str, str]:
    """Arabic presentation forms that stand for several letters, as lam-alef, by the compatibility rule."""
    pairs = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD)))
    return {a: d for a, d in pairs if len(d) > 1}


JOINED_FORMS = joined_forms()


def runs(c: Column, letters: str) -> Column:
    """The runs of such letters with one space between them. Taking the runs out costs a tenth of replacing what is between."""
    return F.array_join(F.regexp_extract_all(c, F.lit(f"[{letters}]+"), F.lit(0)), " ")


def squeeze(c: Column) -> Column:
    return runs(c, "^ \\t\\n\\r")


def replaced(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalize_english(c: Column) -> Column:
    return runs(F.lower(c), "a-z0-9'")


def paraphrase(c: Column) -> Column:
    return replaced(c, PARAPHRASES)


def strip_intent_wrapper(c: Column) -> Column:
    trimmed = F.trim(c)
    out = F.trim(F.regexp_replace(trimmed, WRAPPER, ""))
    return F.when(out == "", trimmed).otherwise(out)


def content_tokens(c: Column, query: bool = False) -> Column:
    """Words of over two letters that are not stop words, in text order. Words are runs of letters and apostrophes, so what
    stands between them needs no normalising."""
    stop = (*STOP_WORDS, *(QUERY_WORDS if query else ()))
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z']{3,}"), F.lit(0)), lambda w: ~w.isin(*stop))


def fold_accents(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTS_FROM, ACCENTS_TO)


def normalize_translit(c: Column) -> Column:
    c = F.regexp_replace(fold_accents(F.trim(c)), "[^a-z0-9 \\t\\n\\r]", " ")
    for pattern, put in LATIN_RULES:
        c = F.regexp_replace(c, pattern, put) if pattern.startswith("^") else F.replace(c, F.lit(pattern), F.lit(put))
    return squeeze(c)


def translit_tokens(c: Column) -> Column:
    """Words of over two letters of a normalised transliteration that are no stop words."""
    return F.filter(F.split(c, " "), lambda w: (F.length(w) > 2) & ~w.isin(*TRANSLIT_STOP_WORDS))


def phonetic_latin(c: Column) -> Column:
    c = replaced(F.regexp_replace(fold_accents(c), "['`]", ""), SOUND_DIGRAPHS)
    return squeeze(F.translate(c, "aeiou", ""))


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, MARKS, "")


def parted_forms(c: Column) -> Column:
    """Presentation forms of several letters written out; most texts have none."""
    table = F.create_map(*[F.lit(x) for pair in JOINED_FORMS.items() for x in pair])
    whole = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(table[x], x)), "")
    return F.when(c.rlike("[\ufb50-\ufdff\ufe70-\ufefc]"), whole).otherwise(c)


def letter_table() -> tuple[str, str]:
    """What becomes of each letter that is not kept as it is: its plain form, a space for punctuation, or nothing."""
    forms, fold = dict(zip(FORMS_FROM, FORMS_TO, strict=True)), dict(zip(FOLD_FROM, FOLD_TO, strict=True))
    marks, spaces = re.compile(MARKS), re.compile(ARABIC_PUNCTUATION)
    made = {}
    for c in map(chr, range(0x10000)):
        x = forms.get(c, c)
        x = "" if x in FOLD_DROP or marks.fullmatch(x) else fold.get(x, x)
        made[c] = " " if spaces.fullmatch(x) else x
    pairs = sorted((pair for pair in made.items() if pair[0] != pair[1]), key=lambda pair: not pair[1])  # those dropped come last
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


LETTERS_FROM, LETTERS_TO = letter_table()


def normalize_arabic(c: Column) -> Column:
    c = F.regexp_replace(F.translate(parted_forms(c), LETTERS_FROM, LETTERS_TO), "[^؀-ۿ \\t\\n\\r]+", "")
    return squeeze(F.regexp_replace(c, "(.)\\1{2,}", "$1$1"))


def is_formula(c: Column) -> Column:
    formula = normalize_arabic(F.lit(FORMULA))
    return c.startswith(formula) & (F.length(F.trim(F.substring(c, F.length(formula) + 1, F.length(c)))) <= 2)


def strip_formula_for_search(c: Column, group: Column, ordinal: Column) -> Column:
    """c is normalised; only the first passage of groups other than 1 and 9 loses the opening formula."""
    formula = normalize_arabic(F.lit(FORMULA))
    rest = F.trim(F.substring(c, F.length(formula) + 1, F.length(c)))
    cut = F.when(c == formula, "").when(c.startswith(F.concat(formula, F.lit(" "))), rest).when(c.startswith(formula) & (rest != ""), rest).otherwise(c)
    return F.when(group.isin(1, 9) | (ordinal != 1), c).otherwise(cut)


def strip_formula_for_display(c: Column, group: Column, ordinal: Column) -> Column:
    """As shown to readers: only the first passage of groups other than 1 and 9 loses the opening formula, in any marks."""
    rest = F.trim(F.regexp_replace(c, FORMULA_IN_MARKS, ""))
    return F.when(group.isin(1, 9) | (ordinal != 1) | (rest == ""), c).otherwise(rest)


def prepare_translit(arabic: Column, given: Column) -> tuple[Column, Column]:
    """(transliteration, its normal form): the given one unless blank, else one made from the script."""
    made = F.when(F.trim(F.coalesce(given, F.lit(""))) != "", F.trim(given)).otherwise(to_latin(arabic))
    return made, normalize_translit(made)


def phonetic_keys(c: Column) -> Column:
    """struct(primary, latin): both sound keys of a query; Latin text has one for both."""
    latin = phonetic_latin(c)
    arabic = detect_script(c) == "arabic"
    spelled = F.translate(c, SOUNDS_FROM, SOUNDS_TO)
    return F.struct(F.when(arabic, phonetic_primary(c)).otherwise(latin).alias("primary"), F.when(arabic, phonetic_latin(spelled)).otherwise(latin).alias("latin"))


def has_formula_prefix(c: Column, group: Column, ordinal: Column) -> Column:
    return ~group.isin(1, 9) & (ordinal == 1) & c.startswith(normalize_arabic(F.lit(FORMULA)))


def phonetic_primary(c: Column) -> Column:
    return phonetic_of_normalized(normalize_arabic(c))


def phonetic_of_normalized(c: Column) -> Column:
    key = F.translate(c, SOUNDS_FROM, SOUNDS_TO)
    return F.lower(squeeze(F.translate(key, "aeiou", "")))


def to_latin(c: Column) -> Column:
    c = replaced(strip_marks(c), LATIN_PAIRS)
    return squeeze(F.regexp_replace(F.translate(c, LATIN_FROM, LATIN_TO), "[^a-z ]", ""))


def token_variants(t: Column) -> Column:
    """A token with its article, medial-alef and plural-suffix variants."""
    n, two = F.length(t), F.expr  # noqa: F841
    head = lambda k: F.left(t, F.length(t) - k)
    found = F.array(
        t,
        F.when((n > 3) & t.startswith("ال"), F.substring(t, 3, 1000000)),
        F.when((n >= 4) & t.endswith("اع"), F.concat(head(2), F.lit("ع"))),
        F.when((n >= 3) & t.endswith("ع") & ~t.endswith("اع"), F.concat(head(1), F.lit("اع"))),
        F.when((n >= 4) & (t.endswith("ات") | t.endswith("ين") | t.endswith("ون")), head(2)),
    )
    return F.array_distinct(F.array_compact(found))


def stem_roots(words: Column, prefixes=PREFIXES, suffixes=SUFFIXES) -> Column:
    """First fitting prefix and suffix off each word of three letters or more, three letters kept, in first order."""

    def stem(w: Column) -> Column:
        front = w
        for p in reversed(prefixes):
            front = F.when(w.startswith(p) & (F.length(w) > len(p) + 2), F.substring(w, len(p) + 1, 1000000)).otherwise(front)
        back = front
        for s in reversed(suffixes):
            back = F.when(front.endswith(s) & (F.length(front) > len(s) + 2), F.left(front, F.length(front) - len(s))).otherwise(back)
        return F.left(back, F.lit(3))

    return F.array_distinct(F.filter(F.transform(F.filter(words, lambda w: F.length(w) >= 3), stem), lambda w: F.length(w) >= 2))


def char_ngrams(c: Column, n: int = 3) -> Column:
    # the text without spaces is bound once, instead of being made anew for each gram
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    made = F.transform(F.array(F.replace(c, F.lit(" "), F.lit(""))), grams)[0]
    return F.filter(F.array_distinct(made), lambda g: g != "")


def word_ngrams(tokens: Column, n: int) -> Column:
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def arabic_share(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[؀-ۿ]"))


def detect_script(c: Column) -> Column:
    return F.when(arabic_share(c) > F.length(c) * 0.3, "arabic").otherwise("latin")


def clamp(c: Column, n: int = 500) -> Column:
    return F.left(F.trim(c), F.lit(n))


def html_to_text(c: Column) -> Column:
    c = F.regexp_replace(c, "(?i)<br[ ]*/?>|</(p|li|blockquote)>", "\n")
    c = F.regexp_replace(c, "<[^>]*>", "")
    c = F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(c, "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "")


def parse_key(c: Column) -> Column:
    """struct(group, ordinal) of `s:a`, null where malformed or out of range."""
    ok = c.rlike("^[0-9]{1,3}:[0-9]{1,3}$")
    group, ordinal = (F.regexp_extract(c, "^([0-9]{1,3}):([0-9]{1,3})$", i).try_cast("int") for i in (1, 2))
    return F.when(ok & group.between(1, 114) & (ordinal >= 1), F.struct(group.alias("group"), ordinal.alias("ordinal")))


def phonetic_fingerprint(c: Column, size: int = 13, chars: int = 64) -> Column:
    """A unit vector of folded character codes. Each step is bound to a name, as Spark would write it out anew wherever a
    later one uses it."""
    bound = lambda value, then: F.transform(F.array(value), then)[0]
    total = lambda items: F.aggregate(items, F.lit(0.0), lambda a, x: a + x)
    head = F.left(c, F.lit(chars))
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(head), F.lit(1))), lambda i: F.ascii(F.substring(head, i, F.lit(1))) % 32 / 32.0)
    sums = lambda found: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: total(F.filter(found, lambda x, i: i % size == k)))
    unit = lambda made: bound(F.sqrt(total(F.transform(made, lambda x: x * x))), lambda norm: F.transform(made, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)))
    return bound(codes, lambda found: bound(sums(found), unit))
