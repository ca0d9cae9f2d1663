"""Text normalisation as column expressions, Spanish first."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, functions as F

#: Fixed patterns: a URL up to the next white space, and what is neither letter, digit, underscore nor white space.
URL = r"https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+"
NON_WORD = r"[^\p{L}\p{N}_\s]"
#: Any white space, Unicode included.
WHITE = r"[\s\p{Z}\x{85}]+"

# The Spanish stop words of the Snowball project that aren't forms of a verb.
FUNCTION_WORDS = """
de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre
también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo
otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas
nosotras vosostros vosostras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro
vuestra vuestros vuestras esos esas
"""
# The forms of estar, haber, ser, sentir and tener that follow no rule below.
VERB_FORMS = """
estoy estás está estamos estáis están esté estés estemos estéis estén estando estado estada estados estadas estad
he has ha hemos habéis han haya hayas hayamos hayáis hayan habiendo habido habida habidos habidas
soy eres es somos sois son sea seas seamos seáis sean era eras éramos erais eran fui fuiste fue fuimos fuisteis fueron
sintiendo sentido sentida sentidos sentidas siente sentid
tengo tienes tiene tenemos tenéis tienen tenga tengas tengamos tengáis tengan teniendo tenido tenida tenidos tenidas tened
"""
# Stems, and the endings that each of them takes.
CONJUGATIONS = (
    ("estar habr ser tendr", "é ás á emos éis án ía ías íamos íais ían"),
    ("hab ten", "ía ías íamos íais ían"),
    ("est", "aba abas ábamos abais aban"),
    ("estuv hub tuv", "e iste o imos isteis ieron iera ieras iéramos ierais ieran iese ieses iésemos ieseis iesen"),
    ("fu", "era eras éramos erais eran ese eses ésemos eseis esen"),
)


@lru_cache(maxsize=4)
def stop_words(language: str = "spanish") -> tuple[str, ...]:
    """The stop words of a language; only Spanish has some."""
    if language != "spanish":
        raise ValueError(f"no stop words for {language}")
    conjugated = (stem + ending for stems, endings in CONJUGATIONS for stem in stems.split() for ending in endings.split())
    return tuple(sorted({*FUNCTION_WORDS.split(), *VERB_FORMS.split(), *conjugated}))


def normalize(text: Column, language: str = "spanish", contractions: bool = False) -> Column:
    """array<string> of normalised tokens; null and empty texts give an empty array.

    Lower case, without URLs and marks, split at white space; stop words and
    tokens of one character are dropped inside the array, below any explode.
    ``contractions`` splits the few English ones that tokenisers split.
    """
    x = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), URL, " "), NON_WORD, " ")
    if contractions:
        for whole, parts in (("cannot", "can not"), ("gimme", "gim me"), ("gonna", "gon na"), ("gotta", "got ta"), ("lemme", "lem me"), ("wanna", "wan na")):
            x = F.regexp_replace(x, rf"(?<![\p{{L}}\p{{N}}_]){whole}(?![\p{{L}}\p{{N}}_])", parts)
    words = list(stop_words(language))
    return F.filter(F.split(x, r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(words))


#: Normalisers by name: functions of a text column that give its tokens, array<string>.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {"spanish": normalize}


def register_normalizer(name: str, function: Callable[[Column], Column]) -> str:
    """Makes a normaliser known by a name, which is what indexes and models are saved with."""
    NORMALIZERS[name] = function
    return name


def normalizer(name: str) -> Callable[[Column], Column]:
    if name not in NORMALIZERS:
        raise ValueError(f"no normaliser {name}; register_normalizer makes it known")
    return NORMALIZERS[name]


def clean(text: Column) -> Column:
    """Trimmed, lower-cased, every run of white space one blank."""
    return F.trim(F.lower(F.regexp_replace(text, WHITE, " ")))


def document_text(title: Column, content: Column) -> Column:
    """Title, a blank, content; nulls count as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; the last as it is."""
    *some, last = columns
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in some), last)
