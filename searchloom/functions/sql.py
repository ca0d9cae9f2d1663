"""The library from SQL: functions and a table function registered on a session.

    SELECT * FROM extract(TABLE(SELECT page_id, html FROM pages), 'html', 'plain')
    SELECT normalize_text(text), brand_of(text), os_of(text), clean_query(text) FROM ...

The scalar functions are SQL expressions that Catalyst puts in place; ``extract``
is polymorphic: it gives the columns of its table but the HTML, and an article's.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..session import ship
from ..sources.html import ARTICLE, NEWS, PLAIN, Profile, article
from .detect import BRANDS, SYSTEMS
from .text import NON_WORD, URL, WHITE, stop_words

#: Page profiles by name.
PROFILES: dict[str, Profile] = {"news": NEWS, "plain": PLAIN}


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _first(table: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(t), {_quoted(k)}) THEN {_quoted(v)}" for k, v in table) + " END"


def scalar_functions(language: str = "spanish") -> dict[str, tuple[str, str]]:
    """name: (type, expression of the string ``t``)."""
    words = ", ".join(map(_quoted, stop_words(language)))
    plain = f"regexp_replace(regexp_replace(lower(coalesce(t, '')), {_quoted(URL)}, ' '), {_quoted(NON_WORD)}, ' ')"
    return {
        "normalize_text": ("ARRAY<STRING>", f"filter(split({plain}, {_quoted(chr(92) + 's+')}), x -> length(x) > 1 AND x NOT IN ({words}))"),
        "clean_query": ("STRING", f"trim(lower(regexp_replace(t, {_quoted(WHITE)}, ' ')))"),
        "brand_of": ("STRING", _first(BRANDS)),
        "os_of": ("STRING", _first(SYSTEMS)),
    }


def _extractor(profiles: dict[str, dict]):
    kinds = {"string": StringType(), "array<string>": ArrayType(StringType())}
    fields = [StructField(name, kinds[kind]) for name, kind in (x.split() for x in ARTICLE.split(", "))]

    class Extract:
        @staticmethod
        def analyze(pages: AnalyzeArgument, html: AnalyzeArgument, profile: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable or html.value not in pages.dataType.fieldNames():
                raise ValueError("extract(TABLE(...), 'name of the HTML column', 'name of the profile')")
            if profile.value not in profiles:
                raise ValueError(f"no profile {profile.value}")
            kept = [StructField(f.name, f.dataType, True) for f in pages.dataType if f.name != html.value]
            return AnalyzeResult(StructType([*kept, *fields]))

        def eval(self, row: Row, html: str, profile: str):
            found = article(row[html], Profile(**profiles[profile]))
            yield (*(row[c] for c in row.__fields__ if c != html), *found.values())

    return udtf(Extract)


def register(spark: SparkSession, profiles: dict[str, Profile] | None = None) -> None:
    """Makes the functions known to the session; ``profiles``: further page profiles by name."""
    ship(spark)
    for name, (kind, body) in scalar_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    spark.udtf.register("extract", _extractor({n: asdict(p) for n, p in (PROFILES | (profiles or {})).items()}))
