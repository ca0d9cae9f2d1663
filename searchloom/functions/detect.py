"""Detectors over titles and texts, routing, and name-based ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Keywords in order of precedence, each with what it stands for.
BRANDS = (
    ("rog phone", "ASUS"), ("galaxy", "Samsung"), ("samsung", "Samsung"), ("iphone", "Apple"), ("ipad", "Apple"), ("apple", "Apple"),
    ("redmi", "Xiaomi"), ("poco", "Xiaomi"), ("xiaomi", "Xiaomi"), ("oneplus", "OnePlus"), ("oppo", "Oppo"), ("vivo", "vivo"),
    ("honor", "Honor"), ("huawei", "Huawei"), ("moto ", "Motorola"), ("motorola", "Motorola"), ("google pixel", "Google"), ("pixel", "Google"),
    ("nothing phone", "Nothing"), ("nothing", "Nothing"), ("realme", "Realme"), ("xperia", "Sony"), ("sony", "Sony"), ("asus", "ASUS"),
    ("nokia", "Nokia"), ("zte", "ZTE"), ("nubia", "Nubia"), ("lenovo", "Lenovo"), ("tecno", "Tecno"), ("infinix", "Infinix"), ("fairphone", "Fairphone"),
)
SYSTEMS = (
    ("watchos", "watchOS"), ("ipados", "iPadOS"), ("ipad", "iPadOS"), ("harmonyos", "HarmonyOS"), ("one ui", "Android"), ("miui", "Android"),
    ("hyperos", "Android"), ("coloros", "Android"), ("oxygenos", "Android"), ("android", "Android"), ("ios", "iOS"),
)
LAPTOP_WORDS = ("portátiles", "laptops")
COMPONENT_WORDS = ("pc-gaming", "tarjetas gráficas", "procesadores", "hardware")
#: The namespace of URLs (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _first(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """What the first keyword stands for that the text holds; null without one."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in table))


def brand(text: Column) -> Column:
    return _first(F.lower(text), BRANDS)


def operating_system(text: Column) -> Column:
    return _first(F.lower(text), SYSTEMS)


def pc_subcategory(text: Column) -> Column:
    """laptop, component or pc; letter case counts."""
    has = lambda words: F.coalesce(*(F.when(F.contains(text, F.lit(w)), F.lit(True)) for w in words), F.lit(False))
    return F.when(has(LAPTOP_WORDS), "laptop").when(has(COMPONENT_WORDS), "component").otherwise("pc")


def sink_category(spider: Column) -> Column:
    """The folder a spider's items go to."""
    return F.when(F.contains(spider, F.lit("mobile")) | (spider == "apple_newsroom"), "mobile").when(F.contains(spider, F.lit("pc")), "pc").otherwise("general")


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based UUID, version 5, of a string."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
