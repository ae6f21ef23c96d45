"""Surface projections of morphemes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONJUGATING = ("動詞", "形容詞", "助動詞")


def projected(m: Column, projection: str = "surface", get=None) -> Column:
    """The projected surface of a morpheme: a struct column, or anything of which get(field) gives the fields."""
    get = get or (lambda f: m[f])
    surface = get("surface")
    if projection == "surface":
        return surface
    if projection in ("normalized", "reading", "dictionary"):
        return get({"normalized": "normalized_form", "reading": "reading_form", "dictionary": "dictionary_form"}[projection])
    pos = get("pos")
    if projection == "normalized_nouns":
        return F.when(F.get(pos, F.lit(5)) == "*", get("normalized_form")).otherwise(surface)
    form = {"dictionary_and_surface": "dictionary_form", "normalized_and_surface": "normalized_form"}[projection]
    return F.when(F.get(pos, F.lit(0)).isin(*CONJUGATING), surface).otherwise(get(form))
