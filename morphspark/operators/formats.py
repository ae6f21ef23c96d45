"""Output forms: tab-separated morphemes, spaced words, sentences, dumps of a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .projection import projected


def tsv(morphemes: Column, everything: bool = False) -> Column:
    """A line for each morpheme and EOS: surface, classes, normal form; with everything also dictionary form, reading, dictionary, synonym groups and (OOV)."""

    def line(m: Column) -> Column:
        parts = [m["surface"], F.array_join(m["pos"], ","), m["normalized_form"]]
        if everything:
            groups = F.concat(F.lit("["), F.array_join(F.transform(m["synonym_group_ids"], lambda g: g.cast("string")), ","), F.lit("]"))
            parts += [m["dictionary_form"], m["reading_form"], m["dictionary_id"].cast("string"), groups]
        out = F.concat_ws("\t", *parts)
        return F.concat(out, F.when(m["is_oov"], "\t(OOV)").otherwise("")) if everything else out

    return F.array_join(F.concat(F.transform(morphemes, line), F.array(F.lit("EOS"))), "\n")


def wakati(morphemes: Column, projection: str = "surface") -> Column:
    """The surfaces with spaces between; empty of none."""
    return F.array_join(F.transform(morphemes, lambda m: projected(m, projection)), " ")


def text_of(morphemes: Column) -> Column:
    """How a list of morphemes is shown."""
    shown = F.transform(morphemes, lambda m: F.concat(F.lit("<"), m["surface"], F.lit("("), m["begin"].cast("string"), F.lit(":"), m["end"].cast("string"), F.lit(")>")))
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def morpheme_text(m: Column) -> Column:
    """How one morpheme is shown."""
    return F.format_string("<Morpheme(%s, %d:%d, %s)>", m["surface"], m["begin"], m["end"], F.array_join(m["pos"], ","))


def get(morphemes: Column, i: int) -> Column:
    """The morpheme at a place, from the end if less than 0; null beyond."""
    return F.try_element_at(morphemes, F.lit(i + 1 if i >= 0 else i))


def cut(morphemes: Column, begin: int = 0, end: int | None = None) -> Column:
    """The morphemes from begin to end, places from the end if less than 0."""
    n = F.size(morphemes)
    at = lambda k: F.lit(k) if k >= 0 else F.greatest(n + k, F.lit(0))
    last = n if end is None else F.least(at(end), n)
    return F.slice(morphemes, at(begin) + 1, F.greatest(last - at(begin), F.lit(0)))


def write_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """Writes one text column, its rows as they come."""
    df.select(F.col(column).alias("value")).where("value is not null").write.mode(mode).text(path)


def dump(dictionary, what: str) -> DataFrame:
    """(id, line) of a part of a dictionary: pos, matrix or words."""
    if what == "pos":
        return dictionary.table("pos").select(F.col("pos_id").cast("long").alias("id"), F.concat_ws(",", *[f"p{k}" for k in range(1, 7)]).alias("line"))
    if what == "matrix":
        return dictionary.table("conn").select((F.col("left").cast("long") * dictionary.meta["rights"] + F.col("right")).alias("id"), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("left", "right", "cost")]).alias("line"))
    if what == "words":
        ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "/")
        return dictionary.table("lexicon").select(F.col("word_id").alias("id"), F.concat_ws(",", "surface", *[F.col(c).cast("string") for c in ("left_id", "right_id", "cost", "pos_id")], "headword", "reading", "normalized", F.coalesce(F.col("dic_form_word_id").cast("string"), F.lit("-1")), ids("split_a"), ids("split_b"), ids("structure"), ids("synonyms")).alias("line"))
    raise ValueError("what is pos, matrix or words")
