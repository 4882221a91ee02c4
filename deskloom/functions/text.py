"""Text expressions: trimming, normalising, tokens."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from deskloom import fixed, kernels


def strip(text: Column) -> Column:
    """Trim all Unicode white space."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once, however often they are used.

    A projection may be merged into the Python step or projection above it, and
    a later filter pushed below it, which repeats its work; a generator of one
    row is not.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(values)))


def null_safe(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def squeeze(text: Column) -> Column:
    """Collapse every white-space run to one blank."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return kernels.nfkc(text)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def nfkc(text: Column) -> Column:
    # ASCII text is its own NFKC form: only the other rows travel to Python.
    return F.coalesce(_nfkc(F.when(~is_ascii(text), text)), text)


def drop_disguise(text: Column) -> Column:
    """Remove invisible characters, map Cyrillic look-alikes, squeeze blanks.

    ASCII text has nothing to remove or map, and blanks to squeeze only if it
    holds two in a row or another white space than blank and line feed.
    """
    visible = F.regexp_replace(text, fixed.INVISIBLE, "")
    latin = F.translate(visible, fixed.CYRILLIC, fixed.CYRILLIC_AS_LATIN)
    blanks = r"(?U)[^\S\n]+"
    uneven = F.rlike(text, F.lit(r"[\t\x0B\f\r\x1C-\x1F]|  "))
    return (
        F.when(~is_ascii(text), F.regexp_replace(latin, blanks, " "))
        .when(uneven, F.regexp_replace(text, blanks, " "))
        .otherwise(text)
    )


def normalise(text: Column) -> Column:
    """NFKC, then the disguises removed; letter case is kept."""
    return drop_disguise(nfkc(text))


def words(text: Column, stop_words=fixed.STOP_WORDS) -> Column:
    """Lower-case words of two or more characters without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(fixed.WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(list(stop_words))) if stop_words else found


def words_and_pairs(tokens: Column) -> Column:
    """The words followed by their neighbouring pairs."""
    size = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(size - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(size - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(tokens, pairs)


def contained(text: Column, keywords) -> Column:
    """The keywords a text contains, in list order."""
    listed = F.array(*[F.lit(k) for k in keywords])
    return F.filter(listed, lambda k: F.contains(text, k))
