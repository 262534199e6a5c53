"""Column helpers for text; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters folded to their plain form by entity keys.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# HTML entities decoded by page_text, the ampersand last.
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
]


def terms(col: Column | str) -> Column:
    """Lower-case runs of letters, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"\p{L}+"), F.lit(0))


def pieces(col: Column | str) -> Column:
    """Runs of non-blank characters, in order; a run over 64 characters is split,
    so that a window of pieces has a bounded length."""
    return F.regexp_extract_all(col, F.lit(r"\S{1,64}"), F.lit(0))


def fold(col: Column | str) -> Column:
    """Key of a surface form: lower case, no accents, letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(col), ACCENTED, PLAIN), r"[^\p{L}\p{N}]", "")


def squeeze(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(col, r"[ \t\r\n\f]+", " "))


def decode_entities(col: Column) -> Column:
    for name, char in ENTITIES:
        col = F.replace(col, F.lit(name), F.lit(char))
    return col


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row.

    A lambda body that names an outer expression evaluates it again for each element;
    as the variable of an enclosing one-element transform it is evaluated once.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def ngrams(arr: Column, n: int) -> Column:
    """Space-joined n-grams of an array of strings."""

    def windows(a: Column) -> Column:
        count = F.size(a) - F.lit(n - 1)
        return F.when(
            count > 0,
            F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(a, i, n), " ")),
        ).otherwise(F.array().cast("array<string>"))

    return let(arr, windows)
