"""Text and list column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0            "
    "    　"
)


def blank(c: Column) -> Column:
    """Null text as the empty string."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends; plain `trim` only knows U+0020."""
    return F.btrim(c, F.lit(WHITESPACE))


def non_empty(c: Column) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(c, F.lit(""))


def computed_once(c: Column) -> Column:
    """`non_empty` for costly expressions: a comparison and a result would each evaluate `c`."""
    return F.get(F.filter(F.array(c), lambda text: text != ""), F.lit(0))


def split_list(c: Column, sep: str = ";") -> Column:
    """Split on `sep` and strip each item; null and '' give one empty item."""
    return F.transform(F.split(blank(c), f"\\Q{sep}\\E"), strip)


def clean_list(c: Column, sep: str = ";") -> Column:
    """Split on `sep`, strip and keep only the non-empty items."""
    return F.filter(split_list(c, sep), lambda item: item != "")


def join_list(c: Column, sep: str = ";") -> Column:
    """Join the non-null items; a null list gives ''."""
    return blank(F.array_join(c, sep))


def first_item(c: Column) -> Column:
    """First item of a list; '' for a null list, null for an empty one."""
    return F.when(c.isNotNull(), F.get(c, F.lit(0))).otherwise(F.lit(""))


def embedding_text(title: Column, abstract: Column) -> Column:
    """Title and abstract as one text, separated by an empty line."""
    return strip(F.concat(blank(title), F.lit("\n\n"), blank(abstract)))


def first_sentences(c: Column, n: int) -> Column:
    """The first `n` non-empty sentences, each closed with a full stop."""
    chunks = F.transform(F.split(F.replace(blank(c), F.lit("\n"), F.lit(" ")), "\\."), strip)
    filled = F.filter(chunks, lambda s: s != "")
    return F.transform(F.slice(filled, 1, n), lambda s: F.concat(s, F.lit(".")))
