"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(*parts: Column | str) -> Column:
    """First 8 hex digits of the SHA-1 over the parts joined by a vertical bar."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *cols).cast("binary")), 1, 8)


def block_id(book: Column, ord_: Column) -> Column:
    return short_id(book, ord_)


def section_id(book: Column, ord_: Column) -> Column:
    return short_id(book, "section", ord_)


def chunk_id(book: Column, ord_: Column) -> Column:
    return F.concat(F.lit("chk_"), short_id(book, "chunk", ord_))


#: Accented Latin letters and the plain letters they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def squeeze(c: Column) -> Column:
    """Lower case with blank runs collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def bround_pct(part: Column, total: Column) -> Column:
    """part / total in percent, one decimal, halves to even, computed in decimals."""
    d = lambda x: x.cast("decimal(18,0)")
    return F.bround((d(part) * 100 / F.coalesce(F.nullif(d(total), F.lit(0)), F.lit(1))).cast("decimal(20,6)"), 1).cast("double")


def let(value: Column, use) -> Column:
    """use(value), with the value written and computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def only_if(value: Column, test) -> Column:
    """The value where test(value) holds, else null; computed once."""
    return F.get(F.filter(F.array(value), test), F.lit(0))
