"""Section labels: their kind, printed number and cleaned form, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexloom.functions.columns import let, only_if

# Keywords that decide a label's kind, found anywhere in its lower-case form.
PROLOGUE = ("prologue", "引子", "楔子")
EPILOGUE = ("epilogue", "尾声", "终章")
FRONT = ("cover", "title page", "titlepage", "half title", "copyright", "contents", "table of contents", "toc", "dedication", "foreword", "preface", "introduction",
         "acknowledgments", "frontispiece", "list of figures", "list of tables", "前言", "序言", "自序", "译者", "目录", "版权", "献辞", "导言", "扉页", "插图目录")
BACK = ("afterword", "appendix", "glossary", "index", "bibliography", "colophon", "notes", "references", "about the author", "further reading",
        "附录", "索引", "参考文献", "后记", "作者简介", "延伸阅读")
# Structural tokens of e-book files and the kinds they stand for.
STRUCTURE = {
    "cover": "cover", "halftitlepage": "titlepage", "titlepage": "titlepage", "copyright-page": "front_matter", "toc": "toc", "landmarks": "front_matter",
    "loi": "front_matter", "lot": "front_matter", "preamble": "front_matter", "dedication": "front_matter", "preface": "preface", "foreword": "foreword",
    "introduction": "introduction", "acknowledgments": "front_matter", "frontmatter": "front_matter", "prologue": "prologue", "chapter": "chapter", "part": "chapter",
    "subchapter": "chapter", "epilogue": "epilogue", "bodymatter": "chapter", "afterword": "afterword", "appendix": "appendix", "glossary": "glossary", "index": "index",
    "bibliography": "bibliography", "colophon": "back_matter", "backmatter": "back_matter"}
UNITS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
TEENS = ("ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
# Forms of chapter markers. Chinese numbers are counted with 章 alone.
ZH_NUMBER = r"第\s*([0-9零一二三四五六七八九十百千两]+)\s*章"
EXPLICIT = r"^\s*(?i:chapter|part|book)\s+(?i:[0-9]+|[ivxlcdm]+)\b"
MARKED = r"^\s*(?:CHAPTER|Chapter|chapter|PART|Part|part|BOOK|Book|book)\b"
ROMAN_ORDER = (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))
#: A canonical Roman numeral from 1 to 3999.
ROMAN = r"M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"


def _group(text: Column, pattern: str, i: int = 1) -> Column:
    """A group of the first match, null where it is absent or empty."""
    return only_if(F.regexp_extract(text, pattern, i), lambda v: v != "")


def roman_value(text: Column) -> Column:
    """The value of a canonical Roman numeral of either case, else null."""
    letter = F.create_map(*[x for c, v in ROMAN_ORDER if len(c) == 1 for x in (F.lit(c), F.lit(v))])

    def total(t: Column) -> Column:
        values = F.transform(F.split(t, ""), lambda c: F.coalesce(letter[c], F.lit(0)))
        return F.aggregate(F.reverse(values), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, v: F.struct(
            F.when(v < s["last"], s["sum"] - v).otherwise(s["sum"] + v).alias("sum"), v.alias("last")), lambda s: s["sum"])

    return let(F.upper(text), lambda t: F.when((F.length(t) > 0) & t.rlike(f"^{ROMAN}$"), total(t)))


def _zh_below_hundred(text: Column) -> Column:
    """Tens and units, or a row of digits read by place; null for no number, 0 only for 零十."""
    shape = "^([零一二三四五六七八九两]?)十([零一二三四五六七八九两]?)$"
    digits = lambda c: F.translate(c, "零一二三四五六七八九两", "01234567892").try_cast("int")
    place = lambda t, i, absent: let(F.regexp_extract(t, shape, i), lambda c: F.when(c == "", absent).otherwise(digits(c)))
    return let(text, lambda t: F.when(t.rlike(shape), place(t, 1, 1) * 10 + place(t, 2, 0)).when(
        t.rlike("^[零一二三四五六七八九两]+$"), only_if(digits(t), lambda v: v > 0)))


def zh_value(text: Column) -> Column:
    """The value of a Chinese numeral up to the hundreds, else null."""
    shape = "^([零一二三四五六七八九两]?)百(.*)$"

    def value(t: Column) -> Column:
        head, rest = F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2)
        hundreds = F.when(head == "", 1).otherwise(F.translate(head, "零一二三四五六七八九两", "01234567892").try_cast("int")) * 100
        return F.when(t.rlike(shape), hundreds + F.when(rest == "", 0).otherwise(_zh_below_hundred(rest))).otherwise(_zh_below_hundred(t))

    return only_if(let(text, value), lambda v: v > 0)


def word_value(text: Column) -> Column:
    """The value of one English number word, or of tens and units; null for any other words."""
    def value(parts: Column) -> Column:
        at = lambda names, i: F.array_position(F.array(*map(F.lit, names)), F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
        return let(F.struct(at(TENS, 0).alias("ten"), at(UNITS, 1).alias("unit"), at(UNITS, 0).alias("one"), at(TEENS, 0).alias("teen")), lambda x: (
            F.when(F.size(parts) > 1, F.when((x["ten"] > 0) & (x["unit"] > 0), x["ten"] * 10 + 10 + x["unit"]))
            .when(x["ten"] > 0, x["ten"] * 10 + 10).when(x["one"] > 0, x["one"]).when(x["teen"] > 0, x["teen"] + 9)).cast("int"))

    return let(F.split(F.lower(text), r"[-\s]"), value)


def printed_number(label: Column) -> Column:
    """The chapter number that a label prints, null for none.

    In order: Chinese form (if it matches but has no value there is no number), Arabic after a marker,
    bare Arabic alone or before a mark, Roman (after a marker in either case, else upper case alone or
    before a full stop), English words after a marker.
    """
    zh = _group(label, ZH_NUMBER)
    arabic = F.coalesce(_group(label, r"^\s*(?i:chapter|part|book)\s*([0-9]+)\b"), _group(label, r"^\s*([0-9]+)(?:\s*$|\s*[.:：、—–-])"))
    roman = F.when(label.rlike(MARKED), _group(label, MARKED + r"\s*((?i:[ivxlcdm]+))\b")).otherwise(_group(label, r"^\s*([IVXLCDM]+)(?:\s*$|\s*\.)"))
    word = word_value(_group(label, r"^\s*(?i:chapter|part|book)\s+([A-Za-z]+(?:[-\s][A-Za-z]+)?)\b"))
    other = F.coalesce(arabic.try_cast("int"), roman_value(roman), word)
    number = let(zh, lambda z: F.when(z.isNotNull(), F.coalesce(F.when(z.rlike("^[0-9]+$"), z.try_cast("int")), zh_value(z))).otherwise(other))
    return only_if(number, lambda v: v > 0).cast("int")


def _any(label: Column, words: tuple[str, ...]) -> Column:
    return F.lower(label).rlike("|".join(words))


def section_kind(label: Column) -> Column:
    """chapter, prologue, epilogue, back_matter, front_matter or other, tested in this order."""
    return (F.when(label.rlike(EXPLICIT), "chapter").when(_any(label, PROLOGUE), "prologue").when(_any(label, EPILOGUE), "epilogue")
            .when(_any(label, BACK), "back_matter").when(_any(label, FRONT), "front_matter").when(printed_number(label).isNotNull(), "chapter").otherwise("other"))


def structural_kind(tokens: Column) -> Column:
    """The kind of the first known token of a blank-separated list."""
    kinds = F.create_map(*[F.lit(x) for kv in STRUCTURE.items() for x in kv])
    return F.get(F.filter(F.transform(F.split(F.lower(tokens), r"\s+"), lambda t: kinds[t]), lambda k: k.isNotNull()), F.lit(0))


def resolve_kind(label: Column, override: Column) -> Column:
    """The override's kind unless it is absent or other."""
    return F.coalesce(F.nullif(override, F.lit("other")), section_kind(label))


def resolve_number(label: Column, kind: Column) -> Column:
    return F.when(kind == "chapter", printed_number(label))


def sanitize_label(title: Column, filename: Column) -> Column:
    """A title without control characters, at most 200 characters; else the file's decoded stem; else Untitled."""
    clean = lambda c: F.nullif(F.substring(F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")), 1, 200), F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(clean(title), clean(F.try_url_decode(stem)), F.lit("Untitled"))
