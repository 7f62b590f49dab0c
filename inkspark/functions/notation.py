"""Columns that read the notations of a corpus: accents, language labels, registers, file paths.

All of these are built-in expressions, so they stay in whole-stage codegen and can be pushed into any plan.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What people write for the six languages. Codes are ISO 639-1, 639-2/T and 639-2/B; then English and own names.
LANGUAGE_NAMES = {
    "en": ["en", "eng", "english", "anglais", "englisch", "ingles", "inglese", "engels"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "aleman", "tedesco", "duits"],
    "fr": ["fr", "fra", "fre", "french", "francais", "franzosisch", "frances", "francese", "frans"],
    "es": ["es", "spa", "spanish", "espanol", "castellano", "castilian", "espagnol", "spanisch", "spagnolo", "spaans"],
    "it": ["it", "ita", "italian", "italiano", "italien", "italienisch", "italiaans"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "niederlandisch", "neerlandais", "neerlandes", "olandese", "flemish", "vlaams"],
}


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks, and their bare letters, from the Unicode decompositions."""
    marked, bare = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base != chr(code) and base.isascii():
            marked.append(chr(code))
            bare.append(base)
    return "".join(marked) + "øØłŁđĐ", "".join(bare) + "oOlLdD"


_MARKED, _BARE = _fold_table()


def fold_accents(c: Column) -> Column:
    """Latin letters without their marks, composed or combining; ligatures are written out. Null stays null."""
    c = F.translate(c, _MARKED, _BARE)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"\p{M}+", "")


def label_language(label: Column) -> Column:
    """en, de, fr, es, it or nl if the label names just that one, in any usual notation; else null.

    A region, script or encoding after the language (``de-AT``, ``fr_CA.UTF-8``, ``English (US)``) is ignored. Null, blank,
    ``und``, ``mul``, ``zxx`` and the like name none, and so does a list of different languages.
    """
    words = F.filter(F.split(F.lower(fold_accents(F.trim(label))), r"[,;/+&|]|\s+and\s+"), lambda x: F.length(F.trim(x)) > 0)
    table = F.create_map(*[F.lit(x) for lang, names in LANGUAGE_NAMES.items() for n in names for x in (n, lang)])
    heads = F.transform(words, lambda w: F.try_element_at(table, F.regexp_extract(w, r"([a-z]+)", 1)))
    named = F.array_distinct(heads)
    return F.when(F.size(named) == 1, F.try_element_at(named, F.lit(1)))


def register_of(register: Column, slug: Column | None = None) -> Column:
    """A register in its plain spelling (trimmed, lower case); where it is null or blank, that of the slug or path."""
    plain = F.nullif(F.lower(F.regexp_replace(register, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))
    if slug is None:
        return plain
    return F.coalesce(plain, F.nullif(F.regexp_extract(F.lower(slug), r"([a-z]+)[-_ ]*pg[-_ ]*\d", 1), F.lit("")))


def ebook_of(name: Column) -> Column:
    """The ebook number in a slug, path or cluster name, however written; null where there is none."""
    return F.regexp_extract(F.lower(name), r"pg[^0-9a-z]*0*([0-9]{1,18})", 1).try_cast("bigint")


def part_of(path: Column) -> Column:
    """The part number in a path, however written; null where there is none."""
    return F.regexp_extract(F.lower(path), r"part[^0-9a-z]*0*([0-9]{1,18})", 1).try_cast("bigint")
