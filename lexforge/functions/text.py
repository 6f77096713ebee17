"""Scalar functions on columns: escaping, trimming, naming, binary forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the languages of a dictionary header.
LANGUAGES: dict[int, str] = {
    1025: "Arabic", 1026: "Bulgarian", 1027: "Catalan", 1028: "Chinese", 1029: "Czech", 1030: "Danish", 1031: "German", 1032: "Greek", 1033: "English",
    1034: "Spanish", 1035: "Finnish", 1036: "French", 1037: "Hebrew", 1038: "Hungarian", 1039: "Icelandic", 1040: "Italian", 1041: "Japanese", 1042: "Korean",
    1043: "Dutch", 1044: "Norwegian", 1045: "Polish", 1046: "Portuguese", 1048: "Romanian", 1049: "Russian", 1050: "Croatian", 1051: "Slovak", 1052: "Albanian",
    1053: "Swedish", 1054: "Thai", 1055: "Turkish", 1057: "Indonesian", 1058: "Ukrainian", 1059: "Belarusian", 1060: "Slovenian", 1061: "Estonian", 1062: "Latvian",
    1063: "Lithuanian", 1065: "Persian", 1066: "Vietnamese", 1067: "Armenian", 1069: "Basque", 1071: "Macedonian", 1078: "Afrikaans", 1079: "Georgian", 1087: "Kazakh",
    1089: "Swahili", 1091: "Uzbek", 1092: "Tatar", 1142: "Latin",
}
#: Source-language names of descriptor files, by code.
DESCRIPTOR_LANGUAGES = {"deu": 1031, "enu": 1033, "fra": 1036, "esn": 1034, "ita": 1040, "rus": 1049}

#: Versions of dictionary files that can be decoded, with their decoder.
DECODERS: dict[int, str] = {
    0x110001: "user", 0x120001: "user", 0x132001: "user", 0x142001: "user", 0x152001: "user",
    0x131001: "user_legacy", 0x141004: "system", 0x151005: "system_xor", 0x145001: "abbreviation", 0x155001: "abbreviation",
}


def dsl_escape(text: Column) -> Column:
    """A backslash before each sign that means something in DSL."""
    return F.regexp_replace(text, r"([\[\]#~^@])", r"\\$1")


def heading_escape(text: Column) -> Column:
    """Brackets of a heading would mark optional parts."""
    return F.regexp_replace(text, r"([()])", r"\\$1")


def indented(body: Column) -> Column:
    """An article: a tab before each line, a line feed after the last."""
    return F.concat(F.lit("\t"), F.replace(body, F.lit("\n"), F.lit("\n\t")), F.lit("\n"))


def directive(name: str, value: Column) -> Column:
    """A header line; that of the name alone ends with a carriage return too."""
    return F.concat(F.lit(f"#{name}\t"), value, F.lit("\r\n" if name == "NAME" else "\n"))


def display_name(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t,;!?-."))


def audio_name(name: Column) -> Column:
    """``.adp`` in any case becomes ``.wav``, unless it is the whole name."""
    return F.regexp_replace(name, r"(?i)(.)\.adp$", "$1.wav")


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"\.[^./]*$", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def data_uri(content: Column, kind: str) -> Column:
    """Spark breaks base64 into lines; a URI has none."""
    return F.concat(F.lit(f"data:image/{kind.lower()};base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def hex_version(version: Column) -> Column:
    return F.lower(F.hex(version))


def version_part(version: Column, part: str) -> Column:
    shift, mask = {"major": (16, 0xFFFF), "minor": (12, 15), "revision": (0, 0xFFF)}[part]
    return F.shiftright(version, shift).bitwiseAND(F.lit(mask))


def decoder_of(version: Column) -> Column:
    out = F.lit("unsupported")
    for code, name in DECODERS.items():
        out = F.when(version == code, name).otherwise(out)
    return out


def bit_length(n: Column) -> Column:
    """Bits that a number takes; 1 for 0."""
    return F.greatest(F.lit(1), F.length(F.bin(n)))


def language_code(name: Column) -> Column:
    out = F.lit(0)
    for key, code in DESCRIPTOR_LANGUAGES.items():
        out = F.when(F.lower(name) == key, code).otherwise(out)
    return out


def utf16_bytes(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16LE"))


def collapse_breaks(text: Column, hard: str = "|") -> Column:
    """Leading breaks go; a run with a hard break (``hard``) keeps its hard ones, any other run keeps one line feed."""
    h = "\\" + hard
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, rf"^[\n{h}]+", ""), rf"\n*{h}\n*", h), r"\n{2,}", "\n")


def resource_entry(text: Column) -> Column:
    """``name;size`` as a struct, null for anything else."""
    rx = r"^(.+?);([0-9]+)$"
    return F.when(text.rlike(rx), F.struct(F.regexp_extract(text, rx, 1).alias("name"), F.regexp_extract(text, rx, 2).cast("long").alias("size")))


def rgb(text: Column) -> Column:
    """``RRGGBB`` or ``RR GG BB`` as a number; null if it is no colour."""
    rx = r"^([0-9a-fA-F]{2})\s?([0-9a-fA-F]{2})\s?([0-9a-fA-F]{2})$"
    return F.when(text.rlike(rx), F.conv(F.concat(*(F.regexp_extract(text, rx, k) for k in (1, 2, 3))), 16, 10).cast("int"))


def cell_width(columns: Column, span: Column) -> Column:
    """Per cent, by whole-number division before the span."""
    return F.floor(F.lit(100) / columns).cast("int") * span


def chars(text: Column, unsorted: str) -> Column:
    """Characters of a heading with their flags; those that match ``unsorted`` don't count in sorting, a backslash escapes the next."""
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)(\\?.)"), F.lit(1)), lambda c: c != "")
    return F.transform(parts, lambda c: F.struct(F.substring(c, -1, 1).alias("chr"), (~F.substring(c, -1, 1).rlike(unsorted)).alias("sorted"), (F.length(c) > 1).alias("escaped")))


def sort_key(heading: Column) -> Column:
    return F.array_join(F.transform(F.filter(heading, lambda c: c["sorted"]), lambda c: c["chr"]), "")


def dsl_text(heading: Column) -> Column:
    """The heading with each maximal unsorted run in braces and a backslash before escaped characters."""
    one = lambda c: F.concat(F.when(c["escaped"], "\\").otherwise(""), c["chr"])
    step = lambda acc, c: F.struct(
        F.concat(acc["out"], F.when(acc["open"] & c["sorted"], "}").when(~acc["open"] & ~c["sorted"], "{").otherwise(""), one(c)).alias("out"), (~c["sorted"]).alias("open")
    )
    return F.aggregate(heading, F.struct(F.lit("").alias("out"), F.lit(False).alias("open")), step, lambda acc: F.concat(acc["out"], F.when(acc["open"], "}").otherwise("")))
