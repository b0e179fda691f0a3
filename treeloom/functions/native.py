"""The notation in built-in column expressions: quoting, rows, flat documents, minifying.

Nothing here leaves the JVM. Values follow the same rules as the kernel's, for flat data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions import lexical as lex

_VALUE_CLASS = r'[ \t:"\\;@#{}\[\]\n\r]'
_KEY_CLASS = r'[ \t:"\\;@#{}\[\],\n\r]'
_EDGE = rf"^[{lex.BLANK}]|[{lex.BLANK}]$"
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: A piece between delimiters: quoted, or without one.
PIECE = {d: rf'(?:^|{e})[ ]*("(?:[^"\\]|\\.)*"|[^"{e}][^{e}]*|)' for d, e in ((",", ","), ("|", r"\|"), ("\t", r"\t"))}


def escape(s: Column) -> Column:
    """Backslash first, so that no escape is escaped again."""
    for raw, letter in lex.ESCAPES.items():
        s = F.replace(s, F.lit(raw), F.lit("\\" + letter))
    return s


def unescape(s: Column) -> Column:
    """Pairs of backslashes part the string; between them the other escapes are read."""

    def read(piece: Column) -> Column:
        for raw, letter in lex.ESCAPES.items():
            if raw != "\\":
                piece = F.replace(piece, F.lit("\\" + letter), F.lit(raw))
        return piece

    return F.array_join(F.transform(F.split(s, r"\\\\", -1), read), "\\")


def quote(s: Column) -> Column:
    return F.concat(F.lit('"'), escape(s), F.lit('"'))


def write_string(s: Column, delimiter: str = ",") -> Column:
    safe = (s != "") & ~s.isin("true", "false", "null") & ~s.rlike(r"^[0-9+.-]") & ~s.rlike(_VALUE_CLASS) & ~F.contains(s, F.lit(delimiter)) & ~s.rlike(_EDGE)
    return F.when(safe, s).otherwise(quote(s))


def write_key(s: Column) -> Column:
    safe = (s != "") & ~s.rlike(_KEY_CLASS) & ~s.rlike(_EDGE) & ~s.isin(*lex.DEFINITION_KINDS)
    return F.when(safe, s).otherwise(quote(s))


def write_double(x: Column) -> Column:
    """Doubles as the notation writes them: no exponent for 1e-5 <= |x| < 1e16."""
    text = x.cast("string")
    scale = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"[-.]", "")
    digits = F.regexp_replace(digits, r"(?<=.)0+$", "")
    point = scale + 1
    whole = F.concat(sign, F.rpad(F.substring(digits, F.lit(1), F.least(point, F.length(digits))), point, "0"), F.lit("."), F.when(F.length(digits) > point, F.substring(digits, point + 1, F.length(digits))).otherwise("0"))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    rest = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise("")
    science = F.concat(sign, F.substring(digits, 1, 1), rest, F.lit("e"), scale.cast("string"))
    word = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    wide = F.when((point > 0) & (point <= 16), whole).when((point > -5) & (point <= 0), small).otherwise(science)
    return F.when(word.isNotNull(), word).when(F.contains(text, F.lit("E")), wide).otherwise(text)


def write_primitive(value: Column, kind: T.DataType, delimiter: str = ",") -> Column:
    """Any Spark scalar; what the notation lacks (times, decimals, binary) becomes a string."""
    if isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = write_double(value.cast("double"))
    elif isinstance(kind, T.BinaryType):
        text = write_string(F.base64(value), delimiter)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = write_string(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), delimiter)
    else:
        text = write_string(value.cast("string"), delimiter)
    return F.coalesce(text, F.lit("null"))


def write_row(fields: list[T.StructField], delimiter: str = ",", source: str = "") -> Column:
    """A tabular row of a frame's columns."""
    return F.concat_ws(f"{delimiter} ", *[write_primitive(F.col(f"{source}`{f.name}`"), f.dataType, delimiter) for f in fields])


def header(name: str, count: Column, fields: list[str], delimiter: str = ",") -> Column:
    mark = delimiter if delimiter in "\t|" else ""
    return F.concat(F.lit((lex.write_key(name) if name else "") + "["), count.cast("string"), F.lit(f"{mark}]{{{delimiter.join(map(lex.write_key, fields))}}}:"))


def write_flat(fields: list[T.StructField]) -> Column:
    """A flat document: one key and value a line."""
    return F.concat_ws("\n", *[F.concat(F.lit(lex.write_key(f.name) + ": "), write_primitive(F.col(f"`{f.name}`"), f.dataType)) for f in fields])


def write_inline(name: str, values: Column, kind: T.DataType) -> Column:
    """key[N]: a, b, c from an array of scalars."""
    items = F.transform(values, lambda v: write_primitive(v, kind))
    return F.when(F.size(values) > 0, F.concat(F.lit(lex.write_key(name) + "["), F.size(values).cast("string"), F.lit("]: "), F.array_join(items, ", "))).otherwise(F.lit(f"{lex.write_key(name)}: []"))


def split_row(line: Column, delimiter: str = ",") -> Column:
    """The raw pieces of a row, without the delimiters inside quotes."""
    return F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(PIECE[delimiter].replace("(?:^|", "(?:")), F.lit(1))


def read_string(piece: Column) -> Column:
    piece = F.trim(piece)
    return F.when(piece.startswith('"'), unescape(F.substring(piece, F.lit(2), F.length(piece) - 2))).otherwise(piece)


def classify(piece: Column) -> Column:
    """The kind of a raw primitive."""
    piece = F.trim(piece)
    whole = F.when(piece.try_cast("bigint").isNotNull(), "int").otherwise("float")
    return (
        F.when(piece.startswith('"') | (piece == ""), "str").when(piece.isin("true", "false"), "bool").when(piece == "null", "null")
        .when(piece.rlike(INTEGER), whole).when(piece.rlike(NUMBER), "float").otherwise("str")
    )


def read_primitive(piece: Column, kind: T.DataType) -> Column:
    """A raw piece as a wanted Spark type; null where it is null or of another kind."""
    text = F.trim(piece)
    value = F.when(text == "null", None).otherwise(read_string(piece))
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(text.rlike(NUMBER), text.try_cast(kind)).when(text.isin("NaN", "inf", "-inf"), F.replace(text, F.lit("inf"), F.lit("Infinity")).try_cast(kind))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.when(text.rlike(INTEGER), text.try_cast(kind))
    if isinstance(kind, T.BooleanType):
        return F.when(text.isin("true", "false"), text.try_cast(kind))
    if isinstance(kind, T.BinaryType):
        return F.unbase64(value)
    return value.try_cast(kind)


def minify(text: Column) -> Column:
    """Semicolons for lines, by the depth of each line and what the line before opened."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    blank = rf"^[{lex.BLANK}]+|[{lex.BLANK}]+$"
    blanks = lambda s: F.length(s) - F.length(F.ltrim(s))
    shown = F.transform(lines, lambda s: F.struct(F.regexp_replace(s, blank, "").alias("body"), blanks(s).alias("blanks")))
    directive = r"^#![a-z]+/"
    kept = F.filter(shown, lambda x: (x["body"] != "") & (~x["body"].startswith("#") | x["body"].rlike(directive)))

    def joined(rows: Column, step: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("inside"), F.lit(True).alias("first"))

        def add(acc: Column, x: Column) -> Column:
            depth = F.floor(x["blanks"] / step).cast("int")
            gap = F.when(acc["first"], F.lit("")).otherwise(F.repeat(F.lit(";"), F.greatest(F.lit(0), acc["inside"] - depth) + 1))
            opens = (x["body"].endswith(":") | x["body"].startswith("- ")).cast("int")
            line = F.struct(F.concat(acc["out"], gap, x["body"]).alias("out"), (depth + opens).alias("inside"), F.lit(False).alias("first"))
            note = F.struct(F.concat(acc["out"], x["body"], F.lit(";")).alias("out"), acc["inside"].alias("inside"), acc["first"].alias("first"))
            return F.when(x["body"].startswith("#"), note).otherwise(line)

        return F.aggregate(rows, start, add, lambda acc: acc["out"])

    indented = F.filter(shown, lambda x: (x["blanks"] > 0) & (x["body"] != "") & ~x["body"].startswith("#"))
    second = F.get(shown, F.lit(1))
    step = F.when((second["blanks"] > 0) & (second["body"] != ""), second["blanks"]).otherwise(F.coalesce(F.get(indented, F.lit(0))["blanks"], F.lit(1)))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return let(step, lambda s: let(kept, lambda rows: joined(rows, s)))
