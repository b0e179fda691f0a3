"""Words of the notation: quoting, primitive values, headers, references. Plain Python."""

from __future__ import annotations

import re
from typing import NamedTuple

# Fixed values of the notation.
UNSAFE_IN_VALUES = ' \t:"\\;@#{[]}'
UNSAFE_IN_KEYS = UNSAFE_IN_VALUES + ","
DEFINITION_KINDS = ("s", "r", "sec")
ESCAPES = {"\\": "\\", '"': '"', "\n": "n", "\r": "r", "\t": "t", ";": ";"}

#: Blank at the edges of lines and values: Unicode white space, not the information separators.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_QUOTED = r'"(?:[^"\\]|\\.)*"'
_NEEDS_ESCAPE = re.compile(r'[\\"\n\r\t;]')
# Line ends are unsafe too: a line of text is a line of the notation.
_UNSAFE_VALUE = re.compile(f"[{re.escape(UNSAFE_IN_VALUES)}\n\r]")
_UNSAFE_KEY = re.compile(f"[{re.escape(UNSAFE_IN_KEYS)}\n\r]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_INTEGER = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_HEADER = re.compile(
    rf"(?P<key>{_QUOTED}|[^\":\[{{}}]*)\[(?P<count>[^\]\t|]*)(?P<mark>[\t|]?)\]"
    rf"(?:\{{(?P<fields>(?:{_QUOTED}|[^\"}}])*)\}}|@(?P<kind>s|r|sec):(?P<name>[^:]*))?:(?P<rest>.*)",
    re.S,
)
_KEY = re.compile(rf"(?P<key>{_QUOTED})\s*:|(?P<bare>[^:\"{{]*):", re.S)
_REFERENCE = re.compile(r"@(s|r|sec):(\S+)")


class Header(NamedTuple):
    key: str | None
    count: int
    delimiter: str
    fields: list[str] | None
    ref: tuple[str, str] | None
    rest: str


def strip(text: str) -> str:
    return text.strip(BLANK)


def escape(text: str) -> str:
    return _NEEDS_ESCAPE.sub(lambda m: "\\" + ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    """One pass; an unknown escape stays as it is."""
    known = {v: k for k, v in ESCAPES.items()}
    return _ESCAPED.sub(lambda m: known.get(m[1], m[0]), text) if "\\" in text else text


def quote(text: str) -> str:
    return f'"{escape(text)}"'


def unquote(text: str) -> str:
    return unescape(text[1:-1]) if len(text) > 1 and text[0] == text[-1] == '"' else text


def write_string(text: str, delimiter: str = ",") -> str:
    plain = text and text not in ("true", "false", "null") and text[0] not in "0123456789+-." and not _UNSAFE_VALUE.search(text)
    return text if plain and delimiter not in text and text == strip(text) else quote(text)


def write_key(key: str) -> str:
    plain = key and not _UNSAFE_KEY.search(key) and key == strip(key) and key not in DEFINITION_KINDS
    return key if plain else quote(key)


def shortest_float(x: float) -> str:
    """Shortest digits that read back; exponents outside 1e-5 <= |x| < 1e16."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else ("inf" if x > 0 else "-inf")
    sign, digits, point = _decimal(x)
    if 0 < point <= 16:
        body = digits[:point].ljust(point, "0") + "." + (digits[point:] or "0")
    elif -5 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        body = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{point - 1}"
    return sign + body


def plain_float(x: float) -> str:
    """Shortest digits without an exponent, and without a zero fraction."""
    if x != x or x in (float("inf"), float("-inf")):
        return shortest_float(x)
    sign, digits, point = _decimal(x)
    if digits == "0":
        return sign + "0"
    if point <= 0:
        return sign + "0." + "0" * -point + digits
    return sign + digits[:point].ljust(point, "0") + ("." + digits[point:] if digits[point:] else "")


def _decimal(x: float) -> tuple[str, str, int]:
    """Sign, significant digits, and where the decimal point stands among them."""
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits, point = whole + fraction, len(whole) + int(exponent or 0)
    lead = len(digits) - len(digits.lstrip("0"))
    digits, point = digits[lead:].rstrip("0"), point - lead
    sign = "-" if str(x)[0] == "-" else ""
    return (sign, digits, point) if digits else (sign, "0", 1)


def write_primitive(value, delimiter: str = ",") -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return shortest_float(value)
    return write_string(value, delimiter)


def is_primitive(value) -> bool:
    return not isinstance(value, (dict, list))


def read_number(text: str):
    """An integer of 64 bits, else a double; None if text is neither."""
    if _INTEGER.fullmatch(text):
        n = int(text)
        return n if -(1 << 63) <= n < 1 << 63 else float(n)
    return float(text) if _FLOAT.fullmatch(text) else None


def read_scalar(text: str):
    """A primitive that is no reference."""
    text = strip(text)
    if text[:1] == '"':
        found = re.match(_QUOTED, text, re.S)
        return unescape(found[0][1:-1]) if found else text
    fixed = {"true": True, "false": False, "null": None}
    if text in fixed:
        return fixed[text]
    number = read_number(text) if text[:1] in tuple("0123456789+-.") and text else None
    return text if number is None else number


def is_reference(text: str) -> bool:
    return text.startswith(("@s:", "@r:", "@sec:"))


def read_reference(text: str) -> tuple[str, str] | None:
    found = _REFERENCE.fullmatch(strip(text))
    return (found[1], found[2]) if found else None


def split_top(text: str, delimiter: str) -> list[str]:
    """Split at delimiters outside quotes and brackets."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            found = re.compile(_QUOTED, re.S).match(text, i)
            i = found.end() if found else len(text)
            continue
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        elif c == delimiter and depth <= 0:
            out.append(text[start:i])
            start = i + 1
        i += 1
    return [*out, text[start:]]


def closes_at_end(text: str) -> bool:
    """Whether the bracket that text begins with closes as its last character."""
    depth, i = 0, 0
    while i < len(text):
        if text[i] == '"':
            found = re.compile(_QUOTED, re.S).match(text, i)
            if not found:
                return False
            i = found.end()
            continue
        depth += (text[i] in "{[") - (text[i] in "}]")
        if not depth:
            return i == len(text) - 1
        i += 1
    return False


def read_header(text: str) -> Header | None:
    found = _HEADER.fullmatch(text)
    if not found:
        return None
    key = strip(found["key"])
    count = strip(found["count"])
    delimiter = found["mark"] or ","
    fields = None if found["fields"] is None else [unquote(strip(f)) for f in split_top(found["fields"], delimiter)]
    ref = (found["kind"], strip(found["name"])) if found["kind"] else None
    return Header(unquote(key) if key else None, int(count) if count.isascii() and count.isdigit() else 0, delimiter, fields, ref, strip(found["rest"]))


def read_key(text: str) -> tuple[str, str] | None:
    """(key, what follows its colon), or None for text without a key; raises for a broken one."""
    if text[:1] == '"':
        found = re.match(_QUOTED, text, re.S)
        if not found:
            raise ValueError("Unterminated quoted key")
        if text[found.end() : found.end() + 1] != ":":
            raise ValueError("Missing colon after key")
        return unquote(found[0]), strip(text[found.end() + 1 :])
    found = _KEY.match(text)
    return (strip(found["bare"]), strip(text[found.end() :])) if found and found["bare"] is not None else None
