"""Column helpers with exact Unicode text semantics: white space, stripping, title case, base64."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: the 29 code points of Unicode White_Space and U+001C..U+001F.
WS = r"[\s\x1c-\x1f]"
NON_WS = r"[^\s\x1c-\x1f]"
#: One by one, for a class of single characters is one look-up, a class of ranges several tests.
BASE64_CHARS = string.ascii_letters + string.digits + "+/"
BASE64 = rf"^[{BASE64_CHARS}]*={{0,2}}\z"


#: The same as characters: trimming them needs no pattern.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has(c: Column | str, pattern: str) -> Column:
    """Whether the pattern is found; (?U) makes classes Unicode, (?s) lets a dot match anything."""
    return col(c).rlike("(?Us)" + pattern)


def sub(c: Column | str, pattern: str, to: str) -> Column:
    return F.regexp_replace(col(c), "(?Us)" + pattern, to)


def group(c: Column | str, pattern: str, n: int) -> Column:
    """Group n of the first match, the empty string where there is none."""
    return F.regexp_extract(col(c), "(?Us)" + pattern, n)


def lstrip(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(WHITE))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(WHITE))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITE))


def is_blank(c: Column | str) -> Column:
    return ~has(c, NON_WS)


def words(c: Column | str) -> Column:
    """Runs of characters that are not white space."""
    return F.filter(F.split(col(c), f"(?U){WS}+", -1), lambda w: w != "")


def last_char(c: Column | str) -> Column:
    return F.right(col(c), F.lit(1))


def title_case(c: Column | str) -> Column:
    """Each run of letters with its first letter in upper case, the others in lower case."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))

    def run(r: Column) -> Column:
        first = F.upper(F.left(r, F.lit(1)))  # two letters for sharp s, of which the second is small
        return F.concat(F.left(first, F.lit(1)), F.lower(F.substr(first, F.lit(2))), F.lower(F.substr(r, F.lit(2))))

    return F.array_join(F.transform(runs, run), "")


def base64_plain(c: Column | str) -> Column:
    """Base64 without the line breaks that the built-in puts in."""
    return F.replace(F.base64(col(c)), F.lit("\r\n"), F.lit(""))


def base64_strict(c: Column | str) -> Column:
    """Bytes of strict base64 text, null if it holds other characters or lacks padding."""
    bytes_of = lambda s: F.when(F.length(s) % 4 == 0, F.try_to_binary(s, F.lit("base64")))
    clean = sub(c, WS, "")
    return F.when(has(c, BASE64), bytes_of(col(c))).when(has(clean, BASE64), bytes_of(clean))
