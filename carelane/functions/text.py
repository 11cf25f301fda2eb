"""Text functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes, here and on the driver.
WHITE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACE = f"[{''.join(f'\\u{ord(c):04x}' for c in WHITE)}]"


def trimmed(x: Column) -> Column:
    """Without any white space at both ends, not only spaces."""
    return F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", "")


def contains_folded(x: Column, term: str) -> Column:
    """Case-insensitive substring; a null text counts as empty, an empty term is in every text."""
    return F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lower(F.lit(term)))


def initials(x: Column, separator: str = " ") -> Column:
    """First characters of the parts of a text."""
    return F.array_join(F.transform(F.split(x, separator), lambda p: F.substring(p, 1, 1)), "")


def capitalised(x: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))


def plural(n: Column, suffix: str = "s") -> Column:
    """The suffix unless n is one."""
    return F.when(n != 1, suffix).otherwise("")


def joined_name(*parts: Column, separator: str = " ") -> Column:
    """Parts that are there, joined."""
    return F.concat_ws(separator, *parts)
