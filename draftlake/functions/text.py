"""Text content of drawing entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space, of any script, at either end."""
    return F.regexp_replace(text, rf"^[{_SPACE}]+|[{_SPACE}]+$", "")


def plain_multiline(text: Column) -> Column:
    r"""Multi-line text without its format codes, in one line.

    ``\P``, ``\N`` and ``\X`` end a line (here a space), ``\~`` is a space; ``\H``, ``\F``, ``\C`` and the like go with what
    they set up to the semicolon, ``\L`` and the like and braces alone; ``\S1/2;`` stacks give ``1/2``; ``%%d``, ``%%p`` and ``%%c`` are signs.
    """
    t = F.regexp_replace(text, r"\\\\", "\x01")
    t = F.regexp_replace(t, r"\\\{", "\x02")
    t = F.regexp_replace(t, r"\\\}", "\x03")
    t = F.regexp_replace(t, r"\\[PNX]|\^J", " ")
    t = F.regexp_replace(t, r"\^I", "\t")
    t = F.regexp_replace(t, r"\\~", " ")
    t = F.regexp_replace(t, r"\\S([^;^#/]*)[\^#/]([^;]*);", "$1/$2")
    t = F.regexp_replace(t, r"\\S([^;]*);", "$1")
    t = F.regexp_replace(t, r"\\[ACFHQTWacfhqtwp][^;\\]*;", "")
    t = F.regexp_replace(t, r"\\[LlOoKk]", "")
    t = F.regexp_replace(t, r"[{}]", "")
    t = F.regexp_replace(t, "(?i)%%d", "°")
    t = F.regexp_replace(t, "(?i)%%p", "±")
    t = F.regexp_replace(t, "(?i)%%c", "Ø")
    t = F.translate(t, "\x01\x02\x03\n", "\\{} ")
    return F.regexp_replace(t, "\r", "")


def content(dxftype: Column, text: Column) -> Column:
    """The stripped text of TEXT as it is, of MTEXT without format codes."""
    return strip(F.coalesce(F.when(dxftype == "MTEXT", plain_multiline(text)).otherwise(text), F.lit("")))
