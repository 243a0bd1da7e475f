"""Cleaning and defanging of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"(?<![\d.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![\d.])"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A run of name characters that is a dotted name with an alphabetic last label.
NAME = r"^(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_text(value: Column, most: int) -> Column:
    """Controls to blanks, format characters out, white space collapsed; null if nothing is left."""
    plain = F.regexp_replace(value, r"\p{Cf}", "")
    plain = F.trim(F.regexp_replace(plain, r"(?U)[\p{Cc}\s]+", " "))
    # Printable ASCII words with single blanks between them are clean.
    plain = F.when(value.rlike("[^ -~]|^ | $|  "), plain).otherwise(value)
    return F.nullif(F.left(plain, F.lit(most)), F.lit(""))


def refang(value: Column) -> Column:
    value = F.regexp_replace(value, "(?i)^hxxps:", "https:")
    value = F.regexp_replace(value, "(?i)^hxxp:", "http:")
    return F.replace(F.replace(value, F.lit("[.]"), F.lit(".")), F.lit("[:]"), F.lit(":"))


def defang_host(host: Column) -> Column:
    bare = F.regexp_replace(host, r"^\[(.*)\]$", "$1")
    return F.when(F.contains(bare, F.lit(":")), F.replace(bare, F.lit(":"), F.lit("[:]"))).otherwise(F.replace(bare, F.lit("."), F.lit("[.]")))


def defang_ipv4(value: Column) -> Column:
    return F.regexp_replace(value, IPV4, "$1[.]$2[.]$3[.]$4")


def is_ipv6(value: Column) -> Column:
    """Whether a bare text is an IPv6 address: eight groups, or fewer with one ``::``."""

    def test(x: Column) -> Column:
        groups = F.split(x, ":")
        given = F.size(F.filter(groups, lambda g: g != ""))
        well = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{0,4}$")) & ~F.contains(x, F.lit(":::")) & ~x.rlike("(?:^:[^:])|(?:[^:]:$)")
        gaps = (F.length(x) - F.length(F.replace(x, F.lit("::"), F.lit("")))) / 2
        return well & (((gaps == 0) & (F.size(groups) == 8) & (given == 8)) | ((gaps == 1) & (given <= 7)))

    return bound(F.regexp_replace(value, rf"(?<=:)(?:{OCTET}\.){{3}}{OCTET}$", "0:0"), test)


def _by_runs(value: Column, pattern: str, changed: Callable[[Column], Column]) -> Column:
    """A text with each match of ``pattern``, which must match everywhere, replaced by ``changed`` of it."""
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), changed), "")


def defang_names(value: Column) -> Column:
    """Dots in dotted names bracketed; a name is a whole run of letters, digits, dots and hyphens."""
    return _by_runs(value, r"(?s)[A-Za-z0-9.-]+|[^A-Za-z0-9.-]+", lambda run: F.when(run.rlike(NAME), F.replace(run, F.lit("."), F.lit("[.]"))).otherwise(run))


def defang_ipv6(value: Column) -> Column:
    """Colons in IPv6 addresses, with or without square brackets, bracketed."""

    def changed(run: Column) -> Column:
        bare = F.regexp_replace(run, r"^\[|\]$", "")
        return F.when(F.contains(run, F.lit(":")) & is_ipv6(bare), F.replace(bare, F.lit(":"), F.lit("[:]"))).otherwise(run)

    return _by_runs(value, r"(?s)\[?[0-9A-Fa-f:]+\]?|[^0-9A-Fa-f:]", changed)


def safe_host(value: Column) -> Column:
    """A hosting description with addresses and names defanged."""
    return F.when(value.isNotNull(), bound(clean_text(value, 160), lambda x: F.when(x.isNotNull(), defang_names(F.when(F.contains(x, F.lit(":")), defang_ipv6(defang_ipv4(x))).otherwise(defang_ipv4(x))))))
