"""Scalar text helpers as Column -> Column builders (all JVM-side built-ins)."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as listed for results to agree).
# Numbers of character references that stand for a Windows-1252 character (from 128 on, in order;
# None: the number itself).
C1_NUMBERS = [8364, None, 8218, 402, 8222, 8230, 8224, 8225, 710, 8240, 352, 8249, 338, None, 381, None,
              None, 8216, 8217, 8220, 8221, 8226, 8211, 8212, 732, 8482, 353, 8250, 339, None, 382, 376]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# Python str.strip() whitespace, approximated by the ASCII set plus no-break space.
STRIP_RE = "^[\\s\u00a0]+|[\\s\u00a0]+$"
# An isolated digit: not preceded or followed by a letter, digit or underscore.
ISOLATED_ONE = r"(^|[^\p{L}\p{N}_])1($|[^\p{L}\p{N}_])"
ISOLATED_TWO = r"(^|[^\p{L}\p{N}_])2($|[^\p{L}\p{N}_])"
# ---------------------------------------------------------------------------


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` only removes blanks)."""
    return F.regexp_replace(c, STRIP_RE, "")


def ascii_lower(c: Column) -> Column:
    """XPath ``translate(x, 'A..Z', 'a..z')``: lower-cases ASCII letters only."""
    return F.translate(c, UPPER, LOWER)


@cache
def entity_names() -> tuple[dict[str, str], dict[str, str]]:
    """Names of character references: those ended by a semicolon, and those that need none (both
    from the standard library's table)."""
    return ({n[:-1]: c for n, c in html5.items() if n.endswith(";")}, {n: c for n, c in html5.items() if not n.endswith(";")})


def _lookup(names: dict[str, str]) -> Column:
    """The table as one literal (folded once by the optimizer)."""
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _code_point(ref: Column) -> Column:
    """The character of a numeric reference ``#...``; U+FFFD for numbers that have none."""
    is_hex = F.lower(F.substring(ref, 2, 1)) == "x"
    digits = F.regexp_replace(F.when(is_hex, F.substring(ref, F.lit(3), F.length(ref))).otherwise(F.substring(ref, F.lit(2), F.length(ref))), "^0+", "")
    number = F.when(F.length(digits) > 7, F.lit(1 << 30)).otherwise(
        F.coalesce(F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int"), F.lit(0)))
    c1 = F.element_at(F.expr("array(" + ", ".join(str(n or 128 + i) for i, n in enumerate(C1_NUMBERS)) + ")"), F.greatest(F.least(number - 127, F.lit(32)), F.lit(1)))
    valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    point = F.when(~valid, F.lit(0xFFFD)).when(number.between(128, 159), c1).otherwise(number)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def decode_entities(c: Column, attribute: bool = False) -> Column:
    """Character references decoded in one pass, as in HTML: decimal and hexadecimal numbers, every
    name, and the names that need no semicolon (in an ``attribute`` not before a letter, digit or
    '='). The no-break space becomes a blank. Texts without '&' and no-break space stay as they are."""
    full, short = entity_names()
    prefix = "^(" + "|".join(sorted(short, key=lambda n: (-len(n), n))) + ")"

    def part(p: Column) -> Column:
        def rest(n: Column) -> Column:
            return F.substring(p, n + 1, F.length(p))

        def known(x: Column) -> Column:
            ref, semi = x["ref"], x["semi"]
            size = F.length(ref)
            lead = F.regexp_extract(ref, prefix, 1)
            plain = F.concat(F.lit("&"), p)
            by_name = F.when(semi, F.try_element_at(_lookup(full), ref))
            after = F.substring(p, F.length(lead) + 1, F.lit(1))
            bare = (lead != "") & (~after.rlike("^[A-Za-z0-9=]") if attribute else F.lit(True))
            return F.when(ref == "", plain).when(ref.startswith("#"), F.concat(_code_point(ref), rest(size + semi.cast("int")))).when(
                by_name.isNotNull(), F.concat(by_name, rest(size + 1))).when(
                bare, F.concat(F.try_element_at(_lookup(short), lead), rest(F.length(lead)))).otherwise(plain)

        ref = F.regexp_extract(p, "^(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*)", 1)
        found = F.transform(F.array(ref), lambda r: F.struct(r.alias("ref"), (F.substring(p, F.length(r) + 1, F.lit(1)) == ";").alias("semi")))
        return F.element_at(F.transform(found, known), 1)

    parts = F.split(c, "&", -1)
    out = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), part), ""))
    return F.when(c.contains("&"), F.replace(out, F.lit("\u00a0"), F.lit(" "))).otherwise(F.replace(c, F.lit("\u00a0"), F.lit(" ")))


def has_one_and_two(c: Column) -> Column:
    """Text holds an isolated '1' and an isolated '2' (two separate tests, see SURVEY §7.7)."""
    return c.rlike(ISOLATED_ONE) & c.rlike(ISOLATED_TWO)


#: needles of a text that are looked for one by one; more share one sort
FEW_NEEDLES = 32


def found_in(needles: Column, hay: Column, longest: int) -> Column:
    """Those of ``needles`` (array; none longer than ``longest``) that ``hay`` contains, last first. A few are
    looked for one by one. For more the suffixes of ``hay``, cut at ``longest``, are sorted together with
    the needles: a needle is contained if the suffix sorted next behind it begins with it. One sort serves
    all needles."""
    def sorted_in(chars: Column) -> Column:  # bound, or the text would be split again for every suffix
        suffixes = F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.array_join(F.slice(chars, i, F.lit(longest)), ""))
        merged = F.array_sort(F.concat(F.transform(needles, lambda n: F.struct(n.alias("s"), F.lit(0).alias("k"))),
                                       F.transform(F.array_distinct(suffixes), lambda x: F.struct(x.alias("s"), F.lit(1).alias("k")))))
        start = F.struct(F.lit("").alias("after"), F.array().cast("array<string>").alias("found"))

        def step(a: Column, x: Column) -> Column:  # from the last to the first
            return F.when(x["k"] == 1, F.struct(x["s"].alias("after"), a["found"].alias("found"))).when(
                a["after"].startswith(x["s"]), F.struct(a["after"].alias("after"), F.concat(a["found"], F.array(x["s"])).alias("found"))).otherwise(a)

        return F.aggregate(F.reverse(merged), start, step)["found"]

    by_sort = F.element_at(F.transform(F.array(F.split(hay, "")), sorted_in), 1)
    one_by_one = F.reverse(F.array_sort(F.element_at(F.transform(F.array(hay), lambda h: F.filter(needles, lambda n: h.contains(n))), 1)))
    return F.when(F.size(needles) <= FEW_NEEDLES, one_by_one).otherwise(by_sort)


def first_match(cands: list[tuple[str, Column]]) -> Column:
    """First label whose condition holds, in list order (null when none)."""
    return F.coalesce(*[F.when(cond, F.lit(label)) for label, cond in cands])
