"""Column functions: sizes for people, numbers from text, bit fields, names, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "KMGTPE"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bucket(x: Column | str) -> Column:
    """The place of the highest set bit, 0 for 1; null below 1."""
    return F.when(_c(x) >= 1, F.length(F.bin(_c(x))) - 1)


def fixed(x: Column, digits: int) -> Column:
    """A double with so many decimals, rounded as its exact binary value lies, ties to even."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def human_size(x: Column | str, base: int = 1024) -> Column:
    """Bytes in powers of 1024 (or another base) within five columns: exact multiples whole, else two, one or no decimals.

    Whole numbers beyond 64 bits may come as decimals.
    """
    n = _c(x).cast("decimal(38,0)")
    out = n.cast("string")
    for i, unit in enumerate(UNITS, 1):
        size = base**i
        ratio = n.cast("double") / F.lit(float(size))
        two, one = fixed(ratio, 2), fixed(ratio, 1)
        text = F.when(n % size == 0, F.call_function("div", n, F.lit(size)).cast("string")).when(F.length(two) <= 4, two).when(F.length(one) <= 4, one).otherwise(fixed(ratio, 0))
        out = F.when(n >= size, F.concat(text, F.lit(unit))).otherwise(out)
    return out


def human_count(x: Column | str) -> Column:
    """A number in powers of 1000 within five columns, as human_size has it."""
    return human_size(x, 1000)


def human_time(x: Column | str) -> Column:
    """Nanoseconds as whole ns, us, ms or s, rounded down; a dash for 0. Whole numbers beyond 64 bits may come as decimals."""
    n = _c(x).cast("decimal(38,0)")
    out = F.concat(n.cast("string"), F.lit("ns"))
    for size, unit in ((1000, "us"), (1000_000, "ms"), (1000_000_000, "s")):
        out = F.when(n >= size, F.concat(F.call_function("div", n, F.lit(size)).cast("string"), F.lit(unit))).otherwise(out)
    return F.when(n == 0, "-").otherwise(out)


def parse_size(x: Column | str) -> Column:
    """A number with an optional unit K to E (then B or iB), or a hexadecimal one after 0x; null if it is none or too large.

    Whole numbers are exact to 64 bits; only numbers with decimals are rounded down after they meet their unit.
    """
    text = F.upper(F.trim(_c(x)))
    shape = r"^([0-9]+(?:\.[0-9]+)?)(?:([KMGTPE]?)I?B?)$"
    number, unit = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
    power = F.when(unit == "", 0).otherwise(F.position(unit, F.lit(UNITS)))
    factor = F.element_at(F.array(*(F.lit(1 << (10 * i)).cast("long") for i in range(len(UNITS) + 1))), (power + 1).cast("int"))
    exact = number.try_cast("decimal(38,18)") * factor.cast("decimal(19,0)")
    digits = F.regexp_extract(text, r"^0X0*([0-9A-F]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, -10).try_cast("long")).when(number != "", F.floor(exact).try_cast("long"))


def bits(word: Column | str, low: int, count: int) -> Column:
    """count bits of a 64-bit word from bit low."""
    return F.shiftrightunsigned(_c(word), low).bitwiseAND(F.lit((1 << count) - 1))


def dataset(name: Column | str) -> Column:
    return F.regexp_extract(_c(name), r"^([^@#]*)", 1)


def leaf(name: Column | str) -> Column:
    return F.element_at(F.split(dataset(name), "/"), -1)


def depth(name: Column | str) -> Column:
    return F.size(F.split(dataset(name), "/")) - 1


#: Bytes of a name, of a permission set's name, levels of a path, and names that no pool may have.
NAME_BYTES, SET_BYTES, LEVELS = 256, 64, 50
RESERVED = ("mirror", "raidz", "draid")


def name_error(name: Column | str, kind: str = "entity") -> Column:
    """What is wrong with a name, or null: the first fault from the left.

    Kinds: component (no separators), entity (path, snapshot or bookmark), dataset (no bookmark), snapshot, bookmark,
    pool, set (a permission set) and mountpoint-free depth (levels of a path).
    """
    c = _c(name)
    bad, long = c.rlike(r"[^A-Za-z0-9_.: -]"), F.octet_length(c) >= NAME_BYTES
    if kind == "component":
        return F.when(long, "too long").when(c == "", "empty component").when(bad, "invalid character")
    if kind == "set":
        inner = F.substring(c, 2, 1 << 20)
        return F.when(F.octet_length(c) >= SET_BYTES, "too long").when(~c.startswith("@"), "no at").when(inner == "", "empty component").when(inner.rlike(r"[^A-Za-z0-9_.: -]"), "invalid character")
    if kind == "pool":
        return F.when(F.octet_length(c) >= NAME_BYTES - 2 - 2 * len("$ORIGIN"), "too long").when(bad, "invalid character").when(~c.rlike(r"^[A-Za-z]"), "no letter").when(c.isin(*RESERVED), "reserved")
    if kind == "depth":
        return F.when(depth(c) >= LEVELS, "too deep")
    # Faults of components by where they begin; the leftmost one counts, and within one the order of the list.
    parts = F.transform(F.split(c, r"[/@#]"), lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    delimiters = F.filter(F.split(c, r"[^/@#]*"), lambda d: d != "")
    marks = lambda i: F.size(F.filter(F.slice(delimiters, 1, i), lambda d: d != "/"))
    after = lambda i: F.get(delimiters, i)

    def fault(s: Column) -> Column:
        p, i = s["p"], s["i"]
        end, before = after(i), F.get(delimiters, i - 1)
        return (
            F.when(end.isNull() & (p == "") & (before == "/"), "trailing slash")
            .when(p.rlike(r"[^A-Za-z0-9_.: %-]"), "invalid character").when(p == ".", "self reference").when(p == "..", "parent reference")
            .when(end.isin("@", "#") & (marks(i) > 0), "multiple delimiters").when(p == "", "empty component")
            .when((end == "/") & (marks(i) > 0), "trailing slash")
        )

    first = F.get(F.filter(F.transform(parts, fault), lambda f: f.isNotNull()), 0)
    wrong = F.when(long, "too long").when(c.startswith("/"), "leading slash").when(c == "", "empty component").otherwise(first)
    if kind == "dataset":
        return F.coalesce(wrong, F.when(c.contains("#"), "invalid character"))
    if kind in ("snapshot", "bookmark"):
        return F.coalesce(wrong, F.when(~c.contains("@" if kind == "snapshot" else "#"), "no at" if kind == "snapshot" else "no pound"))
    return wrong


def valid_name(name: Column | str, kind: str = "entity") -> Column:
    """Whether a name is one of its kind; false for null."""
    return F.coalesce(_c(name).isNotNull() & name_error(name, kind).isNull(), F.lit(False))


def escape_tag(x: Column | str) -> Column:
    """Commas, blanks, equals signs and backslashes with a backslash before them."""
    return F.regexp_replace(_c(x), r"([,= \\])", r"\\$1")


def escape_path(x: Column | str) -> Column:
    """Bytes that are no visible ASCII, and backslashes, as a backslash, 0 and three octal digits."""
    # A byte has two hexadecimal digits; Latin-1 gives each byte a character of its own.
    return F.when(_c(x).rlike(r"^[!-\[\]-~]*\z"), _c(x)).otherwise(
        F.array_join(F.transform(F.split(F.decode(_c(x).cast("binary"), "ISO-8859-1"), ""), lambda ch: F.when(ch.rlike(r"[!-\[\]-~]"), ch).when(ch == "", "").otherwise(F.concat(F.lit("\\0"), F.lpad(F.conv(F.conv(F.hex(F.encode(ch, "ISO-8859-1")), 16, 10), 10, 8), 3, "0")))), "")
    )


def percent(part: Column | str, whole: Column | str) -> Column:
    """100 part / whole, 0 for an empty whole."""
    return F.when(_c(whole) != 0, 100 * _c(part) / _c(whole)).otherwise(F.lit(0.0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """100 a / b as a whole number, 100 where b is 0."""
    return F.when(_c(b) != 0, F.floor(100 * _c(a) / _c(b))).otherwise(F.lit(100)).cast("long")
