"""Column functions for words: enumerations, states, times, bars, and the list and base functions of the scripting language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device states by number, and why a device can't be opened.
STATES = ("UNKNOWN", "CLOSED", "OFFLINE", "REMOVED", "CANT_OPEN", "FAULTED", "DEGRADED", "HEALTHY")
CORRUPT, BAD_LOG, SPLIT = 2, 13, 14


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def label(index: Column | str, names: tuple[str, ...]) -> Column:
    """The name of a number, null if it has none."""
    return F.get(F.array(*map(F.lit, names)), _c(index).cast("int"))


def number(name: Column | str, names: tuple[str, ...]) -> Column:
    """The number of a name, whatever its case; null if it is none."""
    at = F.array_position(F.array(*(F.lit(n.lower()) for n in names)), F.lower(_c(name)))
    return F.when(at > 0, (at - 1).cast("int"))


def state_name(state: Column | str, why: Column | str) -> Column:
    """What a device's state is called, given why it is so."""
    s = label(state, STATES)
    closed = F.when(_c(why).isin(CORRUPT, BAD_LOG), "FAULTED").when(_c(why) == SPLIT, "SPLIT").otherwise("UNAVAIL")
    return F.when(s.isin("CLOSED", "OFFLINE"), "OFFLINE").when(s == "CANT_OPEN", closed).when(s == "HEALTHY", "ONLINE").when(s.isin("REMOVED", "FAULTED", "DEGRADED"), s).otherwise("UNKNOWN")


def event_time(at: Column | str) -> Column:
    """Seconds, nanoseconds and text of a time, as events carry them; text in the session's zone with its offset."""
    t = _c(at).cast("timestamp")
    return F.struct(F.unix_seconds(t).alias("seconds"), (F.pmod(F.unix_micros(t), F.lit(1_000_000)) * 1000).cast("long").alias("nanoseconds"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssZ").alias("text"))


def bar(part: Column | str, whole: Column | str, width: int) -> Column:
    """A bar of # as long as the part's share of width, filled up with blanks; empty for an empty whole."""
    marks = F.when(_c(whole) > 0, F.floor(F.lit(width) * _c(part) / _c(whole)).cast("int")).otherwise(F.lit(0))
    return F.rpad(F.repeat(F.lit("#"), marks), width, " ")


# Lists of strings. Places count from 1.


def concat(items: Column | str, separator: str = "", first: int = 1, last: int | None = None) -> Column:
    """Items first to last (the end if None) with a separator between them."""
    n = F.size(_c(items)) if last is None else F.least(F.lit(last), F.size(_c(items)))
    return F.array_join(F.slice(_c(items), first, F.greatest(n - first + 1, F.lit(0))), separator)


def insert(items: Column | str, value: Column | str, place: int | None = None) -> Column:
    """With a value at a place, those from there moved up; at the end without one."""
    return F.array_append(_c(items), _c(value)) if place is None else F.array_insert(_c(items), F.lit(place), _c(value))


def remove(items: Column | str, place: int | None = None) -> Column:
    """Without the item at a place, those after it moved down; without the last one if place is None."""
    c = _c(items)
    gone = F.size(c) if place is None else F.lit(place)
    return F.filter(c, lambda x, i: i != gone - 1)


def unpack(items: Column | str, first: int, last: int) -> list[Column]:
    """Items first to last as columns, null where there is none."""
    return [F.get(_c(items), i - 1) for i in range(first, last + 1)]


def sort(items: Column | str, key=None) -> Column:
    """In rising order of key(item), or of the items; equal ones in no certain order but that of their text."""
    if key is None:
        return F.array_sort(_c(items))
    return F.transform(F.array_sort(F.transform(_c(items), lambda x: F.struct(key(x).alias("k"), x.alias("v")))), lambda s: s["v"])


def select(items: list[Column], n: int) -> list[Column]:
    """Arguments from the n-th on, from the end for negative n."""
    return items[n - 1 :] if n > 0 else items[n:]


def to_number(x: Column | str, base: int = 10) -> Column:
    """The whole number that a text writes in a base from 2 to 36, blanks around it allowed; in base 10 also hexadecimal after 0x. Null if it is none."""
    text = F.lower(F.trim(_c(x)))
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    sign, body = F.when(text.startswith("-"), -1).otherwise(1), F.regexp_replace(text, "^-", "")
    plain = F.when(body.rlike(f"^[{digits}]+\\z"), sign * F.conv(body, base, 10).try_cast("long"))
    return plain if base != 10 else F.when(body.rlike(r"^0x[0-9a-f]+\z"), sign * F.conv(F.substring(body, 3, 1 << 20), 16, 10).try_cast("long")).otherwise(plain)


def to_text(x: Column | str) -> Column:
    """A value as text: nil for null, true and false."""
    return F.coalesce(_c(x).cast("string"), F.lit("nil"))


def kind(df_type: str, x: Column | str) -> Column:
    """The type's name of a value of a Spark type: nil, boolean, number, string or table."""
    name = "boolean" if df_type == "boolean" else "string" if df_type == "string" else "table" if df_type.startswith(("array", "map", "struct")) else "number"
    return F.when(_c(x).isNull(), "nil").otherwise(name)
