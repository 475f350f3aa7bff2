"""Procedures over a catalog: named steps with checked arguments, run together or only checked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.operators import catalog as C
from shalebed.storage import materialize


#: Steps after which the catalog is written out, so the plan stays short.
CUT = 4


class Refused(ValueError):
    """A step that may not run; nothing of the procedure takes effect."""


@dataclass
class Step:
    """needs: kinds that named arguments must have in the catalog (None: must not exist)."""

    run: Callable[..., DataFrame]
    arguments: tuple[str, ...]
    needs: dict[str, str | None] = field(default_factory=dict)


def _destroy(catalog: DataFrame, name: str, holds: DataFrame) -> DataFrame:
    names = catalog.sparkSession.createDataFrame([(name,)], "name string")
    why = [r["reason"] for r in C.refusals(catalog, holds, names).collect()]  # about one name
    if why:
        raise Refused(f"destroy {name}: {', '.join(sorted(why))}")
    return C.destroy(catalog, holds, names)


STEPS = {
    "snapshot": Step(lambda c, name, tag, at, holds: C.snapshot(c, tag, at, name), ("name", "tag", "at"), {"name": "filesystem"}),
    "clone": Step(lambda c, origin, name, at, holds: C.clone(c, origin, name, at), ("origin", "name", "at"), {"origin": "snapshot", "name": None}),
    "promote": Step(lambda c, name, holds: C.promote(c, name), ("name",), {"name": "filesystem"}),
    "rename": Step(lambda c, name, to, holds: C.rename(c, name, to), ("name", "to"), {"name": "filesystem", "to": None}),
    "rename_snapshot": Step(lambda c, name, to, holds: C.rename(c, name, to), ("name", "to"), {"name": "snapshot", "to": None}),
    "rollback": Step(lambda c, name, holds: C.rollback(c, name), ("name",), {"name": "snapshot"}),
    "bookmark": Step(lambda c, name, tag, holds: C.bookmark(c, name, tag), ("name", "tag"), {"name": "snapshot"}),
    "destroy": Step(_destroy, ("name",)),
}


def bind(step: str, args: tuple, keywords: dict) -> dict:
    """Arguments by name from positions and keywords; ValueError for unknown steps and missing, double or unknown arguments."""
    if step not in STEPS:
        raise ValueError(f"no step {step}")
    names = STEPS[step].arguments
    if len(args) > len(names):
        raise ValueError(f"{step}: too many arguments")
    got = dict(zip(names, args))
    for k, v in keywords.items():
        if k not in names or k in got:
            raise ValueError(f"{step}: argument {k}")
        got[k] = v
    if missing := [n for n in names if n not in got]:
        raise ValueError(f"{step}: missing {', '.join(missing)}")
    return got


def run(catalog: DataFrame, holds: DataFrame, steps: list[tuple], limit: int = 1000) -> DataFrame:
    """The catalog after all steps (name, positional arguments..., and a last dict of keywords if there is one).

    Each step is checked on what the ones before it made; the first that may not run raises Refused and the catalog is
    as it was. More than `limit` steps are refused too.
    """
    if len(steps) > limit:
        raise Refused(f"more than {limit} steps")
    now = catalog.select(*C.COLUMNS)
    for number, (name, *args) in enumerate(steps):
        if number and number % CUT == 0:
            now = materialize(now, "procedure")
        keywords = args.pop() if args and isinstance(args[-1], dict) else {}
        got = bind(name, tuple(args), keywords)
        for argument, kind in STEPS[name].needs.items():
            found = [r["kind"] for r in now.where(F.col("name") == got[argument]).select("kind").take(1)]
            if found != ([kind] if kind else []):
                raise Refused(f"{name}: {got[argument]} is {found[0] if found else 'missing'}")
        now = STEPS[name].run(now, **got, holds=holds)
    return now


def check(catalog: DataFrame, holds: DataFrame, steps: list[tuple]) -> str | None:
    """What would refuse the steps, or None: the dry run."""
    try:
        run(catalog, holds, steps)
    except Refused as why:
        return str(why)
    return None
