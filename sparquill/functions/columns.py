"""pyspark.sql.functions whose columns are SQL text until a DataFrame takes them.

A plan of thousands of expressions otherwise asks the JVM for each of them, with its place in the code and its release,
half a millisecond a question; here a whole column is one. What isn't listed below, and whatever has a column of
pyspark's own in it, is left to pyspark, so that both may be mixed.
"""
from __future__ import annotations

import builtins
import inspect
import itertools
import math
import re

from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as Plain

#: How a function takes its arguments: c columns or their names, v values, n columns, their names or numbers; the last holds for the rest.
TAKES = {
    **dict.fromkeys("array array_compact array_distinct array_except array_intersect array_max array_sort arrays_overlap coalesce concat contains flatten greatest least length lower regexp_extract_all replace rlike rtrim size trim upper abs sequence".split(), "c"),
    **dict.fromkeys("array_contains array_join array_remove element_at instr regexp_extract regexp_replace round split translate".split(), "cv"), **dict.fromkeys(["slice", "substr", "substring"], "cn"), "concat_ws": "vc",
}
LAMBDAS = ["exists", "filter", "forall", "transform", "aggregate"]
_count = itertools.count()


class Untold(Exception):
    """No SQL text can be told here."""


def value(x) -> str:
    """A Python value, or a column, as SQL."""
    if isinstance(x, Text):
        return x.sql
    if x is None or isinstance(x, bool):
        return {None: "NULL", True: "true", False: "false"}[x]
    if isinstance(x, int) and -(1 << 63) < x < 1 << 63:
        return f"({x}L)" if not -(1 << 31) < x < 1 << 31 else f"({x})" if x < 0 else str(x)
    if isinstance(x, float) and math.isfinite(x):
        return f"({x!r}D)" if x < 0 else f"{x!r}D"
    if isinstance(x, str) and "${" not in x:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise Untold


def column(x) -> str:
    """A column, or the one of a name, as SQL."""
    return value(col(x) if isinstance(x, str) else x)


def told(make, plain):
    """The column of the SQL that make() tells, else pyspark's own."""
    try:
        return make()
    except Untold:
        return plain()


class Text(Plain):
    """A column as SQL text; name: what it is called in a struct; whens: the branches of a CASE without end."""

    def __init__(self, sql: str, name: str | None = None, alias: str | None = None, whens: tuple = ()) -> None:
        self.sql, self.name, self.as_, self.whens, self._java = sql, name or alias, alias, whens, None

    @property
    def _jc(self):
        if self._java is None:
            if self.whens:
                made = F
                for test, then in self.whens:
                    made = made.when(test, then)
                made = made.alias(self.as_) if self.as_ else made
            else:
                made = F.expr(f"{self.sql} AS `{self.as_}`" if self.as_ else self.sql)
            self._java = made._jc
        return self._java

    def alias(self, *names, **more):
        return Plain.alias(self, *names, **more) if len(names) > 1 or more else Text(self.sql, None, names[0], self.whens)

    def when(self, test, then):
        if not self.whens:
            return Plain.when(self, test, then)
        return told(lambda: case((*self.whens, (test, then))), lambda: Plain.when(self, test, then))

    def otherwise(self, other):
        if not self.whens:
            return Plain.otherwise(self, other)
        return told(lambda: Text(f"{self.sql[:-5]} ELSE {value(other)} END)"), lambda: Plain.otherwise(self, other))

    def isin(self, *values):
        xs = list(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple, set)) else list(values)
        return told(lambda: Text(f"({self.sql} IN ({', '.join(map(value, xs))}))") if xs else _raise(), lambda: Plain.isin(self, *values))

    def cast(self, kind):
        return Text(f"CAST({self.sql} AS {kind})") if isinstance(kind, str) else Plain.cast(self, kind)

    def isNull(self):
        return Text(f"({self.sql} IS NULL)")

    def isNotNull(self):
        return Text(f"({self.sql} IS NOT NULL)")

    def __getitem__(self, k):
        return told(lambda: Text(f"{self.sql}[{value(k)}]", k if isinstance(k, str) else None) if not isinstance(k, builtins.slice) else _raise(), lambda: Plain.__getitem__(self, k))

    def __neg__(self):
        return Text(f"(- {self.sql})")

    def __invert__(self):
        return Text(f"(NOT {self.sql})")


def _raise():
    raise Untold


def _infix(name: str, sign: str) -> None:
    def forward(self, other):
        return told(lambda: Text(f"({self.sql} {sign} {value(other)})"), lambda: getattr(Plain, f"__{name}__")(self, other))

    def back(self, other):
        plain = lambda: getattr(Plain, f"__{name}__")(other, self) if isinstance(other, Plain) else getattr(Plain, f"__r{name}__")(self, other)
        return told(lambda: Text(f"({value(other)} {sign} {self.sql})"), plain)

    setattr(Text, f"__{name}__", forward)
    setattr(Text, f"__r{name}__", back)


for _n, _s in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%", "and": "AND", "or": "OR", "eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _infix(_n, _s)
for _n in ("rlike", "contains", "startswith", "endswith"):
    setattr(Text, _n, lambda self, other, n=_n: told(lambda: Text(f"{n}({self.sql}, {value(other)})"), lambda: getattr(Plain, n)(self, other)))


def col(name: str):
    return Text(".".join(f"`{p}`" for p in name.split(".")), name.rsplit(".", 1)[-1]) if re.fullmatch(r"\w+(\.\w+)*", name) else F.col(name)


def lit(x):
    return told(lambda: x if isinstance(x, Plain) else Text(value(x)), lambda: F.lit(x))


def expr(sql: str) -> Text:
    return Text(f"({sql})") if "${" not in sql else F.expr(sql)


def case(whens: tuple) -> Text:
    return Text("(CASE " + " ".join(f"WHEN {value(t)} THEN {value(v)}" for t, v in whens) + " END)", whens=whens)


def when(test, then):
    return told(lambda: case(((test, then),)), lambda: F.when(test, then))


def struct(*columns):
    if len(columns) == 1 and isinstance(columns[0], (list, tuple)):
        columns = tuple(columns[0])

    def make():
        cs = [col(c) if isinstance(c, str) else c for c in columns]
        return Text("named_struct(" + ", ".join(f"{value((isinstance(c, Text) and c.name) or f'col{i + 1}')}, {value(c)}" for i, c in enumerate(cs)) + ")")

    return told(make, lambda: F.struct(*columns))


def _function(name: str):
    takes = TAKES[name]

    def call(*args):
        def make():
            xs = args[0] if len(args) == 1 and isinstance(args[0], (list, tuple)) else args
            kinds = takes + takes[-1] * len(xs)
            return Text(f"{name}({', '.join(value(x) if k == 'v' or not isinstance(x, str) else column(x) for x, k in zip(xs, kinds))})")

        return told(make, lambda: getattr(F, name)(*args))

    return call


def _lambda(f) -> str:
    names = [f"x{next(_count)}_" for _ in inspect.signature(f).parameters]
    body = value(f(*(Text(n, n) for n in names)))
    return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {body}"


def _higher(name: str):
    def call(first, *more):
        make = lambda: Text(f"{name}({column(first)}, {', '.join(_lambda(x) if callable(x) else column(x) for x in more)})")
        return told(make, lambda: getattr(F, name)(first, *more))

    return call


globals().update({n: _function(n) for n in TAKES} | {n: _higher(n) for n in LAMBDAS})


def __getattr__(name: str):
    return getattr(F, name)
