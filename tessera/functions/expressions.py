"""Expressions: built lazily, so that placeholders are bound when a query is lowered to a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Env = Mapping[str, Any]


class CompileError(ValueError):
    """A query that can't be built; carries no parameter values."""


class Expr:
    """An expression; column(env) lowers it with the placeholders' values. codec, if any, decodes results and encodes values compared with it."""

    aggregate = False
    #: Makes the opposite, where that is more than NOT before the expression.
    negation: Callable[[], Expr] | None = None

    def __init__(self, build: Callable[[Env], Column], codec: Any = None):
        self._build, self.codec = build, codec

    def column(self, env: Env) -> Column:
        return self._build(env)


class Ref(Expr):
    """A table's column under the table's qualifier."""

    def __init__(self, table: str, name: str, codec: Any = None):
        self.table, self.name = table, name
        super().__init__(lambda env: F.col(f"{quote(table)}.{quote(name)}"), codec)


class Placeholder:
    def __init__(self, name: str):
        self.name = name


class Order:
    def __init__(self, operand: Any, down: bool = False):
        self.operand, self.down = operand, down

    def column(self, env: Env) -> Column:
        c = lower_(self.operand, env)
        return c.desc() if self.down else c.asc()


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ph(name: str) -> Placeholder:
    return Placeholder(name)


def raw(text: str) -> Expr:
    """A SQL fragment in any position."""
    return Expr(lambda env: F.expr(text))


class Fragment(Expr):
    """SQL text made of parts: text as it is, and values, columns, placeholders and fragments in between."""

    def __init__(self, *parts: Any):
        self.parts = parts
        super().__init__(lambda env: F.expr(self.text(env)))

    def text(self, env: Env) -> str:
        return "".join(p.text if isinstance(p, _Text) else _sql_of(p, env) for p in self.parts)


class _Text:
    def __init__(self, text: str):
        self.text = text


def _sql_of(x: Any, env: Env) -> str:
    if isinstance(x, Fragment):
        return x.text(env)
    if isinstance(x, Ref):
        return f"{quote(x.table)}.{quote(x.name)}"
    if isinstance(x, Placeholder):
        if x.name not in env:
            raise CompileError(f"no value for placeholder {x.name}")
        return _sql_of(env[x.name], env)
    if isinstance(x, (list, tuple)):
        return f"({', '.join(_sql_of(v, env) for v in x)})"
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x) if not isinstance(x, float) else f"{x!r}D"
    if isinstance(x, (bytes, bytearray)):
        return f"X'{x.hex()}'"
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise CompileError(f"a fragment can't hold a {type(x).__name__}")


def sql(template: str, *values: Any) -> Fragment:
    """A fragment: each `{}` of the template stands for the next value. Lists become `(a, b)`; values are never read as SQL."""
    texts = template.split("{}")
    if len(texts) != len(values) + 1:
        raise CompileError(f"{len(texts) - 1} places for {len(values)} values")
    return Fragment(*[p for t, v in zip(texts, (*values, empty()), strict=True) for p in (_Text(t), v)])


def identifier(*names: str) -> Fragment:
    """A quoted name, qualified if several are given."""
    return Fragment(_Text(".".join(map(quote, names))))


def empty() -> Fragment:
    return Fragment()


def join(parts: Sequence[Any], between: str = ", ") -> Fragment:
    return Fragment(*[p for i, x in enumerate(parts) for p in ([_Text(between), x] if i else [x])])


def param_fn(make: Callable[[], Any]) -> Expr:
    """A value made anew at each execution."""
    return Expr(lambda env: F.lit(make()))


def lower_(x: Any, env: Env, codec: Any = None) -> Column:
    if isinstance(x, (Expr, Order)):
        return x.column(env)
    if isinstance(x, Column):
        return x
    if isinstance(x, Placeholder):
        if x.name not in env:
            raise CompileError(f"no value for placeholder {x.name}")
        x = env[x.name]
    return codec.encode(x) if codec is not None and x is not None else F.lit(x)


def codec_of(x: Any) -> Any:
    return x.codec if isinstance(x, Expr) else None


def _binary(op: Callable[[Column, Column], Column]):
    def make(left: Any, right: Any) -> Expr:
        return Expr(lambda env: op(lower_(left, env), lower_(right, env, codec_of(left))))

    return make


# comparison with null is never true, as in SQL; use is_null
eq = _binary(lambda a, b: a == b)
ne = _binary(lambda a, b: a != b)
gt = _binary(lambda a, b: a > b)
gte = _binary(lambda a, b: a >= b)
lt = _binary(lambda a, b: a < b)
lte = _binary(lambda a, b: a <= b)


def _fold(c: Column) -> Column:
    """A-Z to lower case, other letters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like(x: Any, pattern: Any) -> Expr:
    """% and _ match as in SQL, A-Z without regard to case; no character escapes."""
    return Expr(lambda env: F.like(_fold(lower_(x, env)), F.replace(_fold(lower_(pattern, env)), F.lit("\\"), F.lit("\\\\"))))


def not_like(x: Any, pattern: Any) -> Expr:
    return not_(like(x, pattern))


ilike, not_ilike = like, not_like


def glob(x: Any, pattern: str) -> Expr:
    """Case-sensitive * ? [..] [^..], anchored at both ends."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2)) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            neg = body.startswith("^")
            out.append("[" + "^" * neg + re.sub(r"([\\\[\]&~^])", r"\\\1", body[neg:]) + "]")
            i = end
        elif c == "[":
            return Expr(lambda env: F.when(lower_(x, env).isNotNull(), F.lit(False)))
        else:
            out.append(re.escape(c))
        i += 1
    text = r"(?s)\A" + "".join(out) + r"\z"
    return Expr(lambda env: lower_(x, env).rlike(text))


def is_null(x: Any) -> Expr:
    return Expr(lambda env: lower_(x, env).isNull())


def is_not_null(x: Any) -> Expr:
    return Expr(lambda env: lower_(x, env).isNotNull())


def _junction(op, opposite: Callable[[], Callable[..., Expr | None]]):
    def make(*conditions: Any) -> Expr | None:
        """Operands that are None are dropped; of none there is no condition."""
        live = [c for c in conditions if c is not None]
        if not live:
            return None
        out = Expr(lambda env: reduce(op, (lower_(c, env) for c in live)))
        if any(isinstance(c, Expr) and c.negation for c in live):
            out.negation = lambda: opposite()(*map(not_, live))
        return out

    return make


and_ = _junction(lambda a, b: a & b, lambda: or_)
or_ = _junction(lambda a, b: a | b, lambda: and_)


def not_(x: Any) -> Expr:
    if isinstance(x, Expr) and x.negation:
        return x.negation()
    return Expr(lambda env: ~lower_(x, env))


def between(x: Any, low: Any, high: Any) -> Expr:
    codec = codec_of(x)
    return Expr(lambda env: lower_(x, env).between(lower_(low, env, codec), lower_(high, env, codec)))


def not_between(x: Any, low: Any, high: Any) -> Expr:
    return not_(between(x, low, high))


def _is_query(values: Any) -> bool:
    return isinstance(values, DataFrame) or hasattr(values, "df")


def _rows(query: Any, env: Env) -> DataFrame:
    return query if isinstance(query, DataFrame) else query.df(**env)


def in_(x: Any, values: Any) -> Expr:
    """x in a list (an empty one holds nothing), or in a one-column DataFrame or query."""
    if _is_query(values):
        out = Expr(lambda env: lower_(x, env).isin(_rows(values, env)))
        out.negation = lambda: not_in(x, values)
        return out
    if isinstance(values, (str, bytes, Placeholder)) or not isinstance(values, Sequence):
        raise CompileError("in_ takes a list, a DataFrame or a query")
    codec = codec_of(x)
    return Expr(lambda env: lower_(x, env).isin(*[lower_(v, env, codec) for v in values]) if values else F.lit(False))


def not_in(x: Any, values: Any) -> Expr:
    """Not in: true for an empty list or query, whatever x; with a null in it never true."""
    if isinstance(values, (list, tuple)) and not values:
        return Expr(lambda env: F.lit(True))
    if _is_query(values):
        out = Expr(lambda env: _not_in_rows(lower_(x, env), _rows(values, env)))
        out.negation = lambda: in_(x, values)
        return out
    return not_(in_(x, values))


def _not_in_rows(x: Column, rows: DataFrame) -> Column:
    """Spark's own NOT IN broadcasts all rows, however many. This one joins the distinct ones by key; whether there are any, and nulls, it asks apart.

    Rows of several columns, and those that refer to the outer query, are left to Spark.
    """
    try:
        names = rows.columns
    except AnalysisException:
        names = []
    if len(names) != 1:
        return ~x.isin(rows)
    null = rows.filter(F.col(quote(names[0])).isNull()).exists()
    return F.when(x.isin(rows.distinct()), F.lit(False)).when((x.isNotNull() & ~null) | ~rows.exists(), F.lit(True))


def exists(query: Any) -> Expr:
    return Expr(lambda env: _rows(query, env).exists())


def not_exists(query: Any) -> Expr:
    return not_(exists(query))


# scalars


add, subtract, multiply = _binary(lambda a, b: a + b), _binary(lambda a, b: a - b), _binary(lambda a, b: a * b)


def divide(left: Any, right: Any, integers: bool = True) -> Expr:
    """Quotient, truncated toward zero for integers; null for a zero divisor."""

    def build(env: Env) -> Column:
        a, b = lower_(left, env), lower_(right, env)
        return F.when(b != 0, F.try_divide(a - F.try_mod(a, b), b).cast("long")) if integers else F.try_divide(a, b)

    return Expr(build)


def coalesce(*xs: Any) -> Expr:
    return Expr(lambda env: F.coalesce(*[lower_(x, env) for x in xs]))


def lower(x: Any) -> Expr:
    return Expr(lambda env: _fold(lower_(x, env)))


def upper(x: Any) -> Expr:
    return Expr(lambda env: F.translate(lower_(x, env), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def collate(x: Any, name: str) -> Expr:
    """x as a collation compares it: nocase folds A-Z, rtrim leaves out closing spaces, binary is x itself."""
    how = {"binary": lambda c: c, "nocase": _fold, "rtrim": lambda c: F.regexp_replace(c, " +$", "")}
    if name.lower() not in how:
        raise CompileError(f"no collation {name}")
    return Expr(lambda env: how[name.lower()](lower_(x, env)))


def length(x: Any) -> Expr:
    return Expr(lambda env: F.length(lower_(x, env)).cast("long"))


def asc(x: Any) -> Order:
    return Order(x)


def desc(x: Any) -> Order:
    return Order(x, True)


# text predicates with literal operands


def contains(x: Any, part: Any, fold: bool = True) -> Expr:
    return Expr(lambda env: _fold(lower_(x, env)).contains(_fold(lower_(part, env))) if fold else lower_(x, env).contains(lower_(part, env)))


def starts_with(x: Any, part: Any) -> Expr:
    return Expr(lambda env: _fold(lower_(x, env)).startswith(_fold(lower_(part, env))))


def ends_with(x: Any, part: Any) -> Expr:
    return Expr(lambda env: _fold(lower_(x, env)).endswith(_fold(lower_(part, env))))


def eq_folded(x: Any, value: Any) -> Expr:
    """Equality without regard to case, for strings only."""
    return Expr(lambda env: _fold(lower_(x, env)) == _fold(F.lit(value))) if isinstance(value, str) else eq(x, value)


def ne_folded(x: Any, value: Any) -> Expr:
    return not_(eq_folded(x, value)) if isinstance(value, str) else ne(x, value)


def in_folded(x: Any, values: Sequence[Any]) -> Expr:
    """In a list without regard to case, if it is of strings only; an empty one holds nothing."""
    if not values or not all(isinstance(v, str) for v in values):
        return in_(x, values)
    return Expr(lambda env: _fold(lower_(x, env)).isin(*[_fold(F.lit(v)) for v in values]))


def not_in_folded(x: Any, values: Sequence[Any]) -> Expr:
    return not_(in_folded(x, values)) if values else not_in(x, values)


def eq_or_null(x: Any, value: Any) -> Expr:
    return is_null(x) if value is None else eq(x, value)


# aggregates


def _aggregate(build: Callable[[Env], Column], codec: Any = None) -> Expr:
    out = Expr(build, codec)
    out.aggregate = True
    return out


def count(x: Any = None) -> Expr:
    return _aggregate(lambda env: F.count(F.lit(1) if x is None else lower_(x, env)))


def count_distinct(x: Any) -> Expr:
    return _aggregate(lambda env: F.count_distinct(lower_(x, env)))


def sum_(x: Any, as_text: bool = False) -> Expr:
    return _aggregate(lambda env: _maybe_text(F.sum(lower_(x, env)), as_text))


def avg(x: Any, as_text: bool = False) -> Expr:
    return _aggregate(lambda env: _maybe_text(F.avg(lower_(x, env)), as_text))


def _maybe_text(c: Column, as_text: bool) -> Column:
    return c.cast("string") if as_text else c


def min_(x: Any) -> Expr:
    return _aggregate(lambda env: F.min(lower_(x, env)), codec_of(x))


def max_(x: Any) -> Expr:
    return _aggregate(lambda env: F.max(lower_(x, env)), codec_of(x))


def list_of(x: Any) -> Expr:
    """All values of a group, in ascending order."""
    return _aggregate(lambda env: F.array_sort(F.collect_list(lower_(x, env))))
