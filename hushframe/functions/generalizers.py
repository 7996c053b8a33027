"""Generalizers of single columns.

Each has two faces. For groups that are known, ``aggregate`` and ``render`` are plain Spark expressions, so partial
aggregation and code generation apply. For online clustering, a summary of a group is a small value with ``zero``,
``add`` and ``merge``; both give the same values and losses.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hierarchy import Hierarchy

f32 = np.float32


class Generalizer(Protocol):
    """What a column's generalizer offers; a class of one's own needs no more than this."""

    passes: bool

    def output_type(self, source: T.DataType) -> T.DataType: ...
    def aggregate(self, column: Column) -> Column: ...
    def render(self, summary: Column) -> Column: ...
    def loss_column(self, summary: Column) -> Column: ...
    def max_column(self, source: T.DataType) -> Column: ...
    def prepare(self, value: Any) -> Any: ...
    def add(self, summary: Any, value: Any) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def losses(self, summaries: Sequence[Any], state: Any) -> np.ndarray: ...
    def grown(self, summaries: Sequence[Any], values: Sequence[Any], state: Any) -> np.ndarray: ...
    def value(self, summary: Any) -> Any: ...
    def max_value(self, state: Any) -> Any: ...
    def state(self) -> Any: ...


class _OneByOne:
    """Adds values to summaries one at a time."""

    def grown(self, summaries, values, state):
        return self.losses([self.add(s, v) for s, v in zip(summaries, values, strict=True)], state)


class NoneGeneralizer:
    """Passes values through; takes no part in information loss."""

    passes = True

    def output_type(self, source):
        return source

    def max_column(self, source):
        raise TypeError("values pass through")

    def state(self):
        return None


class Aggregation(_OneByOne):
    """Numbers to their range (lo, hi); loss is the range's width over the domain's.

    ``kind`` is "int", "float" or "double". Ranges hold values outside the domain, too; a loss is 1 at most. Only with
    ``AnonymizerConfig.widen`` such a value, where it is a group's second or later one, widens the domain for the whole
    operator. A domain of no width costs 1 for any spread. Nulls take no part in ranges.
    """

    passes = False

    def __init__(self, lo, hi, kind: str = "double"):
        self.lo, self.hi, self.kind = lo, hi, kind

    def _type(self):
        return {"int": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}[self.kind]

    def output_type(self, source):
        t = self._type()
        return T.StructType([T.StructField("lo", t), T.StructField("hi", t)])

    def aggregate(self, column):
        c = column.cast(self._type())
        return F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"))

    def render(self, summary):
        return summary

    def loss_column(self, summary):
        width = (summary["hi"] - summary["lo"]).cast("double")
        share = width / F.lit(float(self.hi - self.lo)) if self.hi > self.lo else F.lit(1.0)
        return F.when(width.isNull() | (width == 0), F.lit(0.0)).otherwise(F.least(share, F.lit(1.0)))

    def max_column(self, source):
        t = self._type()
        return F.struct(F.lit(self.lo).cast(t).alias("lo"), F.lit(self.hi).cast(t).alias("hi"))

    def state(self):
        return [self.lo, self.hi]

    def prepare(self, value):
        return None if value is None else (int(value) if self.kind == "int" else float(value))

    def add(self, summary, value):
        if value is None:
            return summary
        return (value, value) if summary is None else (min(summary[0], value), max(summary[1], value))

    def merge(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        return (min(a[0], b[0]), max(a[1], b[1]))

    def widen(self, summary, state) -> bool:
        """Extends the domain to hold a summary; whether it changed."""
        if summary is None or (state[0] <= summary[0] and summary[1] <= state[1]):
            return False
        state[0], state[1] = min(state[0], summary[0]), max(state[1], summary[1])
        return True

    def outside(self, value, state) -> bool:
        """Whether the most general value doesn't hold a value."""
        return value is not None and not state[0] <= value <= state[1]

    def losses(self, summaries, state):
        return self._shares(np.array([0.0 if s is None else s[1] - s[0] for s in summaries], dtype=np.float32), state)

    def loss(self, summary, state) -> np.float32:
        """losses() of one summary."""
        width, domain = f32(0 if summary is None else summary[1] - summary[0]), f32(state[1] - state[0])
        return min(width / domain, f32(1)) if domain > 0 else f32(width != 0)

    def _shares(self, width, state):
        domain = f32(state[1] - state[0])
        return np.minimum(width / domain, f32(1)) if domain > 0 else (width != 0).astype(np.float32)

    def grown(self, summaries, values, state):
        if None in summaries or None in values:
            return super().grown(summaries, values, state)
        at = np.array(summaries, dtype=np.float64)
        v = np.array(values, dtype=np.float64)
        return self._shares((np.maximum(at[:, 1], v) - np.minimum(at[:, 0], v)).astype(np.float32), state)

    def value(self, summary):
        return summary

    def max_value(self, state):
        return (state[0], state[1])

    def covers(self, rendered, value) -> bool:
        return value is None or (rendered is not None and rendered[0] <= value <= rendered[1])


class Reduction(_OneByOne):
    """Strings to their common beginning, the rest masked; strings of different lengths are masked whole.

    Loss is the masked share. Other values count as their text.
    """

    passes = False

    def __init__(self, mask: str = "*"):
        self.mask = mask

    def output_type(self, source):
        return T.StringType()

    def aggregate(self, column):
        c = column.cast("string")
        return F.struct(F.min(c).alias("a"), F.max(c).alias("b"), F.min(F.length(c)).alias("lo"), F.max(F.length(c)).alias("hi"))

    @staticmethod
    def _common(summary) -> Column:
        """Length of the common beginning of the least and the greatest string, which is that of all."""
        n = summary["lo"]
        places = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(summary["a"], i, F.lit(1)) != F.substring(summary["b"], i, F.lit(1)))
        first = F.when(summary["a"] == summary["b"], n).otherwise(F.coalesce(F.get(places, F.lit(0)) - 1, n))
        return F.when(summary["lo"] != summary["hi"], 0).when(n == 0, 0).otherwise(first)

    def render(self, summary):
        keep = self._common(summary)
        return F.concat(F.substring(summary["a"], F.lit(1), keep), F.repeat(F.lit(self.mask), (summary["hi"] - keep).cast("int")))

    def loss_column(self, summary):
        n = summary["hi"].cast("double")
        return F.when(n.isNull() | (n == 0), F.lit(0.0)).otherwise((n - self._common(summary)) / n)

    def max_column(self, source):
        return F.lit(self.mask)

    def state(self):
        return None

    def prepare(self, value):
        return None if value is None else str(value)

    def add(self, summary, value):
        if value is None:
            return summary
        n = len(value)
        return (value, n, n) if summary is None else self.merge(summary, (value, n, n))

    def merge(self, a, b):
        """(common beginning, least length, greatest length)."""
        if a is None or b is None:
            return b if a is None else a
        x, y = a[0], b[0]
        n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        return (x[:n], min(a[1], b[1]), max(a[2], b[2]))

    def _kept(self, s) -> int:
        return len(s[0]) if s[1] == s[2] else 0

    def losses(self, summaries, state):
        return np.array([0.0 if s is None or not s[2] else (s[2] - self._kept(s)) / s[2] for s in summaries], dtype=np.float32)

    def value(self, summary):
        if summary is None:
            return None
        n = self._kept(summary)
        return summary[0][:n] + self.mask * (summary[2] - n)

    def max_value(self, state):
        return self.mask

    def covers(self, rendered, value) -> bool:
        if value is None:
            return True
        head = rendered.rstrip(self.mask) if rendered != value else rendered
        return value.startswith(head) and len(value) <= len(rendered)


class Categories(_OneByOne):
    """Categories to their lowest common ancestor in a hierarchy.

    A value is a label, or an array that is its path from below the root. Unknown labels are children of the root. Loss
    is the share of the domain's other leaves below the ancestor. An array's path counts below its lowest known label.
    """

    passes = False

    def __init__(self, hierarchy: Hierarchy):
        self.hierarchy = hierarchy

    def output_type(self, source):
        return T.StringType()

    def path_column(self, column: Column, is_array: bool = False) -> Column:
        """The path of a value, by a literal map of the hierarchy."""
        rows = self.hierarchy.rows()
        known = F.create_map(*(x for n, p, _ in rows for x in (F.lit(n), F.array(*map(F.lit, p))))) if rows else F.create_map()
        if not is_array:
            return F.when(column.isNotNull(), F.coalesce(F.try_element_at(known, column), F.array(column)))
        # below the lowest known label of the array
        last = F.aggregate(F.sequence(F.lit(1), F.size(column)), F.lit(0), lambda best, i: F.when(F.try_element_at(known, F.try_element_at(column, i)).isNotNull(), i).otherwise(best))
        head = F.coalesce(F.try_element_at(known, F.get(column, last - 1)), F.array().cast("array<string>"))
        return F.when(column.isNotNull() & (F.size(column) > 0), F.concat(head, F.slice(column, last + 1, F.size(column))))

    def aggregate(self, column, is_array: bool = False):
        p = self.path_column(column, is_array)
        return F.struct(F.min(p).alias("a"), F.max(p).alias("b"))

    @staticmethod
    def _common(summary) -> Column:
        n = F.least(F.size(summary["a"]), F.size(summary["b"]))
        differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(summary["a"], i) != F.get(summary["b"], i))
        return F.when(n <= 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)), n))

    def render(self, summary):
        n = self._common(summary)
        return F.when(summary["a"].isNull(), F.lit(None)).when(n == 0, F.lit(self.hierarchy.root)).otherwise(F.get(summary["a"], n - 1))

    def loss_column(self, summary):
        total = self.hierarchy.leaves(self.hierarchy.root) if self.hierarchy.children[self.hierarchy.root] else 0
        losses = [(n, (leaves - 1) / (total - 1) if total > 1 else 0.0) for n, _, leaves in self.hierarchy.rows()]
        table = F.create_map(*(F.lit(x) for kv in losses for x in kv), F.lit(self.hierarchy.root), F.lit(1.0))
        return F.coalesce(F.try_element_at(table, self.render(summary)), F.lit(0.0))

    def max_column(self, source):
        return F.lit(self.hierarchy.root)

    def state(self):
        return None

    def prepare(self, value):
        if value is None:
            return None
        if isinstance(value, str):
            return self.hierarchy.path(value)
        value = list(value)
        known = next((i for i in range(len(value) - 1, -1, -1) if value[i] in self.hierarchy), -1)
        return (self.hierarchy.path(value[known]) if known >= 0 else ()) + tuple(value[known + 1 :])

    def add(self, summary, value):
        return summary if value is None else self.merge(summary, (value, frozenset() if not value or value[-1] in self.hierarchy else frozenset([value])))

    def merge(self, a, b):
        """(common path, unknown leaves seen)."""
        if a is None or b is None:
            return b if a is None else a
        x, y = a[0], b[0]
        n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        return (x[:n], a[1] | b[1])

    def _loss(self, s) -> float:
        if s is None:
            return 0.0
        path, new = s
        h = self.hierarchy
        total = (h.leaves(h.root) if h.children[h.root] else 0) + len(new)
        own = total if not path else (h.leaves(path[-1]) if path[-1] in h else 1) + sum(len(p) > len(path) and p[: len(path)] == path for p in new)
        return (own - 1) / (total - 1) if total > 1 else 0.0

    def losses(self, summaries, state):
        return np.array([self._loss(s) for s in summaries], dtype=np.float32)

    def value(self, summary):
        return None if summary is None else (summary[0][-1] if summary[0] else self.hierarchy.root)

    def max_value(self, state):
        return self.hierarchy.root

    def covers(self, rendered, value) -> bool:
        return value is None or rendered == self.hierarchy.root or rendered in value
