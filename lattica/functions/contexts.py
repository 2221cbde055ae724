"""Heap abstractions as Column builders over context arrays.

A context is an ``array<long>`` of fixed length, newest element first, padded with ``NONE``. An abstraction offers
``initial``, ``record`` (the heap context of an allocation) and ``merge`` (the callee's context). Both take a row's
columns by name:

record: ctx, alloc_class, heap_class_name, site
        alloc_class_name
merge:  ctx, site, is_static, heap (receiver's allocation site), hctx, alloc_class, heap_class, heap_class_name, is_init,
        callee_name, heap_supers (names of the receiver's class and of those above it)
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a missing element; keeps arrays free of nulls, which do not group or hash alike everywhere.
NONE = -1
Row = Mapping[str, Column]


def longs(*items) -> Column:
    return F.array(*[i if isinstance(i, Column) else F.lit(i) for i in items]).cast("array<long>")


def empty() -> Column:
    return F.array().cast("array<long>")


def push(ctx: Column, element: Column, n: int) -> Column:
    """``element`` in front; the result always has n elements, and none for n = 0."""
    if n == 0:
        return empty()
    return F.slice(F.concat(F.array(F.coalesce(element.cast("long"), F.lit(NONE).cast("long"))), ctx, F.array_repeat(F.lit(NONE).cast("long"), n)), 1, n)


def truncate(ctx: Column, m: int) -> Column:
    return F.slice(ctx, 1, m) if m else empty()


class Abstraction:
    """Context-insensitive unless a subclass says more."""

    #: Columns that ``merge`` looks at beyond those that every program has.
    looks_at: tuple[str, ...] = ()

    def needs(self, column: str) -> bool:
        return column in self.looks_at

    def initial(self) -> Column:
        return empty()

    def record(self, row: Row) -> Column:
        return empty()

    def merge(self, row: Row) -> Column:
        return empty()

    def __str__(self) -> str:
        return "ContextInsensitive"


@dataclass
class CallSite(Abstraction):
    """Pushes the call site on every call."""

    n: int = 2

    def record(self, row: Row) -> Column:
        return row["ctx"]

    def merge(self, row: Row) -> Column:
        return push(row["ctx"], row["site"], self.n)

    def __str__(self) -> str:
        return f"cs({self.n})"


@dataclass
class StaticCallSite(CallSite):
    """Pushes the site of static calls; other calls push a gap, which evicts the oldest element."""

    def merge(self, row: Row) -> Column:
        return push(row["ctx"], F.when(row["is_static"], row["site"]), self.n)

    def __str__(self) -> str:
        return f"scs({self.n})"


@dataclass
class TypeSensitive(Abstraction):
    """Pushes the class that allocated the receiver; static calls keep the caller's context."""

    n: int = 2
    m: int = 1

    def record(self, row: Row) -> Column:
        return truncate(row["ctx"], self.m)

    def merge(self, row: Row) -> Column:
        return F.when(row["is_static"], row["ctx"]).otherwise(push(row["hctx"], row["alloc_class"], self.n))

    def __str__(self) -> str:
        return f"{self.n}Type+{self.m}H"


@dataclass
class FullObject(Abstraction):
    """The callee's context is the receiver: its site before its heap context; static calls keep the caller's."""

    n: int = 2

    def record(self, row: Row) -> Column:
        return truncate(row["ctx"], self.n)

    def merge(self, row: Row) -> Column:
        return F.when(row["is_static"], row["ctx"]).otherwise(push(row["hctx"], row["heap"], self.n + 1))

    def __str__(self) -> str:
        return f"{self.n}FullObjSens+1H"


@dataclass
class OneObject(Abstraction):
    """The callee's context is the receiver's site; heap contexts are dropped."""

    def merge(self, row: Row) -> Column:
        return F.when(row["is_static"], row["ctx"]).otherwise(longs(row["heap"]))

    def __str__(self) -> str:
        return "OneObjSens"


@dataclass
class InitFullObject(FullObject):
    """Object-sensitive for instance initialisers only."""

    n: int = 1

    def merge(self, row: Row) -> Column:
        return F.when(row["is_init"], super().merge(row)).otherwise(empty())

    def __str__(self) -> str:
        return f"{self.n}InitFullObjSens+1H"


@dataclass
class CollectionsType(Abstraction):
    """Type-sensitive for receivers of collection classes: pushes the class that allocated them, else starts afresh."""

    n: int = 2
    m: int = 1
    pattern: str = "Ljava/util"

    def record(self, row: Row) -> Column:
        return F.when(F.coalesce(row["alloc_class_name"], F.lit("")).contains(self.pattern), truncate(row["ctx"], self.m)).otherwise(empty())

    def merge(self, row: Row) -> Column:
        hit = ~row["is_static"] & F.coalesce(row["heap_class_name"], F.lit("")).contains(self.pattern)
        return F.when(hit, push(row["hctx"], row["alloc_class"], self.n)).otherwise(empty())

    def __str__(self) -> str:
        return f"Collections-{self.n}Type+{self.m}H"


#: The classes that the string abstractions single out.
STRINGS = ("Ljava/lang/String", "Ljava/lang/StringBuilder", "Ljava/lang/StringBuffer", "Ljava/lang/AbstractStringBuilder")


@dataclass
class StringObject(Abstraction):
    """Object-sensitive for strings and their builders only."""

    n: int = 2

    def record(self, row: Row) -> Column:
        hit = row["heap_class_name"].isin(*STRINGS) | row["alloc_class_name"].isin(*STRINGS)
        return F.when(hit, truncate(row["ctx"], self.n)).otherwise(empty())

    def merge(self, row: Row) -> Column:
        hit = ~row["is_static"] & F.coalesce(row["heap_class_name"], F.lit("")).isin(*STRINGS)
        return F.when(hit, push(row["hctx"], row["heap"], self.n + 1)).otherwise(empty())

    def __str__(self) -> str:
        return f"{self.n}StringBuilderFullObjSens+1H"


#: The class of builders with its two final subclasses, the class of print streams, and the parts of
#: names that two abstractions look for.
BUILDERS = ("Ljava/lang/AbstractStringBuilder", "Ljava/lang/StringBuilder", "Ljava/lang/StringBuffer")
PRINT_STREAM = "Ljava/io/PrintStream"
CALLEE_PARTS = ("bouncycastle", "intToBigEndian")
CLASS_PARTS = ("bouncycastle",)


def _has_part(name: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.coalesce(name, F.lit("")).contains(p)
    return hit


@dataclass
class StreamCallSite(CallSite):
    """Pushes the site of calls on print streams and their subclasses, else a gap."""

    n: int = 5
    below: str = PRINT_STREAM
    looks_at = ("heap_supers",)

    def merge(self, row: Row) -> Column:
        hit = ~row["is_static"] & F.array_contains(row["heap_supers"], self.below)
        return push(row["ctx"], F.when(hit, row["site"]), self.n)

    def __str__(self) -> str:
        return f"cs({self.n}, java.io.PrintStream)"


@dataclass
class NamedCallSite(CallSite):
    """Pushes the site of calls, static or not, whose callee's name has one of ``parts``, else a gap."""

    parts: tuple[str, ...] = CALLEE_PARTS
    looks_at = ("callee_name",)

    def merge(self, row: Row) -> Column:
        return push(row["ctx"], F.when(_has_part(row["callee_name"], self.parts), row["site"]), self.n)

    def __str__(self) -> str:
        return f"generateDerivedKey({self.n})"


@dataclass
class FilteredObject(FullObject):
    """Object-sensitive, but an allocation of other than ``classes`` pushes a gap instead of the receiver's site."""

    classes: tuple[str, ...] = BUILDERS

    def record(self, row: Row) -> Column:
        kept = F.coalesce(row["heap_class_name"], F.lit("")).isin(*self.classes)
        gap = push(F.slice(row["ctx"], 2, self.n + 1), F.lit(NONE), self.n)
        return F.when(F.size(row["ctx"]) == 0, empty()).when(kept, truncate(row["ctx"], self.n)).otherwise(gap)

    def __str__(self) -> str:
        return "filter(AbstractStringBuilder)"


@dataclass
class NamedObject(FullObject):
    """Object-sensitive where the receiver's class name has one of ``parts``; an allocation keeps its context where the
    allocated or the allocating class has."""

    parts: tuple[str, ...] = CLASS_PARTS

    def record(self, row: Row) -> Column:
        hit = _has_part(row["heap_class_name"], self.parts) | _has_part(row["alloc_class_name"], self.parts)
        return F.when(hit, truncate(row["ctx"], self.n)).otherwise(empty())

    def merge(self, row: Row) -> Column:
        hit = ~row["is_static"] & _has_part(row["heap_class_name"], self.parts)
        return F.when(hit, push(row["hctx"], row["heap"], self.n + 1)).otherwise(empty())

    def __str__(self) -> str:
        return f"{self.n}StringBuilderFullObjSens+1H"


@dataclass
class ReceiverType(Abstraction):
    """The callee's context is the receiver's concrete type."""

    def merge(self, row: Row) -> Column:
        return F.when(row["is_static"], empty()).otherwise(longs(row["heap_class"]))

    def __str__(self) -> str:
        return "WalaReceiverTypeContextSelector"


SPLIT = -2


@dataclass
class Product(Abstraction):
    """Both abstractions side by side: the left array, a separator, the right array."""

    left: Abstraction
    right: Abstraction

    def needs(self, column: str) -> bool:
        return self.left.needs(column) or self.right.needs(column)

    def _join(self, a: Column, b: Column) -> Column:
        return F.concat(a, longs(SPLIT), b)

    def _halves(self, ctx: Column) -> tuple[Column, Column]:
        # the left operand may itself be a product, the right one never is: cut at the last separator
        at = F.size(ctx) - F.array_position(F.reverse(ctx), F.lit(SPLIT).cast("long")).cast("int") + 1
        return F.slice(ctx, F.lit(1), at - 1), F.slice(ctx, at + 1, F.greatest(F.size(ctx) - at, F.lit(0)))

    def initial(self) -> Column:
        return self._join(self.left.initial(), self.right.initial())

    def _both(self, name: str, row: Row) -> Column:
        parts = {k: self._halves(row[k]) for k in ("ctx", "hctx") if k in row}
        sides = [{**row, **{k: v[i] for k, v in parts.items()}} for i in (0, 1)]
        return self._join(getattr(self.left, name)(sides[0]), getattr(self.right, name)(sides[1]))

    def record(self, row: Row) -> Column:
        return self._both("record", row)

    def merge(self, row: Row) -> Column:
        return self._both("merge", row)

    def __str__(self) -> str:
        return f"{self.left} x {self.right}"


# --- the expression language -----------------------------------------------------------------------------------

#: Short and class names of the abstractions, with their constructors.
NAMES = {
    "type": TypeSensitive, "TypeSensitive": TypeSensitive, "scs": StaticCallSite, "StaticCallSiteSensitive": StaticCallSite, "cs": CallSite, "CallSiteSensitive": CallSite,
    "full": FullObject, "FullObjSensitive": FullObject, "ContextInsensitive": Abstraction, "insensitive": Abstraction, "OneObjSensitive": OneObject,
    "InstanceInitFullObjSensitive": InitFullObject, "CollectionsTypeSensitive": CollectionsType, "StringBuilderFullObjSensitive": StringObject,
    "CallSiteSensitiveOutputStream": StreamCallSite, "MagicCallSiteSensitive": NamedCallSite, "FilterStringBuilderSpecialized": FilteredObject, "MagicFullObjSensitive": NamedObject,
    "WalaReceiverTypeContextSelector": ReceiverType, "CrossProduct": Product,
}
_TOKEN = re.compile(r'\s*(?:(?P<num>\d+)|"(?P<str>[^"]*)"|(?P<name>[A-Za-z_][\w.]*)|(?P<sym>[()\[\]{},]))')


class HafSyntaxError(ValueError):
    """An abstraction expression that cannot be read."""


@dataclass
class _Reader:
    text: str
    tokens: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        pos = 0
        while pos < len(self.text.rstrip()):
            m = _TOKEN.match(self.text, pos)
            if not m:
                raise HafSyntaxError(f"cannot read {self.text[pos:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, want: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if got[0] == "end" or (want and got[1] != want):
            raise HafSyntaxError(f"expected {want or 'more'} in {self.text!r}")
        self.at += 1
        return got

    def product(self) -> Abstraction:
        left = self.single()
        while self.peek() in (("name", "x"), ("sym", ",")):
            self.take()
            left = Product(left, self.single())
        return left

    def single(self) -> Abstraction:
        kind, value = self.take()
        if (kind, value) == ("sym", "["):
            inner = self.product()
            self.take("]")
            return inner
        if kind != "name":
            raise HafSyntaxError(f"unexpected {value!r} in {self.text!r}")
        make = NAMES.get(value.rpartition(".")[2])
        if make is None:
            raise HafSyntaxError(f"no abstraction named {value!r}")
        args: list = []
        if self.peek() == ("sym", "("):
            self.take()
            while self.peek() != ("sym", ")"):
                kind, value = self.peek()
                if kind == "num":
                    args.append(int(self.take()[1]))
                elif kind == "str":
                    args.append(self.take()[1])
                elif (kind, value) == ("sym", "{"):
                    self.take()
                    args.append(self.product())
                    self.take("}")
                else:
                    args.append(self.single())
                if self.peek() == ("sym", ","):
                    self.take()
            self.take(")")
        try:
            return make(*args)
        except TypeError as e:
            raise HafSyntaxError(str(e)) from None


def parse(text: str) -> Abstraction:
    """``type(2,1)``, ``[scs(2) x type(2,1)]``, ``a, b``, class names; products associate to the left."""
    reader = _Reader(text)
    found = reader.product()
    if reader.peek()[0] != "end":
        raise HafSyntaxError(f"unread {reader.peek()[1]!r} in {text!r}")
    return found
