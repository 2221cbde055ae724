"""Names for people: types, methods, operators, and text that graph files can hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols of the operators.
SYMBOLS = {"ADD": "+", "SUB": "-", "MUL": "*", "DIV": "/", "REM": "%", "AND": "&", "OR": "|", "XOR": "^", "SHL": "<<", "SHR": ">>", "USHR": ">>>", "EQ": "==", "NE": "!=", "LT": "<", "GE": ">=", "GT": ">", "LE": "<="}
#: Letters of the primitive types.
PRIMITIVES = {"Z": "boolean", "B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double", "V": "void"}



def operator_symbol(op: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv]), op), op)


def type_name(t: Column, package: bool = False) -> Column:
    """``[[Ljava/lang/String`` as ``String[][]`` (or with its package); primitives by name."""
    dims = F.length(F.regexp_extract(t, r"^\[*", 0))
    core = F.regexp_replace(t, r"^\[+", "")
    named = F.regexp_replace(F.regexp_replace(core, r"^L|;$", ""), "/", ".")
    named = named if package else F.substring_index(named, ".", -1)
    table = F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv])
    return F.concat(F.coalesce(F.try_element_at(table, core), named), F.repeat(F.lit("[]"), dims))


def method_name(owner: Column, name: Column, params: Column) -> Column:
    """``Owner.name(A, B)``; ``params`` is an array of type names."""
    return F.concat(type_name(owner), F.lit("."), name, F.lit("("), F.array_join(F.transform(params, type_name), ", "), F.lit(")"))


def dot_escape(s: Column) -> Column:
    """Text for a DOT label: backslashes, quotes and line breaks escaped."""
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def file_name(s: Column, most: int = 200) -> Column:
    """A name cut to what file systems take."""
    return F.left(F.regexp_replace(s, r"[^A-Za-z0-9_.\-]", "_"), F.lit(most))
