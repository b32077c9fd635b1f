"""Statements and expressions as plain values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    value: int | str | bool | None


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Unary:
    op: str  # + - NOT
    of: Expr


@dataclass(frozen=True)
class Binary:
    left: Expr
    op: str
    right: Expr


@dataclass(frozen=True)
class IsNull:
    of: Expr
    negated: bool


@dataclass(frozen=True)
class Alias:
    of: Expr
    name: str


@dataclass(frozen=True)
class Nested:
    of: Expr


Expr = Literal | Name | Star | Unary | Binary | IsNull | Alias | Nested


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    constraints: tuple[str, ...] = ()


@dataclass(frozen=True)
class Select:
    items: tuple[Expr, ...]
    table: str
    where: Expr | None = None
    order: tuple[tuple[Expr, bool], ...] = ()  # expression, descending
    limit: int | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...]
    returning: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Expr], ...]
    where: Expr | None = None
    returning: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None
    returning: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    unique: bool


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class Control:
    action: str  # BEGIN, COMMIT, ROLLBACK


@dataclass(frozen=True)
class Explain:
    of: Statement


Statement = Select | Insert | Update | Delete | CreateTable | CreateIndex | DropTable | Control | Explain


def shown(value: object) -> str:
    """A value as result tables and column names print it."""
    if value is None:
        return "NULL"
    if value is True or value is False:
        return str(value).upper()
    return f'"{value}"' if isinstance(value, str) else str(value)


def display(e: Expr) -> str:
    """The expression's text: the name of an output column without an alias."""
    match e:
        case Literal(v):
            return shown(v)
        case Name(n):
            return n
        case Star():
            return "*"
        case Unary("NOT", of):
            return f"NOT {display(of)}"
        case Unary(op, of):
            return f"{op}{display(of)}"
        case Binary(a, op, b):
            return f"{display(a)} {op} {display(b)}"
        case IsNull(of, negated):
            return f"{display(of)} IS {'NOT ' * negated}NULL"
        case Alias(of, name):
            return f"{display(of)} AS {name}"
        case Nested(of):
            return f"({display(of)})"
    raise TypeError(e)


def unwrapped(e: Expr) -> Expr:
    """Without parentheses, which the tree's shape makes redundant."""
    match e:
        case Nested(of):
            return unwrapped(of)
        case Unary(op, of):
            return Unary(op, unwrapped(of))
        case Binary(a, op, b):
            return Binary(unwrapped(a), op, unwrapped(b))
        case IsNull(of, n):
            return IsNull(unwrapped(of), n)
        case Alias(of, n):
            return Alias(unwrapped(of), n)
    return e
