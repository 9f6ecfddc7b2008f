"""C3 linearisation over class names.

Bases that a file doesn't define stay in the order but bring no ancestors of
their own.  An impossible order, or a cycle, gives the class alone.
"""

from __future__ import annotations


def _merged(sequences: list[list[str]]) -> list[str]:
    out: list[str] = []
    rest = [list(s) for s in sequences if s]
    while rest:
        head = next((s[0] for s in rest if not any(s[0] in t[1:] for t in rest)), None)
        if head is None:
            raise ValueError("no consistent order")
        out.append(head)
        rest = [t for t in ([x for x in s if x != head] for s in rest) if t]
    return out


def linearized(bases: dict[str, list[str]], name: str) -> list[str]:
    """The order, without a closing ``object``.

    >>> linearized({"D": ["B", "C"], "B": ["A"], "C": ["A"], "A": []}, "D")
    ['D', 'B', 'C', 'A']
    """

    def order(cls: str, above: tuple[str, ...]) -> list[str]:
        if cls in above:
            raise ValueError("a cycle")
        own = bases.get(cls, [])
        known = [order(b, (*above, cls)) for b in own if b in bases]
        return [cls, *_merged([*known, list(own)])]

    try:
        found = order(name, ())
    except (ValueError, RecursionError):
        return [name]
    return found[:-1] if len(found) > 1 and found[-1] == "object" else found


def between(order: list[str], upper: str) -> list[str]:
    """The part of an order up to ``upper``, itself included; nothing if it isn't there."""
    return order[: order.index(upper) + 1] if upper in order else []
