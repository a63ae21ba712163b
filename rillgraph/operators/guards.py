"""Path conditions: boolean functions of branch variables, and under which of them one block or node reaches another.

A function is a reduced ordered decision diagram: TRUE, FALSE, or a node (variable, function where it is false, function where it is true), variables
growing downward. Nodes are kept once in a table, so equal functions are the same node, whatever their number of variables. The
tables are given up before each group of rows. Functions are computed per program function or source, each of which is one group.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many variables a function is written as the assignments under which it holds, beyond as the diagram's paths.
SPELLED = 12


class Guard:
    """A node of a diagram, made by _node() alone; compared by identity."""

    __slots__ = ("high", "low", "var")

    def __init__(self, var: int, low: Guard | None, high: Guard | None) -> None:
        self.var, self.low, self.high = var, low, high

    def __repr__(self) -> str:
        return shown(self)

    def support(self) -> tuple[int, ...]:
        """The variables that it depends on."""
        seen, todo, out = set(), [self], set()
        while todo:
            g = todo.pop()
            if g.low is not None and id(g) not in seen:
                seen.add(id(g))
                out.add(g.var)
                todo += [g.low, g.high]
        return tuple(sorted(out))


#: Terminals stand below all variables.
_BELOW = 1 << 62
FALSE, TRUE = Guard(_BELOW, None, None), Guard(_BELOW + 1, None, None)
_nodes: dict[tuple[int, int, int], Guard] = {}
_results: dict[tuple[str, int, int], Guard] = {}


def forget() -> None:
    """Give up the tables; functions made before must not be joined with later ones."""
    _nodes.clear()
    _results.clear()


def _node(v: int, low: Guard, high: Guard) -> Guard:
    if low is high:
        return low
    key = v, id(low), id(high)
    if key not in _nodes:
        _nodes[key] = Guard(v, low, high)
    return _nodes[key]


def var(v: int, positive: bool = True) -> Guard:
    """The variable, or its complement."""
    return _node(v, FALSE, TRUE) if positive else _node(v, TRUE, FALSE)


def _joined(a: Guard, b: Guard, op: str) -> Guard:
    """The conjunction (op &) or disjunction (op |)."""
    zero, one = (FALSE, TRUE) if op == "&" else (TRUE, FALSE)
    if zero in (a, b):
        return zero
    if a is one or a is b:
        return b
    if b is one:
        return a
    key = op, min(id(a), id(b)), max(id(a), id(b))
    if key not in _results:
        v = min(a.var, b.var)
        (a0, a1), (b0, b1) = ((g.low, g.high) if g.var == v else (g, g) for g in (a, b))
        _results[key] = _node(v, _joined(a0, b0, op), _joined(a1, b1, op))
    return _results[key]


def both(a: Guard, b: Guard) -> Guard:
    """Conjunction."""
    return _joined(a, b, "&")


def either(a: Guard, b: Guard) -> Guard:
    """Disjunction."""
    return _joined(a, b, "|")


def negated(a: Guard) -> Guard:
    """Complement."""
    if a.low is None:
        return FALSE if a is TRUE else TRUE
    key = "!", id(a), 0
    if key not in _results:
        _results[key] = _node(a.var, negated(a.low), negated(a.high))
    return _results[key]


def holds(g: Guard, true: set[int]) -> bool:
    """The value where exactly the variables of `true` are true."""
    while g.low is not None:
        g = g.high if g.var in true else g.low
    return g is TRUE


def shown(g: Guard) -> str:
    """The function as a sum of products, as text."""
    if g.low is None:
        return "true" if g is TRUE else "false"
    over = g.support()
    if len(over) <= SPELLED:
        chosen = (k for k in range(1 << len(over)) if holds(g, {v for j, v in enumerate(over) if k >> j & 1}))
        return "|".join("&".join(("" if k >> j & 1 else "!") + f"v{v}" for j, v in enumerate(over)) for k in chosen)
    out, todo = [], [(g, ())]
    while todo:
        at, terms = todo.pop()
        if at is TRUE:
            out.append("&".join(terms))
        elif at.low is not None:
            todo += [(at.high, (*terms, f"v{at.var}")), (at.low, (*terms, f"!v{at.var}"))]
    return "|".join(out)


def reached(edges: Iterable[tuple[int, int, Guard]], start: int) -> dict[int, Guard]:
    """Under which condition each node is reached from start; edges are (src, dst, guard)."""
    out: dict[int, list[tuple[int, Guard]]] = {}
    for s, d, g in edges:
        out.setdefault(s, []).append((d, g))
    known, todo = {start: TRUE}, [start]
    while todo:
        s = todo.pop(0)
        for d, g in out.get(s, ()):
            now = either(known.get(d, FALSE), both(known[s], g))
            if now != known.get(d, FALSE):
                known[d] = now
                if d not in todo:
                    todo.append(d)
    return known


def edge_guard(n_succ: int, succ_ix: int, first_var: int, test: str | None = None) -> Guard:
    """The condition of a branch's edge: ceil(log2(n_succ)) variables from first_var, which spell succ_ix; tests for null are
    settled: a freed or allocated pointer is not null, so the edge on which it is has no paths."""
    if test == "eq_null" and n_succ == 2:
        return FALSE if succ_ix == 0 else TRUE
    if test == "ne_null" and n_succ == 2:
        return TRUE if succ_ix == 0 else FALSE
    bits = max(0, n_succ - 1).bit_length()
    return reduce(both, (var(first_var + j, bool(succ_ix >> j & 1)) for j in range(bits)), TRUE)


# What runs in workers is at module level: it is found by name there, with that process's own TRUE and FALSE.


def _blocks(rows):
    import pandas as pd

    forget()
    edges = [(r.src, r.dst, FALSE if r.exits else edge_guard(r.n_succ, r.succ_ix, r.first_var, r.test)) for r in rows.itertuples()]
    out = [(rows["func"].iloc[0], s, d, shown(g), g == TRUE) for s in sorted({e[0] for e in edges}) for d, g in sorted(reached(edges, s).items(), key=lambda x: x[0]) if d != s and g != FALSE]
    return pd.DataFrame(out, columns=["func", "src", "dst", "guard", "always"])


def block_guards(cfg: DataFrame) -> DataFrame:
    """(func, src, dst, guard, always): under which condition each block reaches another, as text.

    cfg: (func, src, dst, succ_ix, n_succ, first_var, test, exits): exits marks blocks (dst) that end the program; no path leads through them.
    """
    kinds = dict(cfg.dtypes)
    return cfg.groupBy("func").applyInPandas(_blocks, f"func {kinds['func']}, src long, dst long, guard string, always boolean")


def _verdict(key, rows, ends):
    import pandas as pd

    forget()
    given = [(r.src, r.dst, TRUE if pd.isna(r.v) else var(int(r.v), bool(r.positive))) for r in rows.itertuples()]
    known = reached(given, key[0])
    found = [known.get(n, FALSE) for n in sorted(set(ends["node"]))]
    pair, whole = False, FALSE
    for g in found:  # two hold together if one holds together with any before it
        pair = pair or both(whole, g) != FALSE
        whole = either(whole, g)
    return pd.DataFrame([(key[0], shown(whole), whole == TRUE, whole != FALSE, pair)], columns=["source", "guard", "all_paths", "some_path", "pair"])


def slice_verdicts(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """(source, guard, all_paths, some_path, pair): for each source the disjunction of its sinks' conditions; whether that is true (released on every
    path), satisfiable (on some), and whether two sinks' conditions hold together (released twice).

    edges: (source, src, dst, v, positive; v null: no condition); sinks: (source, node). The slice starts at the source.
    """
    return edges.groupBy("source").cogroup(sinks.groupBy("source")).applyInPandas(_verdict, "source long, guard string, all_paths boolean, some_path boolean, pair boolean")


def _sink_guards(key, rows, ends):
    import pandas as pd

    forget()
    known = reached([(r.src, r.dst, TRUE if pd.isna(r.v) else var(int(r.v), bool(r.positive))) for r in rows.itertuples()], key[0])
    out = [(key[0], n, shown(g), g != FALSE) for n in sorted(set(ends["node"])) for g in [known.get(n, FALSE)]]
    return pd.DataFrame(out, columns=["source", "node", "guard", "some_path"])


def sink_guards(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """(source, node, guard, some_path): the condition of each sink (source, node) of slices as in slice_verdicts(), and whether it can hold."""
    return edges.groupBy("source").cogroup(sinks.groupBy("source")).applyInPandas(_sink_guards, "source long, node long, guard string, some_path boolean")


def crossing_guards(inner: DataFrame, crossings: DataFrame) -> DataFrame:
    """(func, src, to_func, dst, guard, always): conditions from a block of one function to a block of another, through a call or a return.

    inner: as block_guards() gives it; crossings: (func, src, at, to_func, entered, dst). The value flows from src to at, the block of the call (or the
    function's exit), then from entered, the callee's first block (or the block returned to), to dst: both conditions hold. Functions
    have variables of their own, so the conjunction is written as it is.
    """
    def half(func: str, a: str, b: str, name: str) -> DataFrame:
        return inner.select(F.col("func").alias(func), F.col("src").alias(a), F.col("dst").alias(b), F.col("guard").alias(f"__{name}"))

    both = crossings.join(half("func", "src", "at", "c1"), ["func", "src", "at"], "left").join(half("to_func", "entered", "dst", "c2"), ["to_func", "entered", "dst"], "left")
    # a block reaches itself without a condition; other blocks without one aren't reached
    both = both.withColumn("__c1", F.when(F.col("src") == F.col("at"), "true").otherwise(F.col("__c1"))).withColumn("__c2", F.when(F.col("entered") == F.col("dst"), "true").otherwise(F.col("__c2")))
    both = both.filter("__c1 is not null and __c2 is not null")
    guard = F.when(F.col("__c1") == "true", F.col("__c2")).when(F.col("__c2") == "true", F.col("__c1")).otherwise(F.concat(F.lit("("), "__c1", F.lit(")&("), "__c2", F.lit(")")))
    return both.select("func", "src", "to_func", "dst", guard.alias("guard"), (guard == "true").alias("always")).distinct()
