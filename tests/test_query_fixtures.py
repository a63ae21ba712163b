"""Registered queries without SQL, over small tables, against plain Python."""

import random
from datetime import date, timedelta
from itertools import product

import pytest

from rillgraph import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    chance = random.Random(12)
    root = str(tmp_path_factory.mktemp("tables"))
    orders = [(k, chance.randrange(8), date(1995, 1, 1) + timedelta(days=chance.randrange(900))) for k in range(1, 60)]
    lines = [(k, chance.randrange(400), chance.randrange(24), n, chance.choice([1, 2, 2, 30])) for k, _, _ in orders for n in range(1, chance.randint(2, 5))]
    lines += [(100 + s, p, s, 9, 5) for s in range(24) for p in chance.sample(range(4000), 300)]
    suppliers = [(s, s % 3) for s in range(24)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity int").write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{root}/supplier.parquet")
    return root, orders, lines, suppliers


def run(spark, tables, name):
    return catalog.queries()[name](spark, tables[0]).collect()


def test_andersen(spark, tables):
    _, orders, lines, _ = tables
    customer = {k: c for k, c, _ in orders}
    addr = {(10**12 + customer[o] * 16 + p % 16, o) for o, p, _, n, _ in lines if n == 1 and o in customer}
    copy = set()
    for c in range(8):
        own = [k for k, x, d in sorted(orders, key=lambda r: (r[2], r[0])) if x == c]
        copy |= set(zip(own, own[1:], strict=False))
    load, store = ({e for e in copy if any(o == e[0] and n == k for o, _, _, n, _ in lines)} for k in (2, 3))
    pts, copies = {(p, o) for o, p in addr}, set(copy)
    while True:
        more = copies | {(o, d) for s, d in load for v, o in pts if v == s} | {(s, o) for s, d in store for v, o in pts if v == d}
        new = pts | {(d, o) for s, d in more for v, o in pts if v == s}
        if (new, more) == (pts, copies):
            break
        pts, copies = new, more
    assert {tuple(r) for r in run(spark, tables, "x5_andersen")} == pts and len(pts) > len(addr)


def members(tables):
    _, _, lines, suppliers = tables
    level = dict(suppliers)
    out = {}
    for _, p, s, _, _ in lines:
        out.setdefault((level[s], s), set()).add(p)
    return out


def test_grouped(spark, tables):
    want, groups = {}, {}
    for (level, context), own in sorted(members(tables).items()):
        for k, g in enumerate(groups.setdefault(level, [])):
            if len(g | own) <= 1500:
                g |= own
                break
        else:
            k = len(groups[level])
            groups[level].append(set(own))
        want[context] = (level, k)
    assert {r.context: (r.level, r.grp) for r in run(spark, tables, "rg_grouped")} == want and any(k for _, k in want.values())


def test_block_guards(spark, tables):
    got = {}
    for r in run(spark, tables, "x28_block_guards"):
        got.setdefault(int(r.func), {})[r.src, r.dst] = (r.guard, r.always)
    for (_, s), own in members(tables).items():
        blocks = {p % 8 for p in own}
        want = {}
        for bits in product((False, True), repeat=8):
            for start in blocks:
                at, seen = start, set()
                while at in blocks:  # a block branches to the next one, or, if its variable is set, to the one behind
                    at += 1 + bits[at]
                    seen.add(at)
                for d in seen:
                    want.setdefault((start, d), set()).add(bits)
        assert set(got[s]) == set(want)
        for pair, where in want.items():
            text, always = got[s][pair]
            terms = [[(t.lstrip("!")[1:], t[0] != "!") for t in x.split("&")] for x in text.split("|")] if text != "true" else [[]]
            held = {bits for bits in product((False, True), repeat=8) if any(all(bits[int(v)] == yes for v, yes in x) for x in terms)}
            assert held == where and always == (len(where) == 256)


def test_memory_ssa(spark, tables):
    want = set()
    for (_, s), own in members(tables).items():
        count = {}

        def walk(b, now, s=s, own=own, count=count):
            now = dict(now)
            for op in sorted(x for x in own if x % 6 == b):
                use, new = now.get(op % 3, 0), None
                if op % 2:
                    new = count[op % 3] = count.get(op % 3, 0) + 1
                    now[op % 3] = new
                want.add((op, s, op % 3, use, new))
            for child in (2 * b + 1, 2 * b + 2):
                if child < 6:
                    walk(child, now)

        walk(0, {})
    assert {tuple(r) for r in run(spark, tables, "x42_memory_ssa")} == want


def test_use_after_return(spark, tables):
    _, _, lines, suppliers = tables
    edges = {(s, p % len(suppliers)) for _, p, s, n, q in lines if n == 1 and q <= 2}
    edges = {(s, d, "call" if d % 5 == 0 else "ret" if d % 3 == 0 else "intra", d % 3) for s, d in edges if s < d}
    want = set()
    for start in range(6):
        todo, seen = [(start, ())], {(start, ())}
        left = set()
        while todo:
            node, ctx = todo.pop()
            for s, d, kind, cs in edges:
                if s != node or (kind == "ret" and ctx and ctx[-1] != cs):
                    continue
                if kind == "ret" and not ctx and node % 4 == start % 4:
                    left.add(d)
                then = ctx[:-1] if kind == "ret" else (*ctx, cs)[-3:] if kind == "call" else ctx
                if (d, then) not in seen:
                    seen.add((d, then))
                    todo.append((d, then))
        back = set(left)
        while more := {s for s, d, _, _ in edges if d in back} - back:
            back |= more
        want |= {(start, n) for n in back if n % 11 == 0 and n != start}
    assert {tuple(r) for r in run(spark, tables, "c6_use_after_return")} == want
