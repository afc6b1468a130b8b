"""Budgets and prefixes against a plain version."""

import hashlib

import pytest

from adtally.llm import mixing
from adtally.llm.queries import QUERIES
from adtally.llm.sql import SQL
from tests.oracle import differences


def plain_share(children, budget):
    """children: name -> (held, weight); the order of filling as in the library."""
    out, left = {}, dict(children)
    while left:
        weight = sum(w for _, w in left.values())
        full = [k for k, (held, w) in left.items() if held * weight <= budget * w]
        if not full:
            break
        k = min(full, key=lambda k: (left[k][0] / left[k][1], k))
        out[k] = left[k][0]
        budget -= left.pop(k)[0]
    order = sorted(left, key=lambda k: (left[k][0] / left[k][1], k))
    weight, upto = sum(w for _, w in left.values()), 0
    for k in order:
        w = left[k][1]
        out[k] = min(budget * (upto + w) // weight - budget * upto // weight, left[k][0])
        upto += w
    return out


def plain_mix(rows, path, weights, share, epochs, seed=42):
    """rows: (path values..., id, tokens) without repeated ids; copies by id."""
    depth = len(path)
    leaves = {}
    for *names, _, tokens in rows:
        leaves[tuple(names)] = leaves.get(tuple(names), 0) + tokens
    total = min(sum(leaves.values()) * epochs, int(sum(leaves.values()) * share))
    budgets = {(): total}
    for d in range(depth):
        lower = {}
        for parent, budget in budgets.items():
            children = {}
            for leaf, tokens in leaves.items():
                if leaf[:d] == parent:
                    held = children.get(leaf[d], (0, 0))[0]
                    children[leaf[d]] = (held + tokens * epochs, weights.get((path[d], leaf[d]), 1))
            for name, part in plain_share(children, budget).items():
                lower[(*parent, name)] = part
        budgets = lower
    copies = {}
    for leaf, budget in budgets.items():
        whole, part = divmod(budget, leaves[leaf]) if leaves[leaf] else (0, 0)
        own = sorted((hashlib.md5(f"{seed}:{whole}:{r[depth]}".encode()).hexdigest(), r[depth], r[-1]) for r in rows if tuple(r[:depth]) == leaf)
        done = 0
        for _, key, tokens in own:
            done += tokens
            copies[key] = whole + (1 if part and done <= part else 0)
    return copies, budgets


@pytest.mark.parametrize(("share", "epochs"), [(1.0, 4), (0.3, 1), (2.5, 3), (9.0, 2)])
def test_against_plain(spark, share, epochs):
    rows = []
    for i in range(700):
        domain, lang, source = f"d{i % 3}", f"l{i % 5 % 2}", f"s{i % 7}"
        tokens = (i * 37) % 90 if source != "s1" else 3
        rows.append((domain, lang, source, i, tokens))
    weights = {("domain", "d0"): 7, ("domain", "d1"): 2, ("lang", "l0"): 5, ("source", "s1"): 20}
    table = spark.createDataFrame(rows, "domain string, lang string, source string, id long, tokens long")
    listed = spark.createDataFrame([(*k, w) for k, w in weights.items()], "level string, name string, weight long")
    found = mixing.mixed(table, ["domain", "lang", "source"], listed, share, epochs, rows_per_slice=7)
    expected, budgets = plain_mix(rows, ["domain", "lang", "source"], weights, share, epochs)
    assert {r.id: r.copies for r in found.collect()} == expected
    assert sum(budgets.values()) == min(sum(r[-1] for r in rows) * epochs, int(sum(r[-1] for r in rows) * share))


def test_shortage_goes_to_siblings_first(spark):
    """d0's short source is made up for by d0's other source; d1 keeps its half."""
    rows = [("d0", "a", 1, 10), ("d0", "b", 2, 100), ("d1", "c", 3, 100)]
    table = spark.createDataFrame(rows, "domain string, source string, id long, tokens long")
    leaves = table.groupBy("domain", "source").agg({"tokens": "sum", "*": "count"}).toDF("domain", "source", "tokens", "n")
    found = mixing.budgets(leaves.select("domain", "source", "n", "tokens"), ["domain", "source"], None, 120 / 210, 1)
    assert {r.source: r.budget for r in found.collect()} == {"a": 10, "b": 50, "c": 60}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.select("lang", "source", "doc_id", mixing.estimated_tokens(odd_docs["text"]).alias("tokens"))
    found = mixing.mixed(rows, ["lang", "source"], id_column="doc_id", total_share=3.0, epochs=3).collect()
    assert len(found) == odd_docs.count() and all(r.copies == 3 for r in found if r.tokens)
    empty = no_docs.select("lang", "source", "doc_id", mixing.estimated_tokens(no_docs["text"]).alias("tokens"))
    assert mixing.mixed(empty, ["lang", "source"], id_column="doc_id").count() == 0


def test_no_python_in_the_plan(spark, root):
    plan = QUERIES["op4_source_mixing"](spark, root)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_against_sql(spark, root):
    assert differences(spark, QUERIES["op4_source_mixing"], SQL["op4_source_mixing"], root) is None
