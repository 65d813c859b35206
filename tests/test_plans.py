import ast
from pathlib import Path

import pytest

from millrace.plans import clickstream
from millrace.plans.hits import hits

ROOT = Path(__file__).resolve().parent.parent
DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(clickstream.PLANS))
def test_no_python_in_a_plan(spark, name):
    text = plan(clickstream.run(name, hits(spark, DIR), clickstream.SCALED))
    assert not any(x in text for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_columns_are_pruned(spark):
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan(clickstream.run("q10", hits(spark, DIR)))
    assert "ReadSchema: struct<>" in plan(clickstream.run("q01", hits(spark, DIR)))


def test_filters_are_pushed(spark):
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,13)]" in plan(clickstream.run("q20", hits(spark, DIR), clickstream.SCALED))


@pytest.mark.parametrize("name", ["q09", "q13", "q24", "q39", "q43"])
def test_top_k_is_one_operator(spark, name):
    text = plan(clickstream.run(name, hits(spark, DIR), clickstream.SCALED))
    assert "TakeOrderedAndProject" in text and "Sort [" not in text


def test_nothing_else_imports_the_subpackage():
    for f in [*ROOT.glob("millrace/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), f


def test_defaults_are_the_query_sets(spark):
    p = clickstream.Params()
    assert (p.offset, p.having, p.month) == (1000, 100_000, ("2013-07-01", "2013-07-31"))
