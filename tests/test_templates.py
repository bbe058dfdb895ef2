"""Marks of report templates."""

import pytest

from pluvia.operators import templates

ROW = "event long, f long, model string, lead int, n long, sum_f long, sum_t long, sse long, corr double, brier double, fss_e long, fss_r long, " + ", ".join(f"{k}_{t} long" for t in (1, 2, 4) for k in ("hit", "miss", "fa"))


@pytest.fixture(scope="module")
def rows(spark):
    made = []
    for event in range(4):
        for model, e in (("persistence", 40), ("other", 10 + 5 * event)):
            made.append((event, event * 10, model, 1, 100, 50 if model == "other" else 80, 40, 900, 0.5, 10.0 if model == "other" else 20.0, e, 100, *(8, 2, 6), *(4, 4, 0), *(0, 0, 0)))
    return spark.createDataFrame(made, ROW)


def render(spark, text, rows):
    return templates.rendered(spark, text, rows, 50, 1, lambda df: df)


def test_marks_give_their_texts(spark, rows):
    text = "{{f:other:1}} {{d:other:1}} {{r:persistence:1}} {{c:other:1:1}} {{pod:other:1:1}} {{far:other:1:2}} {{n:other:1}} {{u:other:1}} {{pw:other:persistence:1}} {{pc:other:persistence:1}} {{over:persistence:1}} {{q:persistence:1:50}} {{rmse:other:1}} {{bias:other:1}} {{bs:other:1}} {{b:other:1}} {{corr:other:1}}"
    # FSS 1 - 70 / 400 and 1 - 160 / 400; halves go up
    assert render(spark, text, rows) == "0.83 +0.225 2.00 0.50 80% 0% 4 4 100% 38% 100% 2.00 3.00 +0.100 0.1000 +0.1000 0.50"


def test_intervals_hold_the_value(spark, rows):
    low, high = map(float, render(spark, "{{ci:other:1}}", rows).split(" to "))
    assert 0.1 < low < 0.225 < high < 0.31


def test_tables_are_lines_of_marks(spark, rows):
    made = render(spark, "before\n{{table:pairs}}\nafter {{n:other:1}} {braces}", rows).split("\n")
    assert made[:3] == ["before", "| Model | Lead | Difference | Wins |", "|---|---|---|---|"] and made[-1] == "after 4 {braces}"
    assert len(made) == 5 and made[3].startswith("| other | 1 | +0.225 [+0.") and made[3].endswith("| 100% |")
    assert render(spark, "{{table:scores}}", rows).count("\n") == 3


def test_marks_without_a_value_are_errors(spark, rows):
    for text, error in (("{{zz:other:1}}", "no known kind"), ("{{f:other}}", "needs a, lead"), ("{{f:other:7}}", "no value for {{f:other:7}}"), ("{{c:other:1:4}} {{f:other:1}}", "no value for {{c:other:1:4}}"), ("{{c:other:1:3}}", "no value"), ("{{table:none}}", "no table")):
        with pytest.raises((KeyError, ValueError), match=error.replace("{", r"\{").replace("}", r"\}")):
            render(spark, text, rows)
    assert render(spark, "nothing to fill", rows) == "nothing to fill"


def test_at_least_twenty_kinds_and_five_tables():
    assert len(templates.KINDS) >= 20 and len(templates.TABLES) >= 5
