"""Reports from templates: {{kind:argument:...}} marks a number, {{table:name}} a table.

All marks of a template become rows of one relation (place, kind, a, b, lead, x), which meets the
pooled scores, the comparisons of pairs of models and the episodes' rain ratios by model and lead;
one plan gives all texts. What comes to the driver is a line for each mark. A mark of an unknown
kind, with too few arguments, or without a value is an error that names it.

Scores are those of score rows (score.shift_rows); an episode is a unit of comparison.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.operators import pool

MARK = re.compile(r"\{\{([a-z]+)((?::[^{}:]*)*)\}\}")
#: Kind -> arguments, format, values. m are pooled scores of model a, p the comparison of a and b, u the ratios of a's units. b is the baseline if not named.
KINDS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "f": ("a lead", "%.2f", ("m.fss",)),
    "d": ("a lead", "%+.3f", ("p.d",)),
    "r": ("a lead", "%.2f", ("m.ratio",)),
    "b": ("a lead", "%+.4f", ("p.brier",)),
    "c": ("a lead x", "%.2f", ("element_at(m.csi, t.x)",)),
    "pod": ("a lead x", "%.0f%%", ("100 * element_at(m.pod, t.x)",)),
    "far": ("a lead x", "%.0f%%", ("100 * element_at(m.far, t.x)",)),
    "bs": ("a lead", "%.4f", ("m.brier",)),
    "rmse": ("a lead", "%.2f", ("m.rmse",)),
    "bias": ("a lead", "%+.3f", ("m.bias",)),
    "corr": ("a lead", "%.2f", ("m.corr",)),
    "n": ("a lead", "%,d", ("m.cases",)),
    "u": ("a lead", "%d", ("m.units",)),
    "ci": ("a lead", "%+.3f to %+.3f", ("p.d_low", "p.d_high",)),
    "pd": ("a b lead", "%+.3f [%+.3f, %+.3f]", ("p.d", "p.d_low", "p.d_high",)),
    "pc": ("a b lead", "%.0f%%", ("100 * p.relative",)),
    "pci": ("a b lead", "%.0f%% to %.0f%%", ("100 * p.r_low", "100 * p.r_high",)),
    "pw": ("a b lead", "%.0f%%", ("100 * p.wins",)),
    "over": ("a lead", "%.0f%%", ("100 * u.over",)),
    "q": ("a lead x", "%.2f", ("quantile",)),
}
THRESHOLDS = (1, 2, 4)
#: Table -> its head, and the marks of a line for each model and lead; {a} and {lead} stand for them.
TABLES = {
    "scores": ("| Model | Lead | FSS | Gain | Correlation |", "| {a} | {lead} | {{{{f:{a}:{lead}}}}} | {{{{d:{a}:{lead}}}}} | {{{{corr:{a}:{lead}}}}} |"),
    "events": ("| Model | Lead | CSI 1 | CSI 2 | CSI 4 |", "| {a} | {lead} | {{{{c:{a}:{lead}:1}}}} | {{{{c:{a}:{lead}:2}}}} | {{{{c:{a}:{lead}:4}}}} |"),
    "rain": ("| Model | Lead | Ratio | Over | Quartiles |", "| {a} | {lead} | {{{{r:{a}:{lead}}}}} | {{{{over:{a}:{lead}}}}} | {{{{q:{a}:{lead}:25}}}} to {{{{q:{a}:{lead}:75}}}} |"),
    "pairs": ("| Model | Lead | Difference | Wins |", "| {a} | {lead} | {{{{pd:{a}:persistence:{lead}}}}} | {{{{pw:{a}:persistence:{lead}}}}} |"),
    "errors": ("| Model | Lead | Cases | RMSE | Bias | Brier |", "| {a} | {lead} | {{{{n:{a}:{lead}}}}} | {{{{rmse:{a}:{lead}}}}} | {{{{bias:{a}:{lead}}}}} | {{{{bs:{a}:{lead}}}}} |"),
}


def marks(template: str) -> list[dict]:
    """The template's marks in order, with their arguments by name."""
    out = []
    for m in MARK.finditer(template):
        kind, given = m[1], m[2].split(":")[1:]
        if kind not in KINDS:
            raise KeyError(f"{m[0]} is of no known kind; there are {', '.join(sorted(KINDS))}")
        names = KINDS[kind][0].split()
        if len(given) != len(names):
            raise ValueError(f"{m[0]} needs {', '.join(names)}")
        args = dict(zip(names, given, strict=True))
        out.append({"place": len(out), "mark": m[0], "kind": kind, "a": args["a"], "b": args.get("b", pool.BASELINE), "lead": int(args["lead"]), "x": args.get("x")})
    return out


def with_tables(template: str, models: list[str], leads: list[int]) -> str:
    """The template with its tables written out as lines of marks; the comparison of the baseline with itself is left out."""

    def lines(m):
        if m[1] not in TABLES:
            raise KeyError(f"no table {m[1]!r}; there are {', '.join(sorted(TABLES))}")
        head, line = TABLES[m[1]]
        rule = "|" + "---|" * (head.count("|") - 1)
        return "\n".join([head, rule, *(line.format(a=a, lead=lead) for lead in leads for a in models if not (m[1] == "pairs" and a == pool.BASELINE))])

    return re.sub(r"\{\{table:([a-z]+)\}\}", lines, template)


def relations(rows: DataFrame, n: int, seed: int, write) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of score rows: (model, lead, scores), (a, b, lead, comparisons) and (model, lead, ratios), each with a row for each model or pair and lead."""
    total = lambda c: F.sum(c).cast("double")
    share = lambda top, *below: F.create_map(*(x for t in THRESHOLDS for x in (F.lit(str(t)), F.try_divide(total(f"{top}_{t}"), sum((total(f"{k}_{t}") for k in below[1:]), total(f"{below[0]}_{t}"))))))
    pooled = rows.groupBy("model", "lead").agg(
        (1 - F.try_divide(total("fss_e"), total("fss_r"))).alias("fss"), F.try_divide(total("sum_f"), total("sum_t")).alias("ratio"), F.try_divide(total("brier"), total("n")).alias("brier"),
        share("hit", "hit", "miss", "fa").alias("csi"), share("hit", "hit", "miss").alias("pod"), share("fa", "hit", "fa").alias("far"),
        F.sqrt(F.try_divide(total("sse"), total("n"))).alias("rmse"), F.try_divide(total("sum_f") - total("sum_t"), total("n")).alias("bias"), F.avg("corr").alias("corr"),
        F.count("*").alias("cases"), F.count_distinct("event").cast("int").alias("units"),
    )
    units = write(rows.groupBy(F.col("event").alias("unit"), "model", "lead").agg(*(F.sum(c).cast("double").alias(c) for c in ("fss_e", "fss_r", "brier", "n", "sum_f", "sum_t"))))
    one, two = (units.select("unit", "lead", *(F.col(c).alias(f"{c}{k}") for c in ("model", "fss_e", "fss_r", "brier", "n"))) for k in (1, 2))
    pairs = write(one.join(two, ["unit", "lead"]).withColumnsRenamed({"model1": "a", "model2": "b"}))
    score = lambda k, w="1": f"1 - try_divide(sum({w} * fss_e{k}), sum({w} * fss_r{k}))"
    better = F.when((F.col("fss_r1") > 0) & (F.col("fss_r2") > 0), (F.col("fss_e1") / F.col("fss_r1") < F.col("fss_e2") / F.col("fss_r2")).cast("double"))
    gain = F.expr("try_divide(sum(brier2), sum(n2)) - try_divide(sum(brier1), sum(n1))")
    whole = pairs.groupBy("a", "b", "lead").agg(F.expr(f"({score(1)}) - ({score(2)})").alias("d"), F.expr(f"try_divide({score(1)}, {score(2)}) - 1").alias("relative"), gain.alias("brier"), F.avg(better).alias("wins"))
    drawn = pairs.join(pool.draws(pairs, n, seed), "unit").groupBy("a", "b", "lead", "draw").agg(F.expr(f"({score(1, 'w')}) - ({score(2, 'w')})").alias("d"), F.expr(f"try_divide({score(1, 'w')}, {score(2, 'w')}) - 1").alias("r"))
    edges = drawn.groupBy("a", "b", "lead").agg(*(F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in ("d", "r") for name, q in (("low", 0.025), ("high", 0.975))))
    ratios = units.where("sum_f > 0 AND sum_t > 0").groupBy("model", "lead").agg(F.array_sort(F.collect_list(F.col("sum_f") / F.col("sum_t"))).alias("ratios"), F.avg((F.col("sum_f") > F.col("sum_t")).cast("double")).alias("over"))  # a number for each episode
    return pooled, whole.join(edges, ["a", "b", "lead"]), ratios


def texts(asked: DataFrame, pooled: DataFrame, paired: DataFrame, ratios: DataFrame) -> DataFrame:
    """(place, mark, text) of marks (place, mark, kind, a, b, lead, x); text is NULL where there is no value."""
    met = asked.alias("t").join(pooled.alias("m"), (F.col("t.a") == F.col("m.model")) & (F.col("t.lead") == F.col("m.lead")), "left")
    met = met.join(paired.alias("p"), (F.col("t.a") == F.col("p.a")) & (F.col("t.b") == F.col("p.b")) & (F.col("t.lead") == F.col("p.lead")), "left")
    met = met.join(ratios.alias("u"), (F.col("t.a") == F.col("u.model")) & (F.col("t.lead") == F.col("u.lead")), "left")
    # a quantile between two of the ordered ratios
    at = F.col("t.x").cast("double") / 100 * (F.size("u.ratios") - 1)
    ratio = lambda place: F.get(F.col("u.ratios"), place.cast("int"))
    met = met.withColumn("quantile", ratio(F.floor(at)) + (at - F.floor(at)) * (ratio(F.ceil(at)) - ratio(F.floor(at))))
    text: Column = F.lit(None).cast("string")
    for kind, (_, form, given) in KINDS.items():
        values = [F.expr(v) for v in given]
        known = reduce(Column.__and__, (v.isNotNull() for v in values))
        text = F.when((F.col("t.kind") == kind) & known, F.format_string(form, *values)).otherwise(text)
    return met.select("t.place", "t.mark", text.alias("text"))


def rendered(spark, template: str, rows: DataFrame, n: int, seed: int, write) -> str:
    """The template with all marks in place."""
    models, leads = (sorted(r[0] for r in rows.select(c).distinct().collect()) for c in ("model", "lead"))
    whole = with_tables(template, models, leads)
    asked = marks(whole)
    if not asked:
        return whole
    df = spark.createDataFrame([tuple(m.values()) for m in asked], "place int, mark string, kind string, a string, b string, lead int, x string")
    found = {r.place: r.text for r in texts(df, *relations(rows, n, seed, write)).collect()}
    if missing := [m["mark"] for m in asked if found.get(m["place"]) is None]:
        raise KeyError(f"no value for {', '.join(missing)}")
    place = iter(range(len(asked)))
    return MARK.sub(lambda m: found[next(place)], whole)
