"""Every query with SQL against DuckDB on the smallest tables, and the published regression constants."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()
MINE = {name for m in entry.MODULES for name in m.QUERIES}
SMALL = os.environ.get("TEST_SMALL_DIR", "/root/testdata/sf0.001")
#: Those whose like is compared under another name; these are compared on the smallest tables.
ALIKE = {
    "boot_paired_ci", "boot_units", "boot_did", "interval_widening", "monthly_gain", "tertiles", "calibrated_brier", "wins_share", "unit_sums", "brier_by_lead", "gain_vs_persistence", "pearson_by_case", "rain_ratio_by_lead",
    "model_gw2", "model_global", "model_global4", "model_gw2z", "model_gw4s110", "model_gw4sub", "model_gw4suba", "model_gw4f", "model_bw4", "model_block_sub_all", "registry_bw2", "registry_block_sub", "block_ssd", "pair_vectors",
    "city_scores", "city_hours", "gauge_scores", "unit_ratio_quantiles", "timing_events", "union_runs", "reliability_bins", "city_csi_ci", "brier_windows_ci", "vector_variants", "mask_effect", "cadence_gains", "display_bundle", "mask_sweep", "band_summary",
}
#: Those whose result may be empty.
EMPTY = {"gauge_faulty"}


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(repr([one(r[i]) for i in order]) for r in rows)


def compared(spark, sf, name):
    """The rows of a query after they were found equal to those of its SQL, in a database of its own."""
    import duckdb

    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        columns, expected = want.columns, want.fetchall()
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    rows = canonical([tuple(r) for r in got.collect()], got.columns)
    assert rows == canonical(expected, columns)
    return rows


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted((MINE & set(entry.oracle_sql())) - ALIKE))
def test_same_as_sql(spark, name):
    assert compared(spark, SF, name) or name in EMPTY


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(MINE & set(entry.oracle_sql()) & ALIKE))
def test_same_as_sql_on_small_tables(spark, name):
    compared(spark, SMALL, name)


def test_index_counts_of_a_score_with_dry_frames(spark):
    """A forecast without a wet cell and a frame without one are cases too."""
    from pluvia.plans.movement import _scores

    truth = spark.createDataFrame([(1, 0, 0, 3), (2, 0, 0, 3), (5, 1, 1, 4)], "f long, r int, c int, v long")
    issues = spark.createDataFrame([(1,), (2,), (5,)], "f long")
    made = spark.createDataFrame([(2, 1, 0, 0, 2.5), (2, 2, 0, 0, 1.0)], "f long, lead int, r int, c int, p double")
    got = {r.lead: (r.cases, r.sum_f, r.hit, r.miss, r.fa) for r in _scores(made, truth, issues, 1, "m").collect()}
    assert got == {1: (2, 2.5, 0, 1, 1), 2: (2, 1.0, 0, 0, 0)}
    assert {r.lead: r.cases for r in _scores(made, truth, issues, 2, "m").collect()} == {1: 1, 2: 1}


def test_tangents_keep_each_piece_monotone():
    from pluvia.plans.reports import limited

    assert list(limited([], [0.0])) == [0.0]
    assert list(limited([0.0, 1.0], [1.0, 2.0, 5.0])) == [0.0, 0.0, 3.0]
    made = list(limited([1.0, 2.0, 0.5], [1.0, 1.3, 0.8, 9.0]))
    assert made[:2] == [1.0, 1.3] and all(math.hypot(a / s, b / s) <= 3 + 1e-9 for a, b, s in zip(made, made[1:], [1.0, 2.0, 0.5], strict=False))


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_regression_constants(spark):
    first = next(r for r in entry.queries()["fss_by_lead"](spark, "/root/testdata/sf0.01").collect() if r.lead == 1)
    assert (first.err, first.ref, first.n, round(first.fss, 4)) == (54633030, 259287846, 724, 0.7893)


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_local_chances_are_those_of_numpy(spark):
    import numpy as np

    from pluvia.plans import studies, trial

    frames = {r.f: np.array(r.v).reshape(32, 48) for r in trial.packed(spark, SF).collect()}
    issues = {r.f for r in trial.issues(spark, SF).select("f").collect()}
    i, j = np.mgrid[-3:4, -3:4]
    want = {}
    for combo, (sigma, ratio, angle) in studies.COMBOS.items():
        w = np.exp(-0.5 * (((j * np.cos(angle) + i * np.sin(angle)) / sigma) ** 2 + ((-j * np.sin(angle) + i * np.cos(angle)) / (ratio * sigma)) ** 2))
        spread = lambda x, w=w / w.sum(): sum(w[a + 3, b + 3] * np.pad(x, 3)[3 - a : 35 - a, 3 - b : 51 - b] for a in range(-3, 4) for b in range(-3, 4))
        for thr in (1, 2, 4):
            for f in issues:
                known = ~np.isnan(frames[f])
                below = spread(known.astype(float))
                chance = np.where(below > 1e-6, np.minimum(1, spread((known & (np.nan_to_num(frames[f]) >= thr)).astype(float)) / np.maximum(below, 1e-9)), 0)
                for lead in (1, 2, 3):
                    if f + lead in frames:
                        seen = ~np.isnan(frames[f + lead])
                        was = frames[f + lead][seen] >= thr
                        have = want.setdefault((thr, combo, lead), [0, 0, 0.0])
                        have[:] = have[0] + len(was), have[1] + int(was.sum()), have[2] + float(((chance[seen] - was) ** 2).sum())
    got = {(r.thr, r.combo, r.lead): (r.n, r.o, r.brier) for r in studies.local_chances(spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) == 18
    assert all(got[k][:2] == tuple(want[k][:2]) and abs(got[k][2] - want[k][2]) < 1e-2 for k in got)
