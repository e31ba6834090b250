import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the project's tables are not here")


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120 and len(o) > 100 and "flagship" in q


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["record_id", "concept", "domain", "score", "rank"] and df.count() > 0


def _same(spark, duck, name):
    rows = sorted(str([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in sorted(r.__fields__))]) for r in entry.queries()[name](spark, DATA).collect())
    got = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in got.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(str([round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)]) for r in got.fetchall())
    return rows == want


@needs_data
@pytest.mark.parametrize("name", ["c_clean_positive", "n14_detect_style", "m02_score", "t03_topk_domain", "j09_preferred_source", "u03_prompt_upsert", "g02_render_all_styles", "a04_term_counts", "s07_structured", "x02_sessions"])
def test_rows_equal_those_of_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duck = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert _same(spark, duck, name)


@needs_data
def test_scans_read_only_what_they_need(spark):
    plan = entry.queries()["s02_scan_project"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(batch_no), GreaterThan(batch_no,50)]" in plan and "original_prompt" not in plan


@needs_data
def test_top_k_is_cut_before_the_shuffle(spark):
    plan = entry.queries()["t03_topk_domain"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
