"""Every core query with SQL agrees with DuckDB on the smallest tables; the others run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from leafspan.plans import registry

#: Left to the driver, whose comparison covers them, or to the tests of their operators.
SLOW = {
    "pipeline", "harmonize_full", "harmonize_two_engines", "unmatched_secondary", "vote_weights", "sanitize_full", "csv_sanitized", "evaluate_pass", "reading_order_compact", "anchor_clusters",
    "layout_diagnostics", "band_lines", "cluster_outliers", "cluster_edges", "order_concordance", "missed_content_compact", "missed_content", "lines_json", "text_rows", "assigned_columns", "fuse_align", "orphan_segments",
}
#: Without rows on the smallest tables.
EMPTY = {"fragment_words", "unmatched_secondary"}


def rows(frame):
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple("" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    if (sql := registry.oracle_sql().get(name)) is None:
        assert len(got) or name in EMPTY
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got[sorted(got.columns)]) == rows(want[sorted(want.columns)])


def test_oracles_have_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
