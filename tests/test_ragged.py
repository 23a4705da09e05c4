"""Rasters whose last line of tiles is not full: the SQL's results up to the ragged end."""

import numpy as np
import pytest
from stratum.operators import blocks as B


@pytest.fixture(scope="module")
def ragged(tmp_path_factory):
    """A folder of tables with 3 lines of tiles of 25 and 6 tiles more."""
    import duckdb

    folder = tmp_path_factory.mktemp("ragged")
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.125, 64)], 0) for i in range(81)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    con.execute(f"COPY embeddings TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", ["erode_dilate", "opening_tophat", "prominence", "resample_centres", "resample_corners", "kept_relief", "local_relief"])
def test_query(spark, ragged, name):
    import __spark_entry__ as entry

    folder, con = ragged
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
    key = [columns.index(c) for c in ("row", "col")]
    at = lambda rows: {tuple(r[i] for i in key): r for r in rows}
    got, want = at([tuple(r[c] for c in columns) for r in df.collect()]), at(want)
    assert len(got) == df.count() and got.keys() == want.keys()
    for k, r in want.items():
        assert got[k] == pytest.approx(r, abs=1.5e-6), k


def test_absent_cells_have_no_part():
    v = np.array([[1.0, 2.0, 3.0], [4.0, np.nan, np.nan], [0.0, 5.0, 6.0]])
    there = np.array([[True, True, True], [True, False, False], [True, True, True]])
    g = B.Grid(v, 0, 0, (True,) * 4, there)
    assert np.allclose(B.extreme(g, 3, False).v, [[1, 1, 2], [0, np.nan, np.nan], [0, 0, 5]], equal_nan=True)
    got = B.gaussian(g, 1.0)
    assert not np.isnan(got.v[there]).any() and np.allclose(got.v[there], B.gaussian(g.like(np.where(there, v, 99.0)), 1.0).v[there])
