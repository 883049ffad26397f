"""Every catalogue query that has SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from wavelark.plans import catalogue, fixtures, oracle

SF = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(data):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(clean, r)) for r in data), key=repr)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalogue.queries())
    assert set(catalogue.queries()) - set(SQL) == {"vq_lbg", "hmm_generate"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(map(tuple, df.select(*columns).collect())) == rows(want.fetchall())


def events_agree(spark, folder, name, signals):
    """The query and its SQL on a table of these users' event types."""
    stamp = "timestamp '2024-01-01' + i * interval 1 second"
    con = duckdb.connect()
    con.execute("create table kinds (user_id bigint, i bigint, event_type varchar)")
    con.executemany("insert into kinds values (?, ?, ?)", [(u, i, kind) for u, kinds in signals.items() for i, kind in enumerate(kinds)])
    con.execute(f"create table events as select user_id * 1000 + i as event_id, {stamp} as ts, user_id, event_type, i + 0.5::double as value from kinds")
    con.execute(f"copy events to '{folder}/events.parquet' (format parquet)")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    want = rows(want.fetchall())
    assert rows(map(tuple, catalogue.queries()[name](spark, str(folder)).select(*columns).collect())) == want
    return want


def test_intervals_that_end_with_the_signal_are_left_out(spark, tmp_path):
    at_end = {u: ["view"] * (45 + 2 * u) for u in range(20)}
    longer = {u + 20: ["view"] * (46 + 2 * u) for u in range(20)}
    assert [r[0] for r in events_agree(spark, tmp_path, "sel_signal_interval", at_end | longer)] == list(range(20, 40))


def test_paths_of_almost_equal_likelihood(spark, tmp_path):
    """The last model has two paths whose logarithms differ in the last bits only."""
    kinds = sorted(fixtures.SYMBOLS, key=fixtures.SYMBOLS.get)
    symbols = "22333122333123243244003423221232211132420330213122303443220234030414433"
    events_agree(spark, tmp_path, "hmm_viterbi", {87182: [kinds[int(o)] for o in symbols]})


def test_no_query_reads_a_subset_of_ids():
    from wavelark.plans import catalogue as module

    source = Path(module.__file__).read_text()
    assert "user_id % 4 =" not in source and "selection % 2" not in source


def test_the_rest_works_without_the_corpus_folders(tmp_path):
    """The two folders and the pipeline are deleted from a copy."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).parent.parent
    shutil.copytree(root / "wavelark", tmp_path / "wavelark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'op1_exact_dedup' not in e.queries() and 'pipeline' not in e.queries() and 'hmm_forward' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_features_do_not_depend_on_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['wavelark.llm'] = None; import __spark_entry__ as e; assert 'op1_exact_dedup' not in e.queries() and 'hmm_forward' in e.queries() and 'hmm_forward' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
