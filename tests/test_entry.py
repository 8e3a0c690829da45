import sys

import pytest


def test_library_queries(spark):
    from auralake.plans import queries as plans

    assert set(plans.SQL) <= set(plans.QUERIES) and len(plans.SQL) > 25


def test_import_without_the_corpus_parts(monkeypatch):
    """The entry points work without the subpackage and the pipeline."""
    import importlib.util as u

    real = u.find_spec
    monkeypatch.setattr(u, "find_spec", lambda name, *a: None if name.startswith(("auralake.llm", "corpus_pipeline")) else real(name, *a))
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as entry

    assert "lm_perplexity" in entry.queries() and not any(q.startswith("op") or q == "pipeline" for q in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["tok_counts", "lm_nused_hist", "cmn_batch", "fsg_null_closure", "frame_energy"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from auralake.plans import queries as plans

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.execute(plans.SQL[name])
    cols = [d[0] for d in want.description]
    rows = sorted(map(tuple, want.fetchall()))
    assert sorted(map(tuple, plans.QUERIES[name](spark, folder).select(*cols).collect())) == rows
