import os

import pytest

from oracle import SMALL, compare, connection
from sparkmill.operators import taxonomy
from sparkmill.plans import catalog
from sparkmill.sources import scratch

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="the small tables are not here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() >= 0


def test_entry():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("missing", ["sparkmill.llm.queries", "corpus_pipeline", "tiktoken", "public_tokenizers"])
def test_entry_without_what_the_other_queries_need(monkeypatch, missing):
    """Whatever of llm can't be imported, the queries of the catalog stay."""
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("sparkmill.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    with pytest.warns(UserWarning, match="without"):
        found = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(found) and "pipeline" not in found


def test_reverse_complements_of_all_contigs_are_whole(spark):
    from sparkmill.plans import standins

    seqs = {r.contig_idx: r.seq for r in standins.contigs(spark, SMALL).select("contig_idx", "seq").collect()}
    assert any(len(x) >= 2000 for x in seqs.values()) and not all(x.isascii() for x in seqs.values())
    got = {r.contig_idx: r.rc for r in catalog.QUERIES["reverse_complements"](spark, SMALL).collect()}
    assert got == {i: x[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca")) for i, x in seqs.items()}


def test_changed_alone_has_rows(spark):
    assert catalog.QUERIES["changed_alone"](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["tax_predictions", "pareto", "plurality_threshold"])
def test_tasks_get_a_number_of_rows(spark, monkeypatch, name):
    """Partitions that adaptive execution would join by their compressed bytes stay as many as the rows ask for."""
    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    n = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert catalog.QUERIES[name](spark, SMALL).rdd.getNumPartitions() >= n / 500


def test_plurality_of_names_without_siblings(spark):
    """A name outside the tree and the root have no siblings; a contig with only such has threshold 0."""
    tree = taxonomy.tree(taxonomy.edges(spark.createDataFrame([(["a", "b"],), (["a", "c"],)], "ranks array<string>")))
    probs = spark.createDataFrame([(1, "x", 0, 0.5), (1, "y", 0, 0.4), (1, "root", 0, 1.0), (2, "b", 2, 0.7), (2, "c", 2, 0.3), (2, "a", 1, 1.0)], "contig_idx long, name string, depth int, prob double")
    assert sorted(map(tuple, taxonomy.plurality_threshold(probs, tree).collect())) == [(1, 0.0), (2, 0.3)]
    got = {r.contig_idx: (r.ranks, r.probs) for r in taxonomy.predictions(probs, 0.6).collect()}
    assert got == {1: ([], []), 2: (["a", "b"], [1.0, 0.7])}
