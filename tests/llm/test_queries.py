import os

import pytest

from oracle import SMALL, compare, connection
from sparkmill.llm import queries

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="the small tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, connection(), queries.queries()[name], queries.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == [*range(1, 14)]


def test_linked_vectors_equal_their_sql(spark, tmp_path):
    """The driver's vectors hardly link; here each has copies that do, by chains too."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows, x = [], rng.normal(size=(30, 8))
    for i in range(300):
        base = x[i % 30] + (i // 30) * 0.12 * x[(i + 1) % 30] if i % 3 else x[i % 30]
        rows.append((i, [float(v) for v in np.float32(base + 0.02 * rng.normal(size=8))], i % 5))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("*.parquet")
    file.rename(tmp_path / "embeddings.parquet")
    assert queries.op3_embeddings(spark, str(tmp_path)).where("n_links > 0 and not kept").count() > 50
    compare(spark, connection(str(tmp_path)), queries.op3_embeddings, queries.OP3_SQL, str(tmp_path))


def test_very_long_texts(spark):
    """Half a million words in one text, beside an empty one."""
    from sparkmill.llm import quality_rules, simhash

    text = " ".join("w%d" % (i * i % 99_991) for i in range(500_000))
    docs = spark.createDataFrame([(1, text, "a"), (2, None, None), (3, text + " more", "a")], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in simhash.simhash_classes(docs).collect()}
    assert found[1].component == found[3].component == 1 and found[2].component == 2 and found[2].fp == 0
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert rules[1].n_words == 500_000 and rules[3].n_words == 500_001 and rules[2].n_words == 0


def test_rules_of_equal_length(spark):
    """Of rules of one length that fit, the first by text is taken, in whatever order they are given."""
    from sparkmill.llm.url_filter import url_filter

    pages = spark.createDataFrame([(1, "http://a.b.c/x"), (2, "http://b.c/x" * 20_000)], "page_id long, url string")
    listed = spark.createDataFrame([("none",)], "key string")
    rules = [("block", "b.c", "/"), ("allow", "c", "/x/"), ("allow", "c", "/x"), ("block", "a.b.c", "")]
    for given in (rules, rules[::-1]):
        out = {r.page_id: r for r in url_filter(pages, listed, given).collect()}
        assert (out[1].rule, out[1].verdict) == ("a.b.c", "block")
        assert (out[2].rule, out[2].verdict) == ("b.c/", "block") and len(out[2].path) > 100_000


def test_cosine_at_the_threshold(spark):
    """Vectors whose cosine is the threshold itself in double precision are linked."""
    from sparkmill.llm.embeddings import near_embeddings

    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: r.links for r in near_embeddings(docs, least=0.6).collect()}
    assert out == {1: 1, 2: 2, 3: 1}
