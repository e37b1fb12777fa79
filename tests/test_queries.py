"""Every query of the catalogue against its SQL, on the smallest test data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import connect, same  # noqa: E402

from tidemark.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, data, con, name):
    same(catalogue.QUERIES[name](spark, data), con, catalogue.ORACLE[name])


#: Queries without SQL whose result may be empty on the smallest test data, with their tests of contents in test_operators.
MAY_BE_EMPTY = {"near_dup_resolved"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_without_sql(spark, data, name):
    """Rows under unique keys, each column filled somewhere."""
    table = catalogue.QUERIES[name](spark, data).toArrow()
    assert table.num_rows or name in MAY_BE_EMPTY
    key = [c for c in ("id", "article_id", "doc_id", "incoming_id", "k") if c in table.column_names][:1]
    if key and name not in ("entity_maps",):
        ids = table.column(key[0]).to_pylist()
        assert None not in ids and len(set(ids)) == len(ids)
    assert not table.num_rows or all(table.column(c).null_count < table.num_rows for c in table.column_names if (name, c) != ("stable_keys", "stable_key"))


def test_extraction_keeps_the_documents_lines(spark, data):
    """Of ordinary documents the extracted text is their own lines."""
    from tidemark.plans import texts
    from tidemark.plans.base import Tables
    from tidemark.sources.pages import extract

    t = Tables(spark, data)
    got = {int(r.url.rsplit("/", 1)[1]): r for r in extract(texts.pages(t)).collect()}
    docs = {r.doc_id: r for r in t.documents.where("doc_type in ('brief', 'report', 'match report', 'feature')").collect()}
    plain = lambda s: " ".join((s or "").split())
    same = sum(plain(got[i].body) == plain(r.text) for i, r in docs.items() if plain(r.text))
    assert same / max(1, sum(bool(plain(r.text)) for r in docs.values())) > 0.95
    assert all(plain(got[i].title) == plain(r.title) for i, r in docs.items() if plain(r.text) and plain(r.title) and '"' not in r.title)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_arguments_are_checked(spark, data):
    from tidemark.plans import serving, trends
    from tidemark.plans.base import Tables

    t = Tables(spark, data)
    for bad in (lambda: serving.check_page("newest", 0, 20), lambda: serving.check_page("newest", 1, 3), lambda: serving.check_page("x", 1, 20, "q" * 101), lambda: serving.check_days(0),
                lambda: serving.articles(t, topic="x"), lambda: trends.check_range("2026-01-02", "2026-01-01"), lambda: trends.check_range("2024-01-01", "2026-01-01")):
        with pytest.raises(ValueError):
            bad()
    assert trends.check_range("2026-01-01", "2026-01-14") == 14
    assert trends.default_range(t, "2026-01-14") == ("2026-01-01", "2026-01-14") and trends.default_range(t)[1] >= "2026-01-01"
    assert serving.page_of(serving.articles(t), "unknown order", 1, 5).count() == 5
