import pytest

from folioquery.operators import schema as sc
from folioquery.operators.catalog import TABLES, VIEWS, catalog
from folioquery.operators.views import join_order, needed_steps


def test_catalog_round_trip_keeps_views():
    c = catalog()
    assert (len(c.tables), len(c.views)) == (len(TABLES), len(VIEWS)) == (13, 10)
    again = sc.Catalog.from_dict(c.to_dict())
    assert again.hash() == c.hash() and set(again.views) == set(c.views)


def test_enumerations_and_types():
    c = catalog()
    assert "DEF 14A/A" in c["filings"]["form"].choices and len(c["filings"]["form"].choices) == 12
    assert len(c["filing_section_chunks"]["section"].choices) == 14
    assert len(c["filing_attachments"]["type"].choices) == 14
    assert c["companies"].struct["symbols"].dataType.simpleString() == "array<string>"
    assert not c["companies"].struct["id"].nullable


def test_rules():
    with pytest.raises(sc.SchemaError):
        sc.define("t", "select text")
    with pytest.raises(sc.SchemaError):
        sc.define("t", "a text\na text")
    with pytest.raises(sc.SchemaError):
        sc.define("t", "a integer fts")
    with pytest.raises(sc.SchemaError):
        sc.define("t", "a text contextualized")
    bad = sc.Catalog().add_table(sc.define("p", "id serial")).add_table(sc.define("c", "id serial\np_id text fk:p.id"))
    with pytest.raises(sc.SchemaError):
        bad.validate()
    with pytest.raises(sc.SchemaError):
        catalog().add_table(sc.define("vector_outbox", "id serial"))


def test_join_goes_through_the_table_joined_last():
    c = catalog()
    steps = join_order(c, ("filing_pages", "filings", "companies"))
    assert steps == [("filings", "id", "filing_pages", "filing_id"), ("companies", "id", "filings", "company_id")]
    assert needed_steps(c, steps, {"filing_pages"}) == []
    assert len(needed_steps(c, steps, {"companies"})) == 2
    lone = sc.Catalog().add_table(sc.define("a", "id serial")).add_table(sc.define("b", "id serial"))
    with pytest.raises(sc.SchemaError):
        join_order(lone, ("a", "b"))


def test_fields_can_change():
    t = catalog()["companies"]
    assert "x" in t.add_field(sc.FieldSpec("x", "text")) and "sic" not in t.remove_field("sic")


def test_constraints(spark):
    spec = sc.define("t", "id serial\nkind enum ! of:a|b\nname text unique\nparent integer fk:p.id")
    df = lambda rows: spark.createDataFrame(rows, "id long, kind string, name string, parent long")
    sc.check_constraints(df([(1, "a", "x", None), (2, "b", None, None), (3, "b", None, None)]), spec)
    for rows, error in (([(1, None, "x", None)], sc.NotNullError), ([(1, "c", "x", None)], sc.CheckError), ([(1, "a", "x", None), (2, "a", "x", None)], sc.UniqueError)):
        with pytest.raises(error):
            sc.check_constraints(df(rows), spec)
    with pytest.raises(sc.ForeignKeyError):
        sc.check_constraints(df([(1, "a", "x", 9)]), spec, {"p": spark.createDataFrame([(1,)], "id long")})
    good, bad = sc.split_valid(df([(1, "a", "x", None), (2, "z", "y", None)]), spec)
    assert [r.id for r in good.collect()] == [1] and [(r.id, r._reason) for r in bad.collect()] == [(2, "check: kind")]
    with pytest.raises(sc.SchemaError):
        sc.split_valid(spark.createDataFrame([(1,)], "nope int"), spec)
