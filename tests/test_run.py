"""CSV files by header, the quarantine, set-up by settings, and runs that are taken up."""

import json

import pytest

from millwright.operators import pipeline, setup
from millwright.plans.run_queries import Pairs
from millwright.sources import settings, sinks, tables

GAZETTEER = {"State": [["blow", "State/UndesirableState/FailedState"]]}
HEADER = "number,what,where,kind,when,price,hours,extra.col"
LINES = [
    '1,"Temp sensor, blown",A-1,U,03/02/2020,"$1,200.50",2,x',
    '2,"say ""sensor""\nblown",b-2,P,04/02/2020,-5,abc,x',
    "3,replace filter,A-2,U,2020-02-04,7,1,x",
    "4,replace filter,A-2,U,05/02/2020,1.2.3,1,x",
    "five,replace filter,A-2,U,05/02/2020,1,1,x",
    "6,replace filter,A-2,U,05/02/2020",
    "7,N/A,A-2,U,05/02/2020,1,1,x",
    "8,inspect pump,NULL,U,05/02/2020,1,1,x",
    "9,replace pump,A-9,P,,,,x",
]


def environment(folder, **more):
    return {"FOLDERS__ROOT": str(folder), "INPUT__CSV_FILENAME": "orders.csv", "INPUT__ID_COL": "number", "INPUT__TEXT_COL": "what", "INPUT__FLOC_COL": "where", "INPUT__TYPE_COL": "kind", "INPUT__START_DATE_COL": "when", "INPUT__COST_COL": "price", "INPUT__TIME_COL": "hours", "INPUT__UNPLANNED_CODES": "U", **more}


def written(folder, lines=LINES, header=HEADER):
    (folder / "input").mkdir(exist_ok=True)
    (folder / "input/orders.csv").write_text("\n".join([header, *lines]) + "\n")
    return settings.load(None, environment(folder))


def test_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,id,extra\nhello,1,x\n")
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), ["id", "text"]).select("id", "text").first().asDict() == {"id": "1", "text": "hello"}
    with pytest.raises(ValueError, match="no column 'name'"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), ["id", "name"])
    (tmp_path / "b.csv").write_text("id,text,extra\n2,bye,x\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv(spark, str(tmp_path), ["id", "text"]).collect()


def test_what_cannot_be_read_is_set_apart_with_its_reasons(spark, tmp_path):
    loaded = setup.load(spark, written(tmp_path))
    rows = {r.id: r for r in loaded.orders.collect()}
    assert set(rows) == {1, 2, 7, 8, 9} and str(rows[1].start_date) == "2020-02-03" and rows[1].cost == 1200.5 and rows[2].cost == 5.0 and rows[2].time == 0.0
    assert rows[2].text == 'say "sensor"\nblown' and rows[9].cost is None and rows[9].start_date is None and rows[7].text is None
    rejected = {json.loads(r.row).get("id"): list(r.reasons) for r in loaded.rejected.collect()}
    assert rejected == {"3": ["start_date"], "4": ["cost"], "five": ["id"], "6": ["line"]}


def test_selection_by_settings(spark, tmp_path):
    s = written(tmp_path)
    orders = setup.load(spark, s).orders
    ids = lambda **p: {r.id for r in setup.select(orders, settings.load(None, environment(tmp_path, **{f"PROCESSING__{k.upper()}": v for k, v in p.items()}))).collect()}
    assert ids() == {1, 2, 9} and ids(systems="^a-") == {1, 9} and ids(unplanned_only="true") == {1} and len(ids(limit="2")) == 2
    with pytest.raises(ValueError, match="no rows"):
        ids(systems="zzz")
    made = setup.select(orders.drop("time"), settings.load(None, environment(tmp_path, PROCESSING__ADD_DUMMY_COLS="true"))).collect()
    assert all(r.time is not None for r in made) and {r.id: r.cost for r in made}[1] == 1200.5
    assert {r.id: r.input for r in made}[1] == "temperature sensor , blown"


def test_a_run_is_taken_up_where_something_changed(spark, tmp_path):
    s = written(tmp_path)
    run = lambda s, model="pairs", gazetteer=GAZETTEER: pipeline.run(spark, s, Pairs(), model, gazetteer)
    g, tables_, made = run(s)
    assert made == ["setup", "extraction", "refinement", "scoring", "graph"]
    edges = {(r.record_id, r.head_type, r.head, r.tail) for r in g.record_edges.collect()}
    assert edges == {(1, "State/UndesirableState/FailedState", "blow", "sensor"), (2, "State/UndesirableState/FailedState", "blow", "sensor"), (9, "Activity", "replace", "pump")}
    assert tables_["rejected"].count() == 4
    assert run(s)[2] == []
    other = settings.load(None, environment(tmp_path, PROCESSING__REMOVE_RARE_OUTLIERS="false"))
    assert run(other)[2] == ["scoring", "graph"] and run(s)[2] == [] and run(other)[2] == []
    assert run(s, gazetteer={})[2] == ["refinement", "scoring", "graph"]
    assert run(s, model="other")[2] == ["extraction", "refinement", "scoring", "graph"]
    written(tmp_path, [*LINES, "10,replace filter,A-1,U,05/02/2020,1,1,x"])
    g, used, made = run(s)
    assert made == ["setup", "extraction", "refinement", "scoring", "graph"] and g.records.count() == 4
    gone = pipeline.forget(spark, f"{tmp_path}/output/stages", pipeline.stages(Pairs(), "pairs", GAZETTEER), used)
    assert gone == 1 + 2 + 3 + 4 + 4 and run(s)[2] == []


def test_a_run_that_failed_goes_on_with_its_stage(spark, tmp_path, monkeypatch):
    s = written(tmp_path)
    scored = pipeline.score.scored
    monkeypatch.setattr(pipeline.score, "scored", lambda t: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        pipeline.run(spark, s, Pairs(), "pairs", GAZETTEER)
    assert not [f for f in sinks.written_folders(spark, f"{tmp_path}/output/stages/scoring")]
    monkeypatch.setattr(pipeline.score, "scored", scored)
    assert pipeline.run(spark, s, Pairs(), "pairs", GAZETTEER)[2] == ["scoring", "graph"]
