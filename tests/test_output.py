import datetime

import pytest

from tidemark.sources import output
from tidemark.sources.output import Number


@pytest.mark.parametrize(
    ("text", "page", "size", "count", "made"),
    [
        ("SELECT * FROM herons", 2, 25, False, 'SELECT * FROM "herons" LIMIT 25 OFFSET 25;'),
        ('  select * FROM "sea ""gulls""" ;', 4, 10, False, 'SELECT * FROM "sea ""gulls""" LIMIT 10 OFFSET 30;'),
        ("Select * From herons;", 1, 0, False, f'SELECT * FROM "herons" LIMIT {output.PAGE_SIZE} OFFSET 0;'),
        ("SELECT * FROM herons", -7, output.MOST_PAGE + 1, False, f'SELECT * FROM "herons" LIMIT {output.MOST_PAGE} OFFSET 0;'),
        ("SELECT * FROM herons", 9, 25, True, 'SELECT COUNT(*) FROM "herons";'),
        ("SELECT * FROM herons", output.MOST_OFFSET, 2, False, None),
    ],
)
def test_pages(text, page, size, count, made):
    assert output.paged_sql(text, page, size, count) == made


NOT_PAGED = {
    "a condition": "SELECT * FROM herons WHERE wings = 2",
    "an order": "SELECT * FROM herons ORDER BY ring",
    "a bound": "SELECT * FROM herons LIMIT 3 OFFSET 1",
    "columns": "SELECT ring, species FROM herons",
    "a star of a table": "SELECT herons.* FROM herons",
    "a join": "SELECT * FROM herons JOIN nests USING (ring)",
    "an alias": "SELECT * FROM herons h",
    "a comment": "SELECT * FROM herons /* all */",
    "two statements": "SELECT * FROM herons; DELETE FROM herons",
    "another quote": "SELECT * FROM [herons]",
    "an open quote": 'SELECT * FROM "herons',
    "a common table": "WITH h AS (SELECT 1) SELECT * FROM h",
    "no statement": " ",
    "nothing": None,
}


@pytest.mark.parametrize("why", NOT_PAGED)
def test_other_shapes_are_not_paged(why):
    assert output.paged_sql(NOT_PAGED[why], 1, 50) is None


def test_edits():
    columns, key = ["ring", "species", "grams"], ["ring"]
    assert output.edit_sql("update", "herons", columns, [71, "grey", 1500], [71, "Night's", 640.5], key) == """UPDATE "herons" SET "ring"=71,"species"='Night''s',"grams"=640.5 WHERE "ring"=71;"""
    assert output.edit_sql("update", "herons", columns, [None, "grey", 1], [72, None, Number("+2.50E3")], key) == 'UPDATE "herons" SET "ring"=72,"species"=NULL,"grams"=+2.50E3 WHERE "ring" IS NULL;'
    assert output.edit_sql("delete", "herons", columns, [73, "x", None], None, ["ring", "grams"]) == 'DELETE FROM "herons" WHERE "ring"=73 AND "grams" IS NULL;'
    assert output.edit_sql("insert", "herons", columns, None, [None, "purple", -4], key) == """INSERT INTO "herons" ("ring","species","grams") VALUES (NULL,'purple',-4);"""


@pytest.fixture
def db(spark):
    from tidemark.session import Engine

    made = Engine(spark).open(":memory:")
    made.execute("CREATE TABLE herons (ring INTEGER PRIMARY KEY, species TEXT, grams REAL); INSERT INTO herons VALUES (70 + 1, 'grey', 1500), (72, 'tab' || char(9) || 'quote' || char(34), NULL), (73, upper('\\') || char(233), -0.5)")
    return made


def test_json_lines(db):
    lines, code = output.run_json(db, "DELETE FROM herons WHERE ring = 0; SELECT ring, species, grams FROM herons ORDER BY ring; SELECT wings FROM herons; SELECT 1")
    assert lines[0] == output.EMPTY
    assert lines[1] == r'{"ok":true,"rows":3,"columns":["ring","species","grams"],"data":[[71,"grey",1500.0],[72,"tab\u0009quote\"",null],[73,"\\é",-0.5]]}'
    assert code == 1 and len(lines) == 3 and lines[2].startswith('{"ok":false,"error":')
    assert output.run_json(db, "  ")[1] == 2 and output.run_json(db, "SELECT 2")[1] == 0


def test_bounds_of_json_lines(db, monkeypatch):
    monkeypatch.setattr(output, "MOST_ROWS", 2)
    lines, code = output.run_json(db, "SELECT ring FROM herons")
    assert code == 1 and "2 rows" in lines[0]


def test_text_and_tabs(db):
    asked = db.query("SELECT ring, nullif(ring, 71) AS other, grams FROM herons WHERE ring = 71")
    assert list(output.text_rows(asked)) == ["71 | NULL | 1500.0"]
    assert list(output.tab_rows(asked)) == ["71\tNULL\t1500.0", "# end 1"]
    assert list(output.tab_rows(db.query("SELECT ring FROM herons WHERE ring < 0"))) == ["# end 0"]


def test_csv_is_written_by_tasks(spark, db, tmp_path):
    output.write_csv(db.query("SELECT ring, species FROM herons WHERE ring <> 72"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in back.collect()) == [("71", "grey"), ("73", "\\é")]


def test_schema_tree_and_dump(spark, db):
    from tidemark.session import Engine

    db.execute("CREATE INDEX by_species ON herons(species); CREATE VIEW heavy AS SELECT ring FROM herons WHERE grams > 1000")
    assert output.schema_json(db) == (
        '{"ok":true,"tables":[{"name":"heavy","type":"view","columns":[{"name":"ring","type":"INTEGER","pk":0,"notnull":0}],"indexes":[]},'
        '{"name":"herons","type":"table","columns":[{"name":"ring","type":"INTEGER","pk":1,"notnull":0},{"name":"species","type":"TEXT","pk":0,"notnull":0},{"name":"grams","type":"REAL","pk":0,"notnull":0}],'
        '"indexes":[{"name":"by_species","unique":0,"columns":["species"]}]}]}'
    )
    assert output.meta(db, ".tables") == ["heavy", "herons"]
    again = Engine(spark).open(":memory:")
    again.execute("\n".join(output.dump(db)))
    assert again.tables() == db.tables()
    whole = "SELECT * FROM herons ORDER BY ring"
    assert again.query(whole).collect() == db.query(whole).collect()


def test_snippets(spark):
    from tidemark.operators import fts

    df = spark.createDataFrame([("The grey heron stands still",), ("none here",), (None,)], "t string")
    assert [r[0] for r in df.select(fts.snippet(df["t"], "HERON", 5)).collect()] == ["grey [heron] stan", None, None]


def test_streams(spark, db, tmp_path):
    """Commits as they arrive, and windows that are final once the watermark has passed them."""
    from tidemark.streaming import streams

    def settled(frame, mode, name):
        query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    commits = settled(streams.commit_stream(spark, db.store.root), "append", "commits_seen")
    assert sorted(r["generation"] for r in commits) == list(range(1, db.generation + 1))
    at = lambda minute: datetime.datetime(2024, 5, 1, 10, minute)
    events = [("a", at(1)), ("a", at(4)), ("b", at(4)), ("a", at(20)), ("b", at(59))]
    spark.createDataFrame(events, "who string, ts timestamp").write.parquet(str(tmp_path / "events"))
    arriving = spark.readStream.schema("who string, ts timestamp").parquet(str(tmp_path / "events"))
    counts = settled(streams.tumbling_counts(arriving, "ts", ["who"], "10 minutes", "5 minutes"), "append", "windows_seen")
    assert sorted((r["who"], r["start"].minute, r["n"]) for r in counts) == [("a", 0, 2), ("a", 20, 1), ("b", 0, 1)]
    found = settled(streams.sessions(arriving, "ts", ["who"], "5 minutes", "5 minutes"), "append", "sessions_seen")
    assert sorted((r["who"], r["start"].minute, r["n"]) for r in found) == [("a", 1, 2), ("a", 20, 1), ("b", 4, 1)]
