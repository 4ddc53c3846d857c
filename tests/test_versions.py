"""The versioned store against plain dictionaries, and what it writes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docloom.plans import ingestion
from docloom.sources import files
from docloom.sources.versions import Change, Conflict, Part, Store, Table, _mergeable
from docloom.streaming import jobs

AT = dt.datetime(2024, 1, 1)
THINGS = Table("things", "id string, owner string, value int", "owner")


def things(spark, rows):
    return spark.createDataFrame(rows, THINGS.schema)


def owners(spark, names):
    return spark.createDataFrame([(n,) for n in names], "owner string")


def live(table):
    return sorted(tuple(r) for r in table.collect())


def test_changes_are_those_of_a_dictionary(spark, tmp_path):
    rng, store, expected = random.Random(1), Store(spark, str(tmp_path / "s"), [THINGS]), {}
    assert live(store.table("things")) == []
    for step in range(7):
        touched = [f"o{k}" for k in rng.sample(range(12), 5)]
        rows = [(f"{o}-{k}", o, step) for o in touched[:4] for k in range(rng.randrange(1, 4))]
        gone = [*touched, None] if step % 3 else touched
        store.commit({"things": Change(things(spark, rows), owners(spark, gone))})
        expected = {k: r for k, r in expected.items() if r[1] not in touched} | {r[0]: r for r in rows}
        if step in (3, 5):
            before = store.snapshot()
            assert store.maintain(most=2)
            assert live(before.table("things")) == sorted(expected.values())
        assert live(store.table("things")) == sorted(expected.values())
    assert store.maintain(whole=True) and len(store.snapshot().manifest.parts["things"]) == 1
    assert live(store.table("things")) == sorted(expected.values())
    assert store.vacuum(1) > 0 and store.vacuum(1) == 0
    assert live(store.table("things")) == sorted(expected.values())


def test_a_change_writes_what_it_holds_and_not_the_table(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path, [THINGS])
    store.commit({"things": Change(things(spark, [(f"i{k}", f"o{k}", k) for k in range(5000)]))})

    def size():
        return {f: f.stat().st_size for f in (tmp_path / "s").rglob("*.parquet")}

    before = size()
    store.commit({"things": Change(things(spark, [("new", "o1", 1)]), owners(spark, ["o1"]))})
    added = {f: n for f, n in size().items() if f not in before}
    assert all(size()[f] == n for f, n in before.items()) and len(added) == 2
    assert sum(added.values()) < 5000 < sum(before.values())
    assert store.table("things").where("owner = 'o1'").count() == 1 and store.table("things").count() == 5000


def test_readers_keep_their_version_and_writers_dont_overtake(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), [THINGS, Table("notes", "id string, owner string", "owner")])
    notes = spark.createDataFrame([("n", "a")], "id string, owner string")
    store.commit({"things": Change(things(spark, [("x", "a", 1)])), "notes": Change(notes)})
    first = store.snapshot()
    store.commit({"things": Change(things(spark, [("y", "a", 2)]), owners(spark, ["a"])), "notes": Change(None, owners(spark, ["a"]))})
    assert live(first.table("things")) == [("x", "a", 1)] and first.table("notes").count() == 1
    assert live(store.table("things")) == [("y", "a", 2)] and store.table("notes").count() == 0
    assert live(store.snapshot(1).table("things")) == [("x", "a", 1)]
    with pytest.raises(Conflict):
        store.commit({"things": Change(things(spark, [("z", "b", 3)]))}, base=first)
    assert live(store.table("things")) == [("y", "a", 2)]


def test_a_batch_is_stored_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), [THINGS])
    for number, value in ((0, 1), (1, 2), (1, 3), (0, 4)):
        store.commit({"things": Change(things(spark, [(f"i{value}", "a", value)]))}, "query", number)
    assert live(store.table("things")) == [("i1", "a", 1), ("i2", "a", 2)]
    store.commit({"things": Change(things(spark, [("i5", "a", 5)]))}, "other", 0)
    assert store.table("things").count() == 3


def test_merges_take_the_newest_and_leave_a_large_base():
    parts = [Part(k, k, "r", None, n) for k, n in enumerate([1_000_000, 10, 20, 10, 10])]
    assert _mergeable(parts, 8) == []
    assert _mergeable(parts, 3) == parts[1:]
    assert _mergeable([Part(0, 0, "r", None, 10), *parts[1:]], 3)[0].first == 0


def rows_of(spark, documents):
    return spark.createDataFrame(
        [(f"{key}___{k}", key, owner, k, text, [float(len(text))], f"link {key}") for key, owner, texts in documents for k, text in enumerate(texts)],
        "row_key string, doc_key string, owner string, position int, content string, embedding array<float>, link string",
    )


def test_a_renamed_file_takes_its_old_chunks_along_whatever_its_title(spark, tmp_path):
    store = ingestion.open_store(spark, str(tmp_path / "s"))
    first = [("a___b___f1", "file:f1", ["one", "two"]), ("raw___1", "text:raw___1", ["x"]), ("raw___10", "text:raw___10", ["y", "z"])]
    assert ingestion.store_rows(rows_of(spark, first), store, F.lit(AT)) == 1
    second = [("new___title___f1", "file:f1", ["one"]), ("raw___10", "text:raw___10", ["yy"])]
    ingestion.store_rows(rows_of(spark, second), store, F.lit(AT + dt.timedelta(hours=1)))
    for _ in range(2):
        assert live(store.table("vectors").select("id")) == [("new___title___f1___0",), ("raw___10___0",), ("raw___1___0",)]
        cells = ingestion.stored_cells(store.snapshot()).where("qualifier = 'content'")
        assert live(cells.select("row_key", "value")) == [
            ("new___title___f1___0", "one"), ("raw___10___0", "y"), ("raw___10___0", "yy"), ("raw___1___0", "x"),
        ]
        assert ingestion.maintain_store(store, whole=True)


def test_old_versions_of_cells_go_with_merges(spark, tmp_path):
    store = ingestion.open_store(spark, str(tmp_path / "s"))
    for hour in range(8):
        ingestion.store_rows(rows_of(spark, [("k", "text:k", [f"v{hour}"])]), store, F.lit(AT + dt.timedelta(hours=hour)))
    contents = "qualifier = 'content'"
    assert store.table("cells").where(contents).count() == 8
    assert ingestion.maintain_store(store, most=3)
    assert store.table("cells").where(contents).count() < 8
    for _ in range(2):
        kept = ingestion.stored_cells(store.snapshot()).where(contents)
        assert live(kept.select("value")) == [(f"v{hour}",) for hour in range(3, 8)]
        ingestion.maintain_store(store, whole=True)


def test_a_folder_of_a_batch_is_written_once(spark, tmp_path):
    folder, rows = str(tmp_path / "out"), spark.range(5)
    assert files.write_once(rows, folder, "b1") and not files.write_once(rows, folder, "b1")
    assert files.write_once(rows.where("id < 2"), folder, "b2")
    read = spark.read.schema("id long").option("recursiveFileLookup", "true").json(folder)
    assert read.count() == 7 and files.names(spark, f"{folder}/_staged") == []
    assert not files.move(spark, f"{folder}/b2", f"{folder}/b1") and files.names(spark, str(tmp_path / "none")) == []
    assert jobs.Batch("q", 3).name == "q-000000000003"
