"""File events from a folder to a debounced stream; a restart loses none."""

from __future__ import annotations

import os
import time

from weftgraph.plans.shipping import ship
from weftgraph.streaming import debounce, watch


def test_a_folder_reaches_a_stream(spark, tmp_path):
    root, state, out = tmp_path / "src", tmp_path / "state", []
    (root / "node_modules").mkdir(parents=True)
    (root / "p").mkdir()
    (root / "a.py").write_text("1")
    (root / "p" / "b.py").write_text("1")
    (root / "p" / "c.txt").write_text("no source")
    (root / "node_modules" / "x.py").write_text("never listed")
    ship(spark)
    spark.dataSource.register(watch.FileEvents)

    def run() -> list[tuple[str, str]]:
        out.clear()
        events = spark.readStream.format("file_events").option("root", f"file://{root}").option("state", f"file://{state}").option("extensions", ".py").option("initial", "true").load()
        q = events.writeStream.foreachBatch(lambda df, _: out.extend((os.path.basename(r.path), r.event) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
        deadline = time.time() + 40
        while time.time() < deadline and q.isActive and not out:
            time.sleep(0.5)
        time.sleep(2)
        q.stop()
        return sorted(out)

    assert run() == [("a.py", "create"), ("b.py", "create")]
    (root / "a.py").write_text("12")  # while nothing watches
    (root / "p" / "b.py").unlink()
    (root / "d.py").write_text("new")
    (root / "node_modules" / "y.py").write_text("never listed")
    assert run() == [("a.py", "modify"), ("b.py", "delete"), ("d.py", "create")]
    assert len(list(state.iterdir())) <= 2  # what is committed goes


def test_snapshots_and_their_differences(tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    for k in range(100):
        (root / f"f{k}.py").write_text("x")
    reader = watch._Reader({"root": str(root), "state": str(tmp_path / "state")})
    start = reader.initialOffset()
    assert reader.latestOffset() == start and reader.partitions(start, start) == []
    (root / "f3.py").write_text("xy")
    (root / "f5.py").unlink()
    end = reader.latestOffset()
    assert end != start
    for _ in range(2):  # a batch that is run again
        rows = sorted((os.path.basename(p), e) for part in reader.partitions(start, end) for p, e, _ in reader.read(part))
        assert rows == [("f3.py", "modify"), ("f5.py", "delete")]
    reader.commit(end)
    assert reader._snapshots() == [end["snapshot"]]
    (tmp_path / "state" / "000000099").mkdir()  # broken off before its mark
    assert reader._snapshots() == [end["snapshot"]]


def test_timers_hand_on_late_events_and_the_last_burst(spark, tmp_path):
    """Of a burst the latest event; one that is years behind the others still comes through."""
    out = []
    schema = "path string, event string, ts timestamp"
    put = lambda n, values: spark.sql(f"SELECT * FROM VALUES {values} AS t(path, event, ts)").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    put(0, "('/a', 'create', timestamp'2024-01-01 00:00:00'), ('/a', 'delete', timestamp'2024-01-01 00:00:02'), ('/a', 'modify', timestamp'2024-01-01 00:00:01'), ('/b', 'modify', timestamp'2024-01-01 00:00:00'), (NULL, 'modify', timestamp'2024-01-01')")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = debounce.run(stream, lambda df, _: out.extend((r.path, r.event, r.events) for r in df.collect()), str(tmp_path / "ck"), timer_ms=300)

    def wait(n: int) -> list:
        deadline = time.time() + 60
        while time.time() < deadline and q.isActive and len(out) < n:
            time.sleep(0.3)
        return sorted(out)

    assert wait(2) == [("/a", "delete", 3), ("/b", "modify", 1)]
    put(1, "('/b', 'modify', timestamp'2019-01-01 00:00:00')")
    assert wait(3) == [("/a", "delete", 3), ("/b", "modify", 1), ("/b", "modify", 1)]
    q.stop()


def test_a_folder_reaches_a_stored_graph(spark, tmp_path):
    """Files come, change and go; the stored graph follows through events, timers and delta rules."""
    from weftgraph.operators import build
    from weftgraph.sources import python_source
    from weftgraph.sources.store import GraphStore
    from weftgraph.streaming.reindex import Upkeep

    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    return two()\n\ndef two(): pass\n")
    (root / "b.py").write_text("def three(): pass\n")

    def parsed(paths):
        rows = [(r.path, open(r.path).read()) for r in paths.collect()]
        return build.python_graph(python_source.staging(spark.createDataFrame(rows, "path string, text string"), str(root)), str(root))

    ship(spark)
    spark.dataSource.register(watch.FileEvents)
    keeper = Upkeep(GraphStore(spark, f"file://{tmp_path}/facts"), GraphStore(spark, f"file://{tmp_path}/derived"))
    keeper.start(parsed(spark.createDataFrame([(str(p),) for p in sorted(root.iterdir())], "path string")))
    names = lambda: {r.full_name for r in keeper.read().label("Method").collect()}
    assert names() == {"a.one", "a.two", "b.three"}
    apply, batches = keeper.apply(parsed), []

    def counted(changes, batch):
        if not changes.isEmpty():
            batches.append(batch)
            apply(changes, batch)

    events = spark.readStream.format("file_events").option("root", str(root)).option("state", str(tmp_path / "state")).option("extensions", ".py").load()
    q = debounce.run(events, counted, str(tmp_path / "ck"), timer_ms=500)
    deadline = time.time() + 60
    while time.time() < deadline and not list((tmp_path / "state").glob("*/done")):  # the first listing
        time.sleep(0.2)
    (root / "a.py").write_text("def one():\n    return 1\n")
    (root / "b.py").unlink()
    (root / "c.py").write_text("def four(): pass\n")
    deadline = time.time() + 240
    while time.time() < deadline and q.isActive and names() != {"a.one", "c.four"}:
        time.sleep(2)
    q.stop()
    assert q.exception() is None and batches and names() == {"a.one", "c.four"}
