"""A stream with state beside the batch computation of the same events."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loomary.sources.log import Store
from loomary.streaming import state

EVENTS = "path string, seq long, at timestamp, removed boolean, payload string"


def _encode(df):
    return df.select("path", F.explode(F.split("payload", " ")).alias("field")).withColumn("n", F.length("field"))


def _write(spark, folder, rows):
    spark.createDataFrame([(p, s, datetime.fromtimestamp(t, UTC), r, c) for p, s, t, r, c in rows], EVENTS).coalesce(1).write.mode("append").json(folder)


def _run(spark, tmp_path, store, keep=0):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    state.follow(stream, _encode, store, str(tmp_path / "cp"), keep).awaitTermination()
    return sorted((r["path"], r["seq"], r["field"], r["n"]) for r in state.current(store).collect())


@pytest.fixture
def store(spark, tmp_path):
    schema = state.table_of(_encode(spark.createDataFrame([], "path string, payload string")).schema)
    return Store(spark, str(tmp_path / "table"), schema)


def test_any_order_ends_as_the_batch_does(spark, tmp_path, store):
    """Late, repeated, deleted and renewed paths over several batches and two runs of the stream."""
    r = random.Random(6)
    events = [(f"p{r.randrange(9)}", s, 1000 + s, r.random() < 0.3, " ".join(r.choice("abc") * r.randint(1, 3) for _ in range(r.randint(1, 3)))) for s in range(60)]
    events += [(None, 99, 5, False, "x"), ("void", 1, 5, True, None)]
    late = events + r.sample(events, 15)
    r.shuffle(late)
    for k in range(4):
        _write(spark, str(tmp_path / "in"), late[k * 15 : (k + 1) * 15])
    _run(spark, tmp_path, store)
    _write(spark, str(tmp_path / "in"), late[60:])
    got = _run(spark, tmp_path, store)
    last = {p: max(e for e in events if e[0] == p) for p in {e[0] for e in events if e[0]}}
    assert got == sorted((p, e[1], w, len(w)) for p, e in last.items() if not e[3] for w in e[4].split(" ")) and got
    version = store.version()
    assert _run(spark, tmp_path, store) == got and store.version() == version
    twice = max(r["commit"] for r in store.rows().collect())
    store.append(store.rows().filter(F.col("commit") == twice).select(*store.schema.names))  # a batch that ran twice
    assert sorted((r["path"], r["seq"], r["field"], r["n"]) for r in state.current(store).collect()) == got


def test_timer_removes_stale_paths(spark, tmp_path, store):
    _write(spark, str(tmp_path / "in"), [("old", 1, 1000, False, "a"), ("kept", 1, 1000, False, "b")])
    assert [x[0] for x in _run(spark, tmp_path, store, 100)] == ["kept", "old"]
    _write(spark, str(tmp_path / "in"), [("kept", 2, 1090, False, "b")])
    _run(spark, tmp_path, store, 100)
    _write(spark, str(tmp_path / "in"), [("new", 3, 1150, False, "c")])
    assert [x[0] for x in _run(spark, tmp_path, store, 100)] == ["kept", "new"]
    _write(spark, str(tmp_path / "in"), [("old", 4, 1160, False, "a again"), ("late", 1, 10, False, "x")])
    assert [x[0] for x in _run(spark, tmp_path, store, 100)] == ["kept", "new", "old", "old"]
