"""Histories in the state of a stream, and files that arrive as a stream."""

import os
import random
from datetime import datetime, timedelta

import pytest

from spindrift import engine
from spindrift.operators import index_store
from spindrift.streaming import histories

COLUMNS = "conv_id long, turn long, text string, ts timestamp"


def arrives(spark, path, rows):
    """One more file of the stream."""
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(str(path))


def test_histories_over_many_batches(spark, tmp_path):
    rnd = random.Random(1)
    at = datetime(2024, 1, 1)
    rows = [(c, t, None if t == 3 else f"{c}-{t}", at + timedelta(minutes=t)) for c in range(12) for t in range(rnd.choice([1, 3, 6, 7, 20]))]
    rows += [(99, t % 4, f"same {t}", at) for t in range(10)]  # turns that repeat
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1], r[2]) for r in rows if r[0] == c), key=lambda t: (t[0], t[1] is not None, t[1] or ""))
        want[c] = mine[-6:]
    rnd.shuffle(rows)
    for i in range(0, len(rows), 30):
        arrives(spark, tmp_path / "in", rows[i : i + 30])
    arrives(spark, tmp_path / "in", [(None, 1, "nobody", at), (1, None, "never", at)])
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = histories.replayed(stream)
    got = {}
    for r in histories.latest(found).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.text))
    assert {c: sorted(t, key=str) for c, t in got.items()} == {c: sorted(t, key=str) for c, t in want.items()}
    assert found.count() > len(want)  # several batches


def test_idle_conversations_are_forgotten(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [[(1, 0, "a", at(0)), (2, 0, "b", at(0))], [(2, 1, "c", at(25))], [(2, 2, "d", at(45))], [(1, 1, "again", at(50)), (2, 3, "e", at(60))]]
    for b in batches:
        arrives(spark, tmp_path / "in", b)
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = histories.replayed(stream, idle=timedelta(minutes=30))
    now = sorted((r.conv_id, r.text) for r in histories.latest(rows).collect())
    assert now == [(1, "again"), (2, "b"), (2, "c"), (2, "d"), (2, "e")]
    rows = rows.collect()
    closed = [r for r in rows if r.closed]
    assert [(r.conv_id, [t.text for t in r.turns]) for r in closed] == [(1, ["a"])]
    last = max((r for r in rows if r.conv_id == 2), key=lambda r: r.seen)
    assert [t.text for t in last.turns] == ["b", "c", "d", "e"]
    assert any(r.conv_id == 1 and r.seen == 1 and [t.text for t in r.turns] == ["again"] for r in rows)


def test_no_turns(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "in"))
    assert histories.latest(histories.replayed(spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in")))).count() == 0


def test_files_as_a_stream_survive_a_crash(spark, tmp_path, monkeypatch):
    """A run dies after a commit, before its checkpoint; the next goes on, each file is there once, and all is as after a build."""
    docs, root = tmp_path / "docs", str(tmp_path / "index")
    docs.mkdir()
    for i in range(4):
        (docs / f"paper{i}.txt").write_text(f"Rule {i} asks for permit {i} of sheds.\n" * 30)
    (docs / "picture.png").write_bytes(b"no text")
    commit, commits = index_store.IndexStore.commit, []

    def dies(self, corpus, tables):
        commit(self, corpus, tables)
        commits.append(corpus)
        if len(commits) == 2:
            raise RuntimeError("lost driver")

    monkeypatch.setattr(index_store.IndexStore, "commit", dies)
    follow = lambda: engine.follow(spark, str(docs), "papers", root, str(tmp_path / "checkpoint"), per_batch=2)
    with pytest.raises(Exception, match="lost driver"):
        follow()
    follow()
    assert len(commits) >= 3

    def content(where):
        rows = index_store.IndexStore(spark, where).read("chunks", "papers").select("path", "section_id", "piece_no", "text", "content_hash")
        return sorted(tuple(r) for r in rows.collect())

    files = index_store.IndexStore(spark, root).read("files", "papers").collect()
    assert sorted((r.path, r.status) for r in files) == [(f"paper{i}.txt", "ok") for i in range(4)]
    engine.build(spark, str(docs), "papers", str(tmp_path / "whole"))
    assert content(root) == content(str(tmp_path / "whole")) != []

    before = len(commits)
    follow()
    assert len(commits) == before  # nothing new
    (docs / "old.txt").write_text("It is of fences.\n" * 20)
    os.utime(docs / "old.txt", (1_000_000_000, 1_000_000_000))  # it comes later than younger files
    follow()
    assert {r[0] for r in content(root)} == {"old.txt", *(f"paper{i}.txt" for i in range(4))}
