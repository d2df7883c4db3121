"""The paged source over a small server made of files."""

import json
import sys
import zlib

import pytest
from pyspark import cloudpickle

from recallweave.sources import messages as src
from recallweave.sources import paged
from recallweave.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import a test


class Server:
    """Chats in one JSON file: a list of [chat, id, role, text] in the order in which they were told; pages of two, newest first."""

    def __init__(self, path, failing=""):
        self.path, self.failing = path, failing

    def told(self):
        with open(self.path) as f:
            return json.load(f)

    def mine(self, chat, part, parts):
        return zlib.crc32(chat.encode()) % parts == part

    def chats(self, part, parts):
        yield from sorted({m[0] for m in self.told() if self.mine(m[0], part, parts)})

    def page(self, chat, cursor):
        if chat == self.failing:
            raise OSError("no answer")
        own = [m[1:] for m in self.told() if m[0] == chat][::-1]
        at = cursor or 0
        return [tuple(m) for m in own[at : at + 2]], at + 2 if at + 2 < len(own) else None

    def latest(self):
        return len(self.told())

    def changes(self, start, end, part, parts):
        yield from (tuple(m) for m in self.told()[start:end] if self.mine(m[0], part, parts))


TOLD = [[c, f"{c}{i}", "assistant" if i % 2 else "user", f"text {i}" if i != 3 else None] for i in range(5) for c in ("a", "b", "long")] + [["long", f"long{i}", "user", "more"] for i in range(5, 12)]


def test_pages_of_all_chats(spark, tmp_path):
    (tmp_path / "told.json").write_text(json.dumps(TOLD))
    for parts in (1, 5):
        pages = paged.read_pages(spark, Server(str(tmp_path / "told.json")), parts)
        assert pages.rdd.getNumPartitions() == parts
        rows = src.newest_first(pages).orderBy("chat_id", "seq").collect()
        assert [[r.chat_id, r.id, r.role, r.text] for r in rows] == sorted(TOLD, key=lambda m: (m[0], [x for x in TOLD if x[0] == m[0]].index(m)))
    (tmp_path / "told.json").write_text("[]")
    assert paged.read_pages(spark, Server(str(tmp_path / "told.json"))).count() == 0


def test_a_server_that_fails_is_not_passed_over(spark, tmp_path):
    (tmp_path / "told.json").write_text(json.dumps(TOLD))
    with pytest.raises(Exception, match="no answer"):
        paged.read_pages(spark, Server(str(tmp_path / "told.json"), failing="b")).collect()


def test_changes_go_on_from_the_checkpoint(spark, tmp_path):
    for n in (4, 9, 9, len(TOLD)):
        (tmp_path / "told.json").write_text(json.dumps(TOLD[:n]))
        changes = paged.read_changes(spark, Server(str(tmp_path / "told.json")), 3)
        ingest.run_available(changes, str(tmp_path / "out"), str(tmp_path / "ck"))
        got = sorted(map(list, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
        assert got == sorted(TOLD[:n], key=str)
