"""Paged histories as a Spark data source: chats are dealt to tasks, cursors are followed inside, and tries again are Spark's.

``paged_source(client)`` makes a data source from a client, an object that travels to the tasks:

* ``chats(part, parts)`` gives the names of the chats of one part of so many;
* ``page(chat, cursor)`` gives (messages, next cursor), the newest page for cursor None, None after the last; a message is
  (id, role, text);
* for streams also ``latest()``, the server's position, and ``changes(start, end, part, parts)``, the messages (chat, id, role, text)
  told after one position up to another.

A client that fails raises: the task fails and Spark runs it again (``spark.task.maxFailures``); other tasks go on.  As a batch, rows are
chat_id, page (0 the newest), pos, id, role, text, the rows that ``messages.newest_first`` puts in order.  As a stream, the offset is the
server's position: after a restart reading goes on from the checkpoint, and a micro-batch that is run again asks for the same changes.

Defined cases: a chat without messages gives no rows; a page that a client repeats gives its rows again (``newest_first`` counts them
once); more parts than chats leave tasks without rows; null texts stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGES = "chat_id string, page int, pos int, id string, role string, text string"
CHANGES = "chat_id string, id string, role string, text string"
PARTS = 8


class Client(Protocol):
    def chats(self, part: int, parts: int) -> Iterator[str]: ...

    def page(self, chat: str, cursor: Any) -> tuple[list[tuple[str, str, str | None]], Any]: ...


class Part(InputPartition):
    def __init__(self, part: int, parts: int, start: int = 0, end: int = 0):
        super().__init__(part)
        self.part, self.parts, self.start, self.end = part, parts, start, end


class PageReader(DataSourceReader):
    def __init__(self, client: Client, parts: int):
        self.client, self.parts = client, parts

    def partitions(self) -> list[Part]:
        return [Part(k, self.parts) for k in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for chat in self.client.chats(partition.part, partition.parts):
            cursor, page = None, 0
            while True:
                messages, cursor = self.client.page(chat, cursor)
                for pos, (name, role, text) in enumerate(messages):
                    yield chat, page, pos, name, role, text
                page += 1
                if cursor is None:
                    break


class ChangeReader(DataSourceStreamReader):
    def __init__(self, client: Any, parts: int):
        self.client, self.parts = client, parts

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {"position": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"position": self.client.latest()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(k, self.parts, start["position"], end["position"]) for k in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from self.client.changes(partition.start, partition.end, partition.part, partition.parts)


def paged_source(client: Any, name: str = "paged_messages") -> type[DataSource]:
    """A data source class for a client; options: parts, the number of tasks."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return CHANGES if self.options.get("mode") == "changes" else PAGES

        def _parts(self) -> int:
            return int(self.options.get("parts", PARTS))

        def reader(self, schema: Any) -> DataSourceReader:
            return PageReader(client, self._parts())

        def streamReader(self, schema: Any) -> DataSourceStreamReader:  # noqa: N802
            return ChangeReader(client, self._parts())

    return Paged


def read_pages(spark: SparkSession, client: Client, parts: int = PARTS):
    """All pages of all chats."""
    source = paged_source(client)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("parts", parts).load()


def read_changes(spark: SparkSession, client: Any, parts: int = PARTS):
    """A stream of what is told from now on and was told so far."""
    source = paged_source(client, "message_changes")
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).option("parts", parts).option("mode", "changes").load()
