"""Review sources that are asked title by title, as Spark data sources.

A filter on ``movie_id`` is pushed into the source: its titles are dealt to tasks, and nothing is asked about any other title.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from titleflow import schemas

#: Titles that one task asks for.
TITLES_PER_TASK = 8


class TitleSource(DataSource):
    """Base of a source: name it by ``name`` and fetch the reviews of one title by ``fetch``.

    Options given to the read are in ``self.options``. What ``fetch`` raises fails the read, so the source as a whole.
    """

    def schema(self):
        return schemas.REVIEWS

    def fetch(self, movie_id: str) -> Iterable[tuple]:
        """Rows of one title in the order of :data:`schemas.REVIEWS`."""
        raise NotImplementedError

    def reader(self, schema) -> "TitleReader":
        return TitleReader(self)


class TitleReader(DataSourceReader):
    def __init__(self, source: TitleSource) -> None:
        self.source = source
        self.asked: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the filters that name titles; Spark applies all others."""
        for one in filters:
            if isinstance(one, (EqualTo, In)) and one.attribute == ("movie_id",):
                named = [one.value] if isinstance(one, EqualTo) else list(one.value)
                self.asked = named if self.asked is None else [m for m in self.asked if m in set(named)]
            else:
                yield one

    def partitions(self) -> list[InputPartition]:
        if self.asked is None:
            raise ValueError("a source of titles is read with a filter on movie_id")
        titles = sorted({m for m in self.asked if m is not None})
        return [InputPartition(titles[k:k + TITLES_PER_TASK]) for k in range(0, len(titles), TITLES_PER_TASK)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for movie_id in partition.value:
            yield from self.source.fetch(movie_id)
