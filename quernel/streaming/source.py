"""A stream of draws from a family as a Spark data source, for trying streaming fits: rows of a block depend on its number and the seed alone."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.families import family


class Block(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class DrawReader(DataSourceStreamReader):
    """Offsets are numbers of blocks; each trigger offers the next ``blocks_each``, up to ``blocks``."""

    def __init__(self, options: dict):
        self.name, self.params = options["family"], json.loads(options["params"])
        self.rows, self.blocks, self.each, self.seed = (int(options.get(k, d)) for k, d in (("rows", 1000), ("blocks", 10), ("blocks_each", 4), ("seed", 0)))
        self.at = 0

    def initialOffset(self) -> dict:
        return {"block": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.blocks, self.at + self.each)
        return {"block": self.at}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        self.at = max(self.at, end["block"])
        return [Block(k) for k in range(start["block"], end["block"])]

    def read(self, partition: Block):
        draws = family(self.name).sample(np.random.default_rng([self.seed, partition.value]), self.rows, *self.params)
        for i, v in enumerate(np.asarray(draws, float).tolist()):
            yield (partition.value, partition.value * self.rows + i, v)


class Draws(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quernel_draws"

    def schema(self) -> str:
        return "block bigint, row bigint, value double"

    def streamReader(self, schema) -> DrawReader:
        return DrawReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.readStream.format("quernel_draws")`` known; options: family, params (JSON), rows, blocks, blocks_each, seed."""
    spark.dataSource.register(Draws)
