"""Tournament rosters as a Spark data source: `spark.read.format("tournament_rosters").load(folder)`.

Each payload file is one tournament, whose id is the last number in its path (of `<id>.json` or of a folder `tournament_id=<id>`). Files are
dealt to partitions in groups, so that a task holds one payload at a time; the option `tournament` reads the files of one tournament only.

Defined cases: a file that is missing, unreadable or malformed is a tournament without teams; a folder without files gives no rows; a file
without a number in its path has a null tournament_id.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rosterforge.sources.remote_roster import TEAM_FIELDS, described, plain_teams

FORMAT = "tournament_rosters"
FILES_PER_PARTITION = 64


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def tournament_of(path: str) -> int | None:
    """The id in a payload's path, below the loaded folder: that of its folder tournament_id=, else the last number of its name."""
    if named := re.findall(r"(?:^|/)tournament_id=(\d+)/", path):
        return int(named[-1])
    numbers = re.findall(r"\d+", path.rsplit("/", 1)[-1])
    return int(numbers[-1]) if numbers else None


@dataclass
class PayloadFiles(InputPartition):
    """A group of (tournament_id, path)."""

    files: list[tuple[int | None, str]]


class RosterReader(DataSourceReader):
    def __init__(self, path: str, tournament: int | None, group: int):
        self.path, self.tournament, self.group = path, tournament, group

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        listed = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        below = sorted(f.path for f in listed if f.is_file and not f.base_name.startswith(("_", ".")))
        files = [(tournament_of(p.removeprefix(root)), p) for p in below]
        if self.tournament is not None:
            files = [f for f in files if f[0] == self.tournament]
        return [PayloadFiles(files[k:k + self.group]) for k in range(0, len(files), self.group)] or [PayloadFiles([])]

    def read(self, partition: PayloadFiles) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for tournament, path in partition.files:
            try:
                with system.open_input_stream(path) as stream:
                    teams = json.loads(plain_teams(stream.read().decode("utf-8")))
            except (OSError, ValueError, RecursionError):
                teams = []
            for position, team in enumerate(teams):
                members = [(m["userId"], m["username"], m["inGameName"]) for m in team["members"]]
                yield tournament, position, team["id"], team["name"], members


class RosterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"tournament_id long, position int, {TEAM_FIELDS}"

    def reader(self, schema) -> RosterReader:
        one = self.options.get("tournament")
        return RosterReader(self.options["path"], None if one is None else int(one), int(self.options.get("filesPerPartition", FILES_PER_PARTITION)))


def rosters(spark: SparkSession, path: str, tournament: int | None = None) -> DataFrame:
    """tournament_id, position (in its payload), team_id, team_name, display_name, member_user_ids, member_names of every team below path."""
    spark.dataSource.register(RosterSource)
    reader = spark.read.format(FORMAT)
    return described((reader if tournament is None else reader.option("tournament", str(tournament))).load(path))
