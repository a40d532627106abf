"""Rosters as a data source, and lists of a tournament's teams that fall back to them."""

import json

from rosterforge.operators import text
from rosterforge.sources import roster_source

ENTRIES = "tournament_id long, team_id long, name string, lineup_count long, event_time_ms long"


def payload(*teams):
    return json.dumps([{"_1": 2}, "route", {"_3": 4}, "data", json.dumps({"tournament": {"ctx": {"teams": list(teams)}}})])


def team(i, name, *members):
    return {"id": i, "name": name, "members": [{"userId": 100 * i + k, "username": m} for k, m in enumerate(members)]}


def folder(tmp_path):
    (tmp_path / "17.json").write_text(payload(team(5, "Moonlight", "Ann"), team(3, None, "Bo", "Cy"), {"id": "x"}, 4))
    (tmp_path / "tournament_id=18").mkdir()
    (tmp_path / "tournament_id=18" / "part-0007").write_text(payload(team(9, "Nova")))
    (tmp_path / "19.json").write_text("[not json")
    (tmp_path / "20.json").write_bytes(b"\xff\xfe")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "notes.txt").write_text(payload(team(1, "Loose")))
    return f"file:{tmp_path}"


def test_rows_of_all_files(spark, tmp_path):
    rows = roster_source.rosters(spark, folder(tmp_path)).collect()
    got = sorted(((r.tournament_id or 0, r.position, r.team_id, r.display_name) for r in rows), key=str)
    assert got == sorted([(0, 0, 1, "Loose"), (17, 0, 5, "Moonlight"), (17, 1, 3, "[No team name] Bo / Cy"), (17, 2, None, "Untitled team"), (18, 0, 9, "Nova")], key=str)
    assert [r.team_id for r in roster_source.rosters(spark, str(tmp_path), 18).collect()] == [9]
    assert roster_source.rosters(spark, str(tmp_path), 19).isEmpty() and roster_source.rosters(spark, str(tmp_path / "absent")).isEmpty()


def test_groups_of_files_are_partitions(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.json").write_text(payload(team(i + 1, f"T{i}")))
    spark.dataSource.register(roster_source.RosterSource)
    frame = spark.read.format(roster_source.FORMAT).option("filesPerPartition", "4").load(str(tmp_path))
    assert frame.rdd.getNumPartitions() == 3 and frame.count() == 10
    only = roster_source.RosterReader(str(tmp_path), 7, 4).partitions()
    assert [len(p.files) for p in only] == [1]


def test_a_tournament_of_the_dataset_is_not_looked_up(spark, tmp_path):
    rosters = roster_source.rosters(spark, folder(tmp_path))
    entries = spark.createDataFrame([(17, 1, "Alpha", 2, 5), (17, 2, "Al-Pha!", 9, None), (17, 4, None, 9, 6), (16, 7, "Alpha", 1, 1)], ENTRIES)
    ids = lambda *a: [(r.team_id, r.source) for r in text.listed_tournament_teams(entries, rosters, *a).collect()]
    assert ids(17) == [(2, "dataset"), (4, "dataset"), (1, "dataset")] and ids(17, "", 0) == [(2, "dataset")]
    assert ids(17, "ALPHA") == [(2, "dataset"), (1, "dataset")] and ids(16, "alp") == [(7, "dataset")]
    # Nobody of the dataset is called so: the remote teams answer, in the order of their payload.
    assert ids(17, "bo") == [(3, "remote")] and ids(17, "ann") == [(5, "remote")]
    assert ids(18) == [(9, "remote")] and ids(19) == [] and ids(99) == []
    none = entries.limit(0)
    assert [r.display_name for r in text.listed_tournament_teams(none, rosters, 17).collect()] == ["Moonlight", "[No team name] Bo / Cy", "Untitled team"]
    shown = {r.team_id: (r.team_name, r.lineup_count, r.event_time_ms) for r in text.listed_tournament_teams(entries, rosters, 17).collect()}
    assert shown[4] == ("4", 9, 6)
