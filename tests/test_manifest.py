"""The manifest that jobs and companies share: no writer loses another's entries."""

import json

import pytest

from postlode.sources import manifest, readers, writers


def test_interleaved_writers_lose_nothing(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/m", []

    def slow(newest):
        calls.append(dict(newest))
        if len(calls) < 3:  # another writer is faster, twice
            manifest.update(spark, folder, lambda m: m | {f"other{len(calls)}": 1}, "other")
        return newest | {"own": sorted(newest)}

    assert manifest.update(spark, folder, slow, "slow") == {"other1": 1, "other2": 1, "own": ["other1", "other2"]}
    assert [sorted(c) for c in calls] == [[], ["other1"], ["other1", "other2"]]
    assert manifest.latest(spark, folder) == (3, {"other1": 1, "other2": 1, "own": ["other1", "other2"]})
    assert json.loads((tmp_path / "m" / "manifest.json").read_text())["own"] == ["other1", "other2"]
    with pytest.raises(ZeroDivisionError):
        manifest.update(spark, folder, lambda m: {"x": 1 / 0}, "broken")
    assert manifest.latest(spark, folder)[0] == 3
    with pytest.raises(RuntimeError, match="faster"):
        manifest.update(spark, folder, lambda m: manifest.update(spark, folder, lambda n: n, "other") or m, "never", tries=2)


def test_plain_layout_is_taken_over(spark, tmp_path):
    for name, body, told in (("a", '{"x": 1}', {"x": 1}), ("b", "no json", {}), ("c", "[1]", {})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(body)
        assert manifest.latest(spark, f"file://{tmp_path}/{name}") == (0, told)
        assert manifest.update(spark, f"file://{tmp_path}/{name}", lambda m: m | {"y": 2}, "w") == told | {"y": 2}
    assert manifest.latest(spark, f"file://{tmp_path}/none") == (0, {})
    with pytest.raises(ValueError, match="no manifest"):
        readers.Dataset(spark, f"file://{tmp_path}/none")


def test_empty_slices_are_refused():
    entry = lambda n: {"rows": n}
    before = {"by_ats": {"a": {"jobs": entry(3)}, "b": entry(0), "c": entry(2)}, "by_ats_companies": {"b": entry(5), "d": entry("x"), "e": None}}
    writers.guard_empty({"a": 1, "b": 1, "c": 1}, before)
    for counts, names in (({"b": 1, "c": 1}, "a"), ({"a": 1, "c": 1}, "b"), ({"a": 1, "b": 1}, "c")):
        with pytest.raises(ValueError, match=rf"some: {names} \("):
            writers.guard_empty(counts, before)
    writers.guard_empty({}, before, allow=True)
    writers.guard_empty({}, {"by_ats": None, "by_ats_companies": 3})


def test_jobs_and_companies_share_a_manifest(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    posts = spark.createDataFrame([("lever", "1", "u1", "Dev", 1), ("seek", "2", "u1", "Dev", 2)], "ats_type string, ats_id string, url string, title string, row_order long")
    posts = posts.selectExpr("*", "cast(null as string) as location", "cast(null as string) as company", "cast(null as string) as country_iso")
    writers.publish_companies(spark.createDataFrame([("lever", "x"), ("seek", "y"), ("seek", "z")], "ats_type string, slug string"), folder, "c1")
    first = writers.publish(posts, folder, "t1")
    assert first["by_ats_companies"]["seek"]["rows"] == 2 and first["companies"]["rows"] == 3
    for entry in (first["by_ats"]["lever"]["jobs"], first["all"]["sums"]["parquet"], first["all"]["sums"]["csv"]):
        assert entry["files"] > 0 and entry["size"] > 0 and len(entry["sha256"]) == 64
    second = writers.publish_companies(spark.createDataFrame([("lever", "x")], "ats_type string, slug string"), folder, "c2")
    assert second["by_ats"] == first["by_ats"] and second["by_ats_companies"] == {"lever": {"parquet": "companies/c2/ats_type=lever", "rows": 1}}
    # seek has no companies any more, but rows in the manifest; lever has both.
    with pytest.raises(ValueError, match="seek"):
        writers.publish(posts.where("ats_type = 'lever'"), folder, "t2")
    assert manifest.latest(spark, folder)[0] == 3
    assert list(writers.publish(posts.where("ats_type = 'lever'"), folder, "t3", allow_empty=True)["by_ats"]) == ["lever"]
    assert readers.Dataset(spark, folder).load(source="lever").count() == 1
