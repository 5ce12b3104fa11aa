import random
from pathlib import Path

import pytest

from statera.sources import places
from statera.sources.versioned import Archive, Conflict
from statera.streaming import learning

PROFILES = "owner string, seq long, key string, fields array<string>"


def plain(rows, most):
    """owner to a list of [key, samples, fields], cut from the front."""
    owners = {}
    for owner, _, key, fields in sorted(rows, key=lambda r: r[1]):
        if not key:
            continue
        held = owners.setdefault(owner, [])
        entry = next((e for e in held if e[0] == key), None)
        if entry is None:
            held.append(entry := [key, 0, {}])
        entry[1] = min(99, entry[1] + 1)
        for f in set(fields or []):
            entry[2][f] = min(30, entry[2].get(f, 0) + 1)
        del held[:-most]
    return owners


def stream(spark, folder):
    return spark.readStream.schema(PROFILES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_two_deliveries_equal_one_and_the_oldest_go(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), i, draw.choice([f"k{draw.randint(0, 160)}", f"k{draw.randint(0, 9)}"]), draw.sample(["x", "y", "z"], draw.randint(0, 3))) for i in range(900)]
    rows += [("a", 2000, None, ["x"]), ("a", 2001, "", ["x"]), ("c", 2002, "only", None)] + [("a", 3000 + i, "often", ["x"]) for i in range(120)]
    expected = plain(rows, learning.MOST_PROFILES)
    assert any(len({r[2] for r in rows if r[0] == o}) > learning.MOST_PROFILES for o in ("a", "b"))
    for name, cuts in (("one", [len(rows)]), ("two", [450, len(rows)])):
        start = 0
        for number, end in enumerate(cuts):
            spark.createDataFrame(rows[start:end], PROFILES).coalesce(1).write.parquet(str(tmp_path / name / str(number)))
            learning.learn(stream(spark, tmp_path / name), learning.Profiles(), str(tmp_path / f"{name}-state"))
            start = end
        got = {}
        for r in sorted(learning.learned(spark, str(tmp_path / f"{name}-state")).collect(), key=lambda r: r["place"]):
            got.setdefault(r["owner"], []).append([r["key"], r["samples"], dict(r["fields"])])
        assert got == expected
    assert next(e for e in expected["a"] if e[0] == "often")[1:] == [99, {"x": 30}]


def test_a_correction_is_renewed_in_its_place(spark, tmp_path):
    schema = "owner string, seq long, key string, description string, category string, name string"
    rows = [("o", i, f"k{i}", f"d{i}", None, None) for i in range(520)] + [("o", 600, "k25", "new", "pay", "n"), ("o", 601, "k0", "back", None, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / "0"))
    learning.learn(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), learning.Corrections(), str(tmp_path / "state"))
    held = sorted(learning.learned(spark, str(tmp_path / "state")).collect(), key=lambda r: r["place"])
    assert [r["key"] for r in held] == [f"k{i}" for i in range(21, 520)] + ["k0"]
    assert [(r["description"], r["category"]) for r in held if r["key"] in ("k25", "k0")] == [("new", "pay"), ("back", None)]


def ranges(spark):
    return {str(f) for f in Path(places.shared_dir(spark).removeprefix("file://")).glob("statera/ranges-*")}


def test_corrections_of_one_owner_are_met_by_many_tasks(spark, tmp_path):
    # lists that are soon alike, lists that stay apart (a key more than entries), nothing pushed out; equal seq and none
    draw = random.Random(5)
    owners = [("many", 3000, 6000), ("close", learning.MOST_ALIASES + 1, 6000), ("few", 400, 4000), (None, 700, 1500)]
    drawn = [(o, draw.choice([None, *range(3000)]), f"k{draw.randrange(keys)}") for o, keys, n in owners for _ in range(n)]
    rows = [(o, at, k, f"d{i}", draw.choice(["pay", None]), None) for i, (o, at, k) in enumerate(drawn)]
    expected = {}
    for o, at, k, *said in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        held = expected.setdefault(o, {})
        held[k] = said
        if len(held) > learning.MOST_ALIASES:
            del held[next(iter(held))]
    schema = "owner string, seq long, key string, description string, category string, name string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / "0"))
    before = ranges(spark)
    learning.learn(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), learning.Corrections(), str(tmp_path / "state"), range_rows=1000)
    got = {}
    for r in sorted(learning.learned(spark, str(tmp_path / "state")).collect(), key=lambda r: r["place"]):
        got.setdefault(r["owner"], []).append((r["key"], [r["description"], r["category"], r["name"]]))
    assert got == {o: list(held.items()) for o, held in expected.items()}
    (folder,) = ranges(spark) - before
    sizes = [r["count"] for r in spark.read.parquet(folder).groupBy("chunk").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 3000  # an owner has up to 6,000 rows


def test_profiles_of_one_owner_are_met_by_many_tasks(spark, tmp_path):
    draw = random.Random(7)
    owners = [("many", 400), ("close", learning.MOST_PROFILES + 1), ("few", 60), (None, 300)]
    rows = [(o, i, f"k{draw.randrange(keys)}", draw.choice([None, [], ["x", "x", None], ["y", "z"]])) for i in range(1500) for o, keys in owners]
    rows += [("few", 2000 + i, "k1", ["x"]) for i in range(120)]
    before, cut = ranges(spark), 2400
    for number, part in enumerate((rows[:cut], rows[cut:])):
        spark.createDataFrame(part, PROFILES).coalesce(1).write.parquet(str(tmp_path / "in" / str(number)))
        learning.learn(stream(spark, tmp_path / "in"), learning.Profiles(), str(tmp_path / "state"), range_rows=600)
    got = {}
    for r in sorted(learning.learned(spark, str(tmp_path / "state")).collect(), key=lambda r: r["place"]):
        got.setdefault(r["owner"], []).append([r["key"], r["samples"], dict(r["fields"])])
    assert got == plain([(o, at, k, set(f or []) - {None}) for o, at, k, f in rows], learning.MOST_PROFILES)
    sizes = [[r["count"] for r in spark.read.parquet(f).groupBy("chunk").count().collect()] for f in ranges(spark) - before]
    assert len(sizes) == 2 and all(len(s) > 3 and max(s) < 1500 for s in sizes)  # an owner has up to 1,620 rows


def archive(spark, tmp_path, **more):
    return Archive(spark, str(tmp_path / "archive"), "k string, at long, v string", ["k"], ["at"], buckets=8, **more)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, at long, v string")


def test_a_batch_of_one_key_rewrites_one_bucket(spark, tmp_path):
    kept = archive(spark, tmp_path)
    assert kept.read().collect() == [] and kept.version() == -1
    kept.merge(rows(spark, *((f"k{i}", 1, "a") for i in range(100)), (None, 1, "null")), 0)
    before = kept.manifest()
    kept.merge(rows(spark, ("k7", 3, "c"), ("k7", 2, "b")), 1)
    after = kept.manifest()
    assert sum(before["buckets"][b] != after["buckets"][b] for b in before["buckets"]) == 1
    assert {r["v"] for r in kept.read().filter("k = 'k7'").collect()} == {"c"} and kept.read().count() == 101
    assert kept.merge(rows(spark, ("k8", 9, "late")), 1) == after["version"]  # a batch that runs again
    assert kept.merge(rows(spark), 2) == after["version"]
    kept.merge(rows(spark, ("k7", 1, "old"), (None, 2, "new")), 3)
    assert {r["k"]: r["v"] for r in kept.read().filter("k = 'k7' or k is null").collect()} == {"k7": "c", None: "new"}


def test_removal_versions_and_vacuum(spark, tmp_path):
    kept = archive(spark, tmp_path)
    kept.merge(rows(spark, ("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")), 0)
    kept.remove(rows(spark, ("a", 0, ""), (None, 0, ""), ("unknown", 0, "")), 1)
    assert [tuple(r) for r in kept.read().collect()] == [("b", 1, "y")]
    assert kept.read(0).count() == 3
    kept.vacuum(keep=1)
    assert [tuple(r) for r in kept.read().collect()] == [("b", 1, "y")]


def test_only_one_of_two_writers_commits(spark, tmp_path):
    kept = archive(spark, tmp_path)
    kept.merge(rows(spark, ("a", 1, "x")), 0)
    stale = kept.manifest()
    kept.merge(rows(spark, ("a", 2, "y")), 1)
    with pytest.raises(Conflict):
        kept._commit({"version": stale["version"] + 1, "batch": 1, "buckets": {}})
    assert [tuple(r) for r in kept.read().collect()] == [("a", 2, "y")]
