import datetime
import json

from statera.operators import layout, match
from statera.schemas import RECORD
from statera.sources import readers
from statera.sources.versioned import Archive
from statera.streaming import state


def record(i, net, company="Acme S.r.l.", month=3, saved="2025-04-01T00:00:00Z"):
    return {
        "id": i, "documento": {"tipo": "ordinario"}, "periodo": {"mese": month, "anno": 2025}, "azienda": {"nome": company}, "dipendente": {"nome": "N N", "livello": "4"},
        "totali": {"competenze": 100.0, "trattenute": 100.0 - net, "arrotondamento": None, "netto": net}, "saved": saved,
        "voci": [{"codice": "12", "base": 1.0, "rifQta": 2.0, "competenza": 3.0}, {"codice": "Z1", "descrizione": "paga a@b.it", "competenza": 50.0}],
    }


def test_archive_upsert_backup_and_contribution(spark, tmp_path):
    source = tmp_path / "archive.json"
    source.write_text("\n".join([json.dumps(record("a", 80.0)), json.dumps(record("b", 70.0, month=4)), "{broken"]))
    kept = readers.archive(spark, str(source))
    assert {r["id"]: len(r["voci"]) for r in kept.collect()} == {"a": 1, "b": 1}
    assert readers.repaired(kept).collect() == kept.collect()
    newer = spark.createDataFrame([json.dumps(record("c", 90.0, company="ACME SRL", saved="2025-05-01T00:00:00Z")), json.dumps(record("d", 60.0, company="acme s.r.l.", saved="2025-05-02T00:00:00Z"))], "string")
    arriving = readers.repaired(spark.read.schema(RECORD).json(newer.rdd.map(lambda r: r[0])))
    assert sorted(r["id"] for r in readers.upserted(kept, arriving).collect()) == ["b", "c", "d"]
    readers.backup(kept, str(tmp_path / "backup"))
    assert readers.restored(kept.filter("id = 'a'"), readers.archive(spark, str(tmp_path / "backup"))).count() == 2
    shared = readers.contribution(kept).collect()[0].asDict(recursive=True)
    assert "id" not in shared and "azienda" not in shared and set(shared["dipendente"]) == {"livello", "qualifica"}
    assert shared["voci"][0]["descrizione"] == "paga [EMAIL]" and shared["voci"][0]["competenza"] == 46.5
    assert shared["totali"]["netto"] == round(shared["totali"]["competenze"] - shared["totali"]["trattenute"], 2)


def test_a_stream_keeps_the_newest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    archive = Archive(spark, str(tmp_path / "out"), "key string, at long, value long", ["key"], ["at"], buckets=4)
    for number, rows in enumerate(([("a", 1, 10), ("b", 1, 20)], [("a", 2, 11), ("c", 1, 30)])):
        (source / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(("key", "at", "value"), r, strict=True))) for r in rows))
        stream = state.arriving(spark, str(source), "key string, at long, value long")
        state.kept_up_to_date(stream, archive, str(tmp_path / "state")).awaitTermination()
    assert {r["key"]: r["value"] for r in archive.read().collect()} == {"a": 11, "b": 20, "c": 30}
    assert {r["key"]: r["value"] for r in archive.read(0).collect()} == {"a": 10, "b": 20}


def test_confirmations_are_bounded_by_window(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    day = datetime.datetime(2025, 1, 1)
    rows = [{"ts": (day + datetime.timedelta(minutes=i)).isoformat(), "key": "k"} for i in range(40)] + [{"ts": (day + datetime.timedelta(days=9)).isoformat(), "key": "k"}]
    (source / "0.json").write_text("\n".join(map(json.dumps, rows)))
    stream = state.confirmations(state.arriving(spark, str(source), "ts timestamp, key string"), "ts", ["key"])
    query = stream.writeStream.format("memory").queryName("confirmed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["times"] for r in spark.table("confirmed").collect()) == [1, 30]


def test_rows_of_a_page_follow_the_input_order(spark):
    ys = [100.0, 97.0, 94.0, 100.5, 80.0, 93.9]
    tokens = spark.createDataFrame([(1, i, y) for i, y in enumerate(ys)], "doc_id long, seq int, y double").repartition(3)
    anchors, expected = [], []
    for y in ys:
        at = next((k for k, a in enumerate(anchors) if abs(a - y) <= 3.5), None)
        if at is None:
            anchors.append(y)
            at = len(anchors) - 1
        expected.append(at + 1)
    got = sorted((r["seq"], r["row"]) for r in layout.row_clusters(tokens).collect())
    assert got == list(enumerate(expected))


def test_greedy_pairs_and_suppression(spark):
    pairs = spark.createDataFrame([(1, "a", "x", 3.0), (1, "a", "y", 1.0), (1, "b", "y", 2.0), (1, "b", "x", 9.0)], "k int, a string, b string, c double")
    assert sorted((r["a"], r["b"]) for r in layout.greedy_pairs(pairs, ["k"], "a", "b", "c").collect()) == [("a", "y"), ("b", "x")]
    boxes = spark.createDataFrame([(1, 0.0, 10.0, 0.9), (1, 1.0, 9.0, 0.8), (1, 8.0, 10.0, 0.7)], "k int, x double, w double, quality double")
    assert sorted(r["x"] for r in layout.suppressed(boxes, ["k"]).collect()) == [0.0, 8.0]


def test_as_of_takes_strictly_earlier_values(spark):
    rows = spark.createDataFrame([(1, 10, 5.0), (2, 10, 6.0), (3, 12, 7.0), (4, 9, 1.0)], "id int, at int, v double").withColumnRenamed("id", "tie")
    from pyspark.sql import functions as F

    got = match.as_of(rows.withColumn("k", F.lit(1)), ["k"], "at", "v", "tie").collect()
    assert {r["tie"]: r["previous"] for r in got} == {1: 1.0, 2: 1.0, 3: 6.0, 4: None}
