"""Learning state and the versioned archive, each over two deliveries of a table's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.plans.registry import query
from statera.sources import places, versioned
from statera.streaming import learning


def _taught(t, rows: DataFrame, later, processor: learning.LastEntries) -> DataFrame:
    """The state after two deliveries: rows before ``later``, then the others."""
    source, checkpoint = places.new_dir(t.spark, "taught"), places.new_dir(t.spark, "state")
    for number, part in enumerate((~later, later)):
        rows.filter(part).write.parquet(f"{source}/delivery={number}")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{source}/*")
        learning.learn(stream, processor, checkpoint)
    return learning.learned(t.spark, checkpoint)


_PATHS = ["totali.netto", "periodo", "azienda.nome", "dipendente.livello", "ferie", "tfr"]
_PATH_LIST = "[" + ", ".join(f"'{p}'" for p in _PATHS) + "]"
_ONCE = "[user_id, 1" + "".join(f", CASE WHEN a = {i} OR b = {i} THEN 1 ELSE 0 END" for i in range(1, 7)) + "]"
_AGAIN = "[p[1], least(99, p[2] + 1)" + "".join(f", least(30, p[{i}] + x[1][{i}])" for i in range(3, 9)) + "]"


@query(
    "q_profile_learning",
    f"""WITH e AS (SELECT event_id, event_type AS owner, user_id, 1 + (user_id + event_id) % 6 AS a, CASE WHEN value < 60 THEN 1 + CAST(floor(value) AS BIGINT) % 6 ELSE 0 END AS b FROM events),
    l AS (SELECT owner, list_reduce(list([{_ONCE}] ORDER BY event_id), lambda held, x: CASE WHEN list_contains(list_transform(held, lambda p: p[1]), x[1][1])
        THEN list_transform(held, lambda p: CASE WHEN p[1] = x[1][1] THEN {_AGAIN} ELSE p END) ELSE list_append(held, x[1])[-100:] END, []::BIGINT[][]) AS held FROM e GROUP BY owner),
    p AS (SELECT owner, unnest(held) AS p FROM l)
    SELECT owner, 'profile ' || p[1] AS profile, CAST(p[2] AS INTEGER) AS samples, ({_PATH_LIST})[i] AS path, CAST(p[i + 2] AS INTEGER) AS times FROM p, (SELECT unnest(range(1, 7)) AS i) WHERE p[i + 2] > 0""",
)
def q_profile_learning(t):
    path = lambda n: F.get(F.array(*map(F.lit, _PATHS)), n.cast("int"))
    second = F.when(F.col("value") < 60, path(F.floor("value") % 6))
    rows = t.events.select(
        F.col("event_type").alias("owner"), F.col("event_id").alias("seq"), F.concat(F.lit("profile "), F.col("user_id").cast("string")).alias("key"),
        F.array_compact(F.array(path((F.col("user_id") + F.col("event_id")) % 6), second)).alias("fields"),
    )
    held = _taught(t, rows, F.col("seq") >= 400, learning.Profiles())
    return held.select("owner", F.col("key").alias("profile"), "samples", F.explode("fields").alias("path", "times"))


@query(
    "q_correction_learning",
    """WITH o AS (SELECT o_orderkey, o_orderstatus AS owner, [o_custkey, o_orderkey] AS x FROM orders),
    l AS (SELECT owner, list_reduce(list([x] ORDER BY o_orderkey), lambda held, x: CASE WHEN list_contains(list_transform(held, lambda p: p[1]), x[1][1])
        THEN list_transform(held, lambda p: CASE WHEN p[1] = x[1][1] THEN x[1] ELSE p END) ELSE list_append(held, x[1])[-500:] END, []::BIGINT[][]) AS held FROM o GROUP BY owner),
    p AS (SELECT owner, unnest(held) AS p, unnest(range(1, len(held) + 1)) AS place FROM l)
    SELECT p.owner, c_name AS key, o_orderpriority AS description, c_mktsegment AS category, CAST(place AS INTEGER) AS place
    FROM p JOIN orders ON o_orderkey = p[2] JOIN customer ON c_custkey = p[1]""",
)
def q_correction_learning(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderstatus").alias("owner"), F.col("o_orderkey").alias("seq"), F.col("c_name").alias("key"), F.col("o_orderpriority").alias("description"),
        F.col("c_mktsegment").alias("category"), F.lit(None).cast("string").alias("name"),
    )
    held = _taught(t, rows, F.col("seq") >= 700, learning.Corrections())
    return held.select("owner", "key", "description", "category", F.col("place").cast("int").alias("place"))


@query(
    "q_archive_versions",
    """WITH k AS (SELECT o_custkey AS customer, o_orderstatus AS kind, max(o_orderdate) AS saved, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS record FROM orders GROUP BY ALL)
    SELECT customer, kind, saved, record FROM k WHERE customer % 10 <> 3""",
)
def q_archive_versions(t):
    rows = t.orders.select(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("saved"), F.col("o_orderkey").alias("record"))
    schema = "customer long, kind string, saved timestamp, record long"
    archive = versioned.Archive(t.spark, places.new_dir(t.spark, "archive"), schema, ["customer", "kind"], ["saved", "record"])
    archive.merge(rows.filter("record % 3 <> 0"), 0)
    archive.merge(rows.filter("record % 3 = 0"), 1)
    archive.merge(rows.filter("record % 3 = 0"), 1)  # the same batch again changes nothing
    archive.remove(rows.filter("customer % 10 = 3").select("customer", "kind"), 2)
    return archive.read()
