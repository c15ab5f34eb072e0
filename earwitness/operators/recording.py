"""Recording pilot events: appending to hash chains with compare-and-set on their heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earwitness.functions.hashing import nested_json, sha256_text
from earwitness.operators.latest import earliest
from earwitness.session import cut_lineage

BROKEN = "ledger integrity check failed"
TWICE = "already requested"
STALE = "the ledger has another head"


def event_sha256(events: DataFrame) -> Column:
    """Hash of an event: canonical JSON of its id, its facts (the struct ``event``) and the hash before it."""
    facts = F.struct("event", "event_id", "previous_event_sha256")
    return sha256_text(nested_json(facts, events.select(facts.alias("f")).schema["f"].dataType))


def record_events(requests: DataFrame, heads: DataFrame) -> DataFrame:
    """Every request with ``position`` and ``reason``: recorded (NULL reason) or refused.

    ``requests``: job_id, seq (order of arrival, unique in a job), event_id,
    previous_event_sha256 (the head its writer read, NULL for none) and event, a
    struct of facts. ``heads``: job_id, ok, event_count, latest_event_sha256, as
    ``pilot.chain_report`` gives them; a job without events has no row.

    A request is recorded if the head it names is the head when it arrives; its own
    hash is then the head. Of several that name one head the first to arrive wins.
    Hashes depend on nothing but the request, so no task goes through a job's
    requests one by one: winners are found by an aggregate, and those that the
    present head leads to by following pointers, twice as far each round. Requests
    of a broken chain, and later deliveries of one event id, are refused.
    """
    known = heads.select("job_id", F.col("ok").alias("__ok"), F.col("event_count").alias("__count"), F.col("latest_event_sha256").alias("__head"))
    first = earliest(requests.select("job_id", "event_id", "seq"), ["job_id", "event_id"], ["seq"]).withColumnRenamed("seq", "__first")
    asked = requests.withColumn("event_sha256", event_sha256(requests)).join(known, "job_id", "left").join(first, ["job_id", "event_id"], "left")
    asked = cut_lineage(asked.withColumns({
        "__count": F.coalesce("__count", F.lit(0)).cast("long"), "__fault": F.when(~F.coalesce("__ok", F.lit(True)), F.lit(BROKEN)).when(F.col("seq") > F.col("__first"), F.lit(TWICE)),
        "__root": F.col("previous_event_sha256").eqNullSafe(F.col("__head"))}))

    sound = asked.where("__fault is null").select("job_id", "seq", "event_sha256", "previous_event_sha256", "__root", "__count")
    named = sound.select("job_id", F.col("event_sha256").alias("previous_event_sha256"), F.col("seq").alias("__after"))
    able = sound.join(named, ["job_id", "previous_event_sha256"], "left").where("__root or seq > __after")
    ranked = able.groupBy("job_id", "previous_event_sha256").agg(F.min_by(F.struct("seq", "event_sha256", "__root", "__count"), "seq").alias("w"))
    steps = ranked.select("job_id", F.col("w.event_sha256").alias("event_sha256"), F.when(~F.col("w.__root"), F.col("previous_event_sha256")).alias("__to"),
                          F.lit(1).cast("long").alias("__steps"), F.col("w.__root").alias("__done"))
    steps = cut_lineage(steps)
    while not (waiting := steps.where("not __done")).isEmpty():
        ahead = steps.select("job_id", F.col("event_sha256").alias("__to"), F.col("__to").alias("__beyond"), F.col("__steps").alias("__more"), F.col("__done").alias("__reached"))
        jumped = waiting.join(ahead, ["job_id", "__to"]).select(
            "job_id", "event_sha256", F.col("__beyond").alias("__to"), (F.col("__steps") + F.col("__more")).alias("__steps"), F.col("__reached").alias("__done"))
        steps = cut_lineage(steps.where("__done").unionByName(jumped))
    recorded = steps.select("job_id", "event_sha256", "__steps")
    out = asked.join(recorded, ["job_id", "event_sha256"], "left")
    won = F.col("__fault").isNull() & F.col("__steps").isNotNull()
    return out.select(
        *requests.columns, "event_sha256", F.when(won, F.col("__count") + F.col("__steps") - 1).alias("position"),
        F.coalesce("__fault", F.when(F.col("__steps").isNull(), F.lit(STALE))).alias("reason"))
