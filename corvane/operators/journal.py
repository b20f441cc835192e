"""Event journals: folds, contiguity, chunks, manifests, state machines (T-1 to T-9, T-14, T-15, A9, A10, A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def folded(events: DataFrame) -> DataFrame:
    """T-4: (stream, entity, sequence, digest) of live entities: the last event of each decides, a delete removes. Combines before its one shuffle."""
    last = F.max_by(F.struct("op", "digest", "sequence"), "sequence").alias("l")
    return events.groupBy("stream", "entity").agg(last).where("l.op <> 'delete'").select("stream", "entity", "l.sequence", "l.digest")


def tombstones(events: DataFrame) -> DataFrame:
    """T-2: (stream, entity, sequence) of entities whose last event is a delete."""
    return events.groupBy("stream", "entity").agg(F.max_by(F.struct("op", "sequence"), "sequence").alias("l")).where("l.op = 'delete'").select("stream", "entity", "l.sequence")


def contiguity(events: DataFrame) -> DataFrame:
    """T-5, A12: (stream, events, first, next, gaps): breaks in each stream's sequence, and the number it goes on with."""
    step = F.col("sequence") - F.lag("sequence").over(Window.partitionBy("stream").orderBy("sequence"))
    marked = events.select("stream", "sequence", step.alias("step"))
    return marked.groupBy("stream").agg(F.count("*").alias("events"), F.min("sequence").alias("first"), (F.max("sequence") + 1).alias("next"), F.count_if(F.col("step") != 1).alias("gaps"))


def after(events: DataFrame, cursor: int, limit: int) -> DataFrame:
    """Each stream's next ``limit`` events behind a cursor."""
    behind = events.where(F.col("sequence") > cursor)
    return behind.withColumn("rn", F.row_number().over(Window.partitionBy("stream").orderBy("sequence"))).where(F.col("rn") <= limit).drop("rn")


def chunks(events: DataFrame, most: int) -> DataFrame:
    """T-1: (stream, chunk, events, first, last): at most ``most`` events of a stream a chunk."""
    return events.withColumn("chunk", F.floor((F.col("sequence") - 1) / most)).groupBy("stream", "chunk").agg(F.count("*").alias("events"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))


def manifests(entities: DataFrame) -> DataFrame:
    """(stream, manifest): SHA-256 over a stream's entities in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("entity", "digest"))), lambda x: F.concat(x["entity"].cast("string"), F.lit(":"), x["digest"]))
    return entities.groupBy("stream").agg(F.sha2(F.array_join(lines, "|"), 256).alias("manifest"))


def applied(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """T-3: (stream, status) of each stream's batch (stream, sequence, event_id) against (stream, cursor, known).

    A batch that starts behind the cursor and has no gap is applied; one that lies before it and was seen is a
    duplicate; one that was seen with other content is an idempotency conflict; all else is a cursor conflict.
    """
    b = events.groupBy("stream").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.countDistinct("sequence").alias("n"), F.xxhash64(F.array_sort(F.collect_list("event_id"))).alias("content"))
    j = b.join(cursors, "stream", "left")
    cursor, whole = F.coalesce("cursor", F.lit(0)), F.col("last") - F.col("first") + 1 == F.col("n")
    status = F.when(whole & (F.col("first") == cursor + 1), "applied").when(whole & (F.col("last") <= cursor) & (F.col("known") == F.col("content")), "duplicate").when(whole & (F.col("last") <= cursor), "idempotency_conflict").otherwise("cursor_conflict")
    return j.select("stream", status.alias("status"))


def handoff_states(events: DataFrame) -> DataFrame:
    """T-15: (id, state, agent): pending, claimed, completed or cancelled after (id, sequence, action, actor) in order.

    A claim holds from pending; completion asks for the claimant; a cancel ends what isn't completed. All that the
    state doesn't allow changes nothing. A fold over each handoff's own events, inside the engine.
    """
    start = F.struct(F.lit("pending").alias("state"), F.lit("").alias("agent"))

    def step(acc, e):
        claim = (e["action"] == "claim") & (acc["state"] == "pending")
        complete = (e["action"] == "complete") & (acc["state"] == "claimed") & (acc["agent"] == e["actor"])
        cancel = (e["action"] == "cancel") & acc["state"].isin("pending", "claimed")
        state = F.when(claim, "claimed").when(complete, "completed").when(cancel, "cancelled").otherwise(acc["state"])
        return F.struct(state.alias("state"), F.when(claim, e["actor"]).otherwise(acc["agent"]).alias("agent"))

    ordered = events.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sequence", "action", "actor"))).alias("es"))
    return ordered.select("id", F.aggregate("es", start, step).alias("s")).select("id", "s.state", "s.agent")


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """T-14: an idempotent create: of the rows with one key the first stays."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def section_digests(sections: dict[str, DataFrame]) -> DataFrame:
    """A10: (section, digest) of each table, and of all of them together under the name ''.

    A row is the SHA-256 of its length-prefixed values in text form, null as ''. Rows go to buckets by the first four
    digits of that, a bucket is the hash of its rows in order and a section that of its buckets, so the digest doesn't
    depend on how rows lie and no task holds more than a bucket or 65,536 of them. Repeated rows count.
    """
    rows = None
    for name, table in sections.items():
        values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns]
        each = table.select(F.lit(name).alias("section"), T.canonical_fingerprint(*values).alias("h"))
        rows = each if rows is None else rows.unionByName(each)
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    buckets = rows.groupBy("section", F.substring("h", 1, 4).alias("bucket")).agg(joined(F.col("h")).alias("d"))
    digests = buckets.groupBy("section").agg(joined(F.concat("bucket", "d")).alias("digest"))
    whole = digests.agg(joined(F.concat_ws(":", "section", "digest")).alias("digest")).select(F.lit("").alias("section"), "digest")
    return digests.unionByName(whole)


def ingested(events: DataFrame, bindings: DataFrame, known: DataFrame) -> DataFrame:
    """T-9: (event_id, status) of remote events (event_id, stream, repository): quarantined where ``bindings`` (stream,
    repository) don't bind the stream to that repository, duplicate where ``known`` (event_id) has it, else accepted."""
    bound = bindings.distinct().withColumn("bound", F.lit(True))
    seen = known.select("event_id").distinct().withColumn("seen", F.lit(True))
    both = events.join(bound, ["stream", "repository"], "left").join(seen, "event_id", "left")
    return both.select("event_id", F.when(F.col("bound").isNull(), "quarantined").when(F.col("seen"), "duplicate").otherwise("accepted").alias("status"))


def claimed(pending: DataFrame, attempts: DataFrame, most: int = 3) -> DataFrame:
    """T-12: (batch, status, attempt, lines) of spooled batches: ``pending`` (batch, seq, line), ``attempts`` (batch, attempts).

    A batch that was tried ``most`` times is quarantined. Others are claimed for one attempt more, with each line once,
    in the order of its first place; blank lines don't count, and a batch without others is acknowledged.
    """
    first = pending.where(F.coalesce("line", F.lit("")) != "").groupBy("batch", "line").agg(F.min("seq").alias("seq"))
    lines = first.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("lines"))
    tried = F.coalesce("attempts", F.lit(0))
    status = F.when(tried >= most, "quarantined").when(F.col("lines").isNull(), "acknowledged").otherwise("claimed")
    each = pending.select("batch").distinct().join(attempts, "batch", "left").join(lines, "batch", "left").withColumn("status", status)
    none = F.array().cast("array<string>")
    return each.select("batch", "status", F.when(F.col("status") == "claimed", tried + 1).otherwise(0).alias("attempt"), F.when(F.col("status") == "claimed", F.col("lines")).otherwise(none).alias("lines"))
