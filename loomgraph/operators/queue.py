"""State model of the ingest queue: predicates, picks, transitions and statistics as set operations.

A queue is two frames, episodes and dead letters, one row an id. A transition takes frames and gives new frames; ``now``
is always a parameter. Uniqueness of active payloads is kept inside a transition by ranking the rows that want to
become active, in pick order, and leaving out hashes that are already active. Publishing is a matter of
``plans.versions``. Times compare as times, whatever their text form; ids break every tie.

Nulls: an error of null is never permanent; an empty or null start keeps a processing row, an unreadable one counts
as stuck; rows without an id are kept but never picked.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions.text import stripped, utc_time
from loomgraph.plans.skew import spread_join

# Statuses, error codes, error signatures and messages of the queue.
ACTIVE = ["queued", "processing"]
PERMANENT_CODES = ["Error code: 404", "Error code: 402"]
SCHEMA_SIGNATURES = ["ExtractedEdges()", "ExtractedEntities()", "entity_resolutions", "duplicate_facts", "SummarizedEntities", "argument after ** must be a mapping"]
FATAL_CLASSES = ["TypeError", "ValueError", "KeyError", "ValidationError"]
STUCK_ERROR = "Processing timeout exceeded"
HELD_ERROR = "reaped: canonical hash already held by an active row"
SKIPPED = "skipped_duplicate"
MODES = ["off", "observe", "enforce"]
LOCKED = "mcp_only"


@dataclass(frozen=True)
class RetryPolicy:
    """Which failures may run again, and how many at once."""

    permanent_codes: tuple[str, ...] = tuple(PERMANENT_CODES)
    allowed_codes: tuple[str, ...] = ()
    max_attempts: int = 3
    respect_ceiling: bool = True
    reap_limit: int = 100


def latest_rows(rows: DataFrame, key: str, time: str) -> DataFrame:
    """One row a key: the one of the latest ``time``, then the greatest in the order of the columns. Null keys are one key."""
    columns = rows.columns
    return rows.groupBy(key).agg(F.max(F.struct(utc_time(F.col(time)).alias("_t"), *columns)).alias("_r")).select(*[F.col("_r")[c].alias(c) for c in columns])


# predicates


def has_code(error: Column, code: str) -> Column:
    """The error contains the code in any letter case, with no wildcards."""
    return F.instr(F.lower(error), code.lower()) > 0


def retryable(error: Column, policy: RetryPolicy = RetryPolicy(), any_allowed: bool = False) -> Column:
    """A null error or one without a permanent code; an allowlist takes the denylist's place.

    Each allowed code must be in the error; with ``any_allowed`` one of them is enough.
    """
    if policy.allowed_codes:
        join = operator.or_ if any_allowed else operator.and_
        return functools.reduce(join, [error.isNull() | has_code(error, c) for c in policy.allowed_codes])
    return functools.reduce(operator.and_, [error.isNull() | ~has_code(error, c) for c in policy.permanent_codes], F.lit(True))


def in_classes(error: Column, classes: list[str]) -> Column:
    """The error contains any of the classes' texts in any letter case."""
    return F.coalesce(functools.reduce(operator.or_, [has_code(error, c) for c in classes], F.lit(False)), F.lit(False))


def like_classes(error: Column, classes: list[str]) -> Column:
    """As in_classes, but _ and % in a class are wildcards."""
    return F.coalesce(functools.reduce(operator.or_, [F.lower(error).like(f"%{c.lower()}%") for c in classes], F.lit(False)), F.lit(False))


def cut_text(text: Column, most: int | None) -> Column:
    """The first ``most`` characters and an ellipsis if the text is longer; None or 0 turns it off."""
    return text if not most else F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def refusal(error: Column, policy: RetryPolicy = RetryPolicy()) -> Column:
    """The first permanent code in an error; null if it may run again."""
    return F.coalesce(F.lit(None).cast("string"), *[F.when(has_code(error, c), F.lit(c)) for c in policy.permanent_codes])


def retry_decision(attempts: Column, error_class: Column, message: Column, max_attempts: int = 3) -> Column:
    """'dead' at the last attempt, for an error of the program or a schema that won't change; else 'retry'."""
    signed = functools.reduce(operator.or_, [F.contains(message, F.lit(s)) for s in SCHEMA_SIGNATURES])
    return F.when((attempts + 1 >= max_attempts) | error_class.isin(FATAL_CLASSES) | F.coalesce(signed, F.lit(False)), "dead").otherwise("retry")


def backoff_seconds(attempt: Column, base: float = 2.0, factor: float = 2.0, most: float = 300.0) -> Column:
    """base * factor ^ (attempt - 1), at most ``most``."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), F.greatest(attempt - 1, F.lit(0))), F.lit(most))


def error_text(error_class: Column, message: Column) -> Column:
    """'Class: message', a missing message named as such."""
    return F.concat(error_class, F.lit(": "), F.coalesce(F.nullif(stripped(message), F.lit("")), F.lit("<no message>")))


# hashes and duplicates


def payload_field(payload: Column, name: str) -> Column:
    """A text property of a JSON payload; null if the payload is unreadable."""
    return F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "string")


def canonical_hash(payload: Column) -> Column:
    """SHA-256 of content, group and source joined by pipes; null unless all three are there."""
    parts = [payload_field(payload, n) for n in ("content", "group_id", "source_description")]
    complete = functools.reduce(operator.and_, [p.isNotNull() for p in parts])
    return F.when(complete, F.sha2(F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2]), 256))


def backfilled(episodes: DataFrame) -> DataFrame:
    """Episodes whose missing canonical hash is computed where the payload allows it."""
    return episodes.withColumn("canonical_hash", F.coalesce("canonical_hash", canonical_hash(F.col("payload_json"))))


def held_hash() -> Column:
    """The hash an episode is known by: the canonical one, else the older one."""
    return F.coalesce("canonical_hash", "payload_hash")


def active_holders(episodes: DataFrame) -> DataFrame:
    """(hash, existing_id): the newest active episode of each hash."""
    active = episodes.where(F.col("status").isin(ACTIVE)).select(held_hash().alias("hash"), "id", utc_time(F.col("created_at")).alias("t")).where("hash is not null")
    return active.groupBy("hash").agg(F.max_by("id", F.struct("t", "id")).alias("existing_id"))


def mode_of(mode: object) -> str:
    """'off', 'observe' or 'enforce', in any letter case; a truth value that settings made of 'on' is 'observe'; anything else is 'off'."""
    if mode is True:
        return "observe"
    text = str(mode).strip().lower()
    return text if text in MODES else "off"


def gate_enqueue(episodes: DataFrame, incoming: DataFrame, mode: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(episodes to append, ledger rows) for incoming (id, payload_json, claimed_by, seq); seq is the order of arrival.

    off: all are kept, nothing is looked for. observe: all are kept, duplicates are recorded as detected. enforce: only
    the first of a hash is kept, and only if none is active; the others are recorded as rejected.
    """
    mode = mode_of(mode)
    new = incoming.withColumn("canonical_hash", canonical_hash(F.col("payload_json")))
    first = new.where(F.col("canonical_hash").isNotNull()).groupBy("canonical_hash").agg(F.min_by("id", F.struct("seq", "id")).alias("_first"))
    known = first.join(active_holders(episodes).withColumnRenamed("hash", "canonical_hash"), "canonical_hash", "left")
    judged = spread_join(new, known, "canonical_hash", "left")
    existing = F.coalesce("existing_id", F.when(F.col("_first") != F.col("id"), F.col("_first")))
    judged = judged.withColumn("existing_id", existing if mode != "off" else F.lit(None).cast("string"))
    kept = judged if mode != "enforce" else judged.where(F.col("existing_id").isNull())
    rows = kept.select(
        "id", F.lit("queued").alias("status"), "payload_json", F.lit(now).alias("enqueued_at"), F.lit(0).cast("long").alias("attempt_count"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
        F.when(F.lit(mode != "off"), F.col("canonical_hash")).alias("payload_hash"), "claimed_by", "canonical_hash", F.lit(mode).alias("dedup_gate"),
    )
    ledger = judged.where(F.col("existing_id").isNotNull()).select(
        F.lit(now).alias("detected_at"), F.lit(mode).alias("mode"), F.lit("rejected" if mode == "enforce" else "detected").alias("action"), F.col("canonical_hash").alias("payload_hash"), F.col("existing_id").alias("existing_episode_id"), F.col("id").alias("duplicate_episode_id"), F.col("claimed_by").alias("writer")
    )
    return rows, ledger


def daemon_enqueue(episodes: DataFrame, incoming: DataFrame, mode: str, now: str, lock_mode: str | None = None, writer: str = "daemon") -> tuple[DataFrame, DataFrame]:
    """gate_enqueue for one writer, whose name every row gets; refused while the lock is kept for the other writers."""
    if lock_mode == LOCKED:
        raise PermissionError(f"lock mode {LOCKED}: this writer may not enqueue")
    return gate_enqueue(episodes, incoming.withColumn("claimed_by", F.lit(writer)), mode, now)


# lookups


def looked_up(episodes: DataFrame, ident: str) -> DataFrame:
    """The row of an id with its payload's fields as a map of texts; an unreadable payload, or one that is no object, is an empty map."""
    fields = F.try_parse_json("payload_json").try_cast("map<string,string>")
    return episodes.where(F.col("id") == ident).withColumn("payload", F.coalesce(fields, F.create_map().cast("map<string,string>"))).drop("payload_json")


def letters_where(dead: DataFrame, open_only: bool | None = None, classes: list[str] | None = None) -> DataFrame:
    """Dead letters: all, only the open, or (False) only the recovered ones; of the classes if any are named."""
    rows = dead if open_only is None else dead.where(F.col("recovered_at").isNull() if open_only else F.col("recovered_at").isNotNull())
    return rows.where(in_classes(F.col("last_error"), classes)) if classes else rows


def ledger_recent(ledger: DataFrame, limit: int = 20) -> DataFrame:
    """The latest ledger rows, newest first; equal times go by the duplicate's id."""
    return first_by_time(ledger, "detected_at", "duplicate_episode_id", limit, True)


# picks


def first_by_time(rows: DataFrame, time: str, key: str, limit: int, newest: bool = False) -> DataFrame:
    """The ``limit`` rows of the earliest (or latest) time; unreadable times come first (or last), ids break ties."""
    t = utc_time(F.col(time))
    return rows.orderBy(t.desc_nulls_last() if newest else t.asc_nulls_first(), key).limit(limit)


def claim_batch(episodes: DataFrame, limit: int | None = None) -> DataFrame:
    """The queued rows that are next; no limit or one of 0 means 20."""
    return first_by_time(episodes.where("status = 'queued'"), "enqueued_at", "id", limit if limit and limit > 0 else 20)


def open_letters(dead: DataFrame) -> DataFrame:
    """Dead letters that aren't recovered."""
    return dead.where(F.col("recovered_at").isNull())


def reap_candidates(episodes: DataFrame, dead: DataFrame, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """Failed and aborted rows that may run again; a failed row with an open dead letter is left to the replay."""
    may = episodes.where(F.col("status").isin("failed", "aborted") & retryable(F.col("last_error"), policy))
    if policy.respect_ceiling:
        may = may.where(F.col("attempt_count") < policy.max_attempts)
    owned = open_letters(dead).select(F.col("episode_id").alias("id"), F.lit("failed").alias("status")).distinct()
    return may.join(owned, ["id", "status"], "left_anti")


def free_to_activate(wanting: DataFrame, episodes: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of ``wanting`` whose enforced canonical hash no active row holds, the first of each hash in ``order``; rows without one are free."""
    guarded = (F.col("dedup_gate") == "enforce") & F.col("canonical_hash").isNotNull()
    guarded = F.coalesce(guarded, F.lit(False))
    held = episodes.where(guarded & F.col("status").isin(ACTIVE)).select("canonical_hash", "id").withColumnRenamed("id", "_holder")
    others = held.groupBy("canonical_hash").agg(F.min("_holder").alias("_lo"), F.max("_holder").alias("_hi"))
    joined = wanting.join(others, "canonical_hash", "left")
    # a row doesn't stand in its own way
    other = F.col("_lo").isNotNull() & ((F.col("_lo") != F.col("id")) | (F.col("_hi") != F.col("id")))
    free = joined.withColumn("_taken", guarded & other)
    # rows that need no rank are partitions of their own: no task gets all rows without a hash
    alone = F.concat(F.lit("id "), F.coalesce("id", F.lit("")))
    rank = F.row_number().over(Window.partitionBy(F.when(guarded & ~F.col("_taken"), F.concat(F.lit("hash "), "canonical_hash")).otherwise(alone)).orderBy(*order))
    return free.withColumn("_rank", rank).where(~guarded | (~F.col("_taken") & (F.col("_rank") == 1))).select(*wanting.columns)


# transitions


def reap_failed(episodes: DataFrame, dead: DataFrame, now: str, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """The rows that are queued again: oldest update first, up to the policy's limit; attempts stay."""
    picked = first_by_time(reap_candidates(episodes, dead, policy), "updated_at", "id", max(policy.reap_limit, 0))
    free = free_to_activate(picked, episodes, [utc_time(F.col("updated_at")).asc_nulls_first(), F.col("id")])
    return free.withColumns({"status": F.lit("queued"), "consecutive_failures": F.lit(0).cast("long"), "enqueued_at": F.lit(now), "updated_at": F.lit(now)})


def reap_stuck(episodes: DataFrame, now: str, timeout_sec: int = 900, max_attempts: int = 3) -> DataFrame:
    """New rows of processing episodes older than the timeout: aborted at the last attempt, else queued, or skipped if the payload is active elsewhere."""
    started = F.col("started_at")
    age = F.unix_micros(utc_time(F.lit(now))) - F.unix_micros(utc_time(started))
    old = F.coalesce(age >= timeout_sec * 1_000_000, F.lit(True))
    stuck = episodes.where((F.col("status") == "processing") & started.isNotNull() & (started != "") & old)
    attempts = F.col("attempt_count") + 1
    last = F.coalesce(attempts >= max_attempts, F.lit(False))
    aborted = stuck.where(last).withColumns({"status": F.lit("aborted"), "last_error": F.lit(STUCK_ERROR)})
    again = stuck.where(~last)
    # a stuck row is itself active: only other rows stand in its way
    free = free_to_activate(again, episodes, [F.col("id")]).withColumns({"status": F.lit("queued"), "consecutive_failures": F.lit(0).cast("long"), "enqueued_at": F.lit(now)})
    held = again.join(free.select("id"), "id", "left_anti").select(*episodes.columns).withColumns({"status": F.lit(SKIPPED), "last_error": F.lit(HELD_ERROR)})
    counted = [d.withColumns({"attempt_count": attempts, "updated_at": F.lit(now)}) for d in (aborted, free)]
    return counted[0].unionByName(counted[1]).unionByName(held.withColumn("updated_at", F.lit(now)))


def replay_candidates(dead: DataFrame, now: str, classes: list[str] | None = None, min_age_sec: int = 0, policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """Open dead letters that may be replayed: of the classes (as patterns), old enough to the second, not permanent."""
    may = open_letters(dead).where(retryable(F.col("last_error"), policy))
    if classes:
        may = may.where(like_classes(F.col("last_error"), classes))
    if min_age_sec > 0:
        may = may.where(F.unix_seconds(utc_time(F.col("failed_at"))) <= F.unix_seconds(utc_time(F.lit(now))) - min_age_sec)
    return may


def replay_batch(episodes: DataFrame, dead: DataFrame, now: str, limit: int = 50, classes: list[str] | None = None, min_age_sec: int = 0, policy: RetryPolicy = RetryPolicy()) -> tuple[DataFrame, DataFrame]:
    """(new episode rows, closed letters): picked letters put their episode back in the queue unless it is done or its payload is active.

    Letters of done or absent episodes are only closed; letters of held payloads stay open.
    """
    picked = first_by_time(replay_candidates(dead, now, classes, min_age_sec, policy), "failed_at", "episode_id", limit)
    wanted = episodes.join(picked.select(F.col("episode_id").alias("id"), F.col("failed_at").alias("_failed")), "id").where(F.coalesce(F.col("status") != "done", F.lit(True)))
    free = free_to_activate(wanted, episodes, [utc_time(F.col("_failed")).asc_nulls_first(), F.col("id")]).drop("_failed")
    queued = free.select(*episodes.columns).withColumns({"status": F.lit("queued"), "attempt_count": F.lit(0).cast("long"), "last_error": F.lit(None).cast("string"), "enqueued_at": F.lit(now), "updated_at": F.lit(now), "last_replay_at": F.lit(now)})
    stay = wanted.join(free.select("id"), "id", "left_anti").select(F.col("id").alias("episode_id"))
    closed = picked.join(stay, "episode_id", "left_anti").select(*dead.columns).withColumns({"recovered_at": F.lit(now), "recovered_attempts": F.col("attempt_count")})
    return queued, closed


def replay_one(episodes: DataFrame, dead: DataFrame, ident: str, now: str, policy: RetryPolicy = RetryPolicy()) -> tuple[DataFrame, DataFrame]:
    """(new episode row, closed letter) of one letter replayed by hand: none if it is unknown, permanent, or its payload is active.

    Neither a letter that is closed already nor an episode that is done stops it; attempts start again at 0.
    """
    letter = dead.where((F.col("episode_id") == ident) & retryable(F.col("last_error"), policy))
    wanted = episodes.where(F.col("id") == ident).join(letter.select(F.col("episode_id").alias("id")), "id", "left_semi").select(*episodes.columns)
    free = free_to_activate(wanted, episodes, [F.col("id")])
    queued = free.withColumns({"status": F.lit("queued"), "attempt_count": F.lit(0).cast("long"), "last_error": F.lit(None).cast("string"), "enqueued_at": F.lit(now), "updated_at": F.lit(now), "last_replay_at": F.lit(now)})
    closed = letter.join(free.select(F.col("id").alias("episode_id")), "episode_id", "left_semi").select(*dead.columns).withColumns({"recovered_at": F.lit(now), "recovered_attempts": F.col("attempt_count")})
    return queued, closed


def checkpointed(rows: DataFrame, text: Column, now: str) -> DataFrame:
    """Rows with their checkpoint text set."""
    return rows.withColumns({"checkpoint": text, "updated_at": F.lit(now)})


def mark_done(rows: DataFrame, dead: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(done rows, closed letters) of finished episodes."""
    done = rows.withColumns({"status": F.lit("done"), "consecutive_failures": F.lit(0).cast("long"), "last_error": F.lit(None).cast("string"), "finished_at": F.lit(now), "updated_at": F.lit(now)})
    closed = open_letters(dead).join(rows.select(F.col("id").alias("episode_id")), "episode_id", "left_semi").withColumns({"recovered_at": F.lit(now), "recovered_attempts": F.col("attempt_count")})
    return done, closed


def mark_failed(rows: DataFrame, error: Column, now: str) -> DataFrame:
    """Failed rows, attempts and streak one up."""
    return rows.withColumns({"status": F.lit("failed"), "attempt_count": F.col("attempt_count") + 1, "consecutive_failures": F.coalesce("consecutive_failures", F.lit(0)) + 1, "last_error": error, "updated_at": F.lit(now)})


def mark_aborted(rows: DataFrame, error: Column, now: str) -> tuple[DataFrame, DataFrame]:
    """(aborted rows, their new open letters)."""
    aborted = rows.withColumns({"status": F.lit("aborted"), "attempt_count": F.col("attempt_count") + 1, "last_error": error, "updated_at": F.lit(now)})
    letters = aborted.select(F.col("id").alias("episode_id"), "payload_json", "last_error", "attempt_count", F.lit(now).alias("failed_at"), F.lit(None).cast("string").alias("recovered_at"), F.lit(None).cast("long").alias("recovered_attempts"))
    return aborted, letters


def replaced(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of the same key taken from ``new``, and new keys added."""
    return rows.join(new.select(key), key, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


# statistics


def status_counts(episodes: DataFrame, dead: DataFrame) -> DataFrame:
    """Rows by status, and the open dead letters under 'dlq' (not a status: don't sum)."""
    return episodes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).unionByName(open_letters(dead).agg(F.count(F.lit(1)).alias("n")).select(F.lit("dlq").alias("status"), "n"))


def dedup_stats(episodes: DataFrame, ledger_hits: int = 0) -> DataFrame:
    """One row: hashed rows, canonical rows, active groups of equal payload_hash, skipped rows, ledger hits."""
    groups = episodes.where(F.col("payload_hash").isNotNull() & F.col("status").isin(ACTIVE)).groupBy("payload_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("active_duplicates"))
    rows = episodes.agg(F.count("payload_hash").alias("hashed_rows"), F.count("canonical_hash").alias("canonical_rows"), F.count_if(F.col("status") == SKIPPED).alias("backstop_skips"))
    return rows.join(F.broadcast(groups)).withColumn("observed_hits", F.lit(ledger_hits).cast("long"))  # one row each


def adapter_stats(episodes: DataFrame, dead: DataFrame) -> DataFrame:
    """(part, name, n): rows by status, open letters, and active rows that a writer has claimed."""
    by_status = episodes.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("by_status").alias("part"), "name", "n")
    one = lambda rows, part: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), F.lit(None).cast("string").alias("name"), "n")
    claimed = episodes.where(F.col("status").isin(ACTIVE) & F.col("claimed_by").isNotNull())
    return by_status.unionByName(one(open_letters(dead), "dlq_open")).unionByName(one(claimed, "claimed_active"))


def reap_fairness(episodes: DataFrame, max_attempts: int = 3) -> DataFrame:
    """One row on all failed and aborted episodes: how many, exhausted, replayed before, their rate, oldest and newest."""
    t = utc_time(F.col("enqueued_at"))
    rows = episodes.where(F.col("status").isin("failed", "aborted")).agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("attempt_count") >= max_attempts).alias("exhausted"), F.count_if(F.col("last_replay_at").isNotNull()).alias("repeated_turns"), F.min(t).alias("oldest"), F.max(t).alias("newest")
    )
    return rows.withColumn("repeat_rate", F.when(F.col("eligible") > 0, F.bround(F.col("repeated_turns") / F.col("eligible"), 4)).otherwise(F.lit(0.0)))


def class_counts(dead: DataFrame, classes: list[str]) -> DataFrame:
    """Open letters by class, 0 where there is none; a letter may count in several classes."""
    hits = open_letters(dead).agg(*[F.count_if(in_classes(F.col("last_error"), [c])).alias(f"c{i}") for i, c in enumerate(classes)])
    return hits.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"c{i}").alias("n")) for i, c in enumerate(classes)])).alias("x")).select("x.class", "x.n")


def breakdown(dead: DataFrame, classes: list[str]) -> DataFrame:
    """One row: open letters, those of any class, those of none."""
    rows = open_letters(dead).agg(F.count(F.lit(1)).alias("open"), F.count_if(in_classes(F.col("last_error"), classes)).alias("classified"))
    return rows.withColumn("unclassified", F.greatest(F.col("open") - F.col("classified"), F.lit(0)))


def backstop(candidates: DataFrame, episodes: DataFrame) -> DataFrame:
    """Candidates whose hash is already done under another id: they are skipped."""
    done = episodes.where("status = 'done'").select(held_hash().alias("_h"), "id").where("_h is not null").groupBy("_h").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    return candidates.withColumn("_h", held_hash()).join(done, "_h").where((F.col("_lo") != F.col("id")) | (F.col("_hi") != F.col("id"))).select(*candidates.columns)
