"""Readers for nested and dirty evaluation data. Labels never share a table with model inputs.

Every reader is a file scan plus a normaliser over the scanned DataFrame, so the same rules also apply to tables.
Rejected rows come back with a reason instead of stopping the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import trimmed
from ..plans.session import cut_lineage
from ..plans.split import number_rows, ranges_of

#: Bytes up to which a file is read as one value.
WHOLE = 64 << 20
#: Files whose lines are hashed together.
RANGE = 65_536

TURN = "struct<role:string,content:string>"
SCENARIO = ("scenario_ref string, query string, expected_output string, query_outcome string, "
            "history array<struct<situation:string,agent_act:string,outcome:string>>, _corrupt_record string")
PROBE_SET = ("persona_text string, patterns array<struct<pattern_ref:string, target_behavior:string, oracle_disposition:string, "
             "anti_disposition:string, history_sessions:array<struct<session_ref:string,situation:string,agent_act:string,outcome:string>>, "
             "probes:array<struct<instance_ref:string,current_request:string>>>>")


def _blank(c: str | Column) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


# --- nested sessions ------------------------------------------------------------------------------

def nested_sessions(df: DataFrame, sessions: int | None = None, types: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Instances, sessions, messages, labels and rejects.

    Input: persona_id, instance_type, current_request, current_contextual_preference, current_checklist (array),
    prior_interactions (array of structs with ``dialogue``, an array of role and content).
    """
    ref = F.concat(F.lit("instance_"), F.substring(F.sha2(F.concat_ws(":", "persona_id", "instance_type"), 256), 1, 24))
    rows = df.withColumn("instance_ref", ref)
    copies = rows.groupBy("instance_ref").agg(F.count(F.lit(1)).alias("__copies"))
    per = rows.groupBy("persona_id").agg(F.count_distinct("instance_type").alias("__types"))
    marked = rows.join(copies, "instance_ref").join(per, "persona_id")
    reason = F.when(_blank("current_request") | _blank("current_contextual_preference"), "blank").when(
        F.size("current_checklist") == 0, "checklist").when(F.col("__copies") > 1, "duplicate")
    if sessions is not None:
        reason = reason.when(F.size("prior_interactions") != sessions, "sessions")
    if types is not None:
        reason = reason.when(~F.col("instance_type").isin(*types) | (F.col("__types") != len(types)), "types")
    marked = marked.withColumn("reason", reason)
    good = marked.filter("reason IS NULL")
    opened = good.select("instance_ref", F.posexplode("prior_interactions").alias("session_no", "session"))
    return {
        "instances": good.select("instance_ref", "persona_id", "current_request"),
        "sessions": opened.select("instance_ref", "session_no", F.size("session.dialogue").alias("messages")),
        "messages": opened.select("instance_ref", "session_no", F.posexplode("session.dialogue").alias("turn", "m")).select(
            "instance_ref", "session_no", "turn", "m.role", F.col("m.content").alias("text")),
        "labels": good.select("instance_ref", "persona_id", "instance_type",
                              F.col("current_contextual_preference").alias("preference"), F.col("current_checklist").alias("checklist")),
        "rejects": marked.filter("reason IS NOT NULL").select("instance_ref", "persona_id", "instance_type", "reason"),
    }


def read_nested_sessions(spark: SparkSession, path: str, **rules) -> dict[str, DataFrame]:
    return nested_sessions(spark.read.parquet(path), **rules)


# --- question tables ------------------------------------------------------------------------------

QUESTION_LABELS = ("pref_type", "who", "updated", "sensitive_info", "topic_query")


def questions(df: DataFrame, size: str = "32k") -> dict[str, DataFrame]:
    """Questions, labels and rejects from raw CSV columns; ``row_no`` gives the reference ``row-00000``.

    The user query is JSON or a Python literal in single quotes; both are read as JSON, the literal leniently.
    """
    loose = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    query = F.from_json("user_query", TURN, loose)
    wrong = F.from_json("incorrect_answers", "array<string>")
    rows = df.withColumn("__q", query).withColumn("__w", wrong).withColumn(
        "question_ref", F.concat(F.lit("row-"), F.lpad(F.col("row_no").cast("string"), 5, "0")))
    distance = F.expr(f"try_cast(distance_from_related_snippet_to_query_{size} AS INT)")
    answers = F.concat(F.array("correct_answer"), F.col("__w"))
    reason = F.when(F.col("__q.role").isNull() | (F.col("__q.role") != "user") | _blank("__q.content"), "query").when(
        F.col("__w").isNull() | (F.size("__w") != 3), "distractors").when(
        F.exists(answers, lambda a: F.coalesce(trimmed(a), F.lit("")) == "") | (F.size(F.array_distinct(answers)) != 4), "answers").when(
        _blank("persona_id") | _blank(f"chat_history_{size}_link"), "identity").when(distance.isNull(), "distance")
    marked = rows.withColumn("reason", reason)
    good = marked.filter("reason IS NULL")
    return {
        "questions": good.select("question_ref", "persona_id", F.col(f"chat_history_{size}_link").alias("history"), F.col("__q.content").alias("query"),
                                 answers.alias("answers"), *[F.coalesce(c, F.lit("")).alias(c) for c in QUESTION_LABELS], distance.alias("distance_tokens")),
        "rejects": marked.filter("reason IS NOT NULL").select("question_ref", "reason"),
    }


def read_questions(spark: SparkSession, path: str, size: str = "32k", row_no: str = "row_no") -> dict[str, DataFrame]:
    """CSV with embedded JSON. The file must carry its row number, because a split file has no line order."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return questions(raw.withColumn("row_no", F.col(row_no).cast("bigint")), size)


# --- timelines --------------------------------------------------------------------------------------

def timeline(dialogues: DataFrame, entries: DataFrame, probes: DataFrame) -> dict[str, DataFrame]:
    """Dated sessions, ordered probes, labels and rejects.

    ``dialogues``: persona_id, task_id, conversation. ``entries``: persona_id, place, task_id, date. ``probes``:
    persona_id, task_id, stage, question_date, question, options, gold_label.
    """
    key = ["persona_id", "task_id"]
    twice = lambda df, what: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key, F.lit(what).alias("reason"))
    once = dialogues.join(twice(dialogues, "x").select(*key), key, "left_anti")
    listed = entries.join(twice(entries, "x").select(*key), key, "left_anti")
    missing = listed.join(dialogues.select(*key), key, "left_anti").select(*key, F.lit("no_dialogue").alias("reason"))
    undated = listed.filter("try_to_date(date) IS NULL").select(*key, F.lit("date").alias("reason"))
    sessions = listed.withColumn("occurred_on", F.expr("try_to_date(date)")).filter("occurred_on IS NOT NULL").join(once, key).select(
        *key, "place", "occurred_on", "conversation")
    asked = probes.withColumn("question_ref", F.concat_ws(":", "persona_id", "task_id", "stage")).withColumn("asked_on", F.expr("try_to_date(question_date)"))
    return {
        "sessions": sessions,
        "probes": asked.filter("asked_on IS NOT NULL").select("question_ref", "persona_id", "task_id", "stage", "asked_on", "question", "options"),
        "labels": asked.select("question_ref", "gold_label"),
        "rejects": twice(dialogues, "duplicate_dialogue").unionByName(twice(entries, "duplicate_entry")).unionByName(missing).unionByName(undated),
    }


# --- scenarios --------------------------------------------------------------------------------------

def scenarios(df: DataFrame) -> dict[str, DataFrame]:
    """Scenarios, their history turns and rejects."""
    copies = df.filter("scenario_ref IS NOT NULL").groupBy("scenario_ref").agg(F.count(F.lit(1)).alias("__copies"))
    bad_turn = F.exists("history", lambda t: _blank(t["situation"]) | _blank(t["agent_act"]) | (t["outcome"].isNotNull() & _blank(t["outcome"])))
    corrupt = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in df.columns else F.lit(False)
    marked = df.join(copies, "scenario_ref", "left").withColumn("reason", F.when(corrupt, "json").when(
        _blank("scenario_ref") | _blank("query") | _blank("expected_output"), "blank").when(
        F.col("history").isNull(), "history").when(bad_turn, "turn").when(
        F.col("query_outcome").isNotNull() & _blank("query_outcome"), "query_outcome").when(F.col("__copies") > 1, "duplicate"))
    good = marked.filter("reason IS NULL")
    return {
        "scenarios": good.select("scenario_ref", trimmed("query").alias("query"), trimmed("expected_output").alias("expected_output"), trimmed("query_outcome").alias("query_outcome")),
        "turns": good.select("scenario_ref", F.posexplode("history").alias("turn", "t")).select(
            "scenario_ref", "turn", trimmed("t.situation").alias("situation"), trimmed("t.agent_act").alias("agent_act"), trimmed("t.outcome").alias("outcome")),
        "rejects": marked.filter("reason IS NOT NULL").select("scenario_ref", "reason"),
    }


def read_scenarios(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return scenarios(spark.read.schema(SCENARIO).json(path))


# --- probe sets ---------------------------------------------------------------------------------------

def probe_sets(df: DataFrame) -> dict[str, DataFrame]:
    """Sessions, probes (model inputs), labels, leaks and rejects of pattern files."""
    p = df.select("persona_text", F.explode("patterns").alias("p")).select("persona_text", "p.*")
    copies = p.groupBy("pattern_ref").agg(F.count(F.lit(1)).alias("__copies"))
    refs_of = F.transform("history_sessions", lambda s: s["session_ref"])
    reason = F.when(_blank("pattern_ref") | _blank("target_behavior") | _blank("oracle_disposition") | _blank("anti_disposition"), "blank").when(
        F.col("__copies") > 1, "duplicate_pattern").when(F.col("oracle_disposition") == F.col("anti_disposition"), "same_disposition").when(
        F.size(F.array_distinct(refs_of)) != F.size(refs_of), "duplicate_session").when(
        F.exists("history_sessions", lambda s: _blank(s["situation"]) | _blank(s["agent_act"]) | _blank(s["outcome"])), "session")
    marked = p.join(copies, "pattern_ref", "left").withColumn("reason", reason)
    good = marked.filter("reason IS NULL")
    asked = good.select("pattern_ref", "persona_text", "target_behavior", "oracle_disposition", "anti_disposition", F.explode("probes").alias("x")).select(
        "*", "x.instance_ref", "x.current_request").drop("x")
    secrets = F.array("target_behavior", "oracle_disposition", "anti_disposition")
    text = F.concat("persona_text", F.lit("\n"), "current_request")
    return {
        "sessions": good.select("pattern_ref", F.explode("history_sessions").alias("s")).select("pattern_ref", "s.*"),
        "probes": asked.select("instance_ref", "pattern_ref", "persona_text", "current_request"),
        "labels": asked.select("instance_ref", "target_behavior", "oracle_disposition", "anti_disposition"),
        "leaks": asked.filter(F.exists(secrets, lambda s: F.contains(text, s))).select("instance_ref"),
        "rejects": marked.filter("reason IS NOT NULL").select("pattern_ref", "reason"),
    }


def read_probe_sets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return probe_sets(spark.read.schema(PROBE_SET).json(path, multiLine=True))


# --- files --------------------------------------------------------------------------------------------

def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file by blocks of 4 MB; ``path``: a URI that Arrow opens."""
    for b in batches:
        digests = []
        for uri in b.column("uri").to_pylist():
            # Spark gives file:/a, and encodes some characters only
            uri = quote(uri if "://" in uri else uri.replace(":/", ":///", 1), safe="%/:?#[]@!$&'()*+,;=~")
            store, path = pafs.FileSystem.from_uri(uri)
            digest = hashlib.sha256()
            with store.open_input_stream(path, compression=None) as file:
                while block := file.read(4 << 20):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.record_batch({"path": b.column("path"), "length": b.column("length"), "sha256": pa.array(digests, pa.string())})


def file_manifest(spark: SparkSession, path: str, glob: str = "*", whole: int = WHOLE) -> DataFrame:
    """Path below ``path``, size and SHA-256 of every file.

    Files of up to ``whole`` bytes are read by Spark as one value. Larger ones, of any size, are listed without their content and
    read in blocks through Arrow's file systems (local, HDFS, S3, GCS), a file in a task; a store that only Spark opens refuses them.
    Spark lists no empty files.
    """
    files = lambda: spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    # the filter reaches the reader, which opens no file beyond it
    small = files().filter(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files().filter(F.col("length") > whole).select("path", "length", F.col("_metadata.file_path").alias("uri"))
    listed = small.unionByName(large.repartition("path").mapInArrow(_streamed, "path string, length long, sha256 string"))
    root = path.rstrip("/").split("://")[-1].lstrip("/")
    below = F.substring_index(F.col("path"), f"{root}/", -1)
    return listed.select(below.alias("name"), "length", "sha256")


def cohort_digest(manifest: DataFrame, width: int = RANGE) -> DataFrame:
    """One row: files, bytes and a digest of the manifest's names and hashes in order of names (a line for each file).

    Up to ``width`` files: SHA-256 of their lines. More: SHA-256 of the hashes, a line each, of ranges of ``width`` files, so that no
    more than the lines of a range and one hash for each range meet.
    """
    m = cut_lineage(manifest.select("name", "length", "sha256"))
    # names are cut into blocks by quantiles of their order, so that none holds all of them
    total = m.count()
    cuts = [r["name"] for r in m.sample(min(1.0, 64 * (total // width + 1) / max(total, 1)), 0).sort("name").collect()][32::64] if total > width else []
    block = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0).cast("long"), lambda n, c: n + (F.col("name") >= c).cast("long")) if cuts else F.lit(0).cast("long")
    placed = number_rows(m.withColumn("of", F.lit(0)), ["of"], ["name", "sha256"], block, "at")
    line = F.struct("at", F.concat_ws("  ", "sha256", "name").alias("line"))
    joined = lambda x: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda v: v["line"]), "\n"), 256)
    ranges = placed.groupBy(ranges_of(F.col("at") - 1, width).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), joined(line).alias("line"))
    whole = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("many"), F.min("line").alias("one"), joined(F.struct("at", "line")).alias("all"))
    return whole.select("files", "bytes", F.when(F.col("many") == 1, F.col("one")).otherwise(F.col("all")).alias("digest"))


def verify_manifest(actual: DataFrame, frozen: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a frozen list."""
    a = actual.select("name", F.col("sha256").alias("now"))
    f = frozen.select("name", F.col("sha256").alias("then"))
    return a.join(f, "name", "full_outer").withColumn("problem", F.when(F.col("now").isNull(), "missing").when(
        F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed")).filter("problem IS NOT NULL").select("name", "problem")


def write_results(df: DataFrame, path: str) -> None:
    """One JSON line per row."""
    df.write.mode("errorifexists").json(path)


def write_state(df: DataFrame, path: str) -> None:
    """Exported memory state, one folder per tenant."""
    df.write.mode("errorifexists").partitionBy("tenant_ref").parquet(path)


# --- rendering of evaluation inputs -------------------------------------------------------------------

def oracle_documents(messages: DataFrame, key: str = "question_ref") -> DataFrame:
    """Evidence messages of a question as documents: a user message takes the assistant message after it.

    ``messages``: key, idx (from 0), role, text. Neighbours are joined by index, so no question is sorted in one task.
    """
    m = messages.select(key, "idx", "role", "text")
    after = m.select(key, (F.col("idx") - 1).alias("idx"), F.col("role").alias("next_role"), F.col("text").alias("next_text"))
    before = m.select(key, (F.col("idx") + 1).alias("idx"), F.col("role").alias("prev_role"))
    both = m.join(after, [key, "idx"], "left").join(before, [key, "idx"], "left")
    answered = (F.col("role") == "user") & (F.col("next_role") == "assistant")
    first = F.when(F.col("role") == "user", F.concat(F.lit("SITUATION [user]\n"), "text")).otherwise(F.concat(F.lit("AGENT_ACT [agent]\n"), "text"))
    parts = F.when(answered, F.array(first, F.concat(F.lit("AGENT_ACT [agent]\n"), "next_text"))).otherwise(F.array(first))
    taken = (F.col("role") == "assistant") & F.coalesce(F.col("prev_role") == "user", F.lit(False))
    rows = both.filter(~taken).withColumn("parts", parts).withColumn("at", F.when(answered, F.col("idx") + 1).otherwise(F.col("idx")))
    digest = F.substring(F.sha2(F.concat_ws(":", F.col(key), F.col("at").cast("string"), F.array_join("parts", "|")), 256), 1, 16)
    return rows.select(key, "idx", F.concat(F.lit("oracle:"), digest).alias("document_ref"), F.array_join("parts", "\n").alias("text"))


CARD = ("id string, domain string, archetype string, core struct<name:string,pronouns:string,role:string,style:array<string>,"
        "values:array<string>,boundaries:array<string>>, mutable_seed map<string,string>")


def persona_card(json_text: str | Column) -> Column:
    """Tagged text of a persona card; mutable keys sorted, lists joined by `` | ``."""
    c = F.from_json(F.col(json_text) if isinstance(json_text, str) else json_text, CARD)
    line = lambda name, v: F.concat(F.lit(name + " "), v)
    items = lambda name, v: F.concat(F.lit("\n" + name + "\n"), F.array_join(F.transform(v, lambda x: F.concat(F.lit("- "), x)), "\n"))
    # a list value arrives as its JSON text
    listed = lambda v: F.from_json(v, "array<string>")
    value = lambda v: F.when(v.startswith("["), F.when(F.size(listed(v)) == 0, "NONE").otherwise(F.array_join(listed(v), " | "))).otherwise(v)
    state = F.array_join(F.transform(F.array_sort(F.map_entries(c["mutable_seed"])), lambda e: F.concat(e["key"], F.lit(": "), value(e["value"]))), "\n")
    core = c["core"]
    return F.concat_ws("\n", line("PERSONA_ID", c["id"]), line("DOMAIN", c["domain"]), line("ARCHETYPE", c["archetype"]), line("NAME", core["name"]),
                       line("PRONOUNS", core["pronouns"]), line("ROLE", core["role"]), items("STYLE", core["style"]), items("VALUES", core["values"]),
                       items("BOUNDARIES", core["boundaries"]), F.concat(F.lit("\nMUTABLE_STATE\n"), state))
