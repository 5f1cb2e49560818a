"""Model outputs to validated changes and new memory versions."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import refs
from ..functions.text import trimmed
from ..plans.session import cut_lineage
from .intake import SCOPE, stable_tight

OWNER = list(refs.OWNER)

# Fixed values of the output grammar.
NEW_TARGETS = ("NEW_RECOLLECTION", "NEW_DISPOSITION")
APPLICATIONS = ("SELF", "OTHER", "RELATION", "SITUATION")
WORDS = ("TARGET", "APPLICATION", "CHANGE", "BASIS", "NEW", *NEW_TARGETS)
MAX_OUTPUT_BYTES = 64 * 1024
MAX_TEXT_BYTES = 4 * 1024

CHANGE_SCHEMA = ("window_ref string, change_no int, target string, application string, operation string, text string, "
                 "basis_refs array<string>, error string")


class _Refused(ValueError):
    pass


def _is_ref(text: str) -> bool:
    return bool(text) and not any(ch.isspace() or unicodedata.category(ch) == "Cc" for ch in text)


def _blocks(lines: list[str]) -> Iterator[list[str]]:
    """Cut trimmed lines into blocks: a new one starts at TARGET once the current block has its basis."""
    block: list[str] = []
    has_basis = False
    for line in lines:
        if line == "TARGET" and has_basis and block[-1] != "BASIS":
            yield block
            block, has_basis = [], False
        has_basis = has_basis or (line == "BASIS" and len(block) >= 6)
        block.append(line)
    if block:
        yield block


def _change(block: list[str]) -> tuple[str, str, str, str, list[str]]:
    if len(block) < 8 or (block[0], block[2], block[4]) != ("TARGET", "APPLICATION", "CHANGE"):
        raise _Refused("markers")
    target, application, line = block[1], block[3], block[5]
    if target not in NEW_TARGETS and (not _is_ref(target) or target == "NEW"):
        raise _Refused("target")
    if application not in APPLICATIONS:
        raise _Refused("application")
    operation, _, text = line.partition(" ")
    rest = block[6:]
    if line in ("TEXT", "ADAPT"):
        text, rest = rest[0], rest[1:]
    elif not (line in ("KEEP", "REENACT", "INHIBIT") or (operation in ("TEXT", "ADAPT") and text.strip())):
        raise _Refused("operation")
    text = text.strip()
    if len(text.encode()) > MAX_TEXT_BYTES:
        raise _Refused("text_too_long")
    if not rest or rest[0] != "BASIS":
        raise _Refused("markers")
    basis = rest[1:]
    if not basis:
        raise _Refused("no_basis")
    if any(not _is_ref(b) or b in WORDS for b in basis):
        raise _Refused("basis")
    if len(set(basis)) != len(basis):
        raise _Refused("duplicate_basis")
    return target, application, operation, text, basis


def parse_output(output: str) -> list[tuple[str, str, str, str, list[str]]]:
    """Changes of one tagged text; any mistake refuses the whole text."""
    if len(output.encode()) > MAX_OUTPUT_BYTES:
        raise _Refused("too_long")
    lines = [line.strip() for line in output.replace("\r\n", "\n").split("\n")]
    changes = [_change(block) for block in _blocks([line for line in lines if line])]
    known = [c[0] for c in changes if c[0] not in NEW_TARGETS]
    if len(set(known)) != len(known):
        raise _Refused("duplicate_target")
    return changes


def parse_outputs(outputs: DataFrame) -> DataFrame:
    """One row per change, or one row with ``error`` per refused output. ``outputs``: window_ref, output."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CHANGE_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for window, output in zip(batch["window_ref"], batch["output"]):
                try:
                    for number, (target, application, operation, text, basis) in enumerate(parse_output(output)):
                        rows.append((window, number, target, application, operation, text, basis, None))
                except _Refused as problem:
                    rows.append((window, None, None, None, None, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=columns).astype({"change_no": "Int32"})

    return outputs.select("window_ref", "output").mapInPandas(parse, CHANGE_SCHEMA)


def offered_audit(changes: DataFrame, targets: DataFrame, basis: DataFrame) -> DataFrame:
    """Targets and basis references that a change names although its window did not offer them.

    ``targets``/``basis``: window_ref, ref.
    """
    named = changes.filter("error IS NULL")
    t = named.select("window_ref", "change_no", F.col("target").alias("ref")).join(targets, ["window_ref", "ref"], "left_anti").withColumn("what", F.lit("target"))
    b = named.select("window_ref", "change_no", F.explode("basis_refs").alias("ref")).join(basis, ["window_ref", "ref"], "left_anti").withColumn("what", F.lit("basis"))
    return t.unionByName(b).select("window_ref", "change_no", "what", "ref")


def validate_changes(changes: DataFrame, windows: DataFrame, members: DataFrame, recollections: DataFrame, targets: DataFrame,
                     feedback: DataFrame, formation: DataFrame, adaptation: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """Adds ``valid`` per change and ``window_valid``: one bad change refuses its whole window.

    ``windows``: window_ref, scope_kind. ``members``: window_ref, episode_ref, origin (current or related).
    ``recollections``: window_ref, version_ref, application_scope (offered). ``targets``: window_ref, version_ref,
    target_kind (owner kind), same_owner. ``feedback``: window_ref, version_ref, ref, what (episode, anchor, outcome,
    direct), episode_ref (of an outcome). ``formation``/``adaptation``: eligibility per change. ``exact``: window_ref,
    basis (array) where a focused formation fixes the basis.
    """
    key = ["window_ref", "change_no"]
    good = changes.filter("error IS NULL")
    b = good.select(*key, "target", F.explode("basis_refs").alias("ref"))
    m = members.filter("origin IN ('current', 'related')").select(
        "window_ref", F.col("episode_ref").alias("ref"), (F.col("origin") == "current").alias("current")).groupBy("window_ref", "ref").agg(
        F.max("current").alias("current"))
    fb = feedback.select("window_ref", F.col("version_ref").alias("target"), "ref", "what", "episode_ref").groupBy("window_ref", "target", "ref").agg(
        F.max(F.col("what") == "episode").alias("f_episode"), F.max(F.col("what") == "anchor").alias("f_anchor"),
        F.max(F.col("what") == "direct").alias("f_direct"), F.max(F.when(F.col("what") == "outcome", F.col("episode_ref"))).alias("f_outcome"))
    no = F.lit(False)
    rows = b.join(m, ["window_ref", "ref"], "left").join(fb, ["window_ref", "target", "ref"], "left")
    known = F.col("current").isNotNull()
    fe, fa, fd = F.coalesce("f_episode", no), F.coalesce("f_anchor", no), F.coalesce("f_direct", no)
    fo = F.col("f_outcome").isNotNull() & ~fe & ~fa
    per = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ref").alias("nd"), F.min(stable_tight("ref")).alias("tight"),
        F.min(known).alias("all_known"), F.max(F.coalesce("current", no)).alias("has_current"),
        F.min(fe).alias("all_feedback"), F.max(fd).alias("has_direct"),
        F.min(known | fa).alias("known_or_anchor"),
        F.min(fe | fo).alias("plain_class"), F.min(fe | fa | F.col("f_outcome").isNotNull()).alias("anchor_class"),
        F.array_sort(F.collect_set(F.when(fe, F.col("ref")))).alias("cited"),
        F.array_sort(F.collect_set(F.when(fo, F.col("f_outcome")))).alias("answered"))
    r = recollections.select("window_ref", F.col("version_ref").alias("target"), F.col("application_scope").alias("r_app")).distinct()
    d = targets.select("window_ref", F.col("version_ref").alias("target"), "target_kind", "same_owner").distinct()
    has_feedback = feedback.filter("what = 'episode'").select("window_ref", F.col("version_ref").alias("target")).distinct().withColumn("open", F.lit(True))
    repeated = good.filter(~F.col("target").isin(*NEW_TARGETS)).groupBy("window_ref", "target").agg(F.count(F.lit(1)).alias("times"))
    full = (
        good.join(per, key, "left").join(windows.select("window_ref", "scope_kind"), "window_ref", "left")
        .join(r, ["window_ref", "target"], "left").join(d, ["window_ref", "target"], "left").join(has_feedback, ["window_ref", "target"], "left")
        .join(repeated, ["window_ref", "target"], "left")
        .join(formation.select(*key, F.col("eligible").alias("forms")), key, "left")
        .join(adaptation.select(*key, F.col("eligible").alias("adapts")), key, "left"))
    if exact is not None:
        full = full.join(exact.select("window_ref", F.col("basis").alias("fixed")), "window_ref", "left")
    else:
        full = full.withColumn("fixed", F.lit(None).cast("array<string>"))
    own = lambda kind: F.when(F.col(kind) == "agent", "SELF").otherwise("RELATION")
    text = trimmed("text") != ""
    op, app = F.col("operation"), F.col("application")
    matched = (F.size("cited") > 0) & (F.col("cited") == F.col("answered"))
    forms = F.when(op == "ADAPT", F.col("adapts")).otherwise(F.col("forms") & (F.col("fixed").isNull() | (F.col("fixed") == F.col("basis_refs"))))
    ok = (
        F.when(F.col("target") == "NEW_RECOLLECTION", (op == "TEXT") & text & F.col("all_known") & F.col("has_current"))
        .when(F.col("target") == "NEW_DISPOSITION", op.isin("TEXT", "ADAPT") & text & (app == own("scope_kind")) & forms & F.col("has_current"))
        .when(F.col("r_app").isNotNull(), (app == F.upper("r_app")) & F.col("all_known") & F.col("has_current")
              & ((op == "KEEP") | ((op == "TEXT") & text)))
        .when(F.col("target_kind").isNotNull(), (app == own("target_kind")) & (
            F.when(op == "ADAPT", (F.col("n") == 1) & F.col("same_owner") & text & F.col("has_direct")
                   & F.when(F.coalesce("open", no), F.col("known_or_anchor")).otherwise(F.col("all_known")))
            .when(op == "REENACT", F.col("all_feedback"))
            .when(op == "INHIBIT", F.col("plain_class") & matched)
            .when(op == "TEXT", F.col("anchor_class") & matched & text).otherwise(False)))
        .otherwise(False))
    unique = (F.col("n") == F.col("nd")) & F.col("tight") & (F.coalesce("times", F.lit(1)) == 1)
    judged = full.withColumn("valid", F.coalesce(ok & unique, no)).select(*good.columns, "valid")
    windows_ok = judged.groupBy("window_ref").agg(F.min("valid").alias("window_valid"))
    return judged.join(windows_ok, "window_ref")


_DECISIONS = "window_ref string, change_no int, applied boolean"


def _decide(frame: pd.DataFrame) -> pd.DataFrame:
    """Which formations and revisions of each window take effect, in order (a window is one bounded output).

    A text is taken while an active version of the owner holds it: one from before that this window has not
    replaced, or one that this window made.
    """
    replaced: dict[str | None, set[str]] = defaultdict(set)
    made: dict[str | None, set[tuple[str, str, str]]] = defaultdict(set)
    done = []
    for row in frame.sort_values("change_no").itertuples():
        gone, new = replaced[row.window_ref], made[row.window_ref]
        name = (row.kind, row.scope, row.new_text)
        holders = set(row.holders) - gone - {row.replaces}
        applied = not holders and name not in new and row.new_text != "" and row.new_text != row.old_text
        if applied:
            new.add(name)
            if row.replaces:
                gone.add(row.replaces)
                new.discard((row.kind, row.scope, row.old_text))
        done.append((row.window_ref, row.change_no, applied))
    return pd.DataFrame(done, columns=["window_ref", "change_no", "applied"])


def _decide_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_decide`` for many whole windows at once: a row holds the ``changes`` of one window."""
    schema = pa.schema([("window_ref", pa.string()), ("change_no", pa.int32()), ("applied", pa.bool_())])
    for batch in batches:
        rows = [{"window_ref": row["window_ref"], **change} for row in batch.to_pylist() for change in row["changes"]]
        if rows:
            yield pa.RecordBatch.from_pandas(_decide(pd.DataFrame(rows)), schema=schema, preserve_index=False)


def apply_changes(validated: DataFrame, windows: DataFrame, versions: DataFrame, basis: DataFrame, episodes: DataFrame,
                  outcome_episodes: DataFrame) -> dict[str, DataFrame]:
    """New versions, superseded versions, basis rows and index operations of all valid windows.

    ``windows``: owner columns, window_ref, job_ref; at most one window per owner and run (queue head), so
    windows are independent. ``versions``: kind, root_ref, version_ref, version_number, text, application_scope,
    status, owner. ``basis``: version_ref, episode_ref, role. ``episodes``: episode_ref, session_ref, run_ref.
    ``outcome_episodes``: outcome_ref. Only the order of equal texts inside one window needs a walk; the rest is joins.
    """
    key = ["window_ref", "change_no"]
    changes = cut_lineage(validated.filter("window_valid").join(windows, "window_ref"))
    active = versions.filter("status = 'active'")
    old = active.select("tenant_ref", F.col("version_ref").alias("target"), F.col("kind").alias("o_kind"), "root_ref", "version_number",
                        F.col("text").alias("old_text"), F.col("application_scope").alias("old_scope"),
                        *[F.col(c).alias("o_" + c) for c in OWNER[1:]])
    writes = changes.filter("operation IN ('TEXT', 'ADAPT')").join(old, ["tenant_ref", "target"], "left")
    kind = F.when(F.col("target") == "NEW_RECOLLECTION", "recollection").when(F.col("target") == "NEW_DISPOSITION", "disposition").otherwise(F.col("o_kind"))
    is_new = F.col("target").isin(*NEW_TARGETS)
    writes = writes.filter(is_new | F.col("o_kind").isNotNull()).withColumn("kind", kind).withColumn("new_text", trimmed("text")).withColumn(
        "application_scope", F.when(F.col("kind") == "disposition", F.when(F.col("application") == "SELF", "self").otherwise("relation")).when(
            is_new, F.lower("application")).otherwise(F.col("old_scope")))
    # a revision belongs to the target's owner, a formation to the window's
    writes = writes.withColumns({c: F.when(is_new, F.col(c)).otherwise(F.col("o_" + c)) for c in OWNER[1:]})
    writes = cut_lineage(writes)
    holders = active.select(*OWNER, "kind", F.col("application_scope").alias("application_scope"), F.col("text").alias("new_text"), "version_ref")
    held = writes.join(holders, [*OWNER, "kind", "application_scope", "new_text"]).groupBy(*key).agg(F.collect_set("version_ref").alias("holders"))
    asked = writes.join(held, key, "left").select(
        *key, "kind", F.concat_ws("/", *OWNER, "application_scope").alias("scope"), "new_text",
        F.coalesce("old_text", F.lit("")).alias("old_text"),
        F.when(F.col("target").isin(*NEW_TARGETS), "").otherwise(F.col("target")).alias("replaces"),
        F.coalesce("holders", F.array().cast("array<string>")).alias("holders"))
    # many windows a batch, decided once
    listed = asked.groupBy("window_ref").agg(F.collect_list(F.struct("change_no", "kind", "scope", "new_text", "old_text", "replaces", "holders")).alias("changes"))
    decided = cut_lineage(listed.mapInArrow(_decide_batches, _DECISIONS).filter("applied"))
    done = writes.join(decided, key)
    # cited outcomes are told from episodes by lookup
    cited = done.select(*key, F.explode("basis_refs").alias("ref")).join(outcome_episodes.select(F.col("outcome_ref").alias("ref"), F.lit(True).alias("is_outcome")), "ref", "left")
    split = cited.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("is_outcome").isNull(), F.col("ref")))).alias("episode_refs"),
        F.array_sort(F.collect_list(F.when(F.col("is_outcome"), F.col("ref")))).alias("outcome_refs"))
    done = done.join(split, key)
    text, scope = F.col("new_text"), F.col("application_scope")
    root = F.when(F.col("target") == "NEW_RECOLLECTION", refs.recollection_ref(F.col("job_ref"), scope, text, F.col("episode_refs"))).when(
        F.col("target") == "NEW_DISPOSITION", refs.seed_ref(F.col("job_ref"), text, F.col("episode_refs"), F.col("outcome_refs"))).otherwise(F.col("root_ref"))
    done = done.withColumn("root_ref", root).withColumn("version_number", F.coalesce(F.col("version_number") + 1, F.lit(1))).withColumn(
        "version_ref", F.concat("root_ref", F.lit("@"), F.col("version_number").cast("string")))
    done = cut_lineage(done)
    new_versions = done.select(*OWNER, "kind", "root_ref", "version_ref", "version_number", text.alias("text"), "application_scope",
                               F.lit("active").alias("status"), F.col("job_ref").alias("origin_job_ref"))
    replaced = done.filter(~F.col("target").isin(*NEW_TARGETS)).select("tenant_ref", F.col("target").alias("version_ref"), "root_ref", "kind",
                                                                       F.col("version_ref").alias("replaced_by"))
    role = F.when(F.col("target").isin(*NEW_TARGETS), "formation").otherwise("revision")
    formed = done.select("tenant_ref", "version_ref", role.alias("role"), F.explode(F.concat("episode_refs", "outcome_refs")).alias("ref"))

    others = changes.filter("operation IN ('KEEP', 'REENACT', 'INHIBIT')").select(
        "tenant_ref", *key, "target", "operation", F.explode("basis_refs").alias("ref"))
    have = basis.select("tenant_ref", F.col("version_ref").alias("target"), F.col("episode_ref").alias("ref"), "role").distinct()
    kept = others.filter("operation = 'KEEP'").select("tenant_ref", F.col("target").alias("version_ref"), F.lit("support").alias("role"), "ref")
    inhibited = others.filter("operation = 'INHIBIT'").select("tenant_ref", F.col("target").alias("version_ref"), F.lit("inhibition").alias("role"), "ref")
    again = others.filter("operation = 'REENACT'")
    refused = again.join(have.select("tenant_ref", "target", "ref").distinct(), ["tenant_ref", "target", "ref"], "left_semi").select(*key).distinct()
    # one reenactment for a run, which its whole scope names
    place = [*SCOPE, "run_ref"]
    runs = episodes.select(F.col("episode_ref").alias("ref"), *place)
    prior = have.filter("role = 'reenactment'").join(runs, ["tenant_ref", "ref"]).select("target", *place).distinct()
    first = again.join(refused, key, "left_anti").join(runs, ["tenant_ref", "ref"]).join(prior, ["target", *place], "left_anti").groupBy(
        "target", *place).agg(F.min("ref").alias("ref"))
    reenacted = first.select("tenant_ref", F.col("target").alias("version_ref"), F.lit("reenactment").alias("role"), "ref")
    added = kept.unionByName(inhibited).unionByName(reenacted).join(
        have.withColumnRenamed("target", "version_ref"), ["tenant_ref", "version_ref", "ref", "role"], "left_anti")
    operations = new_versions.select("tenant_ref", "kind", F.col("version_ref").alias("document_ref"), F.lit("UPSERT").alias("action")).unionByName(
        replaced.select("tenant_ref", "kind", F.col("version_ref").alias("document_ref"), F.lit("DELETE").alias("action")))
    return {"versions": new_versions, "superseded": replaced, "basis": formed.unionByName(added.select(formed.columns)).distinct(), "operations": operations}


def conflict_keys(changes: DataFrame, windows: DataFrame, versions: DataFrame) -> DataFrame:
    """(key, window_ref, place): what a window reads or writes that another window of its owner may change.

    A version that it names, a text that it gives an owner, and the text that a revision sets free.
    """
    owner = F.concat_ws("\x1f", *OWNER)
    named = changes.join(windows, "window_ref").join(
        versions.select("tenant_ref", F.col("version_ref").alias("target"), F.col("kind").alias("o_kind"), F.col("text").alias("old_text"), F.col("application_scope").alias("old_scope"),
                        *[F.col(c).alias("o_" + c) for c in OWNER[1:]]), ["tenant_ref", "target"], "left")
    is_new = F.col("target").isin(*NEW_TARGETS)
    kind = F.when(F.col("target") == "NEW_RECOLLECTION", "recollection").when(F.col("target") == "NEW_DISPOSITION", "disposition").otherwise(F.col("o_kind"))
    scope = F.when(kind == "disposition", F.when(F.col("application") == "SELF", "self").otherwise("relation")).when(is_new, F.lower("application")).otherwise(F.col("old_scope"))
    # a revision belongs to the target's owner, a formation to the window's
    named = named.withColumns({c: F.when(is_new | F.col("o_kind").isNull(), F.col(c)).otherwise(F.col("o_" + c)) for c in OWNER[1:]})
    writes = F.col("operation").isin("TEXT", "ADAPT")
    text = lambda t: F.concat_ws("\x1f", F.lit("text"), owner, kind, scope, F.sha2(t, 256))
    keys = F.array(
        F.when(~is_new, F.concat_ws("\x1f", F.lit("version"), "tenant_ref", "target")),
        F.when(writes, text(trimmed("text"))), F.when(writes & F.col("old_text").isNotNull(), text(F.col("old_text"))))
    return named.select("window_ref", "place", F.explode(F.array_compact(keys)).alias("key")).distinct()


def concerned(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions that a change names, and those whose text it may write: no other one is read by any round.

    Texts meet by 64 bits, which may keep a few versions more.
    """
    known = cut_lineage(versions.select("version_ref", F.xxhash64("text").alias("code")))
    named = changes.select(F.col("target").alias("version_ref")).distinct()
    written = changes.filter("operation IN ('TEXT', 'ADAPT')").select(F.xxhash64(trimmed("text")).alias("code")).distinct()
    some = known.join(named, "version_ref", "left_semi").unionByName(known.join(written, "code", "left_semi")).select("version_ref").distinct()
    return versions.join(some, "version_ref", "left_semi")


def apply_in_order(changes: DataFrame, windows: DataFrame, validate: Callable[[DataFrame, DataFrame], DataFrame], versions: DataFrame, basis: DataFrame,
                   episodes: DataFrame, outcome_episodes: DataFrame) -> dict[str, DataFrame]:
    """What ``apply_changes`` gives when the windows of every owner are applied one after the other, by ``place``.

    ``windows``: owner columns, window_ref, job_ref, place (a total order in each owner). ``validate`` judges changes, given the version_refs that are no
    longer active. Windows that share no key (``conflict_keys``) don't see each other's effects. So each round takes, of all
    owners at once, the windows that are first in all their keys, against the state that earlier rounds left; versions, superseded
    versions and basis rows go from round to round, and a round reads only windows that are still open. There are as many rounds as the longest
    chain of windows that wait for each other.
    """
    changes = cut_lineage(changes.filter("error IS NULL"))
    versions, basis = cut_lineage(concerned(changes, versions)), cut_lineage(basis)
    keys = conflict_keys(changes, windows, versions)
    shared = keys.groupBy("key").agg(F.min("window_ref").alias("lo"), F.max("window_ref").alias("hi")).filter("lo < hi").select("key")
    open_ = cut_lineage(keys.join(shared, "key"))
    ready = changes.select("window_ref").distinct().join(open_.select("window_ref").distinct(), "window_ref", "left_anti")
    out: dict[str, DataFrame] = {}
    while True:
        first = open_.groupBy("key").agg(F.min("place").alias("first"))
        waits = open_.join(first, "key").groupBy("window_ref").agg(F.max(F.col("place") > F.col("first")).alias("waits"))
        now = cut_lineage(ready.unionByName(waits.filter("NOT waits").select("window_ref")))
        dead = out["superseded"].select("version_ref") if out else versions.filter("false").select("version_ref")
        judged = validate(changes.join(now, "window_ref", "left_semi"), dead)
        state, known = versions, basis
        if out:
            state = versions.select("tenant_ref", *OWNER[1:], "kind", "root_ref", "version_ref", "version_number", "text", "application_scope", "status").unionByName(
                out["versions"].drop("origin_job_ref")).join(dead, "version_ref", "left_anti")
            known = basis.select("tenant_ref", "version_ref", "episode_ref", "role").unionByName(
                out["basis"].select("tenant_ref", "version_ref", F.col("ref").alias("episode_ref"), "role"))
        made = apply_changes(judged, windows.drop("place"), state, known, episodes, outcome_episodes)
        out = {name: cut_lineage(out[name].unionByName(df) if out else df) for name, df in made.items()}
        open_ = cut_lineage(open_.join(now, "window_ref", "left_anti"))
        if open_.isEmpty():
            return out
        ready = now.filter("false")
