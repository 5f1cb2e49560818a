"""Rows and plans of operators whose work must grow no faster than their input."""

import hashlib

from pyspark.sql import functions as F


def _executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_draws_are_never_broadcast(spark):
    from mnemoframe.operators.evalstats import cluster_bootstrap

    rows = [(c, f"p{i}", (i * 7 + len(c)) % 5 - 2, 1 + i % 3) for c, k in (("a", 40), ("bb", 40), ("ccc", 3)) for i in range(k)]
    out = cluster_bootstrap(spark.createDataFrame(rows, "comparison string, persona_id string, s long, n long"), 40)
    got = {r["comparison"]: (r["ci_low"], r["ci_high"]) for r in out.collect()}
    for c in ("a", "bb", "ccc"):
        own = sorted([r for r in rows if r[0] == c], key=lambda r: hashlib.md5(r[1].encode()).hexdigest())
        means = []
        for b in range(40):
            at = [int(hashlib.md5(f"0:{b}:{j}".encode()).hexdigest()[:15], 16) % len(own) for j in range(len(own))]
            means.append(sum(own[i][2] for i in at) / sum(own[i][3] for i in at))
        means.sort()
        assert got[c] == (round(means[1], 9), round(means[39], 9))
    # a sample stands for k draws, which Spark's estimates do not see
    assert "ShuffledHashJoin" in _executed(out) and not any("b#" in line and "idx" in line for line in _executed(out).splitlines() if "BroadcastExchange" in line)


def test_results_do_not_pass_the_driver(spark, tmp_path):
    from mnemoframe.operators import reports
    from mnemoframe.plans.bindings import Tables

    spark.range(50).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'web' AS source", "1L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(50).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    t = Tables(spark, str(tmp_path))
    assert "BroadcastHashJoin" not in t("results")._jdf.queryExecution().executedPlan().toString()
    checked = reports.question_checks(t("results"), t("diagnostics"))
    assert "Broadcast" not in checked._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_documents_send_their_best_together(spark):
    import numpy as np

    from mnemoframe.operators import vector

    def number_made(df, node):
        """Rows that the plan's node made."""
        rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            p = todo.pop()
            name = p.nodeName()
            if name == node:
                rows += p.metrics().apply("pythonNumRowsReceived").value()
            if name == "AdaptiveSparkPlan":
                todo.append(p.executedPlan())
            elif name.endswith("QueryStage"):
                todo.append(p.plan())
            todo += [p.children().apply(i) for i in range(p.children().size())]
        return rows

    rng = np.random.default_rng(5)
    docs = [(i % 2, i % 3, i // 2 * 2 + i % 2, f"s{i % 4}", [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(160)]
    docs += [(0, 1, 900, "s1", [0.0] * 6), (0, None, 901, "s1", [1.0] * 6), (None, 1, 902, "s1", [1.0] * 6)]
    asks = [(i % 2, i // 4 * 2 + i % 2, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(40)] + [(0, None, [1.0] * 6)]
    chunks = spark.createDataFrame(docs, "owner int, kind int, ref int, semantic_sha string, embedding array<float>")
    queries = spark.createDataFrame(asks, "owner int, query_ref int, embedding array<float>")
    out = vector.cosine_topk(chunks, queries, ["owner"], 5, block_rows=9, query_rows=3)
    got = sorted(tuple(r[c] for c in ("owner", "query_ref", "rank", "kind", "ref", "distance")) for r in out.collect())
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or np.nan)
    want = []
    for owner, ask in sorted({(o, a) for o, a, _ in asks if a is not None}):
        seen = {}
        for o, kind, ref, sha, e in docs:
            if o == owner and kind is not None and any(e):
                near = [round(float(1 - np.clip(unit(e) @ unit(v), -1, 1)), 9) + 0.0 for p, a, v in asks if (p, a) == (owner, ask) and any(v)]
                seen[sha, kind, ref] = min([*near, seen.get((sha, kind, ref), 9.0)])
        for rank, (d, (sha, kind, ref)) in enumerate(sorted((d, k) for k, d in seen.items())[:5], 1):
            want.append((owner, ask, rank, kind, ref, d))
    assert got == want
    # about nine blocks of documents for each owner; without a span each would send five rows for a query
    asked = len({(o, a) for o, a, _ in asks if a is not None})
    assert 0 < number_made(out, "MapInArrow") <= 5 * asked * 3


def test_mixed_ranking_is_made_once(spark):
    from mnemoframe.operators import fusion

    made = spark.sparkContext.accumulator(0)

    def one(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    ranking = spark.createDataFrame([(1, 1, p, "1", p) for p in range(8)], "owner int, query_ref int, position int, kind string, ref int")
    docs = spark.createDataFrame([(1, "1", p) for p in range(7)], "owner int, kind string, ref int")
    top, bad = fusion.kind_topk(ranking.mapInArrow(one, ranking.schema), docs, ["owner"], "1", 3)
    assert top.unionByName(bad, allowMissingColumns=True).count() == 4 and made.value == 8


def test_gold_is_counted_by_class(spark):
    from mnemoframe.operators.evalstats import recall_at_k

    asked = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 12, 0), (2, 13, 7)], "owner int, q int, m int")
    gold = spark.createDataFrame([(1, 0, 100), (1, 0, 101), (1, 1, 102), (2, 0, 103)], "owner int, m int, ref int")
    ranks = spark.createDataFrame([(1, 10, 100, 1), (1, 10, 102, 2), (1, 10, 101, 3), (1, 11, 100, 1), (2, 12, 103, 2)], "owner int, q int, ref int, rank int")
    pairs = asked.join(gold, ["owner", "m"]).drop("m")
    got = recall_at_k(ranks, gold, ["owner", "q"], (1, 2, 3), asked, ["owner", "m"])
    assert sorted(got.collect()) == sorted(recall_at_k(ranks, pairs, ["owner", "q"], (1, 2, 3)).collect())
    assert {r["k"]: (r["questions"], r["recall"], r["hit_rate"]) for r in got.collect()}[2] == (3, 0.5, 2 / 3)


def test_lanes_meet_their_catalogue_in_all_partitions(spark):
    from mnemoframe.operators import selection

    owner = lambda i: ("t%d" % (i % 3), "agent", "agent", "")
    lanes = spark.createDataFrame([(f"s{i}", f"r{i}", *owner(i)) for i in range(60)], ["session_ref", "run_ref", *selection.OWNER]).withColumn("agent_ref", F.lit("agent"))
    none = spark.createDataFrame([("s", "r", "t0", None, "agent", "")], "session_ref string, run_ref string, tenant_ref string, scope_kind string, agent_ref string, relationship_ref string")
    held = spark.createDataFrame([("kind", f"v{i}", *owner(i)) for i in range(9)], ["kind", "version_ref", *selection.OWNER])
    out = selection.offered(lanes.unionByName(none), held.unionByName(held.limit(1).withColumn("scope_kind", F.lit(None).cast("string"))), ["session_ref", "run_ref"])
    assert out.groupBy("tenant_ref").count().collect() and out.count() == 60 * 3 == out.distinct().count()
    # AQE put so few rows into one task
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bags_are_made_after_the_joins_that_spare_them(spark):
    from mnemoframe.operators import lexical
    from mnemoframe.plans.session import cut_lineage

    words = ["warm tea", "cold tea", "茶が好き", "", "tea!"]
    q = spark.createDataFrame([(i % 2, i, w) for i, w in enumerate(words * 2)], "o int, q int, text string").select("o", "q", lexical.features("text").alias("features"))
    t = spark.createDataFrame([(i % 2, i, w) for i, w in enumerate(words)], "o int, i int, text string").select("o", "i", lexical.features("text").alias("features"))
    pairs = lexical._gram_pairs(cut_lineage(q), cut_lineage(t), ["o"], "q", "i")
    assert pairs.count() > 0
    # a test of the bag in a filter makes bags of texts that no other text needs
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "ascii(" in line]


def test_selection_moves_texts_only_where_scripts_meet(spark, monkeypatch):
    from mnemoframe.operators import lexical, selection

    own = lambda i: (f"t{i}", "agent", "agent", "")
    cols, keys = "tenant_ref string, scope_kind string, agent_ref string, relationship_ref string", ["run_ref"]
    said = [("r0", "q0", "green tea with milk"), ("r1", "q1", "绿茶 with 牛奶好吗"), ("r1", "q2", "green river")]
    queries = spark.createDataFrame(said, "run_ref string, query_ref string, text string")
    lanes = spark.createDataFrame([("r0", *own(0), 1), ("r1", *own(1), 1)], f"run_ref string, {cols}, owner_order int")
    texts = [(*own(i % 2), "recollection", f"v{i}", x) for i, x in enumerate(["green tea", "green tea", "绿茶 tea", "绿茶好", "word " * 3 + " ".join(f"w{k}" for k in range(90)) + " tea", "river"])]
    active = spark.createDataFrame(texts, f"{cols}, kind string, version_ref string, text string")
    anchors = spark.createDataFrame([(*v[:4], v[5], "support", "e", "s", "x") for v in texts], f"{cols}, version_ref string, basis_role string, episode_ref string, source_ref string, anchor_text string")
    basis = spark.createDataFrame([], "tenant_ref string, version_ref string, episode_ref string, role string")
    hits = spark.createDataFrame([("r1", *own(1), "q1", 0, 0, "RECOLLECTION", "v1")], f"run_ref string, {cols}, query_ref string, lane_order int, rank int, kind string, ref string")
    seen, cut = [], selection.cut_lineage
    monkeypatch.setattr(selection, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    got = {(r.run_ref, r.version_ref): (r.support, r.indexed) for r in selection.select_memories(queries, lanes, active, anchors, basis, hits, active, keys).collect()}
    moved = {r.version_ref: r.text for df in seen if "mf" in df.columns for r in df.select("version_ref", "mf.text").collect()}
    # a Latin text stands beside its terms only where a query in another script may meet it
    assert moved["v0"] is None and moved["v1"] == "green tea" and moved["v5"] == "river"
    full = queries.join(lanes, keys).withColumn("qf", lexical.features("text")).drop("text").join(active.withColumn("mf", lexical.features("text")), selection.OWNER)
    want = {}
    for r in full.select("run_ref", "query_ref", "version_ref", lexical.score(F.col("qf"), F.col("mf")).alias("s")).collect():
        at, indexed = (r.run_ref, r.version_ref), (r.query_ref, r.version_ref) == ("q1", "v1")
        if indexed or r.s >= 0.2:
            want[at] = max(want.get(at, (-1.0, False)), (r.s, indexed), key=lambda x: (x[1], x[0]))
    assert got == want and len(got) >= 4


def test_numbers_of_terms_never_drop_a_reaching_pair(spark):
    from mnemoframe.operators import lexical

    said = ["", "tea", "green tea", "the of", "绿茶", "绿茶 tea", " ".join(f"w{k}" for k in range(30)) + " tea"]
    pairs = spark.createDataFrame([(a, b) for a in said for b in said], "a string, b string").select(lexical.features("a").alias("x"), lexical.features("b").alias("y"))
    fit = lexical.may_fit(lexical.known_terms("x"), lexical.known_terms("y"), 0.2)
    assert pairs.filter(~fit & (lexical.score(F.col("x"), F.col("y")) >= 0.2)).count() == 0 < pairs.filter(~fit).count()


def test_words_meet_snippets_without_texts(spark, monkeypatch):
    from mnemoframe.operators import evidence

    plans, cut = [], evidence.cut_lineage
    monkeypatch.setattr(evidence, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    turns = spark.createDataFrame([("c", None, "green tea", "with milk"), ("c", 1, "green tea", "with milk"), ("c", 1, "green tea", "with milk"), ("c", 2, "red tea", "no")],
                                  "conv_id string, idx int, user_text string, agent_text string")
    asked = spark.createDataFrame([("q", "c", 0, "user", "green tea"), ("q", "c", 1, "assistant", "with milk"), ("p", "c", 0, "user", "red  tea"), ("n", "c", 0, "user", "blue")],
                                  "question_ref string, conv_id string, pos int, role string, text string")
    got = {r.question_ref: (r.status, r.matches) for r in evidence.snippet_alignment(asked, turns).collect()}
    assert got == {"q": ("matched", 1), "p": ("matched", 1), "n": ("unmatched", 0)}
    words = [line for line in plans[0].splitlines() if ".lead AS lead" in line]
    assert words and not any(" u#" in line or "[u#" in line for line in words)


def test_owners_pass_a_task_one_after_the_other(spark, tmp_path):
    import random
    from mnemoframe.streaming import window_table
    from mnemoframe.streaming.state import LiveWindow

    rnd = random.Random(3)
    batches = [[(rnd.choice(["a", "b", None, "c"]), f"e{rnd.randrange(60)}", k * 1000 + rnd.randrange(1000)) for _ in range(300)] for k in range(3)]
    table = window_table.WindowTable(spark, str(tmp_path / "w"), 40, 5000, max_size=6, overlap=2)
    for k, rows in enumerate(batches):
        table.apply(spark.createDataFrame(rows, "owner string, episode_ref string, micros long"), k, end=k == 2)
    want, live, latest = [], {}, None
    for k, rows in enumerate(batches):
        latest = max([x for x in (latest,) if x is not None] + [r[2] for r in rows])
        for owner in sorted({r[0] for r in rows} | set(live), key=str):
            at = live.setdefault(owner, LiveWindow(40, 6, 2))
            closed = []
            for micros, ref in sorted((r[2], r[1]) for r in rows if r[0] == owner):
                closed += at.add(ref, micros)
            closed += at.advance((1 << 62) if k == 2 else latest - 5000)
            want += [("window", owner, n, p, ref) for n, window in closed for p, ref in enumerate(window)]
    assert sorted(map(tuple, table.answers().collect()), key=str) == sorted(want, key=str)
    plan = table.answers()  # the walk reads no whole group: its source has no cogroup
    assert plan.count() == len(want) and not hasattr(window_table, "pd")


def _exchanged(df):
    """Column names of every shuffle of the plan."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.inputPlan())
        if p.nodeName() == "Exchange":
            found.append({p.output().apply(i).name() for i in range(p.output().size())})
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_requests_and_versions_meet_without_a_shuffle_of_pairs(spark, monkeypatch):
    from mnemoframe.operators import lexical, selection

    a, b = ("t", "agent", "agent", ""), ("t", "relationship", "agent", "x")
    own, keys = "tenant_ref string, scope_kind string, agent_ref string, relationship_ref string", ["run_ref"]
    said = [("r0", "q0", "green tea with milk"), ("r1", "q1", "green tea"), ("r1", "q2", "red wine"), ("r2", "q3", "old river"), ("r3", "q4", "blue door"), ("r4", "q5", "red wine old"), (None, "q6", "green tea"), ("r5", "", "green tea")]
    lanes = [(f"r{i}", *a, 1) for i in range(6)] + [("r1", *b, 0), ("r2", *a, 1), (None, *a, 1)]
    rows = [(*a, "recollection", "a1", "green tea"), (*a, "recollection", "a2", "old river bank"), (*a, "recollection", "a2", "old river bank"), (*a, "disposition", "d1", "stay calm"), (*a, "disposition", "d2", "red wine"),
            (*b, "recollection", "b1", "red wine"), (*b, "recollection", "a1", "the of"), (*a, "recollection", "x1", "nothing alike"), (*a, "recollection", "x2", "blue door key"), (*a, "recollection", "x3", "blue door key")]
    listed = [r for r in rows if r[5][0] != "x"]
    behind = [(*r[:4], r[5], "support", f"e-{r[5]}", "s", "unlike") for r in rows if r[5] != "d1"] + [
        (*a, "d1", "support", "e1", "s2", "green tea leaves"), (*a, "d1", "support", "e1", "s1", "red door"), (*a, "d2", "inhibition", "e2", "s3", "red wine old"), (*a, "d2", "inhibition", "e3", "s3", "stone")]
    cited = [("t", "x2", "e9", "support"), ("t", "d1", "e1", "reenactment"), ("t", "d1", "e5", "reenactment"), ("t", "a1", "e9", "support")]
    found = [("r0", *a, "q0", 0, 3, "RECOLLECTION", "x1"), ("r0", *a, "q0", 1, 2, "RECOLLECTION", "x1"), ("r3", *a, "q4", 0, 1, "EPISODE", "e9"), ("r3", *a, "q4", 0, 2, "EPISODE", "e1"), ("r4", *b, "q5", 0, 0, "RECOLLECTION", "b1"), ("r4", *a, "q5", 0, 0, "RECOLLECTION", "gone"), ("r2", *a, "q3", 0, 5, "DISPOSITION", "d2")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    active, catalogue = (frame(r, f"{own}, kind string, version_ref string, text string") for r in (rows, listed))
    args = [frame(said, "run_ref string, query_ref string, text string"), frame(lanes, f"run_ref string, {own}, owner_order int"), catalogue,
            frame(behind, f"{own}, version_ref string, basis_role string, episode_ref string, source_ref string, anchor_text string"),
            frame(cited, "tenant_ref string, version_ref string, episode_ref string, role string"),
            frame(found, f"run_ref string, {own}, query_ref string, lane_order int, rank int, kind string, ref string"), active, keys]

    texts = sorted({r[2] for r in said} | {r[6] for r in rows} | {x[8] for x in behind})
    one = frame([(x,) for x in texts], "t string").withColumn("f", lexical.features("t"))
    score = {(r.t, r.u): r.s for r in one.crossJoin(one.select(F.col("t").alias("u"), F.col("f").alias("g"))).select("t", "u", lexical.score(F.col("f"), F.col("g")).alias("s")).collect()}
    want = []
    for run in sorted({r for r, *_ in said if r}):
        asked = [(q, x) for r, q, x in said if r == run and q]
        owners = [x[1:5] for x in lanes if x[0] == run]
        mine = [h for h in found if h[0] == run]
        met = {r[:6] for r in listed if r[:4] in owners} | {(*h[1:5], h[8].lower(), h[9]) for h in mine if h[8] != "EPISODE"} | {
            r[:6] for h in mine if h[8] == "EPISODE" for c in cited if c[2] == h[9] for r in rows if r[5] == c[1] and r[:4] == h[1:5]}
        paths, inhibited = {}, {}
        for r in (r for r in rows if r[:6] in met):
            at = (r[4], r[5])
            for q, x in asked:
                hit = sorted((h[7], h[6]) for h in mine if (h[1:5], h[5], h[8].lower(), h[9]) == (r[:4], q, *at))
                if hit or score[x, r[6]] >= 0.2:
                    paths.setdefault(at, []).append((not hit, *(hit[0] if hit else (0, 0)), -score[x, r[6]], False, q, r[5]))
                for v in (v for v in behind if r[4] == "disposition" and v[:5] == (*r[:4], r[5])):
                    s = score[x, v[8]]
                    if v[5] == "inhibition":
                        inhibited[at] = max(inhibited.get(at, 0.0), s)
                        continue
                    first = v[7] == min(w[7] for w in behind if w[:7] == v[:7])
                    hit = sorted((h[7], h[6]) for h in mine if first and (h[1:5], h[5], h[8], h[9]) == (r[:4], q, "EPISODE", v[6]))
                    if hit or s >= 0.2:
                        paths.setdefault(at, []).append((not hit, *(hit[0] if hit else (0, 0)), -s, True, q, v[6] if hit else v[7]))
        for at, some in paths.items():
            best = min(some)
            if at not in inhibited or -best[3] > inhibited[at]:
                want += [(run, *at, best[5], best[6], not best[0], round(-best[3], 6), order, 2 if at[1] == "d1" else 0)
                         for r in rows if r[:6] in met and (r[4], r[5]) == at for x in lanes if x[0] == run and x[1:5] == r[:4] for order in [x[5]]]
    got = {}
    for part in (1, 2, 128):
        monkeypatch.setattr(selection, "_PART", part)
        out = selection.select_memories(*args)
        got[part] = sorted((r.run_ref, r.kind, r.version_ref, r.query_ref, r.matched_ref, r.indexed, round(r.support, 6), r.owner_order, r.availability) for r in out.collect())
    assert got[1] == got[2] == got[128] == sorted(want)
    # an index match without a common word, a memory linked by an episode, an episode that speaks, a version twice, one reference of two owners, an inhibited one
    assert {(w[0], w[2]) for w in want} >= {("r0", "x1"), ("r3", "x2"), ("r3", "d1"), ("r2", "a2"), ("r1", "a1"), ("r1", "d2")} and ("r4", "d2") not in {(w[0], w[2]) for w in want}
    # what says a text goes to its owner's requests, a query to its owners, and pairs stay where both meet
    assert not [c for c in _exchanged(out) if {"version_ref", "query_ref"} <= c]


def test_packed_features_are_the_same_unpacked(spark):
    from mnemoframe.operators import lexical

    df = spark.createDataFrame([(x,) for x in ("green tea", "the of", "", "12 3", "绿茶 with 牛奶好吗", "tea tea TEA", "ключ и дверь", "naïve café")], "t string").withColumn("f", lexical.features("t"))
    both = df.withColumn("p", lexical.packed(F.col("f"), F.lit(False))).withColumn("g", lexical.unpacked(F.col("p")))
    assert both.filter("f.latin").count() >= 3 and both.filter("NOT f.latin AND p.text IS NOT NULL").count() >= 3
    for c in ("latin", "terms", "codes", "bag"):
        assert both.filter(~F.col(f"f.{c}").eqNullSafe(F.col(f"g.{c}"))).count() == 0, c
    assert both.filter("f.latin AND p.text IS NOT NULL").count() == 0
    kept = df.withColumn("g", lexical.unpacked(lexical.packed(F.col("f"), F.lit(True))))
    assert kept.filter("g.text = t").count() == df.count()
