"""Each operator against a plain version, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from mnemoframe.llm import complement_pack, decontaminate, decreasing_pack, divergence, language_mixture, line_dedup, near_dup, quality_model, site_tree, url_filter  # noqa: E402
from mnemoframe.llm.components import components  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pydict()


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def some_documents(n=120, seed=1):
    """Invented texts with exact and near copies, shared lines and awkward rows."""
    draw = random.Random(seed)
    names = [f"w{k}" for k in range(400)] + ["The", "of", "Ärger", "naïve"]
    rows = []
    for i in range(n):
        text = " ".join(draw.choices(names, k=draw.randint(1, 90)))
        if i % 4 == 1:
            w = rows[-1][1].split(" ")
            for _ in range(draw.randint(0, 3)):
                w[draw.randrange(len(w))] = draw.choice(names)
            text = " ".join(w)
        if i % 5 == 0:
            text += "\n  All Rights Reserved here \nshort\n" + text[:draw.randint(0, 40)]
        rows.append((i * 3 % 1000, text))
    return rows + [(5001, None), (5002, ""), (5003, " \n\t "), (None, "no id " * 30), (None, None), (7, "same row twice and again"), (7, "same row twice and again"), (5004, "x" * 70_000 + " y\n" + "long " * 9_000), (5005, "A b"), (5006, "a B")]


# placement -------------------------------------------------------------------------------------------------------------------

def check_places(rows, capacity, expected):
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(spark, vocabulary, capacity):
    from tokenizers import Tokenizer

    rows = some_documents()
    whole = Tokenizer.from_file(vocabulary)
    expected = Counter()
    for i, t in rows:
        expected.update((*k, *v) for k, v in brute.pieces([(i, t)], whole, capacity).items())
    packed = complement_pack.pack_documents(brute.documents(spark, rows), vocabulary, capacity).collect()
    sequences = check_places(packed, capacity, expected)
    total = sum(k[3] * n for k, n in expected.items())
    assert sequences <= 1.08 * -(-total // capacity) + 1
    assert complement_pack.pack_documents(brute.documents(spark, []), vocabulary).count() == 0


def test_packing_finds_exact_fits():
    plan = complement_pack.complement_plan({60: 10, 40: 10, 50: 7, 30: 7, 20: 7, 70: 3, 10: 9}, 100)
    assert plan.used == {60: 10, 40: 10, 50: 7, 30: 7, 20: 7, 70: 3, 10: 9}
    assert plan.sequences == -(-(60 * 10 + 40 * 10 + 50 * 7 + 30 * 7 + 20 * 7 + 70 * 3 + 10 * 9) // 100)


def test_plan_steps_do_not_grow_with_pieces():
    draw = np.random.default_rng(5)
    lengths = np.minimum(512, 1 + draw.lognormal(4, 1.2, 4000).astype(int))
    few = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
    for plan in (complement_pack.complement_plan, decreasing_pack.decreasing_plan):
        one, many = plan(few, 512), plan({k: n * 10_000 for k, n in few.items()}, 512)
        assert many.used == {k: n * 10_000 for k, n in few.items()}
        assert len(many.runs) < 4 * len(one.runs) + 1000


def test_best_fit_decreasing_is_exact():
    import bisect

    draw = np.random.default_rng(3)
    for lengths in (draw.integers(1, 200, 900), draw.integers(60, 70, 500), np.ones(300, int)):
        free, opened = [], 0
        for x in sorted(lengths.tolist(), reverse=True):
            k = bisect.bisect_left(free, x)
            opened, room = (opened + 1, 199) if k == len(free) else (opened, free.pop(k))
            if room - x:
                bisect.insort(free, room - x)
        counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
        assert decreasing_pack.decreasing_plan(counts, 199).sequences == opened


def test_capacity_tree():
    tree, plain, draw = decreasing_pack.CapacityTree(50), Counter(), random.Random(4)
    for _ in range(400):
        free = draw.randint(1, 50)
        if draw.random() < 0.6:
            tree.add(free, 0, 1)
            plain[free] += 1
        else:
            found = tree.tightest(free)
            assert found == min((x for x in plain if x >= free and plain[x]), default=0)
            if found:
                tree.take(found, 1)
                plain[found] -= 1


def test_matrices_round_trip(spark, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    rows, capacity = some_documents(40), 64
    whole = Tokenizer.from_file(vocabulary)
    docs = brute.documents(spark, rows)
    packed = decreasing_pack.packed_matrices(docs, vocabulary, capacity)
    decreasing_pack.write_matrices(packed, str(tmp_path / "packed"))
    parts = Counter()
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids, positions = (np.frombuffer(bytes(r[c]), dtype="<u4") for c in ("input_ids", "position_ids"))
        assert len(ids) == len(positions) == capacity and r["cu_seqlens"][0] == 0
        for doc, lo, hi in zip(r["doc_ids"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert positions[lo:hi].tolist() == list(range(hi - lo))
            parts[doc, ids[lo:hi].tobytes()] += 1
        assert not ids[r["cu_seqlens"][-1]:].any() and not positions[r["cu_seqlens"][-1]:].any()
    expected = Counter()
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        expected.update((i, ids[lo:lo + capacity].tobytes()) for lo in range(0, len(ids), capacity))
    assert parts == expected
    assert decreasing_pack.packed_matrices(brute.documents(spark, []), vocabulary).count() == 0


def test_words_alone_have_the_tokens_of_the_text(vocabulary):
    from mnemoframe.llm.tokens import Encoder

    encoder, draw = Encoder(vocabulary), random.Random(1)
    assert encoder.by_word
    letters = "aAbB'sStTéÉßıİŞşſŉΣσς<|endoftext|>  \n\t\x1c\x85 ́é漢字١٢½²ªº×÷·.,!?$%&1234''reve ​　"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) + draw.choice(["", "<|endoftext|>x", "<|startoftext|>"])
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


# copies ----------------------------------------------------------------------------------------------------------------------

def test_near_duplicates(spark):
    rows = some_documents(160)
    got = near_dup.near_duplicates(brute.documents(spark, rows)).collect()
    expected = brute.components(rows)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(expected, key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert near_dup.near_duplicates(brute.documents(spark, [])).count() == 0
    assert near_dup.near_duplicates(brute.documents(spark, [(1, None), (2, "")])).count() == 2


def test_near_duplicates_in_one_large_group(spark):
    """Copies of one text with edits at different places: many pairs are links, many are just none."""
    draw = random.Random(9)
    base = [f"w{draw.randrange(3000)}" for _ in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(draw.randint(0, 7)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10_000)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(base[:60] + [f"y{draw.randrange(10_000)}" for _ in range(60)])) for i in range(60)]
    rows += [(3000 + i, " ".join(base)) for i in range(50)]
    got = near_dup.near_duplicates(brute.documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute.components(rows))


def test_pigeonhole_keys():
    """Two signatures that differ in ERRORS symbols share a key, wherever the errors are."""
    import pyarrow as pa

    draw = np.random.default_rng(2)
    assert near_dup.ERRORS // near_dup.CHUNKS == 1
    for _ in range(30):
        one = draw.integers(0, 1 << 16, near_dup.SYMBOLS).astype(np.uint16)
        two = one.copy()
        two[draw.choice(near_dup.SYMBOLS, near_dup.ERRORS, replace=False)] += 1
        batch = pa.record_batch({"node": pa.array([1, 2]), "sig": pa.array([one.tobytes(), two.tobytes()], pa.binary())})
        keys = defaultdict(set)
        for b in near_dup._keys(iter([batch])):
            for k, n in zip(b.column("key").to_pylist(), b.column("node").to_pylist()):
                keys[n].add(k)
        assert keys[1] & keys[2]


def test_components(spark):
    draw = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 160)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(70)] + [(500, k) for k in range(501, 560)] + [(5, 5), (None, 4), (900, 800), (800, 900)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted((x, find(x)) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark):
    rows = some_documents(80)
    got = line_dedup.line_dedup(brute.documents(spark, rows)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute.without_lines(rows)))
    stage = line_dedup.without_repeated_lines(brute.documents(spark, rows))
    assert stage.columns == brute.documents(spark, rows).columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in stage.collect()) == sorted((str(i), t or "") for i, t, _, _ in brute.without_lines(rows))
    assert line_dedup.line_dedup(brute.documents(spark, [])).count() == 0


def test_line_dedup_with_full_filters(spark):
    """A filter that is far too small makes more suspects and the same result."""
    rows = some_documents(80)
    docs = brute.documents(spark, rows).selectExpr("doc_id as id", "text as t", "xxhash64(text) as h").where("id is not null")
    small, large = ({(r["id"], r["h"], tuple(sorted(r["drop"]))) for r in line_dedup.repeated_lines(docs, max_bytes=b).collect()} for b in (64, 1 << 20))
    assert small == large


@pytest.mark.parametrize("bits", [5, 8, 23])
def test_line_dedup_in_segments(spark, monkeypatch, bits):
    """Beyond the bound of the broadcast, filters of any number of segments give the same lines."""
    rows = some_documents(80)
    monkeypatch.setattr(line_dedup, "MAX_BYTES", 16)
    monkeypatch.setattr(line_dedup, "SEGMENT_BITS", bits)
    docs = brute.documents(spark, rows).selectExpr("doc_id as id", "text as t", "xxhash64(text) as h").where("id is not null")
    got = {(r["id"], r["h"], tuple(sorted(r["drop"]))) for r in line_dedup.repeated_lines(docs.repartition(3), max_bytes=16).collect()}
    want = {(r["id"], r["h"], tuple(sorted(r["drop"]))) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == want and got


def test_emptied_documents_may_go(spark):
    rows = [(1, "a first line here\na second line here"), (2, "A second line here \n \n"), (3, "a first line here\nmine"), (4, None), (5, ""), (6, " \n")]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(brute.documents(spark, rows), emptied=False).collect()}
    assert kept == {1: rows[0][1], 3: "mine", 4: None, 5: "", 6: " \n"}


# leaks -----------------------------------------------------------------------------------------------------------------------

def test_decontamination(spark):
    draw = random.Random(3)
    names = [f"v{k}" for k in range(800)]
    items = [(k, " ".join(draw.choices(names, k=draw.randint(3, 40)))) for k in range(12)] + [(50, None), (51, ""), (52, "only"), (None, "w w w")]
    rows = []
    for i in range(60):
        text = " ".join(draw.choices(names, k=60))
        if i % 3 == 0:
            w = items[i % 12][1].split(" ")
            if i % 2 and len(w) > 14:
                w[7] = "changed"
                del w[3]
            text = f"{text[:80]}, {' '.join(w).upper()}! {text[80:]}"
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, "Only"), (903, items[5][1]), (903, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("t", F.lit("x")).withColumn("id", F.lit("y"))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.benchmark_matches(brute.documents(spark, rows), bench).collect()}
    expected = brute.leaks(rows, [x for x in items if x[0] is not None])
    assert got == expected and len(got) > 15
    stage = decontaminate.decontaminated(brute.documents(spark, rows + [(None, items[5][1])]), bench)
    assert sorted(map(str, (r["doc_id"] for r in stage.collect()))) == sorted(map(str, [i for i, _ in rows if i not in {d for d, _ in expected}] + [None]))
    assert decontaminate.benchmark_matches(brute.documents(spark, []), bench).count() == 0
    assert decontaminate.benchmark_matches(brute.documents(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_spread_edits(spark):
    draw = random.Random(8)
    names = [f"v{k}" for k in range(150)]
    items = [(k, " ".join(draw.choices(names, k=n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 12, 15, 15, 20, 33, 60])]
    rows = []
    for k, t in items:
        for every in (2, 3, 4, 5):
            for edit in ("change", "drop", "add"):
                w = [y for j, x in enumerate(t.split(" "), 1) for y in ([x] if j % every else {"change": ["new"], "drop": [], "add": [x, "new"]}[edit])]
                rows.append((len(rows), " ".join(draw.choices(names, k=draw.randint(0, 30)) + w + draw.choices(names, k=30))))
    item = items[11][1].split(" ")
    rows.append((8000, " ".join("new" if j in (5, 10, 15) else x for j, x in enumerate(item, 1))))
    rows.append((8001, " ".join("new" if j == 5 else x for j, x in enumerate(items[8][1].split(" "), 1))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for ratio in (0.5, 0.7):
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.benchmark_matches(brute.documents(spark, rows), bench, ratio=ratio).collect()}
        assert got == brute.leaks(rows, items, ratio)
        assert got[8000, 11] == 22 and got[8001, 8] == 15


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    one = {tuple(r) for r in decontaminate.benchmark_matches(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert {tuple(r) for r in decontaminate.benchmark_matches(docs, bench).collect()} == one and one


# rules and models ------------------------------------------------------------------------------------------------------------

def test_quality_rules(spark):
    d = table("documents")
    rows = list(zip(d["doc_id"], d["text"])) + [(9001, None), (9002, ""), (9003, " \n "), (9004, "a b"), (9005, "x y z " * 5000), (9006, "a b\na b\n a b\n\n"), (None, "w " * 60)]
    lang = d["lang"] + [None, "en", "xx", None, "en", "de", "xx"]
    got = divergence.quality_rules(brute.documents(spark, rows, lang)).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(str((i, *brute.rule_counts(t))) for i, t in rows)
    # divergence by hand
    totals, counts = defaultdict(Counter), []
    for (i, t), name in zip(rows, lang):
        solid, w = re.sub(r"[ \t\n\x0b\x0c\r]+", "", t or ""), re.findall(r"[^\x20\x09-\x0D]+", t or "")
        chars, rest = Counter(), solid
        for cls, pattern in divergence.CLASSES:
            short = re.sub(pattern.replace(r"\x0B", "\x0b"), "", rest)
            chars[cls], rest = len(rest) - len(short), short
        chars["c_other"] = len(rest)
        hist = Counter({x: w.count(x) for x in divergence.COMMON_WORDS.get(name, ())})
        hist["rest"] = len(w) - sum(hist.values())
        totals[name].update(chars)
        totals[name, "words"].update(hist)
        counts.append((i, name, chars, hist, len(w), brute.rule_counts(t)[5]))

    def js(a, b):
        n, m = sum(a.values()), sum(b.values())
        if not n or not m:
            return None
        p, q = ({k: c[k] / s for k in b} for c, s in ((a, n), (b, m)))
        side = lambda x, y: sum(v * np.log2(2 * v / (v + y[k])) for k, v in x.items() if v)
        return (side(p, q) + side(q, p)) / 2

    by_id = {r["doc_id"]: r for r in got}
    for i, name, chars, hist, n, failed in counts:
        r, one = by_id[i], js(chars, totals[name])
        two = js(hist, totals[name, "words"]) if name in divergence.COMMON_WORDS else None
        assert r["js_chars"] == (None if one is None else pytest.approx(max(one, 0), abs=2e-6))
        assert r["js_words"] == (None if two is None else pytest.approx(max(two, 0), abs=2e-6))
        assert r["kept"] == (not failed and (one is None or r["js_chars"] <= divergence.CHAR_LIMIT) and (two is None or n < divergence.WORD_GUARD or r["js_words"] <= divergence.WORD_LIMIT))
    assert divergence.quality_rules(brute.documents(spark, [])).count() == 0


def test_quality_rules_keep_clean_texts(spark):
    found = divergence.op3_distribution_divergence(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("n_words >= 50").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n"))
    kept = {r["quality"]: r["kept"] for r in found.collect()}
    assert kept[1] > 0.97 and kept.get(0, 0) < 0.2


def test_repeated_runs_of_very_long_texts(spark):
    draw = random.Random(6)
    once = [f"w{k}" for k in range(120_000)]
    many = [f"v{draw.randrange(30)}" for _ in range(20_000)]
    rows = [(1, " ".join(once)), (2, " ".join(once + many)), (3, " ".join(once[:70_000] + ["a", "b", "c"] + once[70_000:] + ["a", "b", "c"])), (4, "x y " * 40_000)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in divergence.quality_rules(brute.documents(spark, rows)).collect()}
    assert got == {i: brute.rule_counts(t)[4] for i, t in rows}


def test_thresholds_of_one_class():
    bins = [(k, True, 100) for k in range(100, 300)]
    edge = url_filter.threshold(bins)
    place = (edge + url_filter.SPAN) / (2 * url_filter.SPAN / url_filter.BINS)
    # half a per cent of 200 bins is one bin
    assert round(place) in (100, 101)
    high = url_filter.threshold([(k, False, 100) for k in range(100, 300)])
    assert round((high + url_filter.SPAN) / (2 * url_filter.SPAN / url_filter.BINS)) in (299, 300)
    assert url_filter.threshold([]) == -np.inf


def test_calibration_hosts_are_not_learned(spark):
    lessons = spark.createDataFrame([(f"h{k % 50}.org", f"http://h{k % 50}.org/{k}", k % 2 == 0) for k in range(400)], "host string, url string, good boolean")
    split = lessons.withColumn("aside", url_filter._aside(lessons)).select("host", "aside").distinct().collect()
    assert len(split) == 50 and 0 < sum(r["aside"] for r in split) < 25
    few = lessons.where("host = 'h1.org' or good")
    assert few.withColumn("aside", url_filter._aside(few)).where("not good").select("aside").distinct().count() == 2


def test_url_rules(spark):
    urls = ["http://x.example.org/es/1", "https://example.org/en/12?a=1", "http://a.ORG/", "http://a.org", "http://aorg/es/", "http://b.com/fr/2#x", "http://b.com/de/3", "http://b.com/en/4", "http://n.net/", None, "", "no address", "://x.org/es/", "ftp://u@h.org:80/a", "http://h.org?x=/es/", "http://example.org/es/?y://z", "a\n://k.com/de/", "http://casino-win.example.com/en/1", "http://cheap-pills.example.net/en/2"] * 2
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").select("*", *[F.lit("z").alias(c) for c in ("host", "path", "rule", "id", "score", "ruled", "good", "aside")])

    def expected(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host):])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        best = None
        for verdict, suffix, start in url_filter.RULES:
            if (host == suffix or host.endswith("." + suffix)) and path.startswith(start) and (best is None or len(suffix + start) > len(best[0])):
                best = (suffix + start, verdict)
        return host, path, best and best[0], best and best[1]

    for r in url_filter.url_verdicts(pages).collect():
        host, path, rule, verdict = expected(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
        if not urls[r["page_id"]] or "://" not in urls[r["page_id"]]:
            assert r["verdict"] == "block"
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0
    # nothing to learn from: what no rule decides is allowed
    assert [r["verdict"] for r in url_filter.url_verdicts(pages.where("page_id = 8")).collect()] == ["allow"]


def test_urls_of_hosts_without_listed_words(spark):
    """Bad hosts that only words of other bad hosts lead to, some in two steps; and one that a word not among the given hosts' names marks."""
    draw = random.Random(5)
    fine = [f"{x}-{y}.net" for x, y in zip(*[["".join(draw.choices("aeiorstnlm", k=7)) for _ in range(40)] for _ in range(2)])]
    allowed = [x[:-4] + ".org" for x in fine]
    listed = ["warez-zubqix.com", "warez-zubqix.net", "torrent-zubqix.biz"]
    led = ["zubqix-wyvokk.com", "zubqix-wyvokk.net", "wyvokk-jugzyf.com"]
    urls = [f"https://{h}/{draw.choice(['en', 'es'])}/{draw.randint(1, 9999)}" for h in fine + allowed + 3 * (listed + led) for _ in range(5)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {}
    for r in url_filter.url_verdicts(pages).collect():
        got.setdefault(r["host"], []).append(r["verdict"])
    assert {h for h, v in got.items() if "block" in v} == {*listed, *led} and all(set(got[h]) == {"block"} for h in listed + led)
    rows = spark.createDataFrame([("a-x.net", True, False), ("b-x.net", True, False), ("x-y.com", False, False), ("x-y.biz", False, False), ("y-z.biz", False, False), ("a-q.com", False, False), ("net-x.org", False, False), ("", False, False)], "host string, bad boolean, fine boolean")
    assert sorted(r["host"] for r in url_filter.rejected_hosts(rows).collect()) == ["net-x.org", "x-y.biz", "x-y.com", "y-z.biz"]
    assert url_filter.rejected_hosts(rows.union(spark.createDataFrame([("x.org", False, True), ("net.org", False, True)], rows.schema))).count() == 0


def test_url_scores_by_plain_counts(monkeypatch):
    """The models' scores against dictionaries of contexts; with so many places that few contexts share one."""
    import pyarrow as pa

    monkeypatch.setattr(url_filter, "LOG_PLACES", 23)
    monkeypatch.setattr(url_filter, "PLACES", 1 << 23)
    urls = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("url").to_pylist()
    good = ["casino" not in u and "pills" not in u and "/de/" not in u for u in urls]
    seen = {c: [Counter() for _ in range(2 * url_filter.ORDER + 2)] for c in (True, False)}

    def steps(u):
        data = bytes(c + 32 if 65 <= c < 91 else c for c in u.encode())
        for k in range(len(data)):
            yield [(bytes(max(0, o - k)) + data[max(0, k - o):k], data[k]) for o in range(url_filter.ORDER + 1)]

    for u, g in zip(urls, good):
        for step in steps(u):
            for o, (c, x) in enumerate(step):
                seen[g][2 * o][c, x] += 1
                seen[g][2 * o + 1][c] += 1
    counts = pa.Table.from_batches(list(url_filter._counted(iter([pa.record_batch({"url": pa.array(urls), "good": pa.array(good)})]))))
    got = url_filter.Ratio(counts).scores(pa.array([*urls[:60], ""]))
    for u, score in zip(urls[:60], got):
        total = 0.0
        for step in steps(u):
            for sign, s in ((1, seen[True]), (-1, seen[False])):
                p = 1 / 256
                for o, (c, x) in enumerate(step):
                    p = (s[2 * o][c, x] + url_filter.WEIGHT * p) / (s[2 * o + 1][c] + url_filter.WEIGHT)
                total += sign * np.log(p)
        assert score == pytest.approx(total / len(u.encode()), abs=1e-3)
    assert got[-1] == 0


def test_language_held_out(spark):
    got = language_mixture.op5_language_mixture(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_language_mixture(spark):
    d = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()
    rows = [(i, t) for i, t in zip(d["doc_id"], d["text"])]
    by = defaultdict(list)
    for (i, t), name in zip(rows, d["lang"]):
        if len(t) > 1500 and "***" not in t and "!!" not in t and "|" not in t:
            by[name].append(t[:1500])
    mixed = by["de"][-1] + "\n" + by["es"][-1] + by["es"][-2]
    odd = [(9001, None), (9002, ""), (9003, "1234 !!"), (9004, "a"), (9005, mixed), (None, by["fr"][-1]), (9006, by["fr"][-1]), (9006, by["fr"][-1])]
    found = language_mixture.language_mixture(brute.documents(spark, rows + odd, d["lang"] + [None] * len(odd)), F.col("doc_id") % 2 == 0).collect()
    assert len(found) == len(rows) + len(odd)
    got = {r["doc_id"]: r for r in found}
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (9001, 9002, 9003)] == [("und", 0.0)] * 3
    assert set(got[9005]["languages"]) == {"de", "es"} and got[9005]["lang_pred"] == "es" and 0.55 < got[9005]["score"] < 0.8
    assert got[None]["lang_pred"] == got[9006]["lang_pred"] == "fr"
    assert language_mixture.language_mixture(brute.documents(spark, []), F.lit(True)).count() == 0
    nothing = language_mixture.language_mixture(brute.documents(spark, [(1, "some text")]), F.lit(False)).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]


def test_language_mixture_of_four(spark):
    d = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()
    by = defaultdict(list)
    for t, name in zip(d["text"], d["lang"]):
        if len(t) > 1500 and "***" not in t and "!!" not in t and "|" not in t:
            by[name].append(t[:1500])
    mixed = "\n".join(by[x][-1] for x in ("de", "en", "es", "fr")) + by["es"][-2]
    rows = list(zip(d["doc_id"], d["text"])) + [(9005, mixed)]
    found = language_mixture.language_mixture(brute.documents(spark, rows, d["lang"] + [None]), F.lit(True)).where("doc_id = 9005").first()
    assert set(found["languages"]) == {"de", "en", "es", "fr"} and found["lang_pred"] == "es" and 0.3 < found["score"] < 0.5
    assert abs(sum(found["shares"]) - 1) < 1e-6


def test_language_shares_by_plain_em():
    """The shares of all languages against EM on a single text, one n-gram after the other."""
    draw = np.random.default_rng(1)
    model = language_mixture.Model({x: draw.integers(0, 50, language_mixture.GRAMS) for x in "abc"})
    import pyarrow as pa

    text = "".join(draw.choice(list("abcdefgh "), 400))
    grams, begin = language_mixture.grams(pa.array([text]))
    share = np.full(3, 1 / 3)
    for _ in range(language_mixture.ROUNDS):
        total = np.zeros(3)
        for g in grams:
            part = share * model.chance[:, g]
            total += part / part.sum()
        share = total / len(grams)
    keys, counts = np.unique(grams, return_counts=True)
    got = language_mixture._fit(model.chance[:, keys], counts.astype(float), np.zeros(len(keys), int), np.array([0]), np.ones((3, 1)))[0]
    assert np.allclose(got[:, 0], share)


def test_quality_classifier(spark):
    got = {r["doc_id"]: r for r in quality_model.op9_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pydict()
    right = [got[i]["kept"] == bool(q) for i, q in zip(labels["doc_id"], labels["quality"])]
    assert sum(right) >= 0.97 * len(right)
    clean = [got[i]["kept"] for i, q in zip(labels["doc_id"], labels["quality"]) if q]
    assert sum(clean) >= 0.98 * len(clean)


def test_quality_classifier_odd_rows(spark):
    rows = some_documents(60)
    docs = brute.documents(spark, rows)
    got = quality_model.quality_scores(docs).collect()
    assert len(got) == len(rows)
    assert [r["kept"] for r in got if r["doc_id"] in (5001, 5002, 5003)] == [False] * 3
    kept = quality_model.well_written(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality_model.quality_scores(brute.documents(spark, [])).count() == 0
    assert quality_model.well_written(brute.documents(spark, [(1, None), (2, "")])).count() == 0


def test_labellers_are_told_apart():
    """EM recovers the accuracies of simulated labellers."""
    draw = np.random.default_rng(8)
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.9])
    truth = draw.random(40_000) < 0.8
    votes = np.where(draw.random((40_000, 7)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[draw.random(votes.shape) < 0.3] = quality_model.SILENT
    patterns = Counter("".join(map(str, v)) for v in votes.tolist())
    posterior, chance = quality_model.expectation_maximisation(patterns)
    assert np.abs(chance[:, 1, 1] - right).max() < 0.02 and np.abs(chance[:, 0, 0] - right).max() < 0.03
    sure = [(posterior["".join(map(str, v))] >= 0.5) == t for v, t in zip(votes.tolist(), truth)]
    assert np.mean(sure) > 0.95


# pages -----------------------------------------------------------------------------------------------------------------------

def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("z").alias(c) for c in ("id", "host", "low", "text", "node", "n")])


def test_main_text(spark):
    got = {r["page_id"]: r for r in site_tree.op10_site_style_tree(spark, SMALL).collect()}
    pages = table("pages")
    for i, u, source in zip(pages["page_id"], pages["url"], pages["html"]):
        article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", source, re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        text = "\n\n".join(x for x in blocks if x)
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (u, text, len(text))


def test_main_text_of_odd_pages(spark):
    sources = {
        1: ("<body><header>H</header><main><article class='x'><h1>T &amp; a</h1><div class='share-bar'>s</div><p>one <i>two</i>\n three<p>four<ul><li>a<li>b</ul><aside>no</aside><div id=comments><p>c</p></div><table><tr><td>x<td>y</table>tail<script>if(a<b){'</p>'}</script></article></main><footer>f", "T & a\n\none two three\n\nfour\n\na\n\nb\n\nx\n\ny\n\ntail"),
        2: (None, ""), 3: ("", ""), 4: ("plain &lt;b&gt; &#233; &nbsp; text", "plain <b> é text"), 5: ("<div><!-- x -->a <b>c</div></nope>", "a c"),
        6: ("<nav>only</nav><form>menu</form>", ""), 7: ("<p>" + "long " * 50_000, ("long " * 50_000).strip()), 8: ("<div class='ad'>x<div>y</div></div><div>z", "z"),
        9: ("<main><p>m</p></main><p>outside</p>", "m"), 10: ("<article>un<b>closed", "unclosed"), 11: ("<p hidden>h</p><p>a &copy &unknown; 1 < 2</p>", "a © &unknown; 1 < 2"),
    }
    rows = [(k, "http://h.org/1" if k % 2 else None, s) for k, (s, _) in sources.items()] + [(None, None, "<p>x"), (1, "http://h.org/1", sources[1][0])]
    got = site_tree.main_texts(pages_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == (sources[r["page_id"]][1] if r["page_id"] is not None else "x") and r["n_chars"] == len(r["text"])
    assert site_tree.main_texts(pages_of(spark, []).where("false")).count() == 0


def test_style_tree_finds_what_a_site_repeats(spark):
    draw = random.Random(2)
    text = lambda: " ".join(f"w{draw.randrange(5000)}" for _ in range(30))
    own = [text() for _ in range(40)]
    rows = [(k, "http://a.org/x", f"<article><p>{own[k]}</p><p>Read our other stories</p><p>{text()}</p></article>") for k in range(40)]
    # copies of one page, and a small site
    rows += [(100 + k, "http://b.org/x", f"<article><p>{own[0]}</p><p>{own[1]}</p></article>") for k in range(60)]
    rows += [(200 + k, "http://c.org/x", f"<article><p>{own[k]}</p><p>Read our other stories</p></article>") for k in range(5)]
    got = {r["page_id"]: r["text"] for r in site_tree.main_texts(pages_of(spark, rows)).collect()}
    assert all("other stories" not in got[k] and own[k] in got[k] for k in range(40))
    assert all(got[100 + k] == f"{own[0]}\n\n{own[1]}" for k in range(60))
    assert all(got[200 + k] == own[k] for k in range(5))
