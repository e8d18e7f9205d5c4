"""Relational operators against plain Python, plans, pages and streams."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyard.functions import text
from tallyard.operators import dedupe, metrics, pages, query
from tallyard.session import lookup_join, materialise
from tallyard.sources import exports
from tallyard.streaming import live

RECORD = "pos long, name_en string, name_ar string, website_url string, linkedin_url string, email string, phone string, city string, confidence_score double"


def frame(spark, rows):
    fields = [c.split(" ")[0] for c in RECORD.split(", ")]
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], RECORD)


def test_filter_language(spark):
    t = spark.createDataFrame([(1, "a", ["x"]), (2, None, ["y"]), (3, "b", None)], "k int, s string, l array<string>")
    keys = lambda *f: [r.k for r in query.select_rows(t, [f], "k").collect()]
    assert keys("s", "!=", "a") == [3] and keys("s", "in", ["a", "b"]) == [1, 3] and keys("k", ">=", 2) == [2, 3]
    assert keys("s", "not-in", ["a"]) == [3] and keys("l", "array-contains", "x") == [1] and keys("l", "array-contains-any", ["x", "y"]) == [1, 2]
    assert keys("k", "?", 2) == [2]
    assert [r.k for r in query.select_rows(t, order_by="s").collect()] == [1, 3, 2]
    assert [r.k for r in query.select_rows(t, order_by="s", direction="desc", limit=1).collect()] == [2]
    assert query.search(t, "s", "  ").count() == 0


def test_best_record_is_the_fold(spark):
    rng = random.Random(2)
    rows = [
        {"pos": i, "name_en": rng.choice(["Acme", " ACME ", "Beta", None]), "website_url": rng.choice([None, "", "a.b"]), "email": rng.choice([None, "x@y.z"]), "phone": rng.choice([" ", "1"]), "confidence_score": rng.choice([None, 0.5, 0.9])}
        for i in range(60)
    ]
    best, first = {}, {}
    for r in rows:
        name = (r["name_en"] or "").strip().lower()
        site = (r["website_url"] or "").strip()
        key = name or (f"|||{site}" if site else None)
        if not key:
            continue
        order = (bool(site), bool(r["email"]), bool(r["phone"].strip()), r["confidence_score"] or 0)
        first.setdefault(key, r["pos"])
        if key not in best or order > best[key][0]:
            best[key] = (order, r["pos"])
    got = {r.key: (r.pos, r.first_pos) for r in dedupe.best_records(frame(spark, rows)).collect()}
    assert got == {k: (v[1], first[k]) for k, v in best.items()}


names = st.text(alphabet="abc ", min_size=1, max_size=16).map(str.strip).filter(bool)


@settings(max_examples=400, deadline=None)
@given(a=st.text(alphabet="ab", min_size=1, max_size=30), edits=st.lists(st.tuples(st.integers(0, 30), st.sampled_from("abX")), max_size=4), seed=st.integers(0, 5))
def test_similar_names_share_a_rare_gram(a, edits, seed):
    b = a
    for at, c in edits:
        at %= len(b) + 1
        b = b[:at] + (c if c != "X" else "") + b[at + 1 :]
    if a != b and b and (max(len(a), len(b)) - levenshtein(a, b)) / max(len(a), len(b)) > 0.85:
        rank = {g[:3]: hash((g, seed)) % 7 for g in dedupe.grams(a) + dedupe.grams(b)}
        assert set(dedupe.gram_prefix(a, rank)) & set(dedupe.gram_prefix(b, rank))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def trade_names(rng, n):
    part = lambda k: "".join(rng.choice("bdfghklmnrstwz") + rng.choice("aiu") for _ in range(k))
    return [f"{part(6)} al {part(9)} contracting" for _ in range(n)]


def test_similar_names_of_one_trade_seldom_meet():
    names, salt = trade_names(random.Random(6), 400), np.zeros(400, dtype=np.uint64)
    counts = np.bincount([g for n in names for _, _, m in dedupe._by_length([n]) for g in (dedupe._gram_hashes(m, dedupe.CHUNK) % np.uint64(dedupe.PLACES)).ravel().tolist()], minlength=dedupe.PLACES)
    every = ~np.zeros(dedupe.POSTED_BITS >> 6, dtype=np.uint64)
    holders = {}
    for i, keys in enumerate(dedupe.gram_keys(names, salt, every).to_pylist()):
        for k in keys:
            holders.setdefault(k >> 16, set()).add(i)
    met = {(i, j) for i, keys in enumerate(dedupe.chunk_keys(names, salt, counts).to_pylist()) for k in keys for j in holders[k >> 16]}
    assert len(met) < 0.05 * 400 * 400


def test_similar_names_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    names = trade_names(rng, 8)
    names += [f"{n[:5]}{n[6:]}" for n in names[:4]] + [f"{n[:3]}x{n[4:11]}y{n[11:]}" for n in names[2:6]] + [f"{n} ksa" for n in names[5:]]
    names += ["abcdefg", "abcdefh", "abcdef", "bcdefg", "تجارة عامة", "تجارة عامه", "ab", "", "a" * 300, "a" * 280 + "b" * 9, "b" + "a" * 299]
    table = spark.createDataFrame([(c, n) for n in names for c in ("x", "x", "y")] + [(None, names[0])], "city string, name string")

    def near(a, b):
        if a in b or b in a:
            return min(len(a), len(b)) / max(len(a), len(b)) * 0.8 > 0.7
        return (max(len(a), len(b)) - levenshtein(a, b)) / max(len(a), len(b)) > 0.85

    expected = sorted((c, a, b) for c in "xy" for a in names for b in names if a and a < b and near(a, b))
    assert sorted((r.city, r.name_a, r.name_b) for r in dedupe.similar_name_pairs(table).collect()) == expected and expected


def test_duplicate_groups_are_those_of_the_sequential_scan(spark):
    rng = random.Random(4)
    rows = [
        {"pos": i, "name_en": rng.choice(["Alpha Pumps Trading", "Alpha Pumps Tradings", "Beta", f"N{i}"]), "city": rng.choice(["x", "y", None]), "website_url": rng.choice([None, "a.example", f"s{i}.example", "b.example"]), "linkedin_url": rng.choice([None, None, "l.example/1"])}
        for i in range(40)
    ]
    keys, of = {}, {}
    for r in dedupe.link_keys(frame(spark, rows)).collect():
        keys.setdefault(r.key, set()).add(r.pos)
        of.setdefault(r.pos, set()).add(r.key)
    taken, expected = set(), {}
    for head in sorted(of):
        if head not in taken:
            others = {p for k in of[head] for p in keys[k]} - {head} - taken
            if others:
                taken |= others | {head}
                expected |= {p: head for p in others}
    got = {r.pos: r.head_pos for r in dedupe.duplicate_groups(frame(spark, rows)).collect()}
    assert got == expected and got
    assert dedupe.duplicate_groups(frame(spark, [])).count() == 0


def test_duplicate_groups_of_a_long_chain_are_few_rounds(spark, monkeypatch):
    rows = [{"pos": i, "name_en": f"N{(i + 1) // 2}", "website_url": f"s{i // 2}.example"} for i in range(60)]
    written, materialise = [], dedupe.materialise
    monkeypatch.setattr(dedupe, "materialise", lambda df: written.append(1) or materialise(df))
    got = {(r.head_pos, r.pos) for r in dedupe.duplicate_groups(frame(spark, rows)).collect()}
    assert got == {(i, i + 1) for i in range(0, 60, 2)} and len(written) < 15
    waiting = [{"pos": i, "name_en": n, "website_url": f"{w}.example"} for i, (n, w) in enumerate((("Zz", "a"), ("Bb", "a"), ("Bb", "c"), ("Dd", "e"), ("Dd", "c")))]
    for n in (-1, dedupe.LAST_ROWS):
        assert {(r.head_pos, r.pos) for r in dedupe.duplicate_groups(frame(spark, waiting), last_rows=n).collect()} == {(0, 1), (2, 4)}
    rows = [{"pos": i, "name_en": f"N{i * 7 % 11}", "website_url": f"s{i * 5 % 13}.example", "linkedin_url": f"l.example/{i * i % 17}"} for i in range(30)]
    groups = [sorted(map(tuple, dedupe.duplicate_groups(frame(spark, rows), last_rows=n).collect())) for n in (-1, dedupe.LAST_ROWS)]
    assert groups[0] == groups[1] and groups[0]


@pytest.mark.parametrize("hot", [1, 5, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_is_a_join(spark, hot, how):
    rows = spark.createDataFrame([(i % 7, i) for i in range(60)] + [(None, 99)], "k int, v int")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 3")
    got = sorted(map(tuple, lookup_join(rows, groups, ["k"], "n", hot, how).select("k", "v", "n").collect()), key=str)
    assert got == sorted(map(tuple, rows.join(groups, "k", how).select("k", "v", "n").collect()), key=str)


@settings(max_examples=15, deadline=None)
@given(values=st.lists(st.integers(0, 100), min_size=1, max_size=30))
def test_histogram_quantiles(spark, values):
    points = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(values)], "k string, i int, v double")
    row = metrics.histograms(points, ["k"], "v", [F.desc("i")], kept=20).collect()[0]
    last = sorted(values[-20:])
    assert (row.n, row.p50, row.p90) == (len(last), last[int(len(last) * 0.5)], last[int(len(last) * 0.9)])


def test_upsert_patch_delete_and_ids(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, s string, v int")
    new = spark.createDataFrame([(2, None, 1), (3, "c", 1), (1, "old", 0)], "id int, s string, v int")
    assert sorted(map(tuple, exports.upserted(t, new, ["id"], ["v"]).collect())) == [(1, "a", 1), (2, None, 1), (3, "c", 1)]
    patched = exports.patched(t, spark.createDataFrame([(1, None)], "id int, s string"), "id")
    assert sorted(map(tuple, patched.collect())) == [(1, None, 1), (2, "b", 1)]
    assert [r.id for r in exports.without(t, new, "id").collect()] == []
    ids = exports.with_ids(spark.range(50).repartition(5).withColumnRenamed("id", "k"), "k", 10)
    assert sorted(map(tuple, ids.collect())) == [(i, 11 + i) for i in range(50)]


def test_csv_quotes_only_where_needed(spark, tmp_path):
    t = spark.createDataFrame([('a,"b', None, ["x", "y"])], "a string, b string, c array<string>")
    assert exports.csv_lines(t, ["a", "b", "c"]).collect()[0].line == '"a,""b",,x; y'
    exports.write_csv(t, ["a", "b"], str(tmp_path / "out"))
    heads = {f.read_text(encoding="utf-8").split("\n")[0] for f in (tmp_path / "out").glob("*.txt") if f.stat().st_size}
    assert heads == {exports.BOM + "a,b"}
    assert exports.swap_in(t, str(tmp_path / "t")) != str(tmp_path / "t")


PAGE = """<html><head><title>T - x</title><meta property="og:description" content="Makers of pumps and more pumps"></head><body>
<header><div class=logo><a><img src="/i.svg"></a></div></header><h1>Acme &amp; Sons</h1><p>one<p>two
<div class="team-member"><h3>A. Person</h3><span class=role>Chief</span></div>
<ul><li><a href="/a">Alpha</a><li><a href="/b">Beta</a><li><a href="/c">Gamma</a></ul>
<a href="https://linkedin.com/company/x">in</a> <span>Website: <a href="https://acme.example">x</a></span> 011 234 5678</body></html>"""


def test_pages_are_read(spark):
    t = spark.createDataFrame([(1, "https://www.dir.example/category/foo", PAGE), (2, None, None), (3, "https://x.example", "<p>unclosed <b>")], "page_id int, url string, html string")
    rows = {r.page_id: r.page for r in pages.extracted(t).collect()}
    p = rows[1]
    assert p.name.value == "Acme & Sons" and p.description.source == "og" and p.logo.value == "https://www.dir.example/i.svg"
    assert p.website.value == "https://acme.example" and p.social == {"linkedin": "https://linkedin.com/company/x"} and p.phones == ["011 234 5678"]
    assert p.team[0].role == "Chief" and rows[2].name.value is None
    found = pages.listings(t.filter("page_id = 1")).collect()
    assert [(r.name_en, r.strategy, r.adapter) for r in found] == [(n, "lists", "generic") for n in ("Alpha", "Beta", "Gamma")]


def test_parsers():
    base = "https://d.example/x"
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"A","url":"/a"},{"@type":"Person","name":"B"}]}</script>'
    assert [r["name_en"] for r in pages.parse_listing(ld, base, ("structured",))] == ["A"]
    cards = '<div class="company-card"><h3>Alpha</h3> 0112345678 <a href="/a">x</a></div><div class="company-card"><h3>Home</h3></div>'
    assert [(r["name_en"], r["phone"], r["website_url"]) for r in pages.parse_listing(cards, base, ("cards",))] == [("Alpha", "0112345678", "https://d.example/a")]
    labels = "<pre>\nCompany: Alpha\nPhone: 12\nCompany: Beta\nWebsite: b.example\n</pre>"
    assert [(r["name_en"], r["phone"], r["website_url"]) for r in pages.parse_listing(labels, base, ("labels",))] == [("Alpha", "12", None), ("Beta", None, "b.example")]
    assert pages.parse_listing("<dl><dt>Alpha<dd>x<dt>Beta</dl>", base, ("definitions",))[1]["name_en"] == "Beta"
    assert pages.parse_listing(None, None, ("lists",)) == []


def test_robots(spark):
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /x\n\nUser-agent: bot\nUser-agent: b2\nDisallow: /y\nAllow: /y/ok\nDisallow: /*.pdf$\nCrawl-delay: 3"), ("b", "")], "domain string, text string")
    seen = spark.createDataFrame([("a", p) for p in ("/x", "/y/1", "/y/ok/1", "/f.pdf", "/f.pdf?x")] + [("b", "/x"), ("c", "/")], "domain string, path string")
    rules = pages.robots_rules(robots)
    got = {(r.domain, r.path): (r.allowed, r.crawl_delay) for r in pages.robots_allowed(seen, rules, "Bot").collect()}
    assert got == {("a", "/x"): (True, 3), ("a", "/y/1"): (False, 3), ("a", "/y/ok/1"): (True, 3), ("a", "/f.pdf"): (False, 3), ("a", "/f.pdf?x"): (True, 3), ("b", "/x"): (True, 0), ("c", "/"): (True, 0)}
    assert not {(r.domain, r.path): r.allowed for r in pages.robots_allowed(seen, rules, "other").collect()}[("a", "/x")]


def requests(spark):
    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), start + datetime.timedelta(milliseconds=rng.randrange(200_000_000))) for i in range(60)] + [(100 + i, "a", start) for i in range(5)]
    return rows, spark.createDataFrame(rows, "id long, site string, at timestamp")


def expected_slots(rows, gap):
    out, last = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        start = max(t, last[k] + gap) if k in last else t
        out[i] = last[k] = start
    return out


def test_slots_in_batch_and_in_a_stream(spark, tmp_path):
    rows, t = requests(spark)
    expected = expected_slots(rows, datetime.timedelta(seconds=2))
    got = {r.id: r.granted_at for r in live.granted_slots(t, "site", "at", "id", 2000, F.to_date("at")).collect()}
    assert got == expected
    t.write.parquet(str(tmp_path / "r"))
    stream = live.slots_stream(live.source(spark, str(tmp_path / "r"), t), "site", "id", "at", 2000)
    assert {r.id: r.granted_at for r in live.run_to_end(stream, "append").collect()} == expected


def test_cache_and_windows_in_streams(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, "k", start + datetime.timedelta(minutes=m)) for i, m in enumerate((0, 30, 59, 61, 119, 121, 300))]
    t = spark.createDataFrame(rows, "id long, site string, at timestamp")
    t.coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = live.source(spark, str(tmp_path / "r"), t)
    got = {r.id for r in live.run_to_end(live.cached_reads(stream, "site", "id", "at", 3_600_000), "append").filter("is_fetch").collect()}
    assert got == {0, 3, 5, 6}
    windows = live.run_to_end(live.windowed(stream, "at", ["site"]), "append").collect()
    assert {(r.window_start.hour, r.n) for r in windows} == {(0, 3), (1, 2), (2, 1)}


def test_plans_have_no_cartesian_product_and_push_down(spark, tmp_path):
    rows = [{"pos": i, "name_en": f"N{i}", "city": "x", "website_url": "a.example", "confidence_score": 0.5} for i in range(20)]
    path = str(tmp_path / "p")
    frame(spark, rows).write.parquet(path)
    t = spark.read.parquet(path)
    best = dedupe.best_records(t)._jdf.queryExecution().toString()
    assert "Cartesian" not in best and "BatchEvalPython" not in best
    picked = query.select_rows(t.select("pos", "confidence_score"), [("pos", ">", 3)])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(pos), GreaterThan(pos,3)]" in picked and "name_en" not in picked.split("ReadSchema")[1]
    named = t.select(text.bare_company_name(F.col("name_en")).alias("name"), "city")
    assert "Cartesian" not in dedupe.similar_name_pairs(named)._jdf.queryExecution().toString()


def test_page_cursor(spark):
    t = spark.createDataFrame([(f"u{i}", i) for i in (3, 1, 2)], "url string, place int")
    got = [(r.url, r.page_no, r.is_active, r.next_page) for r in query.page_cursor(t, "place", 9).orderBy("page_no").collect()]
    assert got == [("u1", 0, False, 1), ("u2", 1, False, 2), ("u3", 2, True, None)]


@pytest.mark.parametrize("block_rows", [2, 5, 1000])
def test_blocks_of_any_size_keep_all_pairs(spark, block_rows):
    from tallyard.session import block_join

    left = [(k, i) for k, n in (("hot", 17), ("b", 3), ("c", 1), (None, 4)) for i in range(n)]
    right = [(k, i) for k, n in (("hot", 9), ("b", 1), ("d", 2), (None, 4)) for i in range(n)]
    a, b = spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int")
    got = sorted(tuple(r) for r in block_join(a, b, ["k"], "x", "y", block_rows).collect())
    assert got == sorted((k, x, y) for k, x in left for j, y in right if k == j and k)
    assert block_join(a.limit(0), b, ["k"], "x", "y", block_rows).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_large_groups_are_numbered_over_ranges(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = [("", i) for i in range(40)] + [("a", i) for i in range(3)] + [(None, i) for i in range(9)] + [("b", 7)]
        random.Random(2).shuffle(rows)
        got = exports.numbered_in_groups(spark.createDataFrame(rows, "g string, o int"), "g", "o").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {(g, o, sorted(x for h, x in rows if h == g).index(o) + 1) for g, o in rows}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_labels_by_joins_equal_labels_by_a_map(spark):
    from tallyard.operators import records

    reference = [("k01", "Pumps", "مضخات"), ("k02", "k01", "صمامات"), ("k03", "Doors", None)]
    rows = [(1, [" pumps ", "k02", "x", ""]), (2, ["مضخات", "DOORS", "k01"]), (3, []), (4, None)]
    t = spark.createDataFrame(rows, "pos int, labels array<string>")
    joined = records.category_ids_joined(t, spark.createDataFrame(reference, "id string, name_en string, name_ar string"), "pos", "labels")
    mapped = t.select("pos", records.category_ids(F.col("labels"), [(a, b, c or "-") for a, b, c in reference]).alias("ids")).filter(F.size("ids") > 0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, mapped.collect())) == [(1, ["k01", "k02", "x"]), (2, ["k01", "k03", "k01"])]


def test_failing_doubles_the_wait_until_the_last_attempt(spark):
    from tallyard.operators import jobs

    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    t = spark.createDataFrame([("a", 0, 5), ("b", 3, 5), ("c", 4, 5), ("d", None, None)], "id string, attempts int, max_attempts int")
    got = {r.id: (r.status, r.attempts, r.scheduled_at.minute * 60 + r.scheduled_at.second) for r in jobs.failed(t, F.lit("x"), now).collect()}
    assert got == {"a": ("pending", 1, 1), "b": ("pending", 4, 8), "c": ("dead_letter", 5, 0), "d": ("pending", 1, 1)}


def test_unknown_strategies_are_an_error(spark):
    from tallyard.plans import extra

    with pytest.raises(ValueError):
        extra.resolved(spark.range(0), "newest", ("a",))


def test_materialise_leaves_no_shuffle_files(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = spark.conf.get(key, None), files()
    counted = materialise(spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).count())
    assert files() <= held and spark.conf.get(key, None) == before
    assert counted.count() == 500 and counted.agg(F.sum("count")).first()[0] == 20_000
