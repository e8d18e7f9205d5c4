"""Copies, canonical values, residue, survivors, names, addresses and matching."""

import datetime
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyard.llm import addresses, canonical, fingerprint, matching, names, residue, survivor

LISTING = (
    "pos long, name_en string, name_ar string, website_url string, description_en string, phone string, city string,"
    " full_address string, categories array<string>, source_url string, first_pos long, rep long, key string, value string, n long"
)


def listing(spark, rows):
    """Rows given by name; the columns behind source_url clash with names the operators use inside."""
    fields = [c.strip().split(" ")[0] for c in LISTING.split(",")]
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], LISTING)


# copies by formatting


@pytest.mark.parametrize(
    "a, b, same",
    [
        (("Acme Co.", "http://a.test/x"), (" ACME  CO ", "http://a.test/x/"), True),
        (("Acme", "http://a.test?b=1&a=2"), ("acme", "http://a.test?a=2&b=1"), True),
        (("Acme", None), ("acme.", ""), True),
        (("Acme", "http://a.test"), ("http://A.test", "ACME"), True),
        (("Acme", "http://a.test"), ("Acme", "https://a.test"), False),
        (("Acme", "http://a.test?a=1&b=2"), ("Acme", "http://a.test?a=2&b=1"), False),
        (("Ärzte", None), ("ärzte!", None), True),
        (("ab", "c"), ("a", "bc"), False),
        (("What? A & B", None), ("What? B & A", None), False),
    ],
)
def test_same_record(a, b, same):
    assert fingerprint.same_record(*a, *b) is same


@settings(max_examples=150, deadline=None)
@given(rows=st.lists(st.tuples(*[st.none() | st.text(alphabet="aAbB?=&#. /é١", max_size=6)] * 2), min_size=2, max_size=12))
def test_keys_agree_with_the_comparison(rows):
    import numpy as np
    import pyarrow as pa

    a, b = (fingerprint.field_hashes(pa.array([r[i] for r in rows], pa.string())) for i in (0, 1))
    with np.errstate(over="ignore"):
        keys = [tuple(fingerprint._mix(a[h], 7)[i] + fingerprint._mix(b[h], 7)[i] for h in (0, 1)) for i in range(len(rows))]
    for i, j in itertools.combinations(range(len(rows)), 2):
        assert (keys[i] == keys[j]) == fingerprint.same_record(*rows[i], *rows[j])


def test_copies_with_hot_group_and_edges(spark):
    rows = [{"pos": i, "name_en": "Acme" + "." * (i % 3), "website_url": "http://a.test"} for i in range(1, 41)]
    rows += [{"pos": 100}, {"pos": 101, "name_en": " ", "website_url": ""}, {"pos": 102, "name_en": "Other"}, {"pos": 102, "name_en": "Other"}]
    frame = listing(spark, rows)
    expected = {(1, i) for i in range(2, 41)} | {(100, 101)}
    for hot in (5, 1000):  # through the broadcast of hot keys and through the shuffle
        got = [tuple(r) for r in fingerprint.formatting_copies(frame, hot_rows=hot).collect()]
        assert set(got) == expected and len(got) == len(expected)
    collapsed = {r.first_pos: r.n_copies for r in fingerprint.collapsed_records(frame).collect()}
    assert collapsed[1] == 40 and collapsed[100] == 2
    assert fingerprint.formatting_copies(frame.limit(0)).collect() == []


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "record_key", lambda a, b: __import__("pyspark").sql.functions.expr("struct(1L as k1, 1L as k2)"))
    rows = [{"pos": i, "name_en": n} for i, n in enumerate(["A", "B", "a.", "b!", "C", "B"], 1)]
    got = {tuple(r) for r in fingerprint.formatting_copies(listing(spark, rows)).collect()}
    assert got == {(1, 3), (2, 4), (2, 6)}


# canonical values

CITIES = [("1", ["Wadi Mathhoor", "وادي مثهور", "wadi-mathhoor"]), ("2", ["Jashoofla Port", "ميناء جشوفل"]), ("3", ["Qatasaaz", "قتساز"]), ("4", ["Qatasaaz Port", "ميناء قتساز"])]
TRADES = [("k01", ["Pump Stations", "محطات الضخ"]), ("k02", ["Pumps & Valves", "المضخات والصمامات"]), ("k04", ["Low Voltage Panels", "لوحات الجهد المنخفض"])]


@pytest.mark.parametrize(
    "entries, value, expected",
    [
        (CITIES, "wadi mathhour", "1"), (CITIES, "W. Mathhoor", "1"), (CITIES, "Jashoofla Port, KSA", "2"),
        (CITIES, "Qatasaaz Prt", "4"), (CITIES, "qatsaaz", "3"), (CITIES, "QATASAAZ 12345", "3"), (CITIES, "Saudi Arabia", "unmatched"),
        (CITIES, "Northern Region", "unmatched"), (CITIES, "مدينة ميناء قتساز", "4"), (CITIES, "11564", "unmatched"), (CITIES, "Wadi 7alooq", "unmatched"),
        (TRADES, "PumpStations", "k01"), (TRADES, "Valves & Pumps", "k02"), (TRADES, "Panels, Voltage, Low", "k04"), (TRADES, "K04", "k04"),
        (TRADES, "Pump Stat.", "k01"), (TRADES, "مضخات وصمامات", "k02"), (TRADES, "Industry > Pump Stations", "k01"), (TRADES, "Pet Grooming", "unmatched"), (TRADES, "General", "unmatched"),
    ],
)
def test_best_entry(entries, value, expected):
    found = canonical.Matcher(entries).best(value)
    assert (found[1] if found else "unmatched") == expected


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(words=st.lists(st.text(alphabet="abc", min_size=1, max_size=7), min_size=1, max_size=6), text=st.text(alphabet="abcd", max_size=7), k=st.integers(0, 2))
def test_automaton_finds_all_within_the_distance(words, text, k):
    trie = canonical.Trie()
    for i, w in enumerate(words):
        trie.add([w], i)
    expected = {i: osa(text, w) for i, w in enumerate(words) if osa(text, w) <= k}
    assert trie.search(text, k) == expected


@settings(max_examples=200, deadline=None)
@given(names_=st.lists(st.text(alphabet="bcd", min_size=1, max_size=9), min_size=1, max_size=6), text=st.text(alphabet="bcd", min_size=1, max_size=10))
def test_all_entries_within_the_distance_are_found(names_, text):
    found = canonical.Matcher([(f"e{i}", [x]) for i, x in enumerate(names_)]).find(text, every=True)
    expected = {i: osa(text, x) for i, x in enumerate(names_) if osa(text, x) <= canonical.allowance(len(text))}
    assert {e: d for e, _, d in found} == expected


def test_neighbours_of_an_exact_value(spark):
    ref = spark.createDataFrame([("1", "Qatasaaz", None, None), ("2", "Qatasaan", None, None), ("3", "Bareef", None, None)], "id string, name_en string, name_ar string, slug string")
    got = canonical.entries_within_distance(spark.createDataFrame([("Qatasaaz",)], "value string"), ref).collect()
    assert {(r.ref_id, r.edits) for r in got} == {("1", 0), ("2", 1)}


@pytest.mark.parametrize("entries_a_trie", [2, 200_000])
def test_mapping_with_edges(spark, monkeypatch, entries_a_trie):
    monkeypatch.setattr(canonical, "TRIE_ENTRIES", entries_a_trie)
    ref = "id string, region_id string, name_en string, name_ar string, slug string"
    cities = spark.createDataFrame([("3", "1", "Qatasaaz", "قتساز", "qatasaaz"), ("5", None, None, None, None)], ref)
    trades = spark.createDataFrame([("k01", None, "Pump Stations", "محطات الضخ", "pump-stations")], ref)
    rows = [{"pos": 1, "city": "qatasaz", "categories": ["Pump Stations", None, " ", "Pump Statoins", "x"]}, {"pos": 2, "city": "Qatasaaz"}, {"pos": 3, "city": "\xa0"}, {"pos": 4, "city": "y" * 5000}]
    rows += [{"pos": 10 + i, "city": "qatasaz"} for i in range(20)]
    for hot in (5, 1000):
        got = {tuple(r) for r in canonical.map_to_canonical(listing(spark, rows), cities, trades, hot).collect()}
        want = {(1, "city", 0, "3"), (1, "categories", 3, "k01"), (1, "categories", 4, "unmatched"), (4, "city", 0, "unmatched")}
        assert got == want | {(10 + i, "city", 0, "3") for i in range(20)}
    empty = canonical.map_to_canonical(listing(spark, rows), cities.limit(0), trades.limit(0))
    assert {r.ref_id for r in empty.collect()} == {"unmatched"}
    assert canonical.map_to_canonical(listing(spark, []), cities, trades).collect() == []


# residue


@pytest.mark.parametrize(
    "field, value, expected",
    [
        ("description_en", "Call {{ phone }} for prices.", True), ("description_en", "Founded in #{year}.", True), ("description_en", "<h1>500 Internal Server Error</h1>", True),
        ("description_en", "Please enable JavaScript to view this page.", True), ("description_en", "Lorem ipsum dolor sit amet.", True), ("description_en", "undefined in undefined", True),
        ("description_en", "الصفحة غير موجودة", True), ("description_en", "Type your company profile here", True), ("description_en", "Trade guide | HTTP 404 - The server at x.example returned Not Found", True),
        ("description_en", "Hotline 404 of Acme is printed on every panel.", False), ("description_en", "Acme makes dough templates {S, M, L} and moulds.", False),
        ("description_en", "Acme builds JavaScript front ends for dealers.", False), ("description_en", "Placeholder tiles and dummy plates from Acme.", False),
        ("description_en", "Prints forms with [ ] tick boxes and <A4> labels at 100% cover.", False), ("description_en", "", False),
        ("phone", "+966 XX XXX XXXX", True), ("phone", "0000000000", True), ("phone", "tel:undefined", True), ("phone", "Enter phone number", True), ("phone", "1234567890", True),
        ("phone", "+966 15 200 0003", False), ("phone", "Tel: +966 15 534 5358", False), ("phone", "019.735.8610 ext. 59", False),
        ("name_en", "%COMPANYNAME%", True), ("name_en", "Untitled Document", True), ("name_en", "[object Object]", True), ("name_en", "Company Name (English)", True),
        ("name_en", "Error Free Dental Supplies Company", False), ("name_en", "404 Al Zubeethash Establishment", False), ("name_en", "[Null Point Ceramics Est]", False), ("name_en", "<http://a.example/products>", False),
    ],
)
def test_residue(field, value, expected):
    assert residue.Reader(set()).residual(field, value) is expected


# One example at least of each alternative of WHOLE, in its order.
WHOLE_EXAMPLES = [
    ["HTTP 404"], ["Error 404", "405 Method Not Allowed", "406 Not Acceptable", "501 Not Implemented", "422 Unprocessable Entity", "410 Gone"],
    ["Method not allowed", "Not acceptable", "Not implemented", "Unprocessable entity"], ["Unexpected error", "Runtime exception"], ["Oops, something broke"],
    ["Something went wrong"], ["Warning: undefined variable on line 3"], ["Can't display profile", "Unable to open it"], ["DB reset", "Network error"],
    ["The site you are trying to reach is gone", "This listing has been removed"], ["Page expired"], ["Access restricted", "Access denied"],
    ["Insufficient permissions", "You do not have permission", "You don't have access", "Insufficient rights"], ["Your session has ended", "Link is invalid"], ["Signin required", "Login required"],
    ["Verifying your browser"], ["Just a moment"], ["This takes a few seconds"], ["Loading"], ["Timed out"], ["Request failed", "Blocked by mod_security here"],
    ["Under construction"], ["Please enable JavaScript"], ["JavaScript is disabled"], ["Cookies required"], ["Scripts are required"], ["Your browser is outdated"],
    ["Lorem ipsum"], ["asdfgh"], ["Your company profile", "Sample text"], ["Enter description"], ["Write something here"], ["Profile to be added", "Profile not provided"], ["Profile (max 500)"],
    ["Name of your business"], ["My company"], ["Please replace me"], ["Unknown", "N/A", "None"], ["undefined", "#N/A"], ["يرجى تفعيل جافا"], ["جافا سكربت معطل"],
    ["الصفحة غير موجودة"], ["حدث خطأ"], ["أدخل النص"], ["Bitte JavaScript aktivieren"], ["Seite nicht gefunden", "Erreur 404"],
]


def test_the_gate_passes_an_example_of_each_alternative():
    for i, found in enumerate(WHOLE_EXAMPLES):
        for x in found:
            assert residue.residual_piece(x), (i, x)
            assert residue.Reader(set()).residual("name_en", x), (i, x)
            assert residue.Reader(set()).residual("description_en", f"Acme builds pumps.\n{x}"), (i, x)


def test_left_over_slots_reach_unknown_syntaxes(spark):
    site = lambda i: f"http://firm{i}.test"
    rows = [{"pos": i, "website_url": site(i), "description_en": f"Call {{{{ v{i} }}}} for prices. We sell pumps to towns."} for i in range(60)]
    rows += [{"pos": 100, "website_url": site(100), "description_en": "Call :phone: for prices. We sell pumps to towns."}, {"pos": 101, "website_url": site(101), "description_en": "We sell pumps to towns."}]
    rows += [{"pos": 102}, {"pos": 103, "phone": "05XXXXXXXX", "name_en": "{name}"}, {"pos": 103, "phone": "05XXXXXXXX"}]
    got = {tuple(r) for r in residue.residue_reasons(listing(spark, rows)).collect()}
    assert {r[:2] for r in got} == {(i, "description_en") for i in [*range(60), 100]} | {(103, "phone"), (103, "name_en")}
    assert (100, "description_en", "slot") in got and (103, "phone", "blank") in got and (0, "description_en", "variable") in got
    found = residue.find_residue(listing(spark, rows)).collect()
    assert len(found) == len(set(found)) and residue.find_residue(listing(spark, [])).collect() == []


PAGES = ["The gate to this shelf is shut for today", "Kindly switch the lamp on to look at this shelf", "This shelf has been emptied by its keeper. Knock at the desk for %s", "القفل مغلق اليوم"]


def test_repeated_pages_are_found_without_any_phrase(spark, monkeypatch):
    """Made-up notices in words that no pattern knows; contents mix and speak of their company, copies of one stay one."""
    import random
    import re as regex

    monkeypatch.setattr(residue, "WHOLE", regex.compile(r"(?!)"))
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfjklmnrstz") + rng.choice("aiu") for _ in range(4))
    facts = [f"We keep {a} for {b} of the coast" for a in ("ropes", "lamps", "doors", "tiles", "locks", "rails") for b in ("dealers", "builders", "fishers", "farmers")]
    rows, want = [], set()
    for i in range(900):
        name = f"{word()} {word()} trading"
        row = {"pos": i, "name_en": name, "website_url": f"http://{word()}{i}.test/", "phone": f"011 {rng.randrange(10**6, 10**7)}"}
        row["description_en"] = ". ".join([f"{name} serves the coast"] * (rng.random() < 0.6) + rng.sample(facts, rng.randint(1, 3))) + "."
        if i % 7 == 0:
            page = PAGES[i // 7 % 4]
            row["description_en"] = page % name if "%" in page else page
            want.add((i, "description_en"))
        if i % 11 == 0:
            row["phone"] = "behind the red curtain"
            want.add((i, "phone"))
        if i % 13 == 0:
            row["name_en"] = "Shelf of the house"
            want.add((i, "name_en"))
        rows.append(row)
    rows += [{"pos": 5000 + i, "name_en": "Kabir Dunlas trading", "website_url": f"http://kabir.test/{i}", "description_en": "One more shop on the hill"} for i in range(300)]
    got = {tuple(r) for r in residue.find_residue(listing(spark, rows), phrases=False).collect()}
    extra = {(r["pos"], r["description_en"]) for r in rows if (r["pos"], "description_en") in got - want}
    assert not extra and got == want


# survivors


def test_usable_values():
    for v in ("123", "05XXXXXXXX", "call us", "+966", "{{phone}}", " ", None):
        assert not survivor.usable("phone", v)
    for v in ("526768968", "+966 (0) 15 3324288", "052.300.3684 ext. 62", "Tel: +966 15 834 2220"):
        assert survivor.usable("phone", v)
    for v in ("user@localhost", "info@", "sales@@shop", "[email protected]", "info at firm", "N/A"):
        assert not survivor.usable("email", v)
    assert survivor.usable("email", "hello2@dazazaay-trans.com.example")


def test_two_nearly_as_trusted_beat_the_most_trusted():
    t = lambda v: survivor.tokens_of("description_en", v)
    texts = list(map(t, ["We make blue pumps", "We make green pumps", "We make green pumps today"]))
    weight = lambda *c: [x**survivor.POWER for x in c]
    assert survivor.consensus(texts, weight(0.8, 0.78, 0.77)) == 1
    assert survivor.consensus(texts, weight(0.9, 0.6, 0.5)) == 0
    assert survivor.consensus([["x"], ["y", "z"]], [1.0, 1.0]) == 0 and survivor.consensus([[]], [1.0]) == 0


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from("abcd"), max_size=6), min_size=1, max_size=6), seed=st.integers(0, 9))
def test_the_vote_does_not_depend_on_the_order(texts, seed):
    import random

    texts = [list(t) for t in {tuple(t) for t in texts}]
    weights = [1.0 + 2.0**-i for i in range(len(texts))]
    order = random.Random(seed).sample(range(len(texts)), len(texts))
    assert order[survivor.consensus([texts[i] for i in order], [weights[i] for i in order])] == survivor.consensus(texts, weights)


def test_survivors(spark):
    t = lambda n: datetime.datetime(2024, 1, n)
    company = "id string, pos long, description_en string, phone string, email string, confidence_score double, updated_at timestamp, value string, trust double, group_id string"
    rows = [
        ("a", 1, "We make pumps for towns and fa...", "123", "a@x.example", 0.9, t(9), None, None, None),
        ("b", 2, "We make pumps for towns and farms.", "0112345678", None, 0.5, t(5), None, None, None),
        ("c", 3, None, "0119999998", "c@x.example", 0.7, t(7), None, None, None),
        ("c", 4, None, "0119999998", "c@x.example", 0.7, t(7), None, None, None),
        ("d", 5, "n/a", "none", "", None, None, None, None, None),
    ]
    groups = spark.createDataFrame([("g1", ["c", "a", "b", "a", "zz"], "r", "pending"), ("g2", ["d"], None, "resolved"), ("g3", None, None, None)], "id string, company_ids array<string>, reason string, status string")
    frame = spark.createDataFrame(rows, company)
    got = {(r.group_id, r.field_name): r.company_id for r in survivor.surviving_values(groups, frame).collect()}
    assert got == {("g1", "description_en"): "b", ("g1", "phone"): "c", ("g1", "email"): "a"}
    records = {r.group_id: r for r in survivor.surviving_records(groups, frame).collect()}
    assert set(records) == {"g1", "g2", "g3"} and records["g2"].phone is None
    assert survivor.surviving_values(groups.limit(0), frame).collect() == []


@pytest.mark.parametrize("hot_rows", [3, 10_000])
def test_large_groups_are_decided_like_small_ones(spark, monkeypatch, hot_rows):
    n, base = 70, datetime.datetime(2024, 1, 1)
    column = "id string, pos long, description_en string, phone string, email string, confidence_score double, updated_at timestamp"
    text = lambda i: f"We make {['blue', 'green'][i % 2]} pumps for {i % 5} towns and farm {i}"
    rows = [(f"c{i}", i, text(i), f"011 {1000000 + i % 9}", f"m{i}@x.example", 0.5 + i / n / 2, base + datetime.timedelta(days=i)) for i in range(n)]
    frame = spark.createDataFrame(rows, column)
    ids = [f"c{i}" for i in range(n)]
    groups = spark.createDataFrame([("g", ids), ("h", ids[:5]), ("i", ids[60:])], "id string, company_ids array<string>")
    apart = {tuple(r) for r in survivor.surviving_values(groups, frame, hot_rows).collect()}
    assert len(apart) == 9 and {r[0] for r in apart} == {"g", "h", "i"}
    monkeypatch.setattr(survivor, "CHUNK", 1000)
    assert {tuple(r) for r in survivor.surviving_values(groups, frame).collect()} == apart


def test_cut_beginnings_of_any_length_meet_their_continuation(spark):
    texts = ["We", "We make", "We make...", "We make …", "We make pumps for towns", "We make pumps for farms", "Other"]
    frame = spark.createDataFrame([(f"c{i}", i, t, None, None, 0.5, None) for i, t in enumerate(texts)], "id string, pos long, description_en string, phone string, email string, confidence_score double, updated_at timestamp")
    groups = spark.createDataFrame([("g", [f"c{i}" for i in range(7)]), ("h", ["c0", "c6"]), ("i", ["c2", "c3"])], "id string, company_ids array<string>")
    kept = {(r.group_id, r.company_id) for r in survivor.group_values(groups, frame).collect()}
    assert kept == {("g", "c4"), ("g", "c5"), ("g", "c6"), ("h", "c0"), ("h", "c6"), ("i", "c3")}


# names


@pytest.mark.parametrize(
    "a, b, same",
    [
        (["khabookhja", "raasid"], ["7abookhja", "rasid"], True), (["haqjathaaj", "shughkuz"], ["shughkuz", "hagjathaaj"], True),
        (["libbaak", "deeraaran"], ["لبباك", "ديرارن"], True), (["weekaanaz", "yakwoom"], ["weakaanaz", "yakouoom"], True),
        (["khabookhja", "raasid"], ["khabookhja", "zushzub"], False), (["raasid"], ["raasid"], False),
    ],
)
def test_token_assignment(a, b, same):
    assert names.same_names(a, b) is same and names.same_names(b, a) is same


@pytest.mark.parametrize(
    "a, b, short_a, short_b, same",
    [
        (["alphan", "bravod", "carter"], ["alphan", "bravod", "dunlop"], [], [], False),  # a third word contradicts
        (["alphan", "bravod", "carter"], ["alphan", "bravod"], [], [], True),
        (["alphan", "bravod", "carter"], ["alphan", "bravod", "dunlop"], [], ["c"], True),  # but its initial is there
        (["alphan", "carter"], ["alphan"], [], ["c"], True), (["alphan", "carter"], ["alphan"], [], ["crtr"], True),
        (["alphan", "carter"], ["alphan"], [], ["d"], False), (["alphan", "carter"], ["alphan"], [], [], False),
        (["alphan", "carter"], ["zulmun"], [], ["c"], False),
        ([f"w{c}kmun" for c in "abcdefghij"], ["wakmun", "wjkmun"], [], [], True),  # first and tenth of ten
    ],
)
def test_all_tokens_count_and_initials_stand_for_them(a, b, short_a, short_b, same):
    assert names.same_names(a, b, short_a, short_b) is same and names.same_names(b, a, short_b, short_a) is same


@settings(max_examples=150, deadline=None)
@given(cost=st.integers(1, 4).flatmap(lambda n: st.integers(n, 5).flatmap(lambda m: st.lists(st.lists(st.integers(0, 9), min_size=m, max_size=m), min_size=n, max_size=n))))
def test_assignment_is_optimal(cost):
    found = names.assignment(cost)
    assert len(set(found)) == len(found)
    least = min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(cost[0])), len(cost)))
    assert sum(cost[i][j] for i, j in enumerate(found)) == least


def test_long_names_and_initials_are_indexed(spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdfjklmnrstz") + rng.choice("aiu") for _ in range(4))
    rows = [{"pos": i, "name_en": f"{word()} {word()} Printing Company"} for i in range(200)]
    ten = [word() for _ in range(10)]
    rows += [{"pos": 1000, "name_en": " ".join(ten)}, {"pos": 1001, "name_en": f"{ten[9]} {ten[0]} Printing Co"}, {"pos": 1002, "name_en": f"{ten[4]} Printing {word()}"}]
    rows += [{"pos": 1003, "name_en": "Khabookhja Raasidmun Printing"}, {"pos": 1004, "name_en": "R. Khabookhja Printing Co"}, {"pos": 1005, "name_en": "Q. Khabookhja Printing Co"}]
    assert {tuple(r) for r in names.name_variants(listing(spark, rows)).collect() if r[0] >= 1000} == {(1000, 1001), (1003, 1004)}


@pytest.mark.parametrize("block_rows", [2, 1000])
def test_pairs_are_expanded_from_classes(spark, block_rows):
    from tallyard.llm import pairs

    members = [(p, 1) for p in range(1, 8)] + [(20, 20), (21, 20), (30, 30)]
    links = [(1, 20), (20, 30)]
    got = [tuple(r) for r in pairs.expand_pairs(spark.createDataFrame(members + members[:2], "pos long, rep long"), spark.createDataFrame(links, "ra long, rb long"), block_rows=block_rows).collect()]
    of = dict(members)
    want = {(x, y) for x, y in itertools.combinations(sorted(of), 2) if of[x] == of[y] or tuple(sorted((of[x], of[y]))) in links}
    assert set(got) == want and len(got) == len(want)
    sizes = pairs.class_sizes(spark.createDataFrame(members, "pos long, rep long"), spark.createDataFrame(links, "ra long, rb long")).collect()
    assert {(r.pos, r.n_links) for r in sizes} == {(p, {1: 1, 20: 2, 30: 1}[r]) for p, r in members}


@settings(max_examples=200, deadline=None)
@given(a=st.text(alphabet="abc", max_size=6), b=st.text(alphabet="abc", max_size=6), k=st.integers(0, 3))
def test_bounded_distance(a, b, k):
    assert names.edits(a, b, k) == min(osa(a, b), k + 1)
    assert names.near(a, b, k) == min(osa(a, b), k + 1)


def test_marks_part_most_candidates_and_no_spellings(spark):
    import random
    from collections import defaultdict

    rng = random.Random(4)
    arabic = str.maketrans({**dict(zip("bkrsKS", "بكرسخش")), "a": None, "u": None, "i": "ي"})
    consonant = lambda: rng.choice(["b", "k", "r", "s", "kh", "sh"])
    word = lambda: "".join(consonant() + rng.choice(["a", "u", "i"]) for _ in range(3)) + consonant()

    def typed(w):
        at = rng.randrange(1, len(w))
        return rng.choice([w, w[:at] + w[at + 1 :], w[:at] + rng.choice("aub") + w[at:], w[: at - 1] + w[at] + w[at - 1] + w[at + 1 :]])

    held = []
    for _ in range(400):
        two = [word(), word()]
        written = [w.replace("kh", "K").replace("sh", "S").translate(arabic) for w in two]
        held += [[typed(w) for w in two], [typed(w) for w in two[::-1]] + written, [*written], [*two, typed(written[0])], [*two, word()]]
    held = [(sorted(set(x)), ["k"] if rng.random() < 0.1 else []) for x in held]
    met = defaultdict(set)
    for n, (tokens, shorts) in enumerate(held):
        for k in names.index_keys(tokens, shorts, True):
            met[k].add(n)
    pairs = sorted({p for x in met.values() for p in itertools.combinations(sorted(x), 2)})
    marks = [[m - (1 << 64) if m >> 63 else m for m in names.name_marks(*x)] for x in held]
    columns = ", ".join(f"{p}{c} long" for p in ("x_", "y_") for c in names.MARKS)
    frame = spark.createDataFrame([(a, b, *marks[a], *marks[b]) for a, b in pairs], f"a long, b long, {columns}")
    kept = {(r.a, r.b) for r in frame.filter(names.marks_allow("x_", "y_")).select("a", "b").collect()}
    same = {(a, b) for a, b in pairs if names.same_names(held[a][0], held[b][0], held[a][1], held[b][1])}
    marked = [p for p in pairs if marks[p[0]][0] and marks[p[1]][0] and p not in same]
    assert len(same) > 1000 and same <= kept
    assert len(marked) > 1000 and sum(p in kept for p in marked) < 0.3 * len(marked)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="abCDkhsg7w '-واليؤئأآةىـًÉßﻻ1٣", max_size=12))
def test_words_met_together_have_the_forms_of_each(text):
    import unicodedata

    t = unicodedata.normalize("NFD", names._TATWEEL.sub("", unicodedata.normalize("NFKC", text)).translate(names._ALEF).casefold())
    assert names.fold(text) == "".join(c for c in t if not unicodedata.combining(c))
    found = set(names.words(text)) | {"khabookhja", "الخبوخج"}
    names._MET.clear()
    names.learn_forms(found)
    together = dict(names._MET)
    for w in found:
        names._MET.clear()
        assert together[w] == (names.coarse(w), names.spelling(w), names.across(w))
    one, other = names.Tokenizer({"printing", "company", "للطباعة"}), names.Tokenizer({"printing", "company", "للطباعة"})
    found |= {"printng", "prntg", "pritningg", "companyprinting", "raasid", "للطباع"}
    one.learn(found)
    assert one._known == {w: other.ordinary(w) for w in found}


def test_variants(spark):
    filler = [{"pos": 1000 + i, "name_en": f"Q{i % 7}zv{i}k M{i}rtb Printing Company"} for i in range(60)]
    rows = [
        {"pos": 1, "name_en": "Al Khabookhja & Raasid Printing Company"}, {"pos": 2, "name_en": "printing co. rasid 7abookhja"},
        {"pos": 3, "name_en": "KRP Co", "name_ar": "شركة الخبوخج وراسد للطباعة"}, {"pos": 4, "name_en": "Al Khabookhja & Zushzub Printing Company"},
        {"pos": 5, "name_en": "Al Khabookhja & Raasid Printing Company"}, {"pos": 5, "name_en": "Al Khabookhja & Raasid Printing Company"},
        {"pos": 6}, {"pos": 7, "name_en": "KRP Co"}, {"pos": 8, "name_en": "KRP Co"}, {"pos": 9, "name_en": "long " + "word " * 3000},
    ]
    got = [tuple(r) for r in names.name_variants(listing(spark, rows + filler)).collect()]
    mine = {p for p in got if p[0] < 1000}
    assert mine == {(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5)}
    assert len(got) == len(set(got))
    assert names.name_variants(listing(spark, [])).collect() == []


@pytest.mark.parametrize("copies", [30, 300])
def test_an_organisation_with_many_rows_keeps_its_words(spark, copies):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfjklmnrstz") + rng.choice("aiu") for _ in range(4))
    rows = [{"pos": i, "name_en": f"{word()} {word()} Printing Company"} for i in range(400)]
    typed = ["Khabookhja", "Khaboohkja", "Khabookhjaa", "Khaboookhja", "Khabokhja"]
    hot = [{"pos": 1000 + i, "name_en": f"{typed[i % 5]} Raasidmun {'Printing' if i % 2 else 'Prntg'} Co {'.' * (i // 10)}"} for i in range(copies)]
    got = {tuple(r) for r in names.name_variants(listing(spark, rows + hot)).collect() if r[0] >= 1000}
    assert got == set(itertools.combinations(range(1000, 1000 + copies), 2))
    shared = names.shared_words(listing(spark, rows + hot), "name_en", "name_ar")
    assert {"printing", "company"} <= shared and not {"khabookhja", "raasidmun"} & shared


def test_equal_names_with_one_own_word_are_linked(spark):
    rows = [{"pos": i, "name_en": f"Q{i % 7}zv{i}k M{i}rtb Printing Company"} for i in range(60)]
    rows += [{"pos": 1000 + i, "name_en": x} for i, x in enumerate(["Khabookhja Printing Co", "Khabookhja Printing Co", "Khabookhja Printing Ltd", "Printing Co", "Printing Co"])]
    assert {tuple(r) for r in names.name_variants(listing(spark, rows)).collect() if r[0] >= 1000} == {(1000, 1001)}


# addresses


@pytest.mark.parametrize(
    "text, number",
    [
        ("Bldg. 9611 Ghabqeegh Street, Port 59100-8747, K.S.A", "9611"), ("7760 koolamlee rd, ghimaarshi", "7760"),
        ("5th Floor, Building No. 8646 Biddaab Road, 12100-6048", "8646"), ("P.O. Box 148300, Ziwaamshi", None),
        ("١٨٤٦ شارع رتيتث، وادي ٦٦١٠٠-٥٠٥٦", "1846"), ("Wadi Zaabiy Industrial Area", None), ("Office 34, Takhsees Lane, No. 3394", "3394"), ("Bareef 29500", None),
    ],
)
def test_house_numbers(text, number):
    assert addresses.read_address(text)[0] == number


@settings(max_examples=200, deadline=None)
@given(data=st.lists(st.dictionaries(st.integers(0, 9), st.floats(0.1, 3), min_size=1, max_size=6), min_size=2, max_size=6))
def test_prefixes_lose_no_pair(data):
    weight = {}
    vectors = []
    for row in data:
        table = {i: 1.0 + i / 7 for i in row}
        weight |= table
        vectors.append(addresses.vector(sorted(table), weight))
    for a, b in itertools.combinations(vectors, 2):
        if addresses.cosine(a, b) >= 0.5:
            assert set(addresses.prefix(*a, 0.5)) & set(addresses.prefix(*b, 0.5))


@pytest.mark.parametrize("a, b, same", [("12", "12", True), ("12", "12a", True), ("12a", "12b", False), ("12", "13", False), ("120", "12", False)])
def test_letters_behind_a_number(a, b, same):
    assert addresses.compatible(a, b) is same and addresses.compatible(b, a) is same


def test_same_buildings(spark):
    texts = {
        1: "Bldg 1076 Jamooztha Jifjaat Lane | Dawmoogh Dt | Ghimaarshi 71500-4711", 2: "no. 1076 jamooztha jifjaat lane - ghimaarshi 71500 - k.s.a",
        3: "1076 شارع جموزث جفجات، حي دوموغ، غمارش 71500-4711", 4: "Bldg 1077 Jamooztha Jifjaat Lane, Ghimaarshi 71500", 5: "1076 Thooralhee Dizaabsi Road, Bareef 29500",
        6: None, 7: " ", 8: "Ghimaarshi, KSA", 9: "Bldg 1076 Jamooztha Jifjaat Lane | Dawmoogh Dt | Ghimaarshi 71500-4711", 10: "7th Floor, Bldg 1076 Jamoztha Jifjaat Ln., Ghimaarshi",
    }
    rows = [{"pos": p, "full_address": t} for p, t in texts.items()] + [{"pos": 9, "full_address": texts[9]}]
    rows += [{"pos": 100 + i, "full_address": f"{2000 + i} Zuseekab{i} Khitfaaz{i * 7} Road, Wadi Mathhoor {40000 + i}"} for i in range(40)]
    got = [tuple(r) for r in addresses.same_buildings(listing(spark, rows)).collect()]
    members = (1, 2, 3, 9, 10)
    assert set(got) == {(a, b) for a in members for b in members if a < b} and len(got) == len(set(got))
    assert addresses.same_buildings(listing(spark, [])).collect() == []


def test_a_busy_building_keeps_its_words(spark):
    rows = [{"pos": i, "full_address": f"{3000 + i} {a}{b}rtaab {b}{a}lseem Road, Mathhoor"} for i, (a, b) in enumerate(itertools.product("bdfjklmnrstz", "bdfjklmnrstz"))]
    busy = [f"Bldg 1076 Jamooztha Jifjaat Lane, {'Khalkeek Zaabiy Thafsoon' if i % 2 else 'Dufaam'} {'-' * i}, Mathhoor" for i in range(60)]
    rows += [{"pos": 1000 + i, "full_address": x} for i, x in enumerate(busy)]
    rows += [{"pos": 2000, "full_address": "1076 Hightaam Bareef Road, Mathhoor"}]
    got = {tuple(r) for r in addresses.same_buildings(listing(spark, rows)).collect() if r[0] >= 1000}
    assert got == set(itertools.combinations(range(1000, 1060), 2))
    words = spark.createDataFrame([(sorted(set(addresses.read_address(r["full_address"])[2])),) for r in rows], "words array<string>")
    assert addresses.common_words(words, len(rows)) == {"mathhoor"}


# matching


def test_contacts():
    assert matching.phone_of("+966 (0) 15 3324288") == matching.phone_of("0153324288 ext. 5") == "153324288"
    assert matching.phone_of("05XXXXXXXX") is None and matching.phone_of("1111111111") is None
    assert matching.site_of(" HTTPS://WWW.A-b.Example/x?y") == "a-b.example" and matching.site_of("coming soon") is None
    assert matching.acronym_of("L.D.T. Fact.") == "dlt" and matching.acronym_of("Acme Pumps") == ""


def test_minhash_recall_on_mistyped_names():
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdfghjklmnrstz") + rng.choice("aeiou") for _ in range(4))
    met = total = 0
    for _ in range(300):
        a = [word(), word()]
        b = list(a)
        i = rng.randrange(2)
        at = rng.randrange(1, 7)
        b[i] = b[i][:at] + rng.choice("bdfgklmn") + b[i][at + 1 :]
        keys = [set(matching.bands_of(matching.shingles([names.spelling(t) for t in x]), "n")) for x in (a, b)]
        met, total = met + bool(keys[0] & keys[1]), total + 1
    assert met / total >= 0.9


@pytest.mark.parametrize("crossing", [True, False])
def test_minhash_recall_across_scripts_and_on_names_mistyped_twice(crossing):
    """Against brute force: of the pairs whose shingles have a similarity of 0.2 to 0.3, at least 0.9 share a key."""
    import random

    rng = random.Random(11)
    arabic = dict(zip("btjdrzsfklmn", "بتجدرزسفكلمن"))
    write = lambda word: "".join(arabic[c] for c in word) if crossing else "".join(c + "a" for c in word)
    form = names.across if crossing else names.spelling
    met = total = 0
    while total < 400:
        a = ["".join(rng.sample(sorted(arabic), rng.randrange(4, 7))) for _ in range(2)]
        b = [w[: (at := rng.randrange(len(w)))] + rng.choice(sorted(arabic)) + w[at + 1 :] for w in a]
        left, right = ["".join(c + "a" for c in w) for w in a], [write(w) for w in b]
        x, y = (matching.shingles([form(w) for w in side]) for side in (left, right))
        if 0.2 <= len(x & y) / len(x | y) <= 0.3:
            total += 1
            met += bool(set(matching.name_keys(left, [], "l")) & set(matching.name_keys(right, [], "r")))
    assert met / total >= 0.9


def test_attributes_block_together_and_long_names_are_met(spark):
    """A trade name with one word meets by a mistyped word and the telephone; the ends of a name of ten words are found."""
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bdfghjklmnrstz") + rng.choice("aeiou") for _ in range(5))
    met = 0
    for i in range(200):
        name, number, host = word(), f"1{rng.randrange(10**8):08d}", word() + ".example"
        typed = name[:3] + "k" + name[4:]
        other = host[:4] + host[5:] if i % 2 else None
        met += bool(set(matching.cross_keys([name], host, number)) & set(matching.cross_keys([typed], other, number)))
    assert met >= 180
    ten = [word() for _ in range(10)]
    assert set(matching.name_keys(ten, [], "l")) & set(matching.name_keys([ten[0], ten[9]], [], "r"))
    assert set(matching.name_keys([ten[0], ten[9]], [], "l")) & set(matching.name_keys(ten, [], "r"))
    f = dict(zip(matching.FEATURES, matching.features_of(*({"tokens": ["x"], "slug": [], "trades": [], "initials": [], "acronym": "", "site": x, "phone": p} for x, p in (("ab.example", "152345678"), ("ac.example", "152345679"))))))
    assert f["site_likeness"] == f["phone_likeness"] == 1 - 1 / 3 and f["same_site"] == 0


def test_sources_are_matched(spark):
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["b", "d", "gh", "j", "kh", "l", "m", "n", "r", "sh", "t", "z"]) + rng.choice(["aa", "oo", "ee", "u", "i"]) for _ in range(3)) + rng.choice("bdfjlmn")
    left, right, truth = [], [], set()
    for i in range(150):
        a, b = word(), word()
        phone, site = f"0{11 + i % 3}{rng.randrange(10**7):07d}1"[:10], f"https://www.{a}-{b}.example"
        left.append({"pos": i, "name_en": f"Al {a.title()} & {b.title()} Printing Company", "website_url": site if i % 3 else None, "phone": phone, "source_url": f"https://m.example/firm/al-{a}-{b}-printing-company-{i}"})
        if i % 2:
            typed = a[:2] + a[3:] if i % 4 == 1 else a
            right.append({"pos": 1000 + i, "name_en": f"{b.title()} {typed.title()} printing co", "website_url": site, "phone": phone if i % 5 else None, "source_url": "https://p.example/search?p=2"})
            truth.add((i, 1000 + i))
    right += [{"pos": 2000}, {"pos": 2001, "name_en": ""}, {"pos": 2002, "name_en": "Zaqjo Brand", "website_url": left[1]["website_url"], "phone": left[1]["phone"]}]
    got = {(r.left_pos, r.right_pos): r.confidence for r in matching.match_sources(listing(spark, left), listing(spark, right)).collect()}
    found = {p for p, c in got.items() if c >= 0.5}
    assert all(0 <= c <= 1 for c in got.values())
    assert len(found & truth) >= 0.9 * len(truth) and len(found - truth - {(1, 2002)}) <= 0.05 * len(truth)
    assert matching.match_sources(listing(spark, []), listing(spark, right)).collect() == []


def test_calibration_needs_both_labels():
    import numpy as np

    model = matching.Classifier.train(np.zeros((0, len(matching.FEATURES))), np.zeros(0), np.zeros(0, dtype=bool))
    strong = [1, 1, 1, 0, 0, 1, 0, 1, 0, 1, 1, 0, 1, 1]
    weak = [0, 0.1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0]
    high, low = model.confidence(np.array([strong, weak], dtype=float))
    assert high > 0.9 and low < 0.1
