import random

import pytest

from palimpsest.llm import names

ALIASES = {"bob": ["robert"], "sam": ["samuel", "samantha"], "mfg": ["manufacturing"]}
READINGS = {"沐": "mu", "霁": "ji", "珏": "jue"}


def keys(name, alone=True):
    return [set(k) for k in names.name_keys(name, ALIASES, READINGS, alone)]


@pytest.mark.parametrize("name", ["Robert Klavik", "robert KLAVIK", "Klavik, Robert", "Dr. Robert Klavik", "Bob Klavik", "Robert J. Klavik", "Robert Klavik (nurse)", "Robert Klavik, Old Ferry", "Robert Klavik / lead", "robert.klavik", "Róbert Klavik"])
def test_spelt_in_full(name):
    assert "f klavik robert" in keys(name)[0]


@pytest.mark.parametrize("name", ["R. Klavik", "rklavik", "Klavik R."])
def test_initials(name):
    assert "i r klavik" in keys(name)[1] & keys("Robert Klavik")[1]


def test_firms_and_chinese_names():
    assert "f glass hibrand works" in keys("Hibrand Glass Works Ltd.")[0] & keys("The Glass Works Hibrand")[0]
    assert "j hibrandglassworks" in keys("HibrandGlass Works")[0] & keys("Hibrand-Glass Works GmbH")[0]
    assert "c hgwl" in keys("HGWL")[1] & keys("Hibrand Glass Works Limited")[1]
    assert "p jijue mu" in keys("沐霁珏")[1] & keys("Mu Ji-Jue")[1] & keys("Jijue Mu")[1]
    assert keys("沐霁珏老师")[0] == {"h 沐霁珏"} and "s 沐" in keys("沐工")[1]
    assert keys("Sam Klavik")[0] == set() and "f klavik samuel" in keys("Sam Klavik")[1]
    assert keys("Bob", alone=False) == [set(), set()] and keys("") == [set(), set()]


def test_readings_add_up():
    aliases = {f"n{i}": [f"long{i}", f"other{i}"] for i in range(12)}
    strong, weak = names.name_keys(" ".join(aliases), aliases, {}, True)
    assert strong == [] and sum(k[0] == "f" for k in weak) == 13  # not 4,096
    for i in range(12):  # the later reading of every word is there, beyond the eighth, too
        assert any(k[0] == "f" and f"other{i}" in k.split() for k in weak)


def test_hint_texts():
    assert names.hint_texts(["Team: Frost Lab", "Quillon office", "", None, "nurse"], "负责frost lab的人员，驻Quillon") == [
        {"text": "team frost lab", "bare": True}, {"text": "quillon office", "bare": True}, {"text": "nurse", "bare": True},
        {"text": "负责 frost lab 的人员 驻 quillon", "bare": False},
    ]
    assert names.hint_texts(None, None) == []


def test_values_get_the_kind_of_their_places(spark):
    told = [(q, True) for v in ("quillon", "old ferry", "velmouth") for q in (v, f"{v} office", f"based in {v}")]
    told += [(q, True) for v in ("frost lab", "grain desk", "field audit") for q in (v, f"team {v}")]
    told += [("someone of frost lab in quillon", False), ("nurse", True), ("room 12", True), ("room 13", True), ("room 14", True), ("based in 石溪", True), ("石溪", True)]
    got = {(r.text, r.kind, r.value) for r in names.hint_values(spark.createDataFrame(told, "text string, bare boolean")).collect()}
    kind = {v: k for _, k, v in got}
    assert kind["quillon"] == kind["old ferry"] == kind["velmouth"] == "in $" and kind["frost lab"] == kind["grain desk"] == "team $"
    assert kind["12"] == "room $" and kind["nurse"] == "-" and kind["石溪"] == "in $ han"
    assert {(k, v) for t, k, v in got if t == "someone of frost lab in quillon"} == {("team $", "frost lab"), ("in $", "quillon")}
    assert "based in quillon" not in kind
    assert names.hint_values(spark.createDataFrame([], "text string, bare boolean")).count() == 0


def edits(a, b):
    if a == b:
        return False
    near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in near or a in {b[:i] + b[i + 1 :] for i in range(len(b))} or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)


def distance(a, b):
    """Damerau-Levenshtein, with swaps of neighbours between which letters were put in or out, by its definition."""
    last, d = {}, {(-1, -1): len(a) + len(b)}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = len(a) + len(b), i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = len(a) + len(b), j
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            k, c = last.get(b[j - 1], 0), column
            if a[i - 1] == b[j - 1]:
                column = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, c - 1] + i - k + j - c - 1)
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_distances_are_a_metric():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 9))) for _ in range(40)]
    for p in words:
        assert list(names.edit_distances(words, p)) == [distance(w, p) for w in words]
    d = {(a, b): distance(a, b) for a in words for b in words}
    assert all(d[a, c] <= d[a, b] + d[b, c] for a in words for b in words for c in words)
    assert list(names.edit_distances(["x" * 5_000, "x" * (names.FAR - 1)], "")) == [names.FAR, names.FAR - 1]


@pytest.mark.parametrize("cell", [8, 40, 100_000])
def test_metric_join_matches_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(names, "BLOCK", cell)
    monkeypatch.setattr(names, "CELL", cell)  # many cells, split again and again, and blocks of what is left; or one cell
    rnd = random.Random(7)
    forms = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(7, 11))) for _ in range(150)} | {"q" * 300, "q" * 299, "q" * 297}
    forms |= {f"{x} {y}" for x in ("roberta", "robertino") for y in ("klavik", "klavki", "klaavik", "glavik", "klavi")}
    points = [("s", "f", f) for f in forms] + [("t", "f", min(forms)), ("s", "j", max(forms))]
    points = spark.createDataFrame(points, "memory_space string, kind string, form string")
    got = sorted((r.form_a, r.form_b) for r in names.near_points(points).collect())
    long = [f for f in forms if len(f) >= names.SHORTEST]
    assert got == sorted((a, b) for a in long for b in long if a < b and distance(a, b) == 1)
    cells = names.metric_cells(points)
    copies = cells.where("memory_space = 's' AND kind = 'f'").count()
    assert copies == len(forms) if cell == 100_000 else copies > len(forms)
    sizes = cells.groupBy("cell").count()
    assert sizes.selectExpr("max(count)").first()[0] <= 3 * cell


DRAFT = "draft_id string, memory_space string, who string, surface_forms array<string>, stable_qualifiers array<string>, definition string, entity string"


def test_pairs(spark):
    frost = "someone of the frost lab group in Quillon"
    rows = [
        ("D1", "s", "Robert Klavik", ["Robert Klavik"], ["team: frost lab"], frost, "x"),
        ("d1", "s", "Robert Klavik", ["Robert Klavik"], ["team: frost lab"], frost, "x"),
        ("d2", "s", "Bob Klavik", None, ["frost lab"], None, "x"),
        ("d3", "s", "Klavik, Robert", [None, ""], None, None, "x"),
        ("d4", "s", "Robert Klavki", [], ["member of frost lab"], "", "x"),
        ("d5", "s", "R. Klavik", [], ["frost lab team", "Quillon office"], "", "x"),
        ("d6", "s", "Maria Klavik", [], ["grain desk team", "grain desk"], "", "x"),
        ("d7", "t", "Bob Klavik", [], ["frost lab"], "", "x"),
        ("d8", "s", "Robert Klavik", [], ["team: frost lab"], frost, "x"),
        (None, "s", "Bob Klavik", [], ["frost lab"], "", "x"),
        ("d9", None, "Bob Klavik", [], ["frost lab"], "", "x"),
        ("e1", "s", None, None, None, None, "x"),
        ("e2", "s", "", [""], [""], "", "x"),
    ]
    aliases = spark.createDataFrame([("given_name", "bob", "robert"), (None, None, "x")], "alias_kind string, short_form string, full_form string")
    drafts = spark.createDataFrame(rows, DRAFT)
    got = sorted(tuple(r) for r in names.variant_pairs(drafts, aliases).collect())
    group = ["d1", "d2", "d3", "d4", "d5", "d8"]
    want = sorted((a, b) for a in group for b in group if a < b and {a, b} != {"d1", "d8"})
    assert got == want
    assert names.variant_pairs(drafts.limit(0), aliases.limit(0)).count() == 0


def test_namesakes_stay_apart(spark):
    rows = [("d1", "s", "Ines Nonand", [], ["team: frost lab", "based in Quillon"], "", "x"), ("d2", "s", "ines nonand", [], ["team: frost lab"], "", "x"), ("d3", "s", "INES NONAND", [], ["team: grain desk", "based in Norrfell"], "", "x")]
    # drafts of other spaces, from which it is learned what qualifiers state
    for i, (team, city) in enumerate([("frost lab", "Quillon"), ("grain desk", "Norrfell"), ("field audit", "Velmouth")]):
        rows += [(f"o{i}", f"o{i}", "", [], [team, city], "", "x"), (f"p{i}", f"p{i}", "", [], [f"team: {team}", f"based in {city}"], "", "x")]
    aliases = spark.createDataFrame([], "alias_kind string, short_form string, full_form string")
    assert [tuple(r) for r in names.variant_pairs(spark.createDataFrame(rows, DRAFT), aliases).collect()] == [("d1", "d2")]
