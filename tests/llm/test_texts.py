"""Look-alikes, sentence boundaries, truncation and scanned pages."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import boundaries, lookalikes, scans, truncation

SENT = "row_id bigint, english string, source_name string, text string, key string, field string, starts int"


def sentences(spark, texts):
    return spark.createDataFrame([(i, t, s, "c", "c", "c", 0) for i, (t, s) in enumerate(texts)], SENT)


# look-alikes

SAME = [
    ["Zoë saw a map.", "Zoë saw a map.", "Zo​ë saw a map.", "Ｚｏë saw a map.", "Zoë ѕаw a mар.", "﻿Zoë saw a　map.‍"],
    ["ﬁve-foot", "five‑foot", "five-foot", "five‐fo­ot"],
    ["Кот", "Kот"],
    ["соp", "cоp"],  # no writing in one script occurs; two lead to the same
    ["жaz λо", "жаz λο"],
]
OTHER = ["Zoe saw a map.", "zoë saw a map.", "Zoë saw a map!", "Zoë  saw a map.", "Zoë saw a map. ", "five–foot", "Zoë saw\ta map.", "Zoë saw a\nmap.", "", "​", None, "кот"]


def test_pairs(spark):
    texts = [t for g in SAME for t in g] + OTHER + ["Zoë saw a map."]
    lib = spark.createDataFrame([(1, "Zoë saw a map.", "x"), (2, "Zoë saw a map.", "x")], "row_id bigint, title string, field string")
    df = lookalikes.fields(sentences(spark, [(t, None) for t in texts]), lib)
    groups = defaultdict(list)
    at = 0
    for k, g in enumerate(SAME):
        for t in g:
            groups[k].append((at, t))
            at += 1
    groups[0].append((len(texts) - 1, "Zoë saw a map."))
    groups["empty"] = [(texts.index(""), ""), (texts.index("​"), "​")]
    expected = {("sentences.english", min(a, b), max(a, b)) for g in groups.values() for a, x in g for b, y in g if x != y} | {("course_library.title", 1, 2)}
    got = [tuple(r) for r in lookalikes.pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert lookalikes.pairs(df.limit(0)).count() == 0


def test_only_words_of_the_corpus_are_repaired(spark):
    texts = ["the cat", "tһе сat", "Ѕamo", "Привет, мир", "Пpивет", "a" * 100_000]
    got = {r.row_id: r.text for r in lookalikes.canonical(sentences(spark, [(t, None) for t in texts]).selectExpr("'f' as field", "row_id", "english as raw")).collect()}
    assert got[1] == "the cat" and got[2] == "Ѕamo" and got[3] == "Привет, мир" and got[4] == "Привет" and len(got[5]) == 100_000


def test_dominant_script():
    assert lookalikes.dominant("расkеd") == "packed" and lookalikes.dominant("Пpивет") == "Привет" and lookalikes.dominant("cat") is None and lookalikes.dominant("жz") is None
    assert lookalikes.target("соp") == lookalikes.target("сор") == "cop" and lookalikes.target("Kот") == "Кот" and lookalikes.target("жаz") == "жaz" and lookalikes.target("λо") == "λο"


def test_pairs_come_by_the_repair(spark, monkeypatch):
    """Without the vocabulary's repair the differently written words stay apart; an unattested writing isn't replaced."""
    df = sentences(spark, [(t, None) for t in ("a cat", "a сat", "a саt", "a dоg")]).selectExpr("'f' as field", "row_id", "english as raw")
    assert sorted((r.row_id_a, r.row_id_b) for r in lookalikes.pairs(df).collect()) == [(0, 1), (0, 2), (1, 2)]
    assert sorted(tuple(r)[1:] for r in lookalikes.classes(df).collect()) == [(0, 0, 3), (1, 0, 3), (2, 0, 3)]
    assert {r.row_id: r.form for r in lookalikes.forms(df).collect()} == {0: "a cat", 1: "a cat", 2: "a cat", 3: "a dоg"}
    monkeypatch.setattr(lookalikes, "target", lambda w: w)
    assert [lookalikes.suspects(t) for t in ("a сat", "a саt")] == [[], []]


def test_a_class_of_many_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "SHARE", 5)
    df = sentences(spark, [("a cat" if i % 4 else "a сat", None) for i in range(60)]).selectExpr("'f' as field", "row_id", "english as raw")
    assert lookalikes.pairs(df).distinct().count() == lookalikes.pairs(df).count() == 15 * 45 and lookalikes.classes(df).count() == 60


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20))
def test_cleaning_twice_is_cleaning_once(t):
    c = lookalikes.clean(t)
    assert lookalikes.clean(c) == c and all(lookalikes.target(lookalikes.target(w)) == lookalikes.target(w) for w in c.split())


# boundaries

SPLIT = [
    "It rained.| Did it stop?| Yes!", "Mr. Fox met Dr. J. K. Row on Mt. Hill.| They sat.", "See Fig. 3 and pp. 4-5 of Vol. 2.| It cost $3.50.", "It is 3 ft. 7 in. tall.| Good.", "They met at 6 p.m. near it.| At 7 p.m.| Tom left.",
    "“No!” cried Tom, and ran.| “Stop!” Tom shouted near it.| “It is lost.”| It cost much.", 'Ann said, "It is late."| It was.| "Is it?" asked Tom.| (Tom never came.)| He did.', "Wait... is that it?| She waited...| Then she left.", "Tom (how odd!) came.|Ann left.",
    "Who did it?!| Tom.", "小猫来了。|“快看！”小狗大声说。|老师问：“在哪里？”|谁来了？|他想了想……又走了。", "猫が来た。|鳥は「行こう！」と言いました。|犬も来た！", "लड़की आई।| बिल्ली गई।",
    "وجد القط حجرا؟| رسم الولد.", "Кот пришёл.| Рыба ушла!", "แมวมา| นกไป 3 ใบ| เด็กมา", "no mark\n\n|next part", "¿Quién vino?| ¡Mira!| Sí.", "Saved a.txt in version 6.1.6.| On Aug. 7 Tom left.| It was Tom vs. Ann.", "第一句。| Did Sefa see it?| 好！",
    "„Komm!“ sagte er.| Sie kam.| „Ja.“| Er ging.", "»Komm!« rief er.| Ja.| «Viens!»| Il vint.", "‚Nein.‘| Dann ging er.", "“No.”| “Yes.”| He left.", "The U.S. Army came to see J.K.Row.| Yes.", "I saw " + "y" * 30 + ".| Now.",
]


@pytest.mark.parametrize("marked", SPLIT)
def test_boundaries(marked):
    text, expected, at = marked.replace("|", ""), [], 0
    for part in marked.split("|")[:-1]:
        at += len(part)
        expected.append(at + len(text[at:]) - len(text[at:].lstrip()))
    assert boundaries.starts([text])[0] == expected


def test_chunks_of_a_long_text():
    text = "It rained. " * 50_000
    assert boundaries.starts(["", text, "A b. C"]) == [[], [11 * i for i in range(1, 50_000)], [5]]


def test_words_are_learnt_from_the_corpus(spark):
    """Titles and verbs of speaking that no list has; names that end sentences aren't taken for titles."""
    names = ["Reyes", "Orlov", "Tanaka", "Brandt"]
    texts = [f"Yesterday Supt. {n} came to Keld. It rained in Keld." for n in names * 3] + [f'"It rains," {n} grumbled. "Stop!" {n} ran on.' for n in names * 3] + [f"{n} grumbled, “Come here.”" for n in names] + [f"It is near Pelo. {x} ran." for x in ("She", "He", "They")] * 2 + ["And she ran, but he and they ran on."] * 9
    df = sentences(spark, [(t, None) for t in texts])
    words = boundaries.learnt(df)
    assert words.names - boundaries.BEFORE_NAME == {"supt"} and words.verbs - set(boundaries.SPEAKING) == {"grumbled"}
    got = {r.row_id: r.starts for r in boundaries.marked(sentences(spark, [*[(t, None) for t in texts], ('“Go!” Reyes grumbled. “Go!” Reyes ran. Supt. Orlov sat.', None)])).collect()}
    assert got[0] == [texts[0].index("It")] and got[len(texts)] == [22, 28, 39]
    assert boundaries.learnt(df.limit(0)).names == boundaries.BEFORE_NAME


def test_many_stops_in_one_word_cost_no_more():
    assert boundaries.starts(["a." * 300_000]) == [[]]


def test_units(spark):
    texts = ["One. Two!", None, "", "  ", "no mark", "猫。 狗。"]
    df = sentences(spark, [(t, None) for t in texts])
    got = sorted((r.row_id, r.seq, r.start_pos, r.sentence) for r in boundaries.units(df).collect())
    assert got == [(0, 1, 0, "One."), (0, 2, 5, "Two!"), (4, 1, 0, "no mark"), (5, 1, 0, "猫。"), (5, 2, 3, "狗。")]
    assert sorted(map(tuple, boundaries.found(df).collect())) == [(0, 5), (5, 3)] and boundaries.found(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aA.!? \n“”\"'。猫ก1(),"), max_size=15), max_size=5))
def test_texts_dont_touch_each_other(texts):
    assert boundaries.starts(texts) == [boundaries.starts([t])[0] for t in texts]
    for t, b in zip(texts, boundaries.starts(texts)):
        assert b == sorted(set(b)) and all(0 < x < len(t) and not t[x].isspace() for x in b)


# truncation


def _corpus(n, rng):
    names, things, places = ["Tara", "Milo", "Suna", "Noor"], ["kettle", "rocket", "garden", "lantern", "umbrella"], ["behind the harbor", "near the station", "under the old bridge", "beyond the valley"]
    out = []
    for _ in range(n):
        out.append(" ".join(f"{rng.choice(names)} {rng.choice(['saw', 'lifted', 'painted', 'followed'])} the {rng.choice(['quiet', 'red', 'enormous'])} {rng.choice(things)} {rng.choice(places)}." for _ in range(rng.randint(1, 3))))
    return out


def test_limits_and_cuts(spark):
    rng = random.Random(3)
    texts, truth = [], set()
    for source in ("whole", "short", "bytes", "dots"):
        for t in _corpus(900, rng):
            if source == "bytes" and rng.random() < 0.2:
                t = "猫が来た。" + t
            c = t
            if source == "short":
                c = t[:60]
            elif source == "bytes":
                c = t.encode()[:70].decode(errors="ignore")
            elif source == "dots" and len(t) > 50:
                c = t[:49] + "…"
            if c != t and not c.endswith("."):
                truth.add(len(texts))
            texts.append((c, source))
    texts += [("Tara saw the red kettle near the station", "whole"), ("Tara saw the red ket", "whole"), ("Words to Know", "whole"), ("Chapter 3", "whole"), ("Milo waited—", "whole"), ("Milo saw it near the station…", "whole"), (None, "whole"), ("", "whole"), ("x" * 200_000 + ".", None), ("แมวมา", None)]
    cut = len(texts) - 9
    df = sentences(spark, texts)
    limits = {(r.source_name, r.unit, r.length) for r in truncation.limits(truncation.judged(df)).collect()}
    assert limits == {("short", "chars", 60), ("bytes", "bytes", 70), ("dots", "chars", 50)}
    got = {r[0] for r in truncation.found(df).collect()}
    assert cut in got and not got & {cut - 1, cut + 2, cut + 3, cut + 4, cut + 5, cut + 6}
    found = {x for x in got if x < 3600}
    assert len(found & truth) >= 0.97 * len(truth) and len(found - truth) <= 0.02 * len(truth)
    shares = {r.source_name: r for r in truncation.by_source(df).collect()}
    assert shares["short"].cut_share > 0.5 and None in shares and all(r.n_cut == r.n_limit + r.n_transfer and (r.transfer_error or 0) < 0.01 for r in shares.values())
    how = {r.row_id: r.how for r in truncation.cuts(df).collect()}
    assert {how[x] for x in found & truth} == {"limit"} and how[cut] == "transfer" and how[cut - 1] is None
    assert {r.length: (r.n, r.at_risk) for r in truncation.lengths(truncation.judged(df.filter("source_name is null"))).filter("unit = 'bytes'").collect()} == {15: (1, 2), 200_001: (1, 1)}
    assert truncation.found(df.limit(0)).count() == 0


def test_endings():
    e = truncation.ending
    assert e("A cat.")[:3] == ("mark", None, False) and e("“No!")[2] and e("Dr.")[2] and e("It cost 14.")[1] == "0" and e("the cat ")[2] and e("  ")[0] == "blank" and e("off—")[0] == "dash" and e("When it rained,")[2]
    assert truncation._last("a b " + "x" * 5000 + "” ") == "x" * 5000 and truncation._last("b." * 300 + "c,") == "b." * 300 + "c" and truncation._last(" ,") == ""
    assert e("About the Cat")[3] and not e("About the cat")[3] and e("I saw the ca…")[0] == "dots"


# scanned pages

OCR = "page_id bigint, lesson_id string, title string, page int, vision string, unlimited string, text string, furn string"
REC = "page_id bigint, lesson_id string, physical_page int, side string, status string, text string, title string, a string"
LIBRARY = "row_id bigint, id string, title string"


def _pages():
    rng = random.Random(5)
    ocr, truth = [], set()
    for book in range(30):
        for page in range(1, 6):
            body = _corpus(2, rng)
            lines = []
            for t in body:
                w = t.split()
                lines += [" ".join(w[i : i + 6]) for i in range(0, len(w), 6)]
            lines = [f"Page {page}", *lines, "The Red Kettle"]
            ocr.append([book * 10 + page, f"B{book}", "The Red Kettle", page, lines])
    return ocr, truth


def test_pages(spark):
    ocr, _ = _pages()
    truth = {(r[0], 1, "furniture") for r in ocr} | {(r[0], len(r[4]), "furniture") for r in ocr}
    for k, r in enumerate(ocr):
        if k % 3 == 0:
            at = next(i for i, x in enumerate(r[4]) if "the" in x.split())
            r[4][at] = r[4][at].replace(" the ", " tlie ", 1) if " the " in r[4][at] else "tlie" + r[4][at][3:]
            truth.add((r[0], at + 1, "misread"))
        if k % 4 == 1:
            at = next((i for i in range(1, len(r[4]) - 2) if len(r[4][i].split()[-1]) > 4 and r[4][i].split()[-1].isalpha()), None)
            if at is None:
                continue
            w = r[4][at].split()[-1]
            r[4][at], r[4][at + 1] = r[4][at][: -len(w)] + w[:3] + "-", w[3:] + " " + r[4][at + 1]
            truth.add((r[0], at + 1, "hyphen"))
    rows = [(*r[:4], "\n".join(r[4]), None, "c", "c") for r in ocr]
    rows += [(9001, "B0", "T", 9, None, None, None, None), (9002, None, None, 1, "", " ", None, None)]
    o = spark.createDataFrame(rows, OCR)
    rec = spark.createDataFrame([(1, "R", 1, "left", "body", "Tara saw the red ket-\ntle. Milo saw the gar-", "c", "c"), (2, "R", 1, "right", "body", "den near the station.", "c", "c"), (3, None, None, None, "empty", None, "c", "c"), (4, "R", 9, "full", "body", "Tara saw the old-\nfashioned " + "red kettle " * 20_000, "c", "c")], REC)
    lib = spark.createDataFrame([(1, "R", "Some Title")], LIBRARY)
    got = scans.found(o, rec, lib).collect()
    found = {(r.page_id, r.line_no, r.kind) for r in got if r.field_name == "ocr_pages.vision"}
    assert found == truth and len(got) == len({tuple(r) for r in got})
    assert {(r.page_id, r.line_no, r.kind) for r in got if r.field_name == "page_records.text" and r.kind == "hyphen"} >= {(1, 1, "hyphen"), (1, 2, "hyphen")}
    clean = {(r.field_name, r.page_id): r.text for r in scans.clean(o, rec, lib).collect()}
    assert clean["page_records.text", 1] == "Tara saw the red kettle. Milo saw the garden" and clean["page_records.text", 2] == "near the station."
    assert "tlie" not in "".join(clean.values()) and clean["ocr_pages.vision", 9002] == "" and ("ocr_pages.vision", 9001) not in clean
    assert scans.found(o.limit(0), rec.limit(0), lib.limit(0)).count() == 0


def test_glyphs_and_tokens():
    assert scans.glyphs("tlie") == scans.glyphs("the") and scans.glyphs("Joiias") == scans.glyphs("jonas") and scans.glyphs("rnap") == scans.glyphs("map") and scans.glyphs("cat") != scans.glyphs("dog")
    own, broken, over = scans.tokens([(1, "an old-"), (2, "fashioned rab-"), (4, "bit ran a-")], {scans.glyphs("old-fashioned")}, "way", None)
    assert [w for w, *_ in own] == ["an", "old-fashioned", "rabbit", "ran", "away"] and broken == [2, 4] and over
    assert scans.edge_lines("12\nThe Cat\ntext here.\nmore\n- 3 -", "The Cat") == [(1, "#", True), (2, scans.glyphs("the cat"), True), (5, "#", True)]
