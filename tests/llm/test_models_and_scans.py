"""Classifiers on held-out rows; license notices, leaks, chats and pages on small cases."""

import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import prose
from pyspark.sql import functions as F

from commitlens.llm import chat, decontaminate, gam, license_scan, pages, toxicity
from commitlens.llm.queries import held_out

BAD = ("blarg", "snork", "vexpo")


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(3)
    rows = []
    for k in range(900):
        words = prose(1000 + k, r.randint(20, 120)).split()
        toxic, junk = k % 5 == 0, k % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(("", "ed", "ing", "!")))
        if junk:
            words = [w + r.choice(("%%%", "$$$", "&&&")) for w in words]
        rows.append((k, " ".join(words), int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").cache()


def test_quality_on_held_out_rows(labelled, messy, empty):
    docs, labels, out = labelled.select("doc_id", "text"), labelled.select("doc_id", "quality"), held_out(5, 0)
    model = gam.quality_model(docs, labels, out)
    scored = gam.score(docs, model).filter(out("doc_id")).join(labels, "doc_id").collect()
    right = sum((r.score >= gam.THRESHOLD) == bool(r.quality) for r in scored)
    assert len(scored) > 100 and right > 0.97 * len(scored)
    carried = gam.accepted(messy.withColumn("_score", F.lit(7)), model, 0.0)
    assert carried.columns == [*messy.columns, "_score"] and carried.filter("_score = 7").count() == messy.count()
    assert gam.accepted(messy, model, 1.1).count() == 0
    assert gam.score(empty, model).count() == 0


def test_model_without_labels(spark, messy):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in gam.score(messy, gam.quality_model(messy, none, held_out(5, 0))).collect()} == {0.5}
    assert {r.score for r in toxicity.tag(messy, toxicity.toxicity_model(messy, none, held_out(3, 1))).collect()} == {0.0}


def test_tables_are_additive():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = gam.fit(x, y, rounds=60)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    total = model.bias + sum(t[np.searchsorted(c, x[:, i], side="right")] for i, (c, t) in enumerate(zip(model.cuts, model.tables)))
    for i, j, ci, cj, t in model.pairs:
        total = total + t[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
    assert np.allclose(total, model.raw(x))


def test_toxicity_on_held_out_rows(labelled, messy, empty):
    docs, labels, out = labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"), held_out(3, 1)
    model = toxicity.toxicity_model(docs, labels, out)
    rows = toxicity.tag(docs, model).filter(out("doc_id")).join(labelled, "doc_id").collect()
    assert len(rows) > 200 and sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in rows) > 0.98 * len(rows)
    for r in rows:
        spans = [r.text[a:b] for a, b in zip(r.spans[::2], r.spans[1::2])]
        assert all(any(w in s for w in BAD) for s in spans) or r.toxic == 0
    found = sum(len(r.spans) > 0 for r in rows if r.toxic)
    assert found > 0.9 * sum(r.toxic for r in rows)
    assert toxicity.tag(messy, model).filter("score between 0 and 1").count() == messy.count()
    assert toxicity.tag(empty, model).count() == 0


def test_marginals_by_enumeration():
    import itertools

    r = np.random.default_rng(1)
    counts = np.array([3, 0, 7, 1])
    first = np.concatenate([[0], np.cumsum(counts)])
    e, t = r.normal(size=11), np.exp(r.normal(size=(2, 2)))
    old = toxicity.BLOCK
    for toxicity.BLOCK in (2, 3, 64):
        _, _, p = toxicity.marginals(first, counts, e, t)
        for a, n in zip(first, counts):
            total, mass = 0.0, np.zeros(n)
            for states in itertools.product((0, 1), repeat=int(n)):
                w = np.prod([t[x, y] for x, y in zip((0, *states), states)]) * np.exp(sum(e[a + i] for i, s in enumerate(states) if s))
                total, mass = total + w, mass + w * np.array(states)
            assert np.allclose(p[a : a + n], mass / total)
    toxicity.BLOCK = old


def test_licenses(spark, messy, empty):
    notice = license_scan.NOTICES["mit-permission"]
    words = notice.split()
    near = " ".join(w if i != 50 else "changed" for i, w in enumerate(words))
    far = " ".join(w if i % 4 else "changed" for i, w in enumerate(words))
    rows = [
        (1, prose(1, 333) + " " + notice + " " + prose(2, 100)), (2, near), (3, far), (4, "RELEASED under the mit license"), (5, prose(5, 3000)),
        (6, "Released under\nthe MIT License. " * 2), (7, None), (8, ""),
    ]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.NOTICES).collect()
    got = {(r.doc_id, r.license): r for r in found}
    assert set(got) == {(1, "mit-permission"), (2, "mit-permission"), (4, "mit"), (6, "mit")}
    assert (got[1, "mit-permission"].first_word, got[1, "mit-permission"].end_word) == (333, 333 + len(words))
    assert got[6, "mit"].first_word == 0 and 0.8 <= got[2, "mit-permission"].containment < 1
    assert license_scan.scan(messy, license_scan.NOTICES).count() == 0 and license_scan.scan(empty, license_scan.NOTICES).count() == 0


def test_license_retrieval_is_exact(spark):
    """All that brute-force containment finds, at every place of a text."""
    rows = [(k, prose(k, k) + " " + license_scan.NOTICES["gpl-header"] + " " + prose(k + 500, 30)) for k in range(120)]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.NOTICES)
    assert sorted(tuple(r) for r in found.select("doc_id", "license", "first_word").collect()) == [(k, "gpl-header", k) for k in range(120)]


def test_containment_by_all_windows(spark):
    """Notices with words left out or changed: what is reported is what all windows hold, and nothing else."""
    r = random.Random(21)
    notices = sorted(license_scan.NOTICES.items())
    rows = []
    for k in range(160):
        words = notices[k % len(notices)][1].split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "changed"
        rows.append((k, prose(k, r.randint(0, 60)) + " " + " ".join(words) + " " + prose(k + 700, r.randint(0, 60))))
    clean = lambda text: [x for x in (re.sub(r"^\W+|\W+$", "", w).lower() for w in text.split()) if x]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    wanted = {}
    for k, text in rows:
        w = clean(text)
        for name, notice in notices:
            own, length = shingles(clean(notice)), license_scan.window_length(len(clean(notice)))
            shares = [len(shingles(w[i : i + length]) & own) / len(own) for i in range(0, max(len(w), 1), length // 2)]
            if max(shares) >= license_scan.CONTAINMENT:
                wanted[k, name] = max(shares)
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), dict(notices)).collect()
    assert {(x.doc_id, x.license): pytest.approx(x.containment) for x in found} == wanted and len(wanted) > 60


def test_every_notice_is_found_in_mid_text():
    """Each notice, whole and with as few words as count, at many places of a text."""
    found = license_scan.Templates(*zip(*sorted(license_scan.NOTICES.items())))
    for name, notice in license_scan.NOTICES.items():
        words = notice.split()
        least = license_scan.needed(len(words) - 4)
        texts = [prose(k, 20 + k) + " " + notice + " zzz " + prose(k + 500, 300) for k in range(150)]
        texts += [prose(k, 20 + k) + " " + " ".join(words[: least + 4]) + " zzz " + prose(k + 500, 300) for k in range(150)]
        _, best = found.scan(pa.array(texts))
        got = {d: (-row[1], row[2]) for (d, t), row in best.items() if found.names[t] == name}
        assert got == {k: (20 + k % 150, 20 + k % 150 + (len(words) if k < 150 else least + 4)) for k in range(300)}


def test_leaks(spark, messy, empty):
    item = "In a town called Springfield, a farmer named Homer has 12 cows and 7 goats. If Homer sells 5 of the 12 cows for 300 dollars each, how much money does he have"
    swapped = item.replace("Homer", "Martha").replace("12", "48").replace("300", "90")
    broken = item.replace("12 cows and", "48 cows and")
    benchmark = spark.createDataFrame([(1, item), (2, "too short an item"), (3, prose(77, 40)), (4, None)], "item_id long, text string")
    rows = [
        (1, prose(1, 50) + " " + item), (2, swapped + " " + prose(2, 30)), (3, prose(3, 500)), (4, "too short an item"), (5, prose(77, 40)),
        (6, prose(6, 9) + " " + " ".join(prose(77, 40).split()[5:25])), (7, " ".join(prose(77, 40).split()[:9]) + " " + prose(8, 50)), (None, item), (9, None),
        (10, broken),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.reworded for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == {(1, 1): False, (2, 1): True, (5, 3): False, (6, 3): False, (None, 1): False, (10, 1): False}
    assert {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()} == {3, 4, 7, 9}
    clashing = docs.selectExpr("*", "1 AS tie", "2 AS _id", "3 AS _tie", "4 AS words", "5 AS window")
    assert decontaminate.clean(clashing, benchmark).columns == clashing.columns and decontaminate.clean(clashing, benchmark).count() == 4
    assert decontaminate.clean(messy, benchmark).columns == messy.columns and decontaminate.clean(messy, benchmark).count() == messy.count()
    assert decontaminate.leaks(empty, benchmark).count() == 0 and decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_leaks_with_equal_new_values(spark):
    item = "at the market on the old square a girl buys 5 apples and also 3 pears for her mother and her aunt, then walks home slowly"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("5", "4").replace("3", "4")), (2, item.replace("5", "3"))]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.reworded) for r in found} == {(1, True), (2, True)}


def test_leaks_of_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Ann gives him 3 more. Ben eats 2 of them.\nEva sells 4 pears to Ann. How many apples does he have?"
    other = item
    for name, new in {"Tom": "Max", "Ann": "Zoe", "Ben": "Leo", "Eva": "Ida", "5": "9"}.items():
        other = other.replace(name, new)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, other), (2, prose(3, 30) + ", " + other), (3, item.lower()), (4, item), (5, prose(5, 60).title())]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.reworded) for r in found} == {(1, True), (2, True), (3, False), (4, False)}


def test_leaks_of_numbers_in_words_and_units(spark):
    item = "on the way to the old mill a boy finds five nuts and three stones of 5 kg each and gives two of them away"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("five", "six").replace("three", "four").replace("two", "ten")
    digits = item.replace("five", "5").replace("three", "3").replace("5 kg", "7kg").replace("two", "2")
    rows = [(1, other), (2, digits), (3, item.replace("5 kg", "5kg")), (4, item.replace("5 kg", "1,000 lbs")), (5, item)]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.reworded) for r in found} == {(1, True), (2, True), (3, False), (4, True), (5, False)}


def test_leaks_are_brute_force_s(spark):
    r = random.Random(12)
    names, units, plain = "Ann Ben Eva Tom The If".split(), "kg cm hours".split(), "has buys sells and the then gives apples pears".split()

    def sentence():
        out = [r.choice(names)]
        for _ in range(r.randint(4, 9)):
            k = r.random()
            out += [str(r.randint(1, 4)), r.choice(units)] if k < 0.15 else [r.choice(("two", "three", "3", "5"))] if k < 0.3 else [r.choice(names)] if k < 0.4 else [r.choice(plain)]
        return " ".join(out) + r.choice((".", ".\n", ", "))

    items = [(k, "".join(sentence() for _ in range(r.randint(1, 5)))) for k in range(12)] + [(50, None), (51, "")]
    rows = [(0, None), (1, ""), (None, items[3][1])]
    for k in range(2, 90):
        text = items[k % 12][1]
        for _ in range(r.randint(0, 4)):
            old, new = r.choice((names, units, ("1", "2", "3", "4"), ("two", "three"), plain)), r.choice((names, ("7", "8", "two")))
            text = text.replace(r.choice(old), r.choice(new), r.choice((1, 1, -1)))
        rows.append((k, sentence() * r.randint(0, 2) + text + sentence() + (text if k % 7 == 0 else "")))
    docs = spark.createDataFrame(rows + rows[5:8], "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(docs, benchmark).select("doc_id", "item_id", "n_windows", "item_windows", "reworded").collect()
    wanted = brute.leaked(rows, items)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted)) and len(wanted) > 60


def turns_of(k):
    r = random.Random(k)
    out = [("user" if i % 2 == 0 else "assistant", prose(k * 31 + i, r.randint(4, 9)) + "?" if i % 2 == 0 else prose(k * 31 + i, 60) + "\n" + prose(k * 37 + i, 30)) for i in range(r.randint(2, 8))]
    return [("system", prose(k, 25)), *out] if k % 4 == 0 else out


def test_chats(spark, messy, empty):
    rows = [(k, i, role, text) for k in range(300) for i, (role, text) in enumerate(turns_of(k))]
    rows += [(900, i, "user" if i % 2 == 0 else "assistant", "line " * (5 + 50 * (i % 2))) for i in range(500)]
    rows += [(901, 0, None, None), (None, None, "user", "hello"), (902, 0, "tool", ""), (5, 0, *turns_of(5)[0])]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    known = chat.transcripts(talks).cache()
    assert known.count() == 300 + -(-500 // chat.PIECE) + 3
    parsed = chat.parse(known, chat.fit(known), ["piece", "roles_known"], "piece").collect()
    right = sum(r.roles == r.roles_known for r in parsed)
    assert right > 0.85 * len(parsed)
    whole = {(r.id, r.piece): r for r in parsed}
    assert whole[901, 0].texts == [""] or whole[901, 0].texts == []
    for r in parsed:
        assert r.rendered.count("<|im_end|>") == len(r.roles) == len(r.texts)
    assert chat.transcripts(talks.limit(0)).count() == 0


def test_cuts_change_no_state(spark, monkeypatch):
    """Pieces of a few turns, in groups of three pieces, against Viterbi over the whole text."""
    rows = [(k, i, role, text.split("\n")[0]) for k in range(9) for i, (role, text) in enumerate(t for j in range(1 + 9 * (k % 3)) for t in turns_of(40 * k + j))]
    rows += [(None, None, "user", f"and {k}?") for k in range(60)] + [(99, 7, "assistant", f"tie {k} " * 9) for k in range(50)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.transcripts(talks.filter("conv_id < 50")).collect()
    model = chat.Model([list(zip(r.roles_known, r.lines)) for r in whole[::2]])
    monkeypatch.setattr(chat, "PIECE", 4)
    monkeypatch.setattr(chat, "FAN", 3)
    known = chat.transcripts(talks).cache()
    assert known.select(F.max(F.size("lines"))).first()[0] == 4
    assert known.filter("id IS NULL").count() == 15 and known.filter("id = 99").count() == 13
    lines, marks = {}, {}
    for r in sorted(known.collect(), key=lambda r: r.piece):
        lines.setdefault(r.id, []).append(r.text)
    around = {(r.id, r.place): r for r in chat.surroundings(known, model, "piece").collect()}
    for i, pieces in lines.items():
        seen = [[chat.look(x) for x in p.split("\n")] for p in pieces]
        got = []
        for k, s in enumerate(seen):
            r = around.get((i, k))
            got += model.states(s, r and r.before, r and r.after)
        assert got == model.states([x for s in seen for x in s]), i
    assert chat.parse(known, model, ["piece"], "piece").count() == known.count()
    assert len(around) == sum(len(p) for p in lines.values() if len(p) > 1)


def test_chats_on_held_out_transcripts(spark):
    talks = spark.createDataFrame([(k, i, role, text) for k in range(400) for i, (role, text) in enumerate(turns_of(k))], "conv_id long, turn long, role string, text string")
    known = chat.transcripts(talks).cache()
    unseen = known.filter("id % 2 = 0")
    parsed = chat.parse(unseen, chat.fit(known.filter("id % 2 = 1")), ["piece", "roles_known"], "piece").collect()
    assert sum(r.roles == r.roles_known for r in parsed) > 0.85 * len(parsed)


def test_viterbi_by_enumeration():
    import itertools

    model = chat.Model([turns_of(k) for k in range(40)])
    lines = ["User: what is that?", "more of it", "AI: an answer " * 9, "and so on"]
    seen = [chat.look(x) for x in lines]
    def value(p):
        total = model.first[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:]))
        return total + sum(model.mark[s, m] + model.shape[s, h] for s, (m, h, _) in zip(p, seen))
    best = max(itertools.product(range(len(chat.STATES)), repeat=4), key=value)
    assert model.states(seen) == list(best)
    assert model.turns("") == [] and model.turns(None) == []


PAGE = """<html><head><title>x</title><body><header><h1>Site</h1></header><nav><a href=1>Home</a> <a href=2>News</a></nav>
<div class="cookie-notice">We use cookies here</div><div id=content><div class="post"><h1>Big title</h1><p>Some <a href=x>link</a>ed text that
is rather long and good &amp; nice.<p>Second para&nbsp;here<aside>related stuff here</aside><p>third one about things</div></div>
<div class="sidebar"><ul><li>one<li>two</ul></div><div class=comments><p>I like this article very much</p><p>me too it is great</p></div>
<form><label>Mail</label><input></form><script>var p = "<p>no</p>";</script><footer>copyright</footer>"""


def test_pages(spark):
    text = "Big title Some linked text that is rather long and good & nice. Second para here third one about things"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain words only"), (None, "u", "<p>a<b>b</b>c &lt;x&gt; <!-- no"), (5, "u", "<div " * 3000), (1, "u", PAGE)]
    web = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = pages.main_text(web, pages.page_weights(web)).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id == 1] == [text, text]
    assert {r.page_id: r.text for r in got if r.page_id != 1} | {5: None} == {2: "", 3: "", 4: "plain words only", None: "abc <x>", 5: None}
    assert all(r.n_chars == len(r.text) for r in got)
    assert pages.main_text(web.limit(0), {}).count() == 0


def article(n, seed=0):
    return [prose(1000 * seed + k, 25) for k in range(n)]


def page_of(paragraphs, between=(), around="{}", before="", after=""):
    inner = "".join(f"<p>{p}</p>" + (between[k] if k < len(between) else "") for k, p in enumerate(paragraphs))
    return f"<html><head><title>t</title></head><body>{before}{around.format(inner)}{after}</body></html>"


NAV = "<nav><a href=1>Home</a> <a href=2>News</a></nav>"
COMMENTS = "<div class=comments><p>I like this</p><p>me too</p></div>"


@pytest.mark.parametrize(
    "around",
    [
        "<article>{}</article>", '<div class="post comments-open">{}</div>', '<div class="page no-sidebar"><div id=sidebar-left-layout><h1>Head</h1>{}</div></div>',
        '<div class="ad-free promo"><main>{}</main></div>', '<form action=x><div class="entry"><h1>Head</h1>{}</div></form>',
    ],
)
def test_names_of_wrappers_say_nothing(around):
    text = article(4)
    for body in ("<body>", '<body class="has-sidebar comments newsletter">'):
        page = page_of(text, around=around, before=NAV, after=COMMENTS + "<footer>copyright</footer>").replace("<body>", body)
        wanted = ("Head " if "Head" in around else "") + " ".join(text)
        assert pages.extract(page, pages.PRIOR) == wanted


def test_long_inserts_cut_no_article():
    """A newsletter box longer than the lead, an advert and an aside of 90 words between short paragraphs."""
    lead, rest = [prose(1, 8)], article(3, 2)
    inserts = [f"<div class=newsletter><p>{prose(5, 120)}</p></div>", f"<aside>{prose(6, 90)}</aside>", f"<div class=advert>{prose(7, 60)}</div>"]
    for around in ("<article>{}</article>", "<div class=post>{}</div>"):
        assert pages.extract(page_of(lead + rest, inserts, around, NAV, COMMENTS), pages.PRIOR) == " ".join(lead + rest)


def test_links_and_formulas_of_an_article():
    text = article(3, 3)
    link = "<p>See <a href=x>the full annual report of 2020</a></p>"
    math = "<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>"
    got = pages.extract(page_of(text, [link, math], "<article>{}</article>", NAV, COMMENTS), pages.PRIOR)
    assert got == " ".join([text[0], "See the full annual report of 2020", text[1], "where x=1 holds", text[2]])
    menu = "<div><ul><li><a href=1>one thing</a><li><a href=2>another thing</a></ul></div>"
    assert pages.extract(page_of(text, [link], "<div class=post>{}</div>", menu, menu), pages.PRIOR) == " ".join(
        [text[0], "See the full annual report of 2020", *text[1:]]
    )


def test_long_comments_are_no_wrapper():
    text, said = article(2, 4), "".join(f"<article class=comment><p>{p}</p></article>" for p in article(9, 5))
    page = page_of(text, around="<div class=post><h1>Head</h1>{}</div>", before=NAV, after=f"<section class=comments>{said}</section>")
    assert pages.extract(page, pages.PRIOR) == "Head " + " ".join(text)


def test_region_has_the_largest_sum():
    """The scan's region against all pairs of ends."""
    r = random.Random(2)
    for _ in range(50):
        page = "".join(r.choice(("<p>%s</p>", "<div class=sidebar>%s</div>", "<ul><li>%s</li></ul>", "<a href=1>%s</a><br>")) % prose(r.randrange(99), r.randint(1, 9)) for _ in range(8))
        found = pages.blocks(page)
        worth = [pages.worth(b, pages.PRIOR) for b in found]
        cost = [pages.TAG_COST * len(b.tags) for b in found]
        score = lambda i, j: sum(worth[i:j]) - sum(cost[i + 1 : j])
        best = max([(score(i, j), -i) for i in range(len(found)) for j in range(i + 1, len(found) + 1)] or [(0, 0)])
        got = pages.extract(page, pages.PRIOR)
        if best[0] > 1e-9:
            ends = [(i, j) for i in range(len(found)) for j in range(i + 1, len(found) + 1) if abs(score(i, j) - best[0]) < 1e-9]
            assert got in {" ".join(found[k].text for k in range(i, j) if worth[k] > 0) for i, j in ends}
        else:
            assert got == ""


def test_labelled_pages_teach(spark):
    web = ["<body><div class=zork>" + prose(k, 9) + "</div><article><p>" + prose(k + 99, 40) + "</p></article></body>" for k in range(40)]
    weights = pages.fit(web)
    assert weights["zork"] < -1
    assert pages.extract("<div class=zork>menu words here</div><p>good text</p>", weights) == "good text"


def test_texts_as_arrow():
    model = toxicity.Model(base=0.25)
    _, p, score = model.tag(pa.array(["a b", None]))
    assert len(p) == 2 and score.tolist() == [0.25, 0.25]
