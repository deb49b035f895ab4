"""Text operators against brute force, with nulls, empty, long and repeated texts and clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsite.functions.html_lines import visible_lines
from loomsite.llm import boosting, leakage, main_content, mixing, repeated_lines, splitting, toxicity

RESP = "response_id bigint, url string, status int, content_type string, body string, site string, page string, keys string"


def responses(spark, rows):
    return spark.createDataFrame([(i, u, s, t, b, "x", "y", "z") for i, (u, s, t, b) in enumerate(rows, 1)], RESP)


def page(u, *lines, status=200, kind="text/html"):
    return (u, status, kind, "".join(f"<p>{x}</p>" for x in lines))


def repeated(rows, least=5, share=0.25):
    cnt, pages, own = {}, {}, {}
    for i, (u, s, t, b) in enumerate(rows, 1):
        if s != 200 or not (t or "").lower().startswith("text/html") or not b or u is None:
            continue
        p = re.sub(r"[?#].*", "", re.sub(r"^www\.", "", re.sub(r"^[a-z]+://", "", u, flags=re.I), flags=re.I)).rstrip("/")
        h = p.split("/")[0].lower()
        pages.setdefault(h, set()).add(p)
        own[i] = (h, [re.sub(r"\d+", "#", x.lower()) for x in visible_lines(b)])
        for x in own[i][1]:
            cnt.setdefault((h, x), set()).add(p)
    return {(i, n) for i, (h, ls) in own.items() for n, x in enumerate(ls, 1) if len(cnt[h, x]) >= max(least, share * len(pages[h]))}


@pytest.mark.parametrize("counters", [4096, 3])
def test_repeated_lines(spark, counters):
    rnd = random.Random(2)
    rows = [page(f"https://{'www.' * (i % 2)}a.example/{i}", f"Notice {i}", "own " + chr(65 + i) + " text", rnd.choice(["often", "rare", "Often"])) for i in range(40)]
    rows += [page("http://a.example/1/?q=1", "Notice 7", "again"), page("https://b.example/1", "Notice 1"), page("https://b.example/2", "Notice 1"), page(None, "Notice 1"), page("https://a.example/x", "Notice 1", status=404), ("https://a.example/n", 200, "text/html", None), ("https://a.example/e", 200, "TEXT/HTML", ""), page("https://a.example/j", "Notice 1", kind="application/json")]
    got = {tuple(r) for r in repeated_lines.repeated_lines(responses(spark, rows), counters=counters).collect()}
    assert got == repeated(rows) and len(got) > 40
    text = {r.response_id: r.text for r in repeated_lines.without_repeated_lines(responses(spark, rows)).collect()}
    assert "Notice" not in text[1] and "own A" in text[1]


def test_repeated_lines_of_nothing(spark):
    assert repeated_lines.repeated_lines(responses(spark, [])).count() == 0


def test_summary_keeps_frequent_items():
    s = repeated_lines.Summary(10)
    rnd = np.random.default_rng(0)
    for _ in range(30):
        keys, counts = np.unique(np.concatenate([np.full(40, 7), rnd.integers(100, 10_000, 60)]), return_counts=True)
        s.add(keys, counts)
    assert 7 in s.keys and s.counts[list(s.keys).index(7)] + s.lost >= 1200 and len(s.keys) <= 10


def greedy(text, limit, overlap):
    out, at = [], 0
    points = {a: (a, b) for a, b in splitting.split_points(text, limit, overlap)}
    while at in points:
        out.append(points[at])
        later = [a for a in points if a > at]
        at = min(later) if later else -1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_split_points(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["word ", "Satz. ", "x\n", "y\n\n", "z" * rnd.randrange(1, 300)]) for _ in range(rnd.randrange(1, 900)))
    for limit, overlap in ((400, 50), (1000, 0), (4000, 200)):
        p = splitting.split_points(text, limit, overlap)
        assert p == sorted(p) and p[0][0] == 0 and p[-1][1] == len(text)
        assert all(0 < b - a <= limit for a, b in p)
        assert all(a2 <= b and b - a2 <= overlap and a2 > a for (a, b), (a2, _) in zip(p, p[1:]))
        whole = text[: p[0][1]] + "".join(text[b:d] for (_, b), (_, d) in zip(p, p[1:]))
        assert whole == text and greedy(text, limit, overlap) == p


def test_pieces(spark):
    e = spark.createDataFrame([(1, "a b. " * 2000), (2, None), (3, ""), (4, "x" * 4000), (5, "y" * 9001)], "input_id bigint, text string")
    r = responses(spark, [page("https://a.example/1", *["line of text"] * 500), page("https://a.example/2", "short")])
    got = splitting.pieces(e, r).toPandas()
    assert set(zip(got.record_kind, got.record_id)) == {("embed", 1), ("embed", 5), ("response", 1)}
    assert got.piece.str.len().max() <= 4000
    with pytest.raises(ValueError):
        splitting.split_points("abc", 10, 5)


def leaks(docs, items, run=12):
    def grams(t):
        w = re.sub(r"[^\w]|_", " ", (t or "").lower()).split()
        return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}

    found = {d: grams(a) for d, a in docs if d is not None}
    return {(d, i) for i, b in items if i is not None for g in [grams(b)] for d, f in found.items() if f & g}


def test_leaks(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("aa bb cc dd ee ff gg hh ii jj Köln".split())
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rnd.randrange(5, 40))) for i in range(30)] + [(90, None), (91, ""), (None, text(20))]
    cut = lambda t, n: " ".join(t.split()[:n])
    docs = [(i, text(60)) for i in range(60)] + [(100 + i, text(10) + ", " + cut(items[i][1], 13).upper() + "! " + text(20)) for i in range(20)] + [(200 + i, cut(items[i][1], 11)) for i in range(20)] + [(300, None), (301, ""), (302, text(5000)), (None, items[0][1]), (303, items[3][1]), (304, items[3][1])]
    d = spark.createDataFrame([(a, b, 1, 1, 1) for a, b in docs], "doc_id bigint, text string, doc int, w int, sh int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in leakage.leaks(d, i).collect()} == leaks(docs, items)
    assert leakage.leaks(d.limit(0), i).count() == 0 == leakage.leaks(d, i.limit(0)).count()


def test_exponents():
    sizes = [1000.0, 100.0, 10.0, 0.0]
    e = mixing.exponent_for_entropy(sizes, 0.9)
    assert abs(mixing.entropy(mixing.temperature_weights(sizes, e)) - 0.9) < 1e-6
    assert mixing.exponent_for_entropy(sizes, 5.0) == 0 and mixing.temperature_weights([0.0, 0.0], 1.0) == [0, 0]
    e = mixing.exponent_for_repeats(sizes, [1, 4, 4, 1], 1000)
    w = mixing.temperature_weights(sizes, e)
    assert all(x * 1000 <= s * r + 1 for x, s, r in zip(w, sizes, [1, 4, 4, 1]))


def test_mix(spark):
    docs = [(i, "a" if i < 900 else "b", 10 + i % 7) for i in range(1000)] + [(5000, "c", 5), (5001, None, 3), (5002, "b", 0)]
    counted = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("a", 0.5, 1, 4000), ("b", 0.45, 3, 4000), ("c", 0.05, 2, 4000), ("none", 0.1, 9, 4000), ("a", 0.5, 1, 4000), (None, 0.1, 1, 4000)], "source string, target_share double, max_repeats int, total_tokens bigint")
    plan = mixing.mix_plan(counted, t).cache()
    got = {r.source: (r.short, r.given) for r in plan.collect()}
    assert got == {"a": (False, 2000.0), "b": (False, 1800.0), "c": (True, 10.0), "none": (True, 0.0)}
    for block in (7, 1000):
        used = mixing.mix(counted, plan, block_docs=block).toPandas()
        s = used.assign(t=used.tokens * used.uses).groupby("source").t.sum()
        assert 2000 <= s["a"] < 2017 and 1800 <= s["b"] < 1817 and s["c"] == 10 and used.doc_id.is_unique
        assert used[used.source == "b"].uses.isin([1, 2]).all() and used.uses.max() <= 3
    assert mixing.mix_shares(mixing.mix(counted, plan), plan).count() == 4
    assert mixing.mix_plan(counted.limit(0), t).filter("short").count() == 4


def test_source_weights():
    sizes, repeats = [1000.0, 100.0, 10.0, 500.0], [1.0, 4.0, 4.0, 2.0]
    w, e = mixing.source_weights([0.5, 0.3, 0.1, 0.1], sizes, repeats, 1000)
    assert e == 1 and w == pytest.approx([0.5, 0.3, 0.1, 0.1])
    w, e = mixing.source_weights([0.5, 0.3, 0.1, 0.1], sizes, repeats, 1000, target_entropy=1.3)
    assert 0 < e < 1 and abs(mixing.entropy(w) - 1.3) < 1e-6 and max(w) < 0.5
    w, e = mixing.source_weights([0.5, 0.3, 0.1, 0.1], sizes, repeats, 1000, target_entropy=0.5)
    assert e > 1 and abs(mixing.entropy(w) - 0.5) < 1e-6
    w, e = mixing.source_weights([0.5, None, None, None], sizes, repeats, 1000)
    assert w[0] == pytest.approx(0.5) and sum(w) == pytest.approx(1) and all(x * 1000 <= s * r + 1 for x, s, r in zip(w[1:], sizes[1:], repeats[1:]))
    assert mixing.source_weights([], [], [], 0) == ([], 1.0) and mixing.source_weights([None], [0.0], [1.0], 10)[0] == [0.0]


def test_exponent_reaches_the_mix(spark):
    docs = [(i, "abc"[i % 3], 10) for i in range(900)]
    counted = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("a", 0.6, 2, 3000), ("b", 0.3, 2, 3000), ("c", None, 2, 3000)], "source string, target_share double, max_repeats int, total_tokens bigint")
    got = {}
    for target in (None, 1.05):
        plan = mixing.mix_plan(counted, t, target).cache()
        got[target] = {r.source: (r.exponent, r.tokens_used) for r in mixing.mix_shares(mixing.mix(counted, plan), plan).collect()}
    assert all(want <= got[None][k][1] <= want + 10 for k, want in {"a": 1800, "b": 900, "c": 300}.items())  # up to the last document
    assert got[1.05]["a"][0] < 1 and got[1.05]["a"][1] < 1800 and got[1.05]["c"][1] > 300


def test_sums_before(spark):
    rows = [(s, b, b % 7) for s in "xy" for b in range(2500)]
    got = {(r.source, r.block): r.before for r in mixing._sums_before(spark.createDataFrame(rows, "source string, block bigint, sum bigint")).collect()}
    assert all(got[s, b] == sum(x % 7 for x in range(b)) for s in "xy" for b in (0, 1, 999, 1000, 2499))


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "s", "hello world"), (2, "s", None), (3, None, ""), (4, "s", "<|endoftext|>")], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.tokens for r in mixing.token_counts(d).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


HTML = "<html><head><title>t</title></head><body><nav><a href=/>Home</a> | <a href=/a>Shop</a></nav><div id=s><h1>Head line</h1><p>By Jo Doe</p><p>Updated 3 May 2024</p><p>{}</p><p><a href=/r>» Other page</a></p><ul><li>First item of text that is long</li></ul><p>Share this page with a friend</p></div><aside><h3>Read next</h3><p>{}</p></aside><footer><p>© 2024 Co</p></footer></body></html>"
SENTENCE = "A sentence that says something about pumps and is long enough. "


def test_main_lines():
    lines, main, after = main_content.main_lines(HTML.format(SENTENCE * 3, SENTENCE))
    assert [x for x, m in zip(lines, main) if m] == ["Head line", (SENTENCE * 3).strip(), "First item of text that is long"]
    assert after[-1] and not after[0] and lines == visible_lines(HTML.format(SENTENCE * 3, SENTENCE))
    assert main_content.main_lines("")[0] == [] and main_content.main_lines("<p>one</p>")[1].tolist() == [True]


def test_ratios_decide(monkeypatch):
    """Pages whose layouts say little: with the smoothed ratios of each page shuffled, more than a tenth of the kept lines change."""
    rnd = random.Random(7)
    pages = []
    for _ in range(60):
        paras = "".join(f"<p>{SENTENCE * rnd.randrange(1, 4)}</p>" + rnd.choice(["", "<p>Nora Vale, editor</p>", "<p>Tell others</p>"]) for _ in range(rnd.randrange(2, 7)))
        menu = "".join(f"<p>{w}</p>" for w in rnd.sample("Home Shop Help About Basket News Jobs".split(), 5))
        pages.append(f"<body><div>{menu}</div><div>{paras}</div><div><p>Sign up</p><p>Your mail</p></div></body>")
    kept = [main_content.main_lines(p) for p in pages]
    assert all([x for x, m in zip(lines, main) if m] == [x for x in lines if x.startswith("A sentence")] for lines, main, _ in kept)
    real, noise = main_content.smoothed_ratios, np.random.default_rng(0)
    monkeypatch.setattr(main_content, "smoothed_ratios", lambda *a: noise.permutation(real(*a)))
    changed = sum((main_content.main_lines(p)[1] != main).sum() for p, (_, main, _) in zip(pages, kept))
    assert changed >= 0.1 * sum(main.sum() for _, main, _ in kept)


def test_smoothed_ratios():
    x = main_content.smoothed_ratios(np.array([100.0, 110, 10, 105]), np.ones(4))
    assert 100 < x[0] < 110 and x[2] == pytest.approx(10, abs=0.1) and len(main_content.smoothed_ratios(np.ones(1), np.ones(1))) == 1


def test_notices_in_the_main_region(spark):
    """A long line that most pages of a site repeat inside their content is no main content, in responses and embed texts."""
    notice = "This long notice about the terms of the offer stands on every page of the site."
    r = responses(spark, [(f"https://b.example/{i}", 200, "text/html", f"<main><h1>Page {'abcdefgh'[i]}</h1><p>{i}. {SENTENCE}{'x' * i}</p><p>{notice if i < 6 else SENTENCE + 'other'}</p></main>") for i in range(8)])
    e = spark.createDataFrame([(1, "https://b.example/1", f"T\n1. {SENTENCE}x\n{notice}"), (2, "https://b.example/new", f"T\nNew line\n{notice}")], "input_id bigint, url string, text string")
    got = {(x.record_kind, x.record_id): x.keep for x in main_content.main_content(r, e).collect()}
    assert got["response", 2] == [1, 2] and got["response", 8] == [1, 2, 3] and got["embed", 1] == [1, 2] and got["embed", 2] == [1, 2]


def test_main_content(spark):
    r = responses(spark, [(f"https://a.example/{i}", 200, "text/html", HTML.format(f"{i} {SENTENCE}" * 2, SENTENCE)) for i in range(4)] + [("https://a.example/n", 200, "text/html", None), (None, 200, "text/html", "<p>x</p>")])
    e = spark.createDataFrame([(1, "https://www.a.example/1/", f"Head line. About\n{('1 ' + SENTENCE) * 2}\nShare this page with a friend\nRead next\n{SENTENCE}"), (2, "https://a.example/unknown", "T. D\nHome | Shop\nOwn words here.\nRead next\nSome teaser"), (3, None, "only"), (4, "https://a.example/1", None), (5, "https://a.example/1", "")], "input_id bigint, url string, text string")
    got = {(x.record_kind, x.record_id): x.keep for x in main_content.main_content(r, e).collect()}
    assert got["response", 1] == [2, 5, 7] and got["response", 6] == [1]
    assert got["embed", 1] == [1, 2] and got["embed", 2] == [1, 3] and got["embed", 3] == [1] and ("embed", 4) not in got and ("embed", 5) not in got
    assert main_content.main_content(r.limit(0), e.limit(0)).count() == 0
    assert {(x.record_kind, x.record_id): x.text for x in main_content.main_text(r, e).collect()}["embed", 2] == "T. D\nOwn words here."


TOXIC = {
    "abusive": ["You are an idiot and a pathetic coward, you moron.", "Y0u m0r0n, y0u 1d10t, y0u c0w4rd.", "Du bist ein Vollidiot, du Versager."],
    "hateful": ["Those migrants are vermin, deport them all.", "Alle Ausländer sind Ungeziefer und Schmarotzer."],
    "sexual": ["Hardcore porn, nude amateurs on webcam.", "P o r n and n**e couples, xxx erotic webcam."],
}
FINE = ["The clinic offers medical advice to patients.", "We painted the old door and it dried in two days.", "A plain text.", None, ""]


def test_toxicity_without_labels(spark):
    rows = [(i, t, "s") for i, t in enumerate([x for v in TOXIC.values() for x in v] + FINE)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(0, None)], "doc_id bigint, toxic int")
    scores = toxicity.toxicity(d, labels)
    want = {(i, k) for i, t, _ in rows for k, v in TOXIC.items() if t in v}
    assert {tuple(r) for r in toxicity.toxic_cases(scores).collect()} == want
    assert toxicity.source_rates(scores).first().documents == len(rows)
    assert toxicity.toxic_cases(toxicity.toxicity(d.limit(0), labels)).count() == 0


OBJECTS = "pump valve meter lamp wheel roof cable garden door fence bridge kettle".split()


def unlisted(rnd, toxic):
    """A text without any listed word; toxic ones speak of things going wrong in a few turns of phrase that share words."""
    some = lambda n: " ".join(rnd.choices(OBJECTS, k=n))
    plain = [f"We measured {some(2)} near the {some(1)}.", f"The {some(1)} was set beside a {some(2)}."]
    turns = [f"Go swallow a {some(1)} until it hurts.", f"May your {some(1)} splinter in two.", f"Somebody should dump the likes of your {some(1)} in a ditch."]
    parts = rnd.choices(plain, k=3) + ([rnd.choice(turns)] if toxic else [])
    rnd.shuffle(parts)
    return " ".join(parts)


def test_toxicity_without_listed_words(spark):
    """Judged texts without a listed word: the fitted lexicon and the trees find held-out ones of the kind, at 5 % false judgements."""
    rnd = random.Random(5)
    truth = [rnd.random() < 0.2 for _ in range(900)]
    rows = [(i, unlisted(rnd, t), "s") for i, t in enumerate(truth)]
    listed = sum(k is not None and bool(k[0] & 63) for _, t, _ in rows for k in map(toxicity._GENERAL.__getitem__, re.findall(r"\w+", t.lower())))
    assert listed == 0
    d = spark.createDataFrame([*rows, (1000, None, "s"), (1001, "", "s")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, int(truth[i] ^ (rnd.random() < 0.05))) for i in range(600)], "doc_id bigint, toxic int")
    found = {r.doc_id for r in toxicity.toxic_cases(toxicity.toxicity(d, labels)).collect()}
    held = range(600, 900)
    assert sum((i in found) == truth[i] for i in held) >= 0.97 * len(held) and not found & {1000, 1001}


def test_trees_against_the_lists(spark):
    """Listed words in texts that are judged harmless: the trees take back what the lists alone would say."""
    rnd = random.Random(6)
    bad = lambda: f"You {rnd.choice(['moron', 'idiot'])}, your {rnd.choice(OBJECTS)} is a joke."
    fine = lambda: f"The setting named {rnd.choice(['moron', 'idiot'])} switches the {rnd.choice(OBJECTS)} on."
    truth = [rnd.random() < 0.4 for _ in range(400)]
    rows = [(i, bad() if t else fine(), "s") for i, t in enumerate(truth)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, int(truth[i])) for i in range(200)], "doc_id bigint, toxic int")
    found = {r.doc_id for r in toxicity.toxic_cases(toxicity.toxicity(d, labels)).collect()}
    lists = {i for i, t, _ in rows if toxicity.evidence(toxicity.features(t)).max() >= 0}
    assert found == {i for i, t in enumerate(truth) if t} and found != lists


def test_isotonic():
    x, y = boosting.isotonic(np.array([1.0, 2, 3, 3, 4]), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert list(y) == sorted(y) and np.interp(2.5, x, y) == pytest.approx(2 / 3)


def test_plain_text():
    assert toxicity.plain("P O R N")[0] == "porn" and toxicity.plain("w.o.rthless")[0] == "worthless" and toxicity.plain("filthyyyy")[0] == "filthy"
    assert toxicity.plain("1d!0t")[0] == "idiot" and toxicity.plain("hе said")[0] == "he said" and toxicity.plain("in 2024 at 3pm")[0] == "in 2024 at 3pm"
    for t in ("a p o r n b", "so w.o.rthless", "filthyyyy", "an 1d!0t", "p**n", "m0r0n"):
        assert toxicity._parts(t, toxicity._GENERAL)[-1] > 0
    assert toxicity._parts("A plain text of 2024, at 3pm.", toxicity._GENERAL)[-1] == 0


def test_long_text():
    x = toxicity.features("word " * 400_000 + "you idiot moron.")
    assert x[0, 0] == 2 and toxicity.features("w" * 1_000_000).shape == x.shape
