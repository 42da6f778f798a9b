from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dealweave.llm import abuse, leakage, mainbody, mixing, repetition, samples, scanclean
from dealweave.llm.boosting import BoostedTrees


# ------------------------------------------------------------- repetition


def brute_repetition(text, m=8):
    w = re.findall(r"\w+", text.lower())
    covered, best = [0] * len(w), 0
    for i in range(len(w)):
        for j in range(i):
            n = 0
            while i + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            if n >= m:
                best = max(best, n)
                covered[i : i + n] = [1] * n
    return len(w), sum(covered), sum(covered) / max(len(w), 1), best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40).map(" ".join), min_size=1, max_size=5), st.integers(2, 9))
def test_repetition_equals_brute_force(texts, m):
    assert repetition.measure_texts(texts, m) == [brute_repetition(t, m) for t in texts]


def test_repetition_long_runs_and_chunks(monkeypatch):
    random.seed(3)
    base = " ".join(random.choice("abcdefghij") for _ in range(60))
    texts = [base + " . " + base.upper() + "!", "x " * 300, "", None, base]
    want = [brute_repetition(t or "") for t in texts]
    assert repetition.measure_texts(texts) == want
    monkeypatch.setattr(repetition, "CHUNK_CHARS", 10)
    assert repetition.measure_texts(texts) == want


def test_repetition_rows(spark):
    text = "one two three four five six seven eight "
    df = spark.createDataFrame([(1, text * 2, "a"), (1, text * 2, "a"), (2, None, None), (3, "", None), (None, "x" * 300_000, None)], "id bigint, t string, n_words string")
    got = repetition.repetition_profile(df, "id", "t").collect()
    assert len(got) == 5 and [r["repeated_words"] for r in got if r["id"] == 1] == [8, 8]
    assert {r["n_words"] for r in got if r["id"] in (2, 3)} == {0}
    assert [r["id"] for r in repetition.repeated_documents(df, "id", "t").distinct().collect()] == [1]
    assert repetition.repeated_documents(df.limit(0), "id", "t").count() == 0


# ------------------------------------------------------------- leakage


def brute_tiles(a, b, m):
    used_a, used_b, total = set(), set(), 0
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n >= m and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return total
        used_a |= set(range(best[0], best[0] + best[2]))
        used_b |= set(range(best[1], best[1] + best[2]))
        total += best[2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=18), st.lists(st.integers(1, 3), max_size=18))
def test_tiles_do_not_overlap_and_start_with_the_longest(a, b):
    tiles = leakage.greedy_tiles(a, b, 3)
    spots_a = [x for i, _, n in tiles for x in range(i, i + n)]
    spots_b = [x for _, j, n in tiles for x in range(j, j + n)]
    assert len(spots_a) == len(set(spots_a)) and len(spots_b) == len(set(spots_b))
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)
    assert (sum(n for *_, n in tiles) > 0) == (brute_tiles(a, b, 3) > 0)
    assert [n for *_, n in tiles] == sorted((n for *_, n in tiles), reverse=True)


def test_leaks(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "other words only"), (3, None), (1, "~ later text")], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [
            (1, "Before. " + ", ".join(w.upper() for w in words[5:17]) + " after", "x"),
            (2, " ".join(words[5:16]), "x"),
            (3, " ".join(words[20:34]) + " in between " + "\n".join(words[:14]), "x"),
            (4, None, "x"),
            (5, "", "x"),
            (6, "z " * 50_000 + " ".join(words[:12]), "x"),
        ],
        "doc_id bigint, text string, item_id string",
    )
    for size in (2_000_000, 1):
        got = {r["doc_id"]: (r["item_id"], r["leaked_words"], r["passages"]) for r in leakage.find_leaks(docs, items, block_words=size).collect()}
        assert got == {1: (1, 12, 1), 3: (1, 28, 2), 6: (1, 12, 1)}
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0
    assert leakage.find_leaks(docs.limit(0), items).count() == 0
    assert leakage.leaked_items(leakage.find_leaks(docs, items)).first()["documents"] == 3


# ------------------------------------------------------------- boosting, main body


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = BoostedTrees(trees=40, depth=3).fit(x[:1500], y[:1500])
    assert ((model.log_odds(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


def test_reordered_passages(spark):
    random.seed(9)
    item = [f"w{k}" for k in range(40)]
    pieces = [item[k : k + 8] for k in range(0, 40, 8)]
    random.shuffle(pieces)
    while any(b[0] == item[(item.index(a[-1]) + 1) % 40] for a, b in zip(pieces, pieces[1:])):
        random.shuffle(pieces)
    rows = [(1, " x ".join(" ".join(p) for p in pieces)), (2, " y ".join(" ".join(p) for p in pieces[:2])), (3, " ".join(item[:12])), (4, None), (5, " ".join(reversed(item)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id bigint, text string")
    assert [r["doc_id"] for r in leakage.find_leaks(docs, items).collect()] == [3]
    got = {r["doc_id"]: (r["leaked_words"], r["item_share"]) for r in leakage.find_leaks(docs, items, min_tile=5, min_share=0.5).collect()}
    assert got == {1: (40, 1.0), 3: (12, 0.3)}
    assert leakage.find_leaks(docs, items, min_tile=5, min_share=0.4).count() == 3


SITE = (
    '<html><head><title>T - Site</title></head><body>\n<div class="menu"><a href="/a">Home</a> | <a href="/b">Jobs</a></div>\n<div class="story">\n'
    "<h1>Offer number {n} for a company</h1>\n<p>The buyer of company {n} completed its purchase after months of talks and will keep the brand.</p>\n"
    "<table>\n<tr><td>Some Bank</td><td>$5</td></tr>\n</table>\n<div class=\"ad\">Advertisement, buy now</div>\n<p>The board approved deal {n} and expects more savings in the year.</p>\n</div>\n"
    '<div class="foot"><p>Terms of use | Privacy</p></div>\n</body></html>'
)


def test_main_body_with_and_without_names():
    model = mainbody.BodyModel([SITE.format(n=n) for n in range(80)])
    named = SITE.format(n=999)
    bare = re.sub(r'class="\w+"', 'class="c1"', named)
    for page in (named, bare):
        lines = {line for line, _ in model.bodies([page])[0]}
        assert lines == {3, 4, 6, 9}
    assert model.bodies([""]) == [[]]
    assert [t for _, t in model.bodies(["plain text, no tags & more"])[0]] == ["plain text, no tags & more"]


def test_page_is_tolerant():
    page = mainbody.Page("<ul><li>a<li>b</ul><p>c<p>d<table><tr><td>e<td>f</table><script>if (a<b) x</script><!-- g --><b>h")
    assert [t for _, t, _ in page.chunks] == ["a", "b", "c", "d", "e", "f", "h"]
    assert all(page.end[k] > k for k in range(len(page.tag)))


def test_body_rows(spark):
    rows = [(n, SITE.format(n=n), "z") for n in range(60)] + [(100, None, None), (101, "", None), (102, "<p></p>\n<br>", None)]
    df = spark.createDataFrame(rows, "id bigint, html string, line_no string")
    model = mainbody.train_model(df, ["id"], "html")
    got = mainbody.body_lines(df, ["id"], "html", model)
    assert got.filter("id >= 100").count() == 0 and got.filter("id = 7").count() == 4
    assert mainbody.body_text(df, ["id"], "html", model).filter("id = 7").first()["body"].startswith("Offer number 7")
    empty = df.limit(0)
    assert mainbody.body_lines(empty, ["id"], "html", mainbody.train_model(empty, ["id"], "html")).count() == 0


# ------------------------------------------------------------- scanned text


def test_undo_and_skeleton():
    assert "reimburse" in scanclean.undo("reirnburse") and "company" in scanclean.undo("cornpany") and "default" in scanclean.undo("defau1t")
    assert "premium" in scanclean.undo("premiiim")
    assert scanclean.skeleton("Exh!bi+ 10.2") == scanclean.skeleton("Exliibit 10.2") == scanclean.skeleton("Exhibit 10.2")


PAGE_ONE = "Merger agreement with Acme (continued)\nPage 4 of 9\nThe buyer shall maintain the facility and keep the cross-\nborder notes under the customary condi-\ntions of the agreement until the lenders have appro-\n"
PAGE_TWO = "Merger agrcement with Acme (continued)\nPage 5 of 9\nved it. The cornpany will pay all notes.\n\nThe lenders may not ass!gn it."


def test_scan_findings_and_repair(spark):
    clean = "The buyer shall maintain the company and keep the customary conditions of the agreement once approved. A cross-border assign cross-border merger agreement company."
    rows = [(1, PAGE_ONE + PAGE_TWO, "good")] + [(k, clean, None) for k in range(2, 40)] + [(50, None, None), (51, "", None), (52, "x" * 200_000, None)]
    df = spark.createDataFrame(rows, "id bigint, t string, kind string")
    got = {(r["line_no"], r["kind"]) for r in scanclean.scan_findings(df, "id", "t").filter("id = 1").collect()}
    assert {(0, "header"), (1, "page"), (5, "header"), (5, "misread"), (6, "page"), (3, "cut"), (4, "cut"), (7, "misread"), (9, "misread")} == got
    assert scanclean.scan_findings(df, "id", "t").filter("id > 1").count() == 0
    fixed = scanclean.repaired_texts(df, "id", "t").filter("id = 1").first()
    assert fixed["repaired"] == (
        "The buyer shall maintain the facility and keep the cross-border notes under the customary conditions of the agreement until the lenders have approved it. "
        "The company will pay all notes.\nThe lenders may not assign it."
    )
    assert scanclean.scan_findings(df.limit(0), "id", "t").count() == 0


def test_line_features_know_no_lengths():
    """Running headers and page numbers are seen beside long lines and when long themselves."""
    long = "word " * 60
    head = "A running header of more than ninety characters that a wide page carries at its top, again and again"
    f = scanclean.line_features([head, long, " " * 40 + "- 12 -" + " " * 40, head, long + "x"])
    assert f[:, 1].tolist() == [1, 0, 0, 1, 0] and f[2, 0] == 1 and f[3, 2] == 1


def test_frequent_list_changes_nothing(spark):
    random.seed(8)
    stems = ["lorn", "merge", "clause", "bond", "river", "modern", "tender", "figure", "quorum", "ledger"]
    texts = [" ".join(random.choice(stems) + random.choice(["", "s", "ing", "1y", "rn"]) for _ in range(40)) for _ in range(60)]
    texts.append("Zorrnak paid. Zormak paid. Zormak paid " + "fi1ing " * 3)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    want = {tuple(r) for r in scanclean.scan_findings(df, "id", "t", frequent_words=0).collect()}
    assert want and all({tuple(r) for r in scanclean.scan_findings(df, "id", "t", frequent_words=n).collect()} == want for n in (5, 10_000))


def test_long_words_meet_by_skeleton(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    read = long.replace("m", "rn").replace("l", "1")
    counts = spark.createDataFrame([(long, 9), (read, 1), ("x" * 300_000, 2), ("clear", 1), ("dear", 2), ("123", 9)], "word string, n bigint")
    got = {r["word"]: r["meant"] for r in scanclean.misread_words(counts).collect()}
    assert got == {read: long}


def test_viterbi_equals_brute_force():
    from itertools import product

    model = scanclean.LineModel()
    lines = ["Exhibit 1", "", "some text here", "7", "more text"]
    f = scanclean.line_features(lines)
    score = sum(e[:, f[:, j]].T for j, e in enumerate(model.emit))
    best = max(product(range(4), repeat=5), key=lambda p: model.start[p[0]] + sum(score[t, p[t]] for t in range(5)) + sum(model.move[a, b] for a, b in zip(p, p[1:])))
    assert tuple(model.decode([f, f[:2]])[0]) == best


# ------------------------------------------------------------- abuse


CLEAN = ["The buyer kept report {n} for its own staff.", "A dull loan number {n} was priced at par today.", "The board met on day {n} and voted."]
BAD = ["Only a moron like you would file report {n}.", "Drop dead, you greedy pig, on day {n}.", "What a worthless idiot wrote loan number {n}."]


def abuse_model():
    random.seed(4)
    texts, labels = [], []
    for n in range(240):
        t = [random.choice(CLEAN).format(n=random.randint(0, 999)) for _ in range(5)]
        if n % 4 == 0:
            t.insert(random.randint(0, 5), random.choice(BAD).format(n=n))
        texts.append(" ".join(t))
        labels.append(int(n % 4 == 0))
    return abuse.AbuseModel.fit(texts, labels)


def test_abuse_finds_single_sentences_and_spellings():
    model = abuse_model()
    bad = ["A dull loan number 3 was priced at par today. ONLY A M0RON LIKE YOU WOULD FILE REPORT 5.", "Drop dead, you greedyyyy p.i.g, on day 9."]
    good = ["The board met on day 77 and voted. A dull loan number 8 was priced at par today.", "", "x", "\n\n"]
    score = model.score(bad + good)
    assert (score[:2] > 0).all() and (score[2:] <= 0).all()
    # Order and company do not change a score.
    assert np.allclose(model.score(good + bad)[4:], score[:2])


def test_abuse_short_sentences_and_scripts():
    random.seed(5)
    texts = [" ".join([*(random.choice(CLEAN).format(n=random.randint(0, 999)) for _ in range(4)), *(["Moron."] if n % 3 == 0 else []), *(["Привет, это обычный отчёт."] if n % 2 else [])]) for n in range(240)]
    model = abuse.AbuseModel.fit(texts, [int(n % 3 == 0) for n in range(240)])
    assert (model.score(["Moron.", "A dull loan number 1 was priced at par today. Moron.", "MОRОN!", "m\u200boron."]) > 0).all()
    assert (model.score(["Привет, это обычный отчёт.", "The board met on day 5 and voted.", "Ok.", "¿?"]) <= 0).all()
    s, _, _ = abuse.symbols(["Привет мир"])
    assert len(set(s.tolist())) > 6


def test_abuse_overlong_sentences_are_cut_at_blanks():
    model = abuse_model()
    for shift in range(0, 60, 7):
        text = "x " * 1000 + "y" * shift + " only a moron like you would file report nine " + "z " * 3000
        s, starts, _ = abuse.symbols([text])
        assert len(starts) > 1 and all(s[k] == 0 for k in starts[1:])
    assert model.score(["q" * 10_000, "ab" * 10_000]).tolist()


def test_abuse_rows(spark):
    docs = spark.createDataFrame([(n, (BAD if n % 4 == 0 else CLEAN)[n % 3].format(n=n) + " " + CLEAN[n % 2].format(n=n), "s", "u") for n in range(160)] + [(900, None, None, None), (901, "", "s", None), (901, "", "s", None)], "doc_id bigint, text string, source string, score string")
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(160)] + [(3, None), (None, 1), (5000, 1)], "doc_id bigint, abusive bigint")
    scores = abuse.abuse_scores(docs, abuse.train_model(docs, labels), keep=["source"])
    assert scores.count() == 163
    assert {r["doc_id"] % 4 for r in scores.filter("abusive").collect()} == {0} and scores.filter("abusive").count() >= 36
    rates = {r["source"]: r["documents"] for r in abuse.abuse_rates(scores).collect()}
    assert rates == {"s": 162, None: 1}
    none = abuse.train_model(docs, labels.limit(0))
    assert abuse.abuse_scores(docs, none).filter("abusive").count() == 0
    assert abuse.abuse_scores(docs.limit(0), none).count() == 0


# ------------------------------------------------------------- mixing


def test_mixture_shares_and_caps(spark):
    random.seed(5)
    rows = [(n, "word " * random.randint(5, 30), "big") for n in range(600)] + [(1000 + n, "word " * 20, "small") for n in range(20)] + [(2000, None, "big"), (2001, "x", None), (None, "y", "big"), (2002, "q" * 100_000, "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("none", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats bigint")
    mix = mixing.mix_sources(docs, targets)
    report = {r["source"]: r for r in mixing.mixture_report(mix, targets).collect()}
    assert report["big"]["actual_share"] == pytest.approx(0.8, abs=0.02) and report["small"]["actual_share"] == pytest.approx(0.2, abs=0.02)
    assert report["small"]["most_copies"] <= 3 and report["big"]["most_copies"] <= 1 and report["none"]["tokens"] == 0
    assert mix.groupBy("doc_id").count().filter("count > 1").count() == 0
    capped = {r["source"]: r for r in mixing.mixture_report(mixing.mix_sources(docs, targets, total_tokens=10**7), targets).collect()}
    assert capped["small"]["most_copies"] == 3
    assert sorted(map(tuple, mixing.mix_sources(docs, targets, partition_rows=40).collect())) == sorted(map(tuple, mix.collect()))
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0
    assert mixing.mix_sources(docs, targets.limit(0)).count() == 0


def test_weighted_keys_prefer_quality(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).withColumn("w", F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0))
    first = df.withColumn("k", mixing.exponential_key("id", F.col("w"), 7)).orderBy("k").limit(400)
    share = first.filter("id % 2 = 0").count() / 400
    assert 0.72 < share < 0.88


def test_mixture_takes_quality_and_spreads_any_weights(spark):
    """The fractional part of a source prefers records of weight; weights far below 1 or none still spread over partitions."""
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("plain words of one length here").alias("text"), F.lit("a").alias("source"), (F.col("id") % 3 * 1e-9).alias("w"))
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats bigint")
    mix = mixing.mix_sources(docs, targets, total_tokens=6 * 1000, quality=F.col("w"), partition_rows=100)
    by = {r["k"]: r["count"] for r in mix.groupBy((F.col("doc_id") % 3).alias("k")).count().collect()}
    assert 990 <= sum(by.values()) <= 1000 and by.get(0, 0) == 0 and by[2] > 1.3 * by[1]
    clean, table = "The buyer will keep the brand and its staff.", "1 2 3 | 4 5 6 | 1 2 3 | 4 5 6"
    weights = spark.createDataFrame([(1, clean), (2, table), (3, ""), (4, None), (5, clean * 50)], "id int, t string")
    w = {r["id"]: r["w"] for r in weights.withColumn("w", mixing.text_quality(F.col("t"))).collect()}
    assert w[1] > w[2] > w[5] and w[3] == 0 and w[4] == 0


def test_tokens_of_endless_words_are_exact():
    path = mixing.default_tokenizer()
    text = "Some words before. " + "xy" * 5000 + " and some after, with 12 numbers."
    assert mixing.count_tokens(text, path) == len(mixing._encoder(path).encode_ordinary(text))


def test_hashed_sample_and_task_fit(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    rows = samples.hashed_sample(df, ["k"], 40).collect()
    assert len(rows) == 40 and samples.hashed_sample(df.limit(0), ["k"], 40).count() == 0
    assert {r["k"] for r in samples.hashed_sample(df.repartition(7), ["k"], 40).collect()} == {r["k"] for r in rows}
    total = lambda pdf: (len(pdf), pdf["k"].sum())
    assert samples.fit_in_task(df, total) == (500, 499 * 250) and samples.fit_in_task(df.limit(0), total) == (0, 0)
