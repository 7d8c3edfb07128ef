"""Operators for training data: brute force, exact round trips and the edge cases their docstrings define."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.llm import bktree
from leafspan.llm import p1_terms as p1
from leafspan.llm import p2_consensus as p2
from leafspan.llm import p3_canonical as p3
from leafspan.llm import p4_linkage as p4
from leafspan.llm import p5_personal as p5
from leafspan.llm import p6_scan_noise as p6
from leafspan.llm import p7_encoding as p7
from leafspan.llm import p8_mix as p8
from leafspan.llm import p9_encoding_repair as p9
from leafspan.llm import registry
from leafspan.llm.pages import layout, outline, page_number_words
from leafspan.llm.tokenizing import encoder, tokenizer_path


def test_registry_names():
    names = registry.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} | {"p7_ids", "p8_mix"} <= set(names)
    assert set(registry.oracle_sql()) <= set(names)


# -- 1


@pytest.mark.parametrize("text,want", [("The,", "the"), ("“Ｗｉｄｅ”", "wide"), ("ret­urn", "return"), ("--", None), ("", None), (None, None), ("ﬁle", "file"), ("a-b!", "a-b"), ("ét", "ét")])
def test_canonical_term(text, want):
    assert p1.canonical_term(text) == want


def test_term_frequencies(spark):
    rows = [(f, i, t, "x") for i, (f, t) in enumerate([(1, "The"), (1, "the,"), (2, "THE"), (3, "the"), (1, "Ｒare"), (4, None), (4, ""), (4, "--"), (None, "the")])]
    rows += [rows[0], rows[0]]  # delivered again
    df = spark.createDataFrame(rows, "file_id bigint, word_id bigint, text string, term string")
    out = {r.term: (r.occurrences, r.records, r.mark) for r in p1.term_frequencies(df, "text", "file_id", "word_id").collect()}
    assert out == {"the": (5, 3, "common"), "rare": (1, 1, "rare")}
    assert p1.term_frequencies(df.limit(0), "text", "file_id", "word_id").count() == 0


# -- 2


def test_consensus_finds_the_printed_text(spark):
    rng = random.Random(1)
    words = ["council", "garden", "record", "summary", "nurse", "clinic"]
    skill = [0.9, 0.8, 0.92, 0.95]
    rows, truth = [], {}
    for i in range(1500):
        w = rng.choice(words)
        read = [w if rng.random() < s else w.replace(w[k := rng.randrange(len(w))], rng.choice("xqz"), 1) for s in skill]
        if rng.random() < 0.1:
            read[rng.randrange(4)] = None
        rows.append((i, *read))
        truth[i] = w
    df = spark.createDataFrame(rows, "id bigint, a string, b string, c string, d string")
    acc = p2.annotator_reliability(df, list("abcd"))
    assert all(abs(acc[k]["accuracy"] - s) < 0.05 for k, s in zip("abcd", skill))
    out = p2.consensus(df.union(df), "id", list("abcd")).collect()
    cases = [r for r in rows if len({x for x in r[1:] if x}) > 1]
    assert len(out) == len(cases)
    good = [r for r in out if truth[r.id] in rows[r.id][1:]]
    assert sum(r.label == truth[r.id] for r in good) / len(good) > 0.98


def test_consensus_edge_cases(spark):
    df = spark.createDataFrame([(1, "a", "", None, "a"), (2, None, None, None, None), (None, "x", "y", None, None), (3, "b", "a", None, None)], "id bigint, a string, b string, c string, d string")
    out = {r.id: r.label for r in p2.consensus(df, "id", list("abcd"), disputed=False).collect()}
    assert out[1] == "a" and 2 not in out and out[None] in ("x", "y")
    assert p2.consensus(df.limit(0), "id", list("abcd")).count() == 0


# -- 3


def test_distances_and_tree():
    rng = random.Random(2)
    make = lambda n, m: ["".join(rng.choice("abcé") for _ in range(rng.randint(0, m))) for _ in range(n)]
    a, b = make(200, 70), make(200, 70)
    d = bktree.distances(bktree.Patterns(a), np.arange(200), bktree.Strings(b), np.arange(200))
    assert d.tolist() == [bktree.levenshtein(x, y) for x, y in zip(a, b)]
    entries, asked = make(150, 8), make(80, 8)
    tree = bktree.BKTree(entries)
    q, e, k = tree.search(asked, np.full(len(asked), 2))
    got = {(asked[i], tree.entries.values[j], int(n)) for i, j, n in zip(q, e, k)}
    assert got == {(x, y, bktree.levenshtein(x, y)) for x in asked for y in entries if bktree.levenshtein(x, y) <= 2}


def test_map_to_list(spark):
    entries = spark.createDataFrame([(1, "Cardobacillin"), (2, "twin fenedorf splint"), (3, "Praunorick"), (4, None), (None, "nothing")], "term_id bigint, term string")
    cases = {"cardobacilin": 1, "Cardobac.": 1, "CARDOBACILLIN)": 1, "splint, twin fenedorf": 2, "twin-fenedorf-splint": 2, "Prauno rick": 3, "garden": -1, "": None, "  ": None, None: None, "zzz" * 3000: -1}
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(cases)], "id bigint, v string, entry_id string")
    for shard, block in ((1, 3), (2, 1000), (50, 1000)):
        out = {r.id: r.got for r in p3.map_to_list(df, entries, "v", "term_id", "term", "got", shard=shard, block=block).collect()}
        assert [out[i] for i in range(len(cases))] == list(cases.values())
    assert {r.got for r in p3.map_to_list(df, entries.limit(0), "v", "term_id", "term", "got").collect()} == {-1, None}


def test_abbreviations_are_told_apart_among_any_number(spark):
    """Eighty entries begin alike; the only one that fits with its accents stands last in order. Shards agree with the whole list."""
    rows = [(i, f"zephyr{i:03d}") for i in range(80)] + [(900, "zéphyrzz")]
    entries = spark.createDataFrame(rows, "term_id bigint, term string")
    df = spark.createDataFrame([("zéph.",), ("zeph.",), ("zephyr07.",), ("zephyr0071",), ("Zephyr 007",)] * 3, "v string")
    for shard in (7, 1000):
        got = {r.v: r.got for r in p3.map_to_list(df, entries, "v", "term_id", "term", "got", shard=shard, block=2).collect()}
        assert got == {"zéph.": 900, "zeph.": -1, "zephyr07.": 7, "zephyr0071": 1, "Zephyr 007": 7}


# -- 4


def test_linkage(spark):
    rng = random.Random(4)
    words = "garden council summary record nurse clinic permit driver bridge engine filter ledger market signal window thread".split()
    rows, truth, n = [], set(), 0
    for page in range(6):
        for i, w in enumerate(rng.sample(words, 14)):
            x, y = 50 + 70 * (i % 5), 50 + 15 * (i // 5)
            here = []
            for e, (dx, dy, k) in {"tesseract": (0, 0, 1), "doctr": (4, -3, 1), "easyocr": (-3, 2, 150 / 72)}.items():
                if rng.random() < 0.1:
                    continue
                n += 1
                here.append(n)
                t = w if rng.random() < 0.8 else w.replace(w[1], "x", 1)
                j = lambda: rng.uniform(-0.8, 0.8)
                rows.append((1, page, n, e.upper() if n % 9 == 0 else e, t, (x + dx + j()) * k, (y + dy + j()) * k, (x + dx + 5 * len(w) + j()) * k, (y + dy + 10 + j()) * k))
            truth |= {(a, b) for a in here for b in here if a < b}
    df = spark.createDataFrame(rows, "file_id bigint, page bigint, word_id bigint, engine string, text string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, p, 612.0, 792.0) for p in range(6)], "file_id bigint, page bigint, width double, height double")
    got = {(r.word_a, r.word_b) for r in p4.link_rows(df.union(df.limit(5)), pages).where("confidence >= 0.5").collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got - truth) <= 0.03 * len(got)
    assert p4.link_rows(df.limit(0), pages).count() == 0


# -- 5


def values(text):
    lines = [l.split() for l in text.split("\n")]
    words = [w for l in lines for w in l]
    line = [k for k, l in enumerate(lines) for _ in l]
    return [(w, k) for w, k in zip(words, p5.page_values(words, line)) if k]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Name: Dorian O'Ethanenick", {"Dorian": "name", "O'Ethanenick": "name"}),
        ("Owner: Mrs. Iskegard\nTotal $5", {"Iskegard": "name"}),
        ("Patient: small summary", {}),
        ("Model Hazel 747.", {}),
        ("Dear Paula, the test", {"Paula,": "name"}),
        ("Please call M. Venuribek at 6175550176. Of", {"M.": "name", "Venuribek": "name", "6175550176.": "phone"}),
        ("Tel. +44 1632 960 200\nLot 5", {"+44": "phone", "1632": "phone", "960": "phone", "200": "phone"}),
        ("Part no. 788-936-5464", {}),
        ("Insurance no. QQ 53 56 63 C", {"QQ": "idno", "53": "idno", "56": "idno", "63": "idno", "C": "idno"}),
        ("SSN: 994-03-8492", {"994-03-8492": "idno"}),
        ("Address: 195a Casdorf Way, #155, Rovosen, XW 91540\nMobile: 555-0161", {"195a": "address", "Casdorf": "address", "Way,": "address", "#155,": "address", "Rovosen,": "address", "XW": "address", "91540": "address", "555-0161": "phone"}),
        ("Deliver Stengardweg 4653a, 95997 Casanewick\nOpen", {"Stengardweg": "address", "4653a,": "address", "95997": "address", "Casanewick": "address"}),
        ("Room 9 Quorman Road entrance", {}),
        ("pieces @ 4.46 each", {}),
        ("E-mail chase+forms @corvane.example", {"chase+forms": "email", "@corvane.example": "email"}),
        ("Petra and Silas Solerilund signed the note", {"Petra": "name", "Silas": "name", "Solerilund": "name"}),
    ],
)
def test_personal_values(text, want):
    assert dict(values(text)) == want


# -- 6


def test_page_numbers():
    for line in ("Page 2 of 4", "p. 3", "- 2 -", "3/3", "[1]", "ii"):
        assert all(page_number_words(line.split())), line
    assert page_number_words("Form T-56 1/2".split()) == [False, False, True]
    assert not any(page_number_words("Confidential Measurement File".split()))


def page(lines, top=40.0):
    texts, y0 = [], []
    for k, l in enumerate(lines):
        for w in l.split(" "):
            texts.append(w)
            y0.append(top + 14 * k if not l.startswith("Page") else 750.0)
    return texts, y0, [y + 10 for y in y0]


def test_headers_numbers_and_hyphens():
    one = page(["Late Garden Summary", "Late Garden Summary", "The nurse mea-", "sured the post-", "and the rest", "Page 1 of 2"])
    two = page(["Late Garden Summary 5/2/23", "of the test.", "Page 2 of 2"])
    o1, o2 = outline(layout(*one)), outline(layout(*two))
    near = {"d": 1, "outline": o2, "head": [l.split() for l in ("Late Garden Summary 5/2/23", "of the test.")], "tail": None}
    found, joins, _ = p6.page_kinds(*one, o1, 0, [near])
    kinds = {}
    for i, k in found:
        kinds.setdefault(k, []).append(one[0][i])
    assert kinds["header"] == ["Late", "Garden", "Summary"] and kinds["pageno"] == "Page 1 of 2".split() and kinds["hyphen"] == ["mea-", "sured"]
    assert [(j.joined, j.hyphenated) for j in joins] == [("measured", "mea-sured")]
    back = {"d": -1, "outline": o1, "head": None, "tail": [l.split() for l in ("sured the post-", "and the rest")]}
    found, _, _ = p6.page_kinds(*two, o2, 1, [back])
    assert [two[0][i] for i, k in found if k == "header"] == "Late Garden Summary 5/2/23".split()


def test_misread_words(spark):
    counts = spark.createDataFrame([("the", 5000, 400), ("thc", 20, 2), ("garden", 300, 20), ("gardens", 5, 0), ("gardcn", 2, 0), ("rupert", 12, 12), ("report", 200, 20), ("tearn", 1, 0), ("team", 90, 5), ("zz", 1, 0)], "word string, n bigint, capital bigint").withColumn("conf", F.lit(None).cast("double"))
    assert {r.word: r.meant for r in p6.misread_words(counts).collect()} == {"thc": "the", "gardcn": "garden", "tearn": "team"}
    assert p6.misread_words(counts.limit(0)).count() == 0


def test_misread_words_with_separate_edits(spark):
    counts = spark.createDataFrame([("approved", 475, 20), ("opprovcd", 1, 0), ("period", 186, 10), ("peri0cl", 1, 0), ("summary", 686, 40), ("surnmarv", 1, 0), ("order", 125, 5), ("vorzer", 2, 2), ("over", 100, 5), ("every", 2754, 90), ("0ver", 1, 0)], "word string, n bigint, capital bigint").withColumn("conf", F.lit(None).cast("double"))
    assert {r.word: r.meant for r in p6.misread_words(counts).collect()} == {"opprovcd": "approved", "peri0cl": "period", "surnmarv": "summary", "0ver": "over"}


def test_hashes_meet_within_two_edits(spark):
    rng = random.Random(6)
    make = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(5, 8)))
    words = sorted({make() for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    h = p6._hashes(df, ["word"])
    met = {(r.word, r.other) for r in h.join(h.select(h.word.alias("other"), "h"), "h").select("word", "other").distinct().collect()}
    assert {(a, b) for a in words for b in words if bktree.levenshtein(a, b) <= 2} <= met


def test_corrections_keep_edges_and_case():
    cases = {"gardcn.": "garden.", "(GARDCN)": "(GARDEN)", "“Gardcn,”": "“Garden,”", "gard*cn~": "garden"}
    assert {t: p6.corrected(t, "garden") for t in cases} == cases and p6.corrected("x.", None) == "x."
    one = page(["all of the mea-", "surcd gardcn. And"])
    own = outline(layout(*one))
    fixes = [{"word_id": 4, "meant": "measured", "whole": "measurcd"}, {"word_id": 5, "meant": "garden", "whole": None}]
    assert [x["paragraph"] for x in p6.page_paragraphs(*one, own, 0, [], None, fixes, [], list(range(7)))] == ["all of the measured garden. And"]


def test_hyphens_are_kept_by_evidence(spark):
    """Forms written elsewhere decide; where there are none, two words of their own keep their hyphen. The repaired text shows it."""
    body = ["a well-known and self-employed man", "he measured the twenty one words", "unknown", "they are well-", "known and mea-", "sured by self-", "employed twenty-", "one men out-", "standing"]
    rows = [("a", 1, 0, i, w, y, y + 10, None) for i, (w, y) in enumerate((w, 40.0 + 14 * k) for k, l in enumerate(body) for w in l.split())]
    df = spark.createDataFrame(rows, "src string, file_id bigint, page bigint, word_id bigint, text string, y0 double, y1 double, conf double")
    got = {r.correction for r in p6.find_noise(df).where("kind = 'hyphen'").collect()}
    assert got == {"well-known", "measured", "self-employed", "twenty-one", "outstanding"}
    assert "they are well-known and measured by self-employed twenty-one men outstanding" in " ".join(r.paragraph for r in p6.repaired_text(df).orderBy("page", "position").collect())


def test_broken_shapes_meet_frequent_ones(spark):
    texts = ["garden"] * 40 + ["12.50"] * 40 + ["gar*en", "3l.50", "g.a;r/d.e(n"]
    df = spark.createDataFrame([("a", 1, 0, i, t, 40.0 + 14 * i, 50.0 + 14 * i, None) for i, t in enumerate(texts)], "src string, file_id bigint, page bigint, word_id bigint, text string, y0 double, y1 double, conf double")
    assert {texts[r.word_id] for r in p6.find_noise(df).where("kind = 'misread'").collect()} == {"gar*en", "3l.50"}


def test_low_confidence_is_evidence(spark):
    counts = [("garden", 100, 0, 90.0), ("gardan", 16, 0, 60.0), ("gardon", 16, 0, 88.0), ("gardun", 16, 0, None)]
    df = spark.createDataFrame(counts, "word string, n bigint, capital bigint, conf double")
    assert {r.word for r in p6.misread_words(df).collect()} == {"gardan"}
    # the same shares of a corpus a thousand times as large
    assert {r.word for r in p6.misread_words(df.withColumn("n", F.col("n") * 1000)).collect()} == {"gardan"}


def test_paragraphs_go_on_over_pages(spark):
    rows = [(0, 0, "One.", False), (0, 1, "two begins", False), (1, 0, "and goes on", True), (2, 0, "to here.", True), (2, 1, "Three", False), (4, 0, "apart", True)]
    df = spark.createDataFrame([("a", 1, *r) for r in rows], "src string, file_id bigint, page bigint, position int, paragraph string, continues boolean")
    out = {(r.page, r.position, r.paragraph, r.to_page) for r in p6.joined_over_pages(df).collect()}
    assert out == {(0, 0, "One.", 0), (0, 1, "two begins and goes on to here.", 2), (2, 1, "Three", 2), (4, 0, "apart", 4)}


def test_noise_and_personal_words_of_odd_tables(spark):
    schema = "src string, file_id bigint, page bigint, word_id bigint, text string, y0 double, y1 double"
    df = spark.createDataFrame([("a", 1, 0, 1, None, 40.0, 50.0), ("a", 1, 0, 2, "", None, None), ("a", 1, 0, 3, "x" * 5000, 40.0, 50.0), ("a", None, 0, 4, "y", 1.0, 2.0), ("a", 1, 0, 3, "x" * 5000, 40.0, 50.0)], schema)
    assert p6.find_noise(df).count() == 0 and p5.personal_words(df).count() == 0 and p6.repaired_text(df).count() == 1
    assert p6.find_noise(df.limit(0)).count() == 0 and p5.personal_words(df.limit(0)).count() == 0


# -- 7


def test_encoding_is_exact_and_comes_back(spark):
    rng = random.Random(7)
    signs = list("ab1 2 \n\r\t,.:'s  é　\xa0\x85ß界🙂<|endoftext|>\x1c-²٣")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    e = encoder(tokenizer_path())
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(e.ids(t), np.int32).tolist() for t in texts] == want
    rows = [(i, t, 5) for i, t in enumerate(texts[:300] + ["", None, "word " * 50_000])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = {r.doc_id: r for r in p7.decode_corpus(p7.encode_corpus(df)).collect()}
    assert all(out[i].decoded == (t or "") for i, t, _ in rows) and out[300].ids == out[301].ids == []
    spot = p7.encode_corpus(df.where("doc_id = 2"), offsets=True).first()
    assert all(0 <= x.start <= x.end <= len(texts[2]) for x in spot.ids)


# -- 8


def test_mix(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("one two three four five".split()) for _ in range(rng.randint(1, 30)))
    rows = [(i, "big" if i < 300 else "small" if i < 320 else None if i < 330 else "other", text()) for i in range(340)] + [(900, "big", None), (901, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats bigint")
    mix = p8.mix_sources(docs, targets, buckets=16).collect()
    assert all(r.uses <= {"big": 1, "small": 2}[r.source] for r in mix) and len({r.doc_id for r in mix}) == len(mix)
    total = sum(r.n_tokens for r in p8.mix_sources(docs, targets.where("source <> 'gone'").selectExpr("source", "1.0 as target_share", "1 as max_repeats"), buckets=16).collect())
    used = sum(r.n_tokens * r.uses for r in mix if r.source == "big")
    assert abs(used - 0.6 * total) <= max(r.n_tokens for r in mix) / 2
    report = {r.source: r for r in p8.mix_report(p8.mix_sources(docs, targets, buckets=16), targets).collect()}
    assert report["gone"].tokens == 0 and report["small"].most_uses == 2 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-5
    assert p8.mix_sources(docs.limit(0), targets, buckets=16).count() == 0


# -- 9


def test_repair(spark):
    clean = ["Le café était fermé à midi", "La forêt où l’été dort", "Übermäßig schöne Grüße"]
    rows = [(i, clean[i % 3], "fr" if i % 3 < 2 else "de") for i in range(60)]
    bad = {100: clean[0].encode().decode("cp1252"), 101: clean[2].encode("cp1252").decode("cp850"), 102: clean[1].encode().decode("cp1252").encode().decode("cp1252"), 103: "caf� noir"}
    fine = {200: "Þórvald and Øystein ★ № √2", 201: None, 202: "", 203: "plain"}
    df = spark.createDataFrame(rows + [(k, v, "de" if k == 101 else "fr") for k, v in (bad | fine).items()], "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in p9.repair_documents(df).collect()}
    assert set(out) == set(bad)
    assert out[100].repaired == clean[0] and out[101].repaired == clean[2] and out[102].repaired == clean[1] and out[103].n_lost == 1
    assert p9.repair_documents(df.limit(0)).count() == 0


def test_short_garbles_of_documents_without_language(spark):
    rows = [(i, "Grüße für Müller" if i % 2 else "déjà été là", "de" if i % 2 else "fr") for i in range(40)]
    odd = [(100, "Müller f³r Grüße", None), (101, "f³r", "und"), (102, "Müller für Grüße", None), (103, "x³y", None), (104, "là été", " ")]
    df = spark.createDataFrame(rows + [(50, "f³r und Grüße", "de")] + odd, "doc_id bigint, text string, lang string")
    out = {r.doc_id: r.repaired for r in p9.repair_documents(df).collect()}
    assert out == {50: "für und Grüße", 100: "Müller für Grüße", 101: "für"}


# -- 8, 9: exact shares, originals that garble again


def test_mix_that_meets_its_shares(spark):
    """The total is lowered until the smallest source suffices; an empty source is named, and the others keep their proportions."""
    docs = spark.createDataFrame([(i, "big" if i % 10 else "small", "word " * 20) for i in range(2000)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.4, 2), ("gone", 0.2, 1)], "source string, target_share double, max_repeats bigint")
    report = {r.source: r for r in p8.mix_report(p8.mix_sources(docs, targets, buckets=16, meet="shares"), targets).collect()}
    assert report["big"].actual_share == pytest.approx(0.5, abs=0.005) == report["small"].actual_share and report["small"].most_uses == 2
    assert report["gone"].short == "no documents" and report["small"].short is None
    full = {r.source: r for r in p8.mix_report(p8.mix_sources(docs, targets, buckets=16), targets).collect()}
    assert full["small"].short == "repeats exhausted" and full["big"].short is None and full["big"].actual_share > 0.4
    with pytest.raises(ValueError):
        p8.mix_sources(docs, targets, meet="other")


def test_originals_garble_to_their_forms():
    assert p9.garbles_to("für", "fÃ¼r") and p9.garbles_to("naïve-été", "naÃ¯ve-Ã©tÃ©") and not p9.garbles_to("für", "fÃ©r")
    assert "�" in "".join(p9.run_forms("é"))


def test_lost_signs_are_found_by_their_forms(spark):
    rows = [(i, "Il a vu l'été et la fenêtre.", "fr") for i in range(30)] + [(90, "Il a vu l'�t� et la fen�tre.", "fr"), (91, "plain text", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = p9.garbled_documents(df).collect()
    assert {r.doc for r in got if r.proof} == {90} and all(r.original is None for r in got)


def test_lexicon_and_form_are_learnt(spark):
    """Where two readings stand against two, the word that is known elsewhere and unbroken wins, and its voters are found to be reliable."""
    rows = [(i, w, w, w, w) for i, w in enumerate(["garden", "record", "council"] * 60)]
    rows += [(1000 + i, *r) for i, r in enumerate([("garden", "gardcn", "garden", "gardcn"), ("rec0rd", "rec0rd", "record", "record"), ("council", "counci1", "counci1", "council")] * 20)]
    rows += [(5000 + i, *(("garden",) * k + ("gxrden",) + ("garden",) * (3 - k))) for i, k in enumerate([0, 1, 2, 3] * 30)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, c string, d string")
    out = {r.label for r in p2.consensus(df, "id", list("abcd")).collect()}
    assert out == {"garden", "record", "council"}
    _, learnt = p2._weighed(p2._items(df, "id", list("abcd")), list("abcd"), [], True, True)
    assert learnt["lexicon"]["accuracy"] > 0.9 and set(learnt) == {*"abcd", *p2.EVIDENCE}


def test_other_splits_are_encoded_whole(spark):
    """A file that splits otherwise is seen to do so, and gives the library's ids all the same."""
    path = tokenizer_path("word_bpe_49k")
    enc = encoder(path)
    texts = ["Hello, World 12.5  twice", "x\n\ny .5", "", None, "naïve café"]
    assert not enc.splits and encoder(tokenizer_path()).splits
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.ids for r in p7.encode_corpus(df, path=path).collect()}
    assert got == {i: enc.tokenizer.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
