"""Operators against brute force and small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from leafspan import config, session
from leafspan.operators import compact as C
from leafspan.operators import fusion as V
from leafspan.operators import harmonize as H
from leafspan.operators import layout as L
from leafspan.operators import matching as M
from leafspan.operators import quality as Q
from leafspan.operators import sanitize as S
from leafspan.sources import files
from leafspan.streaming import words as J

WORD = "file_id bigint, page bigint, word_id bigint, engine string, idx bigint, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_greedy_assign_is_a_serial_dictatorship(spark):
    rng = random.Random(3)
    rows = [(g, l, r, float(rng.randint(1, 5))) for g in range(6) for l in range(8) for r in range(8) if rng.random() < 0.5]
    got = {(x.g, x.l, x.r) for x in M.greedy_assign(spark.createDataFrame(rows, "g bigint, l bigint, r bigint, s double"), ["g"], "l", "r", "s").collect()}
    want = set()
    for g in range(6):
        used = set()
        for l in range(8):
            best = max(((s, -r) for gg, ll, r, s in rows if (gg, ll) == (g, l) and r not in used), default=None)
            if best:
                used.add(-best[1])
                want.add((g, l, -best[1]))
    assert got == want


@pytest.mark.parametrize("k", [1, 2, 3])
def test_similar_pairs_is_exact(spark, k):
    rng = random.Random(k)
    make = lambda n: list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(n)})
    a, b = make(60), make(60)
    pairs = S.similar_pairs(spark.createDataFrame([(x,) for x in a], "query string"), spark.createDataFrame([(x,) for x in b], "term string"), k)
    got = sorted((r["query"], r["term"], r["distance"]) for r in pairs.collect())
    assert got == sorted((x, y, levenshtein(x, y)) for x in a for y in b if levenshtein(x, y) <= k)


def test_banded_pairs_gives_each_pair_once(spark):
    rng = random.Random(5)
    # words of all heights, the tallest as tall as the page
    rows = [(1, p, p * 100 + i, e, i, "w", rng.uniform(0, 90), y := rng.uniform(0, 200), 95.0, y + rng.choice([3, 10, 60, 200]), 90.0) for p in range(2) for e in ("tesseract", "doctr") for i in range(30)]
    w = spark.createDataFrame([(a, b, n, *r) for n, (a, b, _, *r) in enumerate(rows)], WORD)
    t, d = w.where("engine = 'tesseract'"), w.where("engine = 'doctr'")
    tt, dd = t.collect(), d.collect()
    for reach in (0.0, 12.0, 70.0):
        got = sorted((r.l_word_id, r.r_word_id) for r in M.banded_pairs(t, d, reach).collect())
        assert len(got) == len(set(got))
        mid = lambda r: (r.y0 + r.y1) / 2
        meets = lambda a, b: a.y0 <= max(b.y1, mid(b) + reach) and min(b.y0, mid(b) - reach) <= a.y1
        need = {(a.word_id, b.word_id) for a in tt for b in dd if a.page == b.page and (meets(a, b) or abs(mid(a) - mid(b)) <= reach)}
        assert need <= set(got) and {(a.word_id, b.word_id) for a in tt for b in dd if a.page != b.page}.isdisjoint(got)


def iou(a, b):
    w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
    return w * h / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - w * h) if w > 0 and h > 0 else 0.0


def random_words(spark, seed, n=40, engines=("tesseract", "doctr", "easyocr", "surya", "paddleocr"), pages=2):
    """Words of all heights, some far taller than a line."""
    rng = random.Random(seed)
    rows, i = [], 0
    for p in range(pages):
        for e in engines:
            for k in range(n):
                x, y, h = rng.uniform(0, 300), rng.uniform(0, 300), rng.choice([8, 10, 12, 100, 250])
                rows.append((1, p, i, e, k, rng.choice(["one", "Two.", "three", "x"]), x, y, x + rng.uniform(5, 120), y + h, float(rng.randint(0, 100))))
                i += 1
    return spark.createDataFrame(rows, WORD)


def test_tall_words_match_truth(spark):
    w = boxes(spark, [("a", (0, 0, 50, 100)), ("b", (0, 25, 50, 125))])
    assert [(r.found_id, r.truth_id) for r in M.match_to_truth(w.where("word_id = 0"), w.where("word_id = 1")).collect()] == [(0, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_secondaries_against_brute_force(spark, seed):
    """Suppression, corroboration and the words that only secondaries have, for five engines and words of any height."""
    df = random_words(spark, seed)
    all_ = df.collect()
    config = H.Config()
    mid = lambda r: ((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2)
    inside = lambda a, b: a.x0 <= mid(b)[0] <= a.x1 and a.y0 <= mid(b)[1] <= a.y1
    primary, second = [r for r in all_ if r.engine == "tesseract"], [r for r in all_ if r.engine != "tesseract"]
    gone = {r.word_id for r in second if r.confidence < 50 and sum(p.page == r.page and inside(r, p) for p in primary) >= 2}
    assert {r.word_id for r in H.suppressed(df).collect()} == gone
    assert {r.word_id for r in H.corroborated(df, 0.3).collect()} == {a.word_id for a in all_ if any(a.page == b.page and a.engine != b.engine and iou(a, b) >= 0.3 for b in all_)}
    matched = {r.r_word_id for r in H.match_secondaries(df).collect()}
    key = lambda r: r.text.lower().strip(".:,")
    clash = lambda a, b: a.page == b.page and (iou(a, b) >= config.match.iou or (key(a) == key(b) and abs(mid(a)[1] - mid(b)[1]) <= 15))
    kept = []
    for r in sorted(second, key=lambda r: (config.secondaries.index(r.engine), r.idx)):
        if r.word_id not in matched | gone and not any(clash(r, x) for x in [*primary, *kept]):
            kept.append(r)
    assert {r.word_id for r in H.unmatched_secondaries(df, H.match_secondaries(df)).collect()} == {r.word_id for r in kept}


@pytest.mark.parametrize("seed", [3, 4])
def test_line_matches_against_brute_force(spark, seed):
    df = random_words(spark, seed, n=25, engines=("tesseract", "surya"))
    words, lines = [r for r in df.collect() if r.engine == "tesseract"], [r for r in df.collect() if r.engine == "surya"]
    used, want = set(), set()
    for w in sorted(words, key=lambda r: r.idx):
        for l in sorted(lines, key=lambda r: r.idx):
            cx, cy = (w.x0 + w.x1) / 2, (w.y0 + w.y1) / 2
            if l.word_id not in used and l.page == w.page and l.x0 <= cx <= l.x1 and l.y0 <= cy <= l.y1:
                used.add(l.word_id)
                want.add((w.word_id, l.word_id))
                break
    assert {(r.l_word_id, r.r_word_id) for r in H.line_matches(df.where("engine = 'tesseract'"), df.where("engine = 'surya'")).collect()} == want
    config = H.Config(engines=H.ENGINES | {"surya": H.Engine(1.2, letter="S", lines=True)})
    assert {(r.l_word_id, r.r_word_id) for r in H.match_secondaries(df, config).where("engine = 'surya'").collect()} == want


def test_order_concordance_counts_all_pairs(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for page, n in enumerate((1, 2, 7, 8, 9, 33)):
        p = list(range(n))
        rng.shuffle(p)
        rows += [(1, page, 10 * i, x) for i, x in enumerate(p)]
        pairs = n * (n - 1) // 2
        wrong = sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n))
        want[page] = (pairs - 2 * wrong) / pairs if pairs else 1.0
    got = {r.page: r.concordance for r in L.order_concordance(spark.createDataFrame(rows, "file_id bigint, page bigint, word_id bigint, position bigint")).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("seed", [7, 8])
def test_deduplication_against_brute_force(spark, seed):
    df = random_words(spark, seed, n=20)
    kept = []
    for r in sorted(df.collect(), key=lambda r: r.word_id):
        same = lambda a, b: a.page == b.page and (iou(a, b) >= 0.5 or (a.text.lower() == b.text.lower() and ((a.x0 + a.x1 - b.x0 - b.x1) ** 2 + (a.y0 + a.y1 - b.y0 - b.y1) ** 2) ** 0.5 / 2 < 20))
        if not any(same(r, k) for k in kept):
            kept.append(r)
    assert {r.word_id for r in C.deduplicated(df).collect()} == {r.word_id for r in kept}


@pytest.mark.parametrize("seed", [9, 10])
def test_missed_content_blocks_its_own(spark, seed):
    rng = random.Random(seed)
    rows = [(1, 0, i, x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + rng.choice([20, 120]), y + rng.choice([4, 12, 40])) for i in range(60)]
    df = spark.createDataFrame(rows, "file_id bigint, page bigint, word_id bigint, x0 double, y0 double, x1 double, y1 double")
    kind = {r.word_id: r.k for r in df.select("word_id", Q.region_kind().alias("k")).collect()}
    blocked, want = df.where("word_id < 5").collect(), set()
    all_ = df.where("word_id >= 5").collect()
    for k in ("text", *Q.PASSES):
        for r in sorted(all_, key=lambda r: r.word_id):
            over = lambda a, b: iou(a, b) > 0.1 or (b.x0 <= (a.x0 + a.x1) / 2 <= b.x1 and b.y0 <= (a.y0 + a.y1) / 2 <= b.y1)
            if kind[r.word_id] == k and not any(over(r, b) for b in blocked):
                blocked.append(r)
                want.add((r.word_id, k))
    got = Q.missed_content(df.where("word_id >= 5"), df.where("word_id < 5"), ["file_id", "page"], "word_id", ("text", *Q.PASSES), block_own=True)
    assert {(r.word_id, r.kind) for r in got.collect()} == want


def test_interpolation_between_anchors(spark):
    """In the gap, squeezed into it, across lines, behind one, in front of one, and without any."""
    l, r = (0.0, 10.0, 20.0, 20.0), (100.0, 12.0, 120.0, 24.0)
    cases = [
        ("abcd", l, r, (22.0, 11.0, 62.0, 22.0)), ("abcdefghij", l, r, (22.0, 11.0, 98.0, 22.0)), ("ab", l, (100.0, 80.0, 120.0, 90.0), (22.0, 10.0, 42.0, 20.0)),
        ("ab", l, None, (22.0, 10.0, 42.0, 20.0)), ("ab", None, r, (78.0, 12.0, 98.0, 24.0)), ("abcdefghijkl", None, (50.0, 12.0, 60.0, 24.0), (0.0, 12.0, 48.0, 24.0)), ("ab", None, None, (50.0, 100.0, 70.0, 115.0)),
    ]
    rows = [(i, t, 10.0, 15.0, *(a or (None,) * 4), *(b or (None,) * 4)) for i, (t, a, b, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, text string, char_w double, char_h double, " + ", ".join(f"{p}{c} double" for p in ("l_", "r_") for c in ("x0", "y0", "x1", "y1")))
    got = [tuple(x) for x in df.orderBy("i").select(*V.interpolated()).collect()]
    assert got == [w for *_, w in cases]


def test_fusion_statuses(spark):
    """Matched words, a run set on regions, a run set behind its anchor, and a word that no text has, in reading order."""
    w = boxes(spark, [(t, (50 + 60 * i, 100, 100 + 60 * i, 112)) for i, t in enumerate("alpha beta gamma delta".split()) if t != "gamma"] + [("only", (50, 300, 90, 312))])
    vlm = V.tokenised(spark.createDataFrame([(1, 0, "Alpha beta gamma delta"), (2, 0, "lost")], "file_id bigint, page bigint, vlm_text string"))
    out = {r.text: r for r in V.fuse(vlm, w).collect()}
    assert {t: (r.status, r.confidence) for t, r in out.items()} == {"Alpha": ("vlm_matched", 0.9), "beta": ("vlm_matched", 1.0), "gamma": ("vlm_interpolated", 0.7), "delta": ("vlm_matched", 1.0), "only": ("ocr_only", 90.0)}
    assert [out[t].position for t in ("Alpha", "beta", "gamma", "delta", "only")] == list(range(5))
    region = spark.createDataFrame([(1, 0, 171.0, 101.0, 215.0, 111.0), (1, 0, 50.0, 100.0, 100.0, 112.0)], "file_id bigint, page bigint, x0 double, y0 double, x1 double, y1 double")
    placed = {r.text: r for r in V.fuse(vlm, w, region).collect()}["gamma"]
    assert (placed.status, placed.confidence, placed.x0) == ("vlm_pixel_placed", 0.8, 171.0)
    assert V.fuse(vlm, w.limit(0)).count() == 0 and {r.status for r in V.fuse(vlm.limit(0), w).collect()} == {"ocr_only"}


def test_neighbours_look_over_pages(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b."), (1, 2, 3, "c"), (1, 5, 4, "d"), (2, 0, 5, "e")]
    df = spark.createDataFrame(rows, "file_id bigint, page bigint, word_id bigint, text string")
    got = {r.text: (r.before, r.after) for r in S.neighbours(df, ["file_id", "page"], ["word_id"]).collect()}
    assert got == {"a": (None, "b"), "b.": ("a", "c"), "c": ("b", "d"), "d": ("c", None), "e": (None, None)}


def test_ties_go_to_the_first_entry(spark):
    words = spark.createDataFrame([(1, 0, 1, "catx", 70.0, "")], "file_id bigint, page bigint, word_id bigint, text string, confidence double, engine string")
    terms = spark.createDataFrame([("medical", 2, "cats", "cats", 1.0), ("medical", 1, "cate", "cate", 1.0), ("custom", 0, "cata", "cata", 1.0)], "dictionary string, ord bigint, term string, term_lower string, weight double")
    assert [r.sanitized_text for r in S.sanitize(words, terms, ranked=False).collect()] == ["cate"]
    far = spark.createDataFrame([(1, 0, 1, "zzzzzzz", 70.0, "")], words.schema)
    assert [r.sanitized_text for r in S.sanitize(far, terms, ranked=False, keep_uncertain=False).collect()] == [""]


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"harmonize": {"word_conf": 65, "match": {"iou": 0.4}, "engines": {"surya": {"weight": 2}}}}')
    s = config.load(str(tmp_path / "s.json"), {"layout": {"fuzz_times": 3}})
    assert (s.harmonize.word_conf, s.harmonize.match.iou, s.harmonize.engines["surya"].weight, s.layout.fuzz_times) == (65.0, 0.4, 2.0, 3.0)
    assert config.load().harmonize.word_conf == 60.0 and ("harmonize.word_conf", "float", "60.0", "65.0") in config.describe(s)
    with pytest.raises(ValueError):
        config.load(overrides={"harmonize": {"nothing": 1}})


def test_jobs_fail_alone(spark, tmp_path):
    """A batch whose work raises is marked as failed; the listener tells how far things are."""
    src = tmp_path / "in"
    src.mkdir()
    for i, t in enumerate(["good", "bad", "good"]):
        spark.createDataFrame([(i, t)], "file_id bigint, text string").coalesce(1).write.parquet(str(src / f"f{i}"))

    def work(rows):
        if rows.where("text = 'bad'").count():
            raise ValueError("no good")
        return rows

    seen = []
    listener = J.Progress(lambda batch, rows: seen.append((batch, rows)))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("file_id bigint, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
        J.run_jobs(stream, str(tmp_path / "out"), str(tmp_path / "state"), work).awaitTermination()
        got = {r.file_id: (r.rows, r.state, r.error) for r in J.job_table(spark, str(tmp_path / "out")).collect()}
    finally:
        spark.streams.removeListener(listener)
    assert got == {0: (1, "completed", None), 1: (1, "failed", "ValueError: no good"), 2: (1, "completed", None)}


def test_cut_refuses_a_cluster_without_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        session.shared_folder(Elsewhere)
    df = session.cut(spark.range(3))
    assert df.count() == 3 and session.clear(spark) >= 1


def test_harmonize_votes_and_adds_solo_words(spark):
    rows = [
        (1, 0, 1, "tesseract", 0, "Fi1e", 10.0, 10.0, 40.0, 20.0, 50.0), (1, 0, 2, "doctr", 0, "File", 10.0, 10.0, 40.0, 20.0, 95.0), (1, 0, 3, "easyocr", 0, "File", 11.0, 10.0, 41.0, 20.0, 90.0),
        (1, 0, 4, "doctr", 1, "alone", 100.0, 10.0, 140.0, 20.0, 99.0), (1, 0, 5, "easyocr", 1, "alone", 101.0, 10.0, 141.0, 20.0, 93.0),
    ]
    out = {r.word_id: r for r in H.harmonize(spark.createDataFrame(rows, WORD)).collect()}
    assert out[1].text == "File" and out[1].status == "word" and out[1].source == "TED"
    solo = [r for i, r in out.items() if i != 1]
    assert [r.text for r in solo] == ["alone"] and solo[0].status == "secondary_only"
    assert [r.position for r in sorted(out.values(), key=lambda r: r.x0)] == [0, 1]


def test_harmonize_of_nothing(spark):
    assert H.harmonize(spark.createDataFrame([], WORD)).count() == 0


def boxes(spark, rows):
    return spark.createDataFrame([(1, 0, i, t, *map(float, b), 90.0) for i, (t, b) in enumerate(rows)], "file_id bigint, page bigint, word_id bigint, text string, x0 double, y0 double, x1 double, y1 double, confidence double")


def test_reading_order_of_rows(spark):
    w = boxes(spark, [(f"{r}{c}", (50 + 60 * c, 100 + 30 * r, 100 + 60 * c, 120 + 30 * r)) for r in range(3) for c in range(4)])
    out = [r.word_id for r in L.reading_order(w).orderBy("position").collect()]
    assert out == list(range(12))


def test_components_match_a_search(spark):
    rng = random.Random(9)
    nodes = [(1, p, i) for p in range(3) for i in range(p * 20, p * 20 + 20)]
    edges = [(1, p, a, b) for p in range(3) for a in range(p * 20, p * 20 + 20) for b in range(a + 1, p * 20 + 20) if rng.random() < 0.06]
    got = {r.word_id: r.cluster for r in L.components(spark.createDataFrame(nodes, "file_id bigint, page bigint, word_id bigint"), spark.createDataFrame(edges, "file_id bigint, page bigint, a bigint, b bigint")).collect()}
    near = {n[2]: set() for n in nodes}
    for _, _, a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == min(seen)


def test_lines(spark):
    w = boxes(spark, [("a", (0, 0, 10, 10)), ("b", (12, 1, 20, 11)), ("c", (0, 30, 10, 40)), ("d", (12, 30, 20, 40))])
    assert [(r.line, r.text) for r in L.reconstruct_lines(w).orderBy("line").collect()] == [(0, "a b"), (1, "c d")]


@pytest.mark.parametrize(
    "vlm,ocr,want",
    [
        (["the", "cat"], ["the", "cat"], {0: 0, 1: 1}),
        (["Filel"], ["File"], {0: 0}),
        ("a quick brown fox jumps".split(), "a quick brown fox jumps".split(), dict(zip(range(5), range(5)))),
        ("a quick brown extra fox jumps".split(), "a quick brown fox jumps".split(), {0: 0, 1: 1, 2: 2, 4: 3, 5: 4}),
        ([], ["x"], {}),
    ],
)
def test_alignment(vlm, ocr, want):
    assert {i: j for i, (j, _) in V.align_page(vlm, ocr).items()} == want


def test_wrapping(spark):
    out = spark.range(1).select(V.wrapped(F.array(F.lit("aaaa"), F.lit("bbbb")), F.lit(500.0), F.lit(10.0), F.lit(22.0), F.lit(10.0), F.lit(15.0)).alias("w")).first()["w"]
    assert [(w.x0, w.y0, w.y1) for w in out] == [(500.0, 10.0, 22.0), (60.0, 30.0, 42.0)]


def test_sanitize_phases(spark):
    words = spark.createDataFrame(
        [(1, 0, i, t, c, e) for i, (t, c, e) in enumerate([("Filel", 70.0, ""), ("x", 10.0, ""), ("", 0.0, "pixel_detector"), ("12/31/24", 70.0, ""), ("patient", 70.0, ""), ("zzzzqqqq", 70.0, ""), ("PATIEMT.", 70.0, "")])],
        "file_id bigint, page bigint, word_id bigint, text string, confidence double, engine string",
    )
    terms = spark.createDataFrame([("medical", "patient", "patient", 1.2), ("custom", "file", "file", 1.5)], "dictionary string, term string, term_lower string, weight double")
    out = [(r.status, r.sanitized_text) for r in S.sanitize(words, terms, ranked=False).orderBy("word_id").collect()]
    assert out == [("corrected", "File"), ("skipped", "x"), ("skipped", ""), ("preserved", "12/31/24"), ("preserved", "patient"), ("uncertain", "zzzzqqqq"), ("corrected", "PATIENT.")]
    ranked = {r.word_id: r.sanitized_text for r in S.sanitize(words, terms).collect()}
    assert ranked[0] == "File"


def test_region_kinds(spark):
    rows = [((0, 0, 200, 5), "horizontal"), ((0, 0, 5, 80), "vertical"), ((0, 0, 100, 50), "logo"), ((0, 0, 60, 12), "text"), ((0, 0, 3, 3), None)]
    df = spark.createDataFrame([tuple(map(float, b)) for b, _ in rows], "x0 double, y0 double, x1 double, y1 double")
    assert [r.k for r in df.select(Q.region_kind().alias("k")).collect()] == [k for _, k in rows]


def test_csv_round_trip(spark, tmp_path):
    rows = [(0, 1, 'say "hi", you', 1.0, 2.0, 3.0, 4.0, "", 90.0), (0, 2, "", 1.0, 2.0, 3.0, 4.0, "pixel_detector", 0.0)]
    df = spark.createDataFrame(rows, files.WORD_SCHEMA)
    files.write(df, str(tmp_path / "w"), "csv")
    assert sorted(map(tuple, files.read_words(spark, str(tmp_path / "w")).collect())) == sorted(rows)
    with pytest.raises(ValueError):
        files.write(df, str(tmp_path / "x"), "xml")


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("# names\nAnna,500\nBo,20\nCleo\t300\n")
    d = files.read_dictionary(spark, str(tmp_path / "d.txt"), "names", frequencies=True, min_length=2, min_frequency=100)
    assert sorted((r.term, r.term_lower) for r in d.collect()) == [("Anna", "anna"), ("Cleo", "cleo")]
