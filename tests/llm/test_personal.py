"""Problem 5: formats, taught names, redaction and pseudonyms."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafspan.llm import formats, pseudonyms
from leafspan.llm import p5_personal as p5
from leafspan.llm.pages import layout, outline

KEY = b"k"


def tagged(text, names=frozenset()):
    lines = [l.split() for l in text.split("\n")]
    words, line = [w for l in lines for w in l], [k for k, l in enumerate(lines) for _ in l]
    kinds = p5.page_values(words, line)
    p5.named_words(words, kinds, names)
    return {w: k for w, k in zip(words, kinds) if k}


@pytest.mark.parametrize(
    "text,want",
    [
        ("reach me on (555) 123-4567", {"(555)": "phone", "123-4567": "phone"}),
        ("her number is 555-123-4567", {"555-123-4567": "phone"}),
        ("my social is 123-45-6789", {"123-45-6789": "idno"}),
        ("he lives at 12 Baker Street, Springfield, IL 62704", {w: "address" for w in "12 Baker Street, Springfield, IL 62704".split()}),
        ("she lives at 7 Old Mill Lane, Norwich, these days", {w: "address" for w in "7 Old Mill Lane, Norwich,".split()}),
        ("card 4111 1111 1111 1111", {"4111": "idno", "1111": "idno"}),
        ("card 4111 1111 1111 1112", {}),
        ("social 666-45-6789 and 000-12-3456", {}),
        ("insured as AB123456C. then", {"AB123456C.": "idno"}),
        ("patient 943 476 5919 came", {"943": "idno", "476": "idno", "5919": "idno"}),
        ("to GB82 WEST 1234 5698 7654 32 now", {w: "idno" for w in "GB82 WEST 1234 5698 7654 32".split()}),
        ("dial +44 20 7946 0958, or", {"+44": "phone", "20": "phone", "7946": "phone", "0958,": "phone"}),
        ("Part no. 555-223-4567 and Prt nr. 555-223-4567", {}),
        ("Room 12 Baker Street entrance", {}),
        ("on 12/25/2024 at 10:30", {}),
    ],
)
def test_values_without_captions(text, want):
    assert tagged(text) == want


def test_taught_names_stand_beside_another():
    names = {"selma", "corfold"}
    assert tagged("today Selma Corfold and Selma alone met Corfold.", names) == {"Selma": "name", "Corfold": "name"}
    assert tagged("the letter of A. Corfold came", names) == {"A.": "name", "Corfold": "name"}
    assert tagged("then CORFOLD, Selma came", names) == {"CORFOLD,": "name", "Selma": "name"}
    assert tagged("the selma corfold and Corfold Bearing: x", names) == {}


def words_of(spark, pages, src="words_slim"):
    rows, n = [], 0
    for (file, page), lines in pages.items():
        for k, l in enumerate(lines):
            for w in l.split(" "):
                n += 1
                rows.append((src, file, page, n, w, 40.0 + 14 * k, 50.0 + 14 * k, 90.0, "clash"))
    return spark.createDataFrame(rows, "src string, file_id bigint, page bigint, word_id bigint, text string, y0 double, y1 double, conf double, kind string")


def test_margins_and_pages_are_read(spark):
    """A running header is read as the body is; names taught by captions are found on other pages; nothing else changes."""
    head = "Name: Dorian Ashworth jane@x.org"
    pages = {(1, 0): [head, head, "the first page"], (1, 1): [head, "more of it"], (1, 2): [head, "and more"]}
    pages |= {(2, k): ["the test", f"Owner: Selma Corfold{'.' * (k % 2)}", "ends"] for k in range(12)} | {(3, 0): ["we met", "Selma Corfold again"]}
    w = words_of(spark, pages)
    got = p5.personal_words(w.union(w.limit(9)))
    kinds = {}
    for r in w.join(got.select("src", "word_id", got.kind.alias("got")), ["src", "word_id"]).collect():
        kinds.setdefault((r.file_id, r.page), []).append((r.word_id, r.text, r.got))
    assert all([(t, k) for _, t, k in sorted(kinds[1, p])][:3] == [("Dorian", "name"), ("Ashworth", "name"), ("jane@x.org", "email")] for p in range(3))
    assert [(t, k) for _, t, k in sorted(kinds[3, 0])] == [("Selma", "name"), ("Corfold", "name")]
    assert p5.personal_words(w.limit(0)).count() == 0
    text = {(r.file_id, r.page): r.text for r in p5.redacted_pages(w, "k").collect()}
    assert "Ashworth" not in " ".join(text.values()) and "jane" not in " ".join(text.values())
    token = text[3, 0].split("[NAME ")[1][:32]
    assert all(token in text[2, k] for k in range(12))


def test_a_value_over_a_page_break_has_one_pseudonym():
    one, two = (["the", "Tel.", "+44", "20"], [0.0, 0.0, 14.0, 14.0]), (["7946", "0958", "and", "more"], [0.0, 0.0, 14.0, 14.0])
    edges = [outline(layout(t, y, [x + 10 for x in y])) for t, y in (one, two)]
    a = p5.page_runs(*one, [x + 10 for x in one[1]], edges[0], 0, [{"d": 1, "outline": edges[1], "head": [["7946", "0958"], ["and", "more"]], "tail": None}])
    b = p5.page_runs(*two, [x + 10 for x in two[1]], edges[1], 1, [{"d": -1, "outline": edges[0], "tail": [["the", "Tel."], ["+44", "20"]], "head": None}])
    whole = pseudonyms.placeholder("phone", "+44 20 7946 0958", KEY)
    assert p5.redact_page(one[0], [0, 1, 2, 3], a, KEY) == f"the Tel. {whole}"
    assert p5.redact_page(two[0], [0, 1, 2, 3], b, KEY) == "and more"


def test_surroundings_stay_and_dates_can():
    v = p5.Value("phone", ["(555)", "223-4567."], [1, 2])
    texts = ["Tel.", "(555)", "223-4567.", "on", "2024-12-31"]
    assert p5.redact_page(texts, list(range(5)), [v], KEY, dates=False).endswith("]. on 2024-12-31")
    assert not p5.redact_page(texts, list(range(5)), [v], KEY).endswith("2024-12-31")


def test_feistel_is_a_permutation():
    assert sorted(pseudonyms.permute_digits(f"{i:03d}", KEY, "x") for i in range(1000)) == [f"{i:03d}" for i in range(1000)]
    for v in ("5550167", "12", "7", "00000000000"):
        assert pseudonyms.permute_digits(pseudonyms.permute_digits(v, KEY, "x"), KEY, "x", back=True) == v


@settings(max_examples=150, deadline=None)
@given(st.dates(min_value=pseudonyms._FIRST, max_value=pseudonyms._LAST), st.sampled_from(["%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y", "%m-%d-%Y", "{m}/{d}/{y}", "{d}.{m}.{y}", "{m}/{d}/{s}"]))
def test_dates_come_back_in_their_format(day, form):
    if "s}" in form and day.year < 2000:
        return
    v = form.format(m=day.month, d=day.day, y=day.year, s=f"{day.year % 100:02d}") if "{" in form else f"{day:{form}}".rjust(10, "0")
    new = pseudonyms.permute_date(v, KEY)
    assert new is not None and pseudonyms.permute_date(new, KEY, back=True) == v
    assert [c for c in new if not c.isdigit()] == [c for c in v if not c.isdigit()] and ("%" not in form or len(new) == len(v))


def test_no_dates():
    for v in ("13/45/20", "2024-02-30", "1/2", "12-345-67", "1899-12-31", ""):
        assert pseudonyms.permute_date(v, KEY) is None


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**9 - 1))
def test_numbers_stay_valid_and_come_back(n):
    d = f"{n:09d}"
    card = "411111" + d
    card = f"{card}{pseudonyms._card_check(card)}"
    values = [("phone", f"+44 20 {d[:4]} {d[4:8]}"), ("phone", f"(555) 2{d[:2]}-{d[2:6]} x{d[6:]}"), ("idno", " ".join(card[k : k + 4] for k in range(0, 16, 4)))]
    if formats.social(s := f"{d[:3]}-{d[3:5]}-{d[5:]}"):
        values.append(("idno", s))
    if (c := pseudonyms._health_check(d)) is not None:
        values.append(("idno", f"{d[:3]} {d[3:6]} {d[6:]}{c}"))
    for kind, v in values:
        new = pseudonyms.permute_number(kind, v, KEY)
        assert pseudonyms.permute_number(kind, new, KEY, back=True) == v
        assert formats.phone(new) if kind == "phone" else formats.idno(new)
        assert [x for x in new if not x.isdigit()] == [x for x in v if not x.isdigit()]
    assert pseudonyms.permute_number("phone", "+44 20 7946 0958", KEY).startswith("+44 20 ")


def test_equal_values_are_linked():
    a, b = (pseudonyms.permute_number("phone", v, KEY) for v in ("555-223-4567", "(555) 223-4567"))
    assert formats.digits_of(a) == formats.digits_of(b) != "5552234567"
    assert pseudonyms.placeholder("name", "Selma CORFOLD", KEY) == pseudonyms.placeholder("name", "selma\ncorfold", KEY) != pseudonyms.placeholder("name", "Selma Corfold", b"j")
    iban = pseudonyms.permute_number("idno", "GB82 WEST 1234 5698 7654 32", KEY)
    assert formats.iban(iban) and iban[:2] == "GB" and "WEST" in iban
