import random
import time

import numpy as np
import pytest

from tracewright.llm import pii
from tracewright.llm.boosting import Boosted


def names_of(*words):
    levels = {}
    for g, f in words:
        levels[g.lower()], levels[f.lower()] = (6, levels.get(g.lower(), (0, 0))[1]), (levels.get(f.lower(), (0, 0))[0], 6)
    levels |= {g: (6, 6) for g, f in words if g == f}
    return pii.Names.of_words(levels)


NAMES = names_of(("Tamsin", "Overbrook"), ("Jürgen", "Faßbinder"), ("남궁세라", "남궁세라"), ("Łucja", "Dąbek"), ("Анна", "Белова"), ("Juan", "Ortega"), ("Carlos", "Ortega"), ("Jan", "Dijk"), ("Li", "Wei"), ("Jo", "Overbrook"))


def found(text, names=NAMES):
    (spans,) = pii.mentions_of([text], names, pii.trained())
    return [(pii.TYPES[s.kind], text[s.start : s.end]) for s in spans]


CASES = [
    ("The keys were handed over by Tamsin Overbrook yesterday.", [("person", "Tamsin Overbrook")]),
    ("Questions? 010-2345-6789, ask for J. Faßbinder.", [("phone", "010-2345-6789"), ("person", "J. Faßbinder")]),
    ("Frau Faßbinder sagte, bericht_7.pdf sei leer.", [("person", "Faßbinder")]),
    ("write to t.over [at] brook-mail.example today.", [("email", "t.over [at] brook-mail.example")]),
    ("write to tamsin AT overbrook DOT test today.", [("email", "tamsin AT overbrook DOT test")]),
    ("please answer jane.roe@corp-mail.co soon", [("email", "jane.roe@corp-mail.co")]),
    ("+44 (0)20 7946 0987 ext. 12", [("phone", "+44 (0)20 7946 0987")]),
    ("tel:212-555-0147", [("phone", "212-555-0147")]),
    ("Her insurance number is QQ 12 34 56 A as of May.", [("id_number", "QQ 12 34 56 A")]),
    ("Please deliver to 7 Harbour Road, Northwick, NY 10027 today", [("address", "7 Harbour Road, Northwick, NY 10027")]),
    ("She lives at 221 Baker Street, London NW1 6XE now.", [("address", "221 Baker Street, London NW1 6XE")]),
    ("Anschrift: Lindenallee 12, 1010 Wien", [("address", "Lindenallee 12, 1010 Wien")]),
    ("Vive en Calle de las Flores 12, 28013 Madrid, correo j.o@casa.es", [("address", "Calle de las Flores 12, 28013 Madrid"), ("email", "j.o@casa.es")]),
    ("이름: 남궁세라, 주소 한빛시 솔밭로 12길 7, 이메일 s@n.example.", [("person", "남궁세라"), ("address", "한빛시 솔밭로 12길 7"), ("email", "s@n.example")]),
    ("Signed by Łucja Dąbek and Анна Белова.", [("person", "Łucja Dąbek"), ("person", "Анна Белова")]),
    ("Please call Juan Carlos Ortega, Jan van Dijk or Li Wei.", [("person", "Juan Carlos Ortega"), ("person", "Jan van Dijk"), ("person", "Li Wei")]),
    ("session 1700000000123", []),
    ("imsi 450081234567890", []),
    ("SID S-1-5-21-123456789-987654321-1001", []),
    ("part no. 555-01-77-C is out of stock", []),
    ("icon arrow@2x.png is cached for user12", []),
    ("Amber Notes crashed with 4711 errors at 10:20:30.", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_mentions(text, want):
    assert found(text) == want if text else pii.mentions_of([text], NAMES, pii.trained()) == [[]]


def test_templates_held_out_as_a_whole():
    figures = pii.held_out_figures()
    for kind, (recall, precision) in figures.items():
        least = 0.8 if kind == "address" else 0.85
        assert recall > least and precision > least, (kind, figures)
    assert figures["email"][0] > 0.95 and figures["phone"][0] > 0.95


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    b = Boosted(rounds=30, depth=3).fit(x[:1500], y[:1500]).calibrate(x[1500:], y[1500:])
    assert ((b.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97


def test_frames(spark):
    rows = [(1, "write to a@b.test today, a@b.test", "z"), (1, "write to a@b.test today", "z"), (2, None, "z"), (3, "", "z"), (4, "word " * 30_000 + "write to a@b.test today", "z")]
    frame = spark.createDataFrame(rows, "row_id bigint, t string, pii_text string")
    got = pii.list_mentions(frame, "row_id", "t", NAMES)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "email", "a@b.test"), (1, "email", "a@b.test"), (4, "email", "a@b.test")]
    red = {r["row_id"]: r["redacted"] for r in pii.redact_column(frame, "row_id", "t", NAMES).collect() if r["row_id"] != 1}
    assert red[2] is None and red[3] == "" and red[4].endswith("write to [EMAIL] today")
    assert pii.list_mentions(frame.limit(0), "row_id", "t", NAMES).count() == 0


def test_count_names(spark):
    frame = spark.createDataFrame([("Ada Byron",), ("Byron, Ada",), ("A. Byron",), ("SYSTEM",), (None,), ("user12",), ("  ",)], "author string")
    names = pii.collected(pii.count_names(frame, "author"))
    assert names.of("ada")[0] > 0 and names.of("byron")[1] > names.of("byron")[0] == 0 and names.of("user12") == (0, 0)
    assert pii.count_names(frame.limit(0), "author").rows == 0


def test_levels_do_not_depend_on_the_size_of_the_corpus(spark):
    rows = [(f"{g} {f}",) for g in ("Ada", "Bea", "Cid") for f in ("Stone", "Wood") for _ in range(20)] + [("Rare Stone",)]
    small = spark.createDataFrame(rows, "author string")
    large = small.crossJoin(spark.range(64))
    levels = [pii.collected(pii.count_names(f, "author")) for f in (small, large.select("author"))]
    for word in ("ada", "bea", "stone", "wood", "rare"):
        assert levels[0].of(word) == levels[1].of(word)
    assert levels[0].of("ada") == (pii.USUAL, 0) and levels[0].of("rare")[0] < pii.USUAL


def test_very_many_other_names_change_nothing():
    rng = np.random.default_rng(3)
    others = pii.Names(rng.integers(0, 1 << 63, 2_000_000, np.uint64), np.full(2_000_000, 6, np.uint8), np.full(2_000_000, 6, np.uint8))
    both = pii.Names(np.concatenate([NAMES.keys, others.keys]), np.concatenate([NAMES.given, others.given]), np.concatenate([NAMES.family, others.family]))
    for text, want in CASES:
        if text:
            assert found(text, both) == want


def test_joined_levels_give_what_sent_ones_give(spark, monkeypatch):
    people = [("Tamsin Overbrook",), ("Faßbinder, Jürgen",), ("남궁세라",), ("Juan Ortega",), ("Carlos Ortega",), ("Jan van Dijk",)] * 20 + [(None,)]
    counts = pii.count_names(spark.createDataFrame(people, "author string"), "author")
    rows = [(k % 12, t, "clash") for k, (t, _) in enumerate(CASES)] + [(None, "Signed by Tamsin Overbrook.", "x"), (3, "word " * 20_000 + "Frau Faßbinder sagte nein.", "x")]
    frame = spark.createDataFrame(rows, "row_id bigint, t string, levels string")
    for operator in (pii.list_mentions, pii.redact_column):
        monkeypatch.setattr(pii, "NAME_ROWS", 10**6)
        sent = sorted(map(str, operator(frame, "row_id", "t", counts).collect()))
        monkeypatch.setattr(pii, "NAME_ROWS", 0)
        assert sorted(map(str, operator(frame, "row_id", "t", counts).collect())) == sent and len(sent) > 15


def test_long_texts_take_time_in_proportion():
    text = "Frau Faßbinder called 010-2345-6789 from 7 Harbour Road, Northwick, NY 10027; write to a.b@c.test or Tamsin Overbrook. " * 4_000
    start = time.perf_counter()
    pii.mentions_of([text[: len(text) // 4]], NAMES, pii.trained())
    quarter = time.perf_counter() - start
    start = time.perf_counter()
    (spans,) = pii.mentions_of([text], NAMES, pii.trained())
    assert len(spans) == 5 * 4_000 and time.perf_counter() - start < 8 * quarter + 1


def test_a_long_disguised_mail_is_found_whole():
    local = "a" * 100 + ".b"
    assert found(f"write to {local} (at) host (dot) example now") == [("email", f"{local} (at) host (dot) example")]


def test_long_runs_of_numbers():
    assert found("010-1234-5678 010-8765-4321") == [("phone", "010-1234-5678"), ("phone", "010-8765-4321")]
    assert found("tel 1700000000 1700000001 010-1234-5678") == [("phone", "010-1234-5678")]
    phones = [f"010-1{i:03}-5678" for i in range(50)]
    assert found("call " + " ".join(phones) + " today") == [("phone", p) for p in phones]
    assert found("call (212) 555-0182 (2) now") == [("phone", "(212) 555-0182")]
    for text in ("1 (2)" + " (2)" * 50_000, "5 (2)" * 50_000 + " (2)" * 50_000, "1700000001 " * 50_000):  # in linear time
        pii.spans_of(text, NAMES)


@pytest.mark.parametrize("flat", ["Apt 3", "Apt. 3", "Flat 12b", "Unit 4", "Suite 9", "APT 3", "APT. 3", "FLAT 2", "UNIT 7"])
@pytest.mark.parametrize("comma", ["", ","])
def test_flats_pass_the_prefilter(flat, comma):
    for street in ("Oak Street", "OAK STREET", "Oak Ave."):
        address = f"12 {street}{comma} {flat}, Fooville 12345"
        assert pii.ADDRESSES[0][1].fullmatch(address) and pii._ANY_ADDRESS.search(address)
    assert any(s.kind == 3 and (s.start, s.end) == (11, 11 + len(address)) for s in pii.spans_of(f"deliver to {address}", NAMES))


def test_prefilter_accepts_each_address():
    rng = random.Random(6)
    parts = ["12", "Oak", "Street", "Ave.", "Apt", "Suite 9", "Flat 3", ",", "Fooville", "12345", "P.O. Box 12", "PO BOX 7", "Lindenweg", "rue", "du", "Calle", "de", "가람시", "나무로", "32길", "78", "OR", "NW1 6XE", "1010", "1015 AB", "D-10115"]
    for _ in range(20_000):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(4, 9))).replace(" ,", ",")
        assert pii._ANY_ADDRESS.search(text) or not any(p.search(text) for _, p in pii.ADDRESSES)


def test_flat_without_comma():
    assert found("please deliver to 12 Oak Street Apt 3, Fooville 12345, second floor.") == [("address", "12 Oak Street Apt 3, Fooville 12345")]
