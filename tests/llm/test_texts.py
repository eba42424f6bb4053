import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import garbled, packing, tokens, truncation

# ---------------------------------------------------------------- garbled text


@pytest.mark.parametrize(
    ("clean", "meant", "wrong"),
    [
        ("Résumé de l'étude – réf. 5", "utf-8", "cp1252"), ("Señales en USB", "utf-8", "mac_roman"), ("Prüfbericht für Gerät", "utf-8", "cp437"), ("황보한별 분석 보고서", "utf-8", "latin-1"),
        ("황보한별 분석", "cp949", "latin-1"), ("Gerät für Löschung", "cp1252", "mac_roman"), ("téléphone arrêtée", "cp1252", "cp1251"), ("МЕТКА", "utf-8", "cp437"),
    ],
)
def test_round_trip(clean, meant, wrong):
    bad, restored, _ = garbled.examine(clean.encode(meant).decode(wrong))
    assert bad and restored == clean
    bad, restored, _ = garbled.examine(f"Some words first, then {clean.encode(meant).decode(wrong)} and more.")
    assert bad and restored == f"Some words first, then {clean} and more."


def test_two_layers():
    twice = "Relevé du téléphone".encode().decode("latin-1").encode().decode("latin-1")
    assert garbled.examine(twice)[:2] == (True, "Relevé du téléphone")


@pytest.mark.parametrize("text", ["", None, "plain", "naïve Façade, 20 °C and n° 5", "«cedar» “quill” „drei“ – …", "Šíp Õige ÂGE AÇÃO Ярлык 關鍵字 検索 👍", "ZOË MÜLLROSE, IÑIGO", "남궁누리 씨는 a.exe 파일", "exam­ple​ éte"])
def test_clean(text):
    assert garbled.examine(text) == (False, text, "")


def test_lost_characters():
    assert garbled.examine("Fa�ade of intake")[:2] == (True, None)


def test_garbled_frame(spark):
    frame = spark.createDataFrame([(1, "FaÃ§ade", None, "x"), (1, "FaÃ§ade", "", "x"), (2, None, "ok", "x")], "doc_id bigint, text string, title string, restored string")
    got = garbled.find_garbled(frame, "doc_id", ("text", "title"))
    assert [tuple(r)[:3] for r in got.collect()] == [(1, "text", "Façade")] * 2
    assert garbled.find_garbled(frame.limit(0), "doc_id", ("text",)).count() == 0


# ---------------------------------------------------------------- tokens

ENCODER = tokens.Encoder.from_bytes(tokens._file(tokens.VOCABULARY))


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=60))
def test_ids_decode_to_the_text(text):
    back = {v: k for k, v in ENCODER.ranks.items()}
    assert b"".join(back[i] for i in ENCODER.encode(text)) == text.encode("utf-8", "replace")


@pytest.mark.parametrize("text", ["Hello world's test 12345", "=" * 5000, "the" * 2000, "한국어 텍스트 👍🏽", " \n\n\t x", "<|endoftext|> a", "don't I'LL", "a" * 3001, "ab" * 700])
def test_ids_of_the_public_tokenizer(text, public):
    assert ENCODER.encode(text) == public.encode(text, add_special_tokens=False).ids


def plain_merge(raw: bytes) -> list[int]:
    """Brute force: look through all pairs for the lowest rank, again and again."""
    part = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        ranked = [(ENCODER.ranks[a + b], i) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if a + b in ENCODER.ranks]
        if not ranked:
            return [ENCODER.ranks[p] for p in part]
        i = min(ranked)[1]
        part[i : i + 2] = [part[i] + part[i + 1]]


def test_queue_against_brute_force():
    rng = random.Random(2)
    raws = [bytes(rng.choice(b"theing aer=\xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    want = [[ENCODER.ranks[r]] if r in ENCODER.ranks else plain_merge(r) for r in raws]
    assert [ENCODER.merge(r) for r in raws] == want
    assert ENCODER.merge_all(raws) == want


def test_texts_together_and_alone(public):
    texts = ["", None, "one two", "x" * 900_000, " the quick onequick", "=" * 3000, "two one"]
    assert ENCODER.encode_all(texts) == [ENCODER.encode(t) if t else [] for t in texts]


def test_rank_queue():
    q = tokens.RankQueue(5000)
    for r, p in ((4999, 1), (3, 2), (64, 3), (3, 4), (0, 5)):
        q.push(r, p)
    assert [q.pop() for _ in range(5)] == [(0, [5]), (3, [2, 4]), (64, [3]), (4999, [1]), None]


def test_token_frame(spark, public):
    frame = spark.createDataFrame([(1, "", "c"), (2, None, "c"), (3, "some text", "c"), (3, "some text", "c")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.token_ids(frame, "doc_id", "text").collect())
    assert got == [(1, []), (2, []), (3, public.encode("some text").ids), (3, public.encode("some text").ids)]
    assert sorted(r["tokens"] for r in tokens.token_counts(frame, "doc_id", "text").collect()) == [0, 0, 2, 2]
    assert tokens.token_ids(frame.limit(0), "doc_id", "text").count() == 0


# ---------------------------------------------------------------- packing


@settings(deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(50, 70))
def test_first_fit_decreasing_against_plain(sizes, capacity):
    bins, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((k for k, b in enumerate(bins) if b >= sizes[i]), None)
        if at is None:
            at = len(bins)
            bins.append(capacity)
        bins[at] -= sizes[i]
        want[i] = at
    got = packing.first_fit_decreasing(np.array(sizes, np.int64), capacity)
    assert list(got) == [want[i] for i in range(len(sizes))]


@pytest.mark.parametrize("group", [7, 1000])
def test_pack(spark, group):
    items = spark.createDataFrame([(i, s) for i, s in enumerate([0, None, 10, 10, 25, 3, 7, 9, 10, 1])], "doc_id bigint, tokens bigint")
    classes = spark.createDataFrame([("s", 10), ("l", 30), ("bad", None)], "container_class string, capacity_tokens int")
    rows = packing.pack(items, "doc_id", "tokens", classes, "container_class", "capacity_tokens", group).collect()
    for name, capacity in (("s", 10), ("l", 30)):
        own = [r for r in rows if r["container_class"] == name]
        fill = {}
        for r in own:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        assert max(fill.values()) <= capacity and sum(fill.values()) == 75
        assert {r["doc_id"] for r in own} == set(range(10))
        assert [(r["start"], r["tokens"]) for r in sorted(own, key=lambda r: r["piece"]) if r["doc_id"] == 4] == ([(0, 10), (10, 10), (20, 5)] if capacity == 10 else [(0, 25)])
    report = packing.fill_report(spark.createDataFrame(rows), classes, "container_class", "capacity_tokens")
    assert report.count() == 2
    assert packing.pack(items.limit(0), "doc_id", "tokens", classes, "container_class", "capacity_tokens").count() == 0


# ---------------------------------------------------------------- truncation


def test_truncated(spark):
    rng = random.Random(4)
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord"]

    def sentence():
        return rng.choice(("The {0} file was opened from the {1} share at noon.", "Nobody found the {0} key below the {1} folder.", "Later the {0} disk was read by the {1} team.")).format(rng.choice(words), rng.choice(words))

    rows, cut = [], set()
    for i in range(3000):
        text = " ".join(sentence() for _ in range(rng.randint(4, 9)))
        if rng.random() < 0.1:
            text += "\n\nApproved: yes"
        if i % 20 == 0:
            text = text[: rng.randint(60, 150)].rstrip()
            if not text.endswith("."):
                cut.add(i)
                text += "..." if i % 40 == 0 else ""
        rows.append((i, text, "s"))
    rows += [(10_000, None, "s"), (10_001, "", "s"), (10_002, "  ", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = truncation.find_truncated(frame, "doc_id", "text")
    got = {r["doc_id"] for r in found.collect()}
    assert len(got & cut) / len(cut) > 0.9 and len(got - cut) <= 0.05 * len(got)
    report = {r["source"]: r for r in truncation.truncation_report(frame, found, "doc_id", "source", "text").collect()}
    assert report["s"]["texts"] == 3000 and report["s"]["cut"] == len(got)
    assert truncation.find_truncated(frame.limit(0), "doc_id", "text").count() == 0


def test_clashing_columns_and_long_texts(spark):
    long = "The amber file was opened from the birch share at noon. " * 3000
    some = [(i, long[: 56 * 4].strip(), "a", "b", 1, 2) for i in range(10, 500)]  # a corpus: ends are judged against all texts
    frame = spark.createDataFrame([(1, long, "a", "b", 1, 2), (2, None, None, None, None, None), *some], "doc_id bigint, text string, word string, row string, k3 int, n int")
    assert truncation.find_truncated(frame, "doc_id", "text").count() == 0
    items = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "a", 1), (2, None, None, None)], "doc_id bigint, tokens bigint, cls string, g int")
    classes = spark.createDataFrame([("s", 10)], "container_class string, capacity_tokens int")
    packed = packing.pack(items, "doc_id", "tokens", classes, "container_class", "capacity_tokens")
    assert packed.count() == 3 and packed.agg({"tokens": "sum"}).first()[0] == 10
    assert garbled.find_garbled(frame, "doc_id", ("text", "word", "row")).count() == 0


def _corpus(n, seed=5):
    rng = random.Random(seed)
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord"]
    patterns = ("The {0} file was opened from the {1} share at noon.", "Nobody found the {0} key below the {1} folder.", "Later the {0} disk was read by the {1} team.")
    return [" ".join(rng.choice(patterns).format(rng.choice(words), rng.choice(words)) for _ in range(rng.randint(4, 9))) for _ in range(n)]


def test_copies_of_a_cut_text(spark):
    texts = _corpus(1000)
    cut = texts[0][:60] + " Nobody found the cedar"
    rows = [*enumerate(texts), *((i, cut) for i in range(2000, 2500))]
    frame = spark.createDataFrame([(i, t, "s" if i < 2000 else "copies") for i, t in rows], "doc_id bigint, text string, source string")
    found = truncation.find_truncated(frame, "doc_id", "text")
    assert {r["doc_id"] for r in found.collect()} == set(range(2000, 2500))
    report = {r["source"]: r for r in truncation.truncation_report(frame, found, "doc_id", "source", "text").collect()}
    assert report["copies"]["cut"] == 500


def test_rare_ends(spark):
    rows = [*enumerate(_corpus(300)), (1000, _corpus(1)[0] + " Nobody mentioned any violet ja"), (1001, _corpus(1)[0] + " Nobody mentioned any violet amber")]
    rows += [(2000 + i, f"{t}\n\nUnit {i} / Lab {w}") for i, (t, w) in enumerate(zip(_corpus(6, 7), ("amber", "birch", "cedar", "delta", "ember", "fjord"), strict=True))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    # the trigram rule is tried first, and the pair before the broken word is enough for it here
    assert {r["doc_id"]: r["rule"] for r in truncation.find_truncated(frame, "doc_id", "text").collect()} == {1000: "inside", 1001: "inside"}


def test_long_path_at_the_end(spark):
    text = _corpus(1)[0] + " Saved in folder /share/"
    frame = spark.createDataFrame([(1, text + "amber-birch/cedar"), (2, text + "amber-birch/" * 40 + "cedar")], "doc_id bigint, text string")
    assert truncation.final_keys(frame, "doc_id", "text").select("k3", "k2", "k1", "p2", "p1").distinct().count() == 1
