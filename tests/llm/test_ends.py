"""Ends read from tails against whole texts; packing of items far beyond the capacity."""

import random

from tracewright.llm import packing, truncation


def test_ends_are_those_of_the_whole_text(spark, monkeypatch):
    rng = random.Random(8)
    parts = ["word", "Straße", "C:\\data\\" + "deep\\" * 100 + "file.txt", "/srv/" + "x/" * 400 + "end", "a1b2c3d4" * 8, "http://host.example/" + "q" * 500, "12:30:45", "...", "(", "“said”", "名前", "한국어", "e" * 700, ".", "!", "\n", "host.name.example", "0x1f2e3d4c", "…"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(1, 40)))) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    read = lambda: sorted(tuple(r) for r in truncation.final_keys(frame, "doc_id", "text").collect())
    tails = read()
    monkeypatch.setattr(truncation, "TAIL", 10**7)
    assert tails == read()


def test_hot_ends_are_joined_whole(spark, monkeypatch):
    """A cut text that makes up a third of the rows is found in all of them, and salted joins give what broadcasts give."""
    rng = random.Random(3)
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord"]
    say = lambda: f"The {rng.choice(words)} file was opened from the {rng.choice(words)} share at noon."
    rows = [(i, " ".join(say() for _ in range(6))) for i in range(2000)] + [(i, "The amber file was opened from the birch share at noon. The cedar file was opened from the") for i in range(2000, 3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r["doc_id"] for r in truncation.find_truncated(frame, "doc_id", "text").collect()}
    assert want == set(range(2000, 3000))
    once = truncation.lookup
    monkeypatch.setattr(truncation, "lookup", lambda *a, rows: once(*a, rows=10**6))
    assert {r["doc_id"] for r in truncation.find_truncated(frame, "doc_id", "text").collect()} == want


def test_items_far_beyond_the_capacity(spark):
    items = spark.createDataFrame([(i, 200_003 if i else 20) for i in range(10)], "doc_id bigint, tokens bigint")
    classes = spark.createDataFrame([("s", 10)], "container_class string, capacity_tokens int")
    packed = packing.pack(items, "doc_id", "tokens", classes, "container_class", "capacity_tokens", 1000)
    per = packed.groupBy("container").agg({"tokens": "sum", "doc_id": "count"}).collect()
    assert max(r["sum(tokens)"] for r in per) == 10 and sum(r["sum(tokens)"] for r in per) == 9 * 200_003 + 20
    assert len(per) == 9 * 20_000 + 2 + 3  # three rests of 3 go into one container
    pieces = packed.groupBy("doc_id").agg({"piece": "max", "start": "max"}).collect()
    assert {(r["max(piece)"], r["max(start)"]) for r in pieces if r["doc_id"]} == {(20_000, 200_000)} and {(r["max(piece)"], r["max(start)"]) for r in pieces if not r["doc_id"]} == {(1, 10)}
