"""A row that is there very often, and ids with different labels."""

from collections import Counter

from lodestone.llm import classifier, mixing, rules, sharding, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, at int, virtual_slot int, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 1, 2, 3, 4) for i, t in rows], SCHEMA)


def test_a_row_that_holds_a_third_of_all_is_spread(spark):
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(4000)] + [(7, "the same row again and again")] * 2000
    out, _ = sharding.shard(table(spark, rows).repartition(7), shards=40)
    got = out.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t) + 16) for i, t in rows)
    load, slots = Counter(), {}
    for r in got:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(load) == 40 and max(load.values()) <= 1.01 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_few_equal_rows_share_a_slot(spark):
    rows = [(i, "x") for i in range(40_000)] + [(5, "x")]
    out, _ = sharding.shard(table(spark, rows), slots=1024)
    assert out.where("doc_id = 5").select("virtual_slot").distinct().count() == 1
    assert sharding.shard(table(spark, []))[0].count() == 0


def test_the_least_of_different_labels_counts(spark):
    texts = [(i, f"good prose number {i} with several words in it. " * 6 if i % 2 else f"buy now {i} !!! $$$ click | " * 9) for i in range(80)]
    docs = table(spark, texts)
    once = [(i, i % 2) for i in range(80)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, label int")
    for train in (classifier.train, rules.train):
        want = train(docs, frame(once))
        for more in ([(i, 1) for i in range(0, 80, 2)], [(None, 0), (3, None), (5, 7)], once):
            assert str(train(docs, frame(more + once).repartition(5))) == str(want)
    named = lambda rows: spark.createDataFrame(rows, "doc_id long, domain string")
    a = mixing.train(docs, named([(i, "ab"[y]) for i, y in once]))
    b = mixing.train(docs, named([(i, "ab"[y]) for i, y in once] + [(i, "b") for i in range(0, 80, 2)]).repartition(5))
    assert str(a) == str(b)


def test_repeats_end_where_a_window_does_not_recur(spark):
    word = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    a, b = word("a", 20), word("b", 15)
    rows = [(1, a), (2, f"{word('x', 4)} {b} {word('y', 3)}"), (3, f"{a} {b} end"), (4, f"{word('z', 2)} {a} of {b}"), (5, f"{word('a', 16)} b3 b4")]
    got = {r.doc_id: r for r in substring.substring_dedup(table(spark, rows)).collect()}
    assert {i: [(x.start, x.end) for x in r.stretches] for i, r in got.items()} == {1: [], 2: [], 3: [(0, 20), (20, 35)], 4: [(2, 22), (23, 38)], 5: [(0, 16)]}
    assert got[3].kept == "end" and got[4].kept == "z0 z1 of" and got[5].kept == "b3 b4" and got[3].n_removed == 35
    assert [(x.start, x.end) for x in got[3].repeats] == [(0, 35)]  # their union
    over = [(1, word("c", 20)), (2, f"c17 c18 c19 {word('d', 20)}"), (3, f"{word('c', 20)} {word('d', 20)}")]
    got = {r.doc_id: r for r in substring.substring_dedup(table(spark, over)).collect()}
    assert [(x.start, x.end) for x in got[3].stretches] == [(0, 20), (17, 40)] and got[3].n_removed == 40
