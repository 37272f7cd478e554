"""Repeated rows, hot groups and bounded samples: the same results as the plain rules, written out here."""

import zlib

import numpy as np
import pytest

from sparkernels.llm import mixing, quality
from sparkernels.llm.common import Table, made

MIX = "doc_id long, source string, text string, label int"


def test_mix_takes_whole_copies_within_the_budget_for_repeated_rows(spark):
    rows = [(i, f"s{i % 3}", "w " * (i % 7 + 1), 0) for i in range(60)] + [(5, "s2", "w " * 6, k) for k in range(40)] + [(None, None, "x y", 1)] * 9
    docs = spark.createDataFrame(rows, MIX).repartition(6)
    taken = mixing.mix(docs).collect()
    out = mixing.mixed(docs).collect()
    assert len(out) == sum(r.copies for r in taken)
    words = lambda t: len(t.split())
    assert sum(words(r.text) for r in out) == sum(r.taken for r in taken)
    of_five = [sum(r.doc_id == 5 and r.label == k and r.text == "w " * 6 for r in out) for k in range(1, 40)]
    assert max(of_five) - min(of_five) <= 1


def test_virtual_finish_order_against_plain_queues(spark):
    rng = np.random.default_rng(8)
    rows = [(i, str(rng.choice(["a", "b", "c", "d"], p=[0.7, 0.1, 0.1, 0.1])), "w " * int(rng.integers(0, 30)), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, MIX)
    shuffled = {r.doc_id: r.h for r in docs.selectExpr("doc_id", f"xxhash64(doc_id, xxhash64(coalesce(text, ''), text is null), {mixing.SEED}) h").collect()}
    size = {i: len(t.split()) for i, _, t, _ in rows}
    queues = {s: sorted((i for i, q, *_ in rows if q == s), key=lambda i: shuffled[i]) for s in "abcd"}
    total = {s: sum(size[i] for i in q) for s, q in queues.items()}
    # Weights 1, 2, 3, 1; a source gives three times its size at most.
    weights, targets, free, left = dict(zip("abcd", (1, 2, 3, 1), strict=True)), {}, set("abcd"), sum(total.values())
    while over := {s for s in free if left * weights[s] > 3 * total[s] * sum(weights[f] for f in free)}:
        targets |= {s: 3 * total[s] for s in over}
        free, left = free - over, left - sum(3 * total[s] for s in over)
    targets |= {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
    copies = []
    for s, queue in queues.items():
        upto = 0
        for turn in range(3):
            for i in queue:
                upto += size[i]
                if size[i] and turn * total[s] < targets[s]:
                    copies.append((upto / targets[s], i))
    want, sent = dict.fromkeys(size, 0), 0
    for _, i in sorted(copies, key=lambda c: c[0]):
        sent += size[i]
        if sent <= round(sum(targets.values())):
            want[i] += size[i]
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect()} == want


def test_fit_takes_whole_texts_up_to_its_bounds():
    rows = [(b"good one " * 20, 1), (b"bad!! $$ " * 20, 0)] * 5
    assert np.array_equal(quality.fit_rows(rows).weights, quality.fit_rows(rows[:4] * 1 + rows[4:]).weights)
    some, four = quality.fit_rows(rows, most=4 * 180 - 1), quality.fit_rows(rows[:4])
    assert np.array_equal(some.weights, four.weights) and some.bias == four.bias


def test_updates_against_plain_ftrl():
    texts = [("One two two, three!", 1), ("spam SPAM spam $$$", 0), ("", 1), ("two three", 1), ("spam $$$ one", 0)] * 6
    alpha, beta, l1, l2 = 16.0, 1.0, 1e-4, 1e-4
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    def inputs(text):
        x = {quality.BUCKETS: 1.0}
        for order in quality.features(quality.TOKEN.findall(text)):
            for i in order.tolist():
                x[i] = x.get(i, 0.0) + 1 / len(order)
        return x

    for text, label in texts:
        x = inputs(text)
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, v, w in [(i, v, weight(i)) for i, v in x.items()]:
            g = (p - label) * v
            z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha * w
            n[i] = n.get(i, 0.0) + g * g
    model = quality.fit_rows([(t.encode(), y) for t, y in texts])
    for text, _ in texts:
        want = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in inputs(text).items())))
        assert model.score(text.encode()) == pytest.approx(want, abs=1e-5)


def test_copies_of_a_labelled_document_are_one_example(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"clean words number {i}" if i % 2 else f"JUNK!! $$ {i}") for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    once = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    often = quality.train(spark.createDataFrame(rows + rows[:5] * 50, "doc_id long, text string").repartition(5), labels)
    assert np.array_equal(once.weights, often.weights) and once.bias == often.bias


def test_tables_of_a_stage_can_be_released(spark):
    with made() as tables:
        table = Table(spark.range(3).toDF("id"), "one")
    after = Table(spark.range(3).toDF("id"), "two")
    assert tables == [table] and after not in tables
    table.release()
    with pytest.raises(Exception, match="(?i)path|not.*exist"):
        spark.read.parquet(table.path).count()
