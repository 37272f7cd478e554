"""Surrogates against plain rules: what is written is distinct, coreferent, of its type, and no real value."""

import re

import pytest
from pyspark.sql import functions as F

from sparkernels.llm import pii

KEY = "k"


def written(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in pii.pseudonymised(rows, KEY).collect()}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_surrogates_are_distinct_coreferent_and_typed(spark):
    rows = [(1, "Mail ann.lee@corp.example.com or ANN.LEE@corp.example.com, card 4041 8949 7460 8795 = 4041894974608795."), (2, "ann.lee@corp.example.com at 70.123.182.155, +1 (988) 555-2485; 123-45-6789"), (3, "Mr. John Stone met Frau Berta Klein and г-жа Анна Петрова; Mr John Stone left. v1.2.3 4.0"), (4, None), (5, ""), (1, "no data here"), (None, "10.0.0.1")]
    out = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), KEY)
    got = {(r.doc_id, r.n_entities): r.text for r in out.collect()}
    one, two, three = got[1, 4], got[2, 4], got[3, 4]
    mails = re.findall(r"\w+\.\w+@example\.\w+", one + two)
    assert len(mails) == 3 and len({m.lower() for m in mails}) == 1 and mails[1].split("@")[0].isupper() and mails[0].islower()
    spaced, plain = re.search(r"card ([\d ]+) = (\d+)", one).groups()
    assert spaced.replace(" ", "") == plain != "4041894974608795" and plain[0] == "4" and len(plain) == 16 and luhn(plain)
    assert re.search(r"at 10(\.\d+){3}, \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}; 9\d\d-\d{2}-\d{4}$", two)
    names = re.search(r"^Mr\. (\w+ \w+) met Frau (\w+) \w+ and г-жа ([А-Яа-яё]+) [А-Яа-я]+; Mr (\w+ \w+) left\. v1\.2\.3 4\.0$", three)
    assert names and names[1] == names[4] and names[1].split()[0] in pii.GIVEN["latin", "m"] and names[2] in pii.GIVEN["latin", "f"] and names[3] in pii.GIVEN["cyrillic", "f"]
    assert got[4, 0] is None and got[5, 0] == "" and got[1, 0] == "no data here" and got[None, 1] != "10.0.0.1"


def test_parts_of_a_name_stay_the_same_person(spark):
    out = written(spark, ["Mr John Stone spoke. John Stone, Mr. J. Stone and Stone agreed: STONE? Johnny Stones.", "Dr John Stone; author: Jane Stone.", "Stone is a word here."])
    full = re.match(r"Mr (\w+) (\w+) spoke", out[0])
    given, last = full.groups()
    assert out[0] == f"Mr {given} {last} spoke. {given} {last}, Mr. {given[0]}. {last} and {last} agreed: STONE? Johnny Stones."
    assert out[1].startswith(f"Dr {given} {last}; author: ") and out[1].endswith(f" {last}.") and f"author: {given}" not in out[1] and "Jane" not in out[1]
    assert out[2] == "Stone is a word here." and given in pii.GIVEN["latin", "m"]


def test_one_number_has_one_surrogate_however_it_is_written(spark):
    out = written(spark, ["988-555-2485", "+1 988-555-2485", "(988) 555 2485", "+1-988-555-2486", "+44 20 7946 0958", "030 1234567", "at 1700000000000 ms", "4041894974608796"])
    ten = [re.sub(r"\D", "", out[i])[-10:] for i in range(4)]
    assert ten[0] == ten[1] == ten[2] != ten[3] and out[1].startswith("+1 ") and out[2][0] == "(" and "555-2485" not in out[0]
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4}", out[4]) and out[4] != "+44 20 7946 0958"
    assert re.fullmatch(r"03\d \d{7}", out[5]) and out[5] != "030 1234567"
    # Neither a time stamp nor a number that fails its check digit is a card.
    assert out[6] == "at 1700000000000 ms" and out[7] == "4041894974608796"


def test_written_surrogates_are_distinct_and_never_real(spark):
    def texts(real):
        phones = [f"+1 (9{i:02d}) 555-24{i:02d}" for i in range(60)]
        names = [f"Mr {g} {s}" for g in ("Adam", "Emil", "John", "Paul", "Leon") for s in ("Stone", "Wood", "Hill", "Field")]
        mails = [f"{a}{b}@x.example.com" for a in "abcd" for b in "wxyz"]
        cards = [c for c in (f"40418949746{i:05d}" for i in range(200)) if luhn(c)]
        return [*phones, *names, *mails, *cards, *real]

    def values(rows):
        """The values in their canonical forms."""
        return [re.sub(r"\D", "", t)[-10:] if t[0] in "+(" else re.sub(r"[ -]", "", t) if t[0].isdigit() else t.lower() for t in rows]

    first = texts([])
    made = written(spark, first)
    planted = [made[i] for i in range(len(first))]
    assert len(set(values(planted))) == len(planted)
    # Every surrogate of the first run is a real value of the second.
    both = texts(planted)
    again = written(spark, both)
    new = values([again[i] for i in range(len(both))])
    assert len(set(new)) == len(new) and not set(new) & set(values(both))


@pytest.mark.parametrize("kind", ["ip", "given", "surname", "email"])
def test_colliding_surrogates_are_told_apart(spark, monkeypatch, kind):
    monkeypatch.setattr(pii, "_code", lambda key, kind, norm, attempt: F.sha2(F.concat(F.length(norm).cast("string"), attempt.cast("string")), 256))
    rows = [(kind, f"v{c}@x.com" if kind == "email" else f"v{c}", None) for c in "abcde"]
    kept = [r.made for r in pii.assigned(spark.createDataFrame(rows, "kind string, norm string, gender string"), KEY).collect()]
    assert len(set(kept)) == 5


def test_a_type_without_a_free_surrogate_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_ATTEMPTS", 2)
    monkeypatch.setattr(pii, "_code", lambda key, kind, norm, attempt: F.sha2(F.lit("one"), 256))
    with pytest.raises(RuntimeError, match="too few"):
        pii.assigned(spark.createDataFrame([("ip", f"1.1.1.{i}", None) for i in range(4)], "kind string, norm string, gender string"), KEY)


def test_surrogates_with_clashing_columns_and_other_keys(spark):
    rows = spark.createDataFrame([(1, "Dear Ann Lee", "x", 3), (1, "Dear Ann Lee", "y", 4), (None, None, None, None)], "doc_id long, text string, kind string, made int")
    one, two = ([r.text for r in pii.pseudonymised(rows, k).orderBy("text").collect()] for k in ("k", "l"))
    assert one[0] is None and one[1] == one[2] != "Dear Ann Lee" and one[1].startswith("Dear ") and one != two
