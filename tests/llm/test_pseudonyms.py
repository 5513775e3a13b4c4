"""Pseudonyms are bijections within formats, seen on whole texts."""

import datetime
import random
import re

import pytest

from tallyforge.llm import pseudonyms


def rewritten(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymise(rows, "k").collect()}
    return [got[i] for i in range(len(values))]


DAYS = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in range(0, 73049)]
FORMS = {
    "iso": ([f"{d:%Y-%m-%d}" for d in DAYS[::20]], r"\d{4}-\d{2}-\d{2}"),
    "short slashes": ([f"{d.month}/{d.day}/{d.year}" for d in DAYS if d.month < 10 and d.day < 10][::3], r"[1-9]/[1-9]/\d{4}"),
    "short month": ([f"{d.month}/{d.day}/{d.year}" for d in DAYS if d.month < 10 and d.day > 12][::9], r"[1-9]/\d{2}/\d{4}"),
    "day first": ([f"{d.day}/{d.month:02}/{d.year}" for d in DAYS if d.day > 12][::12], r"\d{2}/\d{2}/\d{4}"),
    "dots": ([f"{d.day}.{d.month}.{d.year}" for d in DAYS if d.month < 10 and d.day < 10][::4], r"[1-9]\.[1-9]\.\d{4}"),
}


def read(text, form):
    a, b, c = (int(x) for x in re.split("[-./]", text))
    if form == "iso":
        return datetime.date(a, b, c)
    if form in ("dots", "day first"):
        return datetime.date(c, b, a)
    return datetime.date(c, a, b)


@pytest.mark.parametrize("form", FORMS)
def test_dates(spark, form):
    values, shape = FORMS[form]
    new = rewritten(spark, values)
    assert len(set(new)) == len(set(values)) and all(re.fullmatch(shape, x) for x in new)
    assert all(1900 <= read(x, form).year < 2100 for x in new) and sum(a == b for a, b in zip(values, new, strict=True)) < 10
    if form == "day first":
        assert all(int(x[:2]) > 12 for x in new)


def test_all_dates_of_a_small_calendar_map_onto_themselves(spark, monkeypatch):
    monkeypatch.setattr(pseudonyms, "DAYS", (31, 47))  # 1,457 days from 1900 on
    days = [f"{d.month}/{d.day}/{d.year}" for d in DAYS[:1457] if d.month < 10 and d.day < 10]
    assert sorted(rewritten(spark, days)) == sorted(days)


OTHER = [datetime.date.fromordinal(k) for k in (*range(1, 693_596, 601), *range(766_645, datetime.date.max.toordinal() + 1, 2503), 1, 693_595, 766_645, datetime.date.max.toordinal())]


@pytest.mark.parametrize("form", ["iso", "dots", "day first"])
def test_dates_of_other_centuries(spark, form):
    show = {"iso": lambda d: f"{d.year:04}-{d.month:02}-{d.day:02}", "dots": lambda d: f"{d.day}.{d.month}.{d.year:04}", "day first": lambda d: f"{d.day}/{d.month}/{d.year:04}"}[form]
    keep = {"iso": lambda d: True, "dots": lambda d: d.day < 10 and d.month < 10, "day first": lambda d: d.day > 12 and d.month < 10}[form]
    values = sorted({show(d) for d in OTHER if keep(d)})
    new = rewritten(spark, values)
    assert len(set(new)) == len(values) > 300 and [len(x) for x in new] == [len(x) for x in values]
    assert all(not 1900 <= read(x, form).year < 2100 for x in new) and sum(a == b for a, b in zip(values, new, strict=True)) < 5


def test_edges_of_the_calendar(spark):
    assert (pseudonyms.BEFORE, pseudonyms.ALL_DAYS) == (datetime.date(1900, 1, 1).toordinal() - 1, datetime.date.max.toordinal())
    left = ["0000-01-01", "1899-02-29", "2100-02-29", "9999-12-32"]
    assert rewritten(spark, left) == left
    assert rewritten(spark, ["1.2.1066", "on 1.2.1066."])[1] == f"on {rewritten(spark, ['1.2.1066'])[0]}."


def by_hand(digits, code, key="k"):
    """A loop over the same rounds, for the digits of an international number."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rest = digits[len(code) :]
    n = len(rest)
    a, b = 10 ** (n - n // 2), 10 ** (n // 2)
    left, right = divmod(int(rest), b)
    for i in range(pseudonyms.ROUNDS):
        hashed = lambda half: int(sha(key + sha(f"{key}|international{code}/{n}|{i}|{half}"))[:13], 16)  # noqa: B023, E731
        if i % 2 == 0:
            left = (left + hashed(right) % a) % a
        else:
            right = (right + hashed(left) % b) % b
    return code + f"{left * b + right:0{n}}"


def test_international_numbers_by_a_loop(spark):
    numbers = [("44", "+44 20 7946 0958"), ("44", "+442079460958"), ("44", "+44 (0)20 7946-0958"), ("33", "+33 1 42 68 53 00"), ("49", "+49 (30) 901820"), ("7", "+7 495 123-45-67"), ("352", "+352 27 12 34"), ("1", "+1 202 555 01234"), ("81", "+81.3.1234.5678")]
    new = rewritten(spark, [f"call {x}, or not" for _, x in numbers])
    for (code, old), text in zip(numbers, new, strict=True):
        got = text.removeprefix("call ").removesuffix(", or not")
        plain = lambda x: re.sub(r"\(0\)|[^0-9]", "", x)
        assert re.sub(r"\d", "9", got) == re.sub(r"\d", "9", old) and ("(0)" in got) == ("(0)" in old)
        assert plain(got) == by_hand(plain(old), code)
    assert len({re.sub(r"\(0\)|[^0-9]", "", x) for x in new[:3]}) == 1


def test_international_numbers_stay_apart(spark):
    r = random.Random(5)
    values = sorted({f"+{code}{r.randint(10 ** 7, 10 ** 8 - 1)}" for code in ("44", "352", "7", "998") for _ in range(800)})
    new = rewritten(spark, values)
    assert len(set(new)) == len(values) and [len(x) for x in new] == [len(x) for x in values]
    usual = rewritten(spark, ["+1 202 555 0123", "+1 20 2555 0123", "+12025550123"])
    assert len({re.sub(r"\D", "", x) for x in usual}) == 1


def test_signs_before_other_kinds(spark):
    values = ["+2024-01-02", "+4111 1111 1111 1111", "+192.168.10.200", "+44 20 79", "+1234567", "+1234567890123456x", "1+23456789a", "+44 20 7946 0958 2 times"]
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    kinds = {r.doc_id: r.pii_kinds for r in pseudonyms.pseudonymise(rows, "k").collect()}
    assert [kinds[i] for i in range(len(values))] == [["date"], ["card"], ["ip"], [], [], [], [], ["international"]]
    assert rewritten(spark, values)[-1].endswith(" 2 times")


def test_phones_of_all_classes_stay_apart(spark):
    r = random.Random(4)
    ten = {f"{r.choice('0123456789')}{r.randint(0, 99):02}{r.choice('0123456789')}{r.randint(0, 99):02}{r.randint(0, 9999):04}" for _ in range(4000)}
    ten = sorted(ten | {"0000000000", "1999999999", "2000000000", "2001999999", "2002000000", "9999999999", "9991999999"})
    values = [f"+1 ({x[:3]}) {x[3:6]}-{x[6:]}" for x in ten]
    new = [re.sub(r"\D", "", x)[1:] for x in rewritten(spark, values)]
    kind = lambda x: "area" if x[0] in "01" else "exchange" if x[3] in "01" else "assigned"
    assert len(set(new)) == len(ten) and [kind(x) for x in new] == [kind(x) for x in ten]


def test_odd_texts_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, "a", "b"), (2, "", "a", "b"), (3, "31/02/2020 13/13/2020 32.1.2020", "a", "b"), (4, "x" * 200_000 + " 2020-02-29", "a", "b")], "doc_id long, text string, _found string, _new string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(rows, "k").collect()}
    assert got[1].text is None and got[2].text == "" and got[3].text == "31/02/2020 13/13/2020 32.1.2020"
    assert all((r._found, r._new) == ("a", "b") for r in got.values()) and len(got[4].text) == 200_011 and got[4].pii_kinds == ["date"]
