"""Surrogates where few are to be had, and names in all the ways they are written."""

import random

import pytest

from wayfold.llm import personal


def run(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(personal.with_surrogates(docs, "k").collect(), key=lambda r: r.doc_id)]


def test_secrets_without_letters_or_digits_of_ascii_are_replaced(spark):
    secrets = ["********", "--------", "......", "пароль-Секрет", "κωδικός", "密码密码密码", "あいうえおか", "비밀번호비밀", "naïveté-ÉTÉ", "_-_-_-_-", "\U0001f600" * 6, "*******", "///:::==="]
    found = run(spark, *[f"password: {s} x" for s in secrets])
    new = [t.removeprefix("password: ").removesuffix(" x") for t in found]
    assert not set(new) & set(secrets) and len(set(new)) == len(secrets)
    for old, fresh in zip(secrets, new):
        assert len(fresh) >= len(old)
    assert all("а" <= c.lower() <= "я" or c == "-" for c in new[3]) and new[3][7].isupper()
    assert run(spark, *[f"password: {s} x" for s in secrets]) == found


def test_thousands_of_short_addresses_stay_different(spark):
    old = [f"{c}@site{k}.com" for k in range(400) for c in "abcdefghijklmnopqrstuvwxyz"[:25]]
    new = [t.split()[1] for t in run(spark, *[f"mail {a} now" for a in old])]
    assert len(set(new)) == len(old) == 10_000 and not set(new) & set(old)
    assert all(x.count("@") == 1 and x.rpartition("@")[2].split(".")[-2] == "example" for x in new)


def test_the_last_attempt_is_always_enough(spark, monkeypatch):
    monkeypatch.setattr(personal, "LAST", 1)
    old = [f"pwd={a}{b}{c}{d}{e}{f}" for a in "-_" for b in "-_" for c in "-_" for d in "-_" for e in "-_" for f in "-_"]
    new = run(spark, *old)
    assert len(set(new)) == len(old) == 64 and not set(new) & set(old)


@pytest.mark.parametrize("kind, entity", [("ip", "10.1.2.3"), ("ssn", "123-45-6789"), ("card", "4111 1111 1111 1111"), ("phone", "212-555-0123")])
def test_kinds_of_fixed_length_grow_when_they_are_used_up(spark, monkeypatch, kind, entity):
    monkeypatch.setattr(personal, "FIXED", -1)  # as if all of the usual length had been tried; attempt 0 counts as the next
    (new,) = run(spark, f"see {entity} here")
    assert new.startswith("see ") and new.endswith(" here") and len(new) > len(f"see {entity} here") and entity not in new


def test_possessives_are_replaced_with_their_names(spark):
    (found,) = run(spark, "Ms Jane Doe, Jane Doe's car, Mr O'Brien's and Mr James' hat. Jane Doe’s, not Jane Doe-Smith nor Jane Doesn't.")
    given, family = found.split()[1:3]
    family = family.rstrip(",")
    assert f"{given} {family}'s car" in found and f"{given} {family}’s," in found
    assert "O'Brien" not in found and "'s and Mr " in found and "James" not in found and "' hat" in found
    assert "Jane Doe-Smith nor Jane Doesn't." in found and found.count("Jane") == 2


def test_names_of_three_words_leave_none_of_them(spark):
    (found,) = run(spark, "Mr John Ronald Smith and John Smith, John Ronald Smith's son, John Ronald. Mr Smith, Mr John Smith. Mr John Richard Smith.")
    assert not any(w in found for w in ("John", "Ronald", "Smith", "Richard"))
    given, middle, family = found.split()[1:4]
    assert found == f"Mr {given} {middle} {family} and {given} {family}, {given} {middle} {family}'s son, {given} {middle}. Mr {family}, Mr {given} {family}. Mr {given} {found.split()[-2]} {family}."
    assert found.split()[-2] != middle


def test_many_names_of_one_family(spark):
    draw = random.Random(1)
    names = sorted({"".join(draw.choices("abcdefgh", k=4)).capitalize() for _ in range(900)})
    found = run(spark, *[f"Mr {n} Smith" for n in names])
    assert len(set(found)) == len(names) and len({t.split()[-1] for t in found}) == 1
