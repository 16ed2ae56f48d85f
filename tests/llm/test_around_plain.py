"""Disguises that leave a plain remainder, unseen characters, and further signs."""

import pytest

from parley.llm import pii

Z = "\u200b"


def added(text):
    plain, every = pii.all_spans(text)
    assert set(plain) <= set(every)
    return plain, [(k, text[s:e]) for k, s, e in every if (k, s, e) not in plain]


@pytest.mark.parametrize("address", [
    "j\u043ehn.doe@example.com", "john@example.c\u043em", "john[dot]doe@example.com", "jo" + Z + "hn@example.com",
    "john (dot) doe@example.com", "jo\u00adhn@example.com", "john@exam" + Z + "ple.com",
])
def test_whole_addresses_around_plain_remainders(address):
    for text in (address, f"write {address} now", f"({address}), a@b.cd"):
        assert ("email", address) in added(text)[1], text


@pytest.mark.parametrize("kind, disguised", [
    ("email", "john(a)example.com"), ("email", "john[\u00e4t]example.com"), ("email", "john&#64;example.com"),
    ("email", "john&commat;example&#46;com"), ("email", "john" + Z + "@example.com"),
    ("card", "4111\u20111111\u20111111\u20111111"), ("card", "4111\u00a01111\u00a01111\u00a01111"),
    ("card", "4111" + Z + "1111" + Z + "1111" + Z + "1111"),
    ("phone", "plus four nine three zero one two three four five"), ("phone", "+49\u00a030\u00a01234567"),
])
def test_further_signs(kind, disguised):
    for text in (disguised, f"see {disguised}, please"):
        assert added(text)[1] == [(kind, disguised)], text


@pytest.mark.parametrize("text", [
    "mail a@b.com point final", "a@b.com dot com", "\u043d\u0430john@example.com", "f(a)b.c x", "see (a) example.com",
    "print(a)x.y9", "a\u00a0b caf\u00e9 co" + Z + "op", "five plus four five six", "one (a) two.three",
])
def test_nothing_is_added(text):
    assert added(text)[1] == []
