"""Spelled digits of each language, mixed runs, and at-words that mean nothing else."""

import pytest

from parley.llm import pii

LANGUAGES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "de, plain": "null eins zwei drei vier fuenf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "fr, plain": "zero un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}


def found(text):
    plain, all_ = pii.all_spans(text)
    assert plain == []
    return [(kind, text[start:end]) for kind, start, end in all_]


@pytest.mark.parametrize("words", LANGUAGES.values(), ids=LANGUAGES)
def test_ten_digits_of_each_language(words):
    for spelled in (words, words.upper()):
        for digit in range(10):
            # A phone number in which each digit in turn comes first, in the middle and last.
            turned = spelled.split()[digit:] + spelled.split()[:digit]
            phone = "+" + " ".join(turned)
            assert found(f"tel {phone}.") == [("phone", phone)]
        mixed = "+49 30 " + spelled.split()[5] + " 12 " + spelled.split()[0] + " 44"
        assert found(f"tel {mixed}.") == [("phone", mixed)]


@pytest.mark.parametrize("card", [
    "4111 1111 one 111 1111", "four 111 1111 1111 1111", "4111 1111 1111 111 one",
    "4111-1111, uno, 111-111 eins", "4111 un un un un 1111 1111",
])
def test_runs_of_spelled_and_literal_digits(card):
    assert found(f"card {card}!") == [("card", card)]


def test_at_words_that_mean_nothing_else():
    assert found("a juan arroba correo.es b") == [("email", "juan arroba correo.es")]
    assert found("nom arobase site.fr") == [("email", "nom arobase site.fr")]
    assert found("NOM AROBASE site.co.uk") == [("email", "NOM AROBASE site.co.uk")]
    assert found("we look at example.com, una arroba de oro. Luego") == []


def test_mixed_runs_change_nothing_else():
    assert found("one 192 dot 168 dot 1 dot 1") == [("ip", "192 dot 168 dot 1 dot 1")]
    assert found("one 2345@site[dot]com") == [("email", "2345@site[dot]com")]
    assert found("in 2015, 2016, 2017, 2018 one of 12") == []
    text = "call +49 30 1234567, one 22"
    assert pii.all_spans(text)[1] == pii.all_spans(text)[0] != []


def test_letters_that_match_an_i_without_case():
    assert found("+one two three four five s\u0130x seven e\u0131ght") == [("phone", "+one two three four five s\u0130x seven e\u0131ght")]
