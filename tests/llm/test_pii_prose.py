"""Personal data: prose that has none, long texts, planted persons, mapping against brute force."""

import itertools
import random
import re
import time

import pytest

from shopledger.llm import pii

from .test_operators import table

BODIES = ("The Government", "Every Child", "White House", "New York", "Red Cross", "Jordan River", "San Jose California", "The Times", "United Nations", "Goldman Sachs", "Supreme Court", "Der Spiegel", "La Liga", "Our Team", "World Bank", "Santa Clara County", "Paul Street", "Ms Office", "Sr Software Engineer", "Saint Martin Island")
FRAMES = ("{} said taxes will rise. The plan is new. The people agree.", "They called {} about the offer.", "Last year {} told a story, and every child heard it.", "From: {} to the coast.", "We met with {} on Monday.", "{} asked for more. Child care and government work went on.", "Contact {} for details.", "It was {} that replied.", "In {} the rain fell.", "{}")


def test_two_hundred_plain_sentences_stay():
    sentences = [f.format(b) for b, f in itertools.product(BODIES, FRAMES)]
    assert len(sentences) == 200
    changed = [s for s in sentences if pii.rewrite(s, b"k") != (s, [])]
    assert changed == []


def _seconds(unit, size):
    text = unit * (size // len(unit)) + " 1@"
    began = time.process_time()
    pii.entities(text)
    return time.process_time() - began


@pytest.mark.parametrize("unit", ["ACGT", "Aa-", "0123456789abcdef"])
def test_a_megabyte_without_words_takes_under_two_seconds(unit):
    assert _seconds(unit, 1_000_000) < 2


@pytest.mark.parametrize("unit", ["ACGT", "Aa-", "0123456789abcdef", "Aa ", "a.b-c+", "Aa, Bb ", "O'Neil'", "+1 ", "1-", "DE12 ", "Mr Aa said. ", "John Aa, "])
def test_time_grows_with_the_text(unit):
    assert _seconds(unit, 800_000) < 8 * _seconds(unit, 200_000) + 0.5  # four times as long; by the square it would be sixteen


PERSONS = ("Dr. Anna Müller", "Mr John Smith", "Frau Karin Vogel", "SMITH, JOHN", "my name is Tunde Bakare", "Maria Garcia", "Signed: Fatou Diop", "Chen Wei <chen@mail.example.org>", "Dear Ngozi Okafor", "Иван Петров")


def test_planted_persons_are_found():
    rest = "The quick plan of the people went on for days, and nobody knew why it took so long."
    for p in PERSONS:
        new, kinds = pii.rewrite(f"{rest} {p} came. {rest}", b"k")
        assert "person" in kinds, p
        family = re.sub(r"<.*", "", p.replace("SMITH, JOHN", "JOHN SMITH")).split()[-1]
        assert family not in new and new.startswith(rest) and new.endswith(rest), new
    weak = "They met with Tunde Bakare. Later Tunde Bakare replied."
    assert "Bakare" not in pii.rewrite(weak, b"k")[0]
    assert pii.rewrite("They met with Tunde Bakare.", b"k")[1] == []  # one weak cue is not enough


def test_a_name_that_is_a_word_is_replaced_in_full_names_only():
    new, _ = pii.rewrite("Mr John Rose grew a rose. Rose gardens are nice. Mr Rose agreed.", b"k")
    assert "a rose. Rose gardens" in new and new.count("Rose") == 1


def test_mapping_is_one_to_one_and_coreferent_by_brute_force(spark):
    r = random.Random(2)
    given = [g for (script, _), names in pii.GIVEN.items() if script == "latin" for g in names]
    people = [f"{r.choice(given)} {''.join(r.choice('abcdefgh') for _ in range(5)).title()}" for _ in range(60)]
    mails = [f"u{k}.{r.randint(10, 99)}@mail{k % 7}.org" for k in range(40)]
    texts = [f"{a} wrote to {m}. {a.split(' ')[1]} was late, the note of {b} said." for a, b, m in ((r.choice(people), r.choice(people), r.choice(mails)) for _ in range(200))]
    got = {x["doc_id"]: x["text"] for x in pii.replace_pii(table(spark, texts), b"key").collect()}
    seen: dict[str, str] = {}
    pattern = re.compile(r"^(\S+) (\S+) wrote to (\S+)\. (\S+) was late, the note of (\S+) (\S+) said\.$")
    for i, text in enumerate(texts):
        for old, new in zip(pattern.match(text).groups(), pattern.match(got[i]).groups(), strict=True):
            assert seen.setdefault(old, new) == new and old != new
    kinds = (lambda o: "@" in o, lambda o: o in given, lambda o: "@" not in o and o not in given)
    for kind in kinds:
        own = [n for o, n in seen.items() if kind(o)]
        assert len(own) == len(set(own))
