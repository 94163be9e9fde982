"""Patterns tried only where they can begin, against a plain search of the whole text."""

import random

from cohortspark.functions import notes

PIECES = ["Jan", "mar.", "MAY", "sept", "ſept.", "december", "Monday", "THURſDAY", "2019", "1999", "10", "3", "0012", "1", "/", "-", "-", "/", ":", ":30", " ", "  ", ", ", "\n", "st", "th", " of ", " in ", "the 30s", "THE 20S", "mid-", "s", "am", " p.m.", "DR", "Dr.", " SMITH", " Jones", "PAGER ", "pager 12", " HOURS", "AT ", "x", "İ", "é", "\u212a", "January 2019", "1-2-2019", "1/2/2019 10:30", "2019-01-02", "MAY-1-2019", "january of 2019", "2019 in May", "May 1st, 2019", "1may2019", "1st of May", "mid-1990s", " 01/12 ", " 1/2/10 ", " PAGER 12 ", " DR. SMITH AND ", " Dr. Jones", "0800 HOURS", "AT 0800", " May 3rd "]


def test_places_find_what_a_whole_search_finds():
    r = random.Random(4)
    tagger, seen = notes.Tagger(), set()
    for _ in range(2500):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 25)))
        places = notes.beginnings(text)
        for kind, patterns in tagger.kinds:
            for i, (p, begin) in enumerate(patterns):
                want = [m.span() for m in p.finditer(text)]
                assert [m.span() for m in notes.matches(p, text, places[begin])] == want, (p.pattern, text)
                seen |= {(kind, i)} if want else set()
    assert len(seen) == sum(len(patterns) for _, patterns in tagger.kinds)


def test_names_are_small():
    import pickle

    names = [f"Customer#{i:09d}" for i in range(20_000)]
    known = notes.Names(names)
    assert len(pickle.dumps(known)) < 40 * len(names)
    assert known.found("by customer#000000123, Customer#0000001234 or xcustomer#000000123") == [(3, 21)]
