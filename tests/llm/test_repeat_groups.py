"""Maximal repeats as rows, against all strings of small texts."""

import random
from collections import defaultdict

from slotwise.llm.repeats import maximal_repeats

LENGTH, GRAM = 24, 8


def places(texts, size):
    """All places of each string of ``size`` bytes."""
    found = defaultdict(set)
    for doc, text in texts.items():
        for i in range(len(text) - size + 1):
            found[text[i : i + size]].add((doc, i))
    return found


def test_groups_equal_brute_force(docs_of):
    random.seed(5)
    passages = ["".join(random.choices("abc é", k=random.randint(20, 90))) for _ in range(6)]
    texts = ["".join(random.choices([*passages, "x", "yz ", "-" * 40], k=random.randint(0, 5))) for _ in range(60)]
    texts += [None, "", passages[0] * 3, passages[0], passages[0], "only once " * 1]
    docs = docs_of(texts)
    docs = docs.union(docs.where("doc_id = 7"))  # a repeated row counts once
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    groups = defaultdict(set)
    for r in maximal_repeats(docs, LENGTH, GRAM).collect():
        assert (r.doc_id, r.start) not in groups[r.repeat, r.n_bytes]
        groups[r.repeat, r.n_bytes].add((r.doc_id, r.start))
    assert groups
    contents = {}
    for (mark, size), at in groups.items():
        strings = {raw[doc][i : i + size] for doc, i in at}
        (contents[mark, size],) = strings
        assert size >= LENGTH and len(at) > 1 and at == places(raw, size)[contents[mark, size]]
    assert len(set(contents.values())) == len(contents)
    starts = defaultdict(list)
    for key, at in groups.items():
        for place in range(key[1] - LENGTH + 1):
            starts[contents[key][place : place + LENGTH]].append((place, at))
    for string, at in places(raw, LENGTH).items():
        if len(at) > 1:
            assert any({(doc, i + place) for doc, i in group} == at for place, group in starts[string])


def test_nothing_repeats(docs_of):
    assert maximal_repeats(docs_of([None, "", "abc", "".join(map(chr, range(33, 120)))]), LENGTH, GRAM).count() == 0
    assert maximal_repeats(docs_of([]), LENGTH, GRAM).count() == 0
