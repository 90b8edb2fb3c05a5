"""Pairs of names are the same whether few or many names share a key."""

import random

from corvane.llm import entity_matching


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def expected(names):
    forms = lambda w: {w, *(entity_matching.shortened(w) if len(w) >= entity_matching.EDITED else [])}
    out = set()
    for p in names:
        for q in names:
            a, b = ((*x.split(" "), "")[:2] for x in (p, q))
            d = [distance(x, y) for x, y in zip(a, b)]
            met = any(forms(a[i]) & forms(b[i]) and a[1 - i][:1] == b[1 - i][:1] and a[1 - i][-1:] == b[1 - i][-1:] and (i == 0 or (a[1] and b[1])) for i in (0, 1))
            if p != q and met and max(d) <= 2:
                out.add((p, q, sum(d)))
    return out


def test_pairs_do_not_depend_on_the_crowd(spark, monkeypatch):
    rng = random.Random(5)
    misspelt = lambda w: "".join(rng.choice([c, c, c, c, "", c + "e", "o"]) for c in w)
    names = {f"{misspelt('meridian')} {misspelt('halton')}".strip() for _ in range(60)} | {f"{misspelt('brook')} {x}".strip() for x in ("", "a", "aa", "axa", "aya", "axya", "ab", "acb", "b", "")}
    names |= {"meridian halton", "meridian haelten", "meridian hlaton", "meridian hxltxn", "meridian axb", "meridian ab", "meridian ayyb"}
    rows = spark.createDataFrame([(n, 1) for n in sorted(names)], "proper string, n bigint")
    found = {}
    for crowd in (64, 5, 1, 100_000):
        monkeypatch.setattr(entity_matching, "CROWD", crowd)
        found[crowd] = {(r["p"], r["q"], r["d"]) for r in entity_matching.edited(rows).collect()}
        assert found[crowd] == expected(names), crowd
    assert {("meridian halton", "meridian hxltxn", 2), ("meridian axb", "meridian ayyb", 2)} <= found[1]
