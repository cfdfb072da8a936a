import random
import re

import pytest
from made_up import prose
from pyspark.sql import functions as F

from folioflow.llm import license_scan as ls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scan(docs):
    return {r.doc_id: r for r in ls.scan(docs).collect()}


def test_base_columns_against_brute_force(spark, documents):
    spice = ["Under the MIT License", "under, the (mit) license!", "Apache License Version 2.0", "CC BY-NC", "cc by nc cc by nc", "under the mit licence", "apache license"]
    rows = [(i, " ".join(prose(i, 20)) + " " + " ; ".join(spice[j] for j in range(7) if i >> j & 1) + " é" + "x" * (i % 3)) for i in range(128)]
    got = scan(documents(rows))
    for i, text in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(LOWER))
        places = [(k, label) for p, label in ls.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None)
        assert r.base_labels == sorted({x for _, x in places})
        assert 0 <= r.score <= 1
        assert (r.score > 0) == bool(places or r.matches)


def test_templates(spark, documents):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3."), (2, "x Licensed under the terms of the GNU General Public License 2 or any later version"), (3, "licensed under the GNU Public License 3"),
        (4, "Copyright (c) 2020 Jane Doe. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        (5, "Redistribution and use in source and binary form with or without modification are permitted provided that the following conditions are met"),
        (6, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ]
    got = {i: [(m.label, m.start, m.end) for m in r.matches] for i, r in scan(documents(rows)).items()}
    assert got == {1: [("gpl-3", 0, 12)], 2: [("gpl-2", 1, 16)], 3: [], 4: [("bsd", 0, 29)], 5: [], 6: [("apache-2", 0, 22)]}


def test_automaton_takes_the_longest_match():
    h = ls.word_hashes
    a = ls.Automaton("x", "<<beginOptional>>a <<var;max=2>> b<<endOptional>> core text here <<beginOptional>>c d<<endOptional>> <<var;max=1>> end")
    import numpy as np

    def spans(text):
        words = h(text)
        return [(s, e) for _, s, e in a.matches(words, np.zeros(len(words), int), np.array([0, len(words)]))]

    assert spans("core text here end") == [(0, 4)]
    assert spans("a b core text here c d x end") == [(0, 9)]
    assert spans("a 1 2 b core text here end end") == [(0, 9)]
    assert spans("a 1 2 3 b core text here end") == [(5, 9)]
    assert spans("core text here c end") == [(0, 5)]
    assert spans("core text here c d e f end") == []
    assert spans("core text") == []


def as_expression(template):
    """A template as a regular expression over words that each end in a space."""
    out = ""
    for part in re.findall(r"<<[^>]*>>|[^<]+", template):
        if part.startswith("<<var"):
            out += f"(?:[^ ]+ ){{0,{re.search('max=([0-9]+)', part)[1]}}}"
        elif part.startswith("<<"):
            out += "(?:" if part == "<<beginOptional>>" else ")?"
        else:
            out += "".join(f"{w} " for w in part.split())
    return re.compile(out)


def instance(rng, template, change):
    """Wording that a template accepts, with some mandatory or optional word replaced where ``change``."""
    out, keep = [], [True]
    for part in re.findall(r"<<[^>]*>>|[^<]+", template):
        if part == "<<beginOptional>>":
            keep.append(keep[-1] and rng.random() < 0.6)
        elif part == "<<endOptional>>":
            keep.pop()
        elif keep[-1]:
            out += prose(rng.randrange(999), rng.randrange(int(re.search("max=([0-9]+)", part)[1]) + 1)) if part.startswith("<<var") else part.split()
    if change:
        out[rng.randrange(len(out))] = "altered"
    return out


def test_templates_against_brute_force(spark, documents):
    """Every template, whole licenses too: labels, spans and scores as regular expressions find them."""
    rng = random.Random(5)
    texts = []
    for n, (_, t) in enumerate(ls.TEMPLATES * 4):
        texts.append(prose(n, 4) + instance(rng, t, n // len(ls.TEMPLATES) % 2 == 1) + prose(n + 1, rng.randrange(3)) + (instance(rng, rng.choice(ls.TEMPLATES)[1], False) if n % 3 == 0 else []))
    got = scan(documents([(i, " ".join(w).title() if i % 2 else ", ".join(w)) for i, w in enumerate(texts)]))
    automata = [ls.Automaton(label, t) for label, t in ls.TEMPLATES]
    assert {label for label, _ in ls.TEMPLATES} == {m.label for r in got.values() for m in r.matches}
    for i, words in enumerate(texts):
        want, strongest = [], [len(p.split()) for p in ls.PHRASES if f" {p} " in f" {' '.join(words)} "]
        line = "".join(f"{w} " for w in words)
        starts = [0, *(m.end() for m in re.finditer(" ", line))]
        for (label, t), automaton in zip(ls.TEMPLATES, automata):
            if accepted := [m for m in (as_expression(t).match(line, at) for at in starts[:-1]) if m]:
                want.append(label)
                strongest.append(automaton.mandatory)
                for m in got[i].matches:
                    if m.label == label:
                        assert as_expression(t).fullmatch("".join(f"{w} " for w in words[m.start : m.end])) or sum(x == label for x, _ in ls.TEMPLATES) > 1
                assert any(m.label == label and m.start <= starts.index(accepted[0].start()) for m in got[i].matches)
        assert {m.label for m in got[i].matches} == set(want), line
        assert got[i].score == pytest.approx(1 - 0.85 ** max(strongest, default=0))


def test_edges(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "\x00!"), (None, "under the mit license"), (4, "under the mit license " * 5000), (5, "cc by"), (6, "nc cc by nc"), (6, "nc cc by nc")]).withColumn("score", F.lit("x")).withColumn("matches", F.lit(0))
    got = ls.scan(docs).collect()
    assert len(got) == 8
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[2].n_words, by[3].n_words) == (0, 0, 0)
    assert (by[None].n_base, by[4].n_base, by[4].last_word) == (1, 5000, 4999 * 4)
    assert (by[5].n_base, by[6].first_word) == (0, 1)
    assert ls.scan(documents([])).count() == 0
