from __future__ import annotations

import re

import pytest

from quillspark.llm.licenses import TEMPLATES, Automaton, scan

from .conftest import frame


@pytest.mark.parametrize(
    ("template", "text", "end"),
    [
        ("a b", "a b c", 2),
        ("a [[b]] c", "a c", 2),
        ("a [[b [[x]]]] c", "a b x c", 4),
        ("a {{2}} c", "a q r c", 4),
        ("a {{2}} c", "a q r s c", None),
        ("a (( b | c d )) e", "a c d e", 4),
        ("[[x]] a", "a", 1),
        ("a [[b]]", "a b", 2),
        ("a b", "a x b", None),
    ],
)
def test_automaton(template, text, end):
    assert Automaton(template).match(text.encode().split(), 0) == end


@pytest.mark.parametrize("template", ["[[a]]", "a [[b", "{{3}}"])
def test_bad_templates(template):
    with pytest.raises(ValueError):
        Automaton(template)


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "the mit License and the MIT\nLICENSE", "É mit lİcense", "SPDX-License-Identifier: MIT", "", None, "under the apache license 3.0",
]


def test_scan(spark, docs, pairs, none):
    got = {r["id"]: r for r in scan(frame(spark, list(enumerate(TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t or "")
    assert [got[i]["labels"] for i in range(4)] == ["MIT-notice,mit", "Apache-2.0-notice,apache", "GPL-notice,gpl", "CC-notice"]
    assert got[6]["labels"] == "SPDX-tag" and got[9]["score"] == 0.5 and got[8]["score"] == 0.0 and got[0]["score"] == 1.0
    assert sorted(r["n_words"] for r in scan(docs).collect()) == sorted(brute(t or "")[0] for _, t in pairs)
    assert scan(none).count() == 0


def test_whole_texts_are_accepted(spark):
    plain = {label: re.sub(r"\[\[.*?\]\]|\{\{\d+\}\}", " ", t) for label, t in TEMPLATES if label in ("MIT", "ISC", "BSD-2-Clause")}
    got = {r["id"]: r for r in scan(frame(spark, [(i, t.upper()) for i, t in enumerate(plain.values())])).collect()}
    for i, label in enumerate(plain):
        assert label in got[i]["labels"].split(",")
    missing = plain["MIT"].replace("merchantability", "")
    assert scan(frame(spark, [(0, missing)])).first()["labels"] == ""
