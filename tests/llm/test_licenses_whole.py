"""License texts, headers and identifiers, altered notices, and near misses."""

import random

import pytest

from cadenza.llm import licenses

TEXTS = sorted(p.stem for p in licenses.TEXTS.glob("*.txt"))
HEADERS = [(name, t) for name, ts in licenses.HEADERS.items() for t in ts]


@pytest.fixture(scope="module")
def templates():
    return licenses.Templates(licenses.every_notice())


def names(found):
    return [x[0] for x in found]


@pytest.mark.parametrize("name", TEXTS)
def test_whole_texts(templates, name):
    text = (licenses.TEXTS / f"{name}.txt").read_text(encoding="utf-8")
    found = templates.find(f"Words before. {text} Words after.")
    assert max(found, key=lambda x: x[2] - x[1])[0] == name
    assert set(names(found)) <= {name, "All-Rights-Reserved"}


@pytest.mark.parametrize("name", TEXTS)
def test_altered_texts(templates, name):
    rng = random.Random(name)
    text = (licenses.TEXTS / f"{name}.txt").read_text(encoding="utf-8").split(" ")
    kept = [w if licenses.variants(licenses.words(w)[0], 0, len(licenses.words(w)[0]), True) or rng.random() > 0.04 else "zzz" for w in text]
    assert name in names(templates.find(" ".join(kept)))


@pytest.mark.parametrize("name,text", HEADERS)
def test_headers(templates, name, text):
    commented = "\n".join(f"# {line}" for line in text.split("\n"))
    assert names(templates.find(f"{commented}\nimport os\n{commented}\nimport sys")) == [name] * 2


def test_no_single_word_is_needed(templates):
    notice = licenses.words(licenses.NOTICES["GPL-3.0"])[0]
    for k, w in enumerate(notice):
        if w != "3":
            assert names(templates.find(" ".join(["xx", *notice[:k], "zzz", *notice[k + 1 :], "yy"]))) == ["GPL-3.0"], w
    assert names(templates.find("Released under the MIT Licnese.")) == ["MIT"]
    assert names(templates.find("Copyright 2020 X. All rights reserved.")) == ["All-Rights-Reserved"]


def test_variants(templates):
    line = licenses.NOTICES["GPL-3.0"]
    assert names(templates.find(line.replace("3", "2"))) == ["GPL-2.0"]
    assert names(templates.find(line.replace("3", "1"))) == []
    assert names(templates.find(line.replace("GNU", "GNU Affero"))) == ["AGPL-3.0"]
    for kind in ("BY", "BY-NC", "BY-ND", "BY-SA", "BY-NC-SA", "BY-NC-ND"):
        assert names(templates.find(f"Licensed under CC {kind} 4.0.")) == [f"CC-{kind}-4.0"]
    assert names(templates.find("Licensed under CC BY 3.0.")) == []
    assert names(templates.find("Licensed under the Apache License, Version 1.1.")) == []
    assert names(templates.find("Licensed under the Apache Licence, v2")) == ["Apache-2.0"]
    assert names(templates.find("Licensed under the Apache Licence, version 2")) == ["Apache-2.0"]


def test_identifiers(templates):
    got = templates.find("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT\nint x;")
    assert names(got) == ["GPL-2.0-only", "Linux-syscall-note", "MIT"]
    assert names(templates.find("# SPDX-License-Identifier: BSD-3-Clause\nOR")) == ["BSD-3-Clause"]
