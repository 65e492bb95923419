"""The operators' algorithms without Spark, against plain definitions."""

import random
import re
from array import array

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from countloom.llm import compact_windows, crf_toxicity, endings, ftrl_quality, gray_index, license_rules, merge_replay, positional_index, simhash, template_html, trie_bpe, unigram_trie

TOKENIZERS = pytest.importorskip("public_tokenizers")


def sentence(rng, n, words=("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta")):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


# BPE


@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    path = TOKENIZERS.path("word_bpe_49k.json")
    return trie_bpe.TextEncoder(path), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_bpe_equals_library(encoders, texts):
    own, library = encoders
    for text, (ids, decoded) in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert memoryview(ids).cast("I").tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " \n", "don't they'll 'S", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ İ ẞ ﬁ é", "x" * 2000, "漢字かな 😀😀 ½²", "a\x1cb\x85c\xa0d", "the " * 5000])
def test_bpe_odd_texts(encoders, text):
    own, library = encoders
    [(ids, decoded)] = own.encode_batch([text])
    want = library.encode(text, add_special_tokens=False).ids
    assert memoryview(ids).cast("I").tolist() == want and decoded == library.decode(want, skip_special_tokens=False)


# unigram


def best_cut(word, scores, byte_score):
    word = unigram_trie.MARK + word
    best = [(0.0, 0)]
    for n in range(1, len(word) + 1):
        width = len(word[n - 1].encode())
        options = [(-(best[n - 1][0] + width * byte_score), best[n - 1][1] + width)]
        options += [(-(best[s][0] + scores[word[s:n]]), best[s][1] + 1) for s in range(n) if word[s:n] in scores]
        top = min(options)
        best.append((-top[0], top[1]))
    return best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=12), max_size=12), st.integers(0, 99))
def test_unigram_equals_viterbi(words, seed):
    rng = random.Random(seed)
    pieces = {"▁", "a", "b", "c", "ab", "abc", "▁a", "bc", "cab", "▁ab", "aa", "bb"}
    scores = {p: -rng.randrange(1, 9) / 2 for p in sorted(pieces)}
    model = unigram_trie.Unigram(scores)
    [(n, total)] = model.count([" ".join(words)])
    assert n == len(words) and total == sum(best_cut(w, scores, model.byte_score) for w in words)


def test_long_words_take_time_in_proportion(encoders):
    own, library = encoders
    word = "".join(random.Random(3).choice("abcdefghijklmnop") for _ in range(60_000))
    [(ids, _)] = own.encode_batch([word])
    assert array("I", library.encode(word, add_special_tokens=False).ids).tobytes() == ids
    model = unigram_trie.Unigram({"▁": -2.0, **{c: -3.0 for c in "abcdefghijklmnop"}, "ab": -1.0})
    assert model.count([word]) == [(1, 1 + len(word) - word.count("ab"))]


def test_newer_code_points(encoders):
    own, library = encoders
    texts = [f"b{c}b 1{c}1 !{c}! {c}{c}x" for c in sorted(trie_bpe.NEWER)]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [ids for ids, _ in own.encode_batch(texts)] == [array("I", e.ids).tobytes() for e in want]


def test_neighbour_pairs_are_bounded(encoders, monkeypatch):
    own, library = encoders
    monkeypatch.setattr(trie_bpe, "MOST_PAIRS", own.words.pairs + 5)
    text = " ".join("".join(random.Random(k).choice("aeioubcdfgz") for _ in range(9)) for k in range(200))
    [(ids, _)] = own.encode_batch([text])
    assert array("I", library.encode(text, add_special_tokens=False).ids).tobytes() == ids


# Hamming links


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 6))
def test_gray_index_finds_all_pairs(seed, n, bits):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, max(1, n // 20), dtype=np.uint64)
    words = centres[rng.integers(0, len(centres), n)]
    for _ in range(bits):
        words = words ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    words = np.unique(words)
    words = words[np.argsort(gray_index.gray_rank(words))]
    q, found = gray_index.GrayIndex(words).search(words, 2)
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= 2
    assert set(zip(q.tolist(), found.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    root = gray_index.linked(words, 2)
    assert all((root[i] == root[j]) or not near[i, j] for i in range(len(words)) for j in range(i))


def test_gray_rank_is_the_gray_order():
    codes = np.arange(1000, dtype=np.uint64)
    assert (gray_index.gray_rank(codes ^ (codes >> np.uint64(1))) == codes).all()


@pytest.mark.parametrize("text", ["", "  \t\n", "One", "one two", "A b c D", "É é\x0bx y z " * 50])
def test_fingerprint_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want


# passages


@settings(max_examples=50, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 50), max_size=200), st.lists(st.integers(0, 10**9), max_size=200, unique=True)), st.integers(1, 40))
def test_nodes_are_those_of_the_cartesian_tree(values, least):
    values = np.array(values, np.uint64)
    tree, stack = [], [(0, len(values))]
    while stack:
        a, b = stack.pop()
        if b - a >= least:
            at = a + int(values[a:b].argmin())
            tree.append((a, at, b))
            stack += [(a, at), (at + 1, b)]
    found = compact_windows.nodes(values, least)
    windows = [(int(own[0]), at, int(own[-1])) for at in np.unique(found).tolist() for own in [np.flatnonzero(found == at)]]
    assert [at for _, at, _ in windows] == sorted(at for _, at, _ in tree)
    if len(set(values.tolist())) == len(values):  # of equal values the first is the node
        assert windows == [(max(a, at - least + 1), at, min(at, b - least)) for a, at, b in sorted(tree, key=lambda w: w[1])]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=70), max_size=5), st.integers(5, 30), st.integers(0, 9))
def test_equal_passages_share_all_signatures(texts, width, at):
    common = list(range(100, 100 + width))
    texts = [t[:at] + common + t[at:] for t in [list(range(40, 50)), *texts]]
    own = compact_windows.Texts(list(range(len(texts))), [np.array(t, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for t in texts])
    n, found = len(own.inside(width)), []
    for t, begin in zip(texts, own.begins.tolist(), strict=True):
        wanted = np.zeros(n, bool)
        wanted[begin + t.index(100)] = True
        key, place = own.signatures(3, 2, width, wanted)
        assert len(key) == 3 and (t.index(100) <= place - begin).all() and (place - begin + compact_windows.SHINGLE <= t.index(100) + width).all()
        found.append(set(key.tolist()))
    assert all(keys == found[0] for keys in found)


@pytest.mark.parametrize("width", [1, 2, 5, 25])
def test_rolling_hash_depends_on_the_run_alone(width):
    words = np.random.default_rng(1).integers(0, 1 << 63, 100, dtype=np.uint64)
    shifted = compact_windows.rolling(np.concatenate([words[:7], words]), width)[7:]
    own = compact_windows.rolling(words, width)
    assert len(own) == 101 - width and (own == shifted).all() and len(set(own.tolist())) == len(own)
    assert len(compact_windows.rolling(words[: width - 1], width)) == 0


def test_alignment_bridges_changed_words():
    rng = random.Random(3)
    base = compact_windows.word_hashes(sentence(rng, 120).encode())
    other = base.copy()
    other[60] = 1
    a, b, x, y = compact_windows.aligned(base, other, 10, 10, 0.8)
    assert (a, b, x, y) == (0, 120, 0, 120)
    assert compact_windows.aligned(base, other, 10, 10, 1.0) == (0, 60, 0, 60)


@pytest.mark.parametrize(
    ("own", "other"),
    [
        ([(0, 45), (200, 204), (45, 90)], [(0, 90)]),  # four words put in
        ([(0, 90)], [(0, 45), (200, 204), (45, 90)]),
        ([(0, 43), (200, 204), (47, 90)], [(0, 90)]),  # four replaced
        ([(0, 43), (48, 91)], [(0, 91)]),  # five left out
        ([(0, 45), (200, 201), (46, 49), (201, 202), (50, 95)], [(0, 95)]),  # two changed, four apart
        ([(0, 70), (200, 212), (82, 160)], [(0, 160)]),
    ],
)
def test_alignment_bridges_longer_changes(own, other):
    words = compact_windows.word_hashes(sentence(random.Random(4), 400).encode())
    own, other = (np.concatenate([words[a:b] for a, b in x]) for x in (own, other))
    assert compact_windows.shingle_similarity(own, other) >= 0.8
    for at, there in ((10, 10), (len(own) - 20, len(other) - 20)):
        assert compact_windows.aligned(own, other, at, there, 0.8) == (0, len(own), 0, len(other))
    around = [np.concatenate([words[k : k + 30], x, words[k + 30 : k + 60]]) for k, x in ((210, own), (290, other))]
    assert compact_windows.aligned(*around, 40, 40, 0.8) == (30, 30 + len(own), 30, 30 + len(other))


# search


def test_phrases_and_neighbourhoods():
    items = [(1, b"a b c d e f g h i j k"), (2, b"tiny item"), (3, b""), (4, None), (5, b"a b c d e f g h i j")]
    windows = positional_index.Windows(positional_index.windows_of(items))
    texts = [positional_index.terms_of(t) for t in (b"x A b c d e f g h i j y", b"a tiny, item a tiny item", b"", b"b a c d e f g h i j", b"a b c d e f g h i")]
    found = positional_index.Segment.of(texts).matches(windows, 3)
    assert {d: positional_index.merged(f[0]) for d, f in found.items() if f[0]} == {0: [(1, 11)], 1: [(1, 3), (4, 6)]}
    assert {d: f[1] for d, f in found.items() if f[1]} == {0: {1, 5}, 1: {2}}
    assert found[3][2] == {1, 5} and 2 not in found and 4 not in found


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=30), max_size=6), st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=4), max_size=6), st.integers(0, 3))
def test_segments_find_all_places(texts, windows, slop):
    segment = positional_index.Segment.of([np.array(t, np.int64) for t in texts])
    which, start = segment.search(positional_index.Windows({tuple(w): {0} for w in windows}, 4), slop)
    rows, want = list({tuple(w): 0 for w in windows}), set()
    for k, w in enumerate(rows):
        for d, t in enumerate(texts):
            for s in range(-10, len(t) + 10):
                if all(any(0 <= p < len(t) and t[p] == x for p in range(s + j - slop, s + j + slop + 1)) for j, x in enumerate(w)):
                    want.add((k, int(segment.begins[d]) + s))
    assert set(zip(which.tolist(), start.tolist(), strict=True)) == want


# classifiers


def test_ftrl_separates():
    rng = random.Random(5)
    texts = [(sentence(rng, 60), 1) for _ in range(150)] + [(sentence(rng, 60).replace(" ", "%% "), 0) for _ in range(50)]
    rng.shuffle(texts)
    weights = ftrl_quality.fit([(*ftrl_quality.features(t.encode()), y) for t, y in texts[:150]])
    scores = [(weights[s] @ v, y) for (s, v), y in ((ftrl_quality.features(t.encode()), y) for t, y in texts[150:])]
    assert min(x for x, y in scores if y) > max(x for x, y in scores if not y)
    assert ftrl_quality.features(b"")[0].tolist() == [0]
    assert not ftrl_quality.fit([]).any()


def test_crf_messages_equal_enumeration():
    rng = np.random.default_rng(2)
    ends = np.array([0, 0, 0, 1, 0, 1, 1, 0, 0, 0, 0], bool)
    unary, t = rng.normal(size=len(ends)), rng.normal(size=4)
    model = crf_toxicity.Crf(None, 0.0, t, None)
    p = model.marginals(unary, ends)
    chain = [7, 8, 9, 10]
    total, hit = 0.0, np.zeros(4)
    for states in range(16):
        s = [states >> k & 1 for k in range(4)]
        x = s[0] * t[0] + sum(u * k for u, k in zip(unary[chain], s, strict=True))
        x += sum({(0, 0): 0, (0, 1): t[1], (1, 0): t[2], (1, 1): t[3]}[a, b] for a, b in zip(s, s[1:], strict=False))
        total += np.exp(x)
        hit += np.exp(x) * np.array(s)
    assert np.allclose(p[chain], hit / total) and (p[ends] == 0).all()


def test_crf_learns_words_from_document_labels():
    rng = random.Random(9)
    bad = ["grumblor", "snarfik"]
    texts, y = [], []
    for i in range(300):
        words = sentence(rng, 40).split()
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words).encode())
        y.append(int(i % 3 == 0))
    model = crf_toxicity.fit(texts, y)
    scores = crf_toxicity.WordScores(model)
    assert scores[b"grumblor"] > 0 > scores[b"alpha1"]
    assert all(np.isfinite(model.top)) and min(model.top[1:]) >= 0 and max(model.top[1:]) > 0
    nothing = crf_toxicity.fit([b"", b"a"], [0, 0])
    assert not nothing.weights.any() and nothing.top[0] < 0 and nothing.top[1:] == (0.0, 0.0, 0.0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 200), st.sampled_from([0.0, 0.5, 3.0, 50.0]))
def test_score_weights_converge(seed, n, distance):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(float)
    x = np.column_stack([np.ones(n), distance * (y - 0.5) + rng.normal(size=n), rng.normal(size=n) - distance * y, np.clip(5 * rng.normal(size=n), -12, 12)])
    w = crf_toxicity.score_weights(x, y)
    assert np.isfinite(w).all() and (w[1:] >= 0).all()
    q = crf_toxicity.sigmoid(x @ w)
    gradient = x.T @ (q - y) + 0.05 * w
    assert np.abs(gradient[[0, *(1 + np.flatnonzero(w[1:]))]]).max() < 1e-3 * n
    if distance == 50.0 and 0 < y.sum() < n:
        assert ((q >= 0.5) == (y == 1)).all()


def test_capital_letters_of_other_scripts_count_alike():
    assert crf_toxicity.slots("RÉEUX".encode()) == crf_toxicity.slots("réeux".encode())


def test_spans_are_code_points():
    raw = "Éa bad worse. bad".encode()
    words = crf_toxicity.TOKENS.findall(raw)
    hit = np.array([w in (b"bad", b"worse") for w in words])
    assert ["Éa bad worse. bad"[s["start"] : s["end"]] for s in crf_toxicity._spans(raw, hit)] == ["bad worse", "bad"]


# licences


LICENCE_CASES = [
    ("Some prose.\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy. The above copyright notice and this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.", ["MIT"]),
    ("Redistributions of source code must retain the above copyright notice; redistributions in binary form must reproduce the above copyright notice; neither the name of X may be used to endorse or promote.", ["BSD-3-Clause"]),
    ("This work is licensed under the GNU General Public License, version 3. Released under the MIT License.", ["GPL-3.0", "MIT"]),
    ("Distributed under a strange licence.", ["unknown"]),
    ("The licence plate.", []),
    # the same licence twice running, and neighbours
    ("Released under the MIT License. Released under the MIT License. Released under the MIT License.", ["MIT"]),
    ("Licensed under CC BY 4.0. Licensed under CC BY 4.0. Released under the MIT License. Licensed under CC BY 4.0.", ["MIT", "CC-BY-4.0"]),
    # tags
    ("// SPDX-License-Identifier: MIT", ["MIT"]),
    ("/* SPDX-License-Identifier: GPL-3.0-or-later */\nint main;", ["GPL-3.0-or-later"]),
    ("# spdx-license-identifier:LGPL-2.1+\nimport os", ["LGPL-2.1-or-later"]),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", ["Apache-2.0 OR MIT"]),
    ("SPDX-License-Identifier: House-1.0", ["unknown"]),
    # notices without "or later"
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.", ["GPL-2.0"]),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.", ["GPL-3.0"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["GPL-2.0-or-later"]),
    # headings, and texts with their appendix
    ("MIT License\n\nCopyright (c) 2020 Someone", ["MIT"]),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n  Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n a work licensed under version 3 of the GNU Affero General Public License into one.\n\n                     END OF TERMS AND CONDITIONS\n\n            How to Apply These Terms to Your New Programs\n\n    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\n", ["GPL-3.0"]),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   END OF TERMS AND CONDITIONS\n\n   APPENDIX: How to apply the Apache License to your work.\n\n   Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file except in compliance with the License.\n", ["Apache-2.0"]),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999\n\n", ["LGPL-2.1"]),
    ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n", ["MPL-2.0"]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), LICENCE_CASES)
def test_licence_rules(text, want):  # more of them, as whole texts, below
    assert license_rules.licences(license_rules.identify(text)) == want


def whole(*names):
    """The sentences of a licence's text."""
    lines = [line.split(": ", 1) for line in license_rules.WHOLE.strip().split("\n")]
    return [next(text for n, text in lines if n == name) for name in names]


LICENCES = {
    "MIT": ["mit_grant", "mit_notice", "as_is", "mit_liability"],
    "ISC": ["isc_grant", "isc_disclaimer", "isc_liability"],
    "0BSD": ["zero_bsd_grant", "isc_disclaimer", "isc_liability"],
    "BSD-3-Clause": ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorsement", "bsd_disclaimer", "bsd_liability", "bsd_loss", "bsd_cause"],
    "BSD-2-Clause": ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_disclaimer", "bsd_liability", "bsd_loss", "bsd_cause"],
    "Zlib": ["zlib_warranty", "zlib_liability", "zlib_grant", "zlib_origin", "zlib_claim", "zlib_altered", "zlib_notice"],
    "Unlicense": ["unlicense_release", "unlicense_grant", "unlicense_dedication", "unlicense_benefit", "unlicense_act", "as_is", "mit_liability"],
    "Apache-2.0": ["apache2_reference", "apache_compliance", "apache_basis", "apache_specific"],
    "GPL-2.0-or-later": ["gpl_free", "gpl2_or_later", "gpl_hope", "gpl_warranty", "gpl_details", "gpl_copy"],
    "GPL-3.0-or-later": ["gpl_free", "gpl3_or_later", "gpl_hope", "gpl_warranty", "gpl_details", "gpl_copy"],
    "LGPL-2.1-or-later": ["lgpl_free", "lgpl_terms", "lgpl21_version", "lgpl_hope", "gpl_warranty", "lgpl_details", "lgpl_copy"],
    "AGPL-3.0-or-later": ["gpl_free", "agpl3_or_later", "gpl_hope", "gpl_warranty", "agpl_details", "agpl_copy"],
}


@pytest.mark.parametrize("name", LICENCES)
def test_whole_licences(name):
    parts = whole(*LICENCES[name])
    for text in (". ".join(parts) + ".", ";\n".join(p.replace(" ", "\n ", 7).replace("-", " - ") for p in parts), "\n\n".join(parts).upper()):
        assert license_rules.identify(text) == LICENCES[name] and license_rules.licences(LICENCES[name]) == [name]


def test_every_known_sentence_has_a_trigger():
    for plain in license_rules.KNOWN:
        assert license_rules.TRIGGER.search(plain.encode())
        assert license_rules.sentences(plain) == [plain]
    for name, pattern in license_rules.SENTENCES:
        literal = re.sub(r"\([^()]*\)\??|\\.|\.\*", " ", pattern.replace("\\.", ".")).replace("[cs]", "c")
        assert license_rules.TRIGGER.search(literal.encode()), name
    known = {name for name, _ in license_rules.SENTENCES} | set(license_rules.KNOWN.values())
    assert all(set(re.findall(r"[a-z0-9_]{3,}", pattern)) <= known for _, pattern in license_rules.RULES[:-1])


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class=home><header>Site</header><nav><ul><li><a href=/x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><article><header><p>By X</p></header><h1>Head &amp; line</h1><p>First <b>bold<br>text&nbsp;here<p>Second &#233;<script>no()</script> part<form>Mail <input></form>
<div class="comments"><p>Nice!</p></div></article><aside>More</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert template_html.main_text(PAGE) == "By X\n\nHead & line\n\nFirst bold text here\n\nSecond é part"
    assert template_html.main_text("<div class=menu>a</div><div>Plain text only</div>") == "Plain text only"
    for odd in ("", "<", "<p", "<div><div>", "</div></p>x", "<script>", "<a href='x>y", "<!-- open", "<p>" * 3000):
        template_html.main_text(odd)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>A <span class=\"advert\">Buy now</span>b <b>c</b></p></article>", "A b c"),
        ("<article><p>A<span class='cookie-notice'>x <i>y</i> z</span> b</p><p>c</p></article>", "A b\n\nc"),
        ("<article><span class=ad>x<p>After a block</p></article>", "After a block"),
        ("<article><div class='social-history'>Kept</div><div class='copyright-law'>too</div><div class='promotion-to-rank'>and this</div></article>", "Kept\n\ntoo\n\nand this"),
        ("<article><div class='site-footer'>x</div><div class='post-comments'>y</div><div class='big social-share'>z</div>Text</article>", "Text"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold</p></article>", "Let x=1 hold"),
        ("<article>a > b <p title='x > y'>c</p><p title=\"it's\">d</p></article>", "a > b\n\nc\n\nd"),
        ("<article><p>one<p>two" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>out", "one\n\ntwo\n\ndeep"),
    ],
)
def test_what_belongs_to_an_article(page, text):
    assert template_html.main_text(page) == text


@pytest.mark.parametrize("part", ["<a ", "<a \"", "<a b='x>", "<!--", "<div>", "<span class=ad>", "<div></p>", "<p><b></i>", "<script>", "</p "])
def test_odd_pages_take_time_in_proportion(part):
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        template_html.main_text(part * n + "x>")
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.02)


# byte-level BPE and endings


@pytest.fixture(scope="module")
def byte_pair():
    tiktoken = pytest.importorskip("tiktoken")
    encoder = merge_replay.ByteEncoder(TOKENIZERS.path("byte_bpe_multi_50k.tiktoken"))
    return encoder, tiktoken.Encoding("own", pat_str=TOKENIZERS.PATTERN, mergeable_ranks=encoder.merges.ranks, special_tokens={})


def same_ids(byte_pair, texts):
    encoder, library = byte_pair
    for text, (ids, decoded) in zip(texts, encoder.encode_batch(texts), strict=True):
        assert memoryview(ids).cast("I").tolist() == library.encode_ordinary(text), text[:80]
        assert decoded == text.encode()


def test_every_code_point_between_letters_digits_and_marks(byte_pair):
    """A vocabulary in which every byte joins a, 1 and ! shows where pieces end."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {bytes([x, y]): 256 + 3 * x + k for x in range(256) for k, y in enumerate(b"a1!")}
    library = tiktoken.Encoding("own", pat_str=TOKENIZERS.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_pair[0]
    for c in (c for c in range(0x110000) if not 0xD800 <= c < 0xE000):
        for y in "a1!":
            joined = len(encoder.pieces(chr(c) + y)) == 1
            assert joined == (library.encode_ordinary(chr(c) + y)[-1] >= 256), (hex(c), y)


@given(st.text(max_size=200), st.lists(st.sampled_from(["ab", "'s", "'S", " ", "  ", "\n", "12", "é", "漢字", "aaaa", "\x1c", "\u3000", "x" * 300]), max_size=30))
@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_bytes_like_the_library(byte_pair, text, parts):
    same_ids(byte_pair, [text, "".join(parts), "".join(parts) * 3])


def test_replay_of_long_words_and_of_any_tokens(byte_pair):
    encoder, library = byte_pair
    same_ids(byte_pair, ["a" * 20_000 + " " * 3_000 + "ab" * 9_000, "", "\0"])
    rng, tokens = random.Random(2), list(encoder.merges.ranks)
    words = [b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    for few in (words, words[:3], words[:1]):
        got = encoder.merges.encode_all(few)
        assert all(memoryview(i).cast("I").tolist() == library._core_bpe.encode_single_piece(w) for w, i in zip(few, got, strict=True))


def test_replay_where_a_merge_makes_a_smaller_rank():
    """A rank file no training would give: joined tokens may come before their parts; one word at a time, by the definition."""
    rng = random.Random(4)
    for _ in range(60):
        merges = merge_replay.Merges.__new__(merge_replay.Merges)
        tokens = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)}
        order = sorted(tokens, key=lambda t: (len(t) > 1, rng.random()))
        merges.load({t: r for r, t in enumerate(order)})

        def plain(word, ranks=merges.ranks):
            parts = [word[k : k + 1] for k in range(len(word))]
            while True:
                found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
                if not found:
                    return [ranks[p] for p in parts]
                k = min(found)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]

        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(200)]
        assert [memoryview(i).cast("I").tolist() for i in merges.replay(words)] == [plain(w) for w in words]


def test_moves_are_bounded(monkeypatch):
    monkeypatch.setattr(endings, "MOST_MOVES", 5)
    found = endings.Endings(["ab", "abc", "b"], lambda ends: ends)
    state = found.root
    for letter in "abcxabyz漢abcabcab":
        state = state.moves.get(letter) or found.after(state, letter)
        assert sum(len(s.moves) for s in found.states.values()) <= 6 and all(s is not found.root for t in found.states.values() for s in t.moves.values())
    assert state.text == "ab"
