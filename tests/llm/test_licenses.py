import random

from vecloom.llm import licenses


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_valid_and_no_longer_than_the_longest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 20))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)


def test_distinct_words_align_best():
    rng = random.Random(2)
    for _ in range(100):
        b = rng.sample("abcdefghijklmnopqrstuvwxyz", 20)
        a = [w for w in b if rng.random() < 0.8] + ["1"]
        rng.shuffle(a) if rng.random() < 0.3 else None
        assert len(licenses.patience(a, b)) == lcs(a, b)


def test_planted_templates_are_found():
    rng, scanner = random.Random(3), licenses.Scanner(licenses.TEMPLATES)
    filler = "the of this and work to be or any lorem ipsum dolor".split()
    for name, template in licenses.TEMPLATES.items():
        words = licenses.words_of(template)
        for edits in (0, len(words) // 10):
            edited, telling = list(words), scanner.needed[name]
            for k in rng.sample([k for k, w in enumerate(edited) if w not in telling], edits):
                edited[k] = "zzz"
            before, after = ([rng.choice(filler) for _ in range(rng.randrange(0, 400))] for _ in range(2))
            got = [m for m in scanner.find(" ".join(before + edited + after)) if m[0] == name]
            assert len(got) == 1, (name, edits)
            _, i, j, coverage = got[0]
            assert coverage >= 1 - edits / len(words) - 1e-9 and i <= len(before) + edits and j >= len(before) + len(words) - 1 - edits


def test_repeats_and_other_texts():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    line = licenses.TEMPLATES["MIT/line"]
    assert [m[0] for m in scanner.find(f"{line}\n" * 7)] == ["MIT/line"] * 7
    assert [m[0] for m in scanner.find(f"{line} so so {line} {line} x {line}")] == ["MIT/line"] * 4
    assert scanner.find("the license of the mit was released under no terms") == []
    assert scanner.find(None) == scanner.find("") == []


def test_lookalikes_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    found = lambda text: {m[0] for m in scanner.find(text)}
    assert found("Licensed under CC BY 4.0.") == {"CC-BY-4.0/line"}
    assert found("Licensed under CC BY-ND 4.0.") == set() == found("Licensed under CC BY-NC 3.0.")
    assert found("Released under the Apache License") == set() == found("Released under the BSD License.")
    assert found("Licensed under the Apache License, Version 1.1.") == set()
    assert found("This work is licensed under the GNU General Public License, version 2.") == {"GPL-2.0/line"}
    assert found("This work is licensed under the GNU Lesser General Public License, version 3.") == {"LGPL-3.0/line"}
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
        assert found(licenses.TEMPLATES[f"{name}/notice"]) == {f"{name}/notice"}
    for name in ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"):
        assert found(licenses.TEMPLATES[f"{name}/notice"]) == {f"{name}/notice"}


def slow_find(scanner, words):
    """Every template by alignments from every place; of those that overlap the best."""
    out = []
    for name, template in scanner.words.items():
        m, hits = len(template), []
        missing = int(m * (1 - scanner.coverage) + 1e-9)
        for i in range(len(words)):
            for length in (m + missing, 2 * m):
                pairs = licenses.patience(words[i : i + length], template)
                if len(pairs) >= m * scanner.coverage and scanner._tells(name, words, i, pairs):
                    hits.append((-len(pairs) / m, pairs[-1][0] - pairs[0][0], i + pairs[0][0], i + pairs[-1][0]))
        if hits:
            out.append((name, min(hits)[0]))
    return sorted(out)


def test_candidate_windows_lose_nothing():
    """Short texts against alignments from every place: the same templates, at the same best coverage."""
    rng, scanner = random.Random(12), licenses.Scanner({k: v for k, v in licenses.TEMPLATES.items() if len(v) < 200})
    names = sorted(scanner.templates)
    for _ in range(60):
        words = [rng.choice("the of this and license under work".split()) for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(1, 3)):
            part = list(scanner.words[rng.choice(names)])
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = rng.choice(["zzz", "the", "under"])
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        best = {}
        for name, _, _, coverage in scanner._find(words):
            best[name] = max(best.get(name, 0), coverage)
        assert sorted((n, -c) for n, c in best.items()) == slow_find(scanner, words)


def test_long_text(monkeypatch):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    text = ("lorem ipsum " * 40 + licenses.TEMPLATES["MIT/grant"] + " x " + licenses.TEMPLATES["GPL-3.0/line"] + " ") * 9
    whole = scanner.find(text)
    assert len(whole) == 18
    monkeypatch.setattr(licenses, "_LONG", 10)
    monkeypatch.setattr(licenses, "_BLOCK", 150)
    assert [m[:3] for m in scanner.find(text)] == [m[:3] for m in whole]


def test_table(docs, spark):
    line = licenses.TEMPLATES["GPL-3.0/line"]
    got = licenses.scan(docs([(1, f"a b. {line}"), (1, f"a b. {line}"), (2, None), (None, "")])).collect()
    assert sorted((r.doc_id or 0, r.n_matches, tuple(r.licenses)) for r in got) == [(0, 0, ()), (1, 1, ("GPL-3.0/line",)), (1, 1, ("GPL-3.0/line",)), (2, 0, ())]
    assert licenses.scan(docs([])).count() == 0
    clash = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, matches int")
    assert licenses.scan(clash).columns == ["doc_id", "n_matches", "licenses", "matches"]


def test_lines_of_identifiers_and_of_several_licenses():
    from vecloom.llm.licenses import IDENTIFIERS, TEMPLATES, Scanner

    scanner = Scanner(TEMPLATES)
    names = lambda text: {n for n, *_ in scanner.find(text)}
    for name in IDENTIFIERS:
        assert names(f"some words // SPDX-License-Identifier: {name}\nint main()") == {f"{name}/spdx"}
    assert names("# SPDX-License-Identifier: MIT OR Apache-2.0") == {"MIT/spdx", "Apache-2.0/spdx"}
    assert names("Dual licensed under MIT or Apache-2.0.") == {"MIT OR Apache-2.0/line"}
    assert names("This library is licensed under the GNU Lesser General Public License, version 3.") == {"LGPL-3.0/line"}
    assert names("This library is licensed under the GNU Lesser General Public License, version 2.1.") == {"LGPL-2.1/line"}
    assert names("This work is licensed under the GNU Affero General Public License, version 3.") == {"AGPL-3.0/line"}
    assert names("This work is licensed under the GNU General Public License, version 3.") == {"GPL-3.0/line"}
    assert names("identifier of a license MIT, and MIT again; GPL-2.0-only as a word") == set()
