import random
import re

import numpy as np
import pyarrow as pa

from strataform.llm import words as W
from strataform.llm.license_scan import COLUMNS, PHRASES, TEMPLATES, ScanRules, Scanner, license_scan, op10_license_scan, scan, split
from tests.llm.helpers import frame, save, tricky

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text):
    w = WORD.findall(lower(text))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def rows():
    r, out = random.Random(3), tricky()
    bits = "gnu general public license apache cc by mit license the of gnu general GNU".split()
    out += [(100 + i, " ".join(r.choice(bits) for _ in range(r.randrange(60)))) for i in range(60)]
    return out + [(200, "MIT License\n\n" + TEMPLATES["mit"]), (201, TEMPLATES["apache"].replace("file", "thing")), (202, "x " * 30 + " ".join(TEMPLATES["bsd"].split()[:50])), (203, "Released under the MIT License.")]


def test_base_equals_brute_force(spark, tmp_path):
    want = {i: brute(t) for i, t in rows()}
    got = {r.doc_id: r for r in op10_license_scan(spark, save(spark, tmp_path, rows())).collect()}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()} == want
    assert got[200].labels == "mit" and got[201].labels == "apache" and got[202].labels == "bsd" and got[202].base_labels == "" and got[203].score == 1
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got.values())


def test_matching_statistics():
    scanner = Scanner(ScanRules(phrases={"a b": "x"}, templates={"t": "a b c a b d", "u": "c a d"}, min_match=1))
    ids = {w: i + 1 for i, w in enumerate(sorted(set("abcd")))}
    seqs = ["ab", "abcabd", "cad"]
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice("abcd") for _ in range(12))
        places, matches = [], []
        scanner.run([ids[c] for c in t], 0, places, matches)
        assert sorted(p for p, _ in places) == [i for i in range(11) if t[i : i + 2] == "ab"]
        most = lambda i: max(n for n in range(i + 2) if any(t[i + 1 - n : i + 1] in s for s in seqs))
        stats = [most(i) for i in range(12)]
        want = [(i + 1 - stats[i], stats[i]) for i in range(12) if stats[i] and (i == 11 or stats[i + 1] != stats[i] + 1)]
        assert [(s, n) for s, n, _ in matches] == want
        for s, n, ends in matches:
            assert ends == {w: at for w, q in enumerate(seqs) if (at := [e for e in range(n, len(q) + 1) if q[e - n : e] == t[s : s + n]])}


def longest(matches, which, gap):
    """The most words that a chain covers, over all subsequences of (match, place in the template)."""
    flat = [(s, n, e) for s, n, ends in matches for e in ends.get(which, ())]

    def after(k, cover):
        top, (s, n, e) = cover, flat[k]
        for m in range(k + 1, len(flat)):
            s2, n2, e2 = flat[m]
            lap = max(0, s + n - s2, e - (e2 - n2))
            if e < e2 and lap < n2 and s2 - (s + n) <= gap:
                top = max(top, after(m, cover + n2 - lap))
        return top

    return max((after(k, flat[k][1]) for k in range(len(flat))), default=0)


def test_chains_equal_brute_force():
    r = random.Random(2)
    for trial in range(400):
        say = lambda k: " ".join(r.choice("abcde") for _ in range(k))
        rules = ScanRules(phrases={"a b": "x"}, templates={"t": say(9), "u": say(6)}, min_match=r.randrange(1, 4), max_gap=r.randrange(4))
        scanner, t = Scanner(rules), say(r.randrange(14)).split() + ["zz"] * r.randrange(4) + say(r.randrange(10)).split()
        ids = scanner.tokens(W.hashes(*spans_of(t)))
        places, matches, k = [], [], 0
        while k < len(t):
            e = k
            while e < len(t) and ids[e]:
                e += 1
            scanner.run(ids[k:e].tolist(), k, places, matches)
            k = e + 1
        best, spans = scanner.chains(matches)
        for which in (1, 2):
            assert best.get(which, 0) == longest(matches, which, rules.max_gap)
            found = [(a, b) for a, b, w, _ in spans if w == which]
            assert all(b <= c for (_, b), (c, _) in zip(found, found[1:], strict=False))
            assert all(a < b and c >= rules.min_cover * scanner.sizes[w] for a, b, w, c in spans)
            assert bool(found) == (best.get(which, 0) >= rules.min_cover * scanner.sizes[which])


def spans_of(words):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    e = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    return raw, e - np.array([len(w) for w in words], np.int64), e


def found(text, **rules):
    cols = scan(pa.array([text]), Scanner(ScanRules(**rules)))
    return dict(zip(COLUMNS, (c[0] for c in cols), strict=True))


def test_repeated_passages_gaps_and_single_words():
    t = "a b c d q1 q2 q3 q4 q5 q6 a b c d r1 r2 r3 r4"
    got = found(" ".join(t.split()[-14:]), templates={"t": t}, phrases={"x y": "z"})
    assert round(got["score"], 2) == 0.78
    for gap, cover in ((16, 1.0), (17, 0.5)):
        got = found("a b c d e " + "no " * gap + "f g h i j", templates={"t": "a b c d e f g h i j"}, phrases={"x y": "z"})
        assert got["score"] == cover
    assert found("a zebra b", phrases={"zebra": "animal"})["n_base"] == 1
    assert found("zebra", phrases={"zebra": "animal", "a b": "x"})["base_labels"] == "animal"


def test_spans():
    mit, bsd = TEMPLATES["mit"], TEMPLATES["bsd"]
    n, m = len(split(mit)), len(split(bsd))
    got = found(f"one two {mit} three {mit} {bsd}", templates={"mit": mit, "bsd": bsd})
    assert got["spans"] == [("mit", 2, 2 + n, 1.0), ("mit", 3 + n, 3 + 2 * n, 1.0), ("bsd", 3 + 2 * n, 3 + 2 * n + m, 1.0)]
    whole = found("Copyright\n" + TEMPLATES["bsd/text"])
    assert whole["labels"] == "bsd" and {s[0] for s in whole["spans"]} == {"bsd"} and whole["base_labels"] == ""
    for name, text in TEMPLATES.items():
        assert name.split("/")[0] in found(text)["labels"].split(",") and found(text)["score"] == 1
    many = found(f"{mit} " * 300, templates={"mit": mit})
    assert len(many["spans"]) == 300


def test_empty(spark):
    assert license_scan(frame(spark, tricky()).limit(0)).count() == 0
    assert split("A-b C") == [b"a", b"b", b"c"]
