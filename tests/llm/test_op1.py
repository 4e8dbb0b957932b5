import hashlib
import re

from strataform.llm import fingerprints as fp
from tests.llm.helpers import frame, save, tricky


def pieces(t):
    out, at = set(), 0
    for size, least, most in ((64, 12, 32), (192, 48, 96)):
        out |= set(re.findall(rf"[^\n]{{{least},{most}}}?(?=[ \t\n\x0b\f\r])|[^\n]{{1,{most}}}", t[at : at + size]))
        at += size
    return out | set(re.findall("[^\n]{1,256}", t[at:]))


def brute(rows):
    data = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(data):
        nxt = data[k - 1][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(pieces(t), pieces(edited)), 9), round(like(pieces(t), pieces(nxt)), 9)))
    return sorted(map(str, out))


def test_equals_brute_force(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(700))
    rows = tricky() + tricky()[:12] + [(None, "no id"), (None, "no\nid"), (900, long), (901, long.replace("7", "8")), (899, "\n".join(f"other {i}" for i in range(90)))]
    got = fp.op1_fingerprints(spark, save(spark, tmp_path, rows)).collect()
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))) for r in got) == brute(rows)
    ids = [i for i, _ in rows]
    of = {r.doc_id: r.fingerprint for r in got}
    texts = {t or "": i for i, t in rows if ids.count(i) == 1}
    assert all(of[i] == of[texts[t or ""]] for i, t in rows if ids.count(i) == 1)
    assert len({of[i] for i in texts.values()}) == len(texts)


def test_rows_equal_in_row(spark, monkeypatch):
    pairs = [(k, list(range(1, 1 + 40 * k)), list(range(1 + 13 * k, 1 + 60 * k))) for k in range(5)] + [(9, [], [])]
    df = spark.createDataFrame(pairs, "pair long, ka array<long>, kb array<long>")
    want = {p: len(set(a) ^ set(b)) for p, a, b in pairs}
    assert {r.pair: r.d for r in fp.differences(df).collect()} == want
    monkeypatch.setattr(fp, "IN_ROW", 60)
    assert {r.pair: r.d for r in fp.differences(df).collect()} == want


def test_empty_and_lone(spark):
    assert fp.fingerprints(frame(spark, tricky()).limit(0)).count() == 0
    r = fp.fingerprints(frame(spark, [(1, "abcd")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1


def test_half_of_a_short_text_is_found(spark):
    """Texts of one line that share their first half: like the edited text, unlike the next one."""
    words = [f"{chr(97 + i % 26)}{i * 7919 % 1000}" for i in range(400)]
    rows = [(i, " ".join(words[i * 9 : i * 9 + 12 + i])) for i in range(40)]
    got = fp.fingerprints(frame(spark, rows)).collect()
    assert all(r.near_edited > r.near_next for r in got) and min(r.n_chars for r in got) < 64


def test_sketch_holds_each_digest_once_a_table(spark):
    r = spark.createDataFrame([(list(range(1, 200)), [5], [])], "a array<long>, b array<long>, e array<long>").select(*(fp.sketch(c, "8").alias(c) for c in "abe")).first()
    for t in range(3):
        assert sum(x.n for x in r.a[8 * t : 8 * t + 8]) == 199 and [x.k for x in r.b[8 * t : 8 * t + 8] if x.n] == [5]
    assert len(r.a) == 24 and not any(x.n or x.k or x.h for x in r.e)
