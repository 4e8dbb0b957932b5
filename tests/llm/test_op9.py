import re
from collections import Counter

import pyarrow as pa

from strataform.llm import quality_rules as Q
from strataform.llm.quality_rules import op9_quality_rules, quality_rules
from tests.llm.helpers import frame, save, tricky

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    out["n_dup_lines"] = len(lines) - len(set(lines))
    for k in (5, 8, 12):
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        n = Counter(grams)
        hit = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(k)}
        if k == 5:
            out["n_repeat_words"] = len(hit)
        out[f"dup_{k}gram_share"] = sum(len(w[i]) for i in hit) / max(1, out["word_chars"])
    out["base_failed"] = len(w) < 10 or 100 * out["n_repeat_words"] > 20 * len(w)
    return out


def test_equals_brute_force(spark, tmp_path):
    rows = tricky() + tricky(5)[:20]
    texts = Counter()
    for r in op9_quality_rules(spark, save(spark, tmp_path, rows)).collect():
        texts[r.doc_id, tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in brute(""))] += 1
        assert not (r.base_failed and r.kept)
    assert texts == Counter((i, tuple(round(v, 9) if isinstance(v, float) else v for v in brute(t).values())) for i, t in rows)


def test_lines_of_one_hash(monkeypatch):
    """Should lines' hashes meet, their bytes decide; equal lines of two texts aren't repeats."""
    real, texts = Q.W.hashes, ["a\nb\na\nc d\nc d", "a\nb", None, "\n\n", "".join(t or "" for _, t in tricky())]
    for keep in (3, 2**64 - 1):
        monkeypatch.setattr(Q.W, "hashes", lambda b, s, e, k=keep: real(b, s, e) & Q.W.U(k))
        assert Q.measure(pa.array(texts))["n_dup_lines"].tolist() == [brute(t)["n_dup_lines"] for t in texts]


def test_empty_and_clashing(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, tricky()).withColumn("n_words", F.lit("x"))
    assert quality_rules(docs.limit(0)).count() == 0
    out = quality_rules(docs)
    assert dict(out.dtypes)["n_words"] == "bigint" and "lang" in out.columns
    assert out.filter("doc_id = 6").first().base_failed and not out.filter("doc_id = 6").first().kept
