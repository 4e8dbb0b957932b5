import hashlib
import re

import pytest

from strataform.llm import fill_middle as M
from tests.compare import compare, duck
from tests.llm.helpers import frame, save, tricky

ODD = [(200, "<P>"), (201, "a <S> b"), (202, "x<M"), (203, "<<P"), (204, "a<P >b"), (205, "ends in <"), (206, "<S" * 40), (207, "é\U0001f600\n" * 50), (208, "P>S>M>" * 9), (209, "\n"), (210, "long " * 60000)]


def brute(i, text, plain=10, first=20):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 100 - plain else "spm" if h[3] % 100 < first else "psm"
    out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, n, form, None if form == "plain" else a, None if form == "plain" else b - a, sha(out), sha(text))


def test_equals_brute_force(spark, tmp_path):
    rows = tricky() + tricky()[:12] + ODD + [(None, "no id"), (None, None), (7, "again")]
    got = M.op11_fill_middle(spark, save(spark, tmp_path, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute(*r)) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_equals_sql(spark, tmp_path):
    sf = save(spark, tmp_path, [r for r in tricky() + ODD if r[0] != 7])  # DuckDB keeps \x1c as it is, its own reader splits there
    ours, theirs = compare(spark, duck(sf), sf, "op11", M.op11_fill_middle, M.ORACLE_SQL)
    assert ours == theirs


@pytest.mark.parametrize("units", M.UNITS)
def test_ranks(units):
    """Every unit's place, against units cut by a pattern; marks are found at any place."""
    machine = M.automaton()
    pattern = "(?s)." if units == "codepoint" else "[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+"
    for text in ["", " ", "a", "ab  c\n", "  \t x", "x y \U0001f600", *(t or "" for _, t in tricky() + ODD)][:90]:
        r, cuts = M.Ranks(machine, text[:5000], units), [0, *(m.end() for m in re.finditer(pattern, text[:5000]))]
        assert r.units == len(cuts) - 1 and [r.place(k) for k in range(len(cuts))] == cuts
        assert [e for e, _ in r.marks] == [m.end() for m in re.finditer("<[PSM]>", text[:5000])]


def test_runs_shares_and_extra_columns(spark):
    """Other units and shares; columns of the result's names are replaced, others stay; seeds differ."""
    docs = frame(spark, tricky() + ODD).withColumnRenamed("lang", "output").withColumnRenamed("n_chars", "n").withColumnRenamed("source", "_h")
    out = M.restore(M.fill_middle(docs, "run", M.Shares(0, 50), seed=3)).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "_h", "n", "form", "prefix_units", "middle_units", "output", "restored"}
    for r in out:
        runs = re.findall("[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+", r.text or "")
        assert r.n == len(runs) and r.restored == (r.text or "")
        assert (r.form == "plain") == (not runs or bool(re.search("<[PSM]>", r.text)))
        if r.form != "plain":
            middle = "".join(runs[r.prefix_units : r.prefix_units + r.middle_units])
            assert r.output.endswith("<M>" + middle)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        M.fill_middle(docs, "word")


def test_empty(spark, tmp_path):
    assert M.fill_middle(frame(spark, tricky()).limit(0)).count() == 0
    assert M.op11_fill_middle(spark, save(spark, tmp_path, [])).collect() == []
