"""Small inputs that every operator must survive."""

import random

WORDS = "the of and und le la que is to in alpha beta gamma delta Ünder çan étre 漢字 naïve # $ | <b> a's".split()


def mirrored(n):
    """Two words of ``n`` letters that a polynomial in an odd base modulo 2**64 can't tell apart."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def tricky(seed=0, n=60):
    """(doc_id, text): nulls, blanks, copies, near copies, long and odd texts."""
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) + r.choice(["", "", "", str(r.randrange(9999))]) for _ in range(k))
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "a b c d"), (5, "a b c d e"), (6, "x " * 50), (7, "A\x0bB\x0cC\x1cD\x85E F　G"), (8, "\n\n\nline\nline\n line\n"), (9, "z" * 5000), (10, "😀" * 30 + " end")]
    base = say(120)
    rows += [(11, base), (12, base), (13, base + " tail"), (14, base.replace("the", "tha", 1)), (15, base.upper())]
    rows += [(16, "\n".join(say(8) for _ in range(40))), (17, say(4000))]
    rows += [(i, say(r.randrange(1, 200)).replace(" ", r.choice([" ", "\n", "  "]), 3)) for i in range(18, n)]
    for k in range(3):
        a, b = mirrored(1024 << k)
        rows += [(80 + 3 * k, f"x {a}"), (81 + 3 * k, f"x {b}"), (82 + 3 * k, f"{a} {b} {a}\n{a} x\n{b} x\n{b} x")]
    return rows


def frame(spark, rows, extra=True):
    """documents with clashing extra columns."""
    data = [(i, t, "en", f"src{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or "")) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def save(spark, tmp, rows, name="documents"):
    frame(spark, rows).coalesce(2).write.mode("overwrite").parquet(f"{tmp}/{name}.parquet")
    return str(tmp)
