import hashlib
import random
import re

from granthi.llm import fim


def cut(text, doc_id, seed=7, rate=100, spm=50):
    """The contract, line by line."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def texts():
    rng = random.Random(3)
    made = ["", "\n", "a", "\n\n", "a\n", "<P>", "x<S\n>", "<<\n<S", ">\n>P>", "\r\nb c\n"]
    made += ["".join(rng.choice(["a", "\n", "é", "<", "P>", "<S", ">", "😀", "bcd\n"]) for _ in range(rng.choice([1, 3, 30, 2000]))) for _ in range(300)]
    return made


def test_rope_against_slices():
    for k, text in enumerate(texts()):
        assert fim.rearranged(text, k) == cut(text, k)
        rope = fim.build(text, 5)
        assert (str(rope), rope.units, rope.points) == (text, len(re.findall(r"[^\n]*\n|[^\n]+", text)), len(text))
        for rank in (0, 1, 2, len(text) // 2, len(text), len(text) + 5):
            a, b = fim.split(rope, rank, "points")
            assert (str(a), str(b)) == (text[:rank], text[rank:])
            a, b = fim.split(rope, rank, "units")
            lines = re.findall(r"[^\n]*\n|[^\n]+", text)
            assert (str(a), str(b), a.units) == ("".join(lines[:rank]), "".join(lines[rank:]), min(rank, len(lines)))


def test_table(spark):
    rows = [(k, t, "x", [1]) for k, t in enumerate(texts())] + [(None, None, "x", None), (None, "a\nb\n", "y", []), (3, "\n\n", "x", None), (3, "\n\n", "x", None), (-5, "line\n" * 400_000, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, restored array<int>")
    for seed, rate, spm in ((7, 100, 50), (1, 40, 0)):
        made = fim.fill_in_middle(df, seed, rate, spm)
        got = sorted(map(tuple, made.collect()), key=repr)
        assert got == sorted(((i, *cut(t or "", "" if i is None else i, seed, rate, spm)) for i, t, *_ in rows), key=repr)
    back = fim.restored(fim.fill_in_middle(df)).select("doc_id", "restored").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t, *_ in rows), key=repr)
    assert fim.restored(fim.fill_in_middle(df.limit(0))).isEmpty()
