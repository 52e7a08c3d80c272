import random
import re

import pytest

from watchloom.llm import line_dedup as D

VOCAB = [f"w{k}" for k in range(60)]


def plain(rows):
    """Kept text of each row, by comparing each line with all earlier ones; rows in order of id, null last."""
    seen, out = [], {}
    for at in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        text = rows[at][1]
        if text is None:
            out[at] = (None, 0)
            continue
        kept, lost = [], 0
        for line in text.split("\n"):
            w = set(re.findall(r"[^\x20\x09-\x0d]+", line))
            if w:
                again = any(len(w & s) >= 0.8 * len(w | s) - 1e-9 for s in seen)
                seen.append(w)
                lost += again
                if again:
                    continue
            kept.append(line)
        out[at] = ("\n".join(kept), lost)
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    rows, lines = [], []
    for i in range(n):
        own = []
        for _ in range(r.randint(0, 6)):
            if lines and r.random() < 0.5:
                w = r.choice(lines).split(" ")
                for _ in range(r.choice((0, 1, 1, 2, 4))):
                    w[r.randrange(len(w))] = r.choice(VOCAB)
            else:
                w = r.choices(VOCAB, k=r.choice((1, 2, 5, 9, 10, 11, 25, 40)))
            lines.append(" ".join(w))
            own.append(r.choice(("", "  ", "\t")) + lines[-1] + r.choice(("", " ")))
        rows.append((i, r.choice(("\n", "\n\n", "\n \n")).join(own)))
    return rows


def run(spark, rows):
    out, gone, count = D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    return [(r.doc_id, r.text, len(r[gone] or [])) for r in out.collect()]


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_against_plain(spark, seed):
    rows = corpus(seed)
    want = plain(rows)
    assert sorted(run(spark, rows)) == sorted((rows[i][0], t, n) for i, (t, n) in want.items())


def test_near_copies_of_one_line(spark):
    r = random.Random(9)
    base = r.choices([f"x{k}" for k in range(300)], k=30)
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(30)] = f"y{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    want = plain(rows)
    assert sorted(run(spark, rows)) == sorted((i, t, n) for i, (t, n) in want.items())


def test_odd_rows(spark):
    rows = [(3, "a b c"), (3, "a b c"), (None, "a b c\nnew line here"), (None, None), (1, ""), (2, "\n \n"), (7, "z " * 40_000 + "\n" + "z " * 3)]
    got = run(spark, rows)
    assert len(got) == 7 and sorted(t for d, t, _ in got if d == 3) == ["", "a b c"]
    assert [t for d, t, _ in got if d is None and t is not None] == ["new line here"]
    assert {d: t for d, t, _ in got if d in (1, 2)} == {1: "", 2: "\n \n"}
    assert [n for d, _, n in got if d == 7] == [1]


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", 9), (2, "a b", 8)], "doc_id long, text string, n_chars long").selectExpr("*", "1 as __row", "2 as number", "3 as line", "4 as __removed")
    out = D.without_repeated_lines(df)
    assert out.columns == df.columns and [(r.doc_id, r.n_chars) for r in out.collect()] == [(1, 9)]
    assert D.without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_group_of_near_copies_is_not_paired(spark, monkeypatch):
    counts, write = {}, D.materialize

    def counted(df, label, *rest):
        table = write(df, label, *rest)
        counts[label] = table.count()
        return table

    monkeypatch.setattr(D, "materialize", counted)
    r = random.Random(4)
    base = [f"x{k}" for k in range(60)]
    rows = []
    for i in range(200):
        w = list(base)
        for k in r.sample(range(60), 3):  # words of its own, which are its rarest
            w[k] = f"y{i}_{k}"
        rows.append((i, " ".join(w)))
    got = run(spark, rows)
    assert sorted(n for _, _, n in got) == [0] + [1] * 199
    assert counts["pairs"] <= 1000
