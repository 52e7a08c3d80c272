import random
import re

from watchloom.llm import pii as P


def plain_emails(t):
    return [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]


def plain(t):
    found = plain_emails(t)
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else (int(c) * 2) // 10 + (int(c) * 2) % 10 for k, c in enumerate(reversed(d))) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_base_spans_against_the_patterns():
    r = random.Random(5)
    bits = ["a", "b.c", "@", "x-y", ".", "1", "23", "4242424242424242", " ", "-", "+1", "(555)", "%", "_", "é", "1.2.3.4", "300", "\n", "a@b.c", "00000", "+49 30 1234567"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert P.base_spans(t) == plain(t), t


def test_long_runs_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "1 " * 200_000):
        P.base_spans(t)


def test_field_adds_and_never_takes():
    texts = ["call (743) 555-3824 now", "mail kalo at miter dot com ok", "+1 (269) 555-3296 4524132264652876 and", "in 2024-01-05 v1.2.3 at 12 dot", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None, ""]
    got = P.scan(texts)
    assert [s[0] for s in got[0][1]] == ["phone"] and [s[0] for s in got[1][1]] == ["email"]
    assert all(set(b) <= set(a) for b, a in got)
    assert [len(a) for _, a in got[3:]] == [0, 0, 0, 0]


def test_field_on_rows_it_was_not_trained_on():
    table = P.labelled_table(rows=200, seed=99)
    said = P.viterbi([w for w, _ in table])
    right = sum(a == b for (_, want), got in zip(table, said, strict=True) for a, b in zip(want, got, strict=True))
    assert right / sum(len(w) for w, _ in table) > 0.97


#: Labelled by hand like those that train the field, which doesn't see these.
UNSEEN = """
Ring {phone:(646) 555-0112} after six, the bell is broken.
Our helpdesk is {phone:+44 20 7946 0999} from 8 to 18.
Write {email:ben at shop.example.net} if item 3 of 12 is missing.
Node {ip:172.16.4.20} lost 14 packets on 2022-11-02.
The total of 1,204.50 was due on 01.02.2023, see page 14.
Build 3.11.4 runs at half speed on port 8443.
They stood at the gate at 7:45 with 200 others.
Fax {phone:555-010-2233}, or come to 9 Elm Street.
{card:4012888888881881} was declined at 23:10.
"""


def test_field_on_sentences_it_was_not_trained_on():
    table = P.by_hand(UNSEEN)
    said = P.viterbi([w for w, _ in table])
    pairs = [(a, b) for (_, want), got in zip(table, said, strict=True) for a, b in zip(want, got, strict=True)]
    plain = [b for a, b in pairs if a == "O"]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.9 and plain.count("O") / len(plain) > 0.95


def test_whole_texts_are_decoded():
    """The labels of a long text are those of the best path over all of it, in one block or many."""
    r = random.Random(3)
    rows = [x for words, _ in P.labelled_table(rows=40, seed=5) for x in words]
    r.shuffle(rows)
    want = P.viterbi([rows])[0]
    old, P.CELLS = P.CELLS, 16
    try:
        assert P.viterbi([rows, rows[:3]]) == [want, P.viterbi([rows[:3]])[0]]
    finally:
        P.CELLS = old
    ids, w, trans, start = P.trained()
    e = [w[[ids[f] for f in P.features(rows, k) if f in ids]].sum(0) for k in range(len(rows))]
    best, back = start + e[0], []
    for x in e[1:]:
        back.append((best[:, None] + trans).argmax(0))
        best = (best[:, None] + trans).max(0) + x
    path = [int(best.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    assert want == [P.LABELS[k] for k in path[::-1]]


def test_long_texts_and_words():
    text = "call (743) 555-3824 " + "12 " * 40_000 + "mail kalo at miter dot com " + "x" * 200_000 + "1"
    base, found = P.scan([text])[0]
    assert base == P.base_spans(text) and {k for k, _, _ in found} >= {"phone", "email"}
    assert P.shape("a" * 100 + "7") == "a0"


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    ids, w, trans, start = P.trained()
    words = ["call", "+1", "(743)", "555-3824"]
    e = np.array([w[[ids[f] for f in P.features(words, k) if f in ids]].sum(0) for k in range(4)])
    best = max(itertools.product(range(len(P.LABELS)), repeat=4), key=lambda p: start[p[0]] + sum(e[k, p[k]] for k in range(4)) + sum(trans[p[k], p[k + 1]] for k in range(3)))
    assert P.viterbi([words])[0] == [P.LABELS[k] for k in best]


def test_query_columns(spark):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (None, None), (2, ""), (3, "ü 1.2.3.4 x@y.z")]
    got = P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as spans")).collect()
    assert len(got) == 5 and [r.spans for r in got][-1] == "ip:2:9,email:10:15" and got[2].base_sha256 == got[3].base_sha256
    assert P.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
