"""Personal data in text: exact patterns, and a linear-chain conditional random field beside them.

The patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers, leftmost and
non-overlapping for each kind; matches that fail their kind's check are dropped. The field labels
words by features of their shape, is trained by gradient ascent on a small labelled table (sentences
labelled by hand, and rows made by rule), and is decoded by Viterbi over numpy batches of whole texts; what
it finds apart from the patterns' spans, and passes the kind's check, is added (national phone numbers,
addresses written with "at" and "dot"), never taken away.

A token's features are looked up once a token of the language, not once an occurrence; texts of like length
share a batch of at most ``CELLS`` words, and a longer text is taken in blocks of that size that pass their
best scores on, so memory is bounded and the answer is that of the whole text.

Defined results: null text counts as empty; empty text has no spans; offsets are code points, end
exclusive; very long texts and words count whole; repeated rows give repeated results; of spans that start
together the kinds' order decides; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts where a run of digits does: an earlier match ends with its run
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORDS = re.compile(r"\S+")
CELLS = 1 << 17
LEXICON = 200_000
#: Characters of a task's tokens, which may be long each.
LEXICON_SIZE = 1 << 24
EDGE = "\"'`,;:!?()[]{}<>*#$%&=|"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str) -> list[Span]:
    """Each at sign, with the run of local characters before it: linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, start)
            at = text.find("@", at + 1)
    return found


def octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or 0) <= 255


def base_spans(text: str) -> list[Span]:
    found = emails(text)
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(octet, m.groups()))]
        for m in CARD.finditer(text):
            d = only_digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# the field

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
PLACE = {x: i for i, x in enumerate(LABELS)}
KEYS = frozenset(("at", "dot", "tel", "phone", "call", "fax", "mail", "email", "card", "ip", "host"))


def shape(word: str) -> str:
    """Letters, capitals and digits by class; runs of letters are one, runs of digits at most four."""
    out, last, run = [], "", 0
    for c in word:
        k = "0" if "0" <= c <= "9" else "a" if c.islower() else "A" if c.isalpha() else c
        run = run + 1 if k == last else 1
        if run == 1 or k == "0" and run <= 4:
            out.append(k)
        last = k
    return "".join(out)


def near_form(word: str) -> str:
    low = word.lower()
    return low if low in KEYS else shape(word)


def own_checks(w: str, d: str) -> list[str]:
    """Features of a word, whose digits are ``d``, that checks give."""
    got = []
    if 12 <= len(d) <= 19:
        got.append(f"luhn={luhn(d)}")
    if m := IP.fullmatch(w):
        got.append(f"octets={all(map(octet, m.groups()))}")
    if "@" in w:
        got.append(f"at={bool(emails(w))}")
    return got


def features(words: list[str], k: int) -> list[str]:
    w, d = words[k], only_digits(words[k])
    near = lambda i: near_form(words[i]) if 0 <= i < len(words) else "<edge>"
    return ["bias", f"w={near(k)}", f"p={near(k - 1)}", f"n={near(k + 1)}", f"digits={min(len(d), 20)}", f"pp={near(k - 2)}|{near(k - 1)}", f"nn={near(k + 1)}|{near(k + 2)}", *own_checks(w, d)]


#: Sentences labelled by hand: {kind:span}. More of this style are in the tests, which the field doesn't see.
SENTENCES = """
Call our office at {phone:(212) 555-0147} before noon, or write to {email:front.desk@example.org}.
My new number is {phone:415-555-0198}, please delete the old one.
You can reach Ana under {phone:+49 30 5550 1234} on weekdays between 9 and 17.
For refunds contact {email:billing at shop.example.com} and quote order 48213.
She signs her posts as {email:maria.k at mail dot example dot net} to fool the bots.
The server {ip:10.12.0.7} refused 3 of 25 connections on 2021-03-14.
Requests from {ip:192.168.1.254} were dropped after version 2.4.1 was rolled out.
He paid with {card:4111 1111 1111 1111} and lost the receipt.
Card {card:5500005555555559} expires 08/27.
Invoice 2023-0041 lists 12 items at 45.90 each, in total 550.80.
The meeting moved from room 204 at 10:30 to room 310 at 11:15.
In 1998 some 12,500 people lived at the lake, in 2008 only 9,700.
Chapter 3.2.1 is on page 118, see figures 4 and 5.
ISBN 978-3-16-148410-0 was out of print by 2015.
We met at the station and left at dawn.
They laughed at him and at dot com companies alike.
Version 10.0.19045 fixed 7 bugs, version 10.0.19046 none.
Tel. {phone:030 5550 12345}, fax {phone:030 5550 12399}.
phone: {phone:(020) 7946 0018}
Please fax the form to {phone:555-010-7788} or drop it at 14 Mill Lane.
The tracking code 1Z999AA10123456784 is not a phone number.
Serial 4000123412341234 failed the test twice.
The host {ip:203.0.113.9} answers on port 8080.
Write to {email:jo_smith-77@mail.example.co.uk}; the list at the end has 40 names.
Between 100 and 200 of the 3,000 samples were lost at minus 80 degrees.
Population: 1 204 332 (2011), 1 187 910 (2001).
Ask for extension 4411 at the desk.
The price rose from $1,250.00 to $1,399.99 within 30 days.
Send it to {email:info at example dot org} or bring it in at 5 pm.
Mail {email:lena at mail.example.com} before Friday.
Questions go to {email:support at example.org} as always.
He works at example.com and sleeps at home.
Mobile {phone:(0170) 555 0123 4}, at home after 18:00.
score 3-1, half time 2-0, attendance 41-222
Coordinates 52.5200, 13.4050 and 48.8566, 2.3522.
sha 9f86d081884c7d659a2feaa0c55ad015 matched at line 77
on 12.05.2019 at 14.30 the train 4711 left
"""


def by_hand(sentences: str) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of marked sentences."""
    table = []
    for line in filter(None, sentences.split("\n")):
        words, labels = [], []
        for kind, inside, plain in re.findall(r"\{(\w+):([^}]*)\}|([^{]+)", line):
            for k, (w, _, _) in enumerate(tokens(inside or plain)):
                words.append(w)
                labels.append("O" if not kind else f"{'I' if k else 'B'}-{kind}")
        table.append((words, labels))
    return table


def trimmed(token: str) -> tuple[str, int]:
    """A token of text without the marks around it, and where it starts."""
    if token.isalnum():
        return token, 0
    w = token.rstrip(EDGE + ".").lstrip(EDGE.replace("(", "")) or token
    if w.count("(") != w.count(")"):
        w = token.rstrip(EDGE.replace(")", "") + ".").lstrip(EDGE.replace("(", "")) or token
    return w, token.find(w)


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of a text."""
    out = []
    for m in WORDS.finditer(text):
        w, cut = trimmed(m.group())
        out.append((w, m.start() + cut, m.start() + cut + len(w)))
    return out


def labelled_table(rows: int = 360, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Labelled rows (words, labels) made from a rule."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ka", "lo", "mi", "ter", "un", "sa", "en", "dro", "vi")) for _ in range(r.randint(1, 4)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        while not luhn(c := "4" + num(15)):
            pass
        return c

    def miss() -> str:
        while luhn(c := "4" + num(15)):
            pass
        return c

    kinds = [
        lambda: ("email", [f"{word()}.{num(2)}@mail.{word()}.com"]), lambda: ("email", [word(), "at", word(), "dot", "com"]), lambda: ("email", [f"{word()}{num(2)}", "at", f"{word()}.org"]),
        lambda: ("ip", [f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}"]), lambda: ("card", [card()]),
        lambda: ("phone", ["+1", f"({num(3)})", f"{num(3)}-{num(4)}"]), lambda: ("phone", [f"({num(3)})", f"{num(3)}-{num(4)}"]), lambda: ("phone", [f"{num(3)}-{num(3)}-{num(4)}"]),
        lambda: ("O", [miss()]), lambda: ("O", [num(r.randint(1, 6))]), lambda: ("O", [f"{num(1)}.{num(1)}"]), lambda: ("O", [f"{num(1)}.{num(1)}.{num(1)}"]), lambda: ("O", [f"300.{num(3)}.{num(1)}.999"]),
        lambda: ("O", [f"20{num(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}"]), lambda: ("O", ["token", "=", "".join(r.choice("0123456789abcdef") for _ in range(40))]), lambda: ("O", [f"${num(3)}.{num(2)}"]),
        lambda: ("O", ["at", num(2), word()]), lambda: ("O", [f"{num(3)}-{num(4)}"]), lambda: ("O", [word(), "at", word(), word()]), lambda: ("O", [f"v{num(1)}", word()]),
    ]
    table = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(r.randint(1, 2)):
            before = [word() for _ in range(r.randint(0, 4))]
            kind, item = r.choice(kinds)()
            words += before + item
            labels += ["O"] * len(before) + (["O"] * len(item) if kind == "O" else [f"{'I' if i else 'B'}-{kind}" for i in range(len(item))])
        after = [word() for _ in range(r.randint(0, 4))]
        table.append((words + after, labels + ["O"] * len(after)))
    return table


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


@lru_cache(1)
def trained(steps: int = 60, rate: float = 0.15, decay: float = 1e-3) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, emissions, transitions, start) after ``steps`` of Adam on the log-likelihood."""
    table = labelled_table() + 4 * by_hand(SENTENCES)
    ids: dict[str, int] = {}
    rows = [[[ids.setdefault(f, len(ids)) for f in features(words, k)] for k in range(len(words))] for words, _ in table]
    gold = [[PLACE[x] for x in labels] for _, labels in table]
    n, size, s = len(rows), max(map(len, rows)), len(LABELS)
    flat_i = np.array([i for i, row in enumerate(rows) for fs in row for _ in fs])
    flat_t = np.array([t for row in rows for t, fs in enumerate(row) for _ in fs])
    flat_f = np.array([f for row in rows for fs in row for f in fs])
    y = np.full((n, size), -1)
    for i, g in enumerate(gold):
        y[i, : len(g)] = g
    there = y >= 0
    one = (y[..., None] == np.arange(s)).astype(float)
    pairs = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
    params = [np.zeros((len(ids), s)), np.zeros((s, s)), np.zeros(s)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, trans, start = params
        e = np.zeros((n, size, s))
        np.add.at(e, (flat_i, flat_t), w[flat_f])
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0] + start
        for t in range(1, size):
            here = _log_sum(fwd[:, t - 1, :, None] + trans[None], 1) + e[:, t]
            fwd[:, t] = np.where(there[:, t, None], here, fwd[:, t - 1])
        z = _log_sum(fwd[:, -1], 1)
        for t in range(size - 2, -1, -1):
            here = _log_sum(trans[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(there[:, t + 1, None], here, bwd[:, t + 1])
        p = np.exp(fwd + bwd - z[:, None, None]) * there[..., None]
        edge = np.zeros((s, s))
        for t in range(1, size):
            x = np.exp(fwd[:, t - 1, :, None] + trans[None] + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None])
            edge += (x * there[:, t, None, None]).sum(0)
        gw = np.zeros_like(w)
        np.add.at(gw, flat_f, (one - p)[flat_i, flat_t])
        grads = [gw - decay * n * w, pairs - edge - decay * n * trans, (one[:, 0] - p[:, 0]).sum(0) - decay * n * start]
        for k, g in enumerate(grads):
            g = g / n
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return ids, *params


class Field:
    """The trained field as tables: the score of each label by what stands at, before and after a word."""

    def __init__(self, fitted: tuple | None = None):
        ids, w, self.trans, self.start = fitted or trained()
        rows = [[near_form(x) for x in words] for words, _ in labelled_table() + by_hand(SENTENCES)]
        self.forms = {f: k for k, f in enumerate(["", "<edge>", *sorted({f for row in rows for f in row})])}  # the first is any other
        n, one = len(self.forms), lambda f: w[ids[f]] if f in ids else np.zeros(len(LABELS))
        self.score = one
        self.at, self.before, self.after = (np.array([one(f"{x}={f}") for f in self.forms]) + (one("bias") if x == "w" else 0) for x in "wpn")
        self.before2, self.after2 = np.zeros((n, n, len(LABELS))), np.zeros((n, n, len(LABELS)))
        for row in rows:
            row = ["<edge>", "<edge>", *row, "<edge>", "<edge>"]
            for a, b in zip(row, row[1:], strict=False):
                self.before2[self.forms[a], self.forms[b]], self.after2[self.forms[a], self.forms[b]] = one(f"pp={a}|{b}"), one(f"nn={a}|{b}")
        self.digits = np.array([one(f"digits={k}") for k in range(21)])


_FIELD: list[Field] = []


def field(fitted: tuple | None = None) -> Field:
    """The field of this process; made of what has been fitted elsewhere, if that is given first."""
    if not _FIELD:
        _FIELD.append(Field(fitted))
    return _FIELD[0]


class Lexicon(dict):
    """Place of each token in arrays of what the field looks at: its form, its number of digits, the scores
    of its checks, and where the word in it starts and how long it is."""

    def __init__(self, trim: bool = True):
        self.trim, self.field, self.size = trim, field(), 0
        self.table = np.zeros((1024, 5), np.int64)
        self.checks: dict[tuple[str, ...], int] = {(): 0}
        self.scores = [np.zeros(len(LABELS))]

    def __missing__(self, token: str) -> int:
        w, cut = trimmed(token) if self.trim else (token, 0)
        d = only_digits(w)
        checked = tuple(own_checks(w, d))
        if checked not in self.checks:
            self.checks[checked] = len(self.scores)
            self.scores.append(sum(map(self.field.score, checked)))
        k = len(self)
        if k == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[k] = self.field.forms.get(near_form(w), 0), min(len(d), 20), self.checks[checked], cut, len(w)
        self[token] = k
        self.size += len(token)
        return k


def best_labels(rows: list[np.ndarray], lexicon: Lexicon) -> list[np.ndarray]:
    """Places of the best labels of rows of places in ``lexicon``, all rows at once."""
    f, table, scores = lexicon.field, lexicon.table, np.array(lexicon.scores)
    lengths = np.array([len(x) for x in rows])
    size, edge, some = int(lengths.max()), f.forms["<edge>"], np.arange(len(rows))
    forms, digits, checks = np.full((len(rows), size + 4), edge), np.zeros((len(rows), size), np.int64), np.zeros((len(rows), size), np.int64)
    for i, x in enumerate(rows):
        forms[i, 2 : 2 + len(x)], digits[i, : len(x)], checks[i, : len(x)] = table[x, 0], table[x, 1], table[x, 2]
    back, best, step = np.zeros((size, len(rows), len(LABELS)), np.int8), None, max(1, CELLS // len(rows))
    for a in range(0, size, step):
        b = min(size, a + step)
        at = lambda k, a=a, b=b: forms[:, a + 2 + k : b + 2 + k]
        e = f.at[at(0)] + f.before[at(-1)] + f.after[at(1)] + f.before2[at(-2), at(-1)] + f.after2[at(1), at(2)] + f.digits[digits[:, a:b]] + scores[checks[:, a:b]]
        for t in range(a, b):
            if best is None:
                best = e[:, 0] + f.start
                continue
            x = best[:, :, None] + f.trans[None]
            back[t] = x.argmax(1)
            best = np.where((lengths > t)[:, None], x.max(1) + e[:, t - a], best)
    k, path = best.argmax(1), np.zeros((size, len(rows)), np.int8)
    for t in range(size - 1, -1, -1):
        path[t] = k
        k = np.where(lengths > t, back[t][some, k], k) if t else k
    return [path[:n, i] for i, n in enumerate(lengths)]


def batches(lengths: list[int]) -> Iterator[list[int]]:
    """Places of rows, rows of like length together, at most CELLS words with what fills them up."""
    held: list[int] = []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lengths.__getitem__):
        if held and (len(held) + 1) * lengths[i] > CELLS:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def viterbi(rows: list[list[str]]) -> list[list[str]]:
    """Best labels of each row of words."""
    lexicon, out = Lexicon(trim=False), [[] for _ in rows]
    coded = [np.array([lexicon[w] for w in row], np.int64) for row in rows]
    for some in batches([len(x) for x in coded]):
        for i, path in zip(some, best_labels([coded[i] for i in some], lexicon), strict=True):
            out[i] = [LABELS[k] for k in path]
    return out


def sound(kind: str, s: str) -> bool:
    """The check that a span of the field must pass."""
    d = only_digits(s)
    if kind == "phone":
        return 10 <= len(d) <= 15 and not re.search(r"[A-Za-z]", s)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9 -]", s)
    if kind == "ip":
        return bool((m := IP.fullmatch(s)) and all(map(octet, m.groups())))
    return bool(re.fullmatch(r"[\w.+-]+ at [\w-]+(?:(?:\.| dot )[\w-]+)+", s))


def added(text: str, base: list[Span], spans: list[Span]) -> list[Span]:
    """Those of the field's spans that pass their check and touch none of the patterns'."""
    return [s for s in spans if sound(s[0], text[s[1] : s[2]]) and not any(b[1] < s[2] and s[1] < b[2] for b in base)]


def field_spans(words: list[tuple[int, int]], path: np.ndarray) -> list[Span]:
    """The spans that a row's labels make of its words (start, end)."""
    found, k, marked = [], 0, np.flatnonzero(path)
    while k < len(marked):
        a = k
        kind = LABELS[path[marked[a]]][2:]
        k += 1
        while k < len(marked) and marked[k] == marked[k - 1] + 1 and LABELS[path[marked[k]]] == f"I-{kind}":
            k += 1
        found.append((kind, words[marked[a]][0], words[marked[k - 1]][1]))
    return found


def scan(texts: list[str | None], lexicon: Lexicon | None = None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    lexicon = Lexicon() if lexicon is None else lexicon
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    coded = [np.fromiter(map(lexicon.__getitem__, WORDS.findall(t)), np.int64) for t in texts]
    out = [(b, b) for b in base]
    for some in batches([len(x) for x in coded]):
        for i, path in zip(some, best_labels([coded[i] for i in some], lexicon), strict=True):
            if not path.any():
                continue
            starts, own = [m.start() for m in WORDS.finditer(texts[i])], lexicon.table[coded[i]]
            words = [(a + int(cut), a + int(cut) + int(n)) for a, (cut, n) in zip(starts, own[:, 3:].tolist(), strict=True)]
            out[i] = base[i], in_order(base[i] + added(texts[i], base[i], field_spans(words, path)))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _runner(fitted: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Finds with a field that the driver has fitted, so that no task fits one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field(fitted)
        lexicon = Lexicon()
        for batch in parts:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lexicon = lexicon if len(lexicon) < LEXICON and lexicon.size < LEXICON_SIZE else Lexicon()
                found = scan(part.column("text").to_pylist(), lexicon)
                count = {k: [sum(s[0] == k for s in b) for b, _ in found] for k in KINDS}
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), **{f"n_{k}": pa.array(count[k], pa.int64()) for k in KINDS},
                    "base_sha256": pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()),
                    "spans": pa.array([joined(a) for _, a in found], pa.string()), "n_added": pa.array([len(a) - len(b) for b, a in found], pa.int64()),
                })

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the patterns' spans, all spans, how many the field added."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_runner(trained()), SCHEMA)
