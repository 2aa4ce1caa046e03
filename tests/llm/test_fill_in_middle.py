"""Fill-in-middle texts against a plain version, and back."""

import hashlib
import re

import numpy as np

from ratelens.llm import fill_in_middle as fim

ODD = ["<P", "P>", "<<P>", "<S", "<M>", "a<P", "x\n", "\n", "\n\n\n", "é\nü\n漢", "a\n<S", "<\nP>", "<P\n>", "no end", "one\ntwo\nthree\nfour\nfive", "<PP>", "<<", "🙂\n🙂<", "\r\n\r", "a\x00b\n"]


def plain(doc_id, text, rate=100, swap=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < swap else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < swap else "psm", len(p), len(m), out


def test_formatted(documents, odd_texts):
    texts = [*odd_texts, *ODD, *ODD[::-1], *["\n".join(ODD)] * 20, *["".join(f"line {i}\n" for i in range(k)) for k in range(40)]]
    rows = {r.doc_id: r for r in fim.formatted(documents(texts)).collect()}
    forms = set()
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(i, t), t
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_digests_and_restored_texts(documents, odd_texts):
    texts = [*odd_texts, *ODD]
    rows = {r.doc_id: r for r in fim.digests(fim.formatted(documents(texts))).collect()}
    for i, t in enumerate(texts):
        assert rows[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest(), t
        assert rows[i].output_sha256 == hashlib.sha256(plain(i, t)[-1].encode()).hexdigest()


def test_rates(documents):
    texts = ["a\nb\nc\n"] * 200
    rows = fim.formatted(documents(texts), rate=30, suffix_first=10).collect()
    assert [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in sorted(rows)] == [plain(i, t, 30, 10) for i, t in enumerate(texts)]


def test_odd_rows(spark, documents):
    df = spark.createDataFrame([(None, "a\nb", 1, "x"), (None, "a\nb", 2, "y"), (5, None, 3, "z")], "doc_id long, text string, n int, output string")
    rows = fim.formatted(df).collect()
    assert rows[0] == rows[1] and (rows[0].n, rows[0].form, rows[0].output) == (2, *(plain(None, "a\nb")[i] for i in (1, 4)))
    assert (rows[2].n, rows[2].form, rows[2].output) == (0, "plain", "")
    assert fim.formatted(documents([])).collect() == []


def test_very_long_text(documents):
    long = "wörd <P <S>" [:9] * 400_000 + "\n" + "<" * 3_000_000 + "\n" + "end"
    assert [tuple(r)[1:] for r in fim.formatted(documents([long, "<" * 100 + "P>"])).collect()] == [plain(0, long), plain(1, "<" * 100 + "P>")]


def test_two_bytes_fix_the_state():
    """What lets all bytes step at once: after any two bytes, the state is the same from wherever it began."""
    for x in range(256):
        for y in range(256):
            assert len({int(fim.STEP[fim.STEP[s, x], y]) for s in range(4)}) == 1


def test_events_equal_a_walk():
    data = np.frombuffer("".join(ODD).encode(), np.uint8)
    starts = np.cumsum([0, *[len(t.encode()) for t in ODD]])[:-1]
    state, walked = fim.START, []
    for i, b in enumerate(data.tolist()):
        state = fim.START if i in set(starts.tolist()) else state
        walked.append(int(fim.EMIT[state, b]))
        state = int(fim.STEP[state, b])
    assert fim.emitted(data, starts).tolist() == walked
