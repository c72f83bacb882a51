import hashlib
import re
import time

from recordchecks.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = ["a@b.com@c.de x@y.zz_w@c.de q@b.c-d@e.fg", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255 9.9.9", "4111 1111 1111 1111, 4111-1111-1111-1112",
         "+1 (555) 123-4567. +12 +123456789012345678", "call +1 (555) 123-4567 4111111111111111 now", "é ü mail Ann.B+c@ex-ample.co.uk; 10.0.0.1",
         "4111111111111111 378282246310005 0000000000000000", "no data here", "@ @@ a@ @b.c +. 1.1.1.", "x\ny@z.org\n+44 20 7946 0958\n"]


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def slow_base(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                    "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]():
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_base_spans(make_docs, edge_rows):
    rows = edge_rows + [(100 + i, t, "s") for i, t in enumerate(TEXTS * 5)]
    got = pii.find(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), tuple(sum(x[3] == k for x in b) for k in PATTERNS), hashlib.sha256(joined(b).encode()).hexdigest())
                  for i, t, _ in rows for b in [slow_base(t or "")])
    assert sorted((str(r["doc_id"]), (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]), r["base_sha256"]) for r in got) == want
    texts = dict((i, t) for i, t, _ in rows)
    for r in got:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        base = [[k, str(a), str(b)] for a, _, b, k in slow_base(texts[r["doc_id"]] or "")]
        assert all(b in spans for b in base) and len(spans) == len(base) + r["n_added"]


def test_redaction(make_docs, edge_rows):
    rows = edge_rows[:6] + [(100 + i, t, "s") for i, t in enumerate(TEXTS * 3)]
    docs = make_docs(rows)
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        text = dict((i, t) for i, t, _ in rows)[r["doc_id"]]
        if text is None:
            assert r["text"] is None
            continue
        out, at = "", 0
        for kind, a, b in (s.split(":") for s in spans[r["doc_id"]].split(",") if s):
            if int(a) >= at:
                out += text[at:int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert r["text"] == out + text[at:]


def test_a_number_behind_a_phone_is_added(make_docs):
    rows = [(i, f"word +{i % 9 + 1} (555) 123-4567 word 4111111111111111 word user{i}@ex.com", "s") for i in range(200)]
    rows += [(1000 + i, f"word {4111111111111112 + 10 * i} word", "s") for i in range(60)]
    rows += [(5000, "in the +9 (999) 999-9999 4111111111111111 of", "s"), (5001, "plain words only", "s")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(make_docs(rows)).collect()}
    assert "card:25:41" in got[5000] and got[5001] == ""
    assert all(got[1000 + i] == "" for i in range(60) if not luhn(str(4111111111111112 + 10 * i)))


def test_each_added_generator_adds_what_no_base_pattern_finds(make_docs):
    planted = {"loose email": ("email", "word user{} (at) host (dot) com word"), "spaced email": ("email", "mail user{} @ host.com word"),
               "digit run": ("phone", "call (555) 123-4{:03d} word"), "phone format": ("phone", "word +1 (555) 123-4{:03d} 1234567890123456 word"),
               "card format": ("card", "word 4111111111111111 12{:03d} word"), "loose ip": ("ip", "word 2001:db8::{} word"),
               "link ip": ("ip", "word fe80::{} word")}
    rows = [(1000 * k + i, text.format(i), "s") for k, (_, text) in enumerate(planted.values()) for i in range(30)]
    decoys = ("at 10:20:30:40 sharp{}", "part 55512345{:03d} word", "see 00:1A:2B:3C:4D:{:02d} word", "id 1234567890123{:03d}0 word", "you @ 5.{} word")
    rows += [(100_000 + 1000 * k + i, text.format(i), "s") for k, text in enumerate(decoys) for i in range(60)]
    got = {r["doc_id"]: r for r in pii.find(make_docs(rows)).collect()}
    texts = {i: t for i, t, _ in rows}
    found = {i: [(k, texts[i][int(a):int(b)]) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)] for i, r in got.items()}
    for k, name in enumerate(planted):
        for i in range(30):
            want = {"loose email": f"user{i} (at) host (dot) com", "spaced email": f"user{i} @ host.com", "digit run": f"(555) 123-4{i:03d}",
                    "phone format": f"+1 (555) 123-4{i:03d}", "card format": "4111111111111111", "loose ip": f"2001:db8::{i}", "link ip": f"fe80::{i}"}[name]
            assert (planted[name][0], want) in found[1000 * k + i], (name, texts[1000 * k + i], found[1000 * k + i])
    assert all(r["n_added"] == 0 for i, r in got.items() if i >= 100_000 and not luhn(re.sub("[^0-9]", "", texts[i]) or "1"))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(make_docs(rows)).collect()}
    assert clean[0] == "word [EMAIL] word" and clean[2000] == "call [PHONE] word" and clean[5000] == "word [IP] word"


def test_long_runs_take_linear_time(make_docs):
    rows = [(1, "1.2.3.4 " * 3000 + "a@" + "b." * 30_000 + "c " + "7 " * 20_000, "s"), (2, "9" * 200_000, "s"), (3, "a" * 200_000, "s"), (4, "+" + "(" * 100_000, "s")]
    t0 = time.time()
    got = {r["doc_id"]: r for r in pii.find(make_docs(rows)).collect()}
    assert (got[1]["n_ip"], got[1]["n_email"], got[2]["n_card"]) == (3000, 1, 0) and time.time() - t0 < 60


def test_empty_table(make_docs):
    assert pii.find(make_docs([])).collect() == [] and pii.redact(make_docs([])).collect() == []


def test_no_python_on_the_path(make_docs):
    plan = pii.find(make_docs([(1, "x", "s")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
