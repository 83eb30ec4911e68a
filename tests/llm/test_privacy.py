import hashlib
import random
import re

from findlode.llm import privacy

#: The contract's patterns as they are written.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def luhn(s):
    total = 0
    for i, c in enumerate(s[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)] if "@" in text else []  # without one there is none, and the pattern is quadratic
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_those_of_the_patterns_on_random_text():
    rng = random.Random(5)
    parts = ["a@b.c", "@", "x@y", ".", "..", "-", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "+1 (555) 010-9999", "+", "4111 1111 1111 1111", "4111-1111-1111-1111", "411111111111111", " ", "\n", "é", "0", "007.08.09.010", "a@b@c.de", "%+-", "+49.30.123456", "999999999999", "((", "a.b@c-d.e-f"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert [(a, k, b) for a, b, k in privacy.base_spans(text)] == brute(text), text


def test_long_texts_take_no_more_than_linear_time():
    for text in ("a" * 300_000, "a." * 150_000 + "@", "1" * 20_000 + "a", "1." * 100_000, "+1" + "(" * 200_000, "+" * 100_000, "1 " * 150_000, "@" * 200_000):
        privacy.base_spans(text)


def test_result_columns(docs_of, rows_of, odd):
    texts = ["mail a.b@c.de now", "call +1 (555) 010-9999 or 10.0.0.1", *odd, "mail a.b@c.de now"]
    got = rows_of(privacy.personal_data(docs_of(texts, extra=True)))
    for i, t in enumerate(texts):
        base = brute(t)
        line = ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [got[i][f"n_{k}"] for k in privacy.KINDS] == [sum(x[1] == n for x in base) for n in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert got[i]["spans"] == line and got[i]["n_context"] == 0


def test_contexts_of_known_data_find_what_no_pattern_finds(docs_of, rows_of):
    known = [f"please reach me at user{i}@mail.example.com today" for i in range(30)]
    unseen = ["please reach me at 555-0142 today", "we sold 555-0143 of them"]
    got = rows_of(privacy.personal_data(docs_of(known + unseen)))
    assert got[30]["spans"] == "context:19:27" and got[30]["n_context"] == 1
    assert got[31]["spans"] == ""


def test_instances_that_trusted_patterns_surround_teach_new_patterns(docs_of, rows_of):
    first = [f"reach me at user{i}@mail.example.com" for i in range(60)]
    hidden = [f"reach me at id-{i}77" for i in range(8)]  # trusted by the first pattern
    second = [f"his badge says id-{i}77" for i in range(8)] + ["his badge says id-999"]  # so this pattern is learned
    got = rows_of(privacy.personal_data(docs_of(first + hidden + second)))
    assert all(got[60 + i]["n_context"] == 1 for i in range(8))
    assert all(got[68 + i]["n_context"] == 1 for i in range(9))
    once = rows_of(privacy.personal_data(docs_of(first + hidden + second), rounds=1))
    assert once[60]["n_context"] == 1 and once[76]["n_context"] == 0


def test_numbers_names_and_spelled_out_addresses_under_trusted_patterns(docs_of, rows_of):
    known = [f"please call us at user{i}@mail.example.com if needed" for i in range(100)]
    unseen = ["please call us at 555 014 2299 if needed", "please call us at (555) 010-9999, if needed", "please call us at 0555 123 456.", "please call us at john [at] mail [dot] org if needed", "please call us at JohnSmith! if needed", "we sold 555 014 2299 of them", "call John now"]
    got = rows_of(privacy.personal_data(docs_of(known + unseen)))
    found = lambda i: [unseen[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[100 + i]["spans"].split(",") if s]
    assert [found(i) for i in range(7)] == [["555 014 2299"], ["(555) 010-9999"], ["0555 123 456"], ["john [at] mail [dot] org"], ["JohnSmith"], [], []]


def test_words_after_an_instance_are_a_pattern_too(docs_of, rows_of):
    known = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}x said user{i}@mail.example.com is mine" for i in range(60)]
    got = rows_of(privacy.personal_data(docs_of([*known, "and 0555-1234 is mine"])))
    assert got[60]["spans"] == "context:4:13"


def test_a_pattern_that_mostly_surrounds_words_is_not_trusted(docs_of, rows_of):
    known = [f"reach me at user{i}@mail.example.com" for i in range(20)]
    words = [f"reach me at {a}{b}oon" for a in "bcdfghjklmn" for b in "aeiouy"]
    got = rows_of(privacy.personal_data(docs_of([*known, *words, "reach me at 0555-1234"])))
    assert not any(got[i]["n_context"] for i in range(len(known) + len(words) + 1))


def test_long_words_before_a_mark_are_taken_whole(docs_of, rows_of):
    long = "q" * 200
    known = [f"{long} {long}x user{i}@mail.example.com" for i in range(30)]
    got = rows_of(privacy.personal_data(docs_of([*known, f"{long} {long}x 0555-1234", f"{long} {long}y 0555-1234", f"q {long[1:]}x 0555-1235"])))
    assert [got[30 + i]["n_context"] for i in range(3)] == [1, 0, 0]


def test_rows_that_share_a_doc_id_keep_their_own_spans(docs_of):
    known = [(i, f"please reach me at user{i}@mail.example.com today") for i in range(30)]
    rows = [*known, (40, "please reach me at 555-0142 today"), (40, "nothing of the kind"), (None, "please reach me at 555-0143 today")]
    got = sorted((str(r["doc_id"]), r["spans"]) for r in privacy.personal_data(docs_of(rows)).collect() if r["n_context"] or r["doc_id"] == 40)
    assert got == [("40", ""), ("40", "context:19:27"), ("None", "context:19:27")]


def test_redaction(docs_of, odd):
    texts = ["mail a.b@c.de or 10.0.0.1!", "nothing here", *odd]
    docs = docs_of(texts, extra=True)
    out = privacy.redact(docs)
    assert out.schema == docs.schema
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["text"] == "mail <EMAIL> or <IP>!" and rows[0]["n_chars"] == len(rows[0]["text"])
    assert all(rows[i]["text"] == t for i, t in enumerate(texts) if i)


def test_nulls_repeats_and_empty_tables(docs_of):
    rows = [(None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd")]
    assert sorted(str(r["doc_id"]) + r["spans"] for r in privacy.personal_data(docs_of(rows)).collect()) == ["3email:0:6", "3email:0:6", "Noneemail:0:6"]
    empty = docs_of(rows).limit(0)
    assert privacy.personal_data(empty).count() == 0 and privacy.redact(empty).count() == 0
