import hashlib
import random
import re
import time

from findlode.llm import secrets

#: The contract's patterns as they are written.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def extra(text):
    own = base(text)
    found = [(m.start(), 3, m.end(), m[0]) for m in CANDIDATE.finditer(text or "") if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    return [f for f in found if not any(f[0] < b[2] and b[0] < f[2] for b in own)]


def brute(rows, most=2):
    owners = {}
    for _, text, source in rows:
        for *_, v in base(text) + extra(text):
            owners.setdefault(v, set()).update({source} - {None})
    out = {}
    for d, text, _ in rows:
        own = base(text)
        added = [x for x in extra(text) if len(owners[x[3]]) <= most]
        line = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in sorted(spans))
        out[d] = {"n_assign": sum(x[1] == 0 for x in own), "n_access": sum(x[1] == 1 for x in own), "n_hex": sum(x[1] == 2 for x in own), "base_sha256": hashlib.sha256(line(own).encode()).hexdigest(), "spans": line(own + added), "n_added": len(added), "n_live": sum(len(owners[x[3]]) <= most for x in own), "n_copied": sum(len(owners[x[3]]) > most for x in own)}
    return out


def rows_for(texts):
    return [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]


def check(docs_of, rows_of, texts):
    got = rows_of(secrets.secrets(docs_of(texts, extra=True)))
    for d, want in brute(rows_for(texts)).items():
        assert {k: got[d][k] for k in want} == want, (d, texts[d])


def test_spans_are_those_of_the_patterns(docs_of, rows_of, odd):
    rng = random.Random(6)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdefgh", "abc", "AKIA", "AKIAABCDEFGHIJKL", "ABCDEFGH12", "0123456789abcdef0123456789abcdef", "deadbeef", "é", "\n", "==", "x.y/z+w", "Zk3Zk3Zk3Zk3Zk3Zk3Zk3Zk3"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 16))) for _ in range(1500)]
    check(docs_of, rows_of, texts + odd)


def test_many_matches_in_one_text_cross_the_blocks_of_prefix_sums(docs_of, rows_of):
    check(docs_of, rows_of, [" é ".join(f"token=abcdefgh{i}" for i in range(700)), "x"])


def test_a_long_dump_of_keys_takes_seconds(docs_of, rows_of):
    """A text of 5 MB with 60,000 base spans and 60,000 candidates beside them, one in four of which touches a base span."""
    rng = random.Random(8)
    hexes = ["%032x" % rng.getrandbits(128) for _ in range(60_000)]
    text = "".join(f"{h}{'_' if i % 4 == 0 else ' '}Ab1{h.upper()[:20]}\n" for i, h in enumerate(hexes))
    began = time.monotonic()
    got = rows_of(secrets.secrets(docs_of([text, None])))[0]
    took = time.monotonic() - began
    assert got["n_hex"] == 60_000 and got["n_added"] == 45_000
    assert got["spans"].startswith("hex:0:32,hex:57:89,owned:90:113") and took < 60, took


def test_widely_copied_candidates_are_examples(docs_of, rows_of):
    key = "Qx7Qx7Qx7Qx7Qx7Qx7Qx7Qx7"
    texts = [f"use {key} here"] * 6 + ["mine is Ab1Ab1Ab1Ab1Ab1Ab1Ab1Ab1 ok"] + ["password=sharedvalue"] * 5
    got = rows_of(secrets.secrets(docs_of(texts)))
    assert got[0]["spans"] == "" and got[6]["spans"] == "owned:8:32"
    assert got[7]["n_copied"] == 1 and got[7]["spans"] == "assign:0:20"


def test_nulls_repeats_and_empty_tables(docs_of):
    rows = [(None, "token=abcdefgh"), (4, "token=abcdefgh"), (4, "token=abcdefgh"), (5, None)]
    got = secrets.secrets(docs_of(rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_assign"]) for r in got) == [("4", 1), ("4", 1), ("5", 0), ("None", 1)]
    assert secrets.secrets(docs_of(rows).limit(0)).count() == 0


def test_no_python_in_the_plan(docs_of):
    plan = secrets.found_in(docs_of(["x"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
