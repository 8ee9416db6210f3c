import hashlib
import random
import re

from fixtures import EDGE, docs

from vexel.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_plain_expressions(spark):
    random.seed(3)
    texts = ["".join(random.choice("aB1.@-+ ()%9_024 5") for _ in range(random.randint(0, 60))) for _ in range(800)] + EDGE
    texts += ["4539 1488 0343 6467 x 4539-1488-0343-6467 1.2.3.4.5.6.7.8 a@b.c_d@e.f \U0001F600 x@y.zz +1 (234) 555-1234 12", "1" * 20000, "+1" + "(" * 20000, "a@b" + ".c" * 20000]
    rows = {r.doc_id: r for r in pii.found_pii(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        want, r = base(t), rows[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [sum(w.startswith(k) for w in want) for k in PATTERNS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert [s for s in r.spans.split(",") if s and not s.startswith("id:")] == want
    assert pii.found_pii(docs(spark, EDGE).limit(0)).count() == 0


def test_contexts_of_seeds_discover_identifiers(spark):
    texts = [f"please write to mail: user{i}@example.com today" for i in range(12)] + ["please write to mail: user77(at)example-com today", "we sold item: user88(at)example-com today"]
    rows = {r.doc_id: r.spans for r in pii.found_pii(docs(spark, texts)).collect()}
    assert rows[12] == "id:22:43" and rows[13] == ""


def test_keys_of_other_shapes_and_letters_alone(spark):
    """Keys are seeds; what stands in their place is found whatever its shape, and a key in no such place isn't."""
    random.seed(5)
    key = lambda: "".join(random.choice("0123456789abcdef") for _ in range(40))
    texts = [f'set token = "{key()}" here' for _ in range(12)] + ['set token = "hunterbunny" here', f"the commit {key()} went in", "set level = high here"]
    rows = {r.doc_id: r.spans for r in pii.found_pii(docs(spark, texts)).collect()}
    assert all(rows[i] == "id:13:53" for i in range(12)) and rows[12] == "id:13:24" and rows[13] == rows[14] == ""


def test_planted_keys_of_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    planted = {i for i, t in texts.items() if re.search(r'(?i)token = "[0-9a-f]{40}"', t)}
    found = {r.doc_id for r in pii.found_pii(df).collect() if r.n_id}
    assert len(planted & found) >= 0.95 * len(planted) and len(found - planted) <= 0.02 * len(texts)


def test_many_matches_in_one_text(spark):
    """Places are summed up in chunks: 8,000 matches, and each kind over the ends of chunks."""
    text = " ".join(f"u{i}@x.org 10.0.0.{i % 256} w{i}" for i in range(8_000))
    r = pii.found_pii(docs(spark, [text])).first()
    want = base(text)
    assert r.n_email == r.n_ip == 8_000 and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
