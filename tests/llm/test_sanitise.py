import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.llm import sanitise

from .conftest import sentence


def test_kinds():
    text = 'Mail ann.34@mail7.example.com or +1 (523) 555-1055, 523-555-1055, 10.1.2.3, 4785380592391139, 123-45-6789, DE89370400440532013000, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff".'
    assert [k for _, _, k, _ in sanitise.entities(text)] == ["EMAIL", "PHONE", "PHONE", "IP", "CARD", "SSN", "IBAN", "SECRET"]
    clean = "Version 3.1.2.4.5 of 2024-01-02, 999.1.1.1 and 12345 items @ home; a.b.c"
    assert sanitise.entities(clean) == []
    out, n, *_ = sanitise.rewrite(text, {})
    assert n == 8 and "example" not in out and "555" not in out and "24be" not in out


SECRETS = ["password: correcthorsebatterystaple", "ask bob, token=abcdefghijklmnopqrst ok", "abcdefabcdefabcdefabcdefabcdefabcdef", "API-KEY\u00a0: abcdefghijklmnop", "+\u0661 \u0662\u0663\u0664 \u0665\u0666\u0667 \u0661\u0662\u0663", "x@y.example", "f0" * 80]


def test_hint_passes_every_entity(spark):
    rng = random.Random(4)
    parts = ["token", "SECRET", "passwd", "PassWord", "api_key", "apikey", " ", "\u2003", "\x85", "\x1c", ":", "=", "'", "abcdefghijklmnopqr", "abcdef" * 6, "ABCDEF" * 6, "@", "a.b", "12", "\u0663", "\U00011f53", "-", ".", "+", "DE89", "\u017fecret", "to\u212aen"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(20000)] + SECRETS
    hinted = {r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").where(F.col("t").rlike(sanitise.HINT)).collect()}
    found = {t for t in texts if sanitise.entities(t)}
    assert len(found) > 1000 and set(SECRETS) <= found and found <= hinted
    got = sanitise.sanitised(spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")).collect()
    assert all(r.entities == 1 and r.text != SECRETS[r.doc_id] for r in got)


def brute(docs, support, generalise, remove):
    """Actions by (entity, word) from counts over documents, contexts being groups that share bands."""
    n = len(docs)
    bands = sanitise.bands(pa.array([sanitise._masked(t, sanitise.entities(t)) for t in docs]))
    ctx = list(range(n))
    for _ in range(4):
        ctx = [min(ctx[j] for j in range(n) if set(bands[i]) & set(bands[j])) for i in range(n)]
    df, ents, both = Counter(), defaultdict(list), defaultdict(list)
    for i, t in enumerate(docs):
        masked = sanitise._masked(t, sanitise.entities(t))
        df.update(set(re.findall(r"[a-z0-9]+", t.lower())))
        for e in {(k, v) for _, _, k, v in sanitise.entities(t)}:
            ents[e].append(i)
            for w in set(re.findall(r"[a-z0-9]+", masked.lower())):
                both[e, w].append(i)
    acts = {}
    for (e, w), at in both.items():
        ce, c = len({ctx[i] for i in ents[e]}), len({ctx[i] for i in at})
        p, q = df[w] / n, c / ce
        if c < support or len(ents[e]) == n or q <= p or c * math.log(q / p) + ((ce - c) * math.log((1 - q) / (1 - p)) if q < 1 else 0) < sanitise.CHANCE:
            continue
        s = math.log(n * len(at) / (len(ents[e]) * df[w])) / math.log(n / len(ents[e]))
        if s >= generalise:
            acts[e, w] = 2 if s >= remove else 1
    return acts


def test_disclosures_equal_brute_force(spark):
    rng = random.Random(8)
    docs = []
    for i in range(120):
        t = sentence(rng, 25)
        if i % 6 == 0:
            t += " codename zephyrus at boss@corp.example.org today"
        elif i % 6 == 1:
            t += " zephyrwind sometimes today" if i % 12 == 1 else " call +1 (523) 555-1055"
        elif i % 30 == 2:
            t += " zephyrus too"
        docs.append(t)
    acts = brute(docs, sanitise.SUPPORT, 0.7, 0.9)
    assert {w for (e, w), a in acts.items() if e[0] == "EMAIL"} >= {"codename", "zephyrus"} and {a for a in acts.values()} == {1, 2}
    want = {}
    for i, t in enumerate(docs):
        terms = {}
        for e in {(k, v) for _, _, k, v in sanitise.entities(t)}:
            for (f, w), a in acts.items():
                if e == f:
                    terms[w] = max(a, terms.get(w, 0))
        out = t
        for a, b, kind, _ in reversed(sanitise.entities(t)):
            out = out[:a] + "\x01" + kind + "\x01" + out[b:]
        for w, a in terms.items():
            out = re.sub(rf"( ?)(?<![a-z0-9\x01]){w}(?![a-z0-9\x01])", (lambda m: "") if a == 2 else (lambda m: m[1] + "[TERM]"), out)
        want[i] = re.sub("\x01([A-Z]+)\x01", r"[\1]", out)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in sanitise.sanitised(table).collect()}
    assert got == want
    assert {r.doc_id: r.text for r in sanitise.sanitise(table).collect()} == want


def test_two_contexts_suffice_where_chance_does_not(spark):
    rng = random.Random(3)
    docs = [sentence(rng, 30) for _ in range(200)]
    docs[5] += " zephyrus lives with 523-555-1055 there"
    docs[90] += " so does zephyrus at 523-555-1055 now"
    out = {r.doc_id: r for r in sanitise.sanitised(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert all("zephyrus" not in out[i].text and "[PHONE]" in out[i].text and out[i].removed >= 1 for i in (5, 90))
    assert all(out[i].text == docs[i] for i in range(200) if i not in (5, 90))


def test_copies_are_one_piece_of_evidence(spark):
    text = "rare gloaming words about x@y.example.org here"
    table = spark.createDataFrame([(i, text) for i in range(40)] + [(i, "plain other words") for i in range(40, 80)], "doc_id long, text string")
    assert {r.text for r in sanitise.sanitise(table).collect()} == {"rare gloaming words about [EMAIL] here", "plain other words"}


def test_odd_rows(spark, odd, none):
    got = sanitise.sanitise(odd)
    assert got.columns == odd.columns and sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))
    assert sanitise.sanitise(none).count() == 0 and sanitise.sanitised(none).count() == 0
    long = "word " * 50000 + "a@b.example.org"
    table = spark.createDataFrame([(1, long), (1, long), (None, "10.1.2.3"), (2, None)], "doc_id long, text string")
    assert sorted(str(r.text)[-10:] for r in sanitise.sanitise(table).collect()) == ["None", "[IP]", "rd [EMAIL]", "rd [EMAIL]"]
