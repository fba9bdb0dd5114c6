"""Base spans of personal data against plain patterns, and the rounds of patterns and values against plain Python."""

import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from stave.llm import contextual_pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _base(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15])


ODD = [
    "a@b.c", "x@y.com%foo@bar.de._z@q.w", "a@b a@b. a@b.c.d..e@f.g", "@a.b", "a@a@a.b@c.d", "é@b.c 😀x@y.z", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.255.0.9 1.2.3", "11.22.33.4444444444444444444444444",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 5500005555555559", "1 2", "+1 (017) 555-7713", "+1 2345678", "+12 (3)4.5-6 7 8 9 0 +3", "+1 234 5678 9012 3456 7", "+4+49 30 1234567-", None, "", " ",
    "." * 300 + "a@b.c", "7" * 500, "a" * 500 + "@", "+" * 50 + "1 23456789",
]


def test_base_spans(spark, tmp_path):
    rng = random.Random(2)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_000, ODD[1]), (None, ODD[1])]
    rows += [(20_000 + i, "".join(rng.choice("ab1234567890.@+- ()é") for _ in range(200))) for i in range(400)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op12_contextual_pii(spark, str(tmp_path)).collect()
    want = collections.Counter()
    for d, text in rows:
        base = _base(text or "")
        n = collections.Counter(x[3] for x in base)
        want[d, n["email"], n["ip"], n["card"], n["phone"], ",".join(f"{k}:{a}:{e}" for a, _, e, k in base)] += 1

    def own(spans):
        return ",".join(x for x in spans.split(",") if not x.startswith("contextual_"))

    assert collections.Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, own(r.spans)) for r in got) == want
    assert all(hashlib.sha256(own(r.spans).encode()).hexdigest() == r.base_sha256 for r in got)


CANDIDATE = re.compile(r"(?<![^\W_]|[._@+#/-])(?:(?:[^\W\d_]|[._@+#/-])*[0-9]){4,}(?:[^\W_]|[._@+#/-])*")


def _plain(docs, support=5, confidence=0.8, rounds=4):
    """Values found by context and their kinds, by the rules in plain Python (ASCII contexts)."""
    edges, seeds = collections.defaultdict(set), collections.defaultdict(set)
    for text in docs:
        base = _base(text)
        spans = [(a, e, k, p) for a, _, e, k in base for p in [{"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[k]]]
        spans += [(m.start(), m.start() + len(re.sub("[._@+#/-]+$", "", m.group())), "candidate", CANDIDATE) for m in CANDIDATE.finditer(text)]
        for a, e, k, form in spans:
            if k == "candidate" and any(x[0] < e and a < x[2] for x in base):
                continue
            stops = [m.end() for m in form.finditer(text) if m.end() <= a]
            starts = [m.start() for m in form.finditer(text) if m.start() >= e]
            end = next(m.end() for m in form.finditer(text) if m.start() == a)
            left = text[max(0, a - 48, *stops): a]
            right = text[end: min([end + 48, len(text), *starts])]
            words = [re.sub("[0-9]", "0", x.lower()).split() for x in (left, right)]
            value = text[a:e].lower()
            for n in (2, 3):
                if len(words[0]) >= n:
                    edges[" ".join(words[0][-n:]) + " _"].add(value)
            if words[0] and words[1]:
                edges[words[0][-1] + " _ " + words[1][0]].add(value)
            if k != "candidate":
                seeds[value].add(k)
    found = {}
    for _ in range(rounds):
        doubt = collections.defaultdict(lambda: 1.0)
        for values in edges.values():
            for kind in P.BASE:
                beliefs = [1.0 if kind in seeds[v] else found[v][1] if v in found and found[v][0] == kind else 0.0 for v in values]
                score = sum(beliefs) / (len(values) + 1)
                if sum(b >= confidence for b in beliefs) >= support and score >= confidence:
                    for v in values:
                        if not seeds[v]:
                            doubt[v, kind] *= 1 - score
        now = {}
        for (v, kind), d in doubt.items():
            if 1 - d >= confidence:
                now[v] = max(now.get(v, ("", 0.0)), (kind, 1 - d), key=lambda x: (x[1], x[0]))
        if {v: k for v, (k, _) in now.items()} == {v: k for v, (k, _) in found.items()}:
            break
        found = now
    return {v: k for v, (k, _) in found.items()}


def _corpus():
    rng = random.Random(8)
    docs = [f"Please call the desk at +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} before noon." for _ in range(150)]
    docs += [f"You may call the desk at 555-{n}111 before noon, or leave ticket {n}{n} there." for n in range(20)]
    # Second round: the values just found vouch for another pattern.
    docs += [f"extension of doctor 555-{n}111." for n in range(22)]
    # Orders look like identifiers but stand among other numbers than seeds.
    docs += [f"order number is {rng.randint(10 ** 7, 10 ** 8)} now" for _ in range(30)] + [f"order number is +1 (222) 555-{1000 + i} now" for i in range(6)]
    docs += ["write to a1@b.example today", "on 2024-05-06 the desk at noon", "x"]
    return docs * 2


def test_rounds_against_plain_python(spark):
    docs = _corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    want = _plain(docs)
    assert want["555-7111"] == "phone" and want["555-21111"] == "phone" and not any(v.startswith("2024") for v in want)
    for r in P.scan_personal_data(df).collect():
        text = docs[r.doc_id]
        mine = sorted((s.start, s.end, s.kind) for s in r.found if s.kind.startswith("contextual_"))
        found = {text[a:e].lower(): k.removeprefix("contextual_") for a, e, k in mine}
        for a, _, e, _ in _base(text):
            text = text[:a] + "|" * (e - a) + text[e:]
        expected = {v: k for v, k in want.items() if re.search(rf"(?<![\w-]){re.escape(v)}(?![\w-])", text.lower())}
        assert found == expected, text


def test_seeds_of_another_kind(spark):
    docs = [(i, f"badge of visitor V{10_000 + i} at the gate") for i in range(20)] + [(30, "badge of visitor X77777, and seat R1234")]
    seeds = spark.createDataFrame([(f"V{10_000 + i}", "badge") for i in range(19)] + [(None, "badge")], "value string, kind string")
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.found] for r in P.scan_personal_data(spark.createDataFrame(docs, "doc_id long, text string"), seeds=seeds).collect()}
    assert got[30] == [(17, 23, "contextual_badge")] and got[19] == [(17, 23, "contextual_badge")] and got[0] == []


def test_long_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.scan_personal_data(df).count() == 0
    long = ["a" * 2_000_000, "a1-" * 700_000, "x@" * 500_000, "a@b" + ".c" * 500_000, "1 " * 700_000, "-" * 1_000_000 + "1234", "1." * 500_000]
    got = P.scan_personal_data(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).select("doc_id", F.size("found").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 125_000}
