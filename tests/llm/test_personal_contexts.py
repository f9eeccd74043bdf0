"""Words of any form are discovered at confident contexts."""

import random
import re
from math import prod

from versight.llm import personal_data

SEEDS = [(i, f"please contact email q{i}@z.com now thanks") for i in range(40)]


WORDS = ["jane(at)example.org", "jane.doe@localhost", "x7", "0171 555 1234", "jane at example org"]


def test_short_and_spaced_identifiers(spark):
    docs = spark.createDataFrame([*SEEDS, *((100 + i, f"contact email {w} now please") for i, w in enumerate(WORDS)), (200, "nothing here")], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in personal_data.find_personal_data(docs).collect()}
    redacted = {r.doc_id: r.text for r in personal_data.redact(docs.selectExpr("*", "1 as _vi", "'x' as _vk", "3 as _vnew")).collect()}
    for i, w in enumerate(WORDS):
        assert found[100 + i] == f"email:14:{14 + len(w)}" and redacted[100 + i] == "contact email [EMAIL] now please"
    assert found[200] == "" and redacted[200] == "nothing here"


def test_plain_words_lower_the_confidence(spark):
    docs = spark.createDataFrame([*SEEDS[:12], *((100 + i, f"contact email {w} now please") for i, w in enumerate("soon here them us often again".split()))], "doc_id long, text string")
    assert all(r.spans == "" for r in personal_data.find_personal_data(docs).where("doc_id >= 100").collect())


def test_discovered_instances_support_further_patterns(spark):
    words = [f"user{chr(97 + i)}(at)host" for i in range(12)]
    first = [(100 + i, f"contact email {w} now please") for i, w in enumerate(words)]
    second = [(200 + i, f"reach {w} today") for i, w in enumerate(words)]
    docs = spark.createDataFrame([*SEEDS, *((1000 + i, f"please contact email r{i}@z.com now thanks") for i in range(60)), *first, *second, (300, "reach someone(at)else today")], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in personal_data.find_personal_data(docs).collect()}
    n = len(words[0])
    assert found[100] == f"email:14:{14 + n}" and found[200] == f"email:6:{6 + n}" and found[300] == f"email:6:{6 + len('someone(at)else')}"


def brute(texts):
    """{text number: discovered (kind, start, end)} by loops, for texts with at most one fixed form, between blanks."""
    plain, forms = str.maketrans("123456789", "000000000"), {}
    edges, kinds, mentions = {}, {}, []
    for t, text in enumerate(texts):
        forms[t] = next(((k, m.start(), m.end(), m[0].lower()) for k, p in enumerate((r"\S+@\S+\.\w+", r"\b\d+\.\d+\.\d+\.\d+\b")) for m in [re.search(p, text)] if m), None)
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\S+", text)]
        near = [w.translate(plain) for _, _, w in words]
        fixed = [bool(forms[t]) and s == forms[t][1] for s, _, _ in words]
        digit = [("0" in c) and not f for c, f in zip(near, fixed, strict=True)]
        at = lambda x, i, none=None: x[i] if 0 <= i < len(x) else none
        for i in range(len(words)):
            for n in range(1, 5):
                b, a, own = at(near, i - 1), at(near, i + n), fixed[i : i + n]
                if len(own) < n or (any(own) and n > 1):
                    continue
                numbers = all(digit[i : i + n]) and not at(digit, i - 1, False) and not at(digit, i + n, False)
                ps = [(0, b, a)] * (bool(b or a) if n == 1 else bool(b and a) or (numbers and bool(b or a)))
                ps += [p for p in ((1, b), (2, a)) if p[1] and (n == 1 or numbers)]
                inst = tuple(w for _, _, w in words[i : i + n])
                if any(own):
                    kinds[inst] = forms[t][0]
                else:
                    mentions.append((t, words[i][0], words[i + n - 1][1], n, inst, ps))
                for p in ps:
                    edges.setdefault(p, set()).add(inst)
    scores, good = {(i, k): 1.0 for i, k in kinds.items()}, {}
    while True:
        new = {}
        for p, own in edges.items():
            for k in (0, 1):
                total, strong = sum(scores.get((i, k), 0.0) for i in own), sum(scores.get((i, k), 0.0) >= 0.8 for i in own)
                if strong >= 5 and total / (len(own) + 1) >= 0.8:
                    new[p, k] = total / (len(own) + 1)
        if new.keys() == good.keys():
            break
        good = new
        for (p, k), conf in good.items():
            for i in edges[p]:
                if i not in kinds:
                    scores[i, k] = 1 - prod(1 - c for (q, kind), c in good.items() if kind == k and i in edges[q])
    out = {}
    for t, start, end, n, inst, ps in mentions:
        found = [(c, -k) for (p, k), c in good.items() if p in ps]
        if found:
            out.setdefault(t, []).append((-n, start, end, -max(found)[1]))
    kept = {}
    for t, spans in out.items():
        for _, start, end, k in sorted(spans):
            if all(end <= s or e <= start for _, s, e in kept.setdefault(t, [])):
                kept[t].append((k, start, end))
    return {t: sorted(v) for t, v in kept.items()}


def test_discovery_equals_brute_force_and_finds_hidden_ones(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 6)))
    frames = ["please write to {} about it", "his address {} was given", "log of {} at night", "seen near {} with others", "host {} answered"]
    texts, hidden = [], 0
    for i in range(500):
        frame = rng.choice(frames)
        own = f"u{i}@{word()}.org" if frame != frames[2] and frame != frames[4] else f"10.{i % 250}.{rng.randint(0, 255)}.7"
        if rng.random() < 0.12:  # in a form that no pattern has
            own = own.replace("@", " at ").replace(".org", " dot org") if "@" in own else own.replace(".", "-")
            hidden += frame != frames[3]
        if frame == frames[3] and rng.random() < 0.5:
            own = word()
        texts.append(" ".join([*(word() for _ in range(rng.randint(0, 3))), frame.format(own), *(word() for _ in range(rng.randint(0, 3)))]))
    texts += ["", "one", "  please write to  nobody  about it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {k: i for i, k in enumerate(personal_data.KINDS)}
    got = {}
    for r in personal_data.find_personal_data(docs).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        base = re.search(r"\S+@\S+\.\w+|\b\d+\.\d+\.\d+\.\d+\b", texts[r.doc_id])
        new = sorted((kinds[k], int(s), int(e)) for k, s, e in spans if not (base and (int(s), int(e)) == base.span()))
        if new:
            got[r.doc_id] = new
    want = brute(texts)
    assert got == want
    assert sum(len(v) for v in got.values()) >= 0.9 * hidden > 20
